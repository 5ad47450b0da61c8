"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata so that misspelled terms count too.

Each found term is weighed in its context: a window of words around it tells whether it is quoted or reported, and
whether more terms or a second person are near. A logistic model over the sums of the weighed terms gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped
from .labelled import held_out, sample

#: At most so many labelled rows are learned from; all words of theirs that pass the test below are terms.
TRAIN_ROWS = 20_000
MODULUS, REST, THRESHOLD = 4, 2, 0.3
#: Words of context on each side; word lengths from which one and two edits are allowed; words whose verdict is kept.
CONTEXT, ONE_EDIT, TWO_EDITS, CACHED = 8, 5, 9, 200_000
#: A term's chance under the labels' base rate must be below this.
CHANCE = 1e-6
#: Lengths of word beginnings that may be terms (stems); a stem must occur in so many times the documents of any one word with it.
STEM_SIZES, STEM_GAIN = range(4, 9), 2
#: Counts that a task holds before it sends them on.
HELD_COUNTS = 200_000

_WORD = re.compile(r"\w+")
#: Quotation marks, and the end of a line.
_MARK = re.compile("[\"“”„«»‘’'`\n]")
#: Words that report what others say. The lexicon is learned; these only set a weight of their own.
_REPORT = frozenset("said says wrote writes called calls quote quoted quoting word words term reported comment sagte schrieb nannte zitat wort dit écrit appelé citation mot dijo escribió llamó cita palabra".split())
_PERSON = frozenset("you your youre u du dich dir dein ihr euch tu te toi ton ta vous votre tú ti tus usted vosotros".split())

FEATURES = ("every", "every_share", "direct", "misspelled", "quoted", "crowded", "person", "strongest")
#: What a weight is drawn to where labels say nothing: quoted terms count for little.
_PRIOR = np.array([1.2, 0.5, 0.8, 0.6, 0.1, 0.5, 0.2, 0.5])


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Trie:
    """Terms by their characters; `end` of a node is the number of the term that ends there, or -1."""

    def __init__(self, terms: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.end = [-1]
        for number, term in enumerate(terms):
            at = 0
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.end.append(-1)
                at = self.next[at][c]
            self.end[at] = number


class Product:
    """The Levenshtein automata of all terms, intersected with the trie and made deterministic as words go through it.

    A state is a set of trie nodes with the edits that led there, so all terms are met in one walk of a word. States
    are kept up to a bound and then made anew.
    """

    STATES = 50_000

    def __init__(self, terms: list[str], edits: int) -> None:
        self.trie, self.edits = Trie(terms), edits
        self._reset()

    def _reset(self) -> None:
        self.states: list[dict[int, int]] = [{}]
        self.numbers: dict[frozenset, int] = {frozenset(): 0}
        self.moves: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes)
        while todo:  # characters that the word leaves out
            n = todo.pop()
            if nodes[n] < self.edits:
                for child in self.trie.next[n].values():
                    if nodes.get(child, self.edits + 1) > nodes[n] + 1:
                        nodes[child] = nodes[n] + 1
                        todo.append(child)
        key = frozenset(nodes.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(nodes)
        return self.numbers[key]

    def _move(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for n, e in self.states[state].items():
            below = self.trie.next[n]
            if c in below:
                out[below[c]] = min(e, out.get(below[c], e))
            if e < self.edits:
                out[n] = min(e + 1, out.get(n, e + 1))
                for child in below.values():
                    out[child] = min(e + 1, out.get(child, e + 1))
        after = self.moves[state, c] = self._state(out)
        return after

    def nearest(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term that is long enough for so many edits, the first of equals by number."""
        if len(self.states) > self.STATES:
            self._reset()
        at, moves = self.start, self.moves
        for c in word:
            after = moves.get((at, c))
            at = self._move(at, c) if after is None else after
            if not at:
                return None
        found = [(e, t) for n, e in self.states[at].items() if (t := self.trie.end[n]) >= 0]
        return min(((e, t) for e, t in found if e <= self.allowed[t]), default=None) if found else None

    #: Edits that each term's length allows.
    @cached_property
    def allowed(self) -> list[int]:
        sizes = [0] * (max(self.trie.end) + 1)
        todo = [(0, 0)]
        while todo:
            n, depth = todo.pop()
            if self.trie.end[n] >= 0:
                sizes[self.trie.end[n]] = depth
            todo += [(child, depth + 1) for child in self.trie.next[n].values()]
        return [edits_for_size(n) for n in sizes]


def edits_for_size(n: int) -> int:
    return 2 if n >= TWO_EDITS else 1 if n >= ONE_EDIT else 0


@dataclass
class Lexicon:
    """Terms with weights (log odds), weights of words near them, and the words that look like a term but are ordinary.

    The last `stems` terms are beginnings, with which all words count that go on from them. `under` has the counted
    words that begin with a stem, with its number: misspelled ones count as misspelled terms of the stem.
    """

    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    ordinary: frozenset[str] = frozenset()
    near: list[float] = field(default_factory=list)
    stems: int = 0
    under: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        words = len(self.terms) - self.stems
        self.exact = {t: i for i, t in enumerate(self.terms[:words])}
        self.begin = {t: i for i, t in enumerate(self.terms) if i >= words}
        self.sizes = sorted({len(t) for t in self.begin}, reverse=True)
        met = [*self.terms[:words], *self.under]
        self.number = [*range(words), *self.under.values()]
        self.products = [None, Product(met, 1), Product(met, 2)]
        self.known: dict[str, tuple[int, int] | None] = {}

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of a word, if it is a term or a misspelled one."""
        if word in self.exact:
            return self.exact[word], 0
        for n in self.sizes:
            if word[:n] in self.begin:
                return self.begin[word[:n]], 0
        edits = edits_for_size(len(word))
        if not edits or word in self.ordinary:
            return None
        found = self.products[edits].nearest(word)
        return (self.number[found[1]], found[0]) if found else None

    def _learn(self, word: str) -> tuple[int, int] | None:
        found = self.find(word)
        if len(word) <= 40:
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[word] = found
        return found

    def features(self, text: str | None) -> list[float]:
        words, known = words_of(text), self.known
        terms = {}
        for w in {*words}:
            found = known[w] if w in known else self._learn(w)
            if found is not None:
                terms[w] = found
        if not terms:
            return [0.0] * len(FEATURES)
        hits = [(i, terms[w]) for i, w in enumerate(words) if w in terms]
        # Whether an odd number of quotation marks came before each hit in its line
        low = text.lower()
        spans = [m.start() for m in _WORD.finditer(low)]
        marks, odd, inside = _MARK.finditer(low), False, []
        mark = next(marks, None)
        for i, _ in hits:
            while mark is not None and (p := mark.start()) < spans[i]:
                if low[p] == "\n":
                    odd = False
                elif not (low[p] in "'’`" and p and low[p - 1].isalnum()):
                    odd = not odd
                mark = next(marks, None)
            inside.append(odd)
        direct = misspelled = quoted = crowded = person = strongest = 0.0
        places = [i for i, _ in hits]
        for n, (i, (term, e)) in enumerate(hits):
            weight = self.near[term] if e and self.near else self.weights[term]
            around = words[max(0, i - CONTEXT) : i + CONTEXT + 1]
            told = inside[n] or not _REPORT.isdisjoint(around)
            near = (n > 0 and i - places[n - 1] <= CONTEXT) or (n + 1 < len(places) and places[n + 1] - i <= CONTEXT)
            if told:
                quoted += weight
            elif e:
                misspelled += weight / e
            else:
                direct += weight
            if not told:
                crowded += near * weight
                person += (not _PERSON.isdisjoint(around)) * weight
                strongest = max(strongest, weight / (1 + e))
        every = direct + misspelled
        return [float(np.log1p(every)), 10 * every / (len(words) + 20), float(np.log1p(direct)), float(np.log1p(misspelled)), float(np.log1p(quoted)), float(np.log1p(crowded)), float(np.log1p(person)), strongest / 5]


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.base, -30, 30)))


def _chance(k: int, n: int, rate: float) -> float:
    """At least k of n by chance; 1 where that is no surprise at all."""
    if k <= n * rate:
        return 1.0
    at = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    total, term, odds = 0.0, 1.0, rate / (1 - rate)
    for i in range(k, n + 1):  # beyond the mean each term is less than the one before
        total += term
        term *= (n - i) / (i + 1) * odds
        if term < 1e-12 * total:
            break
    return math.exp(min(0.0, at + math.log(total)))


def _lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> Lexicon:
    """counts: (word, toxic documents with it, clean ones with it); a word that ends in * is a beginning of words."""
    if not toxic or not clean:
        return Lexicon()
    rate, found = toxic / (toxic + clean), []
    for w, t, c in counts:
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
        if odds > 1.5 and _chance(t, t + c, rate) < CHANCE:
            found.append((-odds * np.log1p(t), -len(w), w, float(odds), t))
    found.sort()
    widest: dict[str, int] = {}  # of each beginning: the documents of the most frequent word with it
    for w, t, _ in counts:
        if w[-1:] != "*":
            for n in STEM_SIZES:
                if n < len(w):
                    widest[w[:n]] = max(widest.get(w[:n], 0), t)
    stems: dict[str, float] = {}
    for _, _, w, odds, t in sorted(found, key=lambda x: (-x[3] * x[4], x[1], x[2])):  # of nested ones the one that tells most
        own = w[:-1]
        if w[-1:] == "*" and t >= STEM_GAIN * max(2, widest.get(own, 0)) and not any(x.startswith(own) or own.startswith(x) for x in stems):
            stems[own] = odds
    words = [(w, o) for _, _, w, o, _ in found if w[-1:] != "*" and not any(w[:n] in stems for n in STEM_SIZES)]
    kept = [*words, *stems.items()]
    terms = [w for w, _ in kept]
    numbers = {w: len(words) + i for i, w in enumerate(stems)}
    under = {w: numbers[w[:n]] for w, _, _ in counts if w[-1:] != "*" for n in STEM_SIZES if w[:n] in numbers}
    return Lexicon(terms, [o for _, o in kept], stems=len(numbers), under=under)


def _near_weight(t: int, c: int, toxic: int, clean: int, most: float) -> float:
    """Log odds of a word near a term, from documents without a term; a guess above a tenth of one clean document stands
    in for evidence that is missing."""
    return float(np.clip(np.log((t + 1) / (c + 0.1)) - np.log((toxic + 1) / (clean + 1)), 0, most))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights, none below zero, drawn to the prior; by Newton steps."""
    w, base = _PRIOR.copy(), 0.0
    a = np.hstack((x, np.ones((len(x), 1))))
    prior, pull = np.append(_PRIOR, -3.0), np.append(np.full(len(_PRIOR), 1.0), 0.01)
    v = np.append(w, -3.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        grad = a.T @ (p - y) + pull * (v - prior)
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        v = v - np.clip(step, -2, 2)
        v[:-1] = np.maximum(v[:-1], 0)
        if np.abs(step).max() < 1e-6:
            break
    return v[:-1], float(v[-1])


def sketch(text: str) -> int:
    """The least hash of three words in a row: near copies mostly have the same, other texts don't."""
    words = words_of(text)
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    return min(map(xxhash.xxh64_intdigest, runs)) >> 1


def _without_copies(chosen: DataFrame) -> DataFrame:
    """One text of each sketch and label: what stands in many copies of one text is no evidence about its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [sketch(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], ["text", "label", "half", "sketch"])

    told = chosen.transform(mapped, run, "text string, label int, half int, sketch long")
    first = told.groupBy("sketch", "label").agg(F.min(F.struct(F.length("text"), "text")).alias("t"))
    return first.select("t.text", "label", F.pmod(F.xxhash64(F.lit("half"), "sketch"), F.lit(2)).cast("int").alias("half"))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", rows: int = TRAIN_ROWS, modulus: int = MODULUS, rest: int = REST, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learn from at most `rows` labelled documents. Words are counted on the executors; only those that could be terms
    and the documents' features come to the driver. Weights are fitted on documents that the lexicon of that step hasn't
    seen; the lexicon is then learned anew from all.
    """
    chosen = cut(_without_copies(sample(docs, labels, label, modulus, rest, rows, doc_id=doc_id, text=text)))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, str], list[int]] = {}

        def out() -> pa.RecordBatch:
            rows_ = list(counts.items())
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([h for (h, _), _ in rows_], pa.int32()), pa.array([w for (_, w), _ in rows_], pa.string()), pa.array([c[1] for _, c in rows_], pa.int64()), pa.array([c[0] for _, c in rows_], pa.int64())], ["half", "word", "toxic", "clean"])

        for b in batches:
            for t, y, h in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = {*words_of(t.as_py())}
                for w in own | {w[:n] + "*" for w in own for n in STEM_SIZES if n < len(w)}:
                    counts.setdefault((h, w), [0, 0])[y > 0] += 1
                if len(counts) > HELD_COUNTS:
                    yield out()
        yield out()

    sizes = {(r.half, r.toxic): r.n for r in chosen.groupBy("half", (F.col("label") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = sum(n for (_, y), n in sizes.items() if y), sum(n for (_, y), n in sizes.items() if not y)
    if not toxic or not clean:
        share = (toxic + 0.05) / (toxic + clean + 0.5)
        return Model(Lexicon(), np.zeros(len(FEATURES)), float(np.log(share / (1 - share))))
    counted = chosen.transform(mapped, words, "half int, word string, toxic long, clean long").groupBy("word").agg(*(F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for c in ("toxic", "clean") for h in (0, 1)))
    counted = cut(counted)
    both_t, both_c = F.col("toxic0") + F.col("toxic1"), F.col("clean0") + F.col("clean1")
    # Log odds above 1.5 in all or in one half: few words of any corpus.
    def strong(t, c, n_t: int, n_c: int):
        return (t >= 3) & ((t + 0.5) * (n_c + 1) > 4.48 * (c + 0.5) * (n_t + 1))

    half_t, half_c = sizes.get((0, 1), 0), sizes.get((0, 0), 0)
    likely = counted.where(strong(both_t, both_c, toxic, clean) | strong(F.col("toxic0"), F.col("clean0"), half_t, half_c)).collect()
    first = _lexicon([(r.word, r.toxic0, r.clean0) for r in likely], half_t, half_c)
    final = _lexicon([(r.word, r.toxic0 + r.toxic1, r.clean0 + r.clean1) for r in likely], toxic, clean)
    # Ordinary words near a term: those that clean documents have more often than their share
    usual = counted.where(~F.endswith("word", F.lit("*")) & (both_c >= 3) & (both_c * toxic >= both_t * clean))
    sent = docs.sparkSession.sparkContext.broadcast((first, final))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[str] = set()
            for lexicon in sent.value:
                found |= {w for w in b.column(0).to_pylist() if (t := lexicon.find(w)) is not None and t[1]}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["word"])

    ordinary = frozenset(r.word for r in usual.select("word").transform(mapped, near, "word string").collect())
    first, final = (Lexicon(x.terms, x.weights, ordinary, stems=x.stems, under=x.under) for x in (first, final))
    shown = docs.sparkSession.sparkContext.broadcast((first, final))

    def missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of documents without a term: how many of each label have a word near each term."""
        counts: dict[tuple[int, int], list[int]] = {}
        for b in batches:
            for t, y, h in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = {*words_of(t.as_py())}
                for k, lexicon in enumerate(shown.value):
                    if k or not h:
                        found = [f for w in words if (f := lexicon.find(w)) is not None]
                        for term in {i for i, _ in found} if all(e for _, e in found) else ():
                            counts.setdefault((k, term), [0, 0])[y > 0] += 1
        rows_ = list(counts.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for (k, _), _ in rows_], pa.int32()), pa.array([t for (_, t), _ in rows_], pa.int32()), pa.array([c[1] for _, c in rows_], pa.int64()), pa.array([c[0] for _, c in rows_], pa.int64())], ["lexicon", "term", "toxic", "clean"])

    seen = chosen.transform(mapped, missed, "lexicon int, term int, toxic long, clean long").groupBy("lexicon", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    seen = {(r.lexicon, r.term): (r.toxic, r.clean) for r in seen.collect()}  # two lexicons' terms at most
    for k, (lexicon, t, c) in enumerate(((first, half_t, half_c), (final, toxic, clean))):
        lexicon.near = [_near_weight(*seen.get((k, i), (0, 0)), t, c, w) for i, w in enumerate(lexicon.weights)]
    again = docs.sparkSession.sparkContext.broadcast((first, final))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [again.value[0].features(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "label"])

    unseen = chosen.where("half = 1").select("text", "label").transform(mapped, measure, "x array<double>, label int").toArrow()
    x = np.array(unseen["x"].to_pylist(), float).reshape(unseen.num_rows, len(FEATURES))
    weights, base = _logistic(x, (unseen["label"].to_numpy() > 0).astype(float)) if first.terms else (_PRIOR, float(np.log(toxic / clean)) - 1.0)
    return Model(final, np.round(weights, 9), round(base, 9))


def score(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, modulus: int = MODULUS, rest: int = REST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs.

    Null and empty texts have no terms and get the score of such texts. Null ids count as held out; repeated
    rows are scored alike; an empty table gives no rows. Further columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), held_out(doc_id, modulus, rest).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            x = np.array([m.lexicon.features(t.as_py()) for t in b.column(1)], float).reshape(b.num_rows, len(FEATURES))
            s = m.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return chosen.transform(mapped, run, f"doc_id {dict(docs.dtypes)[doc_id]}, held_out boolean, score double, predicted int")
