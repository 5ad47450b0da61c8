"""Language identification, words first: a known word scores by its log frequency in each language; for an unseen
word, its character n-grams do, the longest of which some are known.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped
from .labelled import held_out

#: At most so many documents are learned from, and all of their words and n-grams.
TRAIN_ROWS = 20_000
MODULUS, REST = 3, 1
LONGEST = 4
#: Words are not independent; this share of the log odds of a text goes into the score.
SHARE = 0.25
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with its ends marked; those of length 1 are its characters."""
    marked = f"\x02{word}\x03" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Entries:
    """Entries of one kind by ascending hashes; their rows follow each other from `first` on."""

    def __init__(self, hashes: np.ndarray, first: int) -> None:
        self.hashes, self.first = hashes, first

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Rows, -1 where there is no such entry."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + self.first, -1)

    def get(self, entry: str) -> int | None:
        row = int(self.find(hashes_of([entry]))[0])
        return None if row < 0 else row

    def __getitem__(self, entry: str) -> int:
        row = self.get(entry)
        if row is None:
            raise KeyError(entry)
        return row


def hashes_of(entries: list[str]) -> np.ndarray:
    """As Spark's xxhash64, unsigned."""
    return np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in entries), np.uint64, len(entries))


class Model:
    """rows[n] has the rows of `logs`, with a column for each language; n is 0 for words. Entries are known by 64 bits."""

    def __init__(self, languages: list[str], counts: list[tuple[int, str, str, int]], totals: dict[tuple[int, str], int]) -> None:
        """counts: (kind, language, entry, count); totals: of all entries of a kind in a language."""
        place = {x: i for i, x in enumerate(languages)}
        kinds, langs, n = (np.array(x, np.int64) for x in zip(*((k, place[x], c) for k, x, _, c in counts), strict=True)) if counts else [np.empty(0, np.int64)] * 3
        self._set(languages, kinds, langs, hashes_of([e for _, _, e, _ in counts]), n, totals)

    @classmethod
    def of(cls, languages: list[str], kinds: np.ndarray, langs: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> Model:
        totals: dict[tuple[int, str], int] = {}
        for kind in range(LONGEST + 1):
            own = np.bincount(langs[kinds == kind], n[kinds == kind], len(languages))
            totals |= {(kind, x): int(c) for x, c in zip(languages, own, strict=True)}
        model = cls.__new__(cls)
        model._set(languages, kinds, langs, hashes, n, totals)
        return model

    def _set(self, languages: list[str], kinds: np.ndarray, langs: np.ndarray, hashes: np.ndarray, n: np.ndarray, totals: dict[tuple[int, str], int]) -> None:
        self.languages, self.rows, logs, first = languages, [], [], 0
        for kind in range(LONGEST + 1):
            own = kinds == kind
            known, at = np.unique(hashes[own], return_inverse=True)
            counts = np.full((len(known), len(languages)), 0.5)
            np.add.at(counts, (at, langs[own]), n[own])
            logs.append(np.log(counts / np.array([totals.get((kind, x), 0) + 0.5 * (len(known) + 1) for x in languages])))
            self.rows.append(Entries(known, first))
            first += len(known)
        self.logs = np.concatenate(logs).astype(np.float32)

    def word(self, word: str) -> tuple[list[int], float]:
        """Rows of `logs` for a word, and what each of them weighs; no rows where not even a character is known."""
        at = self.rows[0].get(word)
        if at is not None:
            return [at], 1.0
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            found = [x for g in grams(word, n) if (x := self.rows[n].get(g)) is not None]
            if found:
                return found, n / LONGEST / len(found)
        return [], 0.0

    def total(self, counts: dict[str, int]) -> np.ndarray:
        """Sums of the log frequencies of these words, as `word` has them, all at once."""
        words, times = list(counts), np.fromiter(counts.values(), float, len(counts))
        at = self.rows[0].find(hashes_of(words))
        known = at >= 0
        total = times[known] @ self.logs[at[known]]
        open_ = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if not len(open_):
                break
            own = [grams(words[i], n) for i in open_.tolist()]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            at = self.rows[n].find(hashes_of([g for x in own for g in x]))
            owner = np.repeat(np.arange(len(own)), sizes)[at >= 0]
            at, found = at[at >= 0], np.bincount(owner, minlength=len(own))
            total = total + (times[open_[owner]] * (n / LONGEST) / found[owner]) @ self.logs[at]
            open_ = open_[found == 0]
        return total


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS, modulus: int = MODULUS, rest: int = REST) -> Model:
    """Learn from at most `rows` documents that aren't held out and have a language, in the order of a hash of their ids."""
    usable = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull() & ~held_out(doc_id, modulus, rest))
    key = F.col(f"`{doc_id}`")
    ids = usable.select(key.alias("__key")).distinct().orderBy(F.xxhash64("__key"), "__key").limit(rows)
    chosen = usable.select(key.alias("__doc"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    chosen = chosen.join(F.broadcast(ids), F.col("__doc") == F.col("__key")).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = []
            for x, own in words.items():
                rows += [(0, x, w, k) for w, k in own.items()]
                for n in range(1, LONGEST + 1):
                    c: dict[str, int] = {}
                    for w, k in own.items():
                        for g in grams(w, n):
                            c[g] = c.get(g, 0) + k
                    rows += [(n, x, g, k) for g, k in c.items()]
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.int64()))], ["kind", "lang", "entry", "n"])

        for b in batches:
            for t, x in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words.setdefault(x, Counter()).update(words_of(t.as_py()))
                if sum(map(len, words.values())) > 200_000:
                    yield out()
        yield out()

    counted = chosen.transform(mapped, run, "kind int, lang string, entry string, n long").groupBy("kind", "lang", F.xxhash64("entry").alias("h")).agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counted["lang"].unique().to_pylist()))
    langs = pc.index_in(counted["lang"], pa.array(languages, pa.string())).to_numpy()
    return Model.of(languages, counted["kind"].to_numpy(), langs, counted["h"].to_numpy().view(np.uint64), counted["n"].to_numpy())


def identify(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", modulus: int = MODULUS, rest: int = REST) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of docs.

    `und` and 0 for a text that is null, empty or without a letter, and where nothing was learned. A tie goes
    to the first language by name. Null ids count as held out; repeated rows are judged alike; an empty table
    gives no rows. Further columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), held_out(doc_id, modulus, rest).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            names, scores = [], []
            for t in b.column(1):
                counts = Counter(words_of(t.as_py()))
                if not m.languages or not any(any(map(str.isalpha, w)) for w in counts):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = m.total(counts)
                odds = np.exp(np.maximum(SHARE * (total - total.max()), -700))
                best = int(np.argmax(odds))
                names.append(m.languages[best])
                scores.append(float(odds[best] / odds.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return chosen.transform(mapped, run, f"doc_id {dict(docs.dtypes)[doc_id]}, held_out boolean, lang_pred string, score double")
