import random
import zlib

import numpy as np
import pytest

from rasterloom.llm import language, quality, toxicity

DOCS = "doc_id long, text string, score string, held_out int"


def corpus():
    """(rows of documents, of labels): prose, shouted junk, and abuse in which some terms are misspelled."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(800)]
    docs, labels = [], []
    for i in range(600):
        words = rng.choices(vocabulary, k=rng.randint(20, 80))
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["numbskull", "dimwit", "wretched", "blockhead"]))
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text, "clash", 7))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    docs += [(None, docs[0][1], None, None), (1, docs[1][1], None, None), (9000, None, None, None), (9001, "", None, None), (9002, "x" * 300_000 + " y" * 50_000, None, None)]
    labels += [(None, 1, 1), (9000, None, None), (9999, 0, 1), labels[3]]
    return spark.createDataFrame(docs, DOCS).repartition(2), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,label,modulus,rest", [(quality, 2 - 1, 3, 1), (toxicity, 2, 4, 2)])
def test_held_out_accuracy_and_odd_rows(spark, tables, module, label, modulus, rest):
    docs, labels = tables
    rows = module.score(docs, module.train(docs, labels)).collect()
    assert len(rows) == docs.count()
    truth = {r[0]: r[label] for r in corpus()[1]}
    right = total = 0
    for r in rows:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD)
        if r.held_out and r.doc_id in truth:
            total += 1
            right += r.predicted == truth[r.doc_id]
    assert total > 100 and right / total > 0.97
    assert len({r.score for r in rows if r.doc_id == 1}) == 1 and len([r for r in rows if r.doc_id == 1]) == 2


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_rows_or_labels(spark, tables, module):
    docs, labels = tables
    model = module.train(docs, labels.limit(0))
    assert module.score(docs.limit(0), model).count() == 0
    assert all(0 <= r.score <= 1 for r in module.score(docs.limit(3), model).collect())


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.95
    bins, manual = m.bins(x), np.full(len(x), m.base)
    for i in range(len(x)):
        manual[i] += sum(t[bins[i, j]] for j, t in enumerate(m.tables)) + sum(t[bins[i, a], bins[i, b]] for (a, b), t in zip(m.pairs, m.pair_tables))
    assert np.allclose(manual, m.logit(x))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("bound", [50_000, 20])
def test_automata_against_edit_distance(monkeypatch, bound):
    monkeypatch.setattr(toxicity.Product, "STATES", bound)
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 12)))
    terms = sorted({word() for _ in range(30)})
    lexicon = toxicity.Lexicon(terms, [1.0] * len(terms))
    for _ in range(1500):
        w = word()
        allowed = toxicity.edits_for_size(len(w))
        near = min(((d, i) for i, t in enumerate(terms) if (d := distance(w, t)) <= min(allowed, toxicity.edits_for_size(len(t)))), default=None)
        want = (terms.index(w), 0) if w in terms else (near[1], near[0]) if near else None
        assert lexicon.find(w) == want


def test_misspelled_and_quoted_terms():
    lexicon = toxicity.Lexicon(["numbskull", "dimwit"], [4.0, 4.0])
    names = toxicity.FEATURES
    feature = lambda text: dict(zip(names, lexicon.features(text)))
    assert feature("you absolute dimwit here")["direct"] > 0
    assert feature("what a numbskul and nmbskull")["misspelled"] > 0 and feature("what a numbskul")["direct"] == 0
    quoted = feature('they wrote "dimwit" on it')
    assert quoted["quoted"] > 0 and quoted["direct"] == 0
    assert not any(lexicon.features("plain words")) and not any(lexicon.features(None)) and not any(lexicon.features(""))
    model = toxicity.Model(lexicon, toxicity._PRIOR, -3.0)
    score = lambda t: model.score(np.array([lexicon.features(t)]))[0]
    assert score("you dimwit") > score("you dimwot") > score("he said dimwit was a word") > score("hello")


def speak(rng, letters, n):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(6)
    letters = {"aa": "abcdefg", "bb": "defghijk", "cc": "éèàxyzw"}
    docs = [(i, speak(rng, letters[k := "aa bb cc".split()[i % 3]], rng.randint(5, 40)), k, "clash") for i in range(400)]
    odd = [(None, "abc cab", "aa", ""), (1000, None, "aa", ""), (1001, "", "bb", ""), (1002, "12 34 !! _", "bb", ""), (1003, "漢字 漢", None, ""), (1004, "ßßß", None, "")]
    df = spark.createDataFrame(docs + odd + docs[:2], "doc_id long, text string, lang string, lang_pred string")
    model = language.train(df)
    assert model.languages == ["aa", "bb", "cc"]
    rows = language.identify(df, model).collect()
    assert len(rows) == len(docs) + len(odd) + 2
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 80 and sum(r.lang_pred == docs[r.doc_id][2] for r in held) / len(held) > 0.97
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1000, 1001, 1002))
    assert by_id[1003].lang_pred in model.languages and all(0 <= r.score <= 1 for r in rows)
    assert by_id[None].held_out
    none = language.train(df.limit(0))
    assert {r.lang_pred for r in language.identify(df.limit(2), none).collect()} == {"und"} and language.identify(df.limit(0), model).count() == 0


def test_unseen_words_fall_back_to_the_longest_known_grams():
    m = language.Model(["a", "b"], [(0, "a", "known", 5), (3, "a", "xyz", 2), (3, "b", "xyw", 2), (1, "b", "q", 9)], {(0, "a"): 5})
    assert m.word("known")[0] == [m.rows[0]["known"]]
    assert m.word("uxyzu") == ([m.rows[3]["xyz"]], 3 / language.LONGEST)
    assert m.word("qq")[0] == [m.rows[1]["q"]] * 2 and m.word("z") == ([], 0.0)


def test_misspelled_words_with_a_stem_are_met():
    lexicon = toxicity._lexicon([("skrum*", 30, 0), ("skrumling", 10, 0), ("skrumlord", 10, 0), ("skrumbag", 10, 0)], 100, 200)
    assert lexicon.terms == ["skrum"] and lexicon.stems == 1
    assert lexicon.find("skrumling") == lexicon.find("skrumwort") == (0, 0)
    assert lexicon.find("skrvmlord") == lexicon.find("krumbag") == (0, 1) and lexicon.find("sgrvmling") == (0, 2)
    assert lexicon.find("umbrella") is None
    assert lexicon.features("what a skrvmlord that is")[toxicity.FEATURES.index("misspelled")] > 0


def test_quotations_are_counted_from_the_start_of_the_line():
    lexicon = toxicity.Lexicon(["skrumling"], [3.0])
    told = lambda text: lexicon.features(text)[toxicity.FEATURES.index("quoted")] > 0
    long = "plain talk " * 60
    assert told(f'"{long} skrumling {long}"') and told('"skrumling"') and not told(f'"\n{long} skrumling')
    assert not told(f'"{long}" skrumling') and not told("it's a skrumling")


def test_languages_by_brute_force(spark):
    """All words and n-grams of the learned documents, counted and scored by the docstrings; over 20,000 words of a language."""
    rng = random.Random(7)
    docs = [(i, speak(rng, "abcdefghijklm" if i % 2 else "ghijklmnopqrst", 400), "ab"[i % 2]) for i in range(110)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    counts, totals = {}, {}
    for i, t, x in docs:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            for w in language.words_of(t):
                for kind in range(language.LONGEST + 1):
                    for e in language.grams(w, kind) if kind else [w]:
                        counts[kind, e, x] = counts.get((kind, e, x), 0) + 1
                        totals[kind, x] = totals.get((kind, x), 0) + 1
    sizes = [len({e for k, e, _ in counts if k == kind}) for kind in range(language.LONGEST + 1)]
    known = {(k, e) for k, e, _ in counts}
    assert max(len({e for k, e, x in counts if k == 0 and x == y}) for y in "ab") > 10_000

    def log(kind, e, x):
        return np.log((counts.get((kind, e, x), 0) + 0.5) / (totals[kind, x] + 0.5 * (sizes[kind] + 1)))

    def judge(text):
        total = {"a": 0.0, "b": 0.0}
        for w in language.words_of(text):
            for kind in [0, *range(language.LONGEST, 0, -1)]:
                found = [e for e in (language.grams(w, kind) if kind else [w]) if (kind, e) in known]
                if found:
                    for x in total:
                        total[x] += sum(log(kind, e, x) for e in found) / len(found) * (kind / language.LONGEST if kind else 1)
                    break
        a, b = (np.exp(language.SHARE * (total[x] - max(total.values()))) for x in "ab")
        return ("a" if a >= b else "b", max(a, b) / (a + b))

    for r in language.identify(df, language.train(df)).collect():
        want = judge(docs[r.doc_id][1])
        assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-4


def test_chance_against_the_sum():
    from math import comb

    for n, rate in ((1, 0.3), (7, 0.05), (40, 0.5), (300, 0.1)):
        for k in range(0, n + 1, max(1, n // 10)):
            exact = sum(comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k, n + 1))
            got = toxicity._chance(k, n, rate)
            assert got == 1.0 if k <= n * rate else abs(got - exact) <= 1e-9 * exact
    assert toxicity._chance(2500, 9000, 0.27) > 1e-3 and toxicity._chance(6000, 7000, 0.1) < 1e-300


def test_no_bound_on_terms_or_their_documents():
    """Over 1000 terms, a term of over 2000 documents, and a word of as many that is no term."""
    counts = [(f"term{i:04d}x", 40, 0) for i in range(1500)] + [("often", 5000, 100), ("usual", 3000, 9000)]
    lexicon = toxicity._lexicon(counts, 10_000, 30_000)
    assert set(lexicon.terms) == {w for w, _, _ in counts} - {"usual"}
    assert lexicon.find("term1499x") == (lexicon.terms.index("term1499x"), 0) and lexicon.find("usual") is None


def plain_features(lexicon, text):
    """The features of a text, hit by hit, from the docstrings."""
    low, words = (text or "").lower(), toxicity.words_of(text)
    places, at = [], 0
    for w in words:
        at = low.index(w, at)
        places.append(at)
        at += len(w)
    hits = [(i, *f) for i, w in enumerate(words) if (f := lexicon.find(w))]
    direct = misspelled = quoted = crowded = person = strongest = 0.0
    for n, (i, term, edits) in enumerate(hits):
        line = low[low.rfind("\n", 0, places[i]) + 1 : places[i]]
        marks = sum(c in "\"“”„«»‘’'`" and not (c in "'’`" and k and line[k - 1].isalnum()) for k, c in enumerate(line))
        weight = lexicon.near[term] if edits and lexicon.near else lexicon.weights[term]
        around = set(words[max(0, i - toxicity.CONTEXT) : i + toxicity.CONTEXT + 1])
        if marks % 2 or around & toxicity._REPORT:
            quoted += weight
            continue
        direct, misspelled = (direct, misspelled + weight / edits) if edits else (direct + weight, misspelled)
        crowded += weight * any(k != n and abs(j - i) <= toxicity.CONTEXT for k, (j, _, _) in enumerate(hits))
        person += weight * bool(around & toxicity._PERSON)
        strongest = max(strongest, weight / (1 + edits))
    every = direct + misspelled
    return [np.log1p(every), 10 * every / (len(words) + 20) if hits else 0.0, *map(np.log1p, (direct, misspelled, quoted, crowded, person)), strongest / 5]


def test_toxicity_by_brute_force(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    rng = random.Random(11)
    parts = ["dimwit", "dimwut", "numbskull", "numskul", "wretched", "blockhed", "you", "said", '"', "'", "it's", "\n", ".", "plain", "words", "“", "”"]
    texts = [None, "", *(" ".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(df, model).collect():
        x = np.array(plain_features(model.lexicon, texts[r.doc_id]))
        assert abs(r.score - 1 / (1 + np.exp(-(x @ model.weights + model.base)))) < 1e-9


def plain_quality(model, text):
    """A text's score: the base, a table entry for each feature and for each pair of them."""
    x, total = quality.features((text or "").encode()), model.base
    at = [sum(e <= v for e in edges.tolist()) for v, edges in zip(x, model.edges, strict=True)]
    total += sum(t[i] for t, i in zip(model.tables, at, strict=True)) + sum(t[at[i], at[j]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def test_quality_by_brute_force(spark, tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.where("doc_id IS NOT NULL").collect()}
    for r in quality.score(docs.where("doc_id IS NOT NULL"), model).collect():
        assert abs(r.score - plain_quality(model, texts[r.doc_id])) < 1e-9
