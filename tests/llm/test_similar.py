import random
import tracemalloc

import pytest

import corpus_pipeline
from rasterloom.llm import similar, words

from .test_simhash import brute_fingerprint, roots


def sets(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def corpus(seed):
    """Copies with some words changed, on both sides of 0.8, and a line that many texts have."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    line = " ".join(word() for _ in range(12))
    texts = [None, "", " ", "One two", "one TWO", "one two three four five", "one two three four six"]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(20, 150))]
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 30))):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own) + (" " + line if rng.random() < 0.5 else ""))
    return texts


@pytest.mark.parametrize("seed,usual", [(1, 50), (2, 3), (3, 0)])
def test_against_brute_force_jaccard(spark, monkeypatch, seed, usual):
    monkeypatch.setattr(similar, "USUAL", usual)
    texts = corpus(seed)
    own = [sets(t) for t in texts]
    alike = [(a, b) for a in range(len(texts)) for b in range(a) if (not own[a] and not own[b]) or 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])]
    assert any((brute_fingerprint(texts[a]) ^ brute_fingerprint(texts[b])).bit_count() > 4 for a, b in alike)
    root = roots(range(len(texts)), alike)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(3)
    assert {r.doc_id: r.component_id for r in similar.near_duplicates(df).collect()} == root
    if seed == 1:
        docs = df.select("doc_id", "text")
        assert {r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()} == {*root.values()}


@pytest.mark.parametrize("crowded,block", [(64, 1 << 19), (2, 1 << 19), (2, 700), (1, 200)])
def test_large_groups_are_compared_in_blocks(spark, monkeypatch, crowded, block):
    """Copies of one text with ever more words changed, those of two changed starts, and a text apart."""
    monkeypatch.setattr(similar, "CROWDED", crowded)
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "USUAL", 5)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(80)]
    texts = []
    for _ in range(150):
        own = list(base) if rng.random() < 0.7 else [word() for _ in range(12)] + base[12:]
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    texts.append(" ".join(word() for _ in range(50)))
    own = [sets(t) for t in texts]
    alike = [(a, b) for a in range(len(texts)) for b in range(a) if 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])]
    root = roots(range(len(texts)), alike)
    assert 5 < len({*root.values()}) < 130
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in similar.near_duplicates(df).collect()} == root


@pytest.mark.parametrize("meeting", [64, 1])
def test_simhash_offers_texts_that_are_verified(spark, monkeypatch, meeting):
    """Without the pairs of the join: what fingerprints of at most four bits apart offer is linked where it is similar enough, and
    nothing else is; with the join all is, however few pairs the fingerprints offer."""
    monkeypatch.setattr(similar.simhash, "MEETING", meeting)
    texts = corpus(4)
    own, prints = [sets(t) for t in texts], [brute_fingerprint(t) for t in texts]
    alike = [(a, b) for a in range(len(texts)) for b in range(a) if (not own[a] and not own[b]) or 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])]
    near = [(a, b) for a, b in alike if (prints[a] ^ prints[b]).bit_count() <= 4]
    copies = [(a, b) for a, b in near if (texts[a] or "").lower().split() == (texts[b] or "").lower().split()]
    assert len(copies) < len(near) < len(alike)
    root = roots(range(len(texts)), alike)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    stage = lambda: {r.doc_id for r in corpus_pipeline.simhash_stage(spark, df, "").collect()}
    assert stage() == {*root.values()}
    monkeypatch.setattr(similar, "_may", lambda x, y: similar.F.lit(False))
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(df).collect()}
    assert all(root[got[i]] == root[i] for i in got)
    if meeting > 1:
        assert all(got[a] == got[b] for a, b in near)
    assert {*root.values()} <= {*got.values()} and len({*got.values()}) < len({*roots(range(len(texts)), copies).values()})


def test_hashing_words_holds_few_times_the_text(monkeypatch):
    texts = [(b"x" * 900 + b" ") * 1000, b"", b"y" * 300_000 + b" z", b"one two  three " * 2000] * 2
    words._powers.cache_clear()
    tracemalloc.start()
    hashes, starts = words.word_hashes(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    assert starts.tolist() == [0, 1000, 1000, 1002, 7002, 8002, 8002, 8004, 14004]
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(words, "PIECE", size)
        assert (words.word_hashes(texts)[0] == hashes).all()
