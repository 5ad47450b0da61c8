import hashlib
import random
import re

import pytest

from rasterloom.llm import decontaminate as dc
from rasterloom.llm.common import cut


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        t = words(t)
        n = min(10, len(t))
        for s in range(max(1, len(t) - 9) if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == t[s : s + n]:
                    hit |= set(range(p, p + n))
                    found.add("null" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("round_words,segment_words", [(1 << 20, 1 << 21), (15, 50)])
def test_against_brute_force(spark, monkeypatch, round_words, segment_words):
    monkeypatch.setattr(dc, "ROUND_WORDS", round_words)
    monkeypatch.setattr(dc, "SEGMENT_WORDS", segment_words)
    rng = random.Random(2)
    some = lambda k: " ".join(rng.choices(["a", "B", "cé", "d1", "the"], k=k))
    items = [(i, some(rng.choice([1, 3, 9, 10, 11, 14]) if i > 6 else 14)) for i in range(9)] + [(20, None), (21, " ,"), (None, some(12)), (3, some(10))]
    items = [x for x in items if len(words(x[1])) > 1 or not words(x[1])]
    docs = [(None, None, "x"), (1, "", "x"), (2, some(300), "x"), (2, some(300), "x"), (4, some(5) + ",;" + (items[0][1] or "").upper() + "--" + items[1][1] + " zzz", "x"), (5, "zzz " * 200, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_hit string").repartition(2)
    got = dc.contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    rows = sorted(map(repr, (tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())))
    assert rows == sorted(repr((d[0], *brute(d[1], items))) for d in docs)


def test_empty_tables(spark):
    docs, items = "doc_id long, text string", "item_id string, text string"
    one = spark.createDataFrame([(1, "a b")], docs)
    none = dc.contamination(one, spark.createDataFrame([], items)).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in none] == [(2, 0, False)]
    assert dc.contamination(one.limit(0), spark.createDataFrame([("q", "a b")], items)).count() == 0


def test_proximity(spark):
    df = spark.createDataFrame([(1, "red x green x x blue"), (2, "blue green red"), (3, "red green"), (4, "red y y y y y blue green"), (5, "red blue")], "doc_id long, text string").coalesce(1)
    index = cut(dc.build_index(df))
    got = {(r.query, r.doc_id, r.first, r.last) for r in dc.search_near(index, {"q": ["red", "green", "blue"], "none": ["red", "pink"]}, 6).collect()}
    assert got == {("q", 1, 0, 5), ("q", 2, 0, 2)}


def test_one_index_serves_many_test_sets(spark, tmp_path):
    """Written, read again, and asked twice."""
    df = spark.createDataFrame([(1, "a b c d e"), (2, "c d x"), (3, None)], "doc_id long, text string")
    dc.build_index(df).write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    found = []
    for items in ([("p", b"C, D")], [("q", b"x"), ("r", b"d E f")]):
        (tests,) = dc.rounds(items)
        found.append(sorted((r.doc_id, r.n_words, [tuple(x) for x in r.spans], r["items"]) for r in dc.search_phrases(index, tests).collect()))
    assert found == [[(1, 5, [(2, 4)], ["p"]), (2, 3, [(0, 2)], ["p"]), (3, 0, [], [])], [(1, 5, [], []), (2, 3, [(2, 3)], ["q"]), (3, 0, [], [])]]
