import random

import xxhash

from rasterloom.llm import simhash
from rasterloom.llm.common import connected_components


def brute_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "One", "ONE two", "a b c", "A\x0bB\x1cC d e É é", "x " * 3000, *(" ".join(rng.choices(["tic", "TAC", "toe", "ñ"], k=rng.randint(1, 60))) for _ in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in simhash.fingerprints(df).collect():
        assert r.fp % 2**64 == brute_fingerprint(texts[r.doc_id])


def check(spark, values, crowded=None):
    old = simhash.CROWDED
    simhash.CROWDED = crowded or old
    try:
        rows = [(i if i else None, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(values)]
        got = simhash.components(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    finally:
        simhash.CROWDED = old
    assert len(got) == len(values)
    pairs = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 2]
    root = roots(range(len(values)), pairs)
    least = {}
    for i in range(1, len(values)):
        least[root[i]] = min(least.get(root[i], i), i)
    for r in got:
        i = r.doc_id if r.doc_id is not None else 0
        assert r.component_id == least.get(root[i]) and r.fingerprint == f"{values[i]:016x}"


def values(seed):
    rng = random.Random(seed)
    out = [0, 0, 1, 2**64 - 1, 2**63]
    for _ in range(25):
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            out.append(v)
            for _ in range(rng.choice([0, 1, 2, 3])):
                v ^= 1 << rng.randrange(64)
    return out


def test_components(spark):
    check(spark, values(1))


def test_crowded_keys_lose_no_link(spark):
    check(spark, values(2), crowded=1)


def test_long_chain(spark):
    nodes = list(range(60))
    random.Random(5).shuffle(nodes)
    edges = spark.createDataFrame([*zip(nodes, nodes[1:]), (100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(nodes, 0), 100: 100, 101: 100}


def test_clashing_columns_and_empty(spark):
    schema = "doc_id long, text string, fingerprint string, component_id string, fp string"
    df = spark.createDataFrame([(4, "a b", "x", "y", "z"), (4, "a b", "x", "y", "z"), (2, "A b", "", "", "")], schema)
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(2, 2), (4, 2), (4, 2)]
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_documents_with_nulls_clashing_columns_and_no_rows(spark):
    schema = "doc_id long, text string, fingerprint int, component_id string, fp string"
    rows = [(4, "one two three four", 1, "x", "y"), (2, "ONE two  three four", 2, "x", "y"), (2, "one two three four", 3, None, None), (None, "one two three four", 4, "x", "y"), (9, None, 5, "x", "y"), (8, " ", 6, "x", "y")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    same = f"{brute_fingerprint(rows[0][1]):016x}"
    want = [(4, same, 2), (2, same, 2), (2, same, 2), (None, same, 2), (9, "0" * 16, 8), (8, "0" * 16, 8)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_candidates_are_all_that_meet(spark, monkeypatch):
    found = sorted(set(values(4)))
    distinct = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in found], "fp long")
    ends = [64 * i // 6 for i in range(7)]
    agree = lambda x: sum(not x >> a & (1 << b - a) - 1 for a, b in zip(ends, ends[1:]))
    wanted = {frozenset((a, b)) for a in found for b in found if a < b and agree(a ^ b) >= 2 and (a ^ b).bit_count() <= 12}
    assert {frozenset((a, b)) for a in found for b in found if a < b and (a ^ b).bit_count() <= 4} <= wanted
    monkeypatch.setattr(simhash, "MEETING", 64)
    got = simhash.candidates(distinct).collect()
    assert {frozenset((r.a % 2**64, r.b % 2**64)) for r in got} == wanted and len(got) == len(wanted)
    monkeypatch.setattr(simhash, "MEETING", 1)
    fewer = {frozenset((r.a % 2**64, r.b % 2**64)) for r in simhash.candidates(distinct).collect()}
    assert fewer and fewer <= wanted and len(fewer) < len(found)
    assert simhash.candidates(distinct.limit(0)).count() == 0
