from collections import Counter

import pytest

from rasterloom.llm import sharding


def test_table_by_brute_force():
    shards, slots = ["a", "b", "c"], 13
    walks = {}
    for s in shards:
        offset, skip = sharding._number(f"offset:{s}") % slots, sharding._number(f"skip:{s}") % (slots - 1) + 1
        walks[s] = [(offset + j * skip) % slots for j in range(slots)]
        assert sorted(walks[s]) == list(range(slots))
    owner = {}
    while len(owner) < slots:
        for i, s in enumerate(shards):
            if len(owner) < slots:
                owner[next(x for x in walks[s] if x not in owner)] = i
    assert [owner[x] for x in range(slots)] == sharding.lookup_table(shards, slots)


def test_even_and_stable():
    full, less = sharding.lookup_table(), sharding.lookup_table(sharding.SHARDS[:-1])
    counts = Counter(full).values()
    assert max(counts) - min(counts) <= 1
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 63)
    assert moved < 0.1 * len(full)


def test_bad_arguments():
    for args in (([], 13), (["a", "a"], 13), (["a"], 12), (["a"] * 3, 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*args)


def test_nulls_repeats_and_clashes(spark):
    df = spark.createDataFrame([(None, "x", 1), (5, "y", 2), (5, "z", 3)], "doc_id long, Shard string, slot long")
    out = sharding.assign_shards(df, "doc_id")
    rows = out.collect()
    assert out.columns == ["doc_id", "slot", "shard"] and len(rows) == 3
    assert len({(r.slot, r.shard) for r in rows if r.doc_id == 5}) == 1 and all(r.shard for r in rows)
    assert sharding.assign_shards(df.limit(0), "doc_id").count() == 0


def test_names_of_its_own_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a", "b", "c", 4)], "doc_id long, __slot string, __shard string, row string, at int")
    (got,) = sharding.assign_shards(df, "doc_id").collect()
    assert got[:5] == (1, "a", "b", "c", 4) and got.shard == sharding.SHARDS[sharding.lookup_table()[got.slot]]
