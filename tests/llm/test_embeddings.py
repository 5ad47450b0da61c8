import random

import numpy as np
import pytest

from rasterloom.llm import embeddings


def brute(rows, cosine):
    def ok(e, label):
        return label is not None and e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e)

    links = {i: set() for i in range(len(rows))}
    for i, (_, e, li) in enumerate(rows):
        for j in range(i):
            f, lj = rows[j][1:]
            if li == lj and ok(e, li) and ok(f, lj) and len(e) == len(f):
                a, b = np.array(e, float), np.array(f, float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    out, seen = {}, set()
    for i in links:
        if i not in seen:
            part, todo = set(), [i]
            while todo:
                x = todo.pop()
                if x not in part:
                    part.add(x)
                    todo += links[x]
            seen |= part
            least = min((rows[x][0] for x in part if rows[x][0] is not None), default=None)
            for x in part:
                out[x] = (rows[x][0], len(links[x]), least, rows[x][0] is not None and rows[x][0] == least)
    return sorted(map(repr, out.values()))


def vectors(seed):
    rng, np_rng = random.Random(seed), np.random.default_rng(seed)
    rows, dim = [], 8
    for _ in range(40):
        base, label = np_rng.normal(size=dim), rng.choice([0, 1, None])
        for _ in range(rng.randint(1, 9)):
            v = base + np_rng.normal(size=dim) * rng.choice([0, 0.02, 0.1, 0.2])
            rows.append((len(rows), v.tolist(), label if rng.random() < 0.9 else 0))
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * dim, [nan] * dim, [inf] + [1.0] * 7, [None] + [1.0] * 7, [1e300] * dim, [2e300] * dim, [1e-300] * dim, [1.0] * 3, [2.0] * 3]
    rows += [(len(rows) + i, e, 0) for i, e in enumerate(odd)]
    rows += [(None, rows[0][1], rows[0][2]), (3, rows[0][1], rows[0][2]), *rows[5:8]]
    return rows


@pytest.mark.parametrize("per_cell,block", [(1000, 2000), (10, 7)])
def test_against_brute_force(spark, per_cell, block):
    rows = vectors(per_cell)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, component_id string")
    got = embeddings.near_duplicates(df, per_cell=per_cell, block=block).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows, 0.98)


def test_empty_and_nothing_usable(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = embeddings.near_duplicates(spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], schema)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("a,b,c", [(3, 4, 5), (5, 12, 13), (7, 24, 25), (20, 21, 29), (9, 40, 41)])
def test_a_cosine_on_the_bound_is_a_link(spark, a, b, c):
    rows = [(1, [1.0, 0.0], 0), (2, [float(a), float(b)], 0), (3, [2.0 * b, -2.0 * a], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for k, other in ((a, 2), (b, 3)):
        got = {r.vec_id: r.component_id for r in embeddings.near_duplicates(df.where(f"vec_id IN (1, {other})"), cosine=k / c).collect()}
        assert got == {1: 1, other: 1}


def test_hashes_that_clash_do_not_join_vectors(spark, monkeypatch):
    rows = vectors(3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    real = embeddings.F.xxhash64
    monkeypatch.setattr(embeddings.F, "xxhash64", lambda *cols: real(embeddings.F.lit(1)) if any(isinstance(c, str) for c in cols) else real(*cols))
    got = embeddings.near_duplicates(df).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows, 0.98)
