"""Embedding near-dedup: an exact metric range join around pivots.

Vectors are taken to the unit sphere, where a cosine of at least `cosine` is a distance of at most r. Each vector is
at home in the cell of its nearest pivot; it is copied to another cell only if the triangle inequality allows a vector
at home there within r of it: |d(x, q) - d(y, q)| <= d(x, y) for every pivot q bounds d(x, p) - d(x, home) by 2r, and
the plane between two pivots bounds it more tightly. Cells then join independently, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, mapped

COSINE = 0.98
#: Vectors a cell should have; at most so many pivots, so that they may be broadcast; rows of a block.
PER_CELL, MOST_PIVOTS, BLOCK = 1000, 4096, 2000
#: What rounding may add to a distance: the root of 2 - 2 cos is off by up to 3e-8 near 0. And to a cosine.
SLACK, COSINE_SLACK = 1e-7, 1e-12
#: Vectors that are held against all pivots at once.
ASSIGNED = 256


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of v, of length 1."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between rows of a and rows of b, all of length 1."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of row i of a and row i of b, as dot product over the product of norms; not finite where these leave the range."""
    with np.errstate(all="ignore"):
        dot = lambda x, y: np.einsum("ij,ij->i", x, y)
        return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def usable(vectors: DataFrame, embedding: str) -> F.Column:
    """Not null or empty, no null or non-finite component, and not all zero."""
    e = F.col(f"`{embedding}`")
    fine = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(e.isNotNull() & fine & F.exists(e, lambda x: x != 0), F.lit(False))


def _assign(classes: DataFrame, pivots: np.ndarray, r: float) -> DataFrame:
    """(label, cell, home, id, weight, e): each class at home once, and in each cell that could hold a neighbour of it."""
    sent = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            e = b.column(b.schema.get_field_index("e"))
            values, size = e.flatten().to_numpy(zero_copy_only=False).astype(float), e.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(size) - size
            # other dimensions never link with the pivots' one; all of one size meet in one cell
            row, cell, home = [np.flatnonzero(size != p.shape[1])], [-size[size != p.shape[1]]], [np.ones((size != p.shape[1]).sum(), bool)]
            fits = np.flatnonzero(size == p.shape[1])
            for at in range(0, len(fits), ASSIGNED):
                some = fits[at : at + ASSIGNED]
                d = _distances(_unit(values[first[some, None] + np.arange(p.shape[1])]), p)
                own = d.argmin(axis=1)
                least = d[np.arange(len(some)), own][:, None]
                near = d - least <= 2 * r + SLACK
                near &= d**2 - least**2 <= 2 * (r + SLACK) * (_distances(p[own], p) + SLACK) + SLACK
                near[np.arange(len(some)), own] = True
                i, c = np.nonzero(near)
                row.append(some[i])
                cell.append(c)
                home.append(c == own[i])
            row, cell, home = np.concatenate(row), np.concatenate(cell), np.concatenate(home)
            taken = b.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32)), pa.array(home)], [*b.schema.names, "cell", "home"])

    return classes.transform(mapped, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema) + ", cell int, home boolean")


def _cell_join(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one pair of blocks: for each vector of the left one that has links, their number and a root shared by what is linked."""
        left, right = pdf[pdf.left.to_numpy()], pdf[~pdf.left.to_numpy()]
        empty = pd.DataFrame({"id": np.array([], np.int64), "n": np.array([], np.int64), "root": np.array([], np.int64)})
        if left.empty or right.empty:
            return empty
        raw, other = np.stack(left.e.to_numpy()).astype(float), np.stack(right.e.to_numpy()).astype(float)
        a, b = _unit(raw), _unit(other)
        li, ri, weight = left.id.to_numpy(), right.id.to_numpy(), right.weight.to_numpy()
        ids, places = np.unique(np.concatenate((li, ri)), return_inverse=True)
        lp, rp = places[: len(li)], places[len(li) :]
        parent = np.arange(len(ids))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        n = np.zeros(len(li), np.int64)
        for at in range(0, len(li), 512):
            found = a[at : at + 512] @ b.T
            close = found >= cosine
            # so near the bound, the quotient of the vectors as they are decides
            i, j = np.nonzero(np.abs(found - cosine) <= COSINE_SLACK)
            for k in range(0, len(i), 1 << 16):
                x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                exact = _cosines(raw[at + x], other[y])
                close[x, y] = np.where(np.isfinite(exact), exact >= cosine, close[x, y])
            close &= li[at : at + 512, None] != ri[None, :]
            n[at : at + 512] = close @ weight
            for i in np.flatnonzero(close.any(axis=1)).tolist():
                x = find(int(lp[at + i]))
                for y in np.unique(parent[rp[np.flatnonzero(close[i])]]).tolist():
                    y = find(y)
                    if x != y:
                        x, y = min(x, y), max(x, y)
                        parent[y] = x
        linked = np.unique(np.concatenate((lp[n > 0], np.flatnonzero(parent != np.arange(len(ids))))))
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, lp, n)
        return pd.DataFrame({"id": ids[linked], "n": count[linked], "root": ids[[find(int(x)) for x in linked]]})

    return run


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, per_cell: int = PER_CELL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors.

    Only vectors with the same label, not null, and as many components are compared. Null, empty and zero vectors and
    those with a null or non-finite component link with nothing. Equal vectors are one class with a weight, so
    copies are counted, not paired. Repeated ids are vectors like others; a null id is never a component's id
    unless all its ids are null, and is not kept. An empty table gives no rows. Further columns are not read.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    r = float(np.sqrt(2 - 2 * cosine)) + SLACK
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.when(usable(vectors, embedding) & F.col(f"`{label}`").isNotNull(), F.col(f"`{embedding}`")).alias("e"), F.col(f"`{label}`").alias("label"))
    rows = rows.select("vec_id", "e", "label", F.xxhash64("e").alias("h1"), F.xxhash64(F.lit("second"), "e").alias("h2"))
    single = rows.where("e IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = rows.where("e IS NOT NULL")
    # A class has a number of its own: ids may be null or repeat.
    classes = cut(rows.groupBy("label", "e").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.min("vec_id").alias("least"), F.count("*").alias("weight")).withColumn("id", F.monotonically_increasing_id()))
    # Cells are of one label and one pivot, so the largest label sets how many pivots are worth their copies.
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    wanted = int(min(MOST_PIVOTS, max(1, largest // per_cell)))
    # Pivots: the vectors with the least hashes, so many at most; any choice gives the same links
    sizes = classes.groupBy(F.size("e").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    if not sizes:
        return _named(single)
    chosen = classes.where(F.size("e") == sizes[0]["size"]).orderBy(F.xxhash64("e"), "id").limit(wanted).select("e").collect()
    pivots = _unit(np.array([x.e for x in chosen], float))
    placed = cut(_assign(classes.select("id", "label", "weight", "e"), pivots, r))
    # A cell's homes and members are dealt over blocks; each pair of blocks is a task's group of at most about twice `block` rows.
    held = placed.groupBy("label", "cell").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("members")).where("homes > 0 AND members > 1")
    blocks = held.select("label", "cell", F.ceil(F.col("homes") / block).cast("int").alias("lefts"), F.ceil(F.col("members") / block).cast("int").alias("rights"))
    dealt = placed.join(blocks, ["label", "cell"])
    which = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    lefts = dealt.where("home").select("label", "cell", which("lefts").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"), F.lit(True).alias("left"), "id", "weight", "e")
    rights = dealt.select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), which("rights").alias("j"), F.lit(False).alias("left"), "id", "weight", "e")
    found = cut(lefts.unionByName(rights).groupBy("label", "cell", "i", "j").applyInPandas(_cell_join(cosine), "id long, n long, root long"))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    # Vectors find their class by two hashes; should two classes of a label share both, by the vectors themselves.
    same = ["h1", "h2"] if classes.groupBy("label", "h1", "h2").count().where("count > 1").isEmpty() else ["e"]
    known = classes.join(links, "id", "left").join(parts, F.col("id") == F.col("node"), "left").select("label", *same, "id", "least", "weight", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "id").alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select("label", *same, (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id")
    many = rows.select("vec_id", "label", *same).join(known, ["label", *same]).select("vec_id", "n_links", "component_id")
    return _named(many.union(single))


def _named(found: DataFrame) -> DataFrame:
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
