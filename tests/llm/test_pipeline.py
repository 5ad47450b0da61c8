import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rasterloom.llm import packing, quality

from .test_decontaminate import brute as contaminated
from .test_simhash import brute_fingerprint, roots
from .test_suffixes import brute as without_repeats

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(8)
    syllables = ["ba", "lo", "mi", "tu", "ren", "sta", "ko", "vel"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(10)).capitalize() for _ in range(n // 10)) + "."
    passage, item = prose(120), prose(20)
    texts = [prose(rng.randint(30, 200)) for _ in range(60)]
    texts += [prose(40) + "\n" + passage + "\n" + prose(40), passage + prose(50), passage, prose(40) + " " + item.upper() + " " + prose(40), None, ""]
    texts += [texts[0], texts[1] + " x", texts[2].upper()]
    junk = [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(25)]
    rows = [(i, t, "xx", "s", len(t or "")) for i, t in enumerate(texts + junk)] + [(None, texts[5], None, None, None)]
    spark.createDataFrame(rows, COLUMNS).repartition(2).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 0 if i >= len(texts) else 1, 0) for i in range(len(rows) - 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "no such words")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, item


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=repr)


def test_each_stage_by_brute_force(spark, tables):
    at, item = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_stage", "simhash_stage", "suffix_stage", "decontamination_stage", "packing_stage"]

    kept = corpus_pipeline.quality_stage(spark, docs, at)
    assert kept.columns == docs.columns
    model = quality.train(docs, spark.read.parquet(f"{at}/labels.parquet"))
    before, first = rows_of(docs), rows_of(kept)
    assert first == [r for r in before if model.score(np.array([quality.features((r[1] or "").encode())]))[0] >= 0.5]
    assert all("!!" not in (r[1] or "") for r in first) and len(first) >= 60

    second = rows_of(corpus_pipeline.simhash_stage(spark, kept, at))
    prints = [brute_fingerprint(r[1]) for r in first]
    root = roots(range(len(first)), [(a, b) for a in range(len(first)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    least = {}
    for i, r in enumerate(first):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    assert second == [r for i, r in enumerate(first) if r[0] is not None and r[0] == least[root[i]]]

    third = rows_of(corpus_pipeline.suffix_stage(spark, spark.createDataFrame(second, COLUMNS), at))
    wanted = without_repeats([r[1] for r in second], 400)
    sizes = {r[0]: (w[0], w[0] - w[1]) for r, w in zip(second, wanted, strict=True)}
    assert {r[0] for r in third} == {i for i, (n, left) in sizes.items() if left or not n}
    assert all(len((r[1] or "").encode()) == sizes[r[0]][1] and r[4] == (len(r[1]) if r[1] is not None else None) for r in third)
    assert any(n != left for n, left in sizes.values())

    fourth = rows_of(corpus_pipeline.decontamination_stage(spark, spark.createDataFrame(third, COLUMNS), at))
    assert fourth == [r for r in third if not contaminated(r[1], [(1, item), (2, "no such words")])[-1]]
    assert len(fourth) < len(third)

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.packing_stage(spark, spark.createDataFrame(fourth, COLUMNS), at).collect()
    wanted = {r[0]: len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in fourth}
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == wanted and max(p.offset + p.length for p in pieces) <= packing.WINDOW

    whole = corpus_pipeline.run(spark, at).collect()
    assert {p.doc_id for p in whole} == {r[0] for r in fourth}
    assert sum(p.length for p in whole) == sum(wanted.values())


def test_rows_without_ids_are_documents_of_their_own(spark, tables):
    at, item = tables
    docs = [r for r in rows_of(spark.read.parquet(f"{at}/documents.parquet")) if r[1] and len(r[1]) > 100 and "!!" not in r[1]]
    unlike = sorted({r[1] for r in docs[:40]})[:6]
    rows = [(None, t, None, None, None) for t in unlike] + [(None, unlike[0], None, None, None), (7, unlike[1], None, None, None), (7, unlike[2], None, None, None), (None, item, None, None, None)]
    kept = rows_of(corpus_pipeline.simhash_stage(spark, spark.createDataFrame(rows, COLUMNS), at))
    prints = {t: brute_fingerprint(t) for t in {r[1] for r in rows}}
    assert all((a ^ b).bit_count() > 2 for x, a in prints.items() for y, b in prints.items() if x != y)
    assert kept == sorted(((7 if t in unlike[1:3] else None, t, None, None, None) for t in prints), key=repr)
    clean = rows_of(corpus_pipeline.decontamination_stage(spark, spark.createDataFrame(rows, COLUMNS), at))
    assert clean == sorted((r for r in rows if not contaminated(r[1], [(1, item)])[-1]), key=repr) and len(clean) < len(rows)
    extra = spark.createDataFrame([(1, unlike[0], "a", "b")], "doc_id long, text string, fingerprint string, component_id string")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, extra, at).columns == extra.columns and stage(spark, extra, at).count() == 1 and stage(spark, extra.limit(0), at).count() == 0


def test_stages_with_clashing_columns_and_nulls(spark, tables):
    at, _ = tables
    rows = [(1, "a text of ten short words that stands here once.", "r", "f", True, "h"), (2, None, None, None, None, None), (2, None, None, None, None, None), (None, "  ", "r", "f", False, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row string, __hit string, __had boolean, __Had_1 string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, at)
        assert got.columns == docs.columns, name
        left = {repr(tuple(r)) for r in got.collect()}
        assert left <= {repr(r) for r in rows}, name
        if stage is not corpus_pipeline.quality_stage:
            assert repr(rows[0]) in left, name
        assert stage(spark, docs.limit(0), at).count() == 0, name
    pieces = corpus_pipeline.packing_stage(spark, docs, at).collect()
    assert sorted((p.doc_id or 0) for p in pieces if p.start == 0) == [0, 1, 2, 2]
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), at).count() == 0


def test_a_filter_on_clean_texts_has_them_cleaned_once(spark):
    """Twice means a second worker for each task, which Spark then keeps."""
    docs = spark.createDataFrame([(1, "a passage " * 60, 600), (2, "a passage " * 60 + "own", 603), (3, None, None), (4, "", 0)], "doc_id long, text string, n_chars long")
    got = corpus_pipeline.suffix_stage(spark, docs, "")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted(tuple(r) for r in got.collect()) == [(2, "own", 3), (3, None, None), (4, "", 0)]


def test_run_on_empty_tables(spark, tmp_path, tables):
    at, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_tables_of_a_failed_run_are_deleted(spark, tables, monkeypatch):
    from pathlib import Path

    at, _ = tables
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("pipeline-*/*"))

    def fails(spark, docs, sf_dir):
        raise RuntimeError("stopped")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("keep", lambda spark, docs, sf_dir: docs), ("fail", fails)])
    with pytest.raises(RuntimeError, match="stopped"):
        corpus_pipeline.run(spark, at)
    assert set(shared.glob("pipeline-*/*")) == before
