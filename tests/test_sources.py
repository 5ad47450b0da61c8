import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import jls
from rasterloom.functions import sql
from rasterloom.operators import container as c
from rasterloom.operators.container import Options
from rasterloom.sources import headers


def image(seed, n=300):
    return np.random.default_rng(seed).integers(90, 99, n).astype(np.uint8).tobytes()


def test_files_out_and_headers_in(spark, tmp_path):
    headers.register(spark)
    rows = [(f"part{i % 2}/{i}.jls", image(i), i) for i in range(6)]
    df = spark.createDataFrame(rows, "name string, data binary, i int")
    coded = df.select("name", jls.encode(F.col("data"), F.lit(10), F.lit(10), F.lit(8), F.lit(3), Options(mode=1, near=2)).alias("content"))
    top = str(tmp_path / "files")
    coded.write.format("imagefiles").mode("append").save(top)
    assert sorted(str(p.relative_to(top)) for p in (tmp_path / "files").rglob("*") if p.is_file()) == sorted(r[0] for r in rows)
    (tmp_path / "files" / "bad.jls").write_bytes(b"\xff\xd8\xff\xd9")
    long = c.encode(bytes(100), 10, 10, 8, 1, Options(comments=(b"x" * 60_000, b"y" * 60_000)))
    (tmp_path / "files" / "long.jls").write_bytes(long)
    found = spark.read.format("jpegls").option("filesPerTask", 3).load(top)
    assert found.rdd.getNumPartitions() == 3
    got = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert len(got) == 8 and got["bad.jls"].error_code == 19 and got["long.jls"].width == 10 and got["long.jls"].error_code is None
    assert all((r.width, r.height, r.component_count, r.near, r.interleave_mode) == (10, 10, 3, 2, 1) for n, r in got.items() if n[0].isdigit())
    assert spark.read.format("jpegls").load(f"{top}/long.jls").count() == 1
    for bad in ([("a", b"x"), ("a", b"y")], [("../a", b"x")], [(None, b"x")]):
        with pytest.raises(Exception):
            spark.createDataFrame(bad, "name string, content binary").write.format("imagefiles").mode("append").save(str(tmp_path / "no"))
    assert not [p for p in (tmp_path / "no").rglob("*") if p.is_file()]


def test_sql_functions(spark):
    sql.register(spark)
    spark.createDataFrame([(1, image(1)), (2, image(2)), (3, None)], "k int, data binary").createOrReplaceTempView("pictures")
    got = spark.sql("SELECT k, data, jls_decode(jls_encode(data, 10, 10, 8, 3, 2, 0)) AS back, jls_decode(data) AS junk FROM pictures").collect()
    assert all(r.back == r.data and r.junk is None for r in got)
    rows = spark.sql("SELECT k, s.* FROM (SELECT k, jls_encode(data, 10, 10, 8, 3, 0, 0) AS c FROM pictures), LATERAL jls_segments(c) s").collect()
    assert sorted({(r.k, r.seq, r.marker) for r in rows if r.k == 1}) == [(1, i, m) for i, m in enumerate((0xD8, 0xF7, 0xDA, 0xDA, 0xDA, 0xD9))]
    assert not [r for r in rows if r.k == 3 or r.error_code is not None]
