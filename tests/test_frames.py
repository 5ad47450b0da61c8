import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import __main__ as cli
from rasterloom import jls
from rasterloom.functions import scalars as s
from rasterloom.operators import container as c
from rasterloom.operators import scan
from rasterloom.operators.container import Options
from rasterloom.sources import netpbm
from rasterloom.streaming import files


def image(seed, width=20, height=16, n=3):
    return np.random.default_rng(seed).integers(100, 110, width * height * n).astype(np.uint8).tobytes()


def test_relations(spark):
    data = image(1)
    coded = [("a", c.encode(data, 20, 16, 8, 3, Options(mode=2, tables=((4, 1, b"xyz"),), table_ids=(4, 0, 9)))), ("b", c.encode(data, 20, 16, 8, 3)), ("bad", b"\xff\xd8\xff\xd9"), ("none", None)]
    df = spark.createDataFrame(coded, "path string, content binary")
    frames = {r.path: r for r in jls.read_frames(df).collect()}
    assert set(frames) == {"a", "b", "bad"} and (frames["a"].width, frames["a"].height, frames["b"].component_count, frames["bad"].error_code) == (20, 16, 3, 19)
    parts = jls.read_components(df)
    assert [(r.component_id, r.mapping_table_id) for r in parts.where("path = 'a'").orderBy("component_index").collect()] == [(1, 4), (2, 0), (3, 9)]
    tables = jls.read_mapping_tables(df)
    assert [(r.table_id, bytes(r.data)) for r in tables.collect()] == [(4, b"xyz")]
    assert [r.mapping_table_id for r in jls.external_table_ids(parts, tables).collect()] == [9]
    scans = jls.read_scans(df).orderBy("path", "scan_index").collect()
    assert [(r.path, r.component_ids) for r in scans] == [("a", [1, 2, 3]), ("b", [1]), ("b", [2]), ("b", [3])]
    assert [r.error_code for r in jls.read_segments(df).where("error_code IS NOT NULL").collect()] == [19]
    back = {r.path: r.r for r in df.select("path", jls.decode(F.col("content")).alias("r")).collect()}
    assert bytes(back["a"].data) == data == bytes(back["b"].data) and back["bad"].error_code == 19 and back["none"].error_code == 4
    with pytest.raises(Exception, match="UNEXPECTED_EOI"):
        jls.read_frames(df, mode="failfast").collect()


def test_parts_of_one_file_decode_apart(spark):
    rows = [(i, image(i), o) for i, o in enumerate((Options(), Options(mode=1, transform=2), Options(restart_interval=3), Options(mode=2, restart_interval=5, transform=3)))]
    df = spark.createDataFrame([(i, c.encode(d, 20, 16, 8, 3, o)) for i, d, o in rows], "path int, content binary")
    assert {r.path: bytes(r.data) for r in jls.decode_distributed(df).collect()} == {i: d for i, d, _ in rows}
    assert jls.intervals(df).where("path = 2").count() == 18


def test_columns_agree_with_the_coder(spark):
    rows = [(bits, near) for bits in range(2, 17) for near in (0, 1, 3) if near <= ((1 << bits) - 1) // 2]
    df = spark.createDataFrame(rows, "bits int, near int")
    got = df.select("bits", "near", s.default_preset(s.max_sample(F.col("bits")), F.col("near")).alias("p")).collect()
    for r in got:
        assert tuple(r.p) == tuple(vars(scan.default_preset((1 << r.bits) - 1, r.near)).values())
    planes = np.random.default_rng(2).integers(0, 65536, (3, 1, 50)).astype(np.int32)
    rgb = spark.createDataFrame([tuple(map(int, planes[:, 0, i])) for i in range(50)], "r int, g int, b int")
    for kind in (1, 2, 3):
        want = c.transform_forward(planes, kind, 16)[:, 0].T.tolist()
        v = s.hp_forward(kind, *map(F.col, "rgb"), bits=16)
        assert [list(x[0]) for x in rgb.select(v).collect()] == want
        assert [list(x[0]) for x in rgb.select(s.hp_inverse(kind, v, 16)).collect()] == planes[:, 0].T.tolist()


def test_maps(netpbm_bits=12):
    data = np.arange(12, dtype="<u2").tobytes()
    raw = netpbm.build(3, 4, netpbm_bits, 1, data)
    assert netpbm.parse(raw) == (3, 4, 12, 1, data)
    assert netpbm.parse(b"P5 # a\n# b\n2 1\n255\nab") == (2, 1, 8, 1, b"ab")
    for bad in (b"", b"P4 1 1 1 a", b"P5 2 2 255\nabc", b"P5 2"):
        with pytest.raises(ValueError):
            netpbm.parse(bad)


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.ppm").write_bytes(netpbm.build(20, 16, 8, 3, image(i)))
    df = netpbm.read(spark, str(tmp_path / "in"))
    out = df.select(netpbm.to_bytes(*map(F.col, ("width", "height", "bits_per_sample", "component_count", "data"))).alias("x")).collect()
    assert {bytes(r.x) for r in out} == {p.read_bytes() for p in (tmp_path / "in").iterdir()}
    (tmp_path / "jls").mkdir()
    for i in range(3):
        (tmp_path / "jls" / f"{i}.jls").write_bytes(c.encode(image(i), 20, 16, 8, 3, Options(mode=2)))
    q = files.stream_frames(spark, str(tmp_path / "jls"), 2).writeStream.format("memory").queryName("frames_seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("frames_seen").where("width = 20 AND error_code IS NULL").count() == 3


def test_command_line(tmp_path, capsys):
    for n, name in ((1, "a.pgm"), (3, "b.ppm")):
        source = tmp_path / name
        source.write_bytes(netpbm.build(20, 16, 8, n, image(n, n=n)))
        coded, back = tmp_path / "x.jls", tmp_path / f"back-{name}"
        assert cli.main(["encode", str(source), str(coded)]) == 0 and cli.main(["decode", str(coded), str(back)]) == 0
        assert back.read_bytes() == source.read_bytes()
    data = image(5)
    (tmp_path / "planar.jls").write_bytes(c.encode(data, 20, 16, 8, 3))
    assert cli.main(["decode", str(tmp_path / "planar.jls")]) == 0
    pixels = netpbm.parse((tmp_path / "planar.ppm").read_bytes())[4]
    assert pixels[0::3] + pixels[1::3] + pixels[2::3] == data
    assert cli.main(["benchmark", str(coded), "-n", "1"]) == 0 and "mean decode" in capsys.readouterr().out
    assert cli.main(["decode", str(source)]) == 1


def test_distributed_decoding_moves_stretches_of_intervals(spark):
    rng = np.random.default_rng(8)
    frames = {1: (64, 2000, 8, 1, Options(restart_interval=5)), 2: (31, 900, 8, 3, Options(mode=2, transform=1, restart_interval=7)), 3: (20, 700, 12, 3, Options(mode=1, restart_interval=3)), 4: (9, 2500, 8, 2, Options(restart_interval=100)), 5: (3, 2, 8, 1, Options())}
    raw = {k: (rng.integers(0, 1 << b, w * h * n).astype("u1" if b == 8 else "<u2").tobytes()) for k, (w, h, b, n, _) in frames.items()}
    df = spark.createDataFrame([(k, c.encode(raw[k], *frames[k])) for k in frames], "path int, content binary")
    assert {r.path: bytes(r.data) for r in jls.decode_distributed(df).collect()} == raw
    rows = {r.path: r["count"] for r in jls._pieces(df, "path", "content").groupBy("path").count().collect()}
    assert rows[1] == 8 and rows[4] == 4 and rows[5] == 1 and all(n < jls.intervals(df).where(f"path = {k}").count() for k, n in rows.items() if k != 5)
