"""Every query that isn't of the training-data subpackage against its SQL in DuckDB."""

import os

import duckdb
import pytest

from rasterloom.plans import catalogue, files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


QUERIES, ORACLES = catalogue.queries() | files.queries(), catalogue.oracle_sql() | files.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(map(repr, (tuple(r[names.index(c)] for c in columns) for r in found.fetchall())))


def test_entry_stands_without_the_training_data_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/rasterloom", tmp_path / "rasterloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_roundtrip_hp_codes_whole_vectors(spark, monkeypatch):
    from rasterloom.plans import catalogue

    seen, checked = [], catalogue._checked
    monkeypatch.setattr(catalogue, "_checked", lambda df, *a: seen.append((df, a)) or checked(df, *a))
    at = "/root/testdata/sf0.001"
    vectors = {r.vec_id: bytes(r.data) for r in catalogue._vectors(spark, at, 8).collect()}
    assert all(r.same for r in catalogue.queries()["roundtrip_hp"](spark, at).collect()) and len(seen) == 3
    for df, (width, height, bits, n, _) in seen:
        assert width * height * n == 66 and bits == 8
        assert all(bytes(r.data) == vectors[r.vec_id] + b"\0\0" for r in df.collect())
