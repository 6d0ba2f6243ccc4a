"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from graphloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 8)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(([plain(row[names.index(c)]) for c in cols] for row in found.fetchall()), key=repr)
    assert got == want


def test_budget_skip_whole(spark, tmp_path):
    """Against a plain fold over all rows: many small ones, and one that fits only after large ones were passed over."""
    rows = [(k, "a", "tiny text") for k in range(300)] + [(k, "b", "x" * (9000 if k < 390 else 30)) for k in range(300, 400)] + [(400, None, "y" * 20000), (401, None, "z")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    order = {r["doc_id"]: r["o"] for r in spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("doc_id", "xxhash64(doc_id) AS o").collect()}
    used, want = {}, set()
    for i, source, text in sorted(rows, key=lambda r: order[r[0]]):
        cost = max(1, len(text) // 4)
        if used.get(source, 0) + cost <= 4000:
            used[source] = used.get(source, 0) + cost
            want.add((source, str(i), used[source]))
    got = {(r["source"], r["id"], r["used"]) for r in QUERIES["budget_skip"](spark, str(tmp_path)).collect()}
    assert got == want and sum(s == "a" for s, *_ in got) == 300


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["symbol_id", "score", "source"]
    assert set(e.oracle_sql()) <= set(e.queries())
