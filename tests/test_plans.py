"""Every query against its SQL on a small table."""

import datetime
import decimal

import duckdb
import pytest

from sessionloom.plans import queries as P

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(P.QUERIES))
def test_query(spark, con, name):
    df = P.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in P.ORACLE:
        return
    rel = con.execute(P.ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want


def test_row_code_is_compiled(spark, tmp_path):
    """No method of the generated code is over the 8,000 bytes up to which the JVM compiles, in reading lines."""
    import re

    from sessionloom.plans import bridge, render
    from sessionloom.sources import ingest

    events = bridge.bridged(spark, SF)
    lines, frames = [render.claude_lines(events), render.codex_lines(events)], []
    for k, make in enumerate((ingest.claude_events, ingest.codex_events)):
        lines[k].write.parquet(f"{tmp_path}/{k}")
        frames.append(make(spark.read.parquet(f"{tmp_path}/{k}")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for frame in frames:
            plan = frame.select("*")._jdf.queryExecution().executedPlan()
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(-?\d+)", spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan))]
            assert sizes and max(sizes) < 8000, sizes
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_small_splits_share_tasks(spark, tmp_path, monkeypatch):
    """Many small files don't make as many tasks."""
    from sessionloom.plans import file_queries

    spark.range(60).repartition(60).write.parquet(f"{tmp_path}/in")
    monkeypatch.setattr(file_queries, "SPLIT_TASKS", 5)
    rows = file_queries.in_small_splits(spark.read.parquet(f"{tmp_path}/in"), f"{tmp_path}/out")
    assert rows.count() == 60 and len(rows.inputFiles()) <= 10
