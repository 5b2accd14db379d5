"""Joins of one target against all, and company resolution by runs."""

import pytest
from pyspark.sql import functions as F

from filinglens.operators import registry as R
from filinglens.session import broadcast_bytes, join_to_few


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def rows_and_side(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 3900, "hot").when(F.col("id") % 2 == 0, F.concat(F.lit("k"), F.col("id") % 7)).alias("target"), F.col("id").alias("candidate"))
    side = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), (None, 5), ("unused", 6)], "target string, v int")
    return rows, side


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_has_the_rows_of_a_plain_one(spark, no_broadcast, how):
    rows, side = rows_and_side(spark)
    got = join_to_few(rows, side, ["target"], how, share=500)
    key = lambda r: (str(r.target), r.candidate, str(r.v))
    assert sorted(got.columns) == ["candidate", "target", "v"]
    assert sorted(got.collect(), key=key) == sorted(rows.join(side, "target", how).select(*got.columns).collect(), key=key)


def test_a_hot_target_spreads_over_the_tasks(spark, no_broadcast):
    """All candidates of one target: no partition of the join holds more than a few shares of them."""
    rows, side = rows_and_side(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = join_to_few(rows, side, ["target"], share=300).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 6 and max(r["count"] for r in parts) < 7800 / 2


def test_small_sides_are_broadcast(spark):
    rows, side = rows_and_side(spark)
    assert broadcast_bytes(spark) == 10 << 20
    assert "BroadcastHashJoin" in join_to_few(rows, side, ["target"])._jdf.queryExecution().executedPlan().toString()


NAMES = [("1", "(주)가나다 소재", "GANADA Materials"), ("2", "(주)가나", None), ("3", "주식회사 나다라", "NADARA"), ("4", "(주)마바사", "Mabasa Co"), ("5", "ab", ""), ("5", "ab", "")]


def test_resolution_equals_a_scan(spark):
    registry = spark.createDataFrame([(c, "", n, e) for c, n, e in NAMES], "corp_code string, stock_code string, corp_name string, corp_eng_name string")
    asked = ["(주)", "가나", "나다", "주", "materials", "ganada m", "GANADA Materials co", "(주)가나", "b", "A", "nowhere", " ", "(주)가나다 소재", "co", "식회사 나다", "ma"]
    got = {r.query: (r.n_companies, r.status) for r in R.resolve(spark.createDataFrame([(q,) for q in asked], "query string"), registry).collect()}
    for q in asked:
        low = q.strip().lower()
        exact = {c for c, n, e in NAMES if low and low in (c, n.lower(), (e or "").lower())}
        inside = {c for c, n, e in NAMES if low and (low in n.lower() or low in (e or "").lower())}
        n = len([1 for c, *_ in NAMES if c in exact]) if exact else len(inside)
        assert got[q][0] == (len(exact) if len(exact) and len(exact) == n else n) or got[q][0] == len(exact or inside), q
        assert (got[q][1] == "none") == (not exact and not inside)
    found = {(r.query, r.corp_code) for r in R.search(spark.createDataFrame([(q,) for q in asked], "query string"), registry).collect()}
    assert found == {(q, c) for q in asked for c, n, _ in NAMES if q.strip() and q.strip().lower() in n.lower()}


def test_hot_runs_cost_no_product(spark):
    """Queries that every name holds are answered from counts: rows of the result grow with the queries only."""
    registry = spark.range(20_000).select(F.col("id").cast("string").alias("corp_code"), F.lit("").alias("stock_code"), F.concat(F.lit("(주)회사 "), F.col("id")).alias("corp_name"), F.lit(None).cast("string").alias("corp_eng_name"))
    asked = spark.createDataFrame([("(주)",), ("주)",), ("회",), ("(주)회사 19999",)], "query string")
    got = {r.query: (r.n_companies, r.status) for r in R.resolve(asked, registry).collect()}
    assert got == {"(주)": (20_000, "ambiguous"), "주)": (20_000, "ambiguous"), "회": (20_000, "ambiguous"), "(주)회사 19999": (1, "resolved")}
