"""Plan guards: nothing quadratic, projections and filters reach the scans."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cross_product(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_filter_and_columns_reach_the_scan(spark):
    from filinglens.operators import filings
    from pyspark.sql import functions as F

    o = spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderkey").alias("rcept_no"), F.to_date("o_orderdate").alias("rcept_dt"))
    text = plan(filings.as_of(o, "1996-01-01"))
    assert "o_orderdate" in text.split("PushedFilters: ")[1].split("\n")[0]
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate" in text and "o_totalprice" not in text


def test_top_k_is_cut_before_the_shuffle(spark):
    from filinglens.operators.ordering import top_per_group
    from pyspark.sql import functions as F

    text = plan(top_per_group(spark.read.parquet(f"{SF}/lineitem.parquet"), ["l_returnflag"], [F.desc("l_extendedprice")], 5))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_latest_is_combined_before_the_shuffle(spark):
    from filinglens.operators.ordering import latest_per_group

    text = plan(latest_per_group(spark.read.parquet(f"{SF}/orders.parquet"), ["o_custkey"], ["o_orderdate"], ["o_orderkey"]))
    assert "partial_max" in text and "Window" not in text


def test_keywords_stay_where_they_are_to_meet_the_nodes(spark):
    """The nodes are few; the keywords, one company holding most of them, are not sorted for the join."""
    from filinglens.operators import graph
    from filinglens.session import materialise

    keywords = materialise(spark.createDataFrame([("a", i // 3, f"word{i % 5}", 0.5) for i in range(30)], "company string, sentence_pos long, keyword string, score double"))
    nodes = materialise(graph.keyword_nodes(keywords))
    text = plan(graph.cooccurrence_edges(keywords, nodes))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
