"""Company registry, exchange listing and company resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filinglens.functions import ident
from filinglens.operators.ordering import latest_per_group
from filinglens.session import materialise


def common_stock_listing(items: DataFrame, market: str | None = None) -> DataFrame:
    """Exchange items reduced to common shares with a usable code."""
    group, kind = F.coalesce(F.col("SECUGRP_NM"), F.lit("")), F.coalesce(F.col("KIND_STKCERT_TP_NM"), F.lit(""))
    keep = ((group == "") | (group == "주권")) & ((kind == "") | kind.contains("보통주"))
    code = ident.stock_code(F.col("ISU_SRT_CD"))
    return items.filter(keep & (code != "")).select(
        code.alias("stock_code"), F.col("ISU_ABBRV").alias("listed_name"),
        F.coalesce(F.col("MKT_TP_NM"), F.lit(market)).alias("market"),
        F.col("LIST_DD").alias("listing_date"), F.col("LIST_SHRS").alias("listed_shares"))


def universe(registry: DataFrame, listing: DataFrame, target_name: str | Column, version: list[str]) -> DataFrame:
    """Listed companies found in the registry, the target left out.

    A stock code kept twice in the registry resolves to its last row by ``version``.
    """
    target = F.lit(target_name) if isinstance(target_name, str) else target_name
    one = latest_per_group(registry.filter(F.col("stock_code") != ""), ["stock_code"], version, ["corp_code", "corp_name"])
    return one.select("stock_code", "corp_code", "corp_name").join(listing, "stock_code").filter(F.col("corp_name") != target)


def unmatched(registry: DataFrame, listing: DataFrame) -> DataFrame:
    return listing.join(registry.select("stock_code"), "stock_code", "left_anti")


def resolve(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """Resolve each query text to one company.

    Exact hits on any of the four identifiers go first; only queries without one
    are searched inside names.  Result per query: tier, number of companies,
    status and, when unique, the company.
    """
    asked = queries.select("query", F.lower(F.trim("query")).alias("_q")).distinct()
    keys = registry.select(
        "corp_code", F.explode(F.array_distinct(F.transform(
            F.array("corp_code", "stock_code", "corp_name", "corp_eng_name"),
            lambda c: F.lower(F.coalesce(c, F.lit("")))))).alias("_q"))
    exact = asked.join(keys.filter("_q <> ''"), "_q").select("query", "corp_code", F.lit(0).alias("tier"))
    open_queries = asked.join(exact.select("query"), "query", "left_anti")
    named = registry.select("corp_code", F.lower("corp_name").alias("_n"), F.lower(F.coalesce("corp_eng_name", F.lit(""))).alias("_e"))
    hits = exact.unionByName(_containing(open_queries.filter(F.length("_q") > GRAMS[0]), named))
    found = hits.groupBy("query", "tier").agg(F.count("*").alias("n_companies"), F.min("corp_code").alias("_first")).drop("tier")
    found = found.unionByName(_counted(open_queries.filter(F.length("_q") <= GRAMS[0]), named))
    return (asked.select("query").join(found, "query", "left")
            .select("query", F.coalesce("n_companies", F.lit(0)).alias("n_companies"),
                    F.when(F.col("n_companies").isNull(), "none").when(F.col("n_companies") == 1, "resolved")
                    .otherwise("ambiguous").alias("status"),
                    F.when(F.col("n_companies") == 1, F.col("_first")).alias("corp_code")))


def search(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """Every company whose name holds the query, case aside."""
    asked = queries.select("query", F.lower(F.trim("query")).alias("_q")).distinct()
    named = registry.select("corp_code", F.lower("corp_name").alias("_n"), F.lit("").alias("_e"))
    return _containing(asked, named).select("query", "corp_code")


def exact_company(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """Company by stock code when one matches, else by an exact name only one company has.

    ``asked``: request_id, corp_name, stock_code (may be null).
    """
    codes = registry.filter("stock_code <> ''").groupBy(F.trim("stock_code").alias("_code")).agg(F.min("corp_code").alias("by_code"))
    names = registry.groupBy(F.col("corp_name").alias("_name")).agg(F.count("*").alias("_k"), F.min("corp_code").alias("by_name")).filter("_k = 1")
    found = (asked.withColumns({"_code": F.trim("stock_code"), "_name": F.trim("corp_name")})
             .join(codes, "_code", "left").join(names, "_name", "left"))
    return found.select("request_id", F.coalesce("by_code", "by_name").alias("corp_code"))


# Lengths of the indexed runs of letters; a query is found through its longest ones.
GRAMS = (3, 8)


def _runs(c: Column, n: int) -> Column:
    last = F.length(c) - n + 1
    cut = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(last >= 1, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def _name_runs(named: DataFrame, *lengths: int) -> DataFrame:
    """(corp_code, _n, _e, run) for the runs of both names."""
    every = F.array_distinct(F.concat(*[F.coalesce(_runs(F.col(c), n), F.array().cast("array<string>")) for c in ("_n", "_e") for n in lengths]))
    return named.select("corp_code", "_n", "_e", F.explode(every).alias("run"))


def _counted(asked: DataFrame, named: DataFrame) -> DataFrame:
    """Companies per query for queries that are runs themselves: the counts of the runs are the answer, whatever their number."""
    held = _name_runs(named, *range(1, GRAMS[0] + 1)).join(asked.select(F.col("_q").alias("run")).distinct(), "run", "left_semi")
    counts = held.select("run", "corp_code").distinct().groupBy("run").agg(F.count("*").alias("n_companies"), F.min("corp_code").alias("_first"))
    return asked.filter("_q <> ''").join(counts, asked["_q"] == counts["run"]).select("query", "n_companies", "_first")


def _containing(asked: DataFrame, named: DataFrame) -> DataFrame:
    """Queries inside names, found through the query's rarest run of the greatest indexed length it has.

    A name holding the query holds every run of it, so joining on one run loses nothing.  Only runs that queries
    have are counted and joined; queries shorter than all runs are runs themselves.
    """
    length = F.length("_q")
    of_query = F.when(length >= GRAMS[1], _runs(F.col("_q"), GRAMS[1])).when(length >= GRAMS[0], _runs(F.col("_q"), GRAMS[0])).otherwise(F.array("_q"))
    runs = asked.filter("_q <> ''").select("query", "_q", F.explode(of_query).alias("run"))
    lengths = [*range(1, GRAMS[0] + 1), GRAMS[1]]
    held = materialise(_name_runs(named, *lengths).join(runs.select("run").distinct(), "run", "left_semi"))
    spread = held.groupBy("run").agg(F.count("*").alias("df"))
    rare = (runs.join(spread, "run", "left").groupBy("query", "_q")
            .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "run")).alias("r"))
            .select("query", "_q", F.col("r.run").alias("run")))
    hits = rare.join(held, "run").filter(F.contains("_n", "_q") | F.contains("_e", "_q"))
    return hits.select("query", "corp_code", F.lit(1).alias("tier")).distinct()


def missing_inputs(companies: DataFrame, texts: DataFrame) -> DataFrame:
    """Companies that cannot be profiled, with the reason."""
    joined = companies.join(texts.select("corp_code", "business_text", F.lit(1).alias("_cached")), "corp_code", "left")
    reason = F.when(F.col("_cached").isNull(), "cache_missing").when(
        F.trim(F.coalesce("business_text", F.lit(""))) == "", "text_empty")
    return joined.withColumn("reason", reason).filter("reason is not null").select("corp_code", "reason")
