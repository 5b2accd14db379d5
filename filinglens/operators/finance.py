"""Statement standardisation, period profiles and company-to-company matching.

Statement rows: company, business_year, dart_report_type, fs_div, line_no and the
disclosure columns sj_div, account_id, account_nm, account_detail,
thstrm_amount, thstrm_add_amount, frmtrm_amount, frmtrm_add_amount (text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filinglens import lexicon as L
from filinglens.functions import amounts as A
from filinglens.functions import ident
from filinglens.functions.text import any_term
from filinglens.session import join_to_few, materialise

PERIOD = ["company", "business_year", "dart_report_type"]
METRICS = ["revenue", "total_assets", "total_equity", "operating_income", "net_income", "operating_margin", "net_margin",
           "revenue_growth_yoy", "total_liabilities", "debt_ratio", "liability_ratio", "operating_cash_flow"]


def prefer_consolidated(statements: DataFrame) -> DataFrame:
    """Consolidated rows of a period where it has any, else the separate ones; one pass, a period is one statement's lines."""
    consolidated = F.max(F.col("fs_div") == "CFS").over(Window.partitionBy(*PERIOD))
    return (statements.withColumn("_cfs", consolidated)
            .filter(F.col("fs_div") == F.when(F.col("_cfs"), "CFS").otherwise("OFS")).drop("_cfs"))


_AMOUNTS = ["thstrm_amount", "thstrm_add_amount", "frmtrm_amount", "frmtrm_add_amount"]


def with_amounts(statements: DataFrame) -> DataFrame:
    """Current and previous amount of every row and the field each came from.

    Interim income and cash-flow rows use the cumulative figure where there is one.
    Texts are parsed once, in their own projection.
    """
    parsed = statements.withColumns({f"_{a}": A.parse_amount(F.col(a)) for a in _AMOUNTS}).withColumn(
        "_interim", (F.upper(F.coalesce("sj_div", F.lit(""))) != "BS") & (F.col("dart_report_type") != "annual"))
    use_now = F.col("_interim") & F.col("_thstrm_add_amount").isNotNull()
    use_then = F.col("_interim") & F.col("_frmtrm_add_amount").isNotNull()
    return parsed.withColumns({
        "amount": F.when(use_now, F.col("_thstrm_add_amount")).otherwise(F.col("_thstrm_amount")),
        "amount_field": F.when(use_now, "thstrm_add_amount").otherwise("thstrm_amount"),
        "previous_amount": F.when(use_then, F.col("_frmtrm_add_amount")).otherwise(F.col("_frmtrm_amount")),
        "previous_field": F.when(use_then, "frmtrm_add_amount").otherwise("frmtrm_amount"),
        "period_key": ident.period_key(F.col("business_year"), F.col("dart_report_type")),
    }).drop("_interim", *[f"_{a}" for a in _AMOUNTS])


def account_score(sheets: list[str], ids: list[str], names: list[str]) -> Column:
    """Score of a row with prepared ``_sheet``, ``_name`` and ``_detailed`` for one account."""
    bare = [n.lower().replace(" ", "").replace("ㆍ", "").replace("·", "") for n in names]
    name = F.col("_name")
    by_name = F.when(name.isin(*bare), 50).when(any_term(name, bare), 20).otherwise(0)
    by_id = F.when(F.coalesce(F.col("account_id"), F.lit("")).isin(*ids), 100).otherwise(0)
    return F.when(F.col("_sheet").isin(*sheets), by_id + by_name - F.when(F.col("_detailed"), 3).otherwise(0)).otherwise(-1)


def account_candidates(statements: DataFrame, accounts=None, keep_unmatched: bool = False) -> DataFrame:
    """One row per (statement row, account) with a positive score and an amount.

    ``keep_unmatched`` keeps the other statement rows with a null account.
    """
    scored = F.filter(F.array(*[F.struct(F.lit(a).alias("account"), account_score(s, i, n).alias("score"))
                                for a, s, i, n in (accounts or L.ACCOUNTS)]), lambda x: x["score"] > 0)
    rows = with_amounts(statements)
    ready = rows.withColumns({"_sheet": F.upper(F.coalesce(F.col("sj_div"), F.lit(""))), "_name": A.account_name(F.col("account_nm")),
                              "_detailed": A.account_name(F.col("account_detail")) != ""}).withColumn("_scored", scored)
    # The scores are filtered where they are made: a step with a lambda is no part of fused code, whose one method would
    # grow beyond what the JVM compiles.  The amount test sits inside the generator: as a filter it would be pushed down
    # and parse every text twice.
    usable = F.when(F.col("amount").isNotNull(), F.col("_scored"))
    unfold = F.explode_outer if keep_unmatched else F.explode
    return ready.select(*rows.columns, unfold(usable).alias("_m")).select(
        *rows.columns, F.col("_m.account").alias("account"), F.col("_m.score").alias("score"))


def standard_accounts(statements: DataFrame, accounts=None) -> DataFrame:
    """Best row per (period, account): highest score, first in the statement on ties."""
    best = F.struct("score", (-F.col("line_no")).alias("_order"), "amount", "previous_amount", "account_id", "account_nm",
                    "amount_field", "previous_field", "sj_div")
    picked = account_candidates(statements, accounts).groupBy(*PERIOD, "period_key", "account").agg(
        F.max(best).alias("b"), F.count("*").alias("candidate_count"))
    return picked.select(*PERIOD, "period_key", "account", F.col("b.score").alias("score"), F.col("b.amount").alias("value"),
                         F.col("b.previous_amount").alias("previous_value"), F.col("b.account_id").alias("account_id"),
                         F.col("b.account_nm").alias("account_nm"), F.col("b.amount_field").alias("amount_field"),
                         F.col("b.previous_field").alias("previous_field"), "candidate_count")


def consolidated_accounts(statements: DataFrame, accounts=None) -> DataFrame:
    """:func:`standard_accounts` of the preferred basis in one pass over the statements.

    The best row per account is found for both bases at once; the handful of
    results of a period then meet and the basis is chosen among them.
    """
    best = F.struct("score", (-F.col("line_no")).alias("_order"), "amount", "previous_amount", "account_id", "account_nm",
                    "amount_field", "previous_field", "sj_div")
    per_basis = account_candidates(statements, accounts, keep_unmatched=True).groupBy(*PERIOD, "period_key", "fs_div", "account").agg(
        F.max(best).alias("b"), F.count("*").alias("candidate_count"))
    packed = per_basis.groupBy(*PERIOD, "period_key").agg(F.collect_list(F.struct("fs_div", "account", "b", "candidate_count")).alias("r"))
    basis = F.when(F.exists("r", lambda x: x["fs_div"] == "CFS"), "CFS").otherwise("OFS")
    chosen = packed.withColumn("basis", basis).select(
        *PERIOD, "period_key", "basis", F.explode(F.filter("r", lambda x: (x["fs_div"] == F.col("basis")) & x["account"].isNotNull())).alias("x"))
    return chosen.select(*PERIOD, "period_key", F.col("basis").alias("fs_div"), F.col("x.account").alias("account"), F.col("x.b.score").alias("score"),
                         F.col("x.b.amount").alias("value"), F.col("x.b.previous_amount").alias("previous_value"),
                         F.col("x.b.account_id").alias("account_id"), F.col("x.b.account_nm").alias("account_nm"),
                         F.col("x.b.amount_field").alias("amount_field"), F.col("x.b.previous_field").alias("previous_field"),
                         F.col("x.candidate_count").alias("candidate_count"))


def period_profiles(accounts: DataFrame) -> DataFrame:
    """One row per (company, period): seven accounts and five ratios."""
    names = [a[0] for a in L.ACCOUNTS]
    wide = accounts.groupBy("company", "business_year", "period_key").agg(
        *[F.max(F.when(F.col("account") == n, F.col("value"))).alias(n) for n in names],
        F.max(F.when(F.col("account") == "revenue", F.col("previous_value"))).alias("previous_revenue"))
    c = F.col
    return wide.withColumns({
        "operating_margin": A.safe_ratio(c("operating_income"), c("revenue")),
        "net_margin": A.safe_ratio(c("net_income"), c("revenue")),
        "debt_ratio": A.safe_ratio(c("total_liabilities"), c("total_equity")),
        "liability_ratio": A.safe_ratio(c("total_liabilities"), c("total_assets")),
        "revenue_growth_yoy": A.growth(c("revenue"), c("previous_revenue")),
        "period_order": ident.period_order(c("period_key")),
    })


def latest_periods(profiles: DataFrame) -> DataFrame:
    """Newest period of each company and its ordered period list."""
    return profiles.groupBy("company").agg(
        F.max_by("period_key", "period_order").alias("latest_period"),
        F.transform(F.array_sort(F.collect_set(F.struct("period_order", "period_key"))), lambda x: x["period_key"]).alias("periods"))


def yoy_across_reports(profiles: DataFrame) -> DataFrame:
    """Growth against the same period type one year earlier, from another report."""
    kind = F.split("period_key", "_", 2)[1]
    w = Window.partitionBy("company", "kind").orderBy("business_year")
    lagged = profiles.withColumn("kind", kind).withColumns({
        "_py": F.lag("business_year").over(w), "_pr": F.lag("revenue").over(w)})
    prior = F.when(F.col("_py") == F.col("business_year") - 1, F.col("_pr"))
    return lagged.withColumn("revenue_growth_reports", A.growth(F.col("revenue"), prior)).drop("kind", "_py", "_pr")


def common_periods(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Periods both companies of a pair report.  ``pairs``: target, candidate.

    Both sides read the same stored keys, so the statements are worked through once.
    """
    keys = materialise(profiles.select("company", "period_key", "period_order"))
    mine = keys.withColumnRenamed("company", "candidate")
    theirs = keys.select(F.col("company").alias("target"), "period_key").join(pairs.select("target").distinct(), "target", "left_semi")
    return join_to_few(pairs.join(mine, "candidate"), theirs, ["target", "period_key"])


def match_pairs(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Latest common period of each pair with twelve metrics on both sides.

    Pairs without a common period stay, marked not comparable with the reason.  Both
    metric sets ride along to the aggregate that picks the period, so the profiles
    are joined twice only; the targets' side is cut to the targets that occur and met
    by ``join_to_few``, so one target may have all candidates.
    """
    stored = materialise(profiles.select("company", "period_key", "period_order", F.struct(*[F.col(m).cast("double").alias(m) for m in METRICS]).alias("m")))
    mine = stored.select(F.col("company").alias("candidate"), "period_key", "period_order", F.col("m").alias("c"))
    theirs = (stored.select(F.col("company").alias("target"), "period_key", F.col("m").alias("t"))
              .join(pairs.select("target").distinct(), "target", "left_semi"))
    seen = join_to_few(pairs.select("target", "candidate").join(mine, "candidate", "left"), theirs, ["target", "period_key"], "left")
    shared = F.col("c").isNotNull() & F.col("t").isNotNull()
    best = seen.groupBy("target", "candidate").agg(
        F.max(F.when(shared, F.struct("period_order", "period_key", "t", "c"))).alias("p"), F.count_if(shared).alias("n_common"))
    return best.select(
        "target", "candidate", F.col("p.period_key").alias("comparison_period"), "n_common", F.col("p").isNotNull().alias("comparable"),
        F.when(F.col("p").isNull(), F.lit("no common period")).alias("reason"),
        *[F.col(f"p.{side}.{m}").alias(f"{name}_{m}") for side, name in (("t", "target"), ("c", "candidate")) for m in METRICS])


def within_size_band(pairs: DataFrame, sizes: DataFrame, low: float = L.SIZE_BAND[0], high: float = L.SIZE_BAND[1]) -> DataFrame:
    """Pairs whose candidate size is between ``low`` and ``high`` times the target's.

    ``sizes``: company, metric.
    """
    t = sizes.select(F.col("company").alias("target"), F.col("metric").alias("target_metric"))
    c = sizes.select(F.col("company").alias("candidate"), F.col("metric").alias("candidate_metric"))
    ratio = A.safe_ratio(F.col("candidate_metric"), F.col("target_metric"), 1.0, 6)
    return (pairs.join(c, "candidate").join(t, "target").withColumn("size_ratio", ratio)
            .filter(F.col("size_ratio").between(low, high)))


def valuation_ratios(metrics: DataFrame) -> DataFrame:
    c = F.col
    return metrics.withColumns({
        "per": A.per(c("market_cap"), c("net_income")), "roe": A.roe(c("net_income"), c("total_equity")),
        "roa": A.roa(c("net_income"), c("total_assets")), "pbr": A.pbr(c("market_cap"), c("total_equity")),
        "ev_ebitda": A.ev_ebitda(c("market_cap"), c("total_liabilities"), c("cash"), c("ebitda"))})


def growth_figures(metrics: DataFrame) -> DataFrame:
    """Overseas share of revenue and growth on the previous period."""
    c = F.col
    return metrics.withColumns({"overseas_revenue_ratio": A.safe_ratio(c("overseas_revenue"), c("revenue")),
                                "revenue_growth_yoy": A.growth(c("revenue"), c("previous_period_revenue"))})
