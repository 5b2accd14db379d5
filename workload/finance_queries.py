"""Queries over statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from filinglens.functions import amounts as A
from filinglens.functions import ident
from filinglens.operators import finance as OF
from workload.tables import PAIRS_SQL, STATEMENTS_SQL, segment_pairs, statements, table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def _based(spark, sf):
    return OF.prefer_consolidated(statements(spark, sf))


def _profiles(spark, sf):
    return OF.period_profiles(OF.consolidated_accounts(statements(spark, sf)))


@query("statement_amounts", f"""WITH {STATEMENTS_SQL} SELECT line_no, period_key, amount::DOUBLE AS amount, previous_amount::DOUBLE AS previous_amount, amount_field FROM chosen""")
def statement_amounts(spark, sf):
    return OF.with_amounts(statements(spark, sf)).select("line_no", "period_key", F.col("amount").cast("double").alias("amount"),
                                                         F.col("previous_amount").cast("double").alias("previous_amount"), "amount_field")


@query("consolidated_preferred", f"""WITH {STATEMENTS_SQL} SELECT company, business_year, kind AS dart_report_type, fs_div, count(*) AS n FROM based GROUP BY ALL""")
def consolidated_preferred(spark, sf):
    return _based(spark, sf).groupBy("company", "business_year", "dart_report_type", "fs_div").agg(F.count("*").alias("n"))


@query("account_candidates", f"""WITH {STATEMENTS_SQL} SELECT line_no, account, score::INT AS score FROM chosen""")
def account_candidates(spark, sf):
    return OF.account_candidates(statements(spark, sf)).select("line_no", "account", "score")


@query("standard_accounts", f"""WITH {STATEMENTS_SQL} SELECT company, period_key, account, score::INT AS score, amount::DOUBLE AS value, previous_amount::DOUBLE AS previous_value, candidate_count FROM best""")
def standard_accounts(spark, sf):
    return OF.standard_accounts(_based(spark, sf)).select("company", "period_key", "account", "score", F.col("value").cast("double").alias("value"),
                                                          F.col("previous_value").cast("double").alias("previous_value"), "candidate_count")


@query("consolidated_accounts", f"""WITH {STATEMENTS_SQL} SELECT company, period_key, fs_div, account, score::INT AS score, amount::DOUBLE AS value, candidate_count FROM best""")
def consolidated_accounts(spark, sf):
    return OF.consolidated_accounts(statements(spark, sf)).select("company", "period_key", "fs_div", "account", "score", F.col("value").cast("double").alias("value"), "candidate_count")


RATIOS = ["operating_margin", "net_margin", "debt_ratio", "liability_ratio", "revenue_growth_yoy"]


@query("finance_periods", f"""WITH {STATEMENTS_SQL} SELECT company, period_key, revenue::DOUBLE AS revenue, net_income::DOUBLE AS net_income, {', '.join(RATIOS)}, period_order::INT AS period_order FROM profile""")
def finance_periods(spark, sf):
    return _profiles(spark, sf).select("company", "period_key", F.col("revenue").cast("double").alias("revenue"),
                                       F.col("net_income").cast("double").alias("net_income"), *RATIOS, "period_order")


@query("latest_finance_period", f"""WITH {STATEMENTS_SQL} SELECT company, arg_max(period_key, period_order) AS latest_period, string_agg(period_key, ',' ORDER BY period_order) AS periods FROM profile GROUP BY 1""")
def latest_finance_period(spark, sf):
    return OF.latest_periods(_profiles(spark, sf)).withColumn("periods", F.array_join("periods", ","))


@query("revenue_growth_across_reports", f"""WITH {STATEMENTS_SQL}, w AS (SELECT company, period_key, revenue, business_year, lag(business_year) OVER p AS py, lag(revenue) OVER p AS pr FROM profile WINDOW p AS (PARTITION BY company, period_type ORDER BY business_year))
 SELECT company, period_key, round(CASE WHEN py = business_year - 1 AND pr <> 0 THEN (revenue::DOUBLE - pr::DOUBLE) / abs(pr::DOUBLE) * 100 END, 4) AS revenue_growth_reports FROM w""")
def revenue_growth_across_reports(spark, sf):
    return OF.yoy_across_reports(_profiles(spark, sf)).select("company", "period_key", "revenue_growth_reports")


COMMON_SQL = """both_periods AS (SELECT target, candidate, c.period_key, c.period_order FROM pairs JOIN profile c ON c.company = candidate JOIN profile t ON t.company = target AND t.period_key = c.period_key)"""


@query("common_periods", f"""WITH {STATEMENTS_SQL}, {PAIRS_SQL}, {COMMON_SQL} SELECT target, candidate, period_key FROM both_periods""")
def common_periods(spark, sf):
    return OF.common_periods(segment_pairs(spark, sf), _profiles(spark, sf)).select("target", "candidate", "period_key")


@query("finance_pair_match", f"""WITH {STATEMENTS_SQL}, {PAIRS_SQL}, {COMMON_SQL}, m AS (SELECT target, candidate, arg_max(period_key, period_order) AS p, count(*) AS n FROM both_periods GROUP BY 1, 2)
 SELECT pairs.target, pairs.candidate, p AS comparison_period, coalesce(n, 0) AS n_common, (p IS NOT NULL)::INT AS comparable, CASE WHEN p IS NULL THEN 'no common period' END AS reason,
  t.revenue::DOUBLE AS target_revenue, c.revenue::DOUBLE AS candidate_revenue, t.operating_margin AS target_operating_margin, c.operating_margin AS candidate_operating_margin, t.debt_ratio AS target_debt_ratio, c.debt_ratio AS candidate_debt_ratio,
  t.operating_cash_flow::DOUBLE AS target_operating_cash_flow, c.total_assets::DOUBLE AS candidate_total_assets
 FROM pairs LEFT JOIN m USING (target, candidate) LEFT JOIN profile t ON t.company = pairs.target AND t.period_key = p LEFT JOIN profile c ON c.company = pairs.candidate AND c.period_key = p""")
def finance_pair_match(spark, sf):
    m = OF.match_pairs(segment_pairs(spark, sf), _profiles(spark, sf))
    return m.select("target", "candidate", "comparison_period", "n_common", F.col("comparable").cast("int").alias("comparable"), "reason", "target_revenue", "candidate_revenue",
                    "target_operating_margin", "candidate_operating_margin", "target_debt_ratio", "candidate_debt_ratio", "target_operating_cash_flow", "candidate_total_assets")


@query("size_band", f"""WITH {PAIRS_SQL}, s AS (SELECT o_custkey AS company, round(sum(o_totalprice), 2) AS metric FROM orders GROUP BY 1)
 SELECT target, candidate, round(c.metric / t.metric, 6) AS size_ratio FROM pairs JOIN s c ON c.company = candidate JOIN s t ON t.company = target WHERE round(c.metric / t.metric, 6) BETWEEN 0.3 AND 3.0""")
def size_band(spark, sf):
    sizes = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("company")).agg(F.round(F.sum("o_totalprice"), 2).alias("metric"))
    return OF.within_size_band(segment_pairs(spark, sf), sizes).select("target", "candidate", "size_ratio")


@query("valuation_ratios", """SELECT p_partkey, round(CASE WHEN ni <> 0 THEN cap / ni END, 4) AS per, round(CASE WHEN eq <> 0 THEN ni / eq * 100 END, 4) AS roe, round(CASE WHEN ta <> 0 THEN ni / ta * 100 END, 4) AS roa,
  round(CASE WHEN eq <> 0 THEN cap / eq END, 4) AS pbr, round(CASE WHEN eb <> 0 THEN (cap + li - cash) / eb END, 4) AS ev_ebitda
 FROM (SELECT p_partkey, p_retailprice AS cap, (p_size % 7 - 2)::DOUBLE AS ni, (p_size % 5)::DOUBLE AS eq, p_size::DOUBLE AS ta, (p_size * 3)::DOUBLE AS li, (p_size % 4)::DOUBLE AS cash, (p_size % 11)::DOUBLE AS eb FROM part)""")
def valuation_ratios(spark, sf):
    p = table(spark, sf, "part")
    s = F.col("p_size").cast("double")
    m = p.select("p_partkey", F.col("p_retailprice").alias("market_cap"), (s % 7 - 2).alias("net_income"), (s % 5).alias("total_equity"), s.alias("total_assets"),
                 (s * 3).alias("total_liabilities"), (s % 4).alias("cash"), (s % 11).alias("ebitda"))
    return OF.valuation_ratios(m).select("p_partkey", "per", "roe", "roa", "pbr", "ev_ebitda")


@query("growth_figures", """SELECT o_custkey, round(CASE WHEN r <> 0 THEN x / r * 100 END, 4) AS overseas_revenue_ratio, round(CASE WHEN p <> 0 THEN (r - p) / abs(p) * 100 END, 4) AS revenue_growth_yoy FROM
 (SELECT o_custkey, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1999), 2) AS r, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1999 AND o_orderstatus = 'F'), 2) AS x,
  round(sum(o_totalprice) FILTER (year(o_orderdate) = 1998), 2) AS p FROM orders GROUP BY 1)""")
def growth_figures(spark, sf):
    o = table(spark, sf, "orders")
    y, v = F.year("o_orderdate"), F.col("o_totalprice")
    m = o.groupBy("o_custkey").agg(F.round(F.sum(F.when(y == 1999, v)), 2).alias("revenue"),
                                   F.round(F.sum(F.when((y == 1999) & (F.col("o_orderstatus") == "F"), v)), 2).alias("overseas_revenue"),
                                   F.round(F.sum(F.when(y == 1998, v)), 2).alias("previous_period_revenue"))
    return OF.growth_figures(m).select("o_custkey", "overseas_revenue_ratio", "revenue_growth_yoy")


@query("business_year", """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('3-MEDIUM', '1-URGENT') THEN year(o_orderdate) + 5 WHEN o_orderpriority = '2-HIGH' THEN year(o_orderdate) + 6 WHEN o_orderstatus = 'F' THEN year(o_orderdate) + 6 ELSE year(o_orderdate) + 7 END::INT AS business_year FROM orders""")
def business_year(spark, sf):
    """Years from names, file names or the filing day, whichever the row has."""
    o = table(spark, sf, "orders")
    p, y = F.col("o_orderpriority"), F.year("o_orderdate")
    text = lambda d: (y + d).cast("string")
    name = F.when(p == "3-MEDIUM", F.concat(F.lit("사업보고서 (2001.01) ("), text(5), F.lit(".12)"))).when(p == "1-URGENT", F.concat(text(5), F.lit("년 보고"))).otherwise("분기보고서")
    file = F.when(p == "2-HIGH", F.concat(F.lit("report_"), text(6), F.lit("-03.zip")))
    kind = F.when(F.col("o_orderstatus") == "F", "annual").otherwise("quarterly")
    return o.select("o_orderkey", ident.business_year(kind, name, file, F.concat(text(7), F.lit("0321"))).alias("business_year"))


@query("quarter_kind", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'quarterly_1' WHEN '2-HIGH' THEN 'quarterly_3' WHEN '3-MEDIUM' THEN 'annual' WHEN '4-NOT SPECIFIED' THEN 'quarterly_1' END AS kind,
  CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS undecided FROM orders""")
def quarter_kind(spark, sf):
    o = table(spark, sf, "orders")
    p = F.col("o_orderpriority")
    name = F.when(p == "1-URGENT", "1분기보고서").when(p == "2-HIGH", "분기보고서 (2001.09)").otherwise("분기보고서")
    file = F.when(p == "4-NOT SPECIFIED", "x-03.zip")
    kind = ident.statement_report_kind(F.when(p == "3-MEDIUM", "annual").otherwise("quarterly"), name, file)
    return o.select("o_orderkey", kind.alias("kind"), kind.isNull().cast("int").alias("undecided"))


@query("uneven_metadata", """SELECT event_id, CASE WHEN event_type = 'click' THEN 'k' || user_id WHEN value > 5 THEN round(value)::BIGINT::VARCHAR ELSE event_type END AS filed FROM events""")
def uneven_metadata(spark, sf):
    """First filled alias of a field that sources name differently."""
    e = table(spark, sf, "events")
    rows = e.select("event_id", F.when(F.col("event_type") == "click", F.concat(F.lit("k"), F.col("user_id").cast("string"))).alias("rcept_dt"),
                    F.when(F.col("value") > 5, F.round("value").cast("bigint").cast("string")).otherwise(" ").alias("filing_date"), F.col("event_type").alias("report_date"))
    return rows.select("event_id", ident.first_filled(F.col("rcept_dt"), F.col("filing_date"), F.col("report_date")).alias("filed"))


@query("amount_parsing", """SELECT l_orderkey, l_partkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN -round(l_extendedprice * 100) WHEN 'A' THEN round(l_extendedprice * 100) END::DOUBLE AS amount,
 l_suppkey * 1000 + l_linenumber AS whole, round(l_tax, 2) AS share FROM lineitem""")
def amount_parsing(spark, sf):
    li = table(spark, sf, "lineitem")
    cents = F.format_number(F.round(F.col("l_extendedprice") * 100).cast("bigint"), 0)
    text = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("("), cents, F.lit(")"))).when(F.col("l_returnflag") == "A", F.concat(F.lit(" "), cents)).otherwise("-")
    whole = F.concat(F.lit("KRW "), F.format_number(F.col("l_suppkey") * 1000 + F.col("l_linenumber"), 0), F.lit("원"))
    return li.select("l_orderkey", "l_partkey", "l_linenumber", A.parse_amount(text).cast("double").alias("amount"), A.parse_int(whole).alias("whole"),
                     A.parse_float(F.concat(F.lit("약 "), F.round("l_tax", 2).cast("string"), F.lit("%"))).alias("share"))


@query("account_names", """SELECT p_partkey, lower(replace(p_name, ' ', '')) || p_size AS name FROM part""")
def account_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", A.account_name(F.concat(F.lit(" "), F.upper("p_name"), F.lit("ㆍ·\t"), F.col("p_size").cast("string"))).alias("name"))
