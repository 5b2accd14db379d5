"""How the given tables stand in for filing data, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.session import spread

AS_OF = "1999-06-30"
DAY = "%Y-%m-%d"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


# --- filings: one per order ----------------------------------------------------------

def filings(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    year = F.year("o_orderdate").cast("string")
    p = F.col("o_orderpriority")
    name = (F.when(p == "1-URGENT", F.lit("증권신고서(지분증권)")).when(p == "2-HIGH", F.lit("[기재정정]증권신고서(지분증권)"))
            .when(p == "3-MEDIUM", F.concat(F.lit("사업보고서 ("), year, F.lit(".12)")))
            .when(p == "4-NOT SPECIFIED", F.concat(F.lit("[기재정정]반기보고서 ("), year, F.lit(".06)")))
            .otherwise(F.concat(F.lit("분기보고서 ("), year, F.when(F.col("o_orderstatus") == "O", ".09)").otherwise(".03)"))))
    return o.select(F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("corp_code"),
                    F.lpad(F.col("o_orderkey").cast("string"), 14, "0").alias("rcept_no"),
                    F.to_date("o_orderdate").alias("rcept_dt"), name.alias("report_nm"))


FILINGS_SQL = """filing AS (
  SELECT lpad(o_custkey::VARCHAR, 8, '0') AS corp_code, lpad(o_orderkey::VARCHAR, 14, '0') AS rcept_no, o_orderdate::DATE AS rcept_dt,
    CASE o_orderpriority WHEN '1-URGENT' THEN '증권신고서(지분증권)' WHEN '2-HIGH' THEN '[기재정정]증권신고서(지분증권)'
      WHEN '3-MEDIUM' THEN '사업보고서 (' || year(o_orderdate) || '.12)' WHEN '4-NOT SPECIFIED' THEN '[기재정정]반기보고서 (' || year(o_orderdate) || '.06)'
      ELSE '분기보고서 (' || year(o_orderdate) || CASE WHEN o_orderstatus = 'O' THEN '.09)' ELSE '.03)' END END AS report_nm
  FROM orders),
typed AS (
  SELECT *, CASE WHEN contains(report_nm, '사업보고서') THEN 'annual' WHEN contains(report_nm, '반기보고서') THEN 'semiannual'
    WHEN contains(report_nm, '분기보고서') THEN 'quarterly' END AS report_type FROM filing)"""


# --- registry and listing: one company per customer --------------------------------------

def registry(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey").cast("string")
    return c.select(F.lpad(k, 8, "0").alias("corp_code"), F.col("c_name").alias("corp_name"),
                    F.concat(F.lit("C"), k, F.lit(" "), F.col("c_mktsegment")).alias("corp_eng_name"),
                    F.when(F.col("c_acctbal") >= 0, F.lpad(k, 6, "0")).otherwise("").alias("stock_code"),
                    F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("c_nationkey")), "yyyyMMdd").alias("modify_date"))


REGISTRY_SQL = """registry AS (
  SELECT lpad(c_custkey::VARCHAR, 8, '0') AS corp_code, c_name AS corp_name, 'C' || c_custkey || ' ' || c_mktsegment AS corp_eng_name,
    CASE WHEN c_acctbal >= 0 THEN lpad(c_custkey::VARCHAR, 6, '0') ELSE '' END AS stock_code,
    strftime(DATE '2000-01-01' + c_nationkey, '%Y%m%d') AS modify_date FROM customer)"""


def listing_items(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select((F.col("c_custkey") + F.when(F.col("c_nationkey") == 7, 100000000).otherwise(0)).cast("string").alias("ISU_SRT_CD"),
                    F.when(F.col("c_nationkey") < 3, F.lit("")).when(F.col("c_nationkey") < 22, F.lit("주권")).otherwise(F.lit("외국주권")).alias("SECUGRP_NM"),
                    F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("구형우선주")).when(F.col("c_nationkey") < 10, F.lit("보통주")).otherwise(F.lit("")).alias("KIND_STKCERT_TP_NM"),
                    F.concat(F.lit("L"), F.col("c_name")).alias("ISU_ABBRV"), F.col("c_mktsegment").alias("MKT_TP_NM"),
                    F.lit("20000101").alias("LIST_DD"), F.floor("c_acctbal").cast("bigint").cast("string").alias("LIST_SHRS"))


LISTING_SQL = """item AS (
  SELECT (c_custkey + CASE WHEN c_nationkey = 7 THEN 100000000 ELSE 0 END)::VARCHAR AS code,
    CASE WHEN c_nationkey < 3 THEN '' WHEN c_nationkey < 22 THEN '주권' ELSE '외국주권' END AS grp,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN '구형우선주' WHEN c_nationkey < 10 THEN '보통주' ELSE '' END AS kind,
    'L' || c_name AS listed_name, c_mktsegment AS market, '20000101' AS listing_date, floor(c_acctbal)::BIGINT::VARCHAR AS listed_shares FROM customer),
listing AS (
  SELECT CASE WHEN length(code) >= 6 THEN code ELSE lpad(code, 6, '0') END AS stock_code, listed_name, market, listing_date, listed_shares
  FROM item WHERE grp IN ('', '주권') AND (kind = '' OR contains(kind, '보통주')))"""


# --- statements: one row per order line -------------------------------------------------------

# line number → sheet, account id, its usual name, another name
LINES = [
    (1, "IS", "ifrs-full_Revenue", "매출액", "기타매출액"),
    (2, "cis", "dart_OperatingIncomeLoss", "영업 이익", "영업이익(손실)"),
    (3, "IS", "ifrs-full_ProfitLoss", "당기순이익", "분기순이익(손실)"),
    (4, "CF", "ifrs-full_CashFlowsFromUsedInOperatingActivities", "영업활동현금흐름", "영업활동으로 인한 현금흐름"),
    (5, "BS", "ifrs-full_Assets", "자산총계", "자산ㆍ총계"),
    (6, "BS", "ifrs-full_Liabilities", "부채총계", "부채총액"),
    (7, "bs", "ifrs-full_Equity", "자본총계", "자본 총액"),
]


def statements(spark: SparkSession, sf: str) -> DataFrame:
    o, li = table(spark, sf, "orders"), spread(table(spark, sf, "lineitem"), "l_orderkey")
    lines = spark.createDataFrame(LINES, "l_linenumber int, sheet string, id string, name string, other string")
    j = li.join(o.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).join(F.broadcast(lines), "l_linenumber")
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")
    flag = F.col("l_returnflag")
    quarter = F.quarter("o_orderdate")
    return j.select(
        F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("business_year"),
        F.when(quarter == 1, "quarterly_1").when(quarter == 2, "semiannual").when(quarter == 3, "quarterly_3").otherwise("annual").alias("dart_report_type"),
        F.when(F.col("l_linestatus") == "O", "CFS").otherwise("OFS").alias("fs_div"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"),
        F.col("sheet").alias("sj_div"),
        F.when(F.col("l_quantity") < 40, F.col("id")).otherwise(F.lit("-표준계정코드 미사용-")).alias("account_id"),
        F.when(F.col("l_tax") < 0.05, F.col("name")).otherwise(F.col("other")).alias("account_nm"),
        F.when(F.col("l_discount") > 0.07, "-").otherwise("").alias("account_detail"),
        F.when(flag == "R", F.concat(F.lit("("), price, F.lit(")"))).when(flag == "A", F.concat(F.lit("1,"), price)).otherwise(price).alias("thstrm_amount"),
        F.when(F.col("l_quantity") % 5 == 0, "-").otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("thstrm_add_amount"),
        F.when(F.col("l_quantity") % 7 == 0, "N/A").otherwise(F.concat(F.lit("-"), F.col("l_suppkey").cast("string"))).alias("frmtrm_amount"),
        F.when(F.col("l_quantity") % 3 == 0, "").otherwise(F.col("l_partkey").cast("string")).alias("frmtrm_add_amount"))


STATEMENTS_SQL = """stmt AS (
  SELECT o_custkey AS company, year(o_orderdate)::INT AS business_year,
    ['quarterly_1','semiannual','quarterly_3','annual'][quarter(o_orderdate)] AS kind,
    ['Q1_YTD','H1_YTD','Q3_YTD','FY'][quarter(o_orderdate)] AS period_type,
    CASE WHEN l_linestatus = 'O' THEN 'CFS' ELSE 'OFS' END AS fs_div, l_orderkey * 10 + l_linenumber AS line_no,
    ['IS','CIS','IS','CF','BS','BS','BS'][l_linenumber] AS sj,
    ['revenue','operating_income','net_income','operating_cash_flow','total_assets','total_liabilities','total_equity'][l_linenumber] AS account,
    l_quantity < 40 AS id_hit, l_tax < 0.05 AS plain_name, l_discount > 0.07 AS has_detail, l_linenumber AS ln,
    round(l_extendedprice * 100)::BIGINT AS cents, l_returnflag AS flag, l_quantity::BIGINT AS q, l_suppkey AS sk, l_partkey AS pk
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
amounts AS (
  SELECT *, CASE WHEN flag = 'R' THEN -cents WHEN flag = 'A' THEN ('1' || cents)::BIGINT ELSE cents END AS term,
    CASE WHEN q % 5 = 0 THEN NULL ELSE q END AS cumul, CASE WHEN q % 7 = 0 THEN NULL ELSE -sk END AS pterm, CASE WHEN q % 3 = 0 THEN NULL ELSE pk END AS pcumul FROM stmt),
chosen AS (
  SELECT *, CASE WHEN sj <> 'BS' AND period_type <> 'FY' AND cumul IS NOT NULL THEN cumul ELSE term END AS amount,
    CASE WHEN sj <> 'BS' AND period_type <> 'FY' AND cumul IS NOT NULL THEN 'thstrm_add_amount' ELSE 'thstrm_amount' END AS amount_field,
    CASE WHEN sj <> 'BS' AND period_type <> 'FY' AND pcumul IS NOT NULL THEN pcumul ELSE pterm END AS previous_amount,
    CASE WHEN id_hit THEN 100 ELSE 0 END + CASE WHEN NOT plain_name AND ln IN (1, 3) THEN 20 ELSE 50 END - CASE WHEN has_detail THEN 3 ELSE 0 END AS score,
    business_year || '_' || period_type AS period_key FROM amounts),
based AS (SELECT c.* FROM chosen c JOIN (SELECT company, business_year, kind, bool_or(fs_div = 'CFS') AS cfs FROM chosen GROUP BY ALL) b
  USING (company, business_year, kind) WHERE fs_div = CASE WHEN cfs THEN 'CFS' ELSE 'OFS' END),
best AS (SELECT *, count(*) OVER (PARTITION BY company, business_year, kind, account) AS candidate_count FROM based
  QUALIFY row_number() OVER (PARTITION BY company, business_year, kind, account ORDER BY score DESC, line_no, amount DESC, previous_amount DESC NULLS LAST) = 1),
profile AS (
  SELECT *, round(CASE WHEN revenue <> 0 THEN operating_income::DOUBLE / revenue::DOUBLE * 100 END, 4) AS operating_margin,
    round(CASE WHEN revenue <> 0 THEN net_income::DOUBLE / revenue::DOUBLE * 100 END, 4) AS net_margin,
    round(CASE WHEN total_equity <> 0 THEN total_liabilities::DOUBLE / total_equity::DOUBLE * 100 END, 4) AS debt_ratio,
    round(CASE WHEN total_assets <> 0 THEN total_liabilities::DOUBLE / total_assets::DOUBLE * 100 END, 4) AS liability_ratio,
    round(CASE WHEN previous_revenue <> 0 THEN (revenue::DOUBLE - previous_revenue::DOUBLE) / abs(previous_revenue::DOUBLE) * 100 END, 4) AS revenue_growth_yoy,
    business_year * 10 + CASE period_type WHEN 'FY' THEN 0 WHEN 'Q1_YTD' THEN 1 WHEN 'H1_YTD' THEN 2 ELSE 3 END AS period_order
  FROM (SELECT company, business_year, period_type, period_key, max(amount) FILTER (account = 'revenue') AS revenue,
    max(amount) FILTER (account = 'operating_income') AS operating_income, max(amount) FILTER (account = 'net_income') AS net_income,
    max(amount) FILTER (account = 'operating_cash_flow') AS operating_cash_flow, max(amount) FILTER (account = 'total_assets') AS total_assets,
    max(amount) FILTER (account = 'total_liabilities') AS total_liabilities, max(amount) FILTER (account = 'total_equity') AS total_equity,
    max(previous_amount) FILTER (account = 'revenue') AS previous_revenue FROM best GROUP BY ALL))"""


def segment_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer paired with the first customer of its market segment."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    lead = c.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("target"))
    return c.join(lead, "c_mktsegment").filter("c_custkey <> target").select("target", F.col("c_custkey").alias("candidate"))


PAIRS_SQL = """pairs AS (SELECT * FROM (SELECT min(c_custkey) OVER (PARTITION BY c_mktsegment) AS target, c_custkey AS candidate FROM customer) WHERE target <> candidate)"""
