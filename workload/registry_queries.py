"""Queries over filings, registry and listing."""

from __future__ import annotations

from pyspark.sql import functions as F

from filinglens.functions import ident
from filinglens.operators import filings as OF
from filinglens.operators import registry as OR
from filinglens.operators.ordering import latest_per_group
from filinglens.streaming.ingest import status_log
from workload.tables import AS_OF, FILINGS_SQL, LISTING_SQL, REGISTRY_SQL, day, filings, listing_items, registry, table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


WINDOW = f"rcept_dt BETWEEN DATE '{AS_OF}' - 800 AND DATE '{AS_OF}'"


@query("asof_latest_filing", f"""WITH {FILINGS_SQL}, {REGISTRY_SQL},
 win AS (SELECT * FROM typed WHERE {WINDOW} AND report_type IS NOT NULL),
 newest AS (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY corp_code ORDER BY rcept_dt DESC, rcept_no DESC) = 1),
 cnt AS (SELECT corp_code, count(*) FILTER (report_type = 'annual') AS annual, count(*) FILTER (report_type = 'semiannual') AS semiannual,
   count(*) FILTER (report_type = 'quarterly') AS quarterly FROM win GROUP BY 1)
 SELECT r.corp_code, corp_name, strftime(rcept_dt, '%Y-%m-%d') AS rcept_dt, rcept_no, report_nm, coalesce(annual, 0) AS annual,
   coalesce(semiannual, 0) AS semiannual, coalesce(quarterly, 0) AS quarterly
 FROM registry r LEFT JOIN newest n USING (corp_code) LEFT JOIN cnt c USING (corp_code)""")
def asof_latest_filing(spark, sf):
    """Latest periodic filing per company at the analysis date, with counts per class."""
    f = filings(spark, sf)
    latest = OF.latest_periodic_as_of(registry(spark, sf).select("corp_code", "corp_name"), f, AS_OF)
    counts = OF.report_counts(OF.within_lookback(f, AS_OF).filter(ident.report_type(F.col("report_nm")).isNotNull()))
    return (latest.join(counts, "corp_code", "left").fillna(0, ["annual", "semiannual", "quarterly"])
            .select("corp_code", "corp_name", day("rcept_dt"), "rcept_no", "report_nm", "annual", "semiannual", "quarterly")
            .orderBy(F.desc("rcept_dt"), "corp_name"))


@query("asof_named_filings", f"""WITH {FILINGS_SQL} SELECT corp_code, rcept_no, strftime(rcept_dt, '%Y%m%d') AS rcept_dt FROM filing
 WHERE rcept_dt <= DATE '{AS_OF}' AND contains(report_nm, '증권신고서') AND contains(report_nm, '지분증권')""")
def asof_named_filings(spark, sf):
    f = OF.named_all(OF.as_of(filings(spark, sf), AS_OF), ["증권신고서", "지분증권"])
    return f.select("corp_code", "rcept_no", ident.dashed_to_compact(F.date_format("rcept_dt", "yyyy-MM-dd")).alias("rcept_dt"))


@query("filings_before_event_day", f"""WITH {FILINGS_SQL} SELECT year(rcept_dt) AS y, count(*) AS n, count(*) FILTER (rcept_dt = DATE '{AS_OF}' - 1) AS day_before
 FROM filing WHERE rcept_dt < DATE '{AS_OF}' GROUP BY 1""")
def filings_before_event_day(spark, sf):
    f = OF.before(filings(spark, sf), AS_OF)
    return f.groupBy(F.year("rcept_dt").cast("bigint").alias("y")).agg(
        F.count("*").alias("n"), F.count_if(F.col("rcept_dt") == F.date_sub(F.lit(AS_OF).cast("date"), 1)).alias("day_before"))


@query("first_original_filing", f"""WITH {FILINGS_SQL} SELECT *, count(*) OVER () AS n_companies FROM (SELECT corp_code, strftime(rcept_dt, '%Y-%m-%d') AS rcept_dt, rcept_no
 FROM filing WHERE report_nm = '증권신고서(지분증권)' QUALIFY row_number() OVER (PARTITION BY corp_code ORDER BY filing.rcept_dt, rcept_no) = 1)""")
def first_original_filing(spark, sf):
    first = OF.first_original(filings(spark, sf))
    total = first.agg(F.countDistinct("corp_code")).first()[0]
    return first.select("corp_code", day("rcept_dt"), "rcept_no", F.lit(total).cast("bigint").alias("n_companies")).orderBy(F.desc("rcept_dt"), "corp_code")


@query("report_classes", f"""WITH {FILINGS_SQL} SELECT rcept_no, report_type,
   CASE report_type WHEN 'annual' THEN 'A001' WHEN 'semiannual' THEN 'A002' WHEN 'quarterly' THEN 'A003' ELSE 'C001' END AS form_code,
   nullif(regexp_extract(report_nm, '\\((\\d{{4}}\\.\\d{{2}})\\)', 1), '') AS report_period,
   'https://dart.fss.or.kr/dsaf001/main.do?rcpNo=' || rcept_no AS source_url FROM typed""")
def report_classes(spark, sf):
    return OF.classify(filings(spark, sf)).select("rcept_no", "report_type", "form_code", "report_period", "source_url")


@query("identifier_quarantine", """SELECT o_orderkey, CASE WHEN NOT regexp_matches(code, '^\\d{8}$') THEN 'corp_code' WHEN NOT regexp_matches(no, '^\\d{14}$') THEN 'rcept_no' END AS problem
 FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey::VARCHAR ELSE lpad(o_custkey::VARCHAR, 8, '0') END AS code,
   CASE WHEN o_orderpriority = '5-LOW' THEN 'R' || o_orderkey ELSE lpad(o_orderkey::VARCHAR, 14, '0') END AS no FROM orders)
 WHERE NOT regexp_matches(code, '^\\d{8}$') OR NOT regexp_matches(no, '^\\d{14}$')""")
def identifier_quarantine(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string")).otherwise(ident.corp_code(F.col("o_custkey"))).alias("corp_code"),
                    F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("R"), F.col("o_orderkey").cast("string")))
                    .otherwise(F.lpad(F.col("o_orderkey").cast("string"), 14, "0")).alias("rcept_no"), F.col("o_orderdate").alias("rcept_dt"))
    return OF.quarantine(rows)[1].select("o_orderkey", "problem")


@query("common_stock_listing", f"WITH {LISTING_SQL} SELECT * FROM listing")
def common_stock_listing(spark, sf):
    return OR.common_stock_listing(listing_items(spark, sf))


TARGET = "Customer#000000010"


@query("registry_listing_universe", f"""WITH {REGISTRY_SQL}, {LISTING_SQL} SELECT corp_code, stock_code, corp_name, listed_name, market, listing_date, listed_shares
 FROM (SELECT * FROM registry WHERE stock_code <> '') r JOIN listing USING (stock_code) WHERE corp_name <> '{TARGET}'""")
def registry_listing_universe(spark, sf):
    u = OR.universe(registry(spark, sf), OR.common_stock_listing(listing_items(spark, sf)), TARGET, ["modify_date"])
    return u.select("corp_code", "stock_code", "corp_name", "listed_name", "market", "listing_date", "listed_shares")


@query("unmatched_listing_count", f"""WITH {REGISTRY_SQL}, {LISTING_SQL} SELECT market, count(*) AS n FROM listing
 WHERE stock_code NOT IN (SELECT stock_code FROM registry WHERE stock_code <> '') GROUP BY 1""")
def unmatched_listing_count(spark, sf):
    r = registry(spark, sf).filter("stock_code <> ''")
    return OR.unmatched(r, OR.common_stock_listing(listing_items(spark, sf))).groupBy("market").agg(F.count("*").alias("n"))


RECENT = ("1999-04-02", "1999-06-30")


@query("recent_issuers", f"""WITH {FILINGS_SQL}, sec AS (SELECT * FROM filing WHERE contains(report_nm, '증권신고서(지분증권)') AND rcept_dt <= DATE '{RECENT[1]}'),
 fst AS (SELECT * FROM sec QUALIFY row_number() OVER (PARTITION BY corp_code ORDER BY rcept_dt, rcept_no) = 1),
 rec AS (SELECT * FROM sec WHERE rcept_dt >= DATE '{RECENT[0]}' QUALIFY row_number() OVER (PARTITION BY corp_code ORDER BY rcept_dt DESC, rcept_no DESC) = 1)
 SELECT r.corp_code, strftime(f.rcept_dt, '%Y-%m-%d') AS first_rcept_dt, f.rcept_no AS first_rcept_no, f.report_nm AS first_report_nm,
  strftime(r.rcept_dt, '%Y-%m-%d') AS recent_rcept_dt, r.rcept_no AS recent_rcept_no, r.report_nm AS recent_report_nm FROM rec r JOIN fst f USING (corp_code)""")
def recent_issuers(spark, sf):
    r = OF.recent_issuers(filings(spark, sf), *RECENT)
    return r.orderBy(F.desc("recent_rcept_dt"), "corp_code").withColumns(
        {c: F.date_format(c, "yyyy-MM-dd") for c in ("first_rcept_dt", "recent_rcept_dt")})


EVENTS_SQL = """ev AS (SELECT corp_code, min(rcept_dt) AS event_dt FROM filing WHERE report_nm = '증권신고서(지분증권)' GROUP BY 1),
 pre AS (SELECT t.*, event_dt FROM typed t JOIN ev USING (corp_code) WHERE report_type IS NOT NULL AND rcept_dt <= event_dt - 1)"""


def _events(spark, sf):
    return OF.first_original(filings(spark, sf)).select("corp_code", F.col("rcept_dt").alias("event_dt"))


@query("pre_event_counts", f"""WITH {FILINGS_SQL}, {EVENTS_SQL},
 c AS (SELECT corp_code, count(*) FILTER (report_type = 'annual') AS a, count(*) FILTER (report_type = 'semiannual') AS s, count(*) FILTER (report_type = 'quarterly') AS q, count(*) AS t FROM pre GROUP BY 1),
 l AS (SELECT * FROM pre QUALIFY row_number() OVER (PARTITION BY corp_code ORDER BY rcept_dt DESC, rcept_no DESC) = 1)
 SELECT ev.corp_code, strftime(ev.event_dt, '%Y-%m-%d') AS event_dt, coalesce(a, 0) AS annual_count, coalesce(s, 0) AS semiannual_count, coalesce(q, 0) AS quarterly_count,
  coalesce(t, 0) AS total_count, (coalesce(t, 0) > 0)::INT AS has_report, l.report_type AS latest_type, strftime(l.rcept_dt, '%Y-%m-%d') AS latest_dt, l.rcept_no AS latest_no
 FROM ev LEFT JOIN c USING (corp_code) LEFT JOIN l USING (corp_code)""")
def pre_event_counts(spark, sf):
    out = OF.pre_event_counts(_events(spark, sf), filings(spark, sf))
    return out.withColumns({"event_dt": F.date_format("event_dt", "yyyy-MM-dd"), "latest_dt": F.date_format("latest_dt", "yyyy-MM-dd"),
                            "has_report": F.col("has_report").cast("int")})


@query("pre_event_reports", f"""WITH {FILINGS_SQL}, {EVENTS_SQL} SELECT corp_code, rcept_no, strftime(rcept_dt, '%Y-%m-%d') AS rcept_dt, report_type, strftime(event_dt, '%Y-%m-%d') AS event_dt FROM pre""")
def pre_event_reports(spark, sf):
    return (OF.pre_event_reports(_events(spark, sf), filings(spark, sf)).orderBy(F.desc("event_dt"), "corp_code", F.desc("rcept_dt"))
            .select("corp_code", "rcept_no", day("rcept_dt"), "report_type", day("event_dt")))


@query("reports_before_first_event", f"""WITH {FILINGS_SQL}, ev AS (SELECT corp_code, rcept_dt AS event_dt, rcept_no AS event_no FROM filing WHERE contains(report_nm, '증권신고서(지분증권)')
  QUALIFY row_number() OVER (PARTITION BY corp_code ORDER BY rcept_dt, rcept_no) = 1)
 SELECT corp_code, strftime(event_dt, '%Y-%m-%d') AS event_dt, event_no, count(*) FILTER (report_type = 'annual') AS annual_count, count(*) FILTER (report_type = 'quarterly') AS quarterly_count
 FROM typed JOIN ev USING (corp_code) WHERE report_type IN ('annual', 'quarterly') AND rcept_dt < event_dt GROUP BY ALL""")
def reports_before_first_event(spark, sf):
    return OF.reports_before_first_event(filings(spark, sf)).withColumn("event_dt", F.date_format("event_dt", "yyyy-MM-dd"))


@query("latest_per_report_type", f"""WITH {FILINGS_SQL} SELECT corp_code, report_type, strftime(rcept_dt, '%Y-%m-%d') AS rcept_dt, rcept_no, report_nm FROM typed
 WHERE report_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY corp_code, report_type ORDER BY rcept_dt DESC, rcept_no DESC) = 1""")
def latest_per_report_type(spark, sf):
    return OF.latest_per_type(filings(spark, sf)).select("corp_code", "report_type", day("rcept_dt"), "rcept_no", "report_nm")


@query("periodic_filing_list", f"""WITH {FILINGS_SQL}, two AS (SELECT *, 0 AS v FROM typed UNION ALL SELECT * REPLACE (report_nm || ' [정정]' AS report_nm), 1 AS v FROM typed WHERE contains(report_nm, '반기보고서')),
 d AS (SELECT * FROM two WHERE report_type IS NOT NULL AND rcept_dt BETWEEN DATE '1996-01-01' AND DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY rcept_no ORDER BY rcept_dt DESC, v DESC) = 1)
 SELECT corp_code, rcept_no, strftime(rcept_dt, '%Y-%m-%d') AS rcept_dt, report_nm, report_type, nullif(regexp_extract(report_nm, '\\((\\d{{4}}\\.\\d{{2}})\\)', 1), '') AS report_period FROM d""")
def periodic_filing_list(spark, sf):
    """Two result pages, the second correcting part of the first; the later one wins."""
    first = filings(spark, sf).withColumn("page", F.lit(0))
    again = first.filter(F.col("report_nm").contains("반기보고서")).withColumns({"report_nm": F.concat("report_nm", F.lit(" [정정]")), "page": F.lit(1)})
    listed = OF.periodic_list(OF.union_all(first, again), "1996-01-01", AS_OF, ["rcept_dt", "page"])
    return listed.orderBy("rcept_dt", "rcept_no").select("corp_code", "rcept_no", day("rcept_dt"), "report_nm", "report_type", "report_period")


@query("company_resolution", f"""WITH {REGISTRY_SQL}, q AS (SELECT DISTINCT s_name AS query, lower(trim(s_name)) AS q FROM
   (SELECT replace(s_name, 'Supplier', 'Customer') AS s_name FROM supplier UNION ALL SELECT substr(replace(s_name, 'Supplier', 'Customer'), 1, 17) FROM supplier
    UNION ALL SELECT s_suppkey::VARCHAR FROM supplier UNION ALL SELECT lpad(s_suppkey::VARCHAR, 6, '0') FROM supplier UNION ALL SELECT 'c' || s_suppkey || ' m' FROM supplier UNION ALL SELECT s_name || '?' FROM supplier)),
 e AS (SELECT DISTINCT query, corp_code FROM q JOIN registry ON q IN (lower(corp_code), lower(stock_code), lower(corp_name), lower(corp_eng_name)) WHERE q <> ''),
 i AS (SELECT query, corp_code FROM q JOIN registry ON contains(lower(corp_name), q) OR contains(lower(corp_eng_name), q) WHERE query NOT IN (SELECT query FROM e)),
 h AS (SELECT query, count(*) AS n, min(corp_code) AS c FROM (SELECT * FROM e UNION ALL SELECT * FROM i) GROUP BY 1)
 SELECT query, coalesce(n, 0) AS n_companies, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN c END AS corp_code
 FROM (SELECT DISTINCT query FROM q) LEFT JOIN h USING (query)""")
def company_resolution(spark, sf):
    """Supplier names, prefixes, codes and misspellings resolved against the registry."""
    s = table(spark, sf, "supplier")
    k, like = F.col("s_suppkey").cast("string"), F.replace(F.col("s_name"), F.lit("Supplier"), F.lit("Customer"))
    asked = s.select(F.explode(F.array(like, F.substring(like, 1, 17), k, F.lpad(k, 6, "0"), F.concat(F.lit("c"), k, F.lit(" m")),
                                       F.concat("s_name", F.lit("?")))).alias("query"))
    return OR.resolve(asked, registry(spark, sf))


@query("date_slices", """WITH r AS (SELECT o_custkey, min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM orders GROUP BY 1),
 x AS (SELECT o_custkey, s, e, unnest(range(0, 40)) AS i FROM r)
 SELECT o_custkey, i AS slice, strftime(s + to_months(3 * i::INT), '%Y-%m-%d') AS slice_start, strftime(least((s + to_months(3 * i::INT))::DATE + INTERVAL 3 MONTH - INTERVAL 1 DAY, e), '%Y-%m-%d') AS slice_end
 FROM x WHERE s + to_months(3 * i::INT) <= e""")
def date_slices(spark, sf):
    spans = table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))
    return OF.date_slices(spans).select("o_custkey", F.col("slice").cast("bigint").alias("slice"), day("slice_start"), day("slice_end"))


@query("exchange_union", """SELECT market, count(*) AS n, count(extra) AS with_extra FROM (SELECT c_mktsegment AS market, c_name AS name, NULL AS extra FROM customer
 UNION ALL SELECT 'SUPPLIERS', s_name, s_acctbal FROM supplier) GROUP BY 1""")
def exchange_union(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("market"), F.col("c_name").alias("name"))
    s = table(spark, sf, "supplier").select(F.lit("SUPPLIERS").alias("market"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("extra"))
    return OF.union_all(c, s).groupBy("market").agg(F.count("*").alias("n"), F.count("extra").alias("with_extra"))


LOG_SQL = """log AS (SELECT lpad(l_orderkey::VARCHAR, 14, '0') AS rcept_no, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS ok FROM lineitem GROUP BY 1)"""


def _log(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.lpad(F.col("l_orderkey").cast("string"), 14, "0").alias("rcept_no"), F.col("l_linenumber").alias("attempt"),
                     F.when(F.col("l_returnflag") == "A", "ok").otherwise("failed").alias("download_status"),
                     F.when(F.col("l_returnflag") != "A", F.lit("no data")).alias("error"))


@query("still_to_collect", f"""WITH {FILINGS_SQL}, {LOG_SQL} SELECT rcept_no, corp_code FROM filing WHERE rcept_no NOT IN (SELECT rcept_no FROM log WHERE ok = 1)""")
def still_to_collect(spark, sf):
    return OF.still_to_collect(filings(spark, sf), _log(spark, sf)).select("rcept_no", "corp_code")


@query("collection_manifest", f"""WITH {FILINGS_SQL}, {LOG_SQL} SELECT CASE WHEN ok = 1 THEN 'ok' WHEN ok = 0 THEN 'failed' ELSE 'pending' END AS download_status, count(*) AS n
 FROM filing LEFT JOIN log USING (rcept_no) GROUP BY 1""")
def collection_manifest(spark, sf):
    return OF.collection_manifest(filings(spark, sf), status_log(_log(spark, sf))).groupBy("download_status").agg(F.count("*").alias("n"))


@query("report_counts", f"""WITH {FILINGS_SQL} SELECT corp_code, count(*) FILTER (report_type = 'annual') AS annual, count(*) FILTER (report_type = 'semiannual') AS semiannual,
 count(*) FILTER (report_type = 'quarterly') AS quarterly FROM typed GROUP BY 1""")
def report_counts(spark, sf):
    return OF.report_counts(filings(spark, sf))


@query("missing_inputs", f"""WITH {REGISTRY_SQL}, t AS (SELECT lpad(doc_id::VARCHAR, 8, '0') AS corp_code, CASE WHEN quality = 0 THEN ' ' ELSE 'x' END AS body FROM labels)
 SELECT corp_code, CASE WHEN body IS NULL THEN 'cache_missing' ELSE 'text_empty' END AS reason FROM registry LEFT JOIN t USING (corp_code) WHERE body IS NULL OR trim(body) = ''""")
def missing_inputs(spark, sf):
    texts = table(spark, sf, "labels").select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("corp_code"),
                                              F.when(F.col("quality") == 0, " ").otherwise("x").alias("business_text"))
    return OR.missing_inputs(registry(spark, sf), texts)


@query("code_normalisation", """SELECT c_custkey, CASE WHEN d = '' THEN '' WHEN length(d) >= 6 THEN d ELSE lpad(d, 6, '0') END AS stock_code, CASE WHEN length(e) = 8 THEN e END AS day
 FROM (SELECT c_custkey, regexp_replace(CASE c_nationkey WHEN 3 THEN 'none' ELSE 'A-' || c_custkey END, '[^0-9]', '', 'g') AS d,
  regexp_replace(CASE c_nationkey WHEN 4 THEN '2024.1.2' ELSE '2024-01-' || (10 + c_nationkey % 20) END, '[^0-9]', '', 'g') AS e FROM customer)""")
def code_normalisation(spark, sf):
    c = table(spark, sf, "customer")
    raw = F.when(F.col("c_nationkey") == 3, "none").otherwise(F.concat(F.lit("A-"), F.col("c_custkey").cast("string")))
    date = F.when(F.col("c_nationkey") == 4, "2024.1.2").otherwise(F.concat(F.lit("2024-01-"), (F.col("c_nationkey") % 20 + 10).cast("string")))
    return c.select("c_custkey", ident.stock_code(raw).alias("stock_code"), ident.compact_date(date).alias("day"))


@query("latest_filing_per_form", f"""WITH {FILINGS_SQL} SELECT *, count(*) OVER () AS n FROM (SELECT coalesce(report_type, 'securities') AS form, strftime(rcept_dt, '%Y-%m-%d') AS rcept_dt, rcept_no
 FROM typed QUALIFY row_number() OVER (PARTITION BY coalesce(report_type, 'securities') ORDER BY typed.rcept_dt DESC, rcept_no DESC) = 1)""")
def latest_filing_per_form(spark, sf):
    """Newest archive of each form; a form may hold most rows, so it is one aggregate."""
    f = OF.classify(filings(spark, sf)).withColumn("form", F.coalesce("report_type", F.lit("securities")))
    newest = latest_per_group(f, ["form"], OF.FILING_ORDER, [])
    return newest.select("form", day("rcept_dt"), "rcept_no", F.lit(newest.count()).cast("bigint").alias("n"))


@query("company_search", f"""WITH {REGISTRY_SQL}, q AS (SELECT DISTINCT '#0000000' || lpad(s_suppkey::VARCHAR, 2, '0') AS query FROM supplier) SELECT query, corp_code FROM q JOIN registry ON contains(lower(corp_name), query)""")
def company_search(spark, sf):
    asked = table(spark, sf, "supplier").select(F.concat(F.lit("#0000000"), F.when(F.col("s_suppkey") < 100, F.lpad(F.col("s_suppkey").cast("string"), 2, "0"))
                                                         .otherwise(F.col("s_suppkey").cast("string"))).alias("query"))
    return OR.search(asked, registry(spark, sf))


@query("exact_company", f"""WITH {REGISTRY_SQL}, a AS (SELECT s_suppkey AS request_id, replace(s_name, 'Supplier', 'Customer') AS corp_name, CASE WHEN s_nationkey < 12 THEN lpad((s_suppkey + 3)::VARCHAR, 6, '0') END AS stock_code FROM supplier)
 SELECT request_id, coalesce(c.corp_code, n.corp_code) AS corp_code FROM a LEFT JOIN registry c ON c.stock_code = a.stock_code AND c.stock_code <> '' LEFT JOIN registry n ON n.corp_name = a.corp_name""")
def exact_company(spark, sf):
    s = table(spark, sf, "supplier")
    asked = s.select(F.col("s_suppkey").alias("request_id"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("corp_name"),
                     F.when(F.col("s_nationkey") < 12, F.lpad((F.col("s_suppkey") + 3).cast("string"), 6, "0")).alias("stock_code"))
    return OR.exact_company(asked, registry(spark, sf))


@query("report_codes", """SELECT o_orderkey, CASE quarter(o_orderdate) WHEN 1 THEN '11013' WHEN 2 THEN '11012' WHEN 3 THEN '11014' ELSE '11011' END AS report_code,
 CASE quarter(o_orderdate) WHEN 1 THEN 'Q1_YTD' WHEN 2 THEN 'H1_YTD' WHEN 3 THEN 'Q3_YTD' ELSE 'FY' END AS period_type FROM orders""")
def report_codes(spark, sf):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("quarterly_1", "semiannual", "quarterly_3", "annual")]), F.quarter("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", ident.statement_report_code(kind).alias("report_code"), ident.period_type(kind).alias("period_type"))
