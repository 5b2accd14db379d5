import datetime as dt

import pytest
from pyspark.sql import functions as F

from filinglens.functions import ident
from filinglens.operators import filings as OF
from filinglens.operators import registry as OR
from filinglens.streaming.ingest import ingest, status_log

D = dt.date


def rows(spark, data):
    return spark.createDataFrame(data, "corp_code string, rcept_no string, rcept_dt date, report_nm string")


def test_periodic_list_merges_pages_and_reads_the_period(spark):
    a = ("01190568", "20240321000964", D(2024, 3, 21), "[기재정정]사업보고서 (2023.12)")
    b = ("01190568", "20240321000965", D(2024, 3, 21), "반기보고서 (2023.06)")
    got = OF.periodic_list(rows(spark, [a, b, a]), "2023-01-01", "2024-12-31").orderBy("rcept_no").collect()
    assert [(r.report_type, r.report_period) for r in got] == [("annual", "2023.12"), ("semiannual", "2023.06")]
    with pytest.raises(ValueError):
        OF.periodic_list(rows(spark, [a]), "2024-01-01", "2023-01-01")


def test_cutoff_day_counts_and_event_day_does_not(spark):
    f = rows(spark, [("1", "a", D(2024, 2, 13), "사업보고서"), ("1", "b", D(2024, 2, 14), "사업보고서"), ("1", "c", D(2024, 2, 12), "사업보고서")])
    assert {r.rcept_no for r in OF.as_of(f, "2024-02-13").collect()} == {"a", "c"}
    assert {r.rcept_no for r in OF.before(f, "2024-02-13").collect()} == {"c"}
    assert {r.rcept_no for r in OF.within_lookback(f, "2024-02-13", 1).collect()} == {"a", "c"}


def test_company_without_filing_in_the_lookback_stays(spark):
    f = rows(spark, [("1", "a", D(2020, 1, 1), "사업보고서"), ("2", "b", D(2024, 1, 1), "분기보고서 (2023.09)"), ("2", "c", D(2024, 1, 1), "분기보고서 (2023.09)")])
    got = {r.corp_code: r.rcept_no for r in OF.latest_periodic_as_of(f.select("corp_code").distinct(), f, "2024-02-13").collect()}
    assert got == {"1": None, "2": "c"}


def test_resolution_exact_before_inside_and_ambiguous(spark):
    reg = spark.createDataFrame([("01190568", "에이피알", "APR", "278470"), ("00000001", "에이피알파트너", "", ""), ("00000002", "Zeta", "Zeta Co", "")],
                                "corp_code string, corp_name string, corp_eng_name string, stock_code string")
    q = spark.createDataFrame([(x,) for x in ("apr", "278470", " 에이피알 ", "에이피", "피알파", "ze", "none", "")], "query string")
    got = {r.query: (r.status, r.corp_code, r.n_companies) for r in OR.resolve(q, reg).collect()}
    assert got["apr"] == got["278470"] == got[" 에이피알 "] == ("resolved", "01190568", 1)
    assert got["에이피"] == ("ambiguous", None, 2)
    assert got["피알파"] == ("resolved", "00000001", 1)
    assert got["ze"] == ("resolved", "00000002", 1)
    assert got["none"][0] == got[""][0] == "none"


def test_listing_keeps_common_stock_and_fills_codes(spark):
    items = spark.createDataFrame([("5930", "주권", "보통주", "A"), ("5935", "주권", "구형우선주", "B"), ("A-77", "", "", "C"), ("x", "주권", "보통주", "D"), ("88", "외국주권", "보통주", "E")],
                                  "ISU_SRT_CD string, SECUGRP_NM string, KIND_STKCERT_TP_NM string, ISU_ABBRV string").withColumns(
        {"MKT_TP_NM": F.lit(None).cast("string"), "LIST_DD": F.lit(""), "LIST_SHRS": F.lit("")})
    got = {(r.stock_code, r.market) for r in OR.common_stock_listing(items, "KOSPI").collect()}
    assert got == {("005930", "KOSPI"), ("000077", "KOSPI")}


def test_partial_failure_then_retry_takes_only_the_failed(spark):
    f = rows(spark, [("1", "x", D(2024, 1, 1), "사업보고서"), ("1", "y", D(2024, 1, 1), "사업보고서")])
    log = spark.createDataFrame([("x", 1, "ok", None), ("y", 1, "failed", "014")], "rcept_no string, attempt int, download_status string, error string")
    assert [r.rcept_no for r in OF.still_to_collect(f, status_log(log)).collect()] == ["y"]
    again = log.union(spark.createDataFrame([("y", 2, "ok", None), ("x", 2, "failed", "010")], log.schema))
    assert OF.still_to_collect(f, status_log(again)).count() == 0


def test_slices_cover_the_range_once(spark):
    r = spark.createDataFrame([("2025-01-15", "2025-12-31")], "start string, end string")
    got = [(str(x.slice_start), str(x.slice_end)) for x in OF.date_slices(r).orderBy("slice").collect()]
    assert got == [("2025-01-15", "2025-04-14"), ("2025-04-15", "2025-07-14"), ("2025-07-15", "2025-10-14"), ("2025-10-15", "2025-12-31")]


def test_first_event_and_recent_issuer(spark):
    name = "증권신고서(지분증권)"
    f = rows(spark, [("1", "a", D(2020, 1, 1), name), ("1", "b", D(2024, 1, 5), "[기재정정]" + name), ("2", "c", D(2019, 1, 1), name), ("1", "d", D(2019, 5, 1), "사업보고서 (2018.12)")])
    got = OF.recent_issuers(f, "2024-01-01", "2024-03-01").collect()
    assert [(r.corp_code, r.first_rcept_no, r.recent_rcept_no) for r in got] == [("1", "a", "b")]
    before = OF.reports_before_first_event(f).collect()
    assert [(r.corp_code, r.annual_count, r.quarterly_count) for r in before] == [("1", 1, 0)]


def test_identifiers(spark):
    bad = OF.quarantine(rows(spark, [("123", "1" * 14, D(2024, 1, 1), ""), ("1" * 8, "1", D(2024, 1, 1), ""), ("1" * 8, "1" * 14, D(2024, 1, 1), ""), (None, None, None, "")]))
    assert bad[0].count() == 1 and sorted(r.problem for r in bad[1].collect()) == ["corp_code", "corp_code", "rcept_no"]


def test_business_year_and_quarter(spark):
    d = spark.createDataFrame([("annual", "사업보고서 (2022.12)", "", "20230329"), ("annual", "사업보고서", "x", "20230329"), ("quarterly", "분기보고서", "a_2023.09.zip", None),
                               ("semiannual", "2021 반기", "", None), ("quarterly", "분기보고서", "", None)], "k string, n string, f string, d string")
    got = d.select(ident.business_year(F.col("k"), F.col("n"), F.col("f"), F.col("d")).alias("y"), ident.statement_report_kind(F.col("k"), F.col("n"), F.col("f")).alias("q")).collect()
    assert [tuple(r) for r in got] == [(2022, "annual"), (2022, "annual"), (2023, "quarterly_3"), (2021, "semiannual"), (None, None)]


def test_stream_stores_each_filing_once_across_runs(spark, tmp_path):
    f = rows(spark, [("1", f"{i:03d}", D(2024, 1, 1), "사업보고서") for i in range(50)])
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    f.filter("rcept_no < '030'").write.mode("append").parquet(src)
    ingest(spark, src, out, state, f.schema).awaitTermination()
    f.filter("rcept_no >= '010'").write.mode("append").parquet(src)
    ingest(spark, src, out, state, f.schema).awaitTermination()
    got = [r.rcept_no for r in spark.read.parquet(out).select("rcept_no").collect()]
    assert len(got) == 50 and len(set(got)) == 50
