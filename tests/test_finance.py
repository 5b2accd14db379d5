from pyspark.sql import functions as F

from filinglens.functions import amounts as A
from filinglens.functions import ident
from filinglens.operators import finance as OF

COLS = "company string, business_year int, dart_report_type string, fs_div string, line_no long, sj_div string, account_id string, account_nm string, account_detail string, thstrm_amount string, thstrm_add_amount string, frmtrm_amount string, frmtrm_add_amount string"


def st(spark, *rows):
    return spark.createDataFrame([("A", 2023, r[0], r[1], i, *r[2:]) for i, r in enumerate(rows)], COLS)


def test_amount_texts(spark):
    texts = ["1,234", "(1,234)", " -5 ", "-", "N/A", "null", "", None, "12.5", "abc", "(7"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(A.parse_amount(F.col("t")).cast("double")).collect()
    assert [r[0] for r in got] == [1234.0, -1234.0, -5.0, None, None, None, None, None, 12.5, None, None]


def test_interim_uses_cumulative_and_falls_back(spark):
    d = st(spark, ("quarterly_3", "CFS", "IS", "x", "매출액", "", "10", "30", "1", "3"), ("quarterly_3", "CFS", "IS", "x", "매출액", "", "10", "-", "1", ""),
           ("quarterly_3", "CFS", "BS", "x", "자산총계", "", "10", "30", "1", "3"), ("annual", "CFS", "IS", "x", "매출액", "", "10", "30", "1", "3"))
    got = OF.with_amounts(d).orderBy("line_no").select("amount", "amount_field", "previous_amount").collect()
    assert [(float(r[0]), r[1], float(r[2])) for r in got] == [(30, "thstrm_add_amount", 3), (10, "thstrm_amount", 1), (10, "thstrm_amount", 1), (10, "thstrm_amount", 1)]


def test_best_account_and_ties_in_statement_order(spark):
    d = st(spark, ("annual", "CFS", "IS", "x", "기타 매출액", "", "1", "", "", ""), ("annual", "CFS", "IS", "-", "매출액", "부문", "2", "", "", ""),
           ("annual", "CFS", "IS", "ifrs-full_Revenue", "수익", "", "3", "", "", ""), ("annual", "CFS", "CIS", "dart_Revenue", "매 출 액", "", "4", "", "", ""),
           ("annual", "CFS", "BS", "ifrs-full_Revenue", "매출액", "", "5", "", "", ""), ("annual", "CFS", "IS", "ifrs-full_Revenue", "매출액", "", "-", "", "", ""))
    scores = {r.line_no: r.score for r in OF.account_candidates(d).filter("account = 'revenue'").collect()}
    assert scores == {0: 20, 1: 47, 2: 150, 3: 150}
    best = OF.standard_accounts(d).filter("account = 'revenue'").collect()[0]
    assert float(best.value) == 3 and best.candidate_count == 4 and best.score == 150


def test_ratios_and_growth(spark):
    d = st(spark, ("annual", "CFS", "IS", "x", "매출액", "", "200", "", "(100)", ""), ("annual", "CFS", "IS", "x", "영업이익", "", "30", "", "", ""),
           ("annual", "CFS", "BS", "x", "부채총계", "", "5", "", "", ""), ("annual", "CFS", "BS", "x", "자본총계", "", "0", "", "", ""))
    p = OF.period_profiles(OF.standard_accounts(d)).collect()[0]
    assert (p.operating_margin, p.net_margin, p.debt_ratio, p.revenue_growth_yoy) == (15.0, None, None, 300.0)


def test_separate_statement_only_without_consolidated(spark):
    d = st(spark, ("annual", "OFS", "IS", "x", "매출액", "", "1", "", "", ""), ("annual", "CFS", "IS", "x", "매출액", "", "2", "", "", ""), ("semiannual", "OFS", "IS", "x", "매출액", "", "3", "", "", ""))
    assert sorted(r.thstrm_amount for r in OF.prefer_consolidated(d).collect()) == ["2", "3"]


def test_matcher_cases(spark):
    rows = [("T", k) for k in ("2022_FY", "2023_H1_YTD", "2023_Q3_YTD")] + [("same", k) for k in ("2022_FY", "2023_H1_YTD", "2023_Q3_YTD")] + \
           [("noq3", "2022_FY"), ("noq3", "2023_H1_YTD"), ("fy", "2022_FY"), ("none", "2021_FY")]
    d = spark.createDataFrame([(c, k, int(k[:4])) for c, k in rows], "company string, period_key string, business_year int")
    d = d.withColumns({"period_order": ident.period_order(F.col("period_key")), **{m: F.lit(1.0) for m in OF.METRICS}})
    pairs = spark.createDataFrame([("T", c) for c in ("same", "noq3", "fy", "none", "absent")], "target string, candidate string")
    got = {r.candidate: (r.comparison_period, r.n_common, r.comparable) for r in OF.match_pairs(pairs, d).collect()}
    assert got == {"same": ("2023_Q3_YTD", 3, True), "noq3": ("2023_H1_YTD", 2, True), "fy": ("2022_FY", 1, True), "none": (None, 0, False), "absent": (None, 0, False)}


def test_period_keys(spark):
    got = spark.createDataFrame([("2023_Q3_YTD",), ("2023_FY",), ("x_FY",), ("2023",), ("2023_ZZ",)], "k string").select(ident.period_order(F.col("k"))).collect()
    assert [r[0] for r in got] == [20233, 20230, None, None, None]


def test_common_periods_work_through_the_profiles_once(spark):
    from filinglens.operators import finance

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(c, f"{y}_FY", y * 10) for c, years in ((1, (2000, 2001)), (2, (2001, 2002)), (3, (1999,))) for y in years]
    plain = spark.createDataFrame(rows, "company long, period_key string, period_order int")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "target long, candidate long")
    out = finance.common_periods(pairs, plain.mapInArrow(counted, plain.schema))
    assert [(r.target, r.candidate, r.period_key) for r in out.collect()] == [(1, 2, "2001_FY")]
    assert read.value == len(rows)


def test_scores_are_not_part_of_fused_code(spark):
    """Fused with the amounts, the scores make one method that the JVM does not compile."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = st(spark, ("annual", "CFS", "IS", "x", "매출액", "", "1", "", "", ""))
        plan = OF.account_candidates(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    scored = [line for line in plan.splitlines() if "ifrs-full_Revenue" in line]
    assert scored and not any("*(" in line.split("Project")[0] for line in scored)
