"""Queries over document texts: cleaning, sentences, evidence, sections, contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from filinglens.functions import text as X
from filinglens.operators import audit as OA
from filinglens.operators import chunks as OC
from filinglens.operators import evidence as OE
from filinglens.operators import sections as OS
from filinglens.operators import versions as OV
from filinglens.plans import peer_search as PS
from filinglens.session import attach, spread
from workload.tables import AS_OF, FILINGS_SQL, LISTING_SQL, REGISTRY_SQL, filings, listing_items, registry, table
from filinglens.operators import registry as OR

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def quoted(terms):
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def any_sql(c, terms):
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


def hits_sql(c, terms):
    return "(" + " + ".join(f"contains({c}, '{t}')::INT" for t in terms) + ")"


STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')".format
SQUASH = "trim(regexp_replace({}, '\\s+', ' ', 'g'))".format

# terms that occur in the given prose
V = OE.Vocabulary(
    keywords={"business": ["tionin", "ment", "ción"], "product": ["eau", "thes", "ung"], "brand": ["ndle", "anst"], "market": ["blean", "tionn", "asos"]},
    noise=["idiot", "trash"], correction=["scum"], peer=["clown", "pathetic"], other="whan", industry=["attion", "ched", "euxp"],
    anchors=["lyre", "eux", "mente"], prefixes=["The ", "(a) "], self_weights=[("lyre", 4), ("eux", 3), ("mente", 1)])

NAMES_SQL = "names AS (SELECT source, arg_min(string_split(text, ' ')[1], doc_id) AS company_name FROM documents GROUP BY 1)"
SENT_SQL = f"""sent AS (SELECT * EXCLUDE (i), row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sentence_pos FROM (
  SELECT doc_id, source, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, source, list_transform(string_split(
    regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n+', chr(1), 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
    lambda x: {SQUASH('x')}) AS l FROM documents)) WHERE length(s) BETWEEN 30 AND 1200)"""
_N = "company_name"
_ANCHORED = f"({any_sql('s', V.anchors)} OR (company_name <> '' AND contains(s, company_name)))"
_CATS = " || ".join(f"CASE WHEN {any_sql('s', t)} THEN ['{c}'] ELSE [] END" for c, t in V.keywords.items())
JUDGED_SQL = f"""{NAMES_SQL}, {SENT_SQL}, tagged AS (SELECT *, ({_CATS})::VARCHAR[] AS categories, {_ANCHORED} AS anchored FROM sent JOIN names USING (source)),
 judged AS (SELECT *, CASE WHEN {any_sql('s', V.noise)} OR ({any_sql('s', V.correction)} AND length(s) < 400) THEN 'noise'
   WHEN {any_sql('s', V.peer)} OR (contains(s, '{V.other}') AND NOT anchored) THEN 'peer' WHEN len(categories) = 0 THEN 'no_category'
   WHEN NOT anchored AND {any_sql('s', V.industry)} THEN 'industry' WHEN NOT anchored THEN 'no_anchor' ELSE 'company' END AS disposition,
  contains(s, company_name)::INT * 4 + contains(s, 'The ' || company_name)::INT * 4 + contains(s, '(a) ' || company_name)::INT * 4
   + contains(s, 'lyre')::INT * 4 + contains(s, 'eux')::INT * 3 + contains(s, 'mente')::INT AS target_score FROM tagged),
 scored AS (SELECT *, len(categories) * 2 + {' + '.join(hits_sql('s', t) for t in V.keywords.values())} + target_score
   + {' + '.join(f"CASE WHEN list_contains(categories, '{a}') AND list_contains(categories, '{b}') THEN {v} ELSE 0 END" for a, b, v in V.pairs)} AS relevance_score FROM judged)"""


def documents(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), "doc_id")


def company_texts(spark, sf):
    d = documents(spark, sf)
    names = d.groupBy("source").agg(F.min_by(F.substring_index("text", " ", 1), "doc_id").alias("company_name"))
    return attach(d, names, ["source"]).select("source", "company_name", "doc_id", "text")


def plain_sentences(spark, sf):
    """Sentences for what does not ask for the company's name."""
    return OE.sentence_table(documents(spark, sf), ["source", "doc_id"])


def sentences(spark, sf):
    return OE.sentence_table(company_texts(spark, sf), ["source", "company_name", "doc_id"])


def judged(spark, sf):
    return OE.judged(sentences(spark, sf), V)


@query("text_normalisation", f"""WITH t AS (SELECT doc_id, text || chr(9) || ' ' || chr(160) || ' x ' || repeat(chr(10), 4) || ' y  z ' AS t FROM documents)
 SELECT doc_id, md5({SQUASH("replace(replace(t, chr(160), ' '), chr(9), ' ')")}) AS inline_text,
  md5({STRIP("regexp_replace(regexp_replace(replace(replace(t, chr(160), ' '), chr(9), ' '), ' {2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS chunk_text,
  md5({STRIP("regexp_replace(regexp_replace(t, '[ \\t' || chr(160) || ']*\\n[ \\t' || chr(160) || ']*', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS document_text,
  md5({STRIP("regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '\\n+', chr(10), 'g')")}) AS search_text FROM t""")
def text_normalisation(spark, sf):
    t = F.concat("text", F.lit("\t   x \n\n\n\n y  z "))
    return documents(spark, sf).select("doc_id", F.md5(X.clean_inline(t)).alias("inline_text"), F.md5(X.clean_chunk(t)).alias("chunk_text"),
                                       F.md5(X.clean_document(t)).alias("document_text"), F.md5(X.clean_search(t)).alias("search_text"))


FP_SQL = f"sha1(regexp_replace(lower({STRIP('text')}), '\\s+', ' ', 'g'))"


@query("fingerprints", f"SELECT doc_id, {FP_SQL} AS fingerprint, substr(sha1({SQUASH('text')}), 1, 16) AS short_id FROM documents")
def fingerprints(spark, sf):
    return documents(spark, sf).select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"), X.short_id(F.col("text")).alias("short_id"))


@query("first_occurrences", f"SELECT min(doc_id) AS doc_id, {FP_SQL} AS fingerprint FROM documents GROUP BY 2")
def first_occurrences(spark, sf):
    rows = documents(spark, sf).select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))
    return OC.first_occurrences(rows, ["doc_id"]).select("doc_id", "fingerprint")


@query("sentence_split", f"WITH {SENT_SQL} SELECT doc_id, sentence_pos::INT AS sentence_pos, length(s)::INT AS n, md5(s) AS h FROM sent")
def sentence_split(spark, sf):
    return plain_sentences(spark, sf).select("doc_id", "sentence_pos", F.length("sentence").alias("n"), F.md5("sentence").alias("h"))


@query("sentence_categories", f"WITH {JUDGED_SQL} SELECT doc_id, sentence_pos::INT AS sentence_pos, array_to_string(categories, '|') AS categories FROM judged WHERE len(categories) > 0")
def sentence_categories(spark, sf):
    return plain_sentences(spark, sf).select("doc_id", "sentence_pos", F.array_join(V.categories(F.col("sentence")), "|").alias("categories")).filter("categories <> ''")


@query("extraction_counts", f"""WITH {JUDGED_SQL} SELECT source, count(*) AS total_sentences, {', '.join(f"count(*) FILTER (disposition = '{d}') AS {d}" for d in OE.DISPOSITIONS)} FROM judged GROUP BY 1""")
def extraction_counts(spark, sf):
    return OE.extraction_counts(judged(spark, sf), ["source"])


@query("evidence_scores", f"WITH {JUDGED_SQL} SELECT doc_id, sentence_pos::INT AS sentence_pos, disposition, target_score::INT AS target_score, relevance_score::INT AS relevance_score FROM scored WHERE disposition IN ('company', 'industry')")
def evidence_scores(spark, sf):
    j = judged(spark, sf).filter(F.col("disposition").isin("company", "industry"))
    return j.select("doc_id", "sentence_pos", "disposition", V.target_score(F.col("sentence"), F.col("company_name")).alias("target_score"), "relevance_score")


@query("category_counts", f"WITH {JUDGED_SQL} SELECT source, category, count(*) AS n FROM (SELECT source, unnest(categories) AS category FROM judged WHERE disposition = 'company') GROUP BY ALL")
def category_counts(spark, sf):
    return OE.category_counts(judged(spark, sf).filter("disposition = 'company'"), ["source"])


def _pass(i, c, before):
    not_in = "".join(f" AND (doc_id, sentence_pos) NOT IN (SELECT doc_id, sentence_pos FROM t{b})" for b in before)
    return f"t{i} AS (SELECT * FROM own WHERE list_contains(categories, '{c}'){not_in} QUALIFY row_number() OVER (PARTITION BY source ORDER BY relevance_score DESC, doc_id, sentence_pos) <= 5)"


CORE_SQL = f"""{JUDGED_SQL}, own AS (SELECT * FROM scored WHERE disposition = 'company'),
 {', '.join(_pass(i, c, range(i)) for i, c in enumerate(V.keywords))},
 taken AS ({' UNION ALL '.join(f"SELECT *, {i} AS p FROM t{i}" for i in range(4))}),
 fill AS (SELECT o.*, 4 AS p FROM own o LEFT JOIN (SELECT source, count(*) AS k FROM taken GROUP BY 1) k USING (source)
   WHERE (doc_id, sentence_pos) NOT IN (SELECT doc_id, sentence_pos FROM taken)
   QUALIFY row_number() OVER (PARTITION BY source ORDER BY relevance_score DESC, doc_id, sentence_pos) <= 40 - coalesce(k, 0)),
 core AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY relevance_score DESC, p, doc_id, sentence_pos) AS core_rank FROM (SELECT * FROM taken UNION ALL SELECT * EXCLUDE (p), p FROM (SELECT * EXCLUDE (k) FROM fill WHERE true) ))"""
CORE_SQL = CORE_SQL.replace("SELECT * EXCLUDE (p), p FROM (SELECT * EXCLUDE (k) FROM fill WHERE true) ", "SELECT * EXCLUDE (k) FROM fillk").replace("fill AS (SELECT o.*, 4 AS p FROM", "fillk AS (SELECT o.*, k, 4 AS p FROM").replace("o.*, k, 4 AS p", "o.*, 4 AS p, k")


def core(spark, sf):
    own = judged(spark, sf).filter("disposition = 'company'")
    return OE.core_evidence(own, "source", ["doc_id", "sentence_pos"])


@query("core_evidence", f"WITH {CORE_SQL} SELECT source, core_rank, doc_id, sentence_pos::INT AS sentence_pos, relevance_score::INT AS relevance_score FROM core")
def core_evidence(spark, sf):
    return core(spark, sf).select("source", "core_rank", "doc_id", "sentence_pos", "relevance_score")


@query("profile_text", f"WITH {CORE_SQL} SELECT source, md5(string_agg(s, chr(10) ORDER BY core_rank)) AS profile_text, count(*) AS core_count FROM core GROUP BY 1")
def profile_text(spark, sf):
    return OE.profile_text(core(spark, sf), "source").withColumn("profile_text", F.md5("profile_text"))


@query("flattened_core", f"WITH {CORE_SQL} SELECT source, (core_rank - 1)::INT AS sentence_pos, md5(s) AS h, array_to_string(categories, '|') AS categories, relevance_score::INT AS relevance_score FROM core")
def flattened_core(spark, sf):
    """Core sentences nested into one record per company and flattened again."""
    records = OE.profile_records(core(spark, sf), "source")
    return OE.flatten_core(records, "source").select("source", "sentence_pos", F.md5("text").alias("h"), F.array_join("categories", "|").alias("categories"), "relevance_score")


@query("profile_records", f"""WITH {CORE_SQL}, cc AS (SELECT source, string_agg(category || '=' || n, ',' ORDER BY category) AS category_counts FROM (SELECT source, category, count(*) AS n FROM (SELECT source, unnest(categories) AS category FROM own) GROUP BY ALL) GROUP BY 1)
 SELECT source, count(*)::INT AS core_evidence_count, md5(string_agg(s, chr(10) ORDER BY core_rank)) AS profile_text, any_value(category_counts) AS category_counts FROM core JOIN cc USING (source) GROUP BY 1""")
def profile_records(spark, sf):
    own = judged(spark, sf).filter("disposition = 'company'")
    r = OE.profile_records(core(spark, sf), "source", category_counts_table=OE.category_counts(own, ["source"]))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("category_counts")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return r.select("source", "core_evidence_count", F.md5("profile_text").alias("profile_text"), flat.alias("category_counts"))


@query("near_duplicates_removed")
def near_duplicates_removed(spark, sf):
    """Evidence of all companies without near duplicates of earlier kept sentences."""
    return OE.company_evidence(judged(spark, sf), "source", ["doc_id", "sentence_pos"]).select("source", "doc_id", "sentence_pos", "relevance_score")


# The SQL engine counts bytes, so letters beyond ASCII become one character each.
_LETTERS = "translate(s, 'ÁÄÇÉÈÊËÍÑÓÖÜßàáâäçèéêëíîïñóôöùúûüœ', chr(1)||chr(2)||chr(3)||chr(4)||chr(5)||chr(6)||chr(7)||chr(8)||chr(11)||chr(12)||chr(14)||chr(15)||chr(16)||chr(17)||chr(18)||chr(19)||chr(20)||chr(21)||chr(22)||chr(23)||chr(24)||chr(25)||chr(26)||chr(27)||chr(28)||chr(29)||chr(30)||chr(31)||chr(127)||'^~`|')"
EDITS_SQL = f"""ev AS (SELECT *, {_LETTERS} AS z, row_number() OVER (PARTITION BY source, disposition ORDER BY doc_id, sentence_pos) AS rn FROM scored WHERE disposition IN ('company', 'industry')),
 sim AS (SELECT a.source, a.disposition, b.rn AS y, list(a.rn) AS xs FROM ev a JOIN ev b ON a.source = b.source AND a.disposition = b.disposition AND a.rn < b.rn
  AND least(length(a.s), length(b.s)) >= 0.93 * greatest(length(a.s), length(b.s)) - 1e-9 WHERE levenshtein(a.z, b.z) <= (1 - 0.93) * greatest(length(a.s), length(b.s)) + 1e-9 GROUP BY ALL),
 step AS (SELECT *, row_number() OVER (PARTITION BY source, disposition ORDER BY y) AS i FROM sim),
 walk AS (SELECT DISTINCT source, disposition, 0::BIGINT AS i, []::BIGINT[] AS gone FROM sim UNION ALL
  SELECT w.source, w.disposition, n.i, CASE WHEN len(list_filter(xs, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, y) ELSE gone END
  FROM walk w JOIN step n ON n.source = w.source AND n.disposition = w.disposition AND n.i = w.i + 1),
 dropped AS (SELECT source, disposition, unnest(arg_max(gone, i)) AS rn FROM walk GROUP BY 1, 2),
 kept AS (SELECT * FROM ev ANTI JOIN dropped USING (source, disposition, rn))"""


@query("near_duplicates_by_edits", f"""WITH RECURSIVE {JUDGED_SQL}, {EDITS_SQL}
 SELECT source, doc_id, sentence_pos::INT AS sentence_pos, relevance_score::INT AS relevance_score FROM kept WHERE disposition = 'company'""")
def near_duplicates_by_edits(spark, sf):
    """The same rule with the edit ratio, which SQL can express."""
    return OE.company_evidence(judged(spark, sf), "source", ["doc_id", "sentence_pos"], ratio="edit").select("source", "doc_id", "sentence_pos", "relevance_score")


@query("extraction_outcomes", f"""WITH RECURSIVE {JUDGED_SQL}, {EDITS_SQL},
 k AS (SELECT source, count(*) FILTER (disposition = 'company') AS company, count(*) FILTER (disposition = 'industry') AS industry FROM kept GROUP BY 1),
 c AS (SELECT source, count(*) AS total_sentences, {', '.join(f"count(*) FILTER (disposition = '{d}') AS {d}" for d in OE.DISPOSITIONS)} FROM judged GROUP BY 1)
 SELECT source, total_sentences, {', '.join(f"c.{d}" for d in OE.DISPOSITIONS if d not in ("company", "industry"))}, coalesce(k.company, 0) AS company, coalesce(k.industry, 0) AS industry,
  c.company - coalesce(k.company, 0) AS company_duplicate, c.industry - coalesce(k.industry, 0) AS industry_duplicate FROM c LEFT JOIN k USING (source)""")
def extraction_outcomes(spark, sf):
    """Where every sentence went, duplicates included, by the edit ratio."""
    return OE.extraction_outcomes(judged(spark, sf), "source", ["doc_id", "sentence_pos"], ratio="edit")


@query("business_profiles")
def business_profiles(spark, sf):
    out = PS.business_profiles(company_texts(spark, sf), "source", ["doc_id"], V)
    context = out["industry_context"].groupBy("source").agg(F.count("*").alias("industry_context_count"))
    evidence = out["evidence"].groupBy("source").agg(F.count("*").alias("company_evidence_count"))
    return (out["counts"].join(evidence, "source", "left").join(context, "source", "left").join(out["text"], "source", "left")
            .fillna(0, ["company_evidence_count", "industry_context_count", "core_count"]))


# --- sections -----------------------------------------------------------------------------------

STARTS, ENDS = ["The th", "Eau", "Que as", "In the"], ["Is the", "Des ", "Ciónla", "Er the"]


def _first_sql(terms, frm):
    return "least(" + ", ".join(f"nullif(strpos({frm}, '{t}'), 0)" for t in terms) + ")"


SLICE_SQL = f"""b AS (SELECT doc_id, source, text, {_first_sql(STARTS, 'text')} AS b FROM documents),
 cut AS (SELECT doc_id, source, coalesce({STRIP("regexp_replace(regexp_replace(substr(text, b, coalesce(e, 150000)), '[ \\t]+', ' ', 'g'), '\\n+', chr(10), 'g')")}, '') AS business_text
   FROM (SELECT *, {_first_sql(ENDS, 'substr(text, b + 1)')} AS e FROM b))"""


@query("section_slices", f"WITH {SLICE_SQL} SELECT doc_id, length(business_text)::INT AS n, md5(business_text) AS h FROM cut")
def section_slices(spark, sf):
    c = OS.section_slice(F.col("text"), STARTS, ENDS)
    return documents(spark, sf).select("doc_id", F.length(c).alias("n"), F.md5(c).alias("h"))


def occ_sql(name, terms, src, text="text", keys="doc_id, source"):
    """CTE with every non-overlapping 0-based position of every term."""
    return f"""{name} AS (SELECT {keys}, text, k, w, (coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x))), 0) + (i - 1) * length(w))::INT AS pos
  FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM (SELECT {keys}, {text} AS text, k, w, string_split({text}, w) AS parts
    FROM (SELECT *, unnest({quoted(terms)}) AS w, unnest(range({len(terms)})) AS k FROM {src}))))"""


@query("business_regions", f"""WITH {occ_sql('o', STARTS, 'documents')},
 e AS (SELECT *, {_first_sql(ENDS, 'substr(text, pos + length(w) + 1)')} AS e FROM o),
 r AS (SELECT doc_id, w AS heading, pos, {STRIP("substr(text, pos + 1, coalesce(e + length(w) - 1, 60000))")} AS t FROM e)
 SELECT doc_id, heading, pos, length(t)::INT AS n, md5(t) AS h FROM r WHERE length(t) >= 500""")
def business_regions(spark, sf):
    r = OS.regions(F.col("text"), STARTS, ENDS)
    return documents(spark, sf).select("doc_id", F.explode(r).alias("r")).select(
        "doc_id", "r.heading", "r.pos", F.length("r.text").alias("n"), F.md5("r.text").alias("h"))


# --- concept groups and candidate pool --------------------------------------------------------------

INDUSTRY = {"alpha": ["Idiot", "tri"], "beta": ["euxment", "ciónes"], "gamma": ["zzz"]}
BUSINESS = {"one": ["Therou", "tion"], "two": ["MENT", "ande"], "three": ["lichung"], "four": ["wherea", "thenat"]}


def _groups_sql(c, groups):
    def one(g, terms):
        found = " || ".join(f"CASE WHEN contains(lower({c}), '{t.lower()}') THEN ['{t}'] ELSE [] END" for t in sorted(terms))
        return f"CASE WHEN {any_sql(f'lower({c})', [t.lower() for t in terms])} THEN ['{g}=' || array_to_string({found}, '+')] ELSE [] END"
    return "(" + " || ".join(one(g, t) for g, t in groups.items()) + ")"


CONCEPT_SQL = "SELECT *, len(ig) * 3 + len(bg) AS prefilter_score FROM (SELECT *, {} AS ig, {} AS bg FROM {})"


def _concepts(source):
    return CONCEPT_SQL.format(_groups_sql("business_text", INDUSTRY), _groups_sql("business_text", BUSINESS), source)


def _flat(m):
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"))), ";")


@query("concept_groups", f"WITH c AS ({_concepts('(SELECT doc_id, text AS business_text FROM documents)')}) SELECT doc_id, array_to_string(ig, ';') AS industry, array_to_string(bg, ';') AS business, prefilter_score::INT AS prefilter_score FROM c")
def concept_groups(spark, sf):
    d = documents(spark, sf).withColumnRenamed("text", "business_text")
    return OS.with_concepts(d, "business_text", INDUSTRY, BUSINESS).select(
        "doc_id", _flat(F.col("industry_groups")).alias("industry"), _flat(F.col("business_groups")).alias("business"), "prefilter_score")


POOL_SQL = f"""{FILINGS_SQL}, {REGISTRY_SQL}, {LISTING_SQL}, {SLICE_SQL},
 uni AS (SELECT r.corp_code, corp_name FROM registry r JOIN listing USING (stock_code) WHERE r.stock_code <> '' AND corp_name <> 'Customer#000000010'),
 newest AS (SELECT * FROM typed WHERE report_type IS NOT NULL AND rcept_dt BETWEEN DATE '{AS_OF}' - 800 AND DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY corp_code ORDER BY rcept_dt DESC, rcept_no DESC) = 1),
 ftext AS (SELECT lpad(o_orderkey::VARCHAR, 14, '0') AS rcept_no, business_text FROM orders JOIN cut ON doc_id = o_orderkey % (SELECT count(*) FROM documents)),
 joined AS (SELECT uni.corp_code, corp_name, n.rcept_no, coalesce(business_text, '') AS business_text FROM uni LEFT JOIN newest n USING (corp_code) LEFT JOIN ftext USING (rcept_no)),
 conc AS ({_concepts('joined')}),
 pool AS (SELECT *, CASE WHEN rcept_no IS NULL THEN 'no_filing' WHEN trim(business_text) = '' THEN 'no_text' WHEN len(ig) < 1 THEN 'industry_failed' WHEN len(bg) < 2 THEN 'business_failed' ELSE 'passed' END AS outcome FROM conc)"""


def pool(spark, sf):
    """Candidate pool; the documents stand in for the filings' texts in turn, so every filing has one."""
    d = documents(spark, sf)
    keys = table(spark, sf, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 14, "0").alias("rcept_no"), (F.col("o_orderkey") % d.count()).alias("doc_id"))
    texts = keys.join(d, "doc_id").select("rcept_no", "text")
    return PS.candidate_pool(registry(spark, sf), OR.common_stock_listing(listing_items(spark, sf)), filings(spark, sf), texts, AS_OF,
                             "Customer#000000010", ["modify_date"], industry=INDUSTRY, business=BUSINESS, starts=STARTS, ends=ENDS)


@query("candidate_pool", f"WITH {POOL_SQL} SELECT corp_code, rcept_no, outcome, prefilter_score::INT AS prefilter_score FROM pool")
def candidate_pool(spark, sf):
    return pool(spark, sf).select("corp_code", "rcept_no", "outcome", "prefilter_score")


@query("candidate_funnel", f"WITH {POOL_SQL} SELECT count(*) AS checked, {', '.join(f'''count(*) FILTER (outcome = '{o}') AS {o}''' for o in OS.OUTCOMES)} FROM pool")
def candidate_funnel(spark, sf):
    return OS.funnel(pool(spark, sf))


@query("top_candidates", f"WITH {POOL_SQL} SELECT corp_code, prefilter_score::INT AS prefilter_score FROM pool WHERE outcome = 'passed' ORDER BY prefilter_score DESC, len(ig) DESC, len(bg) DESC, corp_code LIMIT 50")
def top_candidates(spark, sf):
    return OS.best_candidates(pool(spark, sf)).select("corp_code", "prefilter_score")


# --- keywords in context -------------------------------------------------------------------------------

WORDS = ["idiot", "trash", "token", "license", "Lyre", "ciónes", "euxment", "anden", "zzz"]


@query("keyword_presence", f"""SELECT doc_id, array_to_string(list_filter({quoted(WORDS)}, lambda w: contains(text, w)), '|') AS found, array_to_string(list_filter({quoted(WORDS)}, lambda w: NOT contains(text, w)), '|') AS missing,
 len(list_filter({quoted(WORDS)}, lambda w: contains(text, w)))::INT AS n_found, contains(text, 'idiot')::INT AS has_01, contains(text, 'anden')::INT AS has_08 FROM documents""")
def keyword_presence(spark, sf):
    p = OS.keyword_presence(documents(spark, sf), ["doc_id"], keywords=WORDS)
    return p.select("doc_id", F.array_join("found", "|").alias("found"), F.array_join("missing", "|").alias("missing"), "n_found",
                    F.col("has_01").cast("int").alias("has_01"), F.col("has_08").cast("int").alias("has_08"))


def _context_sql(before, after):
    return STRIP(f"substr(text, greatest(pos - {before}, 0) + 1, pos + length(w) + {after} - greatest(pos - {before}, 0))")


@query("keyword_contexts", f"""WITH {occ_sql('o', WORDS, 'documents')}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, w ORDER BY pos) AS hit FROM o)
 SELECT doc_id, w AS keyword, hit::INT AS hit, pos, md5({_context_sql(300, 500)}) AS h FROM r WHERE hit <= 3""")
def keyword_contexts(spark, sf):
    return OV.first_contexts(documents(spark, sf), ["doc_id"], WORDS).select("doc_id", "keyword", "hit", "pos", F.md5("snippet").alias("h"))


@query("keyword_dictionary", """WITH w AS (SELECT p_type AS category, 0 AS src, p_partkey AS pos, string_split(p_name, ' ')[2] AS keyword FROM part UNION ALL SELECT p_type, 1, p_partkey, string_split(p_name, ' ')[1] FROM part UNION ALL SELECT p_type, 1, p_partkey, string_split(p_name, ' ')[2] FROM part)
 SELECT category, keyword, src::INT AS src, pos FROM (SELECT category, keyword, min((src, pos)) AS m, m[1] AS src, m[2] AS pos FROM w GROUP BY ALL)""".replace("min((src, pos)) AS m, m[1] AS src, m[2] AS pos FROM w GROUP BY ALL", "src, pos FROM w QUALIFY row_number() OVER (PARTITION BY category, keyword ORDER BY src, pos) = 1"))
def keyword_dictionary(spark, sf):
    p = table(spark, sf, "part")
    word = lambda i: F.split("p_name", " ")[i]
    one = lambda i: p.select(F.col("p_type").alias("category"), F.col("p_partkey").alias("pos"), word(i).alias("keyword"))
    return OS.merged_dictionary(one(1), one(0).unionByName(one(1)))


# --- versions and figures ---------------------------------------------------------------------------------

VERSIONS_SQL = "ver AS (SELECT source AS company, doc_id, text, DATE '2000-01-01' + (doc_id % 1000)::INT AS rcept_dt, lpad(doc_id::VARCHAR, 14, '0') AS rcept_no FROM documents)"


def versions(spark, sf):
    return documents(spark, sf).select(F.col("source").alias("company"), F.expr("date_add(date'2000-01-01', cast(doc_id % 1000 as int))").alias("rcept_dt"),
                                       F.lpad(F.col("doc_id").cast("string"), 14, "0").alias("rcept_no"), "text")


SNIP_WORDS, NEED = ["idiot", "Trash", "euxment"], ["tion", "clown", "scum", "zz", "eau"]


@query("field_versions", f"""WITH {VERSIONS_SQL}, {occ_sql('o', SNIP_WORDS, 'ver', keys='company, rcept_dt, rcept_no')},
 s AS (SELECT company, rcept_dt, rcept_no, w, k, pos, {_context_sql(500, 1500)} AS snippet FROM o),
 ok AS (SELECT * FROM s WHERE {hits_sql('snippet', NEED)} >= 2 QUALIFY row_number() OVER (PARTITION BY rcept_no ORDER BY k, pos) = 1),
 f AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY company ORDER BY rcept_dt DESC, rcept_no DESC) = 1),
 n AS (SELECT v.company, count(*) FILTER (f.rcept_no IS NULL OR (v.rcept_dt, v.rcept_no) >= (f.rcept_dt, f.rcept_no)) AS c FROM ver v LEFT JOIN f USING (company) GROUP BY 1)
 SELECT n.company, CASE WHEN f.rcept_no IS NULL THEN 'not_found' ELSE 'found' END AS status, w AS matched_keyword, md5(snippet) AS snippet, rcept_no, c AS checked_versions FROM n LEFT JOIN f USING (company)""")
def field_versions(spark, sf):
    valid = lambda s: (OV.is_peer_selection(s, NEED), F.lit(None).cast("string"))
    r = OV.resolve_field(versions(spark, sf), "peer_selection", SNIP_WORDS, valid)
    return r.select("company", "status", "matched_keyword", F.md5("snippet").alias("snippet"), "rcept_no", "checked_versions")


@query("checked_version_rows", f"""WITH {VERSIONS_SQL}, f AS (SELECT company, rcept_dt, rcept_no FROM ver WHERE contains(text, 'idiot') QUALIFY row_number() OVER (PARTITION BY company ORDER BY rcept_dt DESC, rcept_no DESC) = 1)
 SELECT v.company, v.rcept_no FROM ver v LEFT JOIN f USING (company) WHERE f.rcept_no IS NULL OR (v.rcept_dt, v.rcept_no) >= (f.rcept_dt, f.rcept_no)""")
def checked_version_rows(spark, sf):
    v = versions(spark, sf)
    r = OV.resolve_field(v, "mention", ["idiot"], lambda s: (s.contains("idiot"), F.lit(None).cast("string")))
    return OV.checked_versions(v, r).select("company", "rcept_no")


FIGURES = [r"(?s)\+1 \(([0-9]{3})\) ([0-9]{3})", r"(?s)([0-9]{2,3})\.([0-9]{2,3})\."]
OLD, NEW = "the", "and"


def _spans(i, p):
    return f"""SELECT company, rcept_dt, rcept_no, text, {i} AS pattern, m[j] AS match, (coalesce(list_sum(list_transform(parts[1:j], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:j-1], lambda x: length(x))), 0))::INT AS pos
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS j FROM (SELECT *, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS parts FROM ver))"""


FIG_SQL = f"""{VERSIONS_SQL}, spans AS ({' UNION ALL '.join(_spans(i, p) for i, p in enumerate(FIGURES))}),
 led AS (SELECT *, substr(text, greatest(pos - 200, 0) + 1, pos - greatest(pos - 200, 0)) AS lead FROM spans),
 ok AS (SELECT * FROM led WHERE NOT (contains(lead, '{OLD}') AND NOT contains(lead, '{NEW}')) QUALIFY row_number() OVER (PARTITION BY rcept_no ORDER BY pattern, pos) = 1),
 fig AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY company ORDER BY rcept_dt DESC, rcept_no DESC) = 1)"""


@query("figure_extraction", f"""WITH {FIG_SQL} SELECT company, rcept_no, pattern::INT AS pattern, match, CASE pattern WHEN 0 THEN regexp_extract(match, '{FIGURES[0]}', 1) ELSE regexp_extract(match, '{FIGURES[1]}', 1) END AS group1,
  CASE pattern WHEN 0 THEN regexp_extract(match, '{FIGURES[0]}', 2) ELSE regexp_extract(match, '{FIGURES[1]}', 2) END AS group2,
  md5(substr(text, greatest(pos - 300, 0) + 1, pos + length(match) + 500 - greatest(pos - 300, 0))) AS evidence FROM fig""")
def figure_extraction(spark, sf):
    f = OV.extract_figure(versions(spark, sf), FIGURES, OLD, NEW)
    return f.select("company", "rcept_no", "pattern", "match", "group1", "group2", F.md5("evidence").alias("evidence"))


@query("valuation_table", f"""WITH {VERSIONS_SQL}, p AS (SELECT company, rcept_no, regexp_extract(text, '(?s)\\+1 \\(([0-9]{{3}})\\)', 1) AS v FROM ver WHERE regexp_matches(text, '(?s)\\+1 \\(([0-9]{{3}})\\)') QUALIFY row_number() OVER (PARTITION BY company ORDER BY rcept_dt DESC, rcept_no DESC) = 1),
 d AS (SELECT company, rcept_no, regexp_extract(text, '(?s)([0-9]{{2,3}})\\.([0-9]{{2,3}})\\.', 1) AS a, regexp_extract(text, '(?s)([0-9]{{2,3}})\\.([0-9]{{2,3}})\\.', 2) AS b FROM ver WHERE regexp_matches(text, '(?s)([0-9]{{2,3}})\\.([0-9]{{2,3}})\\.') QUALIFY row_number() OVER (PARTITION BY company ORDER BY rcept_dt DESC, rcept_no DESC) = 1)
 SELECT c.company, p.v::BIGINT AS valuation_price, d.a::DOUBLE AS lower_price_discount, d.b::DOUBLE AS upper_price_discount, d.a::BIGINT AS band_low, d.rcept_no AS band_source FROM (SELECT DISTINCT company FROM ver) c LEFT JOIN p USING (company) LEFT JOIN d USING (company)""")
def valuation_table(spark, sf):
    patterns = {"valuation_price": [r"(?s)\+1 \(([0-9]{3})\)"], "discount_rate": [FIGURES[1]], "offer_price_band": [FIGURES[1]]}
    return OV.valuation_table(versions(spark, sf), patterns).select("company", "valuation_price", "lower_price_discount", "upper_price_discount", "band_low", "band_source")


# --- recall audit ---------------------------------------------------------------------------------------------

AUDIT = {"f1": ["idiot", "Token"], "f2": ["license", "clown", "eauchan"], "f3": ["zzz"]}


def _audit_raw(f, terms):
    low = [t.lower() for t in terms]
    return f"{occ_sql('o_' + f, low, 'documents', 'lower(text)')}, r_{f} AS (SELECT source, count(DISTINCT (doc_id, pos // 200)) AS n FROM o_{f} GROUP BY 1), c_{f} AS (SELECT source, count(*) AS n FROM sent WHERE {any_sql('lower(s)', low)} GROUP BY 1)"


@query("recall_audit", f"""WITH {SENT_SQL}, {', '.join(_audit_raw(f, t) for f, t in AUDIT.items())},
 u AS ({' UNION ALL '.join(f"SELECT s.source, '{f}' AS field, coalesce(r.n, 0) AS raw_hits, coalesce(c.n, 0) AS chunk_hits FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN r_{f} r USING (source) LEFT JOIN c_{f} c USING (source)" for f in AUDIT)})
 SELECT source, field, raw_hits::BIGINT AS raw_hits, chunk_hits::BIGINT AS chunk_hits, CASE WHEN raw_hits = 0 AND chunk_hits = 0 THEN 'absent_everywhere' WHEN chunk_hits = 0 THEN 'lost_before_chunking' WHEN raw_hits > 0 THEN 'retrieval_or_query' ELSE 'source_position_unclear' END AS diagnosis FROM u""")
def recall_audit(spark, sf):
    chunks = plain_sentences(spark, sf).withColumnRenamed("sentence", "content")
    return OA.recall_audit(documents(spark, sf), chunks, "source", AUDIT)


@query("audit_snippets", f"""WITH {occ_sql('o', [t.lower() for t in AUDIT['f2']], '(SELECT doc_id, source, text AS body, lower(text) AS text FROM documents)', 'text', 'doc_id, source, body')},
 b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, pos // 200 ORDER BY k, pos) = 1),
 s AS (SELECT *, {SQUASH("substr(body, greatest(pos - 350, 0) + 1, pos + length(w) + 350 - greatest(pos - 350, 0))")} AS snippet FROM b),
 m AS (SELECT *, {hits_sql('lower(snippet)', [t.lower() for t in AUDIT['f2']])} AS match_count FROM s)
 SELECT source, doc_id, pos, match_count::INT AS match_count, md5(snippet) AS h, row_number() OVER (PARTITION BY source ORDER BY match_count DESC, doc_id, k, pos) AS rank FROM m QUALIFY rank <= 5""")
def audit_snippets(spark, sf):
    h = OA.document_hits(documents(spark, sf), "source", "f2", AUDIT["f2"], ["doc_id"])
    return h.select("source", "doc_id", "pos", "match_count", F.md5("snippet").alias("h"), "rank")


@query("audit_chunks", f"""WITH {SENT_SQL}, m AS (SELECT source, doc_id || '_' || sentence_pos AS chunk_id, {hits_sql('lower(s)', [t.lower() for t in AUDIT['f2']])} AS match_count FROM sent)
 SELECT source, chunk_id, match_count::INT AS match_count, row_number() OVER (PARTITION BY source ORDER BY match_count DESC, chunk_id) AS rank FROM m WHERE match_count > 0 QUALIFY rank <= 5""")
def audit_chunks(spark, sf):
    c = plain_sentences(spark, sf).select("source", F.concat_ws("_", "doc_id", "sentence_pos").alias("chunk_id"), F.col("sentence").alias("content"))
    return OA.chunk_hits(c, "source", "f2", AUDIT["f2"]).select("source", "chunk_id", "match_count", "rank")
