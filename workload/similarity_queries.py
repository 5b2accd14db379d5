"""Queries over vectors, keyword graphs and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from filinglens.functions import vectors as V
from filinglens.functions import text as X
from filinglens.operators import evidence as OE
from filinglens.operators import graph as OG
from filinglens.operators import retrieval as OR
from filinglens.operators import signals as OS
from filinglens.operators.ordering import number_rows, top_per_group
from filinglens.plans import peer_search as PS
from filinglens.session import attach, materialise, scratch_path, spread
from filinglens.sources import readers, sinks, vector_store
from workload.tables import table
from workload.text_queries import SENT_SQL, core, documents, plain_sentences

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def vectors(spark, sf):
    return table(spark, sf, "embeddings")


CENTROID_SQL = """pos AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM embeddings),
 mean AS (SELECT label, list(m ORDER BY p) AS m FROM (SELECT label, p, avg(v) AS m FROM pos GROUP BY ALL) GROUP BY 1),
 cent AS (SELECT label, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS c FROM mean)"""


def centroids(spark, sf):
    return OR.mean_vectors(vectors(spark, sf), "label")


def encoder_sql(source, name, dimension=256):
    """CTE ``name`` (id, v): the stand-in encoder over ``source`` (id, text) as dense unit vectors."""
    return f"""{name}_c AS (SELECT id, list_transform(range(1, length(t) + 1), lambda i: unicode(substr(t, i, 1))::UBIGINT) AS c FROM (SELECT id, ' ' || lower(coalesce(text, '')) || ' ' AS t FROM {source})),
 {name}_h AS (SELECT id, unnest(list_transform(range(1, len(c) - 1), lambda i: ((xor(xor(c[i] * 73856093::UBIGINT, c[i + 1] * 19349663::UBIGINT), c[i + 2] * 83492791::UBIGINT) & 4294967295::UBIGINT) * 2654435761::UBIGINT & 4294967295::UBIGINT) >> 7)) AS h FROM {name}_c),
 {name}_b AS (SELECT id, ((h >> 1) % {dimension})::BIGINT AS b, sum(CASE WHEN h & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {name}_h GROUP BY ALL),
 {name}_n AS (SELECT id, greatest(sqrt(sum(v * v)), 1e-12) AS n FROM {name}_b GROUP BY 1),
 {name} AS (SELECT id, list(coalesce(v / n, 0)::FLOAT::DOUBLE ORDER BY b) AS v FROM (SELECT id, unnest(range({dimension})) AS b FROM {source}) LEFT JOIN {name}_b USING (id, b) LEFT JOIN {name}_n USING (id) GROUP BY 1)"""


@query("unit_vectors", """SELECT vec_id, round(list_inner_product(e, e), 6) AS squared, round(list_sum(e) / sqrt(list_inner_product(e, e)), 6) AS total FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)""")
def unit_vectors(spark, sf):
    u = V.unit(F.col("embedding"))
    return vectors(spark, sf).select("vec_id", F.round(V.dot(F.col("embedding"), F.col("embedding")), 6).alias("squared"), F.round(F.aggregate(u, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("pooled_vectors", f"WITH {CENTROID_SQL} SELECT label, (generate_subscripts(c, 1) - 1)::INT AS pos, round(unnest(c), 6) AS value FROM cent")
def pooled_vectors(spark, sf):
    return centroids(spark, sf).select("label", F.posexplode("vector").alias("pos", "v")).select("label", "pos", F.round("v", 6).alias("value"))


_DOT = "round(list_inner_product(list_transform(embedding, lambda x: x::DOUBLE), c), 6)"


@query("vector_topk", f"WITH {CENTROID_SQL} SELECT cent.label AS query_id, vec_id, {_DOT} AS score, row_number() OVER (PARTITION BY cent.label ORDER BY {_DOT} DESC, vec_id) AS rank FROM embeddings, cent QUALIFY rank <= 5")
def vector_topk(spark, sf):
    q = centroids(spark, sf).select(F.col("label").alias("query_id"), F.col("vector").alias("embedding"))
    return OR.top_k(q, vectors(spark, sf), 5, "vec_id")


@query("vector_topk_filtered", f"WITH {CENTROID_SQL} SELECT cent.label AS query_id, vec_id, {_DOT} AS score, row_number() OVER (PARTITION BY cent.label ORDER BY {_DOT} DESC, vec_id) AS rank FROM embeddings e, cent WHERE e.label = (cent.label + 1) % 10 QUALIFY rank <= 5")
def vector_topk_filtered(spark, sf):
    q = centroids(spark, sf).select(F.col("label").alias("query_id"), ((F.col("label") + 1) % 10).alias("category"), F.col("vector").alias("embedding"))
    return OR.top_k(q, vectors(spark, sf), 5, "vec_id", {"label": "category"})


@query("company_similarity", f"WITH {CENTROID_SQL}, s AS (SELECT t.label AS target, c.label AS company, round(list_inner_product(t.c, c.c), 6) AS similarity FROM cent t, cent c WHERE t.label = (SELECT min(label) FROM embeddings) AND c.label <> t.label) SELECT *, row_number() OVER (ORDER BY similarity DESC, company) AS rank FROM s")
def company_similarity(spark, sf):
    v = centroids(spark, sf).withColumnRenamed("label", "company")
    lead = v.agg(F.min("company")).first()[0]
    targets = v.select("company", F.lit(lead).alias("target")).filter(F.col("company") != lead)
    ranked = OR.rank_against_target(v, targets, "company", "target")
    return OS.ranked(ranked, "similarity", "rank", "company")


FIELDS_SQL = """fields AS (SELECT label AS field, unnest([label, label, (label + 3) % 10, (label + 3) % 10]) AS query, unnest([label, (label + 1) % 10, label, (label + 1) % 10]) AS category FROM (SELECT DISTINCT label FROM embeddings))"""


@query("field_evidence", f"""WITH {CENTROID_SQL}, {FIELDS_SQL}, asked AS (SELECT DISTINCT query, category FROM fields),
 hits AS (SELECT query, category, vec_id, {_DOT} AS score FROM asked JOIN cent ON cent.label = query JOIN embeddings e ON e.label = category QUALIFY row_number() OVER (PARTITION BY query, category ORDER BY {_DOT} DESC, vec_id) <= 3),
 m AS (SELECT field, vec_id, count(DISTINCT h.query) AS query_hits, count(DISTINCT h.category) AS category_hits, max(score) AS score FROM fields JOIN hits h USING (query, category) GROUP BY ALL),
 f AS (SELECT *, round(score + 0.03::DOUBLE * (query_hits - 1) + 0.01::DOUBLE * (category_hits - 1), 6) AS fused_score FROM m)
 SELECT field, vec_id, query_hits, category_hits, fused_score, 'E' || row_number() OVER (PARTITION BY field ORDER BY fused_score DESC, vec_id) AS evidence_id, row_number() OVER (PARTITION BY field ORDER BY fused_score DESC, vec_id) AS r FROM f QUALIFY r <= 8""")
def field_evidence(spark, sf):
    f = vectors(spark, sf).select("label").distinct().select(F.col("label").alias("field"), F.array("label", (F.col("label") + 3) % 10).alias("queries"),
                                                             F.array("label", (F.col("label") + 1) % 10).alias("retrieval_categories"))
    asked = OR.expand_fields(f)
    pairs = asked.select("query", "category").distinct().withColumn("query_id", F.concat_ws("|", "query", "category"))
    q = pairs.join(centroids(spark, sf).select(F.col("label").alias("query"), F.col("vector").alias("embedding")), "query")
    hits = OR.top_k(q, vectors(spark, sf), 3, "vec_id", {"label": "category"}).join(pairs, "query_id")
    fused = OR.fuse(asked.join(hits, ["query", "category"]), key="vec_id")
    return fused.select("field", "vec_id", "query_hits", "category_hits", "fused_score", "evidence_id", F.col("evidence_rank").alias("r"))


CORE_VEC_SQL = "corev AS (SELECT label AS company, vec_id AS pos, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


def sentence_vectors(spark, sf):
    """All vectors, their labels as companies."""
    return vectors(spark, sf).select(F.col("label").alias("company"), F.col("vec_id").alias("pos"), "embedding")


def label_pairs(spark, sf):
    lead = vectors(spark, sf).agg(F.min("label")).first()[0]
    labels = vectors(spark, sf).select("label").distinct().filter(F.col("label") != lead)
    return materialise(labels.select(F.lit(lead).alias("target"), F.col("label").alias("candidate")))


GREEDY_SQL = """ord AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY sim DESC, t, c) AS rn FROM simp),
 greedy AS (SELECT DISTINCT g, 0::BIGINT AS rn, []::BIGINT[] AS ut, []::BIGINT[] AS uc, false AS hit FROM ord UNION ALL
   SELECT y.g, y.rn, CASE WHEN list_contains(x.ut, y.t) OR list_contains(x.uc, y.c) THEN x.ut ELSE list_append(x.ut, y.t) END,
     CASE WHEN list_contains(x.ut, y.t) OR list_contains(x.uc, y.c) THEN x.uc ELSE list_append(x.uc, y.c) END, NOT (list_contains(x.ut, y.t) OR list_contains(x.uc, y.c))
   FROM greedy x JOIN ord y ON y.g = x.g AND y.rn = x.rn + 1 {stop}),
 matched AS (SELECT ord.* FROM greedy JOIN ord USING (g, rn) WHERE hit)"""

PAIR_SIM_SQL = f"""{CORE_VEC_SQL}, simp AS (SELECT c.company AS g, t.pos AS t, c.pos AS c, round(list_inner_product(t.e, c.e) / sqrt(list_inner_product(t.e, t.e) * list_inner_product(c.e, c.e)), 6) AS sim
   FROM corev t, corev c WHERE t.company = (SELECT min(label) FROM embeddings) AND c.company <> t.company)"""


@query("sentence_pairs", f"""WITH RECURSIVE {PAIR_SIM_SQL}, {GREEDY_SQL.format(stop='WHERE len(x.ut) < 5')},
 one AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rn) AS pr FROM matched QUALIFY pr <= 5)
 SELECT g AS candidate, pr AS pair_rank, t AS target_pos, c AS candidate_pos, sim AS similarity FROM one""")
def sentence_pairs(spark, sf):
    out = OR.best_sentence_pairs(label_pairs(spark, sf), sentence_vectors(spark, sf), 5, fill=False)
    return out.select("candidate", "pair_rank", "target_pos", "candidate_pos", "similarity")


@query("sentence_pairs_filled", f"""WITH RECURSIVE {PAIR_SIM_SQL}, {GREEDY_SQL.format(stop='')},
 u AS (SELECT g, t, c, sim, rn, 0 AS phase FROM matched UNION ALL SELECT g, t, c, sim, rn, 1 FROM ord WHERE (g, rn) NOT IN (SELECT g, rn FROM matched))
 SELECT g AS candidate, row_number() OVER (PARTITION BY g ORDER BY phase, rn) AS pair_rank, t AS target_pos, c AS candidate_pos, sim AS similarity, 1 - phase AS one_to_one FROM u QUALIFY pair_rank <= 45""")
def sentence_pairs_filled(spark, sf):
    out = OR.best_sentence_pairs(label_pairs(spark, sf), sentence_vectors(spark, sf), 45)
    return out.select("candidate", "pair_rank", "target_pos", "candidate_pos", "similarity", F.col("one_to_one").cast("int").alias("one_to_one"))


# --- keyword graphs -----------------------------------------------------------------------------------

def keywords(spark, sf):
    """Four longest words of each sentence as its keywords, scored by length."""
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("sentence"), r"[^\p{L}]+", " "), " "), lambda w: F.length(w) >= 2))
    best = F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 4)
    raw = plain_sentences(spark, sf).select(F.col("source").alias("company"), (F.col("doc_id") * 100000 + F.col("sentence_pos")).alias("sentence_pos"), F.explode(best).alias("b"))
    return OG.clean_keywords(raw.select("company", "sentence_pos", F.col("b.w").alias("phrase"), F.round(-F.col("b.n") / 20, 4).alias("score")))


KEYWORDS_SQL = f"""{SENT_SQL}, kw AS (SELECT source AS company, doc_id * 100000 + sentence_pos AS sentence_pos, b.w AS keyword, round(-b.n / 20, 4) AS score FROM (SELECT *, unnest(list_sort(list_transform(list_distinct(list_filter(string_split(regexp_replace(lower(s), '[^\\p{{L}}]+', ' ', 'g'), ' '), lambda w: length(w) >= 2)), lambda w: {{'n': -length(w), 'w': w}}))[1:4]) AS b FROM sent) WHERE -b.n / 20 >= 0.35)"""
NODES_SQL = f"""{KEYWORDS_SQL}, cnt AS (SELECT company, keyword, count(*) AS frequency, round(avg(score), 6) AS mean_score FROM kw GROUP BY ALL),
 nodes AS (SELECT *, round(frequency * mean_score, 6) AS importance, row_number() OVER (PARTITION BY company ORDER BY round(frequency * mean_score, 6) DESC, frequency DESC, mean_score DESC, keyword) AS node_pos FROM cnt QUALIFY node_pos <= 60),
 sel AS (SELECT kw.company, sentence_pos, keyword FROM kw JOIN nodes USING (company, keyword)),
 edges AS (SELECT x.company, x.keyword AS a, y.keyword AS b, count(*) AS weight FROM sel x JOIN sel y ON x.company = y.company AND x.sentence_pos = y.sentence_pos AND x.keyword < y.keyword GROUP BY ALL)"""


def graph(spark, sf):
    k = materialise(keywords(spark, sf))
    nodes = materialise(OG.keyword_nodes(k))
    return nodes, materialise(OG.cooccurrence_edges(k, nodes))


@query("keyword_cleaning", """WITH w AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(left_part), '[^\\p{L}\\p{N}_\\s\\-]', ' ', 'g'), '\\s+', ' ', 'g')) AS bare, length(left_part) / 40 AS score FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS left_part FROM documents)),
 k AS (SELECT doc_id, array_to_string(list_filter(string_split(bare, ' '), lambda t: t <> '' AND t NOT IN ('the', 'of', 'la') AND NOT regexp_matches(t, '^\\d+(\\.\\d+)?$')), ' ') AS k, score FROM w),
 n AS (SELECT doc_id, CASE WHEN length(k) >= 2 THEN k ELSE '' END AS keyword, round(score, 4) AS score FROM k)
 SELECT doc_id, md5(keyword) AS keyword, (keyword = '' OR score < 0.35 OR contains(keyword, 'idiot') OR contains(keyword, 'trash') OR regexp_matches(keyword, '^[\\d\\s.%]+$') OR length(replace(keyword, ' ', '')) < 2)::INT AS noisy FROM n""")
def keyword_cleaning(spark, sf):
    parts = documents(spark, sf).select("doc_id", F.explode(F.split("text", r"\. ")).alias("part"))
    k = X.normalise_keyword(F.col("part"), ["the", "of", "la"])
    rows = parts.select("doc_id", k.alias("k"), F.round(F.length("part") / 40, 4).alias("score"))
    return rows.select("doc_id", F.md5("k").alias("keyword"), X.is_noisy_keyword(F.col("k"), F.col("score"), phrases=["idiot", "trash"]).cast("int").alias("noisy"))


@query("keyword_nodes", f"WITH {NODES_SQL} SELECT company, node_pos, keyword, frequency, mean_score, importance FROM nodes")
def keyword_nodes(spark, sf):
    return OG.keyword_nodes(keywords(spark, sf))


@query("keyword_edges", f"WITH {NODES_SQL} SELECT * FROM edges")
def keyword_edges(spark, sf):
    return graph(spark, sf)[1]


DEGREE_SQL = """ends AS (SELECT company, a AS keyword, b AS other, weight FROM edges UNION ALL SELECT company, b, a, weight FROM edges),
 deg AS (SELECT n.company, n.keyword, coalesce(sum(weight), 0)::BIGINT AS degree, count(weight) AS neighbours, any_value(k) AS nn FROM nodes n JOIN (SELECT company, count(*) AS k FROM nodes GROUP BY 1) z ON z.company = n.company LEFT JOIN ends e ON e.company = n.company AND e.keyword = n.keyword GROUP BY n.company, n.keyword)"""


@query("weighted_degree", f"WITH {NODES_SQL}, {DEGREE_SQL} SELECT company, keyword, degree, neighbours, round(CASE WHEN nn > 1 THEN degree / (nn - 1) ELSE 0 END, 6) AS centrality FROM deg")
def weighted_degree(spark, sf):
    return OG.weighted_degree(*graph(spark, sf)).withColumn("centrality", F.round("centrality", 6))


@query("graph_summary", f"""WITH {NODES_SQL}, {DEGREE_SQL}, mx AS (SELECT company, max(weight) AS mw, count(*) AS m FROM edges GROUP BY 1), sc AS (SELECT company, keyword AS x, other AS y, weight / mw AS w FROM ends JOIN mx USING (company)),
 tri AS (SELECT p.company, p.x AS keyword, sum(pow(p.w * q.w * r.w, 1.0 / 3)) / 2 AS g FROM sc p JOIN sc q ON q.company = p.company AND q.x = p.x AND q.y <> p.y JOIN sc r ON r.company = p.company AND r.x = p.y AND r.y = q.y GROUP BY ALL),
 cl AS (SELECT company, count(*) AS n, avg(CASE WHEN neighbours >= 2 THEN 2 * coalesce(g, 0) / (neighbours * (neighbours - 1)) ELSE 0 END) AS c FROM deg LEFT JOIN tri USING (company, keyword) GROUP BY 1)
 SELECT company, n AS node_count, coalesce(m, 0) AS edge_count, round(2.0 * coalesce(m, 0) / (n * (n - 1)), 6) AS density, round(c, 6) AS average_clustering FROM cl LEFT JOIN mx USING (company)""")
def graph_summary(spark, sf):
    return OG.graph_summary(*graph(spark, sf))


@query("central_keywords", f"WITH {NODES_SQL}, {DEGREE_SQL} SELECT company, row_number() OVER (PARTITION BY company ORDER BY degree DESC, keyword) AS central_rank, keyword, degree FROM deg QUALIFY central_rank <= 10")
def central_keywords(spark, sf):
    return OG.central_keywords(*graph(spark, sf))


NOISE = ["ther", "eau"]


@query("centrality_graph", f"""WITH {NODES_SQL}, cn AS (SELECT * FROM nodes WHERE NOT (contains(keyword, 'ther') OR contains(keyword, 'eau'))), ce AS (SELECT e.* FROM edges e JOIN cn x ON x.company = e.company AND x.keyword = a JOIN cn y ON y.company = e.company AND y.keyword = b)
 SELECT company, keyword FROM cn WHERE (company, keyword) IN (SELECT company, a FROM ce UNION SELECT company, b FROM ce)""")
def centrality_graph(spark, sf):
    return OG.without_noise(*graph(spark, sf), NOISE)[0].select("company", "keyword")


# --- graph comparison: word vectors are letter profiles ---------------------------------------------------

LETTERS = "abcdefghijklmnopqrstuvwxyzéèêçüäößóíñ"


def vector_nodes(nodes):
    counts = F.array(*[(F.length("keyword") - F.length(F.replace("keyword", F.lit(c), F.lit("")))).cast("double") for c in LETTERS])
    return nodes.withColumn("vector", V.unit(counts))


def source_pairs(spark, sf):
    d = table(spark, sf, "documents").select("source")
    lead = d.agg(F.min("source")).first()[0]
    return materialise(d.distinct().filter(F.col("source") != lead).select(F.lit(lead).alias("target"), F.col("source").alias("candidate")))


NODE_FLOOR, EDGE_FLOOR = 0.9, 0.8
_PROFILE = "[" + ", ".join(f"(length(keyword) - length(replace(keyword, '{c}', '')))::DOUBLE" for c in LETTERS) + "]"
NODE_SIM_SQL = f"""{NODES_SQL}, nv AS (SELECT *, list_transform(p, lambda x: x / sqrt(list_inner_product(p, p))) AS v FROM (SELECT company, keyword, node_pos, {_PROFILE} AS p FROM nodes)),
 nsim AS (SELECT c.company AS g, t.node_pos AS t, c.node_pos AS c, t.keyword AS tk, c.keyword AS ck, round(list_inner_product(t.v, c.v), 6) AS sim FROM nv t, nv c WHERE t.company = (SELECT min(source) FROM documents) AND c.company <> t.company)"""
NODE_MATCH_SQL = f"{NODE_SIM_SQL}, simp AS (SELECT * FROM nsim WHERE sim >= {NODE_FLOOR}), {GREEDY_SQL.format(stop='')}"
EDGE_MATCH_SQL = f"""{NODE_SIM_SQL}, ei AS (SELECT e.company, e.a, e.b, weight::DOUBLE AS w, x.node_pos AS ia, y.node_pos AS ib, row_number() OVER (PARTITION BY e.company ORDER BY x.node_pos, y.node_pos) AS ei FROM edges e JOIN nodes x ON x.company = e.company AND x.keyword = a JOIN nodes y ON y.company = e.company AND y.keyword = b),
 simp AS (SELECT c.company AS g, t.ei AS t, c.ei AS c, t.a AS ta, t.b AS tb, c.a AS ca, c.b AS cb, t.w AS tw, c.w AS cw, greatest(least(s1.sim, s2.sim), least(s3.sim, s4.sim)) AS sim
   FROM ei t JOIN ei c ON t.company = (SELECT min(source) FROM documents) AND c.company <> t.company
   JOIN nsim s1 ON s1.g = c.company AND s1.t = t.ia AND s1.c = c.ia JOIN nsim s2 ON s2.g = c.company AND s2.t = t.ib AND s2.c = c.ib
   JOIN nsim s3 ON s3.g = c.company AND s3.t = t.ia AND s3.c = c.ib JOIN nsim s4 ON s4.g = c.company AND s4.t = t.ib AND s4.c = c.ia
   WHERE greatest(least(s1.sim, s2.sim), least(s3.sim, s4.sim)) >= {EDGE_FLOOR}), {GREEDY_SQL.format(stop='')}"""


def aligned(spark, sf):
    nodes, edges = graph(spark, sf)
    return OG.align(source_pairs(spark, sf), vector_nodes(nodes), edges, NODE_FLOOR, EDGE_FLOOR)


@query("node_alignment", f"WITH RECURSIVE {NODE_MATCH_SQL} SELECT g AS candidate, tk AS target_keyword, ck AS candidate_keyword, sim AS similarity FROM matched")
def node_alignment(spark, sf):
    return aligned(spark, sf).select("candidate", F.explode("node_matches").alias("m")).select(
        "candidate", F.col("m.target").alias("target_keyword"), F.col("m.candidate").alias("candidate_keyword"), F.col("m.similarity").alias("similarity"))


@query("node_alignment_rounds", f"WITH RECURSIVE {NODE_MATCH_SQL} SELECT g AS candidate, t, c, sim AS similarity FROM matched")
def node_alignment_rounds(spark, sf):
    """The same matching found by shuffles alone."""
    n = vector_nodes(graph(spark, sf)[0]).select("company", F.col("node_pos").alias("p"), "vector")
    pairs = (source_pairs(spark, sf).join(n.select(F.col("company").alias("target"), F.col("p").alias("t"), F.col("vector").alias("x")), "target")
             .join(n.select(F.col("company").alias("candidate"), F.col("p").alias("c"), F.col("vector").alias("y")), "candidate"))
    near = pairs.select("candidate", "t", "c", F.round(V.dot(F.col("x"), F.col("y")), 6).alias("similarity")).filter(F.col("similarity") >= NODE_FLOOR)
    return OG.mutual_best(near, ["candidate"])


@query("edge_alignment", f"WITH RECURSIVE {EDGE_MATCH_SQL} SELECT g AS candidate, ta, tb, ca, cb, sim AS similarity, round(least(tw, cw) * sim, 6) AS mass FROM matched")
def edge_alignment(spark, sf):
    return aligned(spark, sf).select("candidate", F.explode("edge_matches").alias("m")).select(
        "candidate", "m.ta", "m.tb", "m.ca", "m.cb", "m.similarity", F.round("m.mass", 6).alias("mass"))


@query("keyword_jaccard", f"""WITH RECURSIVE {NODE_MATCH_SQL}, n AS (SELECT company, count(*) AS n FROM nodes GROUP BY 1), m AS (SELECT g, count(*) AS m FROM matched GROUP BY 1)
 SELECT n.company AS candidate, coalesce(m, 0) AS node_match_count, round(coalesce(m, 0) / (n.n + t.n - coalesce(m, 0)), 6) AS keyword_score FROM n JOIN n t ON t.company = (SELECT min(source) FROM documents) AND n.company <> t.company LEFT JOIN m ON g = n.company""")
def keyword_jaccard(spark, sf):
    return OG.jaccard_scores(aligned(spark, sf)).select("candidate", "node_match_count", "keyword_score")


@query("edge_jaccard", f"""WITH RECURSIVE {EDGE_MATCH_SQL}, w AS (SELECT company, sum(weight)::DOUBLE AS w FROM edges GROUP BY 1), m AS (SELECT g, count(*) AS m, sum(least(tw, cw) * sim) AS mass FROM matched GROUP BY 1)
 SELECT w.company AS candidate, coalesce(m, 0) AS edge_match_count, round(coalesce(mass, 0) / (w.w + t.w - coalesce(mass, 0)), 6) AS edge_score FROM w JOIN w t ON t.company = (SELECT min(source) FROM documents) AND w.company <> t.company LEFT JOIN m ON g = w.company""")
def edge_jaccard(spark, sf):
    return OG.jaccard_scores(aligned(spark, sf)).select("candidate", "edge_match_count", "edge_score")


RELABEL_SQL = f"""{NODE_MATCH_SQL}, rn AS (SELECT DISTINCT n.company AS candidate, coalesce(tk, '__candidate__::' || keyword) AS keyword FROM nodes n LEFT JOIN matched ON g = n.company AND ck = keyword WHERE n.company <> (SELECT min(source) FROM documents)),
 rx AS (SELECT e.company AS candidate, coalesce(x.tk, '__candidate__::' || a) AS x, coalesce(y.tk, '__candidate__::' || b) AS y, weight FROM edges e LEFT JOIN matched x ON x.g = e.company AND x.ck = a LEFT JOIN matched y ON y.g = e.company AND y.ck = b WHERE e.company <> (SELECT min(source) FROM documents)),
 re AS (SELECT candidate, least(x, y) AS a, greatest(x, y) AS b, sum(weight)::BIGINT AS weight FROM rx WHERE x <> y GROUP BY ALL)"""


@query("relabelled_edges", f"WITH RECURSIVE {RELABEL_SQL} SELECT * FROM re")
def relabelled_edges(spark, sf):
    nodes, edges = graph(spark, sf)
    a = materialise(OG.align(source_pairs(spark, sf), vector_nodes(nodes), edges, NODE_FLOOR, EDGE_FLOOR))
    return OG.relabelled(source_pairs(spark, sf), nodes, edges, OG.node_mapping(a))[1].drop("target")


def _cosine_sql(noise):
    keep = "NOT (contains(keyword, 'ther') OR contains(keyword, 'eau'))" if noise else "true"
    bare = keep.replace("keyword", "replace(keyword, '__candidate__::', '')")
    iso = "WHERE (company, keyword) IN (SELECT company, a FROM {e} UNION SELECT company, b FROM {e})" if noise else ""
    return f"""{RELABEL_SQL}, tn0 AS (SELECT company, keyword FROM nodes WHERE company = (SELECT min(source) FROM documents) AND {keep}), te AS (SELECT e.company, a, b, weight FROM edges e JOIN tn0 x ON x.company = e.company AND x.keyword = a JOIN tn0 y ON y.company = e.company AND y.keyword = b),
 tn AS (SELECT * FROM tn0 {iso.format(e='te')}), cn0 AS (SELECT candidate AS company, keyword FROM rn WHERE {bare}), ce AS (SELECT candidate AS company, a, b, weight FROM re JOIN cn0 x ON x.company = candidate AND x.keyword = a JOIN cn0 y ON y.company = candidate AND y.keyword = b),
 cn AS (SELECT * FROM cn0 {iso.format(e='ce')}),
 td AS (SELECT keyword, coalesce(sum(weight), 0) / (SELECT count(*) - 1 FROM tn) AS x FROM tn LEFT JOIN (SELECT a AS keyword, weight FROM te UNION ALL SELECT b, weight FROM te) USING (keyword) GROUP BY 1),
 cd AS (SELECT cn.company, cn.keyword, coalesce(sum(weight), 0) / any_value(k - 1) AS y FROM cn JOIN (SELECT company, count(*) AS k FROM cn GROUP BY 1) USING (company) LEFT JOIN (SELECT company, a AS keyword, weight FROM ce UNION ALL SELECT company, b, weight FROM ce) z ON z.company = cn.company AND z.keyword = cn.keyword GROUP BY ALL),
 cc AS (SELECT company, keyword FROM cd UNION SELECT company, keyword FROM (SELECT DISTINCT candidate AS company FROM rn), td),
 s AS (SELECT company, sum(coalesce(x, 0) * coalesce(y, 0)) AS d, sum(coalesce(x, 0) * coalesce(x, 0)) AS p, sum(coalesce(y, 0) * coalesce(y, 0)) AS q FROM cc LEFT JOIN td USING (keyword) LEFT JOIN cd USING (company, keyword) GROUP BY 1)
 SELECT company AS candidate, round(CASE WHEN p > 0 AND q > 0 THEN d / sqrt(p * q) ELSE 0 END, 6) AS centrality_score FROM s"""


def _cosine(spark, sf, noise):
    nodes, edges = graph(spark, sf)
    pairs = source_pairs(spark, sf)
    a = materialise(OG.align(pairs, vector_nodes(nodes), edges, NODE_FLOOR, EDGE_FLOOR))
    rn, rel = OG.relabelled(pairs, nodes, edges, OG.node_mapping(a))
    tn, te = OG.without_noise(nodes, edges, NOISE) if noise else (nodes, edges)
    return OG.centrality_cosine(OG.weighted_degree(tn, te), OG.pair_degrees(rn, rel, NOISE, noise), pairs).select("candidate", "centrality_score")


@query("centrality_cosine", f"WITH RECURSIVE {_cosine_sql(True)}")
def centrality_cosine(spark, sf):
    return _cosine(spark, sf, True)


@query("centrality_cosine_unfiltered", f"WITH RECURSIVE {_cosine_sql(False)}")
def centrality_cosine_unfiltered(spark, sf):
    """The earlier variant that keeps formal terms in the centrality graph."""
    return _cosine(spark, sf, False)


@query("network_similarity", f"""SELECT min(source) AS target, candidate, node_match_count, edge_match_count, keyword_score, edge_score, centrality_score FROM documents,
 ({SQL["keyword_jaccard"]}) k JOIN ({SQL["edge_jaccard"]}) e USING (candidate) JOIN ({SQL["centrality_cosine"]}) c USING (candidate) GROUP BY ALL""")
def network_similarity(spark, sf):
    """All scores of every pair in one job."""
    nodes, edges = graph(spark, sf)
    return OG.network_similarity(source_pairs(spark, sf), vector_nodes(nodes), edges, NOISE, node_floor=NODE_FLOOR, edge_floor=EDGE_FLOOR)


# --- signals --------------------------------------------------------------------------------------------------

def signal_inputs(spark, sf):
    c = table(spark, sf, "customer")
    vec = c.select(F.col("c_custkey").alias("stock_code"), F.col("c_name").alias("company_name"), F.col("c_acctbal").alias("vector_score"))
    o = table(spark, sf, "orders")
    net = o.groupBy(F.col("o_custkey").alias("stock_code")).agg(
        F.count("*").cast("double").alias("keyword_score"), F.max("o_totalprice").alias("edge_score"), F.min("o_totalprice").alias("centrality_score"),
        F.count_if(F.col("o_orderstatus") == "F").alias("node_match_count"), F.count_if(F.col("o_orderstatus") == "P").alias("edge_match_count"))
    return vec, net


_RANKS = "[vector_rank, keyword_rank, edge_rank, centrality_rank]"
SIGNALS_SQL = f"""sig0 AS (SELECT c_custkey AS stock_code, c_name AS company_name, c_acctbal AS vector_score, k AS keyword_score, e AS edge_score, c AS centrality_score, nm AS node_match_count, em AS edge_match_count, count(*) OVER () AS total FROM customer JOIN
   (SELECT o_custkey, count(*)::DOUBLE AS k, max(o_totalprice) AS e, min(o_totalprice) AS c, count(*) FILTER (o_orderstatus = 'F') AS nm, count(*) FILTER (o_orderstatus = 'P') AS em FROM orders GROUP BY 1) ON o_custkey = c_custkey),
 sig1 AS (SELECT *, {', '.join(f"row_number() OVER (ORDER BY {s}_score DESC, stock_code) AS {s}_rank" for s in OS.SIGNALS)} FROM sig0),
 sig2 AS (SELECT *, {', '.join(f"(total - {s}_rank) / (total - 1) AS {s}_percentile" for s in OS.SIGNALS)} FROM sig1),
 sig AS (SELECT *, (vector_percentile + keyword_percentile + edge_percentile + centrality_percentile) / 4 AS mean_percentile, list_max({_RANKS}) - list_min({_RANKS}) AS rank_spread,
   len(list_filter({_RANKS}, lambda r: r <= 5)) AS top5_agreement, len(list_filter({_RANKS}, lambda r: r <= 10)) AS top10_agreement, (keyword_rank + edge_rank + centrality_rank) / 3 AS network_rank_mean FROM sig2)"""


def signals(spark, sf):
    return OS.compare(*signal_inputs(spark, sf))


@query("signal_comparison", f"""WITH {SIGNALS_SQL} SELECT stock_code, company_name, vector_rank, keyword_rank, edge_rank, centrality_rank, round(vector_percentile, 6) AS vector_percentile, round(mean_percentile, 6) AS mean_percentile, rank_spread, top5_agreement::INT AS top5_agreement,
 top10_agreement::INT AS top10_agreement, round(network_rank_mean, 4) AS network_rank_mean, round(vector_rank - network_rank_mean, 4) AS vector_network_gap, node_match_count FROM sig""")
def signal_comparison(spark, sf):
    s = signals(spark, sf)
    r = lambda c, n: F.round(c, n).alias(c)
    return s.select("stock_code", "company_name", "vector_rank", "keyword_rank", "edge_rank", "centrality_rank", r("vector_percentile", 6), r("mean_percentile", 6), "rank_spread",
                    "top5_agreement", "top10_agreement", r("network_rank_mean", 4), r("vector_network_gap", 4), "node_match_count")


@query("signal_consensus", f"WITH {SIGNALS_SQL} SELECT stock_code, top10_agreement::INT AS top10_agreement, round(mean_percentile, 6) AS mean_percentile FROM sig ORDER BY sig.top10_agreement DESC, top5_agreement DESC, sig.mean_percentile DESC, stock_code LIMIT 30")
def signal_consensus(spark, sf):
    return OS.consensus(signals(spark, sf), 30).select("stock_code", "top10_agreement", F.round("mean_percentile", 6).alias("mean_percentile"))


@query("signal_disagreement", f"WITH {SIGNALS_SQL} SELECT stock_code, rank_spread FROM sig ORDER BY rank_spread DESC, stock_code LIMIT 15")
def signal_disagreement(spark, sf):
    return OS.disagreement(signals(spark, sf)).select("stock_code", "rank_spread")


@query("late_fusion", f"WITH {SIGNALS_SQL} SELECT stock_code, round(vector_percentile * 0.4::DOUBLE + keyword_percentile * 0.3::DOUBLE + edge_percentile * 0.2::DOUBLE + centrality_percentile * 0.1::DOUBLE, 6) AS fused_score FROM sig ORDER BY fused_score DESC, stock_code LIMIT 5")
def late_fusion(spark, sf):
    return OS.late_fusion(signals(spark, sf), {"vector": 0.4, "keyword": 0.3, "edge": 0.2, "centrality": 0.1}).select("stock_code", "fused_score")


@query("signal_csv", f"WITH {SIGNALS_SQL} SELECT stock_code::VARCHAR AS stock_code, vector_rank::VARCHAR AS vector_rank, rank_spread::VARCHAR AS rank_spread, edge_match_count::VARCHAR AS edge_match_count FROM sig")
def signal_csv(spark, sf):
    """Signals written as CSV in the fixed column order and read back as text."""
    path = scratch_path(spark, "signals")
    sinks.write_csv(signals(spark, sf), path, sinks.SIGNAL_CSV_COLUMNS)
    return readers.listing(spark, path, sinks.SIGNAL_CSV_COLUMNS).select("stock_code", "vector_rank", "rank_spread", "edge_match_count")


@query("global_numbering", "SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity, l_shipdate) AS n, count(*) OVER (PARTITION BY l_returnflag) AS total FROM lineitem")
def global_numbering(spark, sf):
    """Rows numbered inside three groups that hold a third of the table each."""
    li = table(spark, sf, "lineitem")
    by = ["l_extendedprice", "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate"]
    return number_rows(li, [F.asc(c) for c in by], "n", ["l_returnflag"], total="total").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "n", "total")


@query("signal_drill_down")
def signal_drill_down(spark, sf):
    """Disagreeing companies with their best node, edge and sentence matches."""
    nodes, edges = graph(spark, sf)
    pairs = source_pairs(spark, sf)
    a = materialise(OG.align(pairs, vector_nodes(nodes), edges, NODE_FLOOR, EDGE_FLOOR))
    scores = OG.jaccard_scores(a).select(F.col("candidate").alias("stock_code"), F.col("candidate").alias("company_name"), F.col("keyword_score").alias("vector_score"))
    net = OG.jaccard_scores(a).select(F.col("candidate").alias("stock_code"), "keyword_score", "edge_score", F.col("edge_score").alias("centrality_score"), "node_match_count", "edge_match_count")
    compared = materialise(OS.compare(scores, net))
    embedded = OR.embed(core(spark, sf).select(F.col("source").alias("company"), F.col("core_rank").alias("pos"), "sentence"), "sentence", OR.hashing_encoder())
    best = OR.best_sentence_pairs(pairs, embedded.select("company", "pos", "embedding"), 5)
    out = OS.drill_down(compared, a, best, OS.disagreement(compared, 10))
    return out.select("stock_code", "rank_spread", F.size("top_nodes").alias("n_nodes"), F.size("top_edges").alias("n_edges"), F.size("top_sentences").alias("n_sentences"))


@query("peer_signals")
def peer_signals(spark, sf):
    """From core sentences to signals: embedding, keyphrases, graphs, comparison."""
    c = materialise(core(spark, sf).select(F.col("source").alias("company"), "core_rank", "sentence"))
    names = c.select("company").distinct().withColumn("company_name", F.col("company"))
    return PS.similarity_signals(c, source_pairs(spark, sf), names, OR.hashing_encoder())


@query("keyphrases")
def keyphrases(spark, sf):
    """Diverse one- and two-word phrases of every conversation sentence."""
    c = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    s = OE.sentence_table(c, ["conv_id", "turn"])
    return OR.keyphrases(s, ["conv_id", "turn", "sentence_pos"], "sentence", OR.hashing_encoder())


@query("embedding_job", f"""WITH asked AS (SELECT item_id AS id, text FROM benchmark WHERE trim(text) <> ''), {encoder_sql('asked', 'e')}
 SELECT id AS item_id, (generate_subscripts(v, 1) - 1)::INT AS pos, round(unnest(v), 6) AS value FROM e""")
def embedding_job(spark, sf):
    ok, _ = OR.checked_queries(table(spark, sf, "benchmark"), "text")
    e = OR.embed(ok, "text", OR.hashing_encoder())
    return e.select("item_id", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


def _edited(c):
    return F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("edited "), c)).otherwise(c)


@query("embedding_store", f"""WITH now AS (SELECT doc_id AS id, 'm' AS model, CASE WHEN doc_id % 7 = 0 THEN 'edited ' || text ELSE text END AS text FROM documents WHERE lang IS DISTINCT FROM 'fr'
   UNION ALL SELECT -1 - doc_id, 'other', text FROM documents WHERE lang = 'de'), {encoder_sql('now', 'e')}
 SELECT CASE WHEN id < 0 THEN -1 - id ELSE id END AS doc_id, CASE WHEN id < 0 THEN 'other' ELSE 'm' END AS model,
  round(list_sum(list_transform(range(1, 257), lambda i: v[i] * i)), 4) AS weighted FROM e""")
def embedding_store(spark, sf):
    """A store of all documents' vectors under one model and some under another, brought up to date after edits and deletions."""
    path, load = scratch_path(spark, "vectors"), OR.hashing_encoder()
    d = spread(table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")
    vector_store.sync(d, "doc_id", "text", path, "m", load)
    vector_store.sync(d.filter("lang = 'de'"), "doc_id", "text", path, "other", load)
    vector_store.sync(d.filter("NOT lang <=> 'fr'").withColumn("text", _edited(F.col("text"))), "doc_id", "text", path, "m", load)
    weighted = F.aggregate(F.transform("embedding", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return vector_store.read(spark, path, d.schema["doc_id"]).select(F.col("key").alias("doc_id"), "model", F.round(weighted, 4).alias("weighted"))


@query("text_retrieval", f"""WITH {SENT_SQL}, corpus AS (SELECT doc_id * 100000 + sentence_pos AS id, s AS text FROM sent), {encoder_sql('corpus', 'c')},
 asked AS (SELECT item_id AS id, text FROM benchmark), {encoder_sql('asked', 'q')}
 SELECT q.id AS query_id, c.id AS chunk_id, round(list_inner_product(q.v, c.v), 6) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_inner_product(q.v, c.v), 6) DESC, c.id) AS rank FROM q, c QUALIFY rank <= 5""")
def text_retrieval(spark, sf):
    """Every benchmark text as a query against every document sentence."""
    q = OR.embed(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "text", OR.hashing_encoder())
    s = plain_sentences(spark, sf).select((F.col("doc_id") * 100000 + F.col("sentence_pos")).alias("chunk_id"), "sentence")
    return OR.top_k(q, OR.embed(s, "sentence", OR.hashing_encoder()).select("chunk_id", "embedding"), 5, "chunk_id")
