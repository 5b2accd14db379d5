"""Peer search: universe → section → pool → evidence → signals → peers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglens import lexicon as L
from filinglens.operators import evidence as E
from filinglens.operators import filings, graph, registry, retrieval, sections, signals
from filinglens.session import materialise


def candidate_pool(company_registry: DataFrame, listing: DataFrame, filing_list: DataFrame, texts: DataFrame, day: str, target_name: str,
                   version: list[str], days: int = L.LOOKBACK_DAYS, industry=None, business=None, starts=None, ends=None) -> DataFrame:
    """Every universe company with its filing, section, concepts and outcome.

    ``texts``: rcept_no, text.  Only texts of chosen filings are fetched, and they are
    cut to their section before anything is joined, so whole documents are not
    shuffled with the companies.
    """
    universe = registry.universe(company_registry, listing, target_name, version)
    newest = materialise(filings.latest_periodic_as_of(universe, filing_list, day, days))
    chosen = texts.join(newest.select("rcept_no").filter("rcept_no IS NOT NULL").distinct(), "rcept_no", "left_semi")
    cut = chosen.select("rcept_no", sections.section_slice(F.col("text"), starts, ends).alias("business_text"))
    joined = sections.with_concepts(newest.join(cut, "rcept_no", "left").fillna("", ["business_text"]), "business_text", industry, business)
    return sections.pool_outcome(joined)


def business_profiles(texts: DataFrame, company: str, order: list[str], vocabulary: E.Vocabulary | None = None,
                      max_items: int = L.CORE_MAX_ITEMS) -> dict[str, DataFrame]:
    """Evidence, industry context, core sentences, counts and text per company.

    ``texts``: company, company_name, order columns, text.
    """
    keys = [company, "company_name", *order]
    judged = materialise(E.judged(E.sentence_table(texts, keys), vocabulary))
    place = [*order, "sentence_pos"]
    kept = materialise(E.kept_evidence(judged, company, place))
    own, context = kept.filter("disposition = 'company'"), kept.filter("disposition = 'industry'")
    core = E.core_evidence(own, company, place, max_items=max_items)
    return {"judged": judged, "evidence": own, "industry_context": context, "core": core,
            "counts": E.extraction_counts(judged, [company]), "category_counts": E.category_counts(own, [company]),
            "text": E.profile_text(core, company)}


def keyword_graphs(core: DataFrame, company: str, position: str, load, sentence: str = "sentence") -> tuple[DataFrame, DataFrame]:
    """Nodes with vectors and edges of every company from its core sentences."""
    rows = core.select(F.col(company).alias("company"), F.col(position).alias("sentence_pos"), F.col(sentence).alias("sentence"))
    raw = retrieval.keyphrases(rows, ["company", "sentence_pos"], "sentence", load)
    keywords = materialise(graph.clean_keywords(raw))
    nodes = graph.keyword_nodes(keywords)
    return retrieval.embed(nodes, "keyword", load, "vector"), graph.cooccurrence_edges(keywords, nodes)


def similarity_signals(core: DataFrame, pairs: DataFrame, names: DataFrame, load, company: str = "company", position: str = "core_rank",
                       sentence: str = "sentence") -> DataFrame:
    """Vector and network scores of all candidates side by side.

    ``pairs``: target, candidate (one target).  ``names``: company, company_name.
    """
    pairs = materialise(pairs.select("target", "candidate"))
    embedded = retrieval.embed(core, sentence, load)
    vectors = retrieval.mean_vectors(embedded, company)
    cosine = retrieval.rank_against_target(vectors, pairs.withColumnRenamed("candidate", company), company, "target")
    nodes, edges = keyword_graphs(core, company, position, load, sentence)
    network = graph.network_similarity(pairs, materialise(nodes), materialise(edges))
    left = cosine.join(names.withColumnRenamed("company", company), company).select(
        F.col(company).alias("stock_code"), "company_name", F.col("similarity").alias("vector_score"))
    right = network.select(F.col("candidate").alias("stock_code"), "keyword_score", "edge_score", "centrality_score", "node_match_count", "edge_match_count")
    return signals.compare(left, right)
