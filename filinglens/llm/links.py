"""Connected components by alternating stars, as joins and aggregates.

Large star: every neighbour larger than a node is linked to the smallest of the node's neighbourhood; small
star: a node and its smaller neighbours are linked to the smallest of them.  In turns they leave one star per
component around its smallest node, in a number of rounds that grows with the logarithm of the size.  No
neighbourhood is ever collected: only its minimum is, which combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglens.llm.common import stored


def _toward_smallest(links: DataFrame) -> DataFrame:
    """Pairs (u, v) with m, the smallest v of u."""
    return links.join(links.groupBy("u").agg(F.min("v").alias("m")), "u")


def _all_stars(links: DataFrame) -> bool:
    """Every link goes from a node with this one link to a node that has none of its own: the components are found."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("own"), F.lit(0).alias("met")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("own"), F.lit(1).alias("met")))
    return ends.groupBy("x").agg(F.sum("own").alias("own"), F.max("met").alias("met")).filter("own > 1 OR own > 0 AND met > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns u and v); root is the smallest node of the component."""
    def oriented(df):
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()

    now = stored(oriented(links), "links")
    while not _all_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_smallest(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = oriented(large)
        small = _toward_smallest(large)
        small = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = stored(oriented(small), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def labelled(signatures: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for ``signatures`` (doc_id, n_shingles, node); a document without a set is its own component."""
    named = signatures.select("doc_id", "n_shingles", "node").join(roots, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("root"))
    first = named.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(first, "root", "left").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def component_sql(width: int, percent: int, more: str = "") -> str:
    """The same by SQL, over all pairs that share a shingle."""
    window = " || ' ' || ".join(f"w[i{f' + {k}' if k else ''}]" for k in range(width))
    return f"""
WITH RECURSIVE
  split AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: {window})) END AS s FROM split),
  items AS (SELECT r, len(s) AS n, unnest(s) AS g FROM sets),
  links AS (SELECT a.r AS x, b.r AS y FROM items a JOIN items b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r
    HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
  reach AS (SELECT r AS x, r AS y FROM sets UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
  least AS (SELECT reach.x AS r, min(sets.doc_id) AS component_id FROM reach JOIN sets ON reach.y = sets.r GROUP BY reach.x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id{more} FROM sets JOIN least USING (r)"""
