"""BM25 over postings, phrase match, and rank fusion, all as DataFrame arithmetic.

score(q, d) = sum over terms of idf * tf (k1 + 1) / (tf + k1 (1 - b + b |d| / avg)); idf = ln(1 + (N - df + 0.5) / (df + 0.5)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.session import spread

K1, B = 1.2, 0.75
#: Constant of reciprocal rank fusion.
RRF_K = 60


def plain_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def code_tokens(text: Column) -> Column:
    """As plain_tokens, but camelCase and letter-digit boundaries part words too."""
    parted = F.regexp_replace(text, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    return plain_tokens(parted)


#: Asked-for terms up to which tokens are compared with a list of them; more are joined.
MOST_TERMS = 10_000


def postings(docs: DataFrame, id: str, text: str, tokens=plain_tokens, asked: list[str] | None = None) -> DataFrame:
    """(id, term, tf, n): counts of the asked terms (None: of all) with the document's length, and a row of each document with an
    empty term.

    Other terms go before the texts are taken apart, and counts are combined before the shuffle by (id, term).
    """
    split = spread(docs.select(F.col(id).alias("id"), F.col(text).alias("x"))).select("id", tokens(F.coalesce("x", F.lit(""))).alias("t"))
    kept = F.col("t") if asked is None else F.filter("t", lambda x: x.isin(*asked)) if asked else F.array().cast("array<string>")
    # the whole array of tokens doesn't go through the explode
    slim = split.select("id", F.size("t").alias("n"), F.concat(kept, F.array(F.lit(""))).alias("kept"))
    rows = slim.select("id", "n", F.explode("kept").alias("word"))
    counted = rows.groupBy("id", "word").agg(F.count("*").alias("tf"), F.max("n").alias("n"))
    # a term that depends on n, so that filters on it stay above the aggregation and don't part plans that are shared
    return counted.select("id", F.when(F.col("n") >= 0, F.col("word")).alias("term"), "tf", "n")


def bm25(docs: DataFrame, id: str, text: str, queries: DataFrame, tokens=plain_tokens, mode: str = "any") -> DataFrame:
    """(query_id, id, score) of every document that a query matches. queries: query_id, query.

    mode any: a document with one of the terms; all: with every one. Document frequencies, the number of documents and their
    mean length come from the postings that are scored, so texts are read and taken apart once.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    asked = sorted({r["term"] for r in terms.select("term").distinct().limit(MOST_TERMS + 1).collect()})
    many = len(asked) > MOST_TERMS
    found = postings(docs, id, text, tokens, None if many else asked)
    if many:
        found = found.join(terms.select(F.col("term").alias("_t")).distinct(), F.col("term") == F.col("_t"), "left").filter("term = '' OR _t IS NOT NULL").drop("_t")
    # both branches read every aggregate, so their plans below are equal and Spark shuffles the postings once
    full = (F.col("n") > 0) & (F.col("tf") > 0)
    by_term = found.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"), F.count_if(full).alias("full"), F.sum("n").alias("length"))
    whole = by_term.filter("term = ''").select(F.col("full").cast("double").alias("n_docs"), (F.col("length") / F.nullif("full", F.lit(0))).alias("mean"))
    known = by_term.filter("term <> ''").select("term", "df").crossJoin(F.broadcast(whole))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    hits = found.filter("term <> ''").join(known, "term").join(terms, "term")
    scored = hits.groupBy("query_id", "id").agg(F.sum(part).alias("score"), F.count("*").alias("matched"))
    if mode == "all":
        wanted = terms.groupBy("query_id").agg(F.count("*").alias("wanted"))
        scored = scored.join(wanted, "query_id").filter("matched = wanted")
    return scored.select("query_id", F.col("id").alias(id), "score")


def phrase(docs: DataFrame, id: str, text: str, query: str, tokens=plain_tokens) -> DataFrame:
    """Ids of the documents in which the query's tokens follow each other, with how often."""
    t = docs.select(F.col(id), F.concat(F.lit(" "), F.array_join(tokens(F.col(text)), "  "), F.lit(" ")).alias("t"))
    needle = F.concat(F.lit(" "), F.array_join(tokens(F.lit(query)), "  "), F.lit(" "))
    return t.withColumn("hits", F.floor((F.length("t") - F.length(F.replace(F.col("t"), needle, F.lit("")))) / F.length(needle))).filter("hits > 0").select(id, "hits")


def ranked(scores: DataFrame, by: list[str], name: str, *order: Column) -> DataFrame:
    return scores.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def fused(a: DataFrame, b: DataFrame, on: list[str], weight_b: float = 0.7, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (rank_a, rank_b): a full join on the key, absent ranks add nothing."""
    score = F.coalesce((1 - weight_b) / (k + F.col("rank_a")), F.lit(0.0)) + F.coalesce(weight_b / (k + F.col("rank_b")), F.lit(0.0))
    return a.select(*on, "rank_a").join(b.select(*on, "rank_b"), on, "full").withColumn("score", score)


def fused_lists(lists: list[tuple[DataFrame, float]], on: list[str], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of any number of ranked lists (on, rank), each with its weight: one union and one aggregation."""
    parts = [df.select(*on, F.lit(i).alias("list"), "rank", (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for i, (df, w) in enumerate(lists)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    ranks = [F.min(F.when(F.col("list") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(lists))]
    return every.groupBy(*on).agg(F.sum("part").alias("score"), *ranks)


def over_fields(docs: DataFrame, id: str, fields: list[str], queries: DataFrame, tokens=plain_tokens, mode: str = "any") -> DataFrame:
    """BM25 of each field as an index of its own: (query_id, id, score: the best field's, total: all fields', field: the best)."""
    parts = [bm25(docs, id, f, queries, tokens, mode).withColumn("field", F.lit(f)).withColumn("place", F.lit(-i)) for i, f in enumerate(fields)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("query_id", id).agg(F.max("score").alias("best"), F.sum("score").alias("total"), F.max_by("field", F.struct("score", "place")).alias("field"))


def query_weight(query: str) -> float:
    """Weight of the vector list: low for queries that look like an identifier or are a single short word."""
    words = query.split()
    coded = any(c in query for c in "_/.:#()[]{}") or any(w != w.lower() and w != w.capitalize() and w != w.upper() for w in words)
    return 0.35 if coded or (len(words) == 1 and len(query) <= 12) else 0.7
