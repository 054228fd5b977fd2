"""Where a document tells most of what a query asks: the least stretch of its text that covers most of the asked terms.

Pieces of a text (words and what is between them) give every term's place in characters; a window that slides over the places of a
hit's terms finds, for each as its left end, how many distinct terms end within the width. Texts are read whole, and only places of asked
terms go on. Hits are what a search gives, so there are few; a hit's places are one window partition, sorted by Spark with spilling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.session import spread

from .search import MOST_TERMS, plain_tokens

#: Characters of a snippet, without the dots that tell that it is cut.
WIDTH = 240
#: Pieces whose places are summed up together.
BLOCK = 256
PIECES = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"


def term_places(hits: DataFrame, docs: DataFrame, id: str, text: str, queries: DataFrame) -> DataFrame:
    """(query_id, id, term, start, stop): every place, in characters from 0, at which a hit (query_id, id) tells a term of its query."""
    terms = queries.select("query_id", F.explode(F.array_distinct(plain_tokens(F.col("query")))).alias("term"))
    asked = hits.select("query_id", F.col(id).alias("id")).distinct()
    wanted = [r["term"] for r in terms.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    counts = (lambda x: F.lit(True)) if len(wanted) > MOST_TERMS else (lambda x: F.lower(x).isin(*wanted))
    own = spread(docs.select(F.col(id).alias("id"), F.col(text).alias("_text"))).filter("_text <> ''")
    pieces = own.select("id", F.regexp_extract_all("_text", F.lit(PIECES), F.lit(0)).alias("_p"))
    # places are summed up where the text is, in blocks whose own places are few; of the pieces only those of asked terms leave the row
    size = F.size("_p")
    blocks = pieces.filter(size > 0).select("id", F.transform(F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int")), lambda i: F.slice("_p", i * BLOCK + 1, F.lit(BLOCK))).alias("_b"))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<term:string,start:bigint,stop:bigint>>").alias("told"))

    def with_piece(seen, x):
        stop = seen["at"] + F.length(x)
        new = F.array(F.struct(F.lower(x).alias("term"), seen["at"].alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(counts(x), F.concat(seen["told"], new)).otherwise(seen["told"]).alias("told"))

    summed = blocks.select("id", F.transform("_b", lambda b: F.aggregate(b, none, with_piece)).alias("_s"))
    begins = F.aggregate("_s", F.array(F.lit(0).cast("long")), lambda ends, s: F.concat(ends, F.array(F.element_at(ends, -1) + s["at"])))
    placed = summed.select("id", F.explode(F.arrays_zip(F.col("_s"), begins.alias("_at"))).alias("_z")).filter("_z._s IS NOT NULL").select("id", F.col("_z._at").alias("_at"), F.explode("_z._s.told").alias("_t"))
    placed = placed.select("id", "_t.term", (F.col("_at") + F.col("_t.start")).alias("start"), (F.col("_at") + F.col("_t.stop")).alias("stop"))
    return placed.join(terms, "term").join(asked, ["query_id", "id"]).select("query_id", "id", "term", "start", "stop")


def best_stretches(places: DataFrame, width: int = WIDTH) -> DataFrame:
    """(query_id, id, covered, start, stop) of each hit: the stretch that covers most distinct terms within the width, the shortest of
    these, the first of these. A term longer than the width is a stretch by itself."""
    ahead = Window.partitionBy("query_id", "id").orderBy("start").rangeBetween(0, width)
    near = F.collect_list(F.struct("term", "stop")).over(ahead)
    seen = places.withColumn("_near", F.filter(near, lambda x: (x["stop"] <= F.col("start") + width) | (x["stop"] == F.col("stop"))))
    covered = F.size(F.array_distinct(F.transform("_near", lambda x: x["term"])))
    # the shortest stretch from here that has them all ends where the last of the terms first ends
    firsts = F.transform(F.array_distinct(F.transform("_near", lambda x: x["term"])), lambda t: F.array_min(F.transform(F.filter("_near", lambda x: x["term"] == t), lambda x: x["stop"])))
    told = seen.select("query_id", "id", "start", covered.alias("covered"), F.array_max(firsts).alias("stop"))
    best = told.groupBy("query_id", "id").agg(F.min(F.struct((-F.col("covered")).alias("c"), (F.col("stop") - F.col("start")).alias("n"), "start", "stop")).alias("b"))
    return best.select("query_id", "id", (-F.col("b.c")).cast("long").alias("covered"), F.col("b.start").alias("start"), F.col("b.stop").alias("stop"))


def snippets(hits: DataFrame, docs: DataFrame, id: str, text: str, queries: DataFrame, width: int = WIDTH) -> DataFrame:
    """hits' (query_id, id) with covered (distinct terms) and snippet: width characters around the best stretch, with dots where the text
    goes on. A hit that tells no term of its query (or has no text) has no row; rows of one id in docs are one document each."""
    best = best_stretches(term_places(hits, docs, id, text, queries), width)
    met = best.join(docs.select(F.col(id).alias("id"), F.col(text).alias("_text")).filter("_text IS NOT NULL"), "id")
    size, room = F.length("_text"), F.greatest(F.lit(width) - (F.col("stop") - F.col("start")), F.lit(0))
    begin = F.greatest(F.least(F.col("start") - F.floor(room / 2), size - width), F.lit(0))
    end = F.least(F.greatest(begin + width, F.col("stop")), size)
    cut = F.concat(F.when(begin > 0, "...").otherwise(""), F.substr("_text", (begin + 1).cast("int"), (end - begin).cast("int")), F.when(end < size, "...").otherwise(""))
    return met.select("query_id", F.col("id").alias(id), "covered", cut.alias("snippet"))
