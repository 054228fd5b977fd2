"""WARC revisit records of profile server-not-modified, resolved to the full responses that they stand for.

A revisit (HTTP 304) has no body. Its body is that of the latest earlier full response of the same canonical URL, if the
validators agree; a few of its headers replace the stored ones. The search is an as-of join without a join: captures are cut
into blocks of time for each URL, the last full response of every block is aggregated (partially, before the shuffle), carried
over the blocks of a URL, and combined with the last one inside the block. A URL with a third of all captures becomes many
blocks; one with few is a single block. Bodies never move: a revisit gets the id of the record that has its body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import picked, written

#: Header fields of a 304 response that replace those of the stored response (RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't change what a URL names.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"
#: Captures of a URL that make up a block.
BLOCK_CAPTURES = 20_000


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, http as https, no default port, fragment, tracking parameters or closing slash; parameters sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)), "^http$", "https")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?i:{TRACKING})(=|$)")))
    return F.when(scheme == "", F.lower(bare)).otherwise(F.concat(scheme, F.lit("://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def lower_headers(headers: Column) -> Column:
    """The header map with names in lower case; of names that clash the first stays. Null: no headers."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter(entries, lambda e: F.lower(e["key"]) == n), F.lit(0))["value"]))


def merged_headers(stored: Column, revisit: Column) -> Column:
    """The stored response's headers, with the permitted ones of the revisit in place of its own."""
    new = F.map_filter(revisit, lambda k, v: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(new, k)), new)


def _weak(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def verdict(found: Column, etag: Column, modified: Column, stored_etag: Column, stored_modified: Column) -> Column:
    """How a revisit fares: an entity tag decides if the revisit has one (weak comparison), else Last-Modified does."""
    return (
        F.when(~found, "orphan")
        .when(etag.isNotNull(), F.when(_weak(etag).eqNullSafe(_weak(stored_etag)), "resolved").otherwise("mismatch"))
        .when(modified.isNotNull(), F.when(modified.eqNullSafe(stored_modified), "resolved").otherwise("mismatch"))
        .otherwise("no_validator")
    )


def resolve_revisits(records: DataFrame, block_captures: int = BLOCK_CAPTURES) -> DataFrame:
    """One row per record: record_id, url_key, captured, kind, status, source_id, headers (map).

    records: record_id long, url string, captured long (any unit), kind ('response' or 'revisit'), headers map<string,string>;
    ETag and Last-Modified are read from the headers. status: 'full' for a response, else resolved, mismatch, no_validator
    or orphan (no earlier full response). Earlier means a smaller (captured, record_id). source_id: the record with the body
    (null unless full or resolved). headers: merged if resolved, else the record's own. A null URL or time: an orphan, or
    full. Repeated rows are resolved each. Other columns, also of like names, play no part; an empty table gives none.
    """
    own = lower_headers(F.col("headers"))
    given = picked(records, record_id="record_id", url="url", captured="captured", kind="kind", headers="headers")
    slim = given.select(F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("url_key"), F.col("captured").cast("long").alias("captured"), "kind", own.alias("headers"))
    slim = written(slim.withColumns({"etag": F.col("headers")["etag"], "modified": F.col("headers")["last-modified"]}), "captures")
    dated = slim.filter("url_key IS NOT NULL AND captured IS NOT NULL AND record_id IS NOT NULL")
    spans = dated.groupBy("url_key").agg(F.count("*").alias("n"), F.min("captured").alias("low"), F.max("captured").alias("high"))
    busy = spans.filter(F.col("n") > block_captures).select("url_key", "low", ((F.col("high") - F.col("low")) / F.ceil(F.col("n") * 4 / block_captures) + 1).alias("width"))
    # few URLs are busy: at most one in block_captures rows
    blocked = dated.join(busy, "url_key", "left").withColumn("block", F.coalesce(F.floor((F.col("captured") - F.col("low")) / F.col("width")), F.lit(0)))
    blocked = blocked.drop("low", "width")
    full = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "modified", "headers"))
    tails = blocked.groupBy("url_key", "block").agg(F.max_by(full, F.when(F.col("kind") == "response", F.struct("captured", "record_id"))).alias("tail"))
    carried = tails.withColumn("carry", F.last("tail", True).over(Window.partitionBy("url_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("url_key", "block", "carry")
    within = F.last(full, True).over(Window.partitionBy("url_key", "block").orderBy("captured", "record_id").rowsBetween(Window.unboundedPreceding, -1))
    joined = blocked.withColumn("within", within).join(carried, ["url_key", "block"]).withColumn("stored", F.coalesce("within", "carry")).drop("within", "carry", "block")
    undated = slim.filter("url_key IS NULL OR captured IS NULL OR record_id IS NULL").withColumn("stored", F.lit(None).cast(joined.schema["stored"].dataType))
    every = joined.unionByName(undated)
    status = F.when(F.col("kind") == "response", "full").otherwise(verdict(F.col("stored").isNotNull(), F.col("etag"), F.col("modified"), F.col("stored.etag"), F.col("stored.modified")))
    source = F.when(F.col("status") == "full", F.col("record_id")).when(F.col("status") == "resolved", F.col("stored.record_id"))
    headers = F.when(F.col("status") == "resolved", merged_headers(F.col("stored.headers"), F.col("headers"))).otherwise(F.col("headers"))
    return every.withColumn("status", status).select("record_id", "url_key", "captured", "kind", "status", source.alias("source_id"), headers.alias("headers"))


def header_text(headers: Column) -> Column:
    """The headers as lines 'name: value', by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")


def crawl_of(pages: DataFrame) -> DataFrame:
    """A crawl's records from a table of pages: for each page its full response, a revisit long after and one shortly before.

    The later revisit's validators depend on page_id: stale for multiples of 7, else only Last-Modified for multiples of 5,
    none for multiples of 11, a weak entity tag for multiples of 3.
    """
    p, tag, day = F.col("page_id"), F.md5(F.coalesce("html", F.lit(""))), (F.col("page_id") % 28 + 1).cast("string")
    quoted = F.concat(F.lit('"'), tag, F.lit('"'))
    entity = F.when(p % 7 == 0, F.lit('"stale"')).when((p % 5 == 0) | (p % 11 == 0), None).when(p % 3 == 0, F.concat(F.lit("W/"), quoted)).otherwise(quoted)
    modified = F.when((p % 7 != 0) & (p % 5 == 0), day)
    pick = lambda pairs: F.map_filter(F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])), lambda k, v: v.isNotNull())
    response = pick([("Content-Type", F.lit("text/html")), ("Content-Length", F.octet_length(F.coalesce("html", F.lit(""))).cast("string")), ("ETag", quoted), ("Last-Modified", day), ("Cache-Control", F.lit("max-age=60"))])
    later = pick([("ETag", entity), ("Last-Modified", modified), ("Cache-Control", F.lit("max-age=600")), ("Content-Length", F.lit("0")), ("Server", F.lit("cache"))])
    before = pick([("ETag", quoted), ("Vary", F.lit("Accept"))])
    record = lambda n, at, kind, headers: F.struct((p * 3 + n).alias("record_id"), (p * 1000 + at).alias("captured"), F.lit(kind).alias("kind"), headers.alias("headers"))
    rows = F.array(record(0, 0, "response", response), record(1, 500_000, "revisit", later), record(2, -700, "revisit", before))
    return pages.select("url", F.explode(rows).alias("r")).select("url", "r.*")


def op3_not_modified(spark, sf_dir: str) -> DataFrame:
    found = resolve_revisits(crawl_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.select("record_id", "url_key", "kind", "status", "source_id", header_text(F.col("headers")).alias("header_text"))


ORACLE = r"""
WITH p AS (SELECT page_id AS p, url, '"' || md5(coalesce(html, '')) || '"' AS tag, (page_id % 28 + 1)::VARCHAR AS day, octet_length(encode(coalesce(html, '')))::VARCHAR AS len FROM pages),
u AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS bare FROM p),
c AS (SELECT *, CASE WHEN regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) = '' THEN lower(bare) ELSE
    regexp_replace(lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)), '^http$', 'https') || '://' ||
    regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', '') ||
    regexp_replace(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') ||
    coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?i:utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&'), ''), '') END AS url_key FROM u),
r AS (SELECT p * 3 AS record_id, url_key, p * 1000 AS t, 'response' AS kind, tag AS etag, day AS modified, 'max-age=60' AS cc, len, NULL AS server, 'text/html' AS ct, NULL AS vary FROM c
    UNION ALL SELECT p * 3 + 1, url_key, p * 1000 + 500000, 'revisit', CASE WHEN p % 7 = 0 THEN '"stale"' WHEN p % 5 = 0 OR p % 11 = 0 THEN NULL WHEN p % 3 = 0 THEN 'W/' || tag ELSE tag END,
        CASE WHEN p % 7 <> 0 AND p % 5 = 0 THEN day END, 'max-age=600', '0', 'cache', NULL, NULL FROM c
    UNION ALL SELECT p * 3 + 2, url_key, p * 1000 - 700, 'revisit', tag, NULL, NULL, NULL, NULL, NULL, 'Accept' FROM c),
s AS (SELECT v.*, f.record_id AS f_id, f.etag AS f_etag, f.modified AS f_mod, f.cc AS f_cc, f.len AS f_len, f.ct AS f_ct,
    row_number() OVER (PARTITION BY v.record_id ORDER BY f.t DESC NULLS LAST, f.record_id DESC NULLS LAST) AS n
    FROM r v LEFT JOIN r f ON v.kind = 'revisit' AND f.kind = 'response' AND f.url_key = v.url_key AND (f.t < v.t OR f.t = v.t AND f.record_id < v.record_id)),
x AS (SELECT *, CASE WHEN kind = 'response' THEN 'full' WHEN f_id IS NULL THEN 'orphan'
    WHEN etag IS NOT NULL THEN CASE WHEN replace(etag, 'W/', '') = f_etag THEN 'resolved' ELSE 'mismatch' END
    WHEN modified IS NOT NULL THEN CASE WHEN modified = f_mod THEN 'resolved' ELSE 'mismatch' END ELSE 'no_validator' END AS status FROM s WHERE n = 1)
SELECT record_id, url_key, kind, status, CASE status WHEN 'full' THEN record_id WHEN 'resolved' THEN f_id END AS source_id,
    concat_ws(chr(10), 'cache-control: ' || CASE WHEN status = 'resolved' THEN coalesce(cc, f_cc) ELSE cc END, 'content-length: ' || CASE WHEN status = 'resolved' THEN f_len ELSE len END,
    'content-type: ' || CASE WHEN status = 'resolved' THEN f_ct ELSE ct END, 'etag: ' || CASE WHEN status = 'resolved' THEN coalesce(etag, f_etag) ELSE etag END,
    'last-modified: ' || CASE WHEN status = 'resolved' THEN f_mod ELSE modified END, 'server: ' || CASE WHEN status <> 'resolved' THEN server END, 'vary: ' || vary) AS header_text FROM x
"""
