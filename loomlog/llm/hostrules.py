"""Quality rules by host: document rules, host failure rates under an empirical beta prior, verdicts joined back.

DataFrame functions only. Every document is judged on its whole text; hosts are counted with partial aggregation, so one
host with a third of all rows costs a map-side sum, and its verdict returns by a join whose large side may be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, numbered, picked, place_of, written

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a repeat window.
WINDOW = 5
MIN_WORDS = 10
#: Per cent of the words that may stand in repeated windows.
MAX_REPEAT = 20
#: Softer rules: per cent of symbols among characters in words, of repeated lines among lines with a word.
MAX_SYMBOLS = 10
MAX_DUP_LINES = 30
#: Bytes of hosts' names and verdicts that are broadcast at most.
MOST_BROADCAST = 4 << 20
#: A host is bad if its shrunk failure rate reaches this.
HOST_LIMIT = 0.5


def host_of(source: Column) -> Column:
    """The domain of a URL, or the name itself: lower case, without scheme, user, www., port and path. Null: ''."""
    return F.regexp_extract(F.lower(F.coalesce(source.cast("string"), F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?(?:www\.)?([^/:?#]*)", 1)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row; an alias may be inlined into a lambda and computed for each element."""
    return F.transform(F.array(value), body)[0]


def _covered(n: Column, starts: Column) -> Column:
    """Words in the union of the windows that begin at the (ascending) starts."""
    step = lambda acc, s: F.struct(
        (acc["sum"] + F.lit(WINDOW) - F.greatest(F.lit(0), acc["end"] - s)).cast("long").alias("sum"), (s + WINDOW).cast("int").alias("end")
    )
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("end"))
    return F.aggregate(starts, zero, step, lambda acc: acc["sum"])


def _window_texts(words: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.array_join(F.slice(words, i, WINDOW), " "))


def _repeated_starts(windows: Column) -> Column:
    """Starts (from 0) of the windows that the text holds twice or more. Sorting brings equal windows together."""
    placed = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    equal = lambda s, i, j: F.get(s, j)["w"] == F.get(s, i)["w"]
    chosen = lambda s: F.filter(
        F.transform(s, lambda x, i: F.when(F.coalesce(equal(s, i, i - 1), F.lit(False)) | F.coalesce(equal(s, i, i + 1), F.lit(False)), x["i"])),
        lambda i: i.isNotNull(),
    )
    return F.array_sort(_let(placed, chosen))


def document_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed and n_soft (soft rules failed).

    Null text: no words, so it fails. Window hashes decide most documents, which repeat nothing; where two hashes of a
    document agree the window texts are compared, so equal hashes of different windows change nothing.
    """
    source = docs.columns
    body = F.coalesce(F.col(text), F.lit(""))
    plain = F.translate(body, SPACES, " " * len(SPACES))
    split = docs.withColumns({"_words": F.array_remove(F.split(plain, " "), ""), "_lines": F.filter(F.split(body, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)})
    n = F.size("_words")
    hashes = F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("_words"), i + j) for j in range(WINDOW)])
    )
    some_repeat = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    repeats = F.when(n <= WINDOW, F.lit(0).cast("long")).when(~some_repeat, F.lit(0).cast("long")).otherwise(_covered(n, _repeated_starts(_window_texts(F.col("_words"), n))))
    counted = split.select(
        *[F.col(f"`{c}`") for c in source],
        n.cast("long").alias("n_words"),
        F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        repeats.alias("n_repeat_words"),
    )
    soft = (F.col("n_symbols") * 100 > F.col("word_chars") * MAX_SYMBOLS).cast("int") + (F.col("n_dup_lines") * 100 > F.col("n_lines") * MAX_DUP_LINES).cast("int")
    return counted.withColumns(
        {"base_failed": (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT), "n_soft": soft}
    )


def prior(n: int | None, f: int, k: int, q: float, n2: float) -> tuple[float, float | None]:
    """Mean and strength (None: infinite) of the beta prior, from sums over hosts of documents, failures, 1, failures^2/documents, documents^2."""
    if not n:
        return 0.0, None
    m = f / n
    room = n - n2 / n - (k - 1)
    between = (q - n * m * m - (k - 1) * m * (1 - m)) / room if room else 0.0
    return m, max(0.0, m * (1 - m) / between - 1) if between > 0 else None


def host_verdicts(judged: DataFrame, host: str = "host", failed: str = "failed", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: n_docs, n_failed, host_rate (shrunk), host_bad.

    The beta prior is fitted to all hosts by moments: its mean is the overall rate m, its strength s the one under which
    the spread of the hosts' rates, less what sampling alone gives, is m(1-m)/(s+1). rate = (failed + m s)/(docs + s). No
    spread beyond sampling gives an infinite s, so every host has the overall rate.
    """
    hosts = judged.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    moments = hosts.agg(
        F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("k"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("q"), F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("n2"),
        F.coalesce(F.sum(F.octet_length(F.col(host)) + 64), F.lit(0)).alias("bytes"),
    )
    fitted = moments.first()  # one row, whatever the number of hosts
    m, strength = prior(*(fitted[c] for c in ("n", "f", "k", "q", "n2")))
    rate = F.lit(m) if strength is None else (F.col("n_failed") + m * strength) / (F.col("n_docs") + strength)
    verdicts = hosts.withColumn("host_rate", rate).withColumn("host_bad", F.col("host_rate") >= limit)
    # few hosts are broadcast, so that the documents needn't meet by host; more are joined by a shuffle that may be split
    return F.broadcast(verdicts) if fitted["bytes"] <= MOST_BROADCAST else verdicts


def rule_table(docs: DataFrame, text: str = "text", host: str = "source", id: str = "doc_id", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document, without its text: doc_id, text_hash, host, the rules' columns, host_rate, host_bad and kept.

    A document goes if it fails a base rule, or if its host is bad and it fails a soft rule itself: a clean document of a
    bad host stays. The host is host_of(the column), so URLs of a domain count together. Null hosts are one host (''). Repeated
    rows are judged alike and each counts. Null and empty texts fail; texts are judged whole, however long. An empty table gives
    none. Other columns, also of like names, play no part. The rules are computed once and written; hosts are counted from that.
    """
    given = picked(docs, doc_id=id, host=host, text=text).withColumn("host", host_of(F.col("host")))
    slim = written(document_rules(given).withColumn("text_hash", F.xxhash64("text")).drop("text"), "rules")
    verdicts = host_verdicts(slim.select("host", (F.col("base_failed") | (F.col("n_soft") > 0)).alias("failed")), limit=limit)
    return slim.join(verdicts.select("host", "host_rate", "host_bad"), "host").withColumn("kept", ~F.col("base_failed") & ~(F.col("host_bad") & (F.col("n_soft") > 0)))


def without_rejected(docs: DataFrame, text: str = "text", host: str = "source", id: str = "doc_id", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of docs that the rules keep, columns as they are. Rows are matched by id and a hash of the text."""
    kept = rule_table(docs, text, host, id, limit).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    own, body = place_of(docs, id), place_of(docs, text)
    return numbered(docs).join(kept, F.col(own).eqNullSafe(F.col("_id")) & (F.xxhash64(body) == F.col("_hash")), "left_semi").toDF(*docs.columns)


def op10_host_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rule_table(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract(lower(coalesce(source, '')), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?(?:www\.)?([^/:?#]*)', 1) AS host, coalesce(text, '') AS t,
    list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM w) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY 1),
b AS (SELECT d.doc_id, host, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS soft FROM b),
h AS (SELECT host, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE base_failed OR soft))::DOUBLE AS x FROM f GROUP BY 1),
m AS (SELECT sum(n) AS n, sum(x) / sum(n) AS m, count(*) AS k, sum(x * x / n) AS q, sum(n * n) AS n2 FROM h),
p AS (SELECT m, (q - n * m * m - (k - 1) * m * (1 - m)) / nullif(n - n2 / n - (k - 1), 0) AS v FROM m),
v AS (SELECT host, CASE WHEN v > 0 THEN (x + m * greatest(0, m * (1 - m) / v - 1)) / (n + greatest(0, m * (1 - m) / v - 1)) ELSE m END >= 0.5 AS bad FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (bad AND soft) AS kept
FROM f JOIN v USING (host)
"""
