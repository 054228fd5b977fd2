"""Metric families as a long table (name, type, help, labels, value), and their text exposition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.operators import temporal

SAMPLE = "name string, type string, help string, labels map<string,string>, value double"


def labels(**columns: Column) -> Column:
    """A label map by name; null values are empty."""
    pairs = [x for name, c in sorted(columns.items()) for x in (F.lit(name), F.coalesce(c.cast("string"), F.lit("")))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def family(df: DataFrame, name: str, kind: str, text: str, value: Column, **by: Column) -> DataFrame:
    """One family: a sample for each row of df."""
    return df.select(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(text).alias("help"), labels(**by).alias("labels"), value.cast("double").alias("value"))


def histogram(df: DataFrame, name: str, text: str, value: Column, edges: Sequence[float], **by: Column) -> DataFrame:
    """Cumulative buckets, sum and count, from one aggregation by label."""
    keyed = df.select(*[c.cast("string").alias(k) for k, c in by.items()], value.cast("double").alias("_v"))
    counted = keyed.groupBy(*by).agg(*[F.count_if(F.col("_v") <= e).alias(f"_b{i}") for i, e in enumerate(edges)], F.count("_v").alias("_n"), F.sum("_v").alias("_s"))
    own = {k: F.col(k) for k in by}
    rows = [F.struct(F.lit(f"{name}_bucket").alias("name"), labels(le=F.lit(f"{e:g}"), **own).alias("labels"), F.col(f"_b{i}").cast("double").alias("value")) for i, e in enumerate(edges)]
    rows += [F.struct(F.lit(f"{name}_bucket").alias("name"), labels(le=F.lit("+Inf"), **own).alias("labels"), F.col("_n").cast("double").alias("value"))]
    rows += [F.struct(F.lit(f"{name}_{s}").alias("name"), labels(**own).alias("labels"), F.coalesce(F.col(c), F.lit(0)).cast("double").alias("value")) for s, c in (("sum", "_s"), ("count", "_n"))]
    return counted.select(F.inline(F.array(*rows))).select("name", F.lit("histogram").alias("type"), F.lit(text).alias("help"), "labels", "value")


def capped(df: DataFrame, label: str, at: str, tie: str, limit: int = 20) -> DataFrame:
    """df with the label's first `limit` values (by first appearance) as they are and 'other' for the rest."""
    first = df.groupBy(label).agg(F.min(F.struct(at, tie)).alias("_f")).orderBy("_f").limit(limit).select(F.col(label).alias("_known"))
    named = df.join(F.broadcast(first), F.col(label).eqNullSafe(F.col("_known")), "left")  # at most `limit` rows
    return named.withColumn(label, F.when(F.col("_known").isNotNull(), F.col(label)).otherwise("other")).drop("_known")


def remapped(samples: DataFrame, label: str, mapping: Mapping[str, str], default: str = "other") -> DataFrame:
    """samples with a label's values mapped and samples that become equal joined: extremes of *_min and *_max, sums of the rest."""
    known = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    value = F.coalesce(F.try_element_at(known, F.try_element_at(F.col("labels"), F.lit(label))), F.lit(default))
    new = F.when(F.map_contains_key("labels", label), F.map_concat(F.map_filter("labels", lambda k, v: k != label), F.create_map(F.lit(label), value))).otherwise(F.col("labels"))
    keyed = samples.withColumn("labels", F.array_sort(F.map_entries(new)))
    joined = keyed.groupBy("name", "type", "help", "labels").agg(F.when(F.col("name").endswith("_min"), F.min("value")).when(F.col("name").endswith("_max"), F.max("value")).otherwise(F.sum("value")).alias("value"))
    return joined.withColumn("labels", F.map_from_entries("labels"))


def counter_increase(samples: DataFrame, at: str) -> DataFrame:
    """The increase of every counter over time, restarts counted from zero. samples have a time column."""
    keyed = samples.filter("type = 'counter'").withColumn("key", F.to_json(F.array_sort(F.map_entries("labels"))))
    run = temporal.reset_adjusted(keyed, ["name", "key"], "value", F.col(at))
    return run.groupBy("name", "key").agg(F.max_by("adjusted", at).alias("increase"))


def exposition(samples: DataFrame) -> DataFrame:
    """Lines of the text format (name, line), to be written in the order of (name, line kind, labels)."""
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("decimal(38,0)").cast("string")).otherwise(F.col("value").cast("string"))
    line = F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(""), F.lit(" "), number)
    base = F.regexp_replace("name", "_(bucket|sum|count)$", "")
    root = F.when(F.col("type") == "histogram", base).otherwise(F.col("name"))
    rows = samples.select(root.alias("family"), F.lit(2).alias("rank"), line.alias("line"))
    heads = samples.select(root.alias("family"), "help", "type").distinct().select("family", F.inline(F.array(F.struct(F.lit(0).alias("rank"), F.concat(F.lit("# HELP "), "family", F.lit(" "), "help").alias("line")), F.struct(F.lit(1).alias("rank"), F.concat(F.lit("# TYPE "), "family", F.lit(" "), "type").alias("line")))))
    return heads.unionByName(rows)


def parse_exposition(lines: DataFrame) -> DataFrame:
    """(name, labels, value) of text lines (line)."""
    samples = lines.filter(~F.col("line").startswith("#") & (F.trim("line") != ""))
    name, inside = F.regexp_extract("line", r"^([A-Za-z_:][\w:]*)", 1), F.regexp_extract("line", r"\{(.*)\}\s+\S+$", 1)
    keys, values = (F.regexp_extract_all(inside, F.lit(r'([A-Za-z_]\w*)="((?:[^"\\]|\\.)*)"'), F.lit(i)) for i in (1, 2))
    plain = F.transform(values, lambda v: F.replace(F.replace(v, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")))
    return samples.select(name.alias("name"), F.map_from_arrays(keys, plain).alias("labels"), F.regexp_extract("line", r"(\S+)$", 1).try_cast("double").alias("value"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Samples (name, labels, value) that only one side has or whose values differ."""
    keyed = lambda df, v: df.select("name", F.array_sort(F.map_entries("labels")).alias("labels"), F.col("value").alias(v))
    both = keyed(a, "left_value").join(keyed(b, "right_value"), ["name", "labels"], "full")
    return both.filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def allowed(samples: DataFrame, names: Sequence[str], values: Mapping[str, Sequence[str]]) -> DataFrame:
    """Samples of the given names whose labels are all of the vocabulary: a known label with one of its values."""
    pairs = F.map_entries("labels")
    fine = F.forall(pairs, lambda e: F.coalesce(*[F.when(e["key"] == k, e["value"].isin(*v)) for k, v in sorted(values.items())], F.lit(False))) if values else F.size(pairs) == 0
    return samples.filter(F.col("name").isin(*names) & fine)


def increase(samples: DataFrame, at: str, seconds: int, until) -> DataFrame:
    """(name, key, increase) of each counter over the last so many seconds before a time, restarts counted from zero."""
    end = F.unix_micros(F.lit(until).cast("timestamp"))
    inside = samples.filter((F.unix_micros(at) > end - seconds * 1_000_000) & (F.unix_micros(at) <= end))
    run = temporal.reset_adjusted(inside.withColumn("key", F.to_json(F.array_sort(F.map_entries("labels")))), ["name", "key"], "value", F.col(at))
    return run.groupBy("name", "key").agg((F.max_by("adjusted", at) - F.min_by("adjusted", at)).alias("increase"))


def last_over(samples: DataFrame, at: str, seconds: int, until) -> DataFrame:
    """(name, key, last, least): each series' last and least value over the last so many seconds; one without a sample is absent."""
    end = F.unix_micros(F.lit(until).cast("timestamp"))
    keyed = samples.withColumn("key", F.to_json(F.array_sort(F.map_entries("labels"))))
    inside = (F.unix_micros(at) > end - seconds * 1_000_000) & (F.unix_micros(at) <= end)
    value = F.when(inside, F.col("value"))
    return keyed.groupBy("name", "key").agg(F.max_by("value", F.when(inside, F.col(at))).alias("last"), F.min(value).alias("least"), (F.count_if(inside) == 0).alias("absent"))


def nearest_rank(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """The ceil(q n)-th smallest value of each group for each share q, as q50, q90, ..."""
    return rows.groupBy(*by).agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(f"q{round(q * 100)}") for q in shares])
