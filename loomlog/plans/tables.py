"""Queries over the dimension and order tables, which stand for sessions, calls and prices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlog.operators import lineage, temporal

from .catalogue import query


@query(
    "daily_usage_priced",
    """WITH p AS (SELECT p_brand, d, r, lead(d) OVER (PARTITION BY p_brand ORDER BY d) AS until FROM (
        SELECT p_brand, DATE '1992-01-01' AS d, 1.0::DOUBLE AS r FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1 UNION ALL SELECT p_brand, DATE '1999-01-01', 1.5 FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1)),
    g AS (SELECT p_brand, l_shipdate::DATE AS day, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
    SELECT year(day) AS y, g.p_brand, sum(q) AS quantity, round(sum(q * r), 4) AS usd, count(*) FILTER (WHERE r IS NULL) AS unpriced_days
    FROM g LEFT JOIN p ON p.p_brand = g.p_brand AND day >= d AND (until IS NULL OR day < until) GROUP BY 1, 2""",
)
def daily_usage_priced(t):
    """Quantities by brand and day, priced once a group at the price of the day, then by year; unpriced ones stay unknown."""
    part = t("part").select("p_partkey", "p_brand")
    brands = part.filter("p_brand <> 'Brand#3'").select("p_brand").distinct()
    prices = brands.select("p_brand", F.inline(F.array(F.struct(F.to_date(F.lit("1992-01-01")).alias("since"), F.lit(1.0).alias("rate")), F.struct(F.to_date(F.lit("1999-01-01")).alias("since"), F.lit(1.5).alias("rate")))))
    daily = t("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("q"))
    priced = temporal.valid_at(daily, prices, "p_brand", "day", "since")
    return priced.groupBy(F.year("day").cast("long").alias("y"), "p_brand").agg(F.sum("q").alias("quantity"), F.round(F.sum(F.col("q") * F.col("rate")), 4).alias("usd"), F.count_if(F.col("rate").isNull()).alias("unpriced_days"))


_VERSIONS = """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_shipdate >= TIMESTAMP '2000-06-01' THEN 'v3' WHEN l_shipdate >= TIMESTAMP '1998-01-01' THEN 'v2' WHEN l_shipdate >= TIMESTAMP '1996-01-01' THEN 'v1' END AS version
    FROM lineitem"""


@query("scd_price_lookup", _VERSIONS)
@query("scd_price_lookup_all_lines", _VERSIONS)
def scd_price_lookup(t):
    """The version of a part's price that held when it was shipped, of every line."""
    return _price_versions(t, t("lineitem"))


def _price_versions(t, lines):
    versions = F.array(*[F.struct(F.lit(d).cast("timestamp_ntz").alias("since"), F.lit(v).alias("version")) for d, v in (("1996-01-01", "v1"), ("1998-01-01", "v2"), ("2000-06-01", "v3"))])
    prices = t("part").select(F.col("p_partkey").alias("l_partkey"), F.inline(versions))
    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return temporal.valid_at(rows, prices, "l_partkey", "l_shipdate", "since").drop("l_shipdate")


@query(
    "session_cost_two_level",
    """SELECT o_custkey, count(*) AS orders, round(sum(cost), 4) AS cost FROM (SELECT o_custkey, o_orderkey, sum(l_extendedprice * (1 - l_discount)) AS cost FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1""",
)
def session_cost_two_level(t):
    """Cost by order, then by customer: the first aggregate shrinks the lines before they meet the orders."""
    lines = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cost"))
    return lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("cost"), 4).alias("cost"))


@query(
    "session_tree_rollup",
    """SELECT r_name, n_name, count(DISTINCT c_custkey) AS members, count(o_orderkey) AS orders, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey
    LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY GROUPING SETS ((r_name, n_name), (r_name), ())""",
)
def session_tree_rollup(t):
    """Totals of a tree by branch, by root and over all: orders by customer first, then one rollup over customers."""
    orders = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    tree = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return tree.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").rollup("r_name", "n_name").agg(F.count("c_custkey").alias("members"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.round(F.sum("s"), 2).alias("total"))


@query(
    "cost_grouping_sets",
    """SELECT year(o_orderdate) AS y, c_mktsegment, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
    GROUP BY GROUPING SETS ((1, c_mktsegment, o_orderpriority), (1), ())""".replace("(1,", "(year(o_orderdate),").replace("(1)", "(year(o_orderdate))"),
)
def cost_grouping_sets(t):
    """The same totals at three levels. They are aggregated once at the finest, and the sets are formed from that."""
    fine = t("orders").join(t("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.year("o_orderdate").cast("long").alias("y"), "c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    sets = fine.groupingSets([["y", "c_mktsegment", "o_orderpriority"], ["y"], []], "y", "c_mktsegment", "o_orderpriority")
    return sets.agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("total"))


@query(
    "redo_flag",
    """SELECT o_orderkey, EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate > o.o_orderdate AND p.o_orderdate <= o.o_orderdate + INTERVAL 30 DAY) AS redone FROM orders o""",
)
def redo_flag(t):
    """Whether the same customer ordered again within thirty days: the next later date tells."""
    days = t("orders").select("o_custkey", "o_orderdate").distinct()
    later = days.withColumn("next", F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate")))
    redone = F.coalesce(F.col("next") <= F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"), F.lit(False))
    return t("orders").select("o_orderkey", "o_custkey", "o_orderdate").join(later, ["o_custkey", "o_orderdate"]).select("o_orderkey", redone.alias("redone"))


@query(
    "open_threads_anti",
    """SELECT 'no order' AS kind, c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
    UNION ALL SELECT 'unfinished', o_orderkey FROM orders WHERE o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')
    UNION ALL SELECT 'never sold', p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)""",
)
def open_threads_anti(t):
    """Three kinds of loose ends, each by an anti join."""
    kind = lambda df, name, id: df.select(F.lit(name).alias("kind"), F.col(id).alias("id"))
    customers = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    open_orders = t("orders").filter("o_orderstatus = 'P'").join(t("lineitem").filter("l_linestatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    parts = t("part").join(t("lineitem"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")
    return kind(customers, "no order", "c_custkey").unionByName(kind(open_orders, "unfinished", "o_orderkey")).unionByName(kind(parts, "never sold", "p_partkey"))


@query(
    "before_after_windows",
    """WITH c AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_totalprice > 480000)
    SELECT c.o_orderkey, count(*) FILTER (WHERE o.o_orderdate < c.o_orderdate) AS before, count(*) FILTER (WHERE o.o_orderdate > c.o_orderdate) AS after
    FROM c LEFT JOIN orders o ON o.o_custkey = c.o_custkey AND o.o_orderdate BETWEEN c.o_orderdate - INTERVAL 180 DAY AND c.o_orderdate + INTERVAL 180 DAY GROUP BY 1""",
)
def before_after_windows(t):
    """Activity in the half years before and after a change: a range join within equal keys and buckets of time."""
    orders = t("orders").select("o_custkey", "o_orderdate")
    change = t("orders").filter("o_totalprice > 480000").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("at"))
    near = temporal.near_in_time(change, orders, ["o_custkey"], "at", "o_orderdate", 180 * 86_400)
    return near.groupBy("o_orderkey").agg(F.count_if(F.col("o_orderdate") < F.col("at")).alias("before"), F.count_if(F.col("o_orderdate") > F.col("at")).alias("after"))


@query(
    "commit_prefix_resolution",
    """WITH p AS (SELECT s_suppkey, substr(md5(s_name), 1, 7) AS prefix FROM supplier), f AS (SELECT s_suppkey, md5(s_name) AS sha, s_acctbal FROM supplier)
    SELECT p.s_suppkey, arg_min(f.s_suppkey, (abs(f.s_acctbal - 5000), f.s_suppkey)) AS resolved FROM p JOIN f ON starts_with(f.sha, p.prefix) GROUP BY 1""",
)
def commit_prefix_resolution(t):
    """Abbreviated hashes resolved to full ones: equal seven-character prefixes meet, the best match wins."""
    full = t("supplier").select(F.col("s_suppkey").alias("id"), F.md5("s_name").alias("sha"), "s_acctbal").withColumn("prefix", F.left("sha", F.lit(7)))
    short = t("supplier").select("s_suppkey", F.left(F.md5("s_name"), F.lit(7)).alias("prefix"))
    return short.join(full, "prefix").groupBy("s_suppkey").agg(F.min_by("id", F.struct(F.abs(F.col("s_acctbal") - 5000), "id")).alias("resolved"))


@query(
    "next_launch_cutoff",
    """SELECT o_orderkey, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS cutoff, count(*) OVER (PARTITION BY o_custkey, o_orderdate) > 1 AS tied FROM orders""",
)
def next_launch_cutoff(t):
    """When the next launch of the same owner ends this one, and whether two began at once."""
    tied = F.count("*").over(Window.partitionBy("o_custkey", "o_orderdate")) > 1
    return t("orders").select("o_orderkey", F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("cutoff"), tied.alias("tied"))


@query("top_groups", "SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5")
def top_groups(t):
    """The five largest groups (a report)."""
    return t("part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total")).orderBy(F.desc("n"), "p_brand").limit(5)


@query(
    "lineage_recursive",
    """WITH RECURSIVE w AS (SELECT c_custkey AS id, c_custkey AS top, 0 AS depth FROM customer UNION ALL SELECT w.id, c.c_custkey, depth + 1 FROM w JOIN customer c ON c.c_custkey = CASE WHEN w.top % 7 <> 0 THEN w.top // 2 END AND w.top <> c.c_custkey WHERE depth < 16)
    SELECT id AS c_custkey, arg_max(top, depth) AS root, max(depth) AS depth FROM w GROUP BY 1""",
)
def lineage_recursive(t):
    """Roots and depths of a forest: a customer's parent is half its key, multiples of seven have none. From longer chains, the ancestor
    sixteen steps up."""
    parent = F.when((F.col("c_custkey") % 7 != 0) & (F.floor(F.col("c_custkey") / 2) != F.col("c_custkey")), F.floor(F.col("c_custkey") / 2))
    return lineage.ancestors(t("customer").select("c_custkey", parent.alias("parent")), "c_custkey", "parent", 16)


@query(
    "unambiguous_match",
    "SELECT k, min(v) AS c_custkey FROM (SELECT c_nationkey || '/' || (c_custkey % 200) AS k, c_custkey AS v FROM customer) GROUP BY k HAVING count(DISTINCT v) = 1",
)
def unambiguous_match(t):
    """Keys that a single customer answers to."""
    rows = t("customer").select(F.concat_ws("/", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 200).cast("string")).alias("k"), "c_custkey")
    return lineage.unambiguous(rows, "k", "c_custkey")


@query("semi_join", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(t):
    return t("customer").join(t("orders").filter("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("anti_join", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.09 AND l_quantity > 49) UNION ALL SELECT -1")
def anti_join(t):
    """Suppliers without a large discounted line, and a sentinel, so that the result is never empty."""
    found = t("supplier").join(t("lineitem").filter("l_discount > 0.09 AND l_quantity > 49"), F.col("l_suppkey") == F.col("s_suppkey"), "left_anti").select("s_suppkey")
    return found.union(t("supplier").sparkSession.range(1).select(F.lit(-1).cast("long")))


@query("union_distinct", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t("customer").select(F.col("c_nationkey").alias("nationkey")).union(t("supplier").select("s_nationkey")).distinct()


@query("intersect_except", "(SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 45")
def intersect_except(t):
    part = lambda where: t("lineitem").filter(where).select(F.col("l_partkey").alias("k"))
    return part("l_returnflag = 'R'").intersect(part("l_returnflag = 'A'")).subtract(part("l_returnflag = 'N' AND l_quantity > 45"))


@query(
    "routing_report",
    """SELECT o_orderpriority, o_orderstatus, count(*) AS spawns, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(avg((o_totalprice > 250000)::INT), 4) AS costly_rate, count(DISTINCT o_custkey) AS owners FROM orders GROUP BY 1, 2""",
)
def routing_report(t):
    """Outcomes by kind and state: counts, medians, rates."""
    return t("orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("spawns"), F.round(F.percentile("o_totalprice", 0.5), 4).alias("p50"), F.round(F.avg((F.col("o_totalprice") > 250000).cast("int")), 4).alias("costly_rate"), F.countDistinct("o_custkey").alias("owners"))


@query(
    "agent_commit_quality_weekly",
    """SELECT date_trunc('week', o_orderdate)::TIMESTAMP AS week, count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 4) AS ok_rate, round(sum(o_totalprice) / nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0), 4) AS per_open FROM orders GROUP BY 1""",
)
def agent_commit_quality_weekly(t):
    week = F.date_trunc("week", "o_orderdate").cast("timestamp_ntz").alias("week")
    return t("orders").groupBy(week).agg(F.count("*").alias("n"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 4).alias("ok_rate"), F.round(F.sum("o_totalprice") / F.nullif(F.count_if(F.col("o_orderstatus") == "P"), F.lit(0)), 4).alias("per_open"))


@query(
    "loop_health_interval_share",
    """WITH b AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders GROUP BY 1), l AS (SELECT o_custkey, o_orderdate AS s, o_orderdate + INTERVAL 90 DAY AS e FROM orders)
    SELECT l.o_custkey, sum(greatest(0, date_diff('day', greatest(s, TIMESTAMP '1997-01-01'), least(e, z))))::BIGINT AS clipped_days FROM l JOIN b USING (o_custkey) GROUP BY 1""",
)
def loop_health_interval_share(t):
    """Days of intervals clipped to a window: from 1997 to the owner's last order."""
    o = t("orders").select("o_custkey", "o_orderdate")
    z = F.max("o_orderdate").over(Window.partitionBy("o_custkey"))
    begin = F.greatest(F.col("o_orderdate"), F.lit("1997-01-01").cast("timestamp_ntz"))
    end = F.least(F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"), z)
    return o.select("o_custkey", F.greatest(F.lit(0), F.date_diff(end, begin)).alias("d")).groupBy("o_custkey").agg(F.sum("d").alias("clipped_days"))


@query(
    "who_touched",
    "SELECT p_name, count(*) AS touches, max(l_shipdate) AS last_touch FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_name LIKE 'red%' GROUP BY 1",
)
def who_touched(t):
    """Touches of everything below a prefix; the prefix is pushed to the scan."""
    parts = t("part").filter(F.col("p_name").startswith("red")).select("p_partkey", "p_name")
    lines = t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.max("l_shipdate").alias("d"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_name").agg(F.sum("n").alias("touches"), F.max("d").alias("last_touch"))
