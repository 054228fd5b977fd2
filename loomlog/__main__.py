"""python -m loomlog COMMAND --logs claude=DIR --logs codex=DIR ...: questions to the session logs, as a table, CSV or JSON lines."""

from __future__ import annotations

import argparse
import csv
import io
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.operators import search
from loomlog.plans import sessions
from loomlog.session import session
from loomlog.sources import jsonl, logs, signals, transcripts

PRICES = "model string, effective_from date, input double, cached double, cache_write double, output double"


def _lines(spark: SparkSession, a) -> dict[str, DataFrame]:
    return {agent: jsonl.parsed(logs.log_lines(spark, folder)[0].filter("error IS NULL"))[0] for agent, folder in a.logs}


def _prices(spark: SparkSession, a) -> DataFrame:
    return spark.read.schema(PRICES).option("header", "true").csv(a.prices) if a.prices else spark.createDataFrame([], PRICES)


def _scope(a) -> dict:
    return {"since": a.since, "until": a.until, "agents": a.agents}


def _sessions(spark, t, a):
    rolled = sessions.rollup(t["sessions"], t["messages"], t["calls"], t["tool_calls"])
    return sessions.scoped(rolled, "last_ts", **_scope(a)).select("agent", "session_uid", "project", "first_ts", "last_ts", "prompts", "calls", "tool_calls", "tool_errors", "output_tokens", "active_seconds").orderBy(F.desc_nulls_last("last_ts"), "session_uid")


def _find(spark, t, a):
    given = sessions.scoped(t["messages"], **_scope(a))
    asked = spark.createDataFrame([(1, a.text)], "query_id int, query string")
    hits = search.bm25(given, "event_uid", "text", asked, search.code_tokens, a.mode).join(given.select("event_uid", "agent", "session_uid"), "event_uid")
    return hits.groupBy("agent", "session_uid").agg(F.count("*").alias("hits"), F.round(F.max("score") + F.log(1 + F.count("*")), 4).alias("score")).orderBy(F.desc("score"), "session_uid")


COMMANDS = {
    "sessions": _sessions,
    "find": _find,
    "tree": lambda s, t, a: sessions.session_tree(t["sessions"], sessions.rollup(t["sessions"], t["messages"], t["calls"], t["tool_calls"])).orderBy("root"),
    "cost": lambda s, t, a: sessions.cost_report(t["calls"], _prices(s, a), **_scope(a)).orderBy(F.asc_nulls_last("day"), F.asc_nulls_last("agent"), F.asc_nulls_last("model")),
    "tools": lambda s, t, a: sessions.tool_reliability(t["tool_calls"], **_scope(a)).orderBy("agent", "tool_name"),
    "failures": lambda s, t, a: sessions.with_failures(sessions.scoped(t["tool_calls"], **_scope(a))).filter("error_class IS NOT NULL").groupBy("agent", "tool_name", "error_class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "agent", "tool_name", "error_class"),
    "efficiency": lambda s, t, a: sessions.efficiency(t["calls"], t["tool_calls"], t["messages"]).orderBy("agent", "session_uid"),
    "timeline": lambda s, t, a: sessions.timeline(t["messages"], t["tool_calls"], t["calls"], a.text or "", a.limit).select("ts", "kind", "what"),
    "census": None,
}


def shown(df: DataFrame, form: str, limit: int) -> str:
    """At most limit rows, as text."""
    rows, names = df.limit(limit).collect(), df.columns
    plain = [["" if v is None else str(v) for v in r] for r in rows]
    if form == "json":
        return "".join(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False) + "\n" for r in rows)
    if form == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([names, *plain])
        return out.getvalue()
    cells = [[v.replace("\n", " ")[:80] for v in r] for r in [names, *plain]]
    widths = [max(map(len, column)) for column in zip(*cells, strict=True)]
    return "".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() + "\n" for r in cells)


def main(args: list[str], spark: SparkSession | None = None, out=sys.stdout) -> int:
    pair = lambda s: tuple(s.split("=", 1))
    p = argparse.ArgumentParser("loomlog", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("text", nargs="?", help="words to find, or a session's id")
    p.add_argument("--logs", action="append", type=pair, required=True, metavar="HARNESS=DIR", help=f"harness: {', '.join(transcripts.PARSERS)}")
    p.add_argument("--agents", nargs="*")
    p.add_argument("--since")
    p.add_argument("--until")
    p.add_argument("--prices", help="CSV: model, effective_from, input, cached, cache_write, output")
    p.add_argument("--mode", choices=("any", "all"), default="any")
    p.add_argument("--format", choices=("table", "csv", "json"), default="table")
    p.add_argument("--limit", type=int, default=300)
    a = p.parse_args(args)
    spark = spark or session()
    lines = _lines(spark, a)
    if a.command == "census":
        found = None
        for agent, own in lines.items():
            part = signals.record_census(own).select(F.lit(agent).alias("agent"), "type", "subtype", "n")
            found = part if found is None else found.unionByName(part)
        found = found.orderBy("agent", "type", "subtype")
    else:
        found = COMMANDS[a.command](spark, transcripts.catalogue(lines), a)
    out.write(shown(found, a.format, a.limit))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
