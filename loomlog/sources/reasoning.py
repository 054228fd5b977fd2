"""Reasoning that one harness writes in pieces and again as an item, told once.

Its logs hold a thought as events, one a part and before or after the item, as a completed item, and as an item whose own text may be
encrypted. Parts wait for the next item of their turn, which takes what it doesn't tell itself; another item or the turn's end lets them
stand by themselves, where the first part was. What tells nothing beyond the last thought of the same turn is a repeat.

What a record is to this is told by column expressions; other records are left out. The fold streams through a file's few records
in their order, holding the parts that wait and the last thought.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTPUT = "path string, byte_offset long, ts timestamp, turn_id string, text string, source string, summary_parts int, raw_parts int"


def _parts(json: Column) -> Column:
    """The texts of a JSON string, or of an array of strings or of objects with a text, without blank ones."""
    strings = F.from_json(json, "array<string>")
    texts = F.transform(strings, lambda x: F.coalesce(F.get_json_object(x, "$.text"), F.when(~F.ltrim(x).startswith("{"), x)))
    found = F.when(F.ltrim(json).startswith("["), texts).otherwise(F.array(json))
    return F.filter(found, lambda x: x.isNotNull() & (F.trim(x) != ""))


def records(lines: DataFrame) -> DataFrame:
    """(path, byte_offset, ts, kind, turn_id, source, summary, raw): parts, items, other items (other) and ends of turns (turn)."""
    j = lambda path: F.get_json_object("raw", f"$.{path}")
    p = lambda path: j(f"payload.{path}")
    top, kind = j("type"), p("type")
    event, item, done = top == "event_msg", top == "response_item", (top == "event_msg") & (kind == "item_completed") & (p("item.type") == "Reasoning")
    what = (
        F.when(item & (kind == "reasoning"), "item").when(done | (event & kind.isin("agent_reasoning", "agent_reasoning_raw_content")), "part")
        .when((top == "turn_context") | (event & kind.isin("task_started", "task_complete", "turn_aborted")), "turn").when(item, "other")
    )
    none = F.array().cast("array<string>")
    summary = F.when(item, _parts(p("summary"))).when(done, _parts(p("item.summary_text"))).when(kind == "agent_reasoning", _parts(p("text")))
    raw = F.when(item, _parts(p("content"))).when(done, _parts(p("item.raw_content"))).when(kind == "agent_reasoning_raw_content", _parts(p("text")))
    source = F.when(item, "response_item").when(done, "item_completed").otherwise("event_msg")
    rows = lines.select("path", "byte_offset", F.try_to_timestamp(j("timestamp")).alias("ts"), what.alias("kind"), p("turn_id").alias("turn_id"), source.alias("source"), F.coalesce(summary, none).alias("summary"), F.coalesce(raw, none).alias("raw_parts_"))
    return rows.filter("kind IS NOT NULL")


class _Thoughts:
    """One file's fold."""

    def __init__(self, path: str):
        self.path, self.turn, self.held, self.last, self.out = path, None, None, None, []

    def repeats(self, parts: list[str], turn: str | None) -> bool:
        return self.last is not None and self.last[0] == turn and set(parts) <= self.last[1]

    def tell(self, summary: list[str], raw: list[str], source: str, at, ts, turn: str | None) -> None:
        if (summary or raw) and not self.repeats(summary + raw, turn):
            self.last = turn, set(summary + raw)
            self.out.append((self.path, at, ts, turn, "\n\n".join(summary + raw), source, len(summary), len(raw)))

    def flush(self) -> None:
        if self.held is not None:
            held, self.held = self.held, None
            self.tell(held["summary"], held["raw"], held["source"], held["at"], held["ts"], held["turn"])

    def step(self, r) -> None:
        summary, raw = list(r.summary), list(r.raw_parts_)
        if r.kind == "turn":
            self.flush()
            self.turn = r.turn_id if r.turn_id is not None else self.turn
        elif r.kind == "other":
            self.flush()
        elif r.kind == "part":
            if not (summary or raw) or self.repeats(summary + raw, self.turn):
                return
            if self.held is None:
                self.held = {"summary": [], "raw": [], "source": r.source, "at": r.byte_offset, "ts": r.ts, "turn": self.turn}
            for name, parts in (("summary", summary), ("raw", raw)):
                self.held[name] += [x for x in dict.fromkeys(parts) if x not in self.held[name]]
        else:
            held, self.held = self.held, None
            source = "response_item" if held is None or summary or (raw and not held["summary"]) else held["source"]
            self.tell(summary or (held["summary"] if held else []), raw or (held["raw"] if held else []), source, r.byte_offset, r.ts, self.turn)


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    thoughts = None
    for frame in frames:
        for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
            if thoughts is None or thoughts.path != r.path:
                if thoughts is not None:
                    thoughts.flush()
                    yield pd.DataFrame(thoughts.out, columns=names)
                thoughts = _Thoughts(r.path)
            thoughts.step(r)
        if thoughts is not None:
            yield pd.DataFrame(thoughts.out, columns=names)
            thoughts.out = []
    if thoughts is not None:
        thoughts.flush()
        yield pd.DataFrame(thoughts.out, columns=names)


def reasoning(lines: DataFrame) -> DataFrame:
    """One row (OUTPUT) a thought of the lines (path, byte_offset, raw) of one harness: the parts of its summary, then the raw ones.
    Lines that aren't JSON count for nothing; items that tell nothing (encrypted alone, without parts) have no row."""
    return records(lines).repartition("path").sortWithinPartitions("path", "byte_offset").mapInPandas(_fold, OUTPUT)
