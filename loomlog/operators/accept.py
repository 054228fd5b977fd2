"""Snapshots that are accepted or refused one after the other, each held against the last one that was accepted.

A producer writes snapshots of one thing (a running request) again and again, and they arrive late, twice or from another run of the
same name. What counts of a key is a fold over its rows in order of arrival, which no maximum or lag gives: whether a row is accepted
depends on which ones before it were.

* A row of another start, or that contradicts an identity column (both known, not equal), is ignored.
* Of the others, envelope columns fill what is still unknown, whether the row is accepted or not.
* A row is accepted if the one that counts is still active, and it was written later (or at the same time and is final), did not end
  before that one was written, and no counter is below its last accepted value (unknown ones pass). It is taken whole: nulls too.

So a final snapshot is never replaced. Rows are dealt by key and sorted by arrival; a task streams through them holding one row, so a
key of any number of rows needs no more memory than one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AcceptSpec:
    """Columns: the key, the order of arrival (a number or time, ties by all else as text), when a snapshot was written, started and
    ended, its state, counters that never fall, identity and envelope."""

    key: tuple[str, ...]
    order: str
    written: str
    started: str
    ended: str
    state: str
    counters: tuple[str, ...] = ()
    identity: tuple[str, ...] = ()
    envelope: tuple[str, ...] = ()
    active: str = "active"

    def concerns(self, old: dict, new: dict) -> bool:
        """Whether a row is of the same run as the one that counts."""
        if old[self.started] is None or old[self.started] != new[self.started]:
            return False
        return all(old[c] is None or new[c] is None or old[c] == new[c] for c in self.identity)

    def accepts(self, old: dict, new: dict) -> bool:
        known = lambda c: old[c] is not None and new[c] is not None
        if old[self.state] != self.active or not known(self.written):
            return False
        tie = old[self.written] == new[self.written]
        later = new[self.written] > old[self.written] or (tie and new[self.state] is not None and new[self.state] != self.active)
        in_time = new[self.ended] is None or new[self.ended] >= old[self.written]
        return later and in_time and all(new[c] >= old[c] for c in self.counters if known(c))

    def step(self, old: dict, new: dict) -> tuple[dict, bool, bool]:
        """(the row that counts now, whether the new one was accepted, whether it was ignored)."""
        if not self.concerns(old, new):
            return old, False, True
        kept = (*self.key, *self.envelope)
        taken = self.accepts(old, new)
        base = {**new, **{c: old[c] for c in kept}} if taken else dict(old)
        return base | {c: new[c] for c in self.envelope if old[c] is None}, taken, False


#: Columns that a fold adds: rows accepted after the first, refused, and ignored as another run's.
COUNTS = ("n_accepted", "n_refused", "n_ignored")


def _fold(spec: AcceptSpec, names: list[str], schema: pa.Schema | None = None):
    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, done = None, [0, 0, 0], []
        for batch in batches:
            for row in batch.select(names).to_pylist():
                if held is None or any(held[c] != row[c] for c in spec.key):
                    if held is not None:
                        done.append(held | dict(zip(COUNTS, counts, strict=True)))
                    held, counts = row, [0, 0, 0]
                    continue
                held, taken, ignored = spec.step(held, row)
                counts[0 if taken else 2 if ignored else 1] += 1
            kind = pa.schema([batch.schema.field(n) for n in names] + [(c, pa.int64()) for c in COUNTS])
            if done:
                yield pa.RecordBatch.from_pylist(done, kind)
                done = []
        if held is not None:
            yield pa.RecordBatch.from_pylist([held | dict(zip(COUNTS, counts, strict=True))], kind)

    return folded


def accept_fold(rows: DataFrame, spec: AcceptSpec) -> DataFrame:
    """One row a key, the one that counts, with COUNTS. Rows of a null key column are a key like any other; of null arrival come first.
    A key's first row counts as it is. An empty table gives none. Column names are told apart by case only if the session does so."""
    names = rows.columns
    tie = F.to_json(F.struct(*[c for c in names if c != spec.order]))
    dealt = rows.withColumn("_tie", tie).repartition(*spec.key).sortWithinPartitions(*spec.key, F.asc_nulls_first(spec.order), "_tie").drop("_tie")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", {c} long" for c in COUNTS)
    return dealt.mapInArrow(_fold(spec, names), schema)


def refreshed(table: DataFrame, batch: DataFrame, spec: AcceptSpec) -> DataFrame:
    """The table (rows that count, with COUNTS) after a batch of snapshots: what is stored came before what comes in. One refresh of
    everything and any split of it in order of arrival give the same."""
    counts = table.select(*spec.key, *[F.col(c).alias(f"_{c}") for c in COUNTS])
    first = F.struct(F.lit(0).alias("in"), F.lit(None).cast(dict(batch.dtypes)[spec.order]).alias("at"))
    old = table.drop(*COUNTS).withColumn("_at", first).select(*batch.columns, "_at")
    new = batch.withColumn("_at", F.struct(F.lit(1).alias("in"), F.col(spec.order).alias("at")))
    own = AcceptSpec(**(spec.__dict__ | {"order": "_at"}))
    done = accept_fold(old.unionByName(new), own).drop("_at")
    same = F.lit(True)
    for c in spec.key:
        same = same & done[c].eqNullSafe(counts[c])
    met = done.join(counts, same, "left")
    return met.select(*[done[c] for c in batch.columns], *[(done[c] + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in COUNTS])
