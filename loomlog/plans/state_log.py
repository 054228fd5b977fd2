"""State logs of runs: strict checks of every line, cohorts of copies that tell the same run, conflicts between them, outcomes.

A log is kept in several copies (copy_id). A copy counts if all its lines are in order: blank lines and a torn last object are passed over,
any other line is a frame (FRAME) whose body fits its kind's SCHEMA, frames are numbered 1, 2, 3, ..., and exactly one opens the run.
Copies that open the same run at the same time are a cohort; what they tell at one number must be equal. A kind that is in conflict
leaves what is counted from it unknown. Checks are column expressions on each line and partial aggregates by copy and run, so the
result doesn't depend on how lines are dealt to tasks; only the numbering looks at a copy's lines in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What each kind of frame holds: required and optional members with their types. str: not empty; a tuple: one of these
# words; ? lets it be null; owned: a str or a list; artifact: an absolute path; review: null or an object of a bool and two ints.
TIER = ("routine", "guarded")
SCHEMA = {
    "open": ({"goal_sha256": "str", "tier": TIER, "root": ("llm", "dispatcher"), "root_model": "str", "envelope": "list"}, {}),
    "admit": ({"task": "str", "source": ("envelope", "loop-created"), "owned": "owned", "accept": "str"}, {"tier": TIER, "surfaces": "list"}),
    "dispatch": (
        {"lane": "str", "task": "str", "agent": "str", "run": "str", "base": "str"},
        {"deadline": "str", "model": "str", "effort": "str", "surface": "str", "tier": TIER, "tasks": "list", "kind": ("work", "gate", "triage", "review"), "recovery_of": "str"},
    ),
    "return": (
        {"lane": "str", "run": "str", "status": ("complete", "partial", "blocked", "failed")},
        {"sha": "str?", "landed": "bool", "check": "str", "exit": "int?", "ci": "str?", "coderabbit": "review", "base": "str", "questions": "list", "artifact": "artifact"},
    ),
    "gate": ({"scope": ("lane", "composed"), "sha": "str", "cmd": "str", "exit": "int?"}, {"lane": "str", "base": "str"}),
    "accept": ({"task": "str", "accepted": "bool", "reason": "str"}, {"lane": "str"}),
    "park": ({"task": "str", "reason": "str", "needs": ("owner", "authority", "evidence-later", "dependency", "defect", "budget")}, {"lane": "str", "until": "str"}),
    "land": ({"task": "str", "sha": "str", "gate": "str", "mode": ("after-green", "pre-green")}, {"lane": "str", "ci": "str"}),
    "revert": ({"sha": "str", "reverted_by": "str", "reason": ("ci-red", "ci-timeout", "composed-red", "root-decision")}, {"task": "str"}),
    "watch": ({"op": ("start", "stop"), "what": "str", "deadline": "str"}, {}),
    "heartbeat": ({"at": "str"}, {}),
    "judgement": ({"text": "str"}, {"task": "str", "lane": "str"}),
    "close": ({"reason": ("nothing-admissible", "owner-stop", "blocked", "budget")}, {}),
}
FRAME, ACTORS = ("ev", "v", "seq", "ts", "by"), ("root", "dispatcher", "ext", "daemon")
#: Bytes of a judgement's text.
MOST_TEXT = 4096


def _type(path: str) -> Column:
    """The JSON type at a path: STRING, BIGINT, BOOLEAN, ARRAY<...>, OBJECT<...>, VOID for null; SQL's null if there is nothing."""
    return F.schema_of_variant(F.expr(f"try_variant_get(doc, '$.{path}', 'variant')"))


_TYPES = {
    "str": "STRING", "str?": "(?:VOID|STRING)", "int": "BIGINT", "int?": "(?:VOID|BIGINT)", "bool": "BOOLEAN", "artifact": "STRING", "list": "ARRAY<(?:STRING|VOID)>", "owned": "(?:STRING|ARRAY<(?:STRING|VOID)>)", "review": "(?:VOID|REVIEW)",
}
_FRAME_TYPES = {"ev": "STRING", "v": "BIGINT", "seq": "BIGINT", "ts": "STRING", "by": "STRING"}


def _shapes() -> str:
    """A pattern of a kind, a space, and its members in order with their types, each with a comma: what a frame may hold."""
    shapes = []
    for ev, (required, optional) in SCHEMA.items():
        kinds = required | optional
        types = {n: "STRING" if isinstance(k, tuple) else _TYPES[k] for n, k in kinds.items()} | _FRAME_TYPES
        members = [f"{n}: {types[n]}, " for n in sorted(types)]
        if ev != "heartbeat":
            shapes.append(f"{ev} " + "".join(f"(?:{m})?" if n in optional else m for n, m in zip(sorted(types), members, strict=True)))
    return rf"\A(?:{'|'.join(shapes)})\z"


def _allowed_words() -> Column:
    """Whether each member that takes one of some words has one, as far as it is there."""
    given: dict = {}
    for ev, (required, optional) in SCHEMA.items():
        for name, kind in (required | optional).items():
            given.setdefault(name, {}).setdefault(kind if isinstance(kind, tuple) else None, []).append(ev)
    fits = F.lit(True)
    for name, by_words in given.items():
        for words, kinds in by_words.items():
            if words:
                good = F.coalesce(F.col("m")[name].isin(*words), F.lit(True))
                fits = fits & (good if len(by_words) == 1 else ~F.col("ev").isin(*kinds) | good)
    return fits


def _body_fits() -> Column:
    """Whether the members of a frame (doc, its type, its members' texts m) are those of its kind. A heartbeat's own time is judged where it
    is used.

    The variant's type tells all members in order, so one pattern checks names and types; a review's own type is put out of the way first.
    """
    review = _type("coderabbit")
    is_review = F.coalesce(review.startswith("OBJECT"), F.lit(False))
    members = F.concat(F.expr("substring(type, 8, length(type) - 8)"), F.lit(", "))
    members = F.when(is_review, F.replace(members, F.concat(F.lit("coderabbit: "), review, F.lit(", ")), F.lit("coderabbit: REVIEW, "))).otherwise(members)
    reviewed = F.coalesce((_type("coderabbit.ran") == "BOOLEAN") & (_type("coderabbit.major") == "BIGINT") & (_type("coderabbit.unreviewed") == "BIGINT"), F.lit(False))
    fits = F.concat("ev", F.lit(" "), members).rlike(_shapes()) & ~F.coalesce(F.exists(F.map_values("m"), lambda x: x == ""), F.lit(False)) & _allowed_words() & (~is_review | reviewed)
    for name in sorted({n for kinds in SCHEMA.values() for part in kinds for n, kind in part.items() if kind == "list"}):
        holes = F.exists(F.expr(f"try_variant_get(doc, '$.{name}', 'array<string>')"), lambda x: x.isNull())
        fits = fits & ~(F.coalesce(F.col("m")[name].contains("null"), F.lit(False)) & F.coalesce(holes, F.lit(False)))
    path = F.col("m")["artifact"]
    fits = fits & F.coalesce(path.startswith("/") & ~path.contains("\0"), F.lit(True)) & ((F.col("ev") != "judgement") | (F.octet_length(F.col("m")["text"]) <= MOST_TEXT))
    beat = F.size(F.array_except(F.map_keys("m"), F.array(*[F.lit(n) for n in (*SCHEMA["heartbeat"][0], *FRAME)]))) == 0
    return F.coalesce(F.when(F.col("ev") == "heartbeat", beat).when(F.col("ev").isin(*SCHEMA), fits), F.lit(False))


def frames(lines: DataFrame) -> DataFrame:
    """lines (copy_id, line_no, raw) that count, with ev, seq, at, by, task, their members by name, and issue: null, malformed,
    not_object, framing, order, goal or schema. Rows of a null copy_id or raw count for nothing.

    A line is read and checked by itself where it is; only what is found is sorted to number a copy's lines.
    """
    given = lines.filter("copy_id IS NOT NULL").select("copy_id", "line_no", F.btrim("raw", F.lit(" \t\r\n")).alias("raw"))
    parsed = given.withColumn("doc", F.try_parse_json("raw")).withColumn("type", F.schema_of_variant("doc"))
    own = parsed.withColumn("m", F.when(F.col("type").startswith("OBJECT"), F.expr("try_variant_get(doc, '$', 'map<string,string>')")))
    torn = F.col("doc").isNull() & F.col("raw").startswith("{") & ~F.col("raw").endswith("}")
    # filtered after the numbering: a filter here would go below what it looks at, and make and parse every line once more
    counts = F.coalesce((F.col("raw") != "") & ~torn, F.lit(False))
    member = lambda name: F.col("m")[name]
    told = own.withColumns({"ev": member("ev"), "seq": F.expr("try_variant_get(doc, '$.seq', 'bigint')"), "at": F.try_to_timestamp(member("ts"), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))})
    framed = (_type("v") == "BIGINT") & (member("v") == "1") & (_type("seq") == "BIGINT") & member("by").isin(*ACTORS) & (_type("ts") == "STRING") & member("ts").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$") & F.col("at").isNotNull() & (_type("ev") == "STRING") & (F.col("ev") != "")
    goal = member("goal_sha256")
    early = F.when(F.col("doc").isNull(), "malformed").when(F.col("m").isNull(), "not_object").when(~F.coalesce(framed, F.lit(False)), "framing")
    late = F.when((F.col("ev") == "open") & ~F.coalesce(goal.rlike("^[0-9a-f]{64}$"), F.lit(False)), "goal").when(~_body_fits(), "schema")
    checked = told.select(
        "copy_id", "line_no", "ev", "seq", "at", member("by").alias("by"), member("task").alias("task"), goal.alias("goal"), member("reason").alias("reason"), (member("accepted") == "true").alias("accepted"), F.to_json("doc").alias("body"), early.alias("early"), late.alias("late"), counts.alias("counts")
    )
    place = F.count_if("counts").over(Window.partitionBy("copy_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = checked.withColumn("place", place).filter("counts")
    return numbered.withColumn("issue", F.coalesce("early", F.when(F.col("seq") != F.col("place"), "order"), "late")).drop("early", "late", "place", "counts")


def copies(rows: DataFrame) -> DataFrame:
    """One row a copy of frames(): the goal, time and number it opens with, how many frames, and why it is rejected (its first issue, two opens,
    or none), with the line."""
    opens = F.col("ev") == "open"
    found = rows.groupBy("copy_id").agg(
        F.min(F.when(F.col("issue").isNotNull(), F.struct("line_no", "issue"))).alias("first"), F.count_if(opens).alias("opens"), F.min_by(F.struct("goal", "at", "seq"), F.when(opens, F.col("line_no"))).alias("o"), F.count("*").alias("frames"), F.max(F.when(opens, F.col("line_no"))).alias("again")
    )
    why = F.coalesce("first.issue", F.when(F.col("opens") > 1, "second_open").when(F.col("opens") == 0, "no_open"))
    return found.select("copy_id", F.col("o.goal").alias("goal"), F.col("o.at").alias("opened_at"), "frames", why.alias("rejected"), F.coalesce("first.line_no", F.when(F.col("opens") > 1, F.col("again"))).alias("line_no"), F.col("o.seq").alias("opened_seq"))


def _told(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """The frames of copies that count, each once a cohort."""
    good = judged.filter("rejected IS NULL").select("copy_id", "goal", "opened_at")
    return rows.drop("goal").join(good, "copy_id").groupBy("goal", "opened_at", "seq", "ev", "body").agg(F.first("at").alias("at"), F.first("by").alias("by"), F.first("task").alias("task"), F.first("reason").alias("reason"), F.first("accepted").alias("accepted"))


def _by_number(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """(goal, opened_at, seq, kinds, versions, told): what the copies of a cohort tell at each number, once each."""
    entry = F.struct("ev", "at", "by", "task", "reason", "accepted")
    return _told(rows, judged).groupBy("goal", "opened_at", "seq").agg(F.array_sort(F.collect_set("ev")).alias("kinds"), F.count("*").alias("versions"), F.collect_list(entry).alias("told"))


def conflicts(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """(goal, opened_at, seq, kinds, versions): numbers at which copies of one cohort differ, with the kinds of all they tell."""
    return _by_number(rows, judged).drop("told").filter("versions > 1")


def outcomes(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """One row a cohort: distinct tasks admitted and landed, tasks whose last word is accepted, parks, dispatches, and the first close by
    its root after the open. What a kind in conflict tells is null. Rejected copies of the same run are counted.

    All of it comes from one pass over the frames: by number (conflicts), then by task, then by cohort.
    """
    key = ["goal", "opened_at"]
    sizes = judged.filter("opened_at IS NOT NULL").groupBy(*key).agg(F.count_if(F.col("rejected").isNull()).alias("copies"), F.count_if(F.col("rejected").isNotNull()).alias("rejected_copies"), F.max(F.when(F.col("rejected").isNull(), F.col("opened_seq"))).alias("opened_seq"))
    is_ = lambda ev: F.col("ev") == ev
    numbered = _by_number(rows, judged).select(*key, "seq", F.when(F.col("versions") > 1, F.col("kinds")).alias("bad"), F.inline("told"))
    sized = numbered.join(sizes.select(*key, "opened_seq"), key)
    ended = is_("close") & F.col("by").isin("root", "dispatcher") & (F.col("seq") > F.col("opened_seq"))
    by_task = sized.groupBy(*key, "task").agg(
        F.bool_or(is_("admit")).alias("admit"), F.bool_or(is_("land")).alias("land"), F.max_by("accepted", F.when(is_("accept"), F.col("seq"))).alias("ok"), F.count_if(is_("park")).alias("park"), F.count_if(is_("dispatch")).alias("dispatch"),
        F.min(F.when(ended, F.struct("seq", "at", "reason"))).alias("close"), F.array_distinct(F.flatten(F.collect_set("bad"))).alias("bad"),
    )
    named = lambda c: F.count_if(F.col(c) & F.col("task").isNotNull()).alias(c)
    facts = by_task.groupBy(*key).agg(named("admit"), named("land"), F.count_if("ok").alias("accept"), F.sum("park").alias("park"), F.sum("dispatch").alias("dispatch"), F.min("close").alias("close"), F.array_distinct(F.flatten(F.collect_set("bad"))).alias("bad"))
    met = facts.join(sizes.drop("opened_seq"), key)
    sure = lambda ev, value: F.when(~F.array_contains("bad", ev), value)
    return met.select(
        *key, "copies", "rejected_copies", sure("admit", F.col("admit")).alias("tasks_admitted"), sure("land", F.col("land")).alias("tasks_landed"), sure("accept", F.col("accept")).alias("tasks_accepted"), sure("park", F.col("park")).alias("parks"),
        sure("dispatch", F.col("dispatch")).alias("dispatches"), sure("close", F.col("close.at")).alias("closed_at"), sure("close", F.col("close.reason")).alias("close_reason"),
    )
