"""Names derived from URLs, paths and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def remote_slug(url: Column) -> Column:
    """host/owner/name in lower case from an https, ssh or scp-like remote; null if nothing is left."""
    bare = F.regexp_replace(url, r"(\.git)?/*$", "")
    host_first = F.regexp_replace(bare, r"^(?:[a-z+]+://)?(?:[^@/]+@)?([^:/]+)(?::[0-9]+)?[:/]+", "$1/")
    return F.nullif(F.lower(host_first), F.lit(""))


def canonical_repo(slug: Column, aliases: dict[str, str] | None = None) -> Column:
    """owner/name in lower case, without the host, then by the map of transferred repositories."""
    parts = F.split(slug, "/")
    name = F.lower(F.when(F.size(F.filter(parts, lambda p: p != "")) == 3, F.array_join(F.slice(parts, 2, 2), "/")).otherwise(slug))
    if not aliases:
        return name
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), name)


def project_of(cwd: Column) -> Column:
    """The checkout below a /repos/ folder, else the last folder, else (none)."""
    below = F.nullif(F.regexp_extract(cwd, "/repos/([^/]+)", 1), F.lit(""))
    return F.coalesce(below, F.nullif(F.element_at(F.split(cwd, "/"), -1), F.lit("")), F.lit("(none)"))


def feature_key(name: Column) -> Column:
    """Lower case, no leading slash, runs of other characters than letters, digits and hyphen as one underscore."""
    return F.regexp_replace(F.lower(F.ltrim(name, F.lit("/"))), "[^a-z0-9-]+", "_")


def repo_root(path: Column) -> Column:
    """The checkout that a path lies in: a worktree of an agent, a repos checkout, or the agent's own home; else null."""
    home = r"/(?:Users|home)/[^/]+/"
    shapes = [
        rf"^({home}\.codex[^/]*/worktrees/[^/]+/[^/]+)",
        rf"^({home}repos/[^/]+/\.claude/worktrees/[^/]+)",
        rf"^({home}repos/[^/]+)",
        rf"^({home}\.(?:claude|codex)[^/]*)(?:/|$)",
    ]
    return F.coalesce(*[F.nullif(F.regexp_extract(path, s, 1), F.lit("")) for s in shapes])


def repo_name(root: Column) -> Column:
    """The name of the checkout, for a worktree that of its base."""
    return F.element_at(F.split(F.regexp_replace(root, r"/\.claude/worktrees/[^/]+$", ""), "/"), -1)


def task_mentions(text: Column, pad: int = 0) -> Column:
    """Distinct task keys (PREFIX-number) of a text, sorted; numbers are padded with zeros to a width."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])([A-Z][A-Z]+-[0-9]+)(?![\p{L}\p{N}_])"), F.lit(1))
    number = lambda k: F.regexp_replace(F.substring_index(k, "-", -1), "^0+(?=[0-9])", "")
    return F.array_sort(F.array_distinct(F.transform(found, lambda k: F.concat(F.substring_index(k, "-", 1), F.lit("-"), F.lpad(number(k), F.greatest(F.length(number(k)), F.lit(pad)), F.lit("0"))))))
