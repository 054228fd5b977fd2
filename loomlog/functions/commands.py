"""What a shell command does, as column expressions: its program, the machine it reaches, its git operations.

A command is read by its words, not parsed: quoted text is blanked first, so that what a message says isn't taken for a command.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words before a program that only change how it is run, and options of ssh that take a value.
WRAPPERS = ("sudo", "time", "nohup", "command", "exec", "env")
SSH_VALUES = "BbcDEeFIiJLlmOopQRSWw"
# git's subcommands that change history or its copies.
GIT_CHANGES = ("commit", "cherry-pick", "push", "merge", "revert", "rebase", "reset", "tag")


def unquoted(command: Column) -> Column:
    """The command with what stands in quotes left out; the quotes stay. A backslash keeps a quote from counting."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(command, r"\\.", "_"), r"'[^']*'", "''"), r'"[^"]*"', '""')


def simple_commands(command: Column) -> Column:
    """The parts between ;, &, | and line ends, trimmed, without assignments and wrappers before the program."""
    parts = F.transform(F.split(unquoted(command), r"&&|\|\|?|[;&\n]"), lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), r"^[({\s]+", ""), r"[)}\s]+$", ""))
    bare = F.transform(parts, lambda p: F.regexp_replace(p, rf"^(?:(?:[A-Za-z_][A-Za-z0-9_]*=\S*|{'|'.join(WRAPPERS)})\s+)+", ""))
    return F.filter(bare, lambda p: p != "")


def program(command: Column) -> Column:
    """The first simple command's program, without its folder; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.get(simple_commands(command), F.lit(0)), r"^(\S+)", 1), "^.*/", ""), F.lit(""))


def remote_host(command: Column) -> Column:
    """The machine that the first ssh, scp or rsync of the command reaches, without user; null where none is named."""
    ssh = F.filter(simple_commands(command), lambda p: p.rlike(r"^(?:\S*/)?ssh\s"))
    target = F.regexp_extract(F.get(ssh, F.lit(0)), rf"^\S+(?:\s+-[{SSH_VALUES}]\s+\S+|\s+-\S+)*\s+(?:[^\s@]+@)?([^\s-][^\s:]*)", 1)
    copy = F.filter(simple_commands(command), lambda p: p.rlike(r"^(?:\S*/)?(?:scp|rsync)\s"))
    place = F.regexp_extract(F.get(copy, F.lit(0)), r"\s(?:[^\s@:/]+@)?([A-Za-z0-9][A-Za-z0-9.-]*):(?!//)", 1)
    return F.coalesce(F.nullif(target, F.lit("")), F.nullif(place, F.lit("")))


def git_operations(command: Column) -> Column:
    """git's subcommands that change something, in order; a dry run isn't one."""
    runs = F.filter(simple_commands(command), lambda p: p.rlike(r"^(?:\S*/)?git\s") & ~p.rlike(r"\s(?:--dry-run|-n)(?:\s|$)"))
    verbs = F.transform(runs, lambda p: F.regexp_extract(p, r"^\S+(?:\s+-[Cc]\s+\S+|\s+--?[A-Za-z][^\s]*)*\s+([a-z][a-z-]*)", 1))
    return F.filter(verbs, lambda v: v.isin(*GIT_CHANGES))
