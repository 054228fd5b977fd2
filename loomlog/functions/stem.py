"""English stems by Porter's algorithm (1980), each step a column expression over an array of terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomlog.operators.search import plain_tokens

# Consonant and vowel runs; y is a vowel after a consonant. A first y counts as a consonant and is written Y meanwhile.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_ONE_OR_MORE, _TWO_OR_MORE, _JUST_ONE = f"^(?:{_C})?{_V}{_C}", f"^(?:{_C})?{_V}{_C}{_V}{_C}", f"^(?:{_C})?{_V}{_C}(?:{_V})?$"
_HAS_VOWEL, _SHORT_END = f"^(?:{_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"

# The suffixes of the second, third and fourth step, and what the first two become.
_SECOND = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log".split())
_THIRD = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_FOURTH = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _parts(term: Column, suffixes) -> tuple[Column, Column]:
    """What is before the longest of the suffixes that the term ends with, and that suffix ('' and '' if it has none)."""
    pattern = "^(.+?)(" + "|".join(suffixes) + ")$"
    return F.regexp_extract(term, pattern, 1), F.regexp_extract(term, pattern, 2)


def _begin(t: Column) -> Column:
    return F.regexp_replace(t, "^y", "Y")


def _plural(t: Column) -> Column:
    return F.when(t.rlike("^.+(ss|i)es$"), F.regexp_replace(t, "es$", "")).when(t.rlike("^.+[^s]s$"), F.regexp_replace(t, "s$", "")).otherwise(t)


def _past(t: Column) -> Column:
    """Marks a removed -ed or -ing by a closing +, which the next step takes away."""
    eed = F.regexp_extract(t, "^(.+?)eed$", 1)
    rest, _ = _parts(t, ("ed", "ing"))
    return F.when(t.rlike("^.+eed$"), F.when(eed.rlike(_ONE_OR_MORE), F.regexp_replace(t, "d$", "")).otherwise(t)).when((rest != "") & rest.rlike(_HAS_VOWEL), F.concat(rest, F.lit("+"))).otherwise(t)


def _repaired(t: Column) -> Column:
    bare = F.regexp_replace(t, r"\+$", "")
    fixed = F.when(bare.rlike("(at|bl|iz)$"), F.concat(bare, F.lit("e"))).when(bare.rlike(r"([^aeiouylsz])\1$"), F.regexp_replace(bare, ".$", "")).when(bare.rlike(_SHORT_END), F.concat(bare, F.lit("e"))).otherwise(bare)
    return F.when(t.endswith("+"), fixed).otherwise(t)


def _final_y(t: Column) -> Column:
    rest = F.regexp_extract(t, "^(.+)y$", 1)
    return F.when((rest != "") & rest.rlike(_HAS_VOWEL), F.concat(rest, F.lit("i"))).otherwise(t)


def _mapped(table: dict[str, str]):
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def step(t: Column) -> Column:
        rest, suffix = _parts(t, table)
        return F.when((suffix != "") & rest.rlike(_ONE_OR_MORE), F.concat(rest, F.try_element_at(known, suffix))).otherwise(t)

    return step


def _dropped(t: Column) -> Column:
    rest, suffix = _parts(t, _FOURTH)
    ion = F.regexp_extract(t, "^(.+?[st])ion$", 1)
    return F.when(suffix != "", F.when(rest.rlike(_TWO_OR_MORE), rest).otherwise(t)).when((ion != "") & ion.rlike(_TWO_OR_MORE), ion).otherwise(t)


def _final_e(t: Column) -> Column:
    rest = F.regexp_extract(t, "^(.+)e$", 1)
    return F.when((rest != "") & (rest.rlike(_TWO_OR_MORE) | (rest.rlike(_JUST_ONE) & ~rest.rlike(_SHORT_END))), rest).otherwise(t)


def _final_l(t: Column) -> Column:
    return F.regexp_replace(F.when(t.endswith("ll") & t.rlike(_TWO_OR_MORE), F.regexp_replace(t, "l$", "")).otherwise(t), "^Y", "y")


def _of_both(step):
    return lambda p: F.struct(p["t"].alias("t"), step(p["s"]).alias("s"))


def stems(terms: Column) -> Column:
    """The stems of an array of lower-case terms; terms of one or two letters, and those with other letters than a to z, stay."""
    plain = lambda t: t.rlike("^[a-z]{3,}$")
    pairs = F.transform(terms, lambda t: F.struct(t.alias("t"), F.when(plain(t), t).alias("s")))
    for step in (_begin, _plural, _past, _repaired, _final_y, _mapped(_SECOND), _mapped(_THIRD), _dropped, _final_e, _final_l):
        pairs = F.transform(pairs, _of_both(step))
    return F.transform(pairs, lambda p: F.coalesce(p["s"], p["t"]))


def stemmed_tokens(text: Column) -> Column:
    """Lower-case tokens as their stems."""
    return stems(plain_tokens(text))
