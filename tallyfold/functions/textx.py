"""Text cleaning, tokenising and stemming as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the symbols that cleaning turns into a space (``+`` to ``/`` is a
# contiguous run, so comma, hyphen and full stop are included; a backslash is not).
SYMBOLS = r"[#$%&()*+,\-./<=>?@\[\]^_`{|}~]+"
TOKEN = r"[\p{L}\p{N}_]{2,}"


def clean_text(text: str | Column) -> Column:
    """Runs of symbols become one space, then white space collapses."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.regexp_replace(c, SYMBOLS, " "), r"\s+", " ")


def tokens(text: str | Column, lower: bool = True) -> Column:
    """Tokens of two or more word characters."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.lower(c) if lower else c
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def word_count(text: str | Column) -> Column:
    """Number of white-space separated words; an empty text has none."""
    return F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"\S+"))


# Porter (1980) word shapes: [C](VC)^m[V], y being a vowel after a consonant.
_CONS = "[^aeiou][^aeiouy]*"
_VOWEL = "[aeiouy][aeiou]*"
MEASURE_GT_0 = f"^({_CONS})?{_VOWEL}{_CONS}"
MEASURE_EQ_1 = f"^({_CONS})?{_VOWEL}{_CONS}({_VOWEL})?$"
MEASURE_GT_1 = f"^({_CONS})?{_VOWEL}{_CONS}{_VOWEL}{_CONS}"
HAS_VOWEL = f"^({_CONS})?[aeiouy]"
ENDS_CVC = f"^{_CONS}[aeiouy][^aeiouwxy]$"
DOUBLE_CONS = r"([^aeiouylsz])\1$"

# The published suffix tables of steps 2, 3 and 4.
STEP2 = (
    "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous "
    "ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
)
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def suffix_table(text: str) -> list[tuple[str, str]]:
    """``suffix:replacement`` pairs, longest suffix first (the longest match decides)."""
    pairs = [tuple(item.split(":")) if ":" in item else (item, "") for item in text.split()]
    return sorted(pairs, key=lambda pair: -len(pair[0]))


def _without(w: Column, suffix: str) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - len(suffix)) if suffix else w


def _swap(w: Column, table: list[tuple[str, str]], measure: str) -> Column:
    """Replace the longest listed suffix when the rest of the word is long enough."""
    # the shortest possible rest belongs to the longest suffix
    pattern = f"^(.*?)({'|'.join(suffix for suffix, _ in table)})$"
    stem, suffix = F.regexp_extract(w, pattern, 1), F.regexp_extract(w, pattern, 2)
    new = F.element_at(F.create_map(*[F.lit(part) for pair in table for part in pair]), suffix)
    ok = stem.rlike(measure)
    if measure == MEASURE_GT_1:
        ok = ok & ((suffix != "ion") | stem.rlike("[st]$"))
    return F.when((suffix != "") & ok, F.concat(stem, new)).otherwise(w)


def porter_steps() -> list:
    """The stemmer as a list of Column -> Column steps, to be applied one select each."""

    def mark_y(w: Column) -> Column:
        # a leading y is a consonant
        return F.regexp_replace(w, "^y", "Y")

    def step1a(w: Column) -> Column:
        return (
            F.when(w.endswith("sses") | w.endswith("ies"), _without(w, "es"))
            .when(w.endswith("ss"), w)
            .when(w.endswith("s"), _without(w, "s"))
            .otherwise(w)
        )

    def step1b(w: Column) -> Column:
        # a dropped -ed / -ing leaves a marker for the repair step
        ed, ing = _without(w, "ed"), _without(w, "ing")
        return (
            F.when(w.endswith("eed"), F.when(_without(w, "eed").rlike(MEASURE_GT_0), _without(w, "d")).otherwise(w))
            .when(w.endswith("ed") & ed.rlike(HAS_VOWEL), F.concat(ed, F.lit("|")))
            .when(w.endswith("ing") & ing.rlike(HAS_VOWEL), F.concat(ing, F.lit("|")))
            .otherwise(w)
        )

    def step1b_repair(w: Column) -> Column:
        stem = _without(w, "|")
        fixed = (
            F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e")))
            .when(stem.rlike(DOUBLE_CONS), _without(stem, "x"))
            .when(stem.rlike(ENDS_CVC), F.concat(stem, F.lit("e")))
            .otherwise(stem)
        )
        return F.when(w.endswith("|"), fixed).otherwise(w)

    def step1c(w: Column) -> Column:
        stem = _without(w, "y")
        return F.when(w.endswith("y") & stem.rlike(HAS_VOWEL), F.concat(stem, F.lit("i"))).otherwise(w)

    def step2(w: Column) -> Column:
        return _swap(w, suffix_table(STEP2), MEASURE_GT_0)

    def step3(w: Column) -> Column:
        return _swap(w, suffix_table(STEP3), MEASURE_GT_0)

    def step4(w: Column) -> Column:
        return _swap(w, suffix_table(STEP4), MEASURE_GT_1)

    def step5a(w: Column) -> Column:
        stem = _without(w, "e")
        ok = stem.rlike(MEASURE_GT_1) | (stem.rlike(MEASURE_EQ_1) & ~stem.rlike(ENDS_CVC))
        return F.when(w.endswith("e") & ok, stem).otherwise(w)

    def step5b(w: Column) -> Column:
        return F.when(w.endswith("ll") & w.rlike(MEASURE_GT_1), _without(w, "l")).otherwise(w)

    def unmark_y(w: Column) -> Column:
        return F.lower(w)

    return [mark_y, step1a, step1b, step1b_repair, step1c, step2, step3, step4, step5a, step5b, unmark_y]
