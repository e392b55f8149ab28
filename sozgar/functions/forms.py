"""Normal forms, suffix stripping, weighted distance, typos and flags of single words as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sozgar.functions.alphabet import (
    APOSTROPHE_COST,
    APOSTROPHES,
    CONFUSED_COST,
    ENGLISH_NOISE,
    FULL_COST,
    LONGEST_SUFFIX,
    MAX_DISTANCE,
    MIN_STEM,
    PARTNER,
    SHORT_WORDS,
    SUFFIXES,
    VOWELS,
)
from sozgar.functions.translit import col

VALID_WORD = "^[a-zA-ZʻʼoOgG']+$"
VALID_ENTRY = "^[a-zA-ZʻʼoOgG']{2,}$"


def straight(word: Column | str) -> Column:
    """Uzbek apostrophes as ASCII ones."""
    return F.translate(col(word), "ʻʼ", "''")


def normal(word: Column | str) -> Column:
    return straight(F.lower(col(word)))


def strippable(stem: Column, suffix: Column) -> Column:
    """Whether a suffix may be taken off: the stem keeps three letters, and a bare -i needs a consonant before it."""
    return (F.length(stem) >= MIN_STEM) & suffix.isin(SUFFIXES) & ~((suffix == "i") & F.right(stem, F.lit(1)).isin(list(VOWELS)))


def strip_suffix(word: Column | str) -> Column:
    """The word without its longest suffix, or as it is."""
    w = col(word)
    found = w
    for size in range(1, LONGEST_SUFFIX + 1):  # a longer suffix is asked first
        stem = F.left(w, F.length(w) - size)
        found = F.when(strippable(stem, F.right(w, F.lit(size))), stem).otherwise(found)
    return found


def iterative_strip(word: Column | str, passes: int = 3) -> Column:
    """All stems on the way, up to ``passes``. The passes are a fold, so the expression does not grow with them."""
    start = F.struct(col(word).alias("now"), F.array().cast("array<string>").alias("stems"))

    def step(state: Column, _: Column) -> Column:
        return F.element_at(
            F.transform(
                F.array(strip_suffix(state["now"])),
                lambda s: F.struct(s.alias("now"), F.when(s != state["now"], F.concat(state["stems"], F.array(s))).otherwise(state["stems"]).alias("stems")),
            ),
            1,
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), start, step, lambda s: s["stems"])


def _gap(char: Column) -> Column:
    return F.when(char.isin(list(APOSTROPHES)), APOSTROPHE_COST).otherwise(FULL_COST)


def _swap(a: Column, b: Column) -> Column:
    confused = [x + y for x, y in PARTNER.items()]
    both = a.isin(list(APOSTROPHES)) & b.isin(list(APOSTROPHES))
    return F.when((a == b) | both, 0).when(F.concat(a, b).isin(confused), CONFUSED_COST).otherwise(FULL_COST)


def weighted_tenths(left: Column | str, right: Column | str, cutoff: int = MAX_DISTANCE) -> Column:
    """Edit distance in tenths with cheap confusions and apostrophes; ``cutoff + 1`` if every way passes the cutoff before the left word ends.

    One row of the distance table per character of the left word, built by nested ``aggregate``.
    """
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    a, b = letters(col(left)), letters(col(right))
    first = F.aggregate(b, F.array(F.lit(0)), lambda row, y: F.concat(row, F.array(F.element_at(row, -1) + _gap(y))))

    def row(before: Column, x: Column) -> Column:
        cells = F.arrays_zip(b.alias("y"), F.slice(before, 1, F.size(b)).alias("slant"), F.slice(before, 2, F.size(b)).alias("above"))
        return F.aggregate(
            cells,
            F.array(F.element_at(before, 1) + _gap(x)),
            lambda now, c: F.concat(now, F.array(F.least(c["above"] + _gap(x), F.element_at(now, -1) + _gap(c["y"]), c["slant"] + _swap(x, c["y"])))),
        )

    last = F.aggregate(a, first, row)
    return F.when((F.size(a) > 0) & (F.array_min(last) > 10 * cutoff), 10 * (cutoff + 1)).otherwise(F.element_at(last, -1))


def weighted_distance(left: Column | str, right: Column | str, cutoff: int = MAX_DISTANCE) -> Column:
    return weighted_tenths(left, right, cutoff) / 10.0


def within(left: Column, right: Column, most: int) -> Column:
    """Whether the plain edit distance is ``most`` or less (the built-in function gives -1 beyond its limit)."""
    return F.levenshtein(left, right, most).between(0, most)


def phonetic_typo(word: Column | str) -> Column:
    """The first letter with a confusion partner swapped for it; null if there is none."""
    w = col(word)
    letters = "".join(PARTNER)
    head = F.regexp_extract(w, f"^([^{letters}]*)", 1)
    at = F.length(head) + 1
    return F.when(w.rlike(f"[{letters}]"), F.concat(head, F.translate(F.substring(w, at, F.lit(1)), letters, "".join(PARTNER.values())), F.substring(w, at + 1, F.length(w))))


def double_vowel_typo(word: Column | str) -> Column:
    """The first vowel after the first letter doubled; null if there is none."""
    w = col(word)
    typo = F.regexp_replace(w, "^(.[^aeiou]*)([aeiou])", "$1$2$2")
    return F.when(typo != w, typo)


def flag_reason(word: Column | str) -> Column:
    """Why a dictionary entry looks like garbage; null if it does not."""
    w = col(word)
    return (
        F.when(F.length(w) == 1, "single character")
        .when((F.length(w) == 2) & ~w.isin(SHORT_WORDS), "2-char word not on allowlist")
        .when(~w.rlike(VALID_WORD), "contains non-Uzbek-Latin characters")
        .when(w.isin(ENGLISH_NOISE), "common English word")
        .when(w.endswith("'s") | w.endswith("'t"), "English possessive/contraction")
        .when((F.length(w) >= 5) & ~w.rlike(f"[{VOWELS}]"), "zero vowels (likely garbage)")
    )
