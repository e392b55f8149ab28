"""Typo benchmarks made from a dictionary, accuracy reports, failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sozgar.functions.forms import double_vowel_typo, phonetic_typo, straight
from sozgar.operators.spelling import SpellChecker

GENERATORS = {"phonetic": phonetic_typo, "double_char": double_vowel_typo}


def candidate_words(entries: DataFrame, n: int = 500, least: int = 500) -> DataFrame:
    """The ``n`` most frequent plain words of 4 to 10 letters."""
    return entries.where(F.col("word").rlike("^[a-z']{4,10}$") & (F.col("freq") >= least)).orderBy(F.col("freq").desc(), "word").limit(n)


def typo_cases(words: DataFrame, entries: DataFrame, kind: str, n: int = 100) -> DataFrame:
    """(input, expected, type): the first ``n`` typos in order of frequency that are no words themselves and occur once."""
    made = words.select(GENERATORS[kind]("word").alias("input"), F.col("word").alias("expected"), "freq").where("input IS NOT NULL AND input <> expected")
    made = made.join(entries.select(F.col("word").alias("input")), "input", "left_anti")
    once = Window.partitionBy("input").orderBy(F.col("freq").desc(), "expected")
    kept = made.withColumn("_n", F.row_number().over(once)).where("_n = 1").orderBy(F.col("freq").desc(), "expected").limit(n)
    return kept.select("input", "expected", F.lit(kind).alias("type"))


def real_cases(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Collected (input, expected) pairs: not equal, the input no word, the expected form a word, each once."""
    known = entries.select("word")
    kept = pairs.select("input", "expected").where("input <> expected").distinct()
    kept = kept.join(known.withColumnRenamed("word", "input"), "input", "left_anti").join(known.withColumnRenamed("word", "expected"), "expected", "left_semi")
    return kept.select("input", "expected", F.lit("real").alias("type"))


def benchmark(entries: DataFrame, pairs: DataFrame | None = None, n: int = 100, words: int = 500, least: int = 500) -> DataFrame:
    chosen = candidate_words(entries, words, least)
    cases = typo_cases(chosen, entries, "phonetic", n).unionByName(typo_cases(chosen, entries, "double_char", n))
    return cases if pairs is None else cases.unionByName(real_cases(pairs, entries))


def judged(cases: DataFrame, checker: SpellChecker, top_n: int = 3, normalise: bool = False) -> DataFrame:
    """The cases with suggestions, ``top1`` and ``top3``; with ``normalise`` apostrophes are made equal first."""
    found = checker.suggest(cases.select(F.col("input").alias("word")), "word", top_n)
    joined = cases.join(found.select(F.col("word").alias("input"), "suggestions"), "input", "left")
    goal = straight("expected") if normalise else F.col("expected")
    offered = F.transform("suggestions", straight) if normalise else F.col("suggestions")
    return joined.withColumns({"top1": F.coalesce(F.get(offered, F.lit(0)) == goal, F.lit(False)), "top3": F.coalesce(F.array_contains(offered, goal), F.lit(False))})


def accuracy(results: DataFrame, column: str = "type") -> DataFrame:
    """(type, cases, top1, top3) over all cases (type null) and for each type."""
    return results.groupingSets([[], [column]], column).agg(
        F.count(F.lit(1)).alias("cases"), F.avg(F.col("top1").cast("int")).alias("top1"), F.avg(F.col("top3").cast("int")).alias("top3")
    )


def failures(results: DataFrame, column: str = "type", shown: int = 3) -> DataFrame:
    """The first failures of each type with the number of all of them."""
    missed = results.where(~F.col("top3"))
    by = Window.partitionBy(column)
    numbered = missed.withColumns({"n": F.row_number().over(by.orderBy("input", "expected")), "failed": F.count(F.lit(1)).over(by)})
    return numbered.where(F.col("n") <= shown).select(column, "n", "failed", "input", "expected", "suggestions")
