"""Word-frequency dictionaries: counting, merging, cleaning, folding to roots, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sozgar.functions.alphabet import AUTONOMOUS_FREQ, LONGEST_SUFFIX, MIN_STEM_FREQ
from sozgar.functions.forms import flag_reason, straight, strippable


def word_count(df: DataFrame, words: Column, least: int = 1) -> DataFrame:
    """(word, freq) of an array column; counts are added up before the shuffle."""
    counted = df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    return counted.where(F.col("freq") >= least) if least > 1 else counted


def normalised(entries: DataFrame) -> DataFrame:
    """One spelling of apostrophes; frequencies of forms that become equal are added."""
    return entries.groupBy(straight("word").alias("word")).agg(F.sum("freq").cast("long").alias("freq"))


def merged(*sources: DataFrame) -> DataFrame:
    """Frequencies of all sources added."""
    return reduce(DataFrame.unionByName, [s.select("word", F.col("freq").cast("long").alias("freq")) for s in sources]).groupBy("word").agg(F.sum("freq").cast("long").alias("freq"))


def new_words(entries: DataFrame, known: DataFrame) -> DataFrame:
    return entries.join(known.select("word"), "word", "left_anti")


def extended(known: DataFrame, counted: DataFrame, least: int = 3) -> DataFrame:
    """Known entries with what a new corpus counts at least ``least`` times."""
    return merged(known, counted.where(F.col("freq") >= least))


def flagged(entries: DataFrame) -> DataFrame:
    return entries.withColumn("reason", flag_reason("word")).where("reason IS NOT NULL")


def cleaned(entries: DataFrame) -> DataFrame:
    return entries.where(flag_reason("word").isNull())


def flag_summary(entries: DataFrame) -> DataFrame:
    return flagged(entries).groupBy("reason").agg(F.count(F.lit(1)).alias("words"), F.sum("freq").cast("long").alias("freq"))


def top(entries: DataFrame, n: int) -> DataFrame:
    return entries.orderBy(F.col("freq").desc(), "word").limit(n)


def bottom(entries: DataFrame, n: int) -> DataFrame:
    return entries.orderBy("freq", "word").limit(n)


def review_sample(entries: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` entries in an order that the seed fixes."""
    return entries.orderBy(F.md5(F.concat(F.lit(f"{seed} "), "word")), "word").limit(n)


def split_suffixes(words: DataFrame, column: str = "word") -> DataFrame:
    """(column, stem, suffix, size): every way to take one suffix off."""
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_SUFFIX), F.length(column) - 3)))
    cut = words.where(F.length(column) > 3).select("*", sizes.alias("size"))
    cut = cut.withColumns({"stem": F.left(F.col(column), F.length(column) - F.col("size")), "suffix": F.right(F.col(column), F.col("size"))})
    return cut.where(strippable(F.col("stem"), F.col("suffix")))


def stems(words: DataFrame, vocabulary: DataFrame, column: str = "word") -> DataFrame:
    """(column, stem, stem_freq): the longest suffix whose stem is in the vocabulary taken off; words without one are missing.

    Every word of the input should occur once.
    """
    ways = split_suffixes(words.select(column), column)
    known = ways.join(vocabulary.select(F.col("word").alias("stem"), F.col("freq").alias("stem_freq")), "stem")
    best = known.groupBy(column).agg(F.max(F.struct("size", "stem", "stem_freq")).alias("best"))
    return best.select(column, "best.stem", "best.stem_freq")


def iterated_stems(words: DataFrame, vocabulary: DataFrame, passes: int = 3) -> DataFrame:
    """(word, stems): all stems on the way when suffixes are taken off up to ``passes`` times."""
    state = words.select("word").distinct().select("word", F.col("word").alias("now"), F.array().cast("array<string>").alias("stems"))
    for _ in range(passes):
        step = stems(state.select("now").distinct(), vocabulary, "now").select("now", "stem")
        state = state.join(step, "now", "left").select(
            "word", F.coalesce("stem", "now").alias("now"), F.when(F.col("stem").isNotNull(), F.concat("stems", F.array("stem"))).otherwise(F.col("stems")).alias("stems")
        )
    return state.select("word", "stems")


def roots(entries: DataFrame, threshold: int = AUTONOMOUS_FREQ, gate: int = MIN_STEM_FREQ) -> DataFrame:
    """Rare surface forms folded into their deepest root among entries of frequency ``gate`` or more."""
    common = entries.where(F.col("freq") >= gate)
    rare = entries.where(F.col("freq") < threshold)
    deep = iterated_stems(rare, common).select("word", F.when(F.size("stems") > 0, F.element_at("stems", -1)).alias("root"))
    folded = entries.join(deep, "word", "left").select(F.coalesce("root", "word").alias("word"), "freq")
    return folded.groupBy("word").agg(F.sum("freq").cast("long").alias("freq"))


def corpus_statistics(entries: DataFrame, folded: DataFrame | None = None) -> DataFrame:
    """(words, tokens, roots, reduction): sizes before and after folding, the reduction in percent."""
    sizes = entries.agg(F.count(F.lit(1)).alias("words"), F.sum("freq").cast("long").alias("tokens"))
    if folded is None:
        return sizes
    after = folded.agg(F.count(F.lit(1)).alias("roots"))
    return sizes.crossJoin(after).withColumn("reduction", F.round(100.0 * (1 - F.col("roots") / F.col("words")), 1))
