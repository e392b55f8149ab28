"""Spell checking of any number of texts or words in one plan.

Distinct words are checked once. Unknown words meet the dictionary by a deletion-neighbourhood join
(strings within two edits share a string that each reaches by at most two deletions), which is an
equi-join whose size follows the data, not the square of a length bucket; what it finds is verified by
the built-in banded edit distance and ranked by the weighted one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sozgar.functions.alphabet import MAX_DISTANCE, MIN_DIRECT_FREQ, MIN_STEM, MIN_STEM_FREQ, PARTNER, SUFFIXES
from sozgar.functions.batch import weighted_tenths
from sozgar.functions.forms import normal, within
from sozgar.functions.tokens import word_spans, word_tokens
from sozgar.functions.translit import transliterate
from sozgar.operators.dictionary import normalised, stems

SUGGESTIONS = "array<string>"


def first_letter(word: Column) -> Column:
    """One letter for both of a confusion pair."""
    letters = "".join(sorted({min(a, b) + max(a, b) for a, b in PARTNER.items()}))
    return F.translate(F.substring(word, 1, 1), letters[1::2], letters[0::2])


def deletions(word: Column, most: int) -> Column:
    """The word and all that ``most`` or fewer deletions leave of it."""
    drop = lambda w: F.when(
        F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    ).otherwise(F.array().cast("array<string>"))
    level, everything = F.array(word), F.array(word)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, drop)))
        everything = F.concat(everything, level)
    return F.array_distinct(everything)


def similar(left: DataFrame, right: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """Pairs of rows whose words ``a`` and ``b`` begin with the same letter or its partner and are within ``most`` edits."""
    key = lambda c: F.concat_ws("|", first_letter(F.col(c)), "_part")
    spread = lambda df, c: df.withColumn("_part", F.explode(deletions(F.col(c), most))).withColumn("_key", F.xxhash64(key(c))).drop("_part")
    met = spread(left, a).join(spread(right, b), "_key").drop("_key").where(within(F.col(a), F.col(b), most))
    return met.distinct()


def similar_by_length(left: DataFrame, right: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """The same pairs by blocking on first letter and length; cheaper for a handful of words."""
    lengths = F.explode(F.sequence(F.length(a) - most, F.length(a) + most))
    spread = left.select("*", first_letter(F.col(a)).alias("_first"), lengths.alias("_size"))
    other = right.select("*", first_letter(F.col(b)).alias("_first"), F.length(b).alias("_size"))
    return spread.join(other, ["_first", "_size"]).drop("_first", "_size").where(within(F.col(a), F.col(b), most))


#: Up to so many words the blocked join is taken, which needs no deletions of the whole dictionary.
FEW = 1000


def similar_by_count(left: DataFrame, right: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """The same pairs by the join that suits the number of words on the left, which is counted up to ``FEW`` first."""
    least = FEW if most > 1 else 8 * FEW  # one edit leaves fewer lengths and fewer words in each block
    few = left.limit(least + 1).count() <= least
    return (similar_by_length if few else similar)(left, right, a, b, most)


class SpellChecker:
    """Checks against a dictionary (word, freq). ``join``: 'deletions' (any amount of words), 'lengths' (few), or 'auto', which counts them.

    With ``persist`` the dictionary and the kinds of the words looked up are kept until ``close``, or the end of a ``with`` block.
    """

    def __init__(self, entries: DataFrame, join: str = "deletions", persist: bool = False):
        self.dictionary = normalised(entries).where(F.length("word") > 0)
        self._kept: list[DataFrame] | None = [] if persist else None
        if persist:
            self.dictionary = self.dictionary.persist()
        self._similar = {"deletions": similar, "lengths": similar_by_length, "auto": similar_by_count}[join]

    def close(self) -> None:
        """Gives back what is kept; frames made before read their sources again."""
        self.dictionary.unpersist()
        self.forget()

    def forget(self) -> None:
        """Gives back the kinds of words looked up so far, but not the dictionary."""
        while self._kept:
            self._kept.pop().unpersist()

    def __enter__(self) -> SpellChecker:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @property
    def spark(self) -> SparkSession:
        return self.dictionary.sparkSession

    # --- words -----------------------------------------------------------------------------------

    def match_kinds(self, words: DataFrame) -> DataFrame:
        """(w, match_kind) of distinct normal words: DIRECT, STEM or ''."""
        direct = words.select("w").join(self.dictionary.where(F.col("freq") >= MIN_DIRECT_FREQ).select(F.col("word").alias("w"), F.lit(True).alias("_known")), "w", "left")
        found = stems(direct.where("_known IS NULL").select("w"), self.dictionary, "w").where(F.col("stem_freq") >= MIN_STEM_FREQ).select("w", F.lit(True).alias("_stem"))
        kinds = direct.join(found, "w", "left")
        return kinds.select("w", F.when(F.col("_known"), "DIRECT").when(F.col("_stem"), "STEM").otherwise("").alias("match_kind"))

    def candidates(self, unknown: DataFrame) -> DataFrame:
        """(w, candidate, freq, path, tenths): whole dictionary words (path 1), and roots with a suffix put on (path 2)."""
        entries = self.dictionary.select(F.col("word").alias("candidate"), "freq")
        whole = self._similar(unknown.select("w"), entries, "w", "candidate", MAX_DISTANCE).select("w", "candidate", "freq", F.lit(1).alias("path"))
        built = self.rebuilt(unknown)
        return whole.unionByName(built).withColumn("tenths", weighted_tenths("w", "candidate"))

    def rebuilt(self, unknown: DataFrame) -> DataFrame:
        """Common roots near the word less some suffix's length, with any suffix of that length put on; the word need not end in it."""
        sizes = sorted({len(s) for s in SUFFIXES})
        fitting = F.filter(F.array(*map(F.lit, sizes)), lambda k: F.length("w") >= k + MIN_STEM)
        parts = unknown.select("w", F.explode(fitting).alias("size")).withColumn("part", F.left(F.col("w"), F.length("w") - F.col("size")))
        common = self.dictionary.where(F.col("freq") >= MIN_STEM_FREQ).select(F.col("word").alias("root"))
        near = self._similar(parts.select("part").distinct(), common, "part", "root", 1)
        by_size = F.create_map(*[x for k in sizes for x in (F.lit(k), F.array(*[F.lit(s) for s in SUFFIXES if len(s) == k]))])
        put_on = parts.join(near, "part").select("w", "root", F.explode(by_size[F.col("size")]).alias("suffix")).select("w", F.concat("root", "suffix").alias("candidate"))
        close = put_on.where(within(F.col("w"), F.col("candidate"), MAX_DISTANCE)).distinct()
        fresh = close.join(self.dictionary.select(F.col("word").alias("candidate")), "candidate", "left_anti")
        rooted = stems(fresh.select("candidate").distinct(), self.dictionary, "candidate").select("candidate", F.col("stem_freq").alias("freq"))
        return fresh.join(rooted, "candidate", "left").select("w", "candidate", F.coalesce("freq", F.lit(1)).cast("long").alias("freq"), F.lit(2).alias("path"))

    def ranked(self, unknown: DataFrame, top_n: int = 3) -> DataFrame:
        """The best candidates of each word with their rank: nearest, most frequent, whole words first, by spelling."""
        order = Window.partitionBy("w").orderBy("tenths", F.col("freq").desc(), "path", "candidate")
        found = self.candidates(unknown).where(F.col("tenths") <= 10 * MAX_DISTANCE)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)

    def suggest(self, words: DataFrame, column: str = "word", top_n: int = 3) -> DataFrame:
        """(column, match_kind, suggestions) of each distinct word; a correct word suggests its own normal form, an empty word nothing."""
        if not 1 <= top_n <= 10:
            raise ValueError("top_n must be between 1 and 10")
        given = words.select(column).where(F.col(column).isNotNull()).distinct().withColumn("w", normal(column))
        kinds = self.match_kinds(given.where("w <> ''").select("w").distinct())
        if self._kept is not None:  # one row a distinct word, read by both ways to candidates and by the answers
            kinds = kinds.persist()
            self._kept.append(kinds)
        unknown = kinds.where("match_kind = ''").select("w")
        best = self.ranked(unknown, top_n).groupBy("w").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate"))).alias("best"))
        answers = kinds.join(best.select("w", F.col("best.candidate").alias("found")), "w", "left")
        answers = answers.select("w", "match_kind", F.when(F.col("match_kind") != "", F.array("w")).otherwise(F.coalesce("found", F.array().cast(SUGGESTIONS))).alias("suggestions"))
        return given.join(answers, "w", "left").select(column, F.coalesce("match_kind", F.lit("")).alias("match_kind"), F.coalesce("suggestions", F.array().cast(SUGGESTIONS)).alias("suggestions"))

    def is_correct(self, words: DataFrame, column: str = "word") -> DataFrame:
        """(column, match_kind, is_correct) of each distinct word."""
        given = words.select(column).where(F.col(column).isNotNull()).distinct().withColumn("w", normal(column))
        kinds = given.join(self.match_kinds(given.select("w").distinct()), "w", "left")
        return kinds.select(column, "match_kind", (F.col("match_kind") != "").alias("is_correct"))

    def correct(self, words: DataFrame, column: str = "word") -> DataFrame:
        """(column, correction): the best suggestion, or the word itself if there is none."""
        found = self.suggest(words, column, 1)
        return found.select(column, F.coalesce(F.get("suggestions", F.lit(0)), column).alias("correction"))

    # --- texts -----------------------------------------------------------------------------------

    def errors(self, texts: DataFrame, keys: list[str], text: str = "text", top_n: int = 3) -> DataFrame:
        """(keys, word, start, end, suggestions): every occurrence of a word that is not correct."""
        spans = texts.select(*keys, F.explode(word_spans(text)).alias("span")).select(*keys, "span.word", "span.start", "span.end")
        # The tokens are the words of the spans, without the cost of their places.
        words = texts.select(F.explode(word_tokens(text)).alias("word"))
        answers = self.suggest(words, "word", top_n).where("match_kind = ''").drop("match_kind")
        return spans.join(answers, "word").select(*keys, "word", "start", "end", "suggestions")

    def check(self, texts: DataFrame, keys: list[str], text: str = "text", top_n: int = 3, spans: bool = False) -> DataFrame:
        """(keys, total_words, errors_found, errors): errors in text order; with ``spans`` they carry start and end. Keys name one text each."""
        wrong = self.errors(texts, keys, text, top_n)
        listed = wrong.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "word", "suggestions"))).alias("_errors"))
        fields = ["word", "start", "end", "suggestions"] if spans else ["word", "suggestions"]
        shaped = F.transform("_errors", lambda e: F.struct(*(e[f].alias(f) for f in fields)))
        empty = F.array().cast("array<struct<word:string,start:int,end:int,suggestions:array<string>>>" if spans else "array<struct<word:string,suggestions:array<string>>>")
        total = texts.select(*keys, F.when(F.col(text).isNull(), 0).otherwise(F.size(word_tokens(text))).alias("total_words"))
        joined = total.join(listed, keys, "left")
        return joined.select(*keys, "total_words", F.when(F.col("_errors").isNull(), 0).otherwise(F.size("_errors")).alias("errors_found"), F.coalesce(shaped, empty).alias("errors"))

    def summary(self, texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
        """(keys, total_words, errors_found) of each key: what ``check`` counts, without the suggestions, so only the kinds of words are looked up."""
        found = F.coalesce(word_tokens(text), F.array().cast("array<string>"))
        words = texts.select(*keys, F.explode(word_tokens(text)).alias("word")).select(*keys, normal("word").alias("w"))
        unknown = self.match_kinds(words.select("w").distinct()).where("match_kind = ''").select("w")
        wrong = words.join(unknown, "w").groupBy(*keys).agg(F.count(F.lit(1)).alias("wrong"))
        counts = texts.select(*keys, F.size(found).alias("words"), F.lit(0).cast("long").alias("wrong")).unionByName(wrong.select(*keys, F.lit(0).alias("words"), "wrong"))
        return counts.groupBy(*keys).agg(F.sum("words").cast("int").alias("total_words"), F.sum("wrong").cast("int").alias("errors_found"))

    def pipeline(self, texts: DataFrame, keys: list[str], text: str = "text", script: str = "latin", spans: bool = False) -> DataFrame:
        """(keys, original, converted, spell_check): Cyrillic texts are converted first; any other script means Latin."""
        converted = texts.select(*keys, F.col(text).alias("original"), (transliterate(text) if script == "cyrillic" else F.col(text)).alias("converted"))
        checked = self.check(converted, keys, "converted", spans=spans)
        return converted.join(checked, keys).select(*keys, "original", "converted", F.struct("total_words", "errors_found", "errors").alias("spell_check"))

    # --- one string ------------------------------------------------------------------------------

    def _one(self, value: str, name: str) -> DataFrame:
        return self.spark.createDataFrame([(0, value)], f"id int, {name} string")

    def _first(self, frame: DataFrame):
        row = frame.first()
        self.forget()
        return row

    def suggest_word(self, word: str, top_n: int = 3) -> list[str]:
        return self._first(self.suggest(self._one(word, "word"), "word", top_n))["suggestions"]

    def correct_word(self, word: str) -> str:
        return self._first(self.correct(self._one(word, "word")))["correction"]

    def check_text(self, text: str) -> dict:
        return self._first(self.check(self._one(text, "text"), ["id"]).drop("id")).asDict(recursive=True)
