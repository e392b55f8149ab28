"""The record shapes of the text service as functions of data frames; the transport is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sozgar.functions.translit import convert, transliterate
from sozgar.operators.spelling import SpellChecker

LONGEST_TEXT = 10_000


def health() -> dict:
    return {"status": "ok"}


def _valid(texts: DataFrame, text: str, top_n: int) -> DataFrame:
    """Texts must hold 1 to 10,000 characters, top_n must be 1 to 10; a bad text fails the query."""
    if not 1 <= top_n <= 10:
        raise ValueError("top_n must be between 1 and 10")
    fits = F.coalesce(F.length(text).between(1, LONGEST_TEXT), F.lit(False))
    return texts.withColumn(text, F.when(fits, F.col(text)).otherwise(F.raise_error(F.lit(f"text must hold 1 to {LONGEST_TEXT} characters"))))


def check(checker: SpellChecker, texts: DataFrame, keys: list[str], text: str = "text", top_n: int = 3) -> DataFrame:
    return checker.check(_valid(texts, text, top_n), keys, text, top_n, spans=True)


def transliterated(texts: DataFrame, keys: list[str], text: str = "text", mode: str = "auto") -> DataFrame:
    valid = _valid(texts, text, 1)
    return valid.select(*keys, F.col(text).alias("original"), convert(text, mode).alias("converted"), F.lit(mode.strip().lower()).alias("mode"))


def check_and_transliterate(checker: SpellChecker, texts: DataFrame, keys: list[str], text: str = "text", script: str = "latin", top_n: int = 3) -> DataFrame:
    if script not in ("latin", "cyrillic"):
        raise ValueError("script must be latin or cyrillic")
    valid = _valid(texts, text, top_n)
    converted = valid.select(*keys, F.col(text).alias("original"), (transliterate(text) if script == "cyrillic" else F.col(text)).alias("converted"))
    return converted.join(checker.check(converted, keys, "converted", top_n, spans=True), keys)


def without_ignored(errors: DataFrame, ignored: DataFrame, keys: list[str]) -> DataFrame:
    """Errors that the reader has not ignored; an ignored error is named by word and start."""
    return errors.join(ignored.select(*keys, "word", "start"), [*keys, "word", "start"], "left_anti")
