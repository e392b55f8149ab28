"""The functions as SQL functions: those of words and pages inlined by the optimizer, those of whole texts over Arrow batches (``bytewise``)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sozgar.functions import bytewise, forms, tokens

FUNCTIONS = {
    "uz_html_text": (tokens.html_text, "STRING"),
    "uz_normalise": (forms.normal, "STRING"),
    "uz_flag_reason": (forms.flag_reason, "STRING"),
    "uz_phonetic_typo": (forms.phonetic_typo, "STRING"),
    "uz_double_vowel_typo": (forms.double_vowel_typo, "STRING"),
}


def sql_text(spark: SparkSession, make, name: str = "x") -> str:
    """The SQL text of a column function of one argument called ``name``."""
    frame = spark.createDataFrame([], f"{name} string").select(make(F.col(name)).alias("y"))
    return frame._jdf.queryExecution().analyzed().expressions().head().child().sql().replace("spark_catalog.", "")


def register(spark: SparkSession) -> list[str]:
    """Temporary SQL functions of one argument; returns their names. Those in ``FUNCTIONS`` by the SQL text of their expression."""
    for name, (make, kind) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {sql_text(spark, make)}")
    return [*FUNCTIONS, *bytewise.register(spark)]
