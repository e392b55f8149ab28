"""Corpus pipeline: five stages over ``documents``, each by one operator of ``sozgar.llm``.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a
frame that is written as Parquet and read again for the next. All but the last return the columns of
``documents``. Rows with null ids or texts pass every stage under the operators' own rules; an empty
table passes through empty; columns beyond those of ``documents`` are dropped by the first stage. Repeated
rows: of rows with one id (or none) and one text, near_dedup keeps one; every other stage works on each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sozgar.llm.common import Scratch
from sozgar.llm.mixing import measured, mixed
from sozgar.llm.neardup import near_duplicates
from sozgar.llm.packing import packed_documents, tokenizer_path
from sozgar.llm.ranking import each_copy
from sozgar.llm.repeats import KEY, document, without_repeats
from sozgar.llm.toxicity import THRESHOLD, score, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Similarity in percent from which the near_dedup stage takes two documents for copies (op9 itself: 85).
SIMILAR = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose calibrated toxicity reaches the operator's threshold."""
    docs = docs.select(*COLUMNS)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where(F.col("score") < THRESHOLD).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of documents with a similarity of ``SIMILAR`` percent or more: the one with the smallest id.

    Of rows that share an id, or have none, and have equal texts one stays (which one, the other columns tell).
    """
    docs = docs.select(*COLUMNS)
    gone = near_duplicates(docs, link=SIMILAR).where(~F.col("kept")).select("doc_id").distinct()
    # Only ids that must go are joined; rows with a null id match none of them and stay.
    rest = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    keys = document("doc_id", "text")
    again = docs.select(*keys).groupBy(*KEY).count().where("count > 1").limit(1).count()
    return rest.select("*", *keys).groupBy(*KEY).agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("row")).select(*(F.col("row").getField(c).alias(c) for c in COLUMNS)) if again else rest


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out; a cut inside a character drops what is left of it. Documents of which nothing stays go."""
    found = without_repeats(docs.select(*COLUMNS), as_text=True)
    changed = F.size("spans") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return found.where(~changed | (F.length("kept_text") > 0)).select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mixture takes it; what it does not take goes. Of equal rows each counts."""
    docs = docs.select(*COLUMNS)
    # A null is told from an empty text, and a null id from any id, so only rows that are equal in all columns share a mark.
    nulls = F.concat(*(F.col(c).isNull().cast("int").cast("string") for c in COLUMNS))
    marked = docs.withColumns({"mark": F.xxhash64(*COLUMNS, nulls), "mark_2": F.xxhash64(F.lit(1), *COLUMNS, nulls)})
    marks = ["mark", "mark_2"]
    rows = Scratch(spark, "pipeline-mix").write(measured(marked).select(*marks, "doc_id", "source", "size", "weight", "text_hash"), "sizes")
    taken = mixed(rows, "doc_id", "size", "weight", "source", "text_hash")
    taken = taken.select(*(F.col("row").getField(c).alias(c) for c in marks), "m", (F.col("m") * F.col("epochs") + F.col("chosen")).alias("copies")).where("copies > 0")
    once = marked.dropDuplicates(marks) if taken.where("m > 1").limit(1).count() else marked
    return each_copy(once.join(taken.select(*marks, F.col("copies").alias("m")), marks)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequences and offsets."""
    return packed_documents(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("repeats", repeats), ("mix", mix), ("pack", pack)]

#: SQL can express neither the models nor the tokenizer; each stage is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
