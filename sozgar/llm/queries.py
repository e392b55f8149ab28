"""Queries of the operators in this package and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sozgar.llm.html import op4_extract
from sozgar.llm.mixing import OP10_SQL, op10_mix
from sozgar.llm.neardup import op9_neardup
from sozgar.llm.nearest import OP8_SQL, op8_nearest
from sozgar.llm.oracles import OP6_SQL, OP9_SQL
from sozgar.llm.packing import op2_pack
from sozgar.llm.quality import op3_quality
from sozgar.llm.repeats import op6_repeats
from sozgar.llm.sharding import OP7_SQL, op7_interleave
from sozgar.llm.tiff import media_facts, page_digest, texts_to_tiff
from sozgar.llm.toxicity import op5_toxicity


def op1_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    stored = texts_to_tiff(rows, "text").drop("text")
    facts = stored.select("doc_id", "n_bytes", *media_facts(F.col("media")), "media")
    digest = page_digest(facts, ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return digest.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


QUERIES = {
    "op1_tiff": op1_tiff,
    "op2_pack": op2_pack,
    "op3_quality": op3_quality,
    "op4_extract": op4_extract,
    "op5_toxicity": op5_toxicity,
    "op6_repeats": op6_repeats,
    "op7_interleave": op7_interleave,
    "op8_nearest": op8_nearest,
    "op9_neardup": op9_neardup,
    "op10_mix": op10_mix,
}
ORACLES = {
    "op6_repeats": OP6_SQL,
    "op7_interleave": OP7_SQL,
    "op8_nearest": OP8_SQL,
    "op9_neardup": OP9_SQL,
    "op10_mix": OP10_SQL,
}
