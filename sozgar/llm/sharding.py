"""Sharding by proportional stratified interleaving, in DataFrame functions alone.

Rows are shuffled by a seeded hash within each source and ranked; sorted by fractional rank
((rank - 1/2) / rows of the source) all sources advance together, so every contiguous cut has the
mixture of the whole. Cuts at equal positions give shards whose row counts differ by one at most.

Defined results: a null source is a stratum of its own; null ids and repeated rows are dealt like any
row (equal rows are interchangeable); null text counts as no bytes; an empty table gives an empty
result; extra columns, whatever their names, are ignored by the query and carried by the operator (rows are
compared whole, so map columns are not taken).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sozgar.llm.common import Scratch, boxed, column, unboxed
from sozgar.llm.ranking import BUCKETS, bucket_of, bucket_totals, counted_rows, each_copy, stratum_of


def seeded_unit(columns: list[Column], seed: int) -> Column:
    """A uniform value in [0, 1) that depends on the columns and the seed alone."""
    parts = [F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)]
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def interleave(df: DataFrame, source: str, tie: list[str], shards: int, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``shard`` and ``slot`` (gapless from 0 in each shard). ``tie``: columns that tell rows apart.

    Rows that are equal in all columns are ranked as one row with a number, so however many they do not share a task.
    """
    scratch = Scratch(df.sparkSession, "interleave")
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    df = df.select(*map(column, kept))
    ties = [column(c) for c in tie]
    unit = seeded_unit(ties, seed)
    rows = df.select(boxed(df), stratum_of(column(source)).alias("stratum"), F.struct(*ties).alias("tie"), unit.alias("unit")).withColumn("bucket", bucket_of(F.col("unit"), buckets))
    rows = scratch.write(counted_rows(rows), "rows")
    totals = bucket_totals(rows, ["stratum"], F.col("m")).select("stratum", "bucket", "amount_before", "all_amount")
    before = Window.partitionBy("stratum", "bucket").orderBy("unit", "tie").rowsBetween(Window.unboundedPreceding, -1)
    ranked = each_copy(rows.withColumn("local", F.coalesce(F.sum("m").over(before), F.lit(0))).join(totals, ["stratum", "bucket"]))
    fraction = (F.col("amount_before") + F.col("local") + F.col("copy") + 0.5) / F.col("all_amount")
    ranked = scratch.write(ranked.select("row", "tie", "stratum", fraction.alias("fraction")).withColumn("bucket", bucket_of(F.col("fraction"), buckets)), "ranked")
    scratch.drop("rows")
    n = ranked.count()
    totals = bucket_totals(ranked, [], F.lit(0))
    local = F.row_number().over(Window.partitionBy("bucket").orderBy("fraction", "stratum", "tie"))
    placed = ranked.withColumn("local", local).join(totals.select("bucket", "rows_before"), "bucket")
    place = F.col("rows_before") + F.col("local") - 1
    placed = placed.withColumns({"place": place.cast("long"), "shard": F.expr(f"cast(((rows_before + local - 1) * {shards}L) div {max(n, 1)}L as int)")})
    first = F.expr(f"cast((shard * {max(n, 1)}L + {shards - 1}L) div {shards}L as long)")
    return placed.select(*unboxed(df, kept), "shard", (F.col("place") - first).alias("slot"))


def op7_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32")
    )
    dealt = interleave(rows, "source", ["doc_id", "text_crc32", "size"], shards=24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP7_SQL = """
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
raw AS (SELECT doc_id, source, octet_length(encode(coalesce(text, '')))::BIGINT AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS MATERIALIZED (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS stratum, n + 8 AS size,
  xor(list_reduce(list_transform(range(0, n), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM raw, tab),
u AS (SELECT *, ('0x' || substr(md5(concat_ws(':', '42', coalesce(doc_id::VARCHAR, ''), text_crc32::VARCHAR, size::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS unit FROM d),
f AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY unit, doc_id, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS fraction FROM u),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM f),
s AS (SELECT *, place * 24 // n AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, (place - (shard * n + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s
"""
