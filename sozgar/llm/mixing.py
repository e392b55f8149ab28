"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words by
weight; no target passes ``cap`` times its source's size, and what is left over is shared again by
weight (water filling, solved in closed form over the sources sorted by the level at which they cap).

Sampling: each document has the exponential key -ln(u) / quality weight; documents are taken in key
order. A source's target is met by complete epochs first; the rest is the longest prefix in key order
that fits in the budget. What the prefix leaves is offered to the later documents that fit in it, ``FILLS``
times, by the same rule, so no target is passed.

Quality weight, from 1 down to ``LEAST``: the product of what marks leave (each share of the text that is
``MARKS`` counts four times), the share of characters that are no digits, the share of lines that are
different, and a half where words have fewer than 3 or more than 12 characters on average.

Defined results: null or empty text has size 0 and takes nothing; a null source is a source; null ids are told
apart by their texts; repeated rows are taken like any row (ties in the key are broken by id, then size; equal
rows are interchangeable, and are worked on as one row with a number, so however many they do not share a task);
an empty table gives an empty result; extra columns, whatever their names, are carried by ``mix_rows`` (rows are
compared whole, so map columns are not taken).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sozgar.llm.common import Scratch, boxed, column, free_name, unboxed
from sozgar.llm.ranking import BUCKETS, bucket_of, bucket_totals, counted_rows, each_copy, stratum_of

WORD = r"[^\x20\x09-\x0D]+"
#: Marks whose share lowers a document's quality weight, and the least weight.
MARKS, LEAST = "#$%&*!|", 0.05
WEIGHTS = (5, 2, 1)
FILLS = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, words: Column) -> Column:
    n = F.length(text)
    share = lambda signs: (n - F.length(F.translate(text, signs, ""))) / n
    lines = F.split(text, "\n")
    marks = F.greatest(F.lit(0.0), 1.0 - 4.0 * share(MARKS))
    letters = (F.length(F.translate(text, " \t\n\r", "")) / words).between(3, 12)
    weight = marks * (1.0 - share("0123456789")) * (F.size(F.array_distinct(lines)) / F.size(lines)) * F.when(letters, 1.0).otherwise(0.5)
    return F.when((n > 0) & (words > 0), F.greatest(F.lit(LEAST), weight)).otherwise(LEAST)


def exponential_key(doc_id: Column, text_hash: Column, weight: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text_hash, F.lit("")), F.lit(f":{seed}")).cast("binary"))
    unit = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    return -F.log(unit) / weight


def source_targets(sizes: DataFrame, cap: int = 3, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From (stratum, source_size) the target of each: one row per source, so windows over all of them are small."""
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy("stratum")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    weighed = sizes.withColumn("_w", weight)
    level = everything.orderBy((F.col("source_size") * cap / F.col("_w")).asc(), F.col("stratum"))
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    filled = weighed.withColumns({
        "_rank": F.row_number().over(level),
        "_left": F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)),
        "_weights": F.sum("_w").over(after),
    })
    free = F.col("source_size") * cap * F.col("_weights") > F.col("_w") * F.col("_left")
    first = F.min(F.when(free, F.struct("_rank", "_left", "_weights"))).over(everything)
    filled = filled.withColumn("_first", first)
    share = (F.col("_w") * F.col("_first._left")).cast("double") / F.col("_first._weights")
    capped = F.col("_first").isNull() | (F.col("_rank") < F.col("_first._rank"))
    return filled.select("stratum", "source_size", F.when(capped, (F.col("source_size") * cap).cast("double")).otherwise(share).alias("target"))


def mixed(df: DataFrame, doc_id: str, size: str, weight: str, source: str, text_hash: str, cap: int = 3, seed: int = 42, buckets: int = BUCKETS, fills: int = FILLS) -> DataFrame:
    """(row, m, size, source_size, target, epochs, chosen): each distinct row in a box, its copies, and how many of them are taken once more than ``epochs``."""
    scratch = Scratch(df.sparkSession, "mix-rows")
    rows = df.select(
        boxed(df), column(size).cast("long").alias("size"), stratum_of(column(source)).alias("stratum"), column(doc_id).alias("id"),
        exponential_key(column(doc_id), column(text_hash), column(weight), seed).alias("key"),
    )
    rows = scratch.write(counted_rows(rows).withColumn("bucket", bucket_of(1.0 - F.exp(-F.col("key")), buckets)), "rows")
    totals = bucket_totals(rows, ["stratum"], F.col("size") * F.col("m"))
    sizes = totals.groupBy("stratum").agg(F.max("all_amount").cast("long").alias("source_size"))
    here = totals.select("stratum", "bucket", "amount_before").join(source_targets(sizes, cap), "stratum")
    running = Window.partitionBy("stratum", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("amount_before") + F.coalesce(F.sum("offered").over(running), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    placed = rows.join(here, ["stratum", "bucket"]).withColumn("epochs", epochs)
    # Sizes are whole numbers, so what fits in the budget fits in its whole part.
    placed = placed.withColumn("room", F.when(F.col("epochs") < cap, F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))).otherwise(-1).cast("long"))
    placed = placed.withColumn("offered", F.col("size") * F.col("m")).withColumn("before", before)
    fit = F.when(F.col("size") > 0, F.expr("(room - before) div size")).when(F.col("before") <= F.col("room"), F.col("m")).otherwise(0)
    placed = scratch.write(placed.withColumn("chosen", F.least("m", F.greatest(fit, F.lit(0)))).drop("amount_before", "offered", "before"), "prefix")
    for k in range(fills):
        used = placed.groupBy("stratum", "bucket").agg(F.sum(F.col("chosen") * F.col("size")).alias("used"))
        left = used.select("stratum", "bucket", F.sum("used").over(Window.partitionBy("stratum")).alias("used"))
        offered = placed.join(left, ["stratum", "bucket"]).withColumn("space", F.col("room") - F.col("used")).drop("used")
        rest = F.col("m") - F.col("chosen")
        offered = offered.withColumn("offered", F.when((F.col("size") > 0) & (F.col("size") <= F.col("space")), rest * F.col("size")).otherwise(0))
        totals = bucket_totals(offered, ["stratum"], F.col("offered")).select("stratum", "bucket", "amount_before")
        filled = offered.join(totals, ["stratum", "bucket"]).withColumn("before", before)
        more = F.when(F.col("offered") > 0, F.least(rest, F.greatest(F.expr("(space - before) div size"), F.lit(0)))).otherwise(0)
        placed = scratch.write(filled.withColumn("chosen", F.col("chosen") + more).drop("amount_before", "offered", "space", "before"), f"fill-{k}")
        scratch.keep(f"fill-{k}")
    return placed.select("row", "m", "size", "source_size", "target", "epochs", "chosen")


def mix_rows(df: DataFrame, doc_id: str, size: str, weight: str, source: str, text_hash: str, **options) -> DataFrame:
    """Adds ``source_size``, ``target``, ``copies`` (times that the mix takes the row) and ``taken``. Options as of ``mixed``."""
    df = df.select(*(column(c) for c in df.columns if c not in ("source_size", "target", "copies", "taken")))
    m, copy, chosen, amount = (free_name(n, df.columns) for n in ("m", "copy", "chosen", "amount"))
    found = mixed(df, doc_id, size, weight, source, text_hash, **options)
    # The box is opened before rows are multiplied; Spark 4.1 fails on fields of a struct taken above two explodes.
    rows = found.select(*unboxed(df, df.columns), "source_size", "target", F.col("epochs").alias("copies"), F.col("m").alias(m), F.col("chosen").alias(chosen), F.col("size").alias(amount))
    rows = each_copy(rows, m, copy).withColumn("copies", F.col("copies") + (F.col(copy) < F.col(chosen)).cast("long"))
    return rows.select(*map(column, df.columns), "source_size", "target", "copies", (F.col("copies") * F.col(amount)).alias("taken"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``size`` (words), ``weight`` and ``text_hash``."""
    return docs.withColumns({"size": word_count(column(text)), "text_hash": F.md5(F.coalesce(column(text), F.lit("")).cast("binary"))}).withColumn("weight", quality_weight(column(text), F.col("size")))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    rows = measured(docs).select("doc_id", "source", "size", "weight", "text_hash")
    return mix_rows(rows, "doc_id", "size", "weight", "source", "text_hash").select("doc_id", "size", "source_size", "target", "taken")


#: ``{docs}`` is the table or subquery that is mixed.
MIX_SQL = r"""
WITH base AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS stratum
  FROM {docs}),
rated AS (
  SELECT *, CASE WHEN length(text) > 0 AND size > 0 THEN greatest(0.05::DOUBLE,
      greatest(0.0::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * ((length(text) - length(translate(text, '#$%&*!|', '')))::DOUBLE / length(text)))
      * (1.0::DOUBLE - (length(text) - length(translate(text, '0123456789', '')))::DOUBLE / length(text))
      * (len(list_distinct(string_split(text, chr(10))))::DOUBLE / len(string_split(text, chr(10))))
      * CASE WHEN length(translate(text, ' ' || chr(9) || chr(10) || chr(13), ''))::DOUBLE / size BETWEEN 3 AND 12 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)
    ELSE 0.05::DOUBLE END AS weight FROM base),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':42'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / weight AS k FROM rated),
sizes AS (SELECT stratum, sum(size)::BIGINT AS source_size FROM base GROUP BY 1),
weighed AS (SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY stratum) - 1) % 3] AS w FROM sizes),
filled AS (
  SELECT *, row_number() OVER (ORDER BY source_size * 3 / w::DOUBLE, stratum) AS rnk,
    sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / w::DOUBLE, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY source_size * 3 / w::DOUBLE, stratum ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM weighed),
fixed AS (SELECT rnk AS f_rnk, rest AS f_rest, ws AS f_ws FROM filled WHERE source_size * 3 * ws > w * rest ORDER BY rnk LIMIT 1),
targets AS (
  SELECT stratum, source_size, CASE WHEN f_rnk IS NULL OR rnk < f_rnk THEN (source_size * 3)::DOUBLE ELSE (w * f_rest)::DOUBLE / f_ws::DOUBLE END AS target
  FROM filled LEFT JOIN fixed ON true),
placed AS (
  SELECT keyed.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY stratum ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_it
  FROM keyed JOIN targets USING (stratum)),
fill0 AS (SELECT *, target - epochs * source_size AS budget, epochs < 3 AND before_it + size <= target - epochs * source_size AS c FROM placed),
{fills}
mixed AS (SELECT *, epochs + CASE WHEN c THEN 1 ELSE 0 END AS copies FROM fill{last})
"""
#: One fill after another: ``c`` whether a row is taken once more, ``r`` what is left of its source's budget.
FILL_SQL = """room{k} AS (SELECT * EXCLUDE (c), c AS c0, budget - sum(CASE WHEN c THEN size ELSE 0 END) OVER (PARTITION BY stratum) AS r FROM fill{before}),
fill{k} AS (SELECT * EXCLUDE (c0, r), c0 OR (size > 0 AND size <= r AND coalesce(sum(CASE WHEN NOT c0 AND size > 0 AND size <= r THEN size ELSE 0 END) OVER (PARTITION BY stratum ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size <= r) AS c FROM room{k}),
"""
MIX_SQL = MIX_SQL.replace("{fills}", "".join(FILL_SQL.replace("{k}", str(k)).replace("{before}", str(k - 1)) for k in range(1, FILLS + 1))).replace("{last}", str(FILLS))
OP10_SQL = MIX_SQL.replace("{docs}", "documents") + "SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM mixed"
