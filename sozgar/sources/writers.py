"""Writers of dictionaries, text batches and benchmark files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place, jvm.org.apache.hadoop.fs.Path


def write_dictionary(entries: DataFrame, path: str) -> None:
    """The table in Parquet, sorted by frequency: the form to work with at any size."""
    entries.orderBy(F.col("freq").desc(), "word").write.mode("overwrite").parquet(path)


def export_dictionary(entries: DataFrame, path: str, indent: int = 2) -> None:
    """One JSON object, most frequent first, characters unescaped. An export for small tools: its lines pass through one writer task, not the driver."""
    lines = entries.where("word IS NOT NULL").orderBy(F.col("freq").desc(), "word").coalesce(1)
    name = F.expr("substring(to_json(array(word)), 2, length(to_json(array(word))) - 2)")
    lead = F.when(F.monotonically_increasing_id() == 0, F.lit("{\n")).otherwise(F.lit(",\n"))
    body = lines.select(F.concat(lead, F.lit(" " * indent), name, F.lit(": "), F.col("freq").cast("string")).alias("value"))
    spark = entries.sparkSession
    temporary = f"{path}.parts-{uuid.uuid4().hex}"
    body.write.option("lineSep", " ").text(temporary)
    files, place, make = _files(spark, path)
    parts = [s.getPath() for s in files.listStatus(make(temporary)) if s.getPath().getName().startswith("part-")]
    out = files.create(place, True)
    if not any(files.getFileStatus(p).getLen() for p in parts):
        out.write(bytearray(b"{"))
    for part in parts:
        source = files.open(part)
        spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
        source.close()
    out.write(bytearray(b"\n}\n"))
    out.close()
    files.delete(make(temporary), True)


def overwrite(df: DataFrame, path: str) -> None:
    """Replaces a table that the frame itself reads: the new version is written beside it, then the two are swapped."""
    spark = df.sparkSession
    fresh, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    files, place, make = _files(spark, path)
    if files.exists(place):
        files.rename(place, make(old))
    files.rename(make(fresh), place)
    files.delete(make(old), True)


def write_batches(texts: DataFrame, path: str, column: str = "text", size: int = 1000) -> None:
    """Text files of ``size`` texts each, parted by blank lines."""
    texts.select(F.col(column).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", size).option("lineSep", "\n\n").text(path)


def write_cases(cases: DataFrame, path: str) -> None:
    cases.select("input", "expected", "type").write.mode("overwrite").json(path)
