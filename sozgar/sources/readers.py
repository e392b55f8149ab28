"""Readers of dictionaries, word lists, benchmark files, corpora and dumps."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sozgar.functions.forms import VALID_ENTRY

DICTIONARY = "word string, freq bigint"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's own file systems know the path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of words and frequencies; a missing file is an empty dictionary."""
    if not exists(spark, path):
        return spark.createDataFrame([], DICTIONARY)
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,bigint>").alias("m"))
    return parsed.select(F.explode("m").alias("word", "freq"))


def load_dictionary(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of several places that exists (a table in Parquet or a JSON object)."""
    for path in paths:
        if exists(spark, path):
            return spark.read.parquet(path).select("word", F.col("freq").cast("bigint").alias("freq")) if path.rstrip("/").endswith(".parquet") else read_dictionary(spark, path)
    raise FileNotFoundError(f"no dictionary at {', '.join(paths) or 'any place: none was given'}")


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, comments after #; each valid word once with frequency 1."""
    words = spark.read.text(path).select(F.lower(F.trim(F.split_part("value", F.lit("#"), F.lit(1)))).alias("word"))
    return words.where(F.col("word").rlike(VALID_ENTRY)).distinct().withColumn("freq", F.lit(1).cast("bigint"))


def read_cases(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    cases = spark.read.schema("input string, expected string, type string").json(path, multiLine=True)
    return cases.where(F.col("type") == kind) if kind else cases


def read_typos(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """CSV with a header (typo, correct, category); values trimmed, a missing category is '?'."""
    rows = spark.read.csv(path, header=True, schema="typo string, correct string, category string")
    rows = rows.select(F.trim("typo").alias("input"), F.trim("correct").alias("expected"), F.coalesce(F.trim("category"), F.lit("?")).alias("type"))
    return rows.where(F.col("type") == category) if category else rows


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """One message per line; blank lines and comments are left out."""
    return spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of articles of an XML dump, bz2 or plain: pages of name space 0, or without one, that have a text."""
    schema = "title string, ns bigint, revision struct<text:string>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return pages.where("coalesce(ns, 0) = 0 AND revision.text IS NOT NULL AND revision.text <> ''").select("title", F.col("revision.text").alias("text"))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Every file under a folder as one text."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).withColumnRenamed("value", "text")


class _Lines(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.most = int(options.get("most", 0))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        import lzma

        n = 0
        with lzma.open(partition.value, "rt", encoding="utf-8", errors="replace") as lines:
            for line in lines:
                if text := line.strip():
                    yield (text,)
                    n += 1
                    if n == self.most:
                        return


class XzLines(DataSource):
    """Non-blank lines of xz files, which Hadoop has no codec for; one task per file, ``most`` lines of each."""

    @classmethod
    def name(cls) -> str:
        return "xz_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Lines(self.options)


class _Fetch(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", options.get("path", "")).split() if u]
        self.retries, self.timeout, self.pause = int(options.get("retries", 3)), float(options.get("timeout", 15)), float(options.get("pause", 0.6))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str | None]]:
        import time
        import urllib.request

        html = None
        for attempt in range(self.retries):
            try:
                with urllib.request.urlopen(partition.value, timeout=self.timeout) as answer:
                    html = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
                break
            except Exception:
                time.sleep(1 if attempt < self.retries - 1 else 0)
        time.sleep(self.pause)
        yield (partition.value, html)


class WebPages(DataSource):
    """(url, html) of addresses, each tried up to ``retries`` times; html is null where all fail."""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return "url string, html string"

    def reader(self, schema) -> DataSourceReader:
        return _Fetch(self.options)


def read_xz_lines(spark: SparkSession, *paths: str, most: int = 500_000) -> DataFrame:
    """At most ``most`` non-blank lines; 0 for all."""
    spark.dataSource.register(XzLines)
    lines = spark.read.format("xz_lines").option("most", most).load(",".join(paths))
    return lines.limit(most) if most else lines


def fetch(spark: SparkSession, urls: list[str]) -> DataFrame:
    spark.dataSource.register(WebPages)
    return spark.read.format("web_pages").option("urls", " ".join(urls)).load()


def listing(pages: DataFrame, links: str, order: str, most: int) -> DataFrame:
    """(url): the first ``most`` distinct links of listing pages, in page order and order on the page."""
    spread = pages.select(order, F.posexplode(links).alias("at", "url"))
    return spread.groupBy("url").agg(F.min(F.struct(order, "at")).alias("first")).orderBy("first").limit(most).select("url")
