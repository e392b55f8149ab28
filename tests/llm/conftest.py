import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Names that operators use inside or return; as extra columns they must not disturb.
CLASHING = ["score", "kept", "spans", "shard", "slot", "piece", "length", "offset", "media", "page", "size", "weight", "copies", "taken", "target", "label", "v", "d", "t", "h", "text_a", "percent", "_bucket_", "rank", "_bucket", "_key", "_stratum", "_unit", "_d", "_t", "_spans", "bucket", "stratum", "unit", "tie", "m", "copy", "row", "u", "s", "e", "x", "a.b", "a`c", "marked", "result", "weight_2", "text_hash_2"]


def words(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def edge_rows() -> list[tuple]:
    shared = words(1, 60)
    base = words(2, 200)
    near = base.split()
    near[100] = "changed"
    return [
        (1, base, "en", "a", 10), (2, base, "en", "a", 10), (2, base, "en", "a", 10), (3, " ".join(near), None, None, None), (4, None, "en", "b", 0), (5, "", "en", "b", 0), (6, "   \n\t ", None, "b", 3),
        (7, "tiny", "en", "c", 4), (8, "Tiny", "en", "c", 4), (9, words(3, 30_000), "en", "a", 0), (10, words(4, 40) + "\n" + shared + "\n" + words(5, 40), "en", "c", 0), (11, words(6, 50) + " " + shared + " " + words(7, 10), "en", None, 0),
        (None, words(8, 30), "en", "d", 1), (None, None, None, None, None), (12, "é" * 300 + " ñandú " + "é" * 300, "es", "d", 9), (13, "ab" * 400, "en", "e", 800), (14, "x", "en", "e", 1), (15, "one two three four", "en", "e", 18),
    ]


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """A folder of tables with nulls, empty and long texts, ties, repeated rows and columns with clashing names; and one of empty tables."""
    folder, empty = str(tmp_path_factory.mktemp("edge")), str(tmp_path_factory.mktemp("empty"))
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(edge_rows(), DOCUMENTS)
    wide = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING)))
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 1), (8, 0, 1), (9, 1, 0), (None, 1, 1), (10, None, None), (11, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    vectors = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [0.5, 0.5]), (8, [0.5, 0.5]), (None, [1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (100, [-1.0, 0.1])]
    embeddings = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<p>Bir, ikki &amp; uch"), (3, None, "<p>Bir, ikki &amp; uch"), (None, "u", "<<<>>> </p></div>text"), (4, "u", "<div>" * 3000 + "chuqur" + "</div>" * 3000)], "page_id long, url string, html string")
    for name, table in (("documents", wide), ("labels", labels), ("embeddings", embeddings), ("pages", pages)):
        table.write.parquet(f"{folder}/{name}.parquet")
        table.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return folder, empty
