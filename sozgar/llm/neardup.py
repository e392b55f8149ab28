"""Near-duplicate documents by HyperMinHash: banded compressed registers, estimation, exact confirmation.

1. Every whole text becomes its set of word shingles, a hash of the set and a sketch. Documents with
   equal sets form a class at once; only the smallest id of each goes on.
2. Band keys (six compressed registers) put sets into buckets. In each bucket the members are compared
   with its smallest member: sketches give a collision-corrected estimate, and pairs that may matter are
   measured exactly on full sets. Jaccard distance is a metric, so a member within ``NEAR`` of the pivot
   has all its links among members within ``family_floor`` of it: it is done with this bucket. The others
   repeat this with a new pivot; what ``ROUNDS`` rounds leave in a bucket is compared in blocks as in 3.
3. Sets connected by similarities of ``family_floor`` or more form families. A family whose members all link
   to one pivot is settled. In the others every pair is measured exactly, block against block, and each
   pair of blocks returns a spanning forest of its links, never the pairs themselves.
4. Connected components of the confirmed links give the classes.

No bucket or family meets in one task: bucket members meet pivots in joins, families in pairs of blocks.

Defined results: texts that are null, empty or without words have an empty set and link with nothing;
very long texts are taken whole; repeated rows and documents that share an id are one vertex; a row with
a null id links with nothing, has a null component and is kept; an empty table gives an empty result;
extra columns are ignored by ``near_duplicates``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sozgar.llm.common import Scratch, slices, text_bytes
from sozgar.llm.components import components
from sozgar.llm.hyperminhash import REGISTERS, band_keys, estimate, registers
from sozgar.llm.shingles import SHINGLE, shingle_sets

LINK, NEAR = 85, 55
ROUNDS = 2
#: Members and bytes of text in a block of a family.
BLOCK_ROWS, BLOCK_BYTES = 192, 8 << 20


def family_floor(link: int) -> int:
    """The similarity to a pivot, in percent, below which nothing links to a set within ``NEAR`` of the pivot (triangle inequality)."""
    return NEAR - (100 - link)


def sketches(df: DataFrame, doc_id: str, text: str, width: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_hash, sketch) of every text."""

    def run(batches):
        for batch in slices(batches, text):
            sets = shingle_sets(text_bytes(batch.column(text)), width)
            raw = registers(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(doc_id), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([r.tobytes() for r in raw], pa.binary())],
                [doc_id, "n_shingles", "set_hash", "sketch"],
            )

    return df.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {df.schema[doc_id].dataType.simpleString()}, n_shingles long, set_hash binary, sketch binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def bands(rows: DataFrame) -> DataFrame:
    """(key, v): one row per band of every set."""

    def run(batches):
        for batch in batches:
            keys = band_keys(_matrix(batch.column("sketch")))
            n, m = keys.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(m, dtype=np.int32), n)), pa.array(keys.ravel()), batch.column("v").take(pa.array(np.repeat(np.arange(n), m)))], ["band", "key", "v"])

    return rows.select("v", "sketch").mapInArrow(run, "band int, key long, v long").select(F.xxhash64("band", "key").alias("key"), "v")


def estimated(pairs: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose estimated similarity may reach ``least`` percent: five standard errors are allowed."""

    def run(batches):
        for batch in batches:
            j, used = estimate(_matrix(batch.column("sketch_a")), _matrix(batch.column("sketch_b")), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            goal = least / 100
            keep = pa.array(j + 5 * np.sqrt(goal * (1 - goal) / np.maximum(used, 1)) >= goal)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    side = lambda x: rows.select(F.col("v").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    both = both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * least)
    return both.select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b").mapInArrow(run, "a long, b long")


def measured(pairs: DataFrame, texts: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(a, b, percent): exact similarity of full sets, in whole percent rounded down (so 85 holds exactly from 85 on)."""

    def run(batches):
        for batch in batches:
            for some in slices([batch], "text_b", 1 << 20):
                ids = some.column("a").to_pylist()
                whole = some.column("text_a")
                first = {a: i for i, a in reversed(list(enumerate(ids)))}
                left = dict(zip(first, shingle_sets(text_bytes(whole.take(pa.array(list(first.values())))), width), strict=True))
                found = []
                for a, b in zip(ids, shingle_sets(text_bytes(some.column("text_b")), width), strict=True):
                    both = len(np.intersect1d(left[a], b, assume_unique=True))
                    found.append(100 * both // max(len(left[a]) + len(b) - both, 1))
                yield pa.RecordBatch.from_arrays([some.column("a"), some.column("b"), pa.array(found, pa.int32())], ["a", "b", "percent"])

    side = lambda x: texts.select(F.col("v").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, percent int")


def forest(linked: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in linked:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def block_links(left: list[np.ndarray], right: list[np.ndarray], link: int = LINK) -> np.ndarray:
    """Which pairs of sets reach the similarity: intersections are products of the sets' indicator matrices."""
    sets = left + right
    sizes = np.array([len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    use = count[column] > 1
    row, column = np.repeat(np.arange(len(sets)), sizes)[use], shared[column[use]]
    inter = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        inter += part[: len(left)] @ part[len(left) :].T
    inter = np.rint(inter).astype(np.int64)
    union = sizes[: len(left), None] + sizes[None, len(left) :] - inter
    return (100 * inter >= link * union) & (union > 0)


def family_links(members: DataFrame, texts: DataFrame, width: int = SHINGLE, link: int = LINK) -> DataFrame:
    """(a, b): links that connect the members (v, family) of each family as all its links do."""
    rows = members.join(texts, "v").select("v", "family", "text")
    counts = rows.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    placed = rows.join(counts.select("family", blocks.alias("blocks")), "family").withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("family", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "v", "text")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        low, high, own = table["low"][0].as_py(), table["high"][0].as_py(), table["own"].to_numpy()
        ids, sets = table["v"].to_pylist(), shingle_sets(text_bytes(table["text"]), width)
        first, second = np.flatnonzero(own == low).tolist(), np.flatnonzero(own == high).tolist()
        found = []
        if first and second:
            x, y = np.nonzero(block_links([sets[i] for i in first], [sets[i] for i in second], link))
            found = forest([(ids[first[i]], ids[second[j]]) for i, j in zip(x.tolist(), y.tolist(), strict=True) if low != high or i < j])
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return placed.groupBy("family", "low", "high").applyInArrow(run, "a long, b long")


def links(rows: DataFrame, docs: DataFrame, scratch: Scratch, width: int = SHINGLE, link: int = LINK) -> DataFrame:
    """(a, b): confirmed links that connect distinct sets as all links do. ``rows``: (v, n_shingles, sketch) of one document per set; ``docs``: (v, text)."""
    floor = family_floor(link)
    keyed = scratch.write(bands(rows), "bands")
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    open_ = scratch.write(keyed.join(crowded, "key"), "buckets")
    scratch.drop("bands")
    involved = open_.select("v").distinct()
    texts = scratch.write(docs.join(involved, "v", "left_semi").dropDuplicates(["v"]), "texts")
    known = []
    for k in range(ROUNDS):
        pivots = open_.groupBy("key").agg(F.min("v").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a")
        pairs = open_.join(pivots, "key").where("v <> a").select("key", "a", F.col("v").alias("b"))
        distinct = scratch.write(pairs.select("a", "b").distinct(), f"pairs-{k}")
        known.append(scratch.write(measured(estimated(distinct, rows, floor), texts, width).where(F.col("percent") >= floor), f"known-{k}"))
        done = known[-1].where(F.col("percent") >= NEAR).select("a", "b")
        left = pairs.join(done, ["a", "b"], "left_anti").select("key", F.col("b").alias("v"))
        crowded = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
        open_ = scratch.write(left.join(crowded, "key"), f"open-{k}")
        scratch.drop(f"pairs-{k}", "buckets" if k == 0 else f"open-{k - 1}")
    rest = family_links(open_.select("v", F.col("key").alias("family")), texts, width, link)
    edges = known[0]
    for more in known[1:]:
        edges = edges.unionByName(more)
    families = components(edges, scratch, "families").select("v", F.col("label").alias("family"))
    direct = edges.where(F.col("percent") >= link).select("a", "b").distinct()
    stars = direct.groupBy("a").agg(F.countDistinct("b").alias("m")).select(F.col("a").alias("v"), "m")
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    most = families.join(stars, "v").groupBy("family").agg(F.max("m").alias("m"))
    loose = sizes.join(most, "family", "left").where((F.coalesce("m", F.lit(0)) < F.col("n") - 1) & (F.col("n") > 2)).select("family")
    members = scratch.write(families.join(loose, "family", "left_semi"), "loose")
    return direct.unionByName(family_links(members, texts, width, link)).unionByName(rest)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, link: int = LINK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    scratch = Scratch(docs.sparkSession, "neardup")
    signed = scratch.write(sketches(docs, doc_id, text, width), "signed")
    some = signed.where((F.col("n_shingles") > 0) & F.col(doc_id).isNotNull())
    classes = scratch.write(some.groupBy("set_hash", "n_shingles").agg(F.min(doc_id).alias("v"), F.count(F.lit(1)).alias("n")), "classes")
    rows = some.select(F.col(doc_id).alias("v"), "set_hash", "n_shingles", "sketch").join(classes.select("v", "set_hash"), ["v", "set_hash"], "left_semi")
    rows = scratch.write(rows.dropDuplicates(["v"]).select("v", "n_shingles", "sketch"), "rows")
    found = links(rows, docs.select(F.col(doc_id).alias("v"), text).withColumnRenamed(text, "text"), scratch, width, link)
    # Equal sets link their members to the smallest; where an id has several sets these links join them.
    equal = some.select("set_hash", F.col(doc_id).alias("b")).join(classes.where("n > 1").select("set_hash", F.col("v").alias("a")), "set_hash").where("a <> b").select("a", "b")
    labels = components(found.unionByName(equal), scratch, "classes-cc")
    scratch.keep("signed", "classes-cc-done")
    scratch.sweep()
    kept = signed.join(labels.withColumnRenamed("v", doc_id), doc_id, "left")
    component: Column = F.coalesce("label", doc_id)
    return kept.select(doc_id, "n_shingles", component.alias("component_id"), F.coalesce(F.col(doc_id) == component, F.lit(True)).alias("kept"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
