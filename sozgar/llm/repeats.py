"""Exact removal of repeated passages: every byte under a ``window``-byte string that also starts earlier.

1. Each window is represented by its anchor (the smallest k-gram hash in it); consecutive windows with the
   same anchor are one entry (anchor hash, place). Only anchors that occur twice go on, with their bytes.
2. The entries of an anchor meet in a task. Equal entries (equal bytes) are one string; all but the earliest
   are repeats. Of the different strings, the windows that seem shared are sorted by a suffix array (linear
   grouping construction); equal windows are neighbours there, and all but the earliest of each are repeats.
3. Anchors with more than ``GROUP`` entries are not brought into one task. Equal entries are found by their
   bytes, with map-side combination. Where more than ``GROUP`` different ones stay, their windows are cut into
   cells of ``CELL`` neighbouring places; windows of a cell can be equal only if the bytes that all of them
   share are, so cells with equal shared bytes take the place of the anchor. Where even these are too many,
   windows are grouped one by one by their bytes. All ways give one answer.

Hashes only decide what meets; bytes decide what is equal, so fewer bits of hash (``bits``) cost time alone.

"Earlier" is a smaller id (null ids last; rows that share an id are told apart and ordered by 127 bits of hash of
their text), then an earlier start. Defined results: null or empty text has no bytes and nothing to remove;
texts shorter than the window lose nothing; exactly repeated rows (same id and text) are one document and get
equal results; an empty table gives an empty result; very long texts are taken whole; extra columns, whatever
their names, are ignored by the query and carried by ``without_repeats``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sozgar.llm.anchors import anchors
from sozgar.llm.common import Scratch, boxed, column, mix64, slices, text_bytes
from sozgar.llm.suffixes import suffix_array
from sozgar.llm.words import CHUNK, RunHasher, lay

WINDOW = 100
#: Entries of an anchor that one task compares.
GROUP = 1024
#: Windows of a cell into which the entries of crowded anchors are cut.
CELL = 8
#: Bytes that go into one suffix array, unless a single anchor has more.
TOGETHER = 1 << 16
_GROUP_ODD, _PLACE_ODD = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
#: What tells documents apart, in the order in which they count as earlier.
KEY = ["d", "t", "u"]
KEY_TYPES = "d long, t long, u long"
#: An entry's first window, number of windows and anchor's place share one long; so many bits for each of the last two.
_BITS = 14


def document(doc_id: str, text: str) -> list[Column]:
    """(d, t, u): the id, and two hashes of the text; the sign of ``t`` parts null ids from the largest id and puts them last."""
    whole, key = F.coalesce(column(text), F.lit("")), column(doc_id).cast("long")
    rest = F.shiftrightunsigned(F.xxhash64(whole), 1)
    t = F.when(key.isNull(), rest).otherwise(rest.bitwiseOR(F.lit(-(1 << 63))))
    return [F.coalesce(key, F.lit((1 << 63) - 1)).alias("d"), t.alias("t"), F.xxhash64(whole, F.lit(1)).alias("u")]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(d, t, u, text)."""
    return docs.select(*document(doc_id, text), F.coalesce(column(text), F.lit("")).alias("text"))


def window_rows(base: DataFrame, window: int, bits: int = 64) -> DataFrame:
    """(h, d, t, u, p): anchor hash, document, and packed in one: first window, number of windows, anchor's place in the content."""
    if window >= 1 << _BITS:
        raise ValueError(f"the window must be below {1 << _BITS}")

    def run(batches):
        for batch in slices(batches, "text", CHUNK):
            buffer, starts = lay(text_bytes(batch.column("text")))
            anchor, h, first, last = anchors(buffer, starts, window, bits=bits)
            doc = np.searchsorted(starts, first, "right") - 1
            at = pa.array(doc)
            packed = (first - starts[doc]) << 2 * _BITS | (last - first + 1) << _BITS | (anchor - first)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(batch.column(k).take(at) for k in KEY), pa.array(packed)], ["h", *KEY, "p"])

    return base.select(*KEY, "text").mapInArrow(run, f"h long, {KEY_TYPES}, p long")


def contents(base: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(h, many, o, d, t, u, s, x): the bytes of the entries that ``wanted`` lists per document."""

    def run(batches):
        for batch in slices(batches, "text", CHUNK):
            entries = batch.column("entries")
            owner = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(entries).to_numpy(zero_copy_only=False))
            field = {f.name: v for f, v in zip(entries.type.value_type, entries.flatten().flatten(), strict=True)}
            p = field["p"].to_numpy(zero_copy_only=False).astype(np.int64)
            many, low = (p & 1).astype(bool), (1 << _BITS) - 1
            s, n, o = p >> 2 * _BITS + 1, p >> _BITS + 1 & low, p >> 1 & low
            raw = text_bytes(batch.column("text"))
            for first in range(0, len(owner), 1 << 14):  # entries overlap, so their bytes come in parts
                cut = slice(first, first + (1 << 14))
                x = [raw[i][a:b] for i, a, b in zip(owner[cut].tolist(), s[cut].tolist(), (s[cut] + n[cut] + window - 1).tolist(), strict=True)]
                at, size = pa.array(owner[cut]), len(x)
                yield pa.RecordBatch.from_arrays(
                    [field["h"].slice(first, size), pa.array(many[cut]), pa.array(o[cut].astype(np.int32)), *(batch.column(k).take(at) for k in KEY), pa.array(s[cut].astype(np.int32)), pa.array(x, pa.binary())],
                    ["h", "many", "o", *KEY, "s", "x"],
                )

    return base.join(wanted, KEY).select(*KEY, "text", "entries").mapInArrow(run, f"h long, many boolean, o int, {KEY_TYPES}, s int, x binary")


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of the given lengths: the item of each unit and its place in the item."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def window_classes(buffer: np.ndarray, valid: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the valid windows in suffix order, and a number for each that equal windows share."""
    order = suffix_array(buffer)
    order = order[valid[order]]
    if len(order) < 2:
        return order, np.zeros(len(order), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(buffer, window)
    same = np.concatenate([(view[order[k : k + 65536]] == view[order[k + 1 : k + 65537]]).all(1) if k + 65537 <= len(order) else (view[order[k:-1]] == view[order[k + 1 :]]).all(1) for k in range(0, len(order) - 1, 65536)])
    return order, np.concatenate([[0], np.cumsum(~same)])


def later_windows(h: np.ndarray, o: np.ndarray, rank: np.ndarray, s: np.ndarray, x: list[bytes], window: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, first, end): runs of bytes of the entries under windows that an earlier entry of the same anchor has.

    ``rank``: the place of each entry's document in the order of documents, equal for entries of one document.
    """
    # Equal entries are one string; the earliest stands for them, the others are repeats.
    strings: dict[tuple[int, int, bytes], int] = {}
    own = np.array([strings.setdefault(key, len(strings)) for key in zip(h.tolist(), o.tolist(), x, strict=True)])
    by = np.lexsort((s, rank, own))
    fresh = np.concatenate([[True], own[by][1:] != own[by][:-1]])
    head = by[fresh]  # of each string in turn
    lead = head[own]
    copies = np.flatnonzero((rank != rank[lead]) | (s != s[lead]))
    gone_e, gone_a, gone_b = [copies], [s[copies]], [s[copies] + np.array([len(x[i]) for i in copies.tolist()], np.int64)]
    h, o, e_rank, e_s, x = h[head], o[head], rank[head], s[head], [x[i] for i in head.tolist()]
    done = lambda: tuple(np.concatenate(v) for v in (gone_e, gone_a, gone_b))
    # Windows that seem to stand in another string of the anchor, or twice in one.
    buffer, starts = lay(x)
    n = np.diff(starts) - window  # lay adds a byte
    entry, place = spread(n)
    at = starts[entry] + place
    hashes = RunHasher(buffer)(at, at + window) >> np.uint64(64 - bits)
    key = mix64(hashes + h[entry].view(np.uint64) * _GROUP_ODD + (place - o[entry]).astype(np.uint64) * _PLACE_ODD)
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    shared = count[which] > 1
    if not shared.any():
        return done()
    # Pieces: runs of such windows; equal pieces are one string.
    kept = np.flatnonzero(shared)
    breaks = np.flatnonzero((np.diff(kept, prepend=-2) != 1) | (np.diff(entry[kept], prepend=-1) != 0))
    firsts, lasts = kept[breaks], kept[np.append(breaks[1:], len(kept)) - 1]
    p_entry, p_place, p_count = entry[firsts], place[firsts], lasts - firsts + 1
    raw = buffer.tobytes()
    pieces: dict[tuple[int, int, bytes], int] = {}
    p_string = np.array([
        pieces.setdefault((g, r, raw[a:b]), len(pieces))
        for g, r, a, b in zip(h[p_entry].tolist(), (p_place - o[p_entry]).tolist(), at[firsts].tolist(), (at[lasts] + window).tolist(), strict=True)
    ])
    text = np.frombuffer(b"".join(k[2] for k in pieces), np.uint8)
    length = np.array([len(k[2]) for k in pieces])
    begin = np.cumsum(length) - length
    owner, offset = spread(length)
    order, number = window_classes(text, offset <= length[owner] - window, window)
    class_at = np.zeros(len(text), np.int64)
    class_at[order] = number
    # Every window of every piece with its class; the earliest of a class stays.
    piece, step = spread(p_count)
    e, j = p_entry[piece], p_place[piece] + step
    cls, start = class_at[begin[p_string[piece]] + step], e_s[e] + j
    by = np.lexsort((start, e_rank[e], cls))
    first = np.concatenate([[True], cls[by][1:] != cls[by][:-1]])
    lead = by[np.flatnonzero(first)[np.cumsum(first) - 1]]
    later = np.zeros(len(e), bool)
    later[by] = (start[by] != start[lead]) | (e_rank[e][by] != e_rank[e][lead])
    gone = np.flatnonzero(later)
    if len(gone):
        cut = np.flatnonzero((np.diff(gone, prepend=-2) != 1) | (np.diff(piece[gone], prepend=-1) != 0))
        a, b = gone[cut], gone[np.append(cut[1:], len(gone)) - 1]
        gone_e, gone_a, gone_b = [*gone_e, head[e[a]]], [*gone_a, start[a]], [*gone_b, start[b] + window]
    return done()


def ranks(d: np.ndarray, t: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The place of each row's document in the order of documents."""
    by = np.lexsort((u, t, d))
    new = np.concatenate([[0], (np.diff(d[by]) != 0) | (np.diff(t[by]) != 0) | (np.diff(u[by]) != 0)])
    out = np.empty(len(d), np.int64)
    out[by] = np.cumsum(new)
    return out


MARK = [*KEY, "s", "e"]


def shared_windows(entries: DataFrame, window: int, bits: int = 64) -> DataFrame:
    """(d, t, u, s, e): repeats among the entries of each anchor. The entries of an anchor meet in one task, in a row."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(batch):
            number = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("h", "o", *KEY, "s")}
            h, rank = number["h"], ranks(*(number[k] for k in KEY))
            x = batch.column("x").to_pylist()
            sizes = np.array([len(v) for v in x])
            edges = np.flatnonzero(np.diff(h, append=~h[-1:]) != 0) + 1  # ends of anchors
            start = 0
            upto = np.cumsum(sizes)
            while start < len(h):
                base = upto[start - 1] if start else 0
                k = np.searchsorted(edges, start, "right")
                fit = np.searchsorted(upto[edges[k:] - 1], base + TOGETHER, "right")
                end = int(edges[k + max(int(fit), 1) - 1])
                cut = slice(start, end)
                if end - start > 1:
                    e, a, b = later_windows(h[cut], number["o"][cut], rank[cut], number["s"][cut], x[cut], window, bits)
                    if len(e):
                        at = pa.array(e + start)
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in KEY), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], MARK)
                start = end

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            h = batch.column("h")
            if h[0] == h[-1] and (len(held) == 1 or held[0].column("h")[-1] == h[-1]):
                continue  # still the same anchor
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            h = table.column("h").to_numpy()
            last = int(np.flatnonzero(h != h[-1])[-1]) + 1
            yield from flush(table.slice(0, last))
            held = [table.slice(last)]
        if held:
            yield from flush(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return entries.select("h", "o", *KEY, "s", "x").repartition("h").sortWithinPartitions("h").mapInArrow(run, f"{KEY_TYPES}, s int, e int")


def cells(entries: DataFrame, window: int, bits: int = 64) -> DataFrame:
    """(h, o, d, t, u, s, x): the entries cut into cells of neighbouring windows; ``h`` also covers the bytes that all windows of the cell share."""

    def run(batches):
        for batch in slices(batches, "x", CHUNK):
            x = batch.column("x").to_pylist()
            buffer, starts = lay(x)
            h, o, s = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("h", "o", "s"))
            n = np.diff(starts) - window
            low = -o // CELL
            entry, step = spread((n - 1 - o) // CELL - low + 1)
            cell = low[entry] + step
            place = cell * CELL + o[entry]
            first, last = np.maximum(place, 0), np.minimum(place + CELL, n[entry])
            base = starts[entry]
            shared = RunHasher(buffer)(base + place + CELL - 1, base + place + window) >> np.uint64(64 - bits)
            group = mix64(shared + h[entry].view(np.uint64) * _GROUP_ODD + cell.astype(np.uint64) * _PLACE_ODD)
            raw, at = buffer.tobytes(), pa.array(entry)
            cut = [raw[a:b] for a, b in zip((base + first).tolist(), (base + last + window - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group.view(np.int64)), pa.array((o[entry] - first).astype(np.int32)), *(batch.column(k).take(at) for k in KEY), pa.array((s[entry] + first).astype(np.int32)), pa.array(cut, pa.binary())],
                ["h", "o", *KEY, "s", "x"],
            )

    return entries.select("h", "o", *KEY, "s", "x").mapInArrow(run, f"h long, o int, {KEY_TYPES}, s int, x binary")


def single_windows(entries: DataFrame, window: int) -> DataFrame:
    """(h, o, d, t, u, s, x): every window of the entries as an entry of its own; ``h`` is 0, as the bytes tell all."""

    def run(batches):
        for batch in slices(batches, "x", CHUNK >> 4):
            s = batch.column("s").to_numpy(zero_copy_only=False).astype(np.int64)
            x = batch.column("x").to_pylist()
            entry, place = spread(np.array([len(v) - window + 1 for v in x], np.int64))
            at, none = pa.array(entry), np.zeros(len(entry), np.int64)
            cut = [x[i][j : j + window] for i, j in zip(entry.tolist(), place.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(none), pa.array(none.astype(np.int32)), *(batch.column(k).take(at) for k in KEY), pa.array((s[entry] + place).astype(np.int32)), pa.array(cut, pa.binary())],
                ["h", "o", *KEY, "s", "x"],
            )

    return entries.select(*KEY, "s", "x").mapInArrow(run, f"h long, o int, {KEY_TYPES}, s int, x binary")


def distinct_entries(entries: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """The earliest of all entries with equal bytes (h, o, d, t, u, s, x), and the marks of the others. Equal entries are combined before they are dealt."""
    place = F.struct(*KEY, "s")
    same = ["h", "o", "x"]
    found = scratch.write(entries.groupBy(*same).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("k")), name)
    copied = found.where("k > 1").select(*same, "first")
    marks = entries.join(copied, same).where(place != F.col("first")).select(*KEY, "s", (F.col("s") + F.length("x")).alias("e"))
    return found.select("h", "o", *(F.col("first").getField(k).alias(k) for k in (*KEY, "s")), "x"), marks


def crowded_marks(entries: DataFrame, scratch: Scratch, window: int, group: int, bits: int) -> DataFrame:
    """Marks of entries whose anchors have more of them than one task should compare.

    Each step's marks are written at once, so that its shuffle files and tables go before the next step's come.
    """
    parts, level, before = [], entries, []
    for name, finer in (("entries", lambda rows: cells(rows, window, bits)), ("cells", lambda rows: single_windows(rows, window)), ("windows", None)):
        lone, copies = distinct_entries(level, scratch, f"{name}-distinct")
        scratch.sweep()
        parts.append(scratch.write(copies, f"{name}-copies"))
        scratch.drop(*before)
        scratch.sweep()
        if finer is None:
            break
        sizes = scratch.write(lone.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), f"{name}-sizes")
        few, many = sizes.where(F.col("m") <= group).select("h"), sizes.where(F.col("m") > group).select("h")
        parts.append(scratch.write(shared_windows(lone.join(few, "h"), window, bits), f"{name}-few"))
        scratch.sweep()
        if not many.limit(1).count():
            break
        level, before = scratch.write(finer(lone.join(many, "h")), f"{name}-cut"), [f"{name}-cut"]
        scratch.drop(f"{name}-distinct", f"{name}-sizes")
        scratch.sweep()
    return reduce(DataFrame.unionByName, parts)


def repeat_marks(base: DataFrame, scratch: Scratch, window: int = WINDOW, group: int = GROUP, bits: int = 64) -> DataFrame:
    """(d, t, u, spans): the byte ranges to remove from each document that has any."""
    rows = scratch.write(window_rows(base, window, bits), "rows")
    twice = scratch.write(rows.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h", (F.col("k") > group).alias("many")), "twice")
    scratch.sweep()
    listed = rows.join(twice, "h").select(*KEY, F.struct("h", (F.shiftleft("p", 1) + F.col("many").cast("long")).alias("p")).alias("entry"))
    wanted = scratch.write(listed.groupBy(*KEY).agg(F.collect_set("entry").alias("entries")), "wanted")
    scratch.drop("rows", "twice")
    scratch.sweep()
    found = scratch.write(contents(base, wanted, window), "contents")
    scratch.drop("wanted")
    scratch.sweep()
    marks = scratch.write(shared_windows(found.where("not many"), window, bits), "few")
    scratch.sweep()
    crowd = found.where("many")
    if crowd.limit(1).count():
        marks = marks.unionByName(crowded_marks(crowd.drop("many"), scratch, window, group, bits))
    spans = scratch.write(marks.groupBy(*KEY).agg(F.collect_list(F.struct("s", "e")).alias("spans")), "marks")
    scratch.keep("marks")
    scratch.sweep()
    return spans


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPANS = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, group: int = GROUP, as_text: bool = False, bits: int = 64) -> DataFrame:
    """All rows and columns with ``spans`` (removed byte ranges, maximal) and ``kept`` (the remaining bytes) added.

    With ``as_text`` there is ``kept_text`` instead: a cut inside a character leaves a part of it, which is dropped.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    marks = repeat_marks(keyed(docs, doc_id, text), scratch, window, group, bits)
    output = "kept_text" if as_text else "kept"
    others = [c for c in docs.columns if c not in ("spans", output)]
    carried = docs.select(*(column(c) for c in others if c != text))  # the text travels once, beside the box
    tagged = docs.select(boxed(carried), column(text).alias("text"), *document(doc_id, text)).join(marks, KEY, "left").select("row", "text", F.col("spans").alias("marked"))

    def run(batches):
        for batch in slices(batches, "text"):
            spans, kept = [], []
            for raw, marked in zip(text_bytes(batch.column("text")), batch.column("marked").to_pylist(), strict=True):
                cut = merged(marked)
                at, parts = 0, []
                for a, b in cut:
                    parts.append(raw[at:a])
                    at = b
                parts.append(raw[at:])
                spans.append([{"s": a, "e": b} for a, b in cut])
                kept.append(b"".join(parts))
            result = pa.array([k.decode(errors="ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            spans = pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), spans, result], ["row", "text", "spans", "result"])

    schema = T.StructType([T.StructField("row", carried.schema), tagged.schema["text"], T.StructField("spans", SPANS), T.StructField("result", T.StringType() if as_text else T.BinaryType())])
    columns = [F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in others]
    return tagged.mapInArrow(run, schema).select(*columns, "spans", F.col("result").alias(output))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return found.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
