"""Every operator's query and every pipeline stage on awkward tables, against brute force; and on empty tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from .conftest import edge_rows

from sozgar.llm.queries import QUERIES


def run(spark, name, folder):
    return QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, edge, name):
    assert run(spark, name, edge[1]) == []


def test_tiff_round_trip(spark, edge):
    found = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in run(spark, "op1_tiff", edge[0]))
    wanted = Counter()
    for i, text, *_ in edge_rows():
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        wanted[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert found == wanted


def test_packing(spark, edge):
    from tokenizers import Tokenizer

    from sozgar.llm.packing import tokenizer_path

    tokenizer = Tokenizer.from_file(tokenizer_path())
    wanted = Counter()
    total = 0
    for i, text, *_ in edge_rows():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4").tobytes()
            wanted[i, piece, at, len(part) // 4, zlib.crc32(part)] += 1
    rows = run(spark, "op2_pack", edge[0])
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) == math.ceil(total / 4096)


@pytest.mark.parametrize(("name", "threshold"), [("op3_quality", 0.7), ("op5_toxicity", 0.3)])
def test_scores(spark, edge, name, threshold):
    rows = run(spark, name, edge[0])
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in edge_rows())
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1


def test_pages(spark, edge):
    found = Counter((r.page_id, r.text, r.n_chars) for r in run(spark, "op4_extract", edge[0]))
    assert found[3, "Bir, ikki & uch", 15] == 2 and found[1, "", 0] == 1 and found[2, "", 0] == 1 and found[4, "chuqur", 6] == 1


def repeated(rows, window=100):
    """What the repeat operator should keep, by looking at every window."""
    import xxhash

    docs = sorted({(math.inf if i is None else i, text or "") for i, text, *_ in rows}, key=lambda x: x[0])
    seen, out = set(), {}
    for i, text in docs:
        raw, gone = text.encode(), bytearray(len(text.encode()))
        for k in range(len(raw) - window + 1):
            key = xxhash.xxh3_128_digest(raw[k : k + window])
            if key in seen:
                gone[k : k + window] = b"\1" * window
            seen.add(key)
        out[i, text] = (len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(bytes(c for c, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("group", [1024, 1])
def test_repeats(spark, edge, group):
    from sozgar.llm.repeats import without_repeats

    wanted = repeated(edge_rows())
    assert sum(v[1] for v in wanted.values()) > 1000
    rows = without_repeats(spark.read.parquet(f"{edge[0]}/documents.parquet").select("doc_id", "text", "lang"), group=group).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        kept = bytes(r.kept)
        n = len((r.text or "").encode())
        assert (n, n - len(kept), len(r.spans), hashlib.sha256(kept).hexdigest()) == wanted[math.inf if r.doc_id is None else r.doc_id, r.text or ""]


def test_shards(spark, edge):
    rows = run(spark, "op7_interleave", edge[0])
    assert len(rows) == len(edge_rows())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(24)]
    assert max(counts) - min(counts) <= 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in edge_rows())


def test_nearest(spark, edge):
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in run(spark, "op8_nearest", edge[0])}
    good = {0: (1, 0), 50: (1, 1), 1: (1, 0), 2: (2, 0), 8: (0.5, 0.5), 100: (-1.0, np.float32(0.1))}
    for q in (0, 50, 100):
        near = sorted((-np.dot(good[q], v) / (np.linalg.norm(good[q]) * np.linalg.norm(v)), i) for i, v in good.items() if i != q)[:5]
        for k, (s, i) in enumerate(near, 1):
            assert found[q, k][0] == i or abs(found[q, k][1] + s) < 1e-12
            assert abs(found[q, k][1] + s) < 1e-12
    assert len(found) == 15


def shingles(text):
    import re

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(spark, edge):
    rows = run(spark, "op9_neardup", edge[0])
    sets = {i: shingles(t) for i, t, *_ in edge_rows() if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert len(rows) == len(edge_rows())
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}


def test_mixing(spark, edge):
    rows = run(spark, "op10_mix", edge[0])
    assert len(rows) == len(edge_rows())
    total = sum(r.size for r in rows)
    by = {r.source_size: r.target for r in rows}
    assert abs(sum(by.values()) - total) <= 0.01 * total + 1e-6 or len(by) < 6
    for r in rows:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-9
    assert sorted((r.doc_id or -1, r.taken) for r in rows) == sorted((r.doc_id or -1, r.taken) for r in run(spark, "op10_mix", edge[0]))


def test_callers_columns_come_back_as_they_were(spark, edge):
    """Whatever the extra columns are called (inner names, names with dots), they are carried; only outputs replace columns of their names."""
    from sozgar.llm.html import extract
    from sozgar.llm.mixing import measured, mix_rows
    from sozgar.llm.packing import pack
    from sozgar.llm.repeats import without_repeats
    from sozgar.llm.sharding import interleave

    docs = spark.read.parquet(f"{edge[0]}/documents.parquet")
    n = docs.count()

    def carried(result, *outputs, source=docs):
        extra = [c for c in source.columns if c not in {"doc_id", "text", "lang", "source", "n_chars", *outputs}]
        names = [f"`{c.replace('`', '``')}`" for c in extra]
        assert set(result.columns) == set(source.columns) | set(outputs) and len(result.columns) == len(set(result.columns))
        assert result.select(*names).distinct().collect() == source.select(*names).distinct().collect() and result.count() == n

    dealt = interleave(docs, "source", ["doc_id", "text"], 3)
    carried(dealt, "shard", "slot")
    assert dealt.agg({"shard": "max"}).first()[0] == 2
    sized = measured(docs)
    carried(mix_rows(sized, "doc_id", "size", "weight", "source", "text_hash"), "source_size", "target", "copies", "taken", "size", "weight", "text_hash", source=sized)
    pieces = docs.drop("length", "offset").selectExpr("*", "7 AS length", "0 AS offset")
    packed = pack(pieces, "length", ["doc_id", "text"], 10)
    carried(packed, "sequence_id", "offset", source=pieces)
    assert packed.select("sequence_id").distinct().count() == n
    carried(without_repeats(docs), "spans", "kept")
    carried(without_repeats(docs, as_text=True), "spans", "kept_text")
    page = docs.withColumn("html", F.lit("<p>x</p>")).drop("text", "n_chars")
    carried(extract(page).drop("html"), "text", "n_chars", source=page.drop("html"))


def test_many_equal_rows(spark):
    """Equal rows share no task and each counts: sharding, mixing and packing of one row that stands 3000 times."""
    from sozgar.llm.mixing import measured, mix_rows
    from sozgar.llm.packing import pack
    from sozgar.llm.sharding import interleave

    rows = [(None, "one two three", "a", 5)] * 3000 + [(i, f"w{i} " * (i % 9), "b", i % 9 + 1) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, length int")
    dealt = interleave(df, "source", ["doc_id", "text"], 7).collect()
    slots = defaultdict(list)
    for r in dealt:
        slots[r.shard].append(r.slot)
    assert len(dealt) == 3200 and all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(abs(sum(r.source == "b" for r in dealt if r.shard == k) - 200 / 7) < 2 for k in range(7))
    mixed = mix_rows(measured(df), "doc_id", "size", "weight", "source", "text_hash").collect()
    assert len(mixed) == 3200
    for name in ("a", "b"):
        mine = [r for r in mixed if r.source == name]
        assert sum(r.size for r in mine) == mine[0].source_size
        assert 0 <= mine[0].target - sum(r.taken for r in mine) <= 8 and all(r.taken <= 3 * r.size for r in mine)
    packed = pack(df, "length", ["doc_id", "text"], 16).collect()
    held = defaultdict(list)
    for r in packed:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        assert [o for o, _ in sorted(parts)] == [sum(x for _, x in sorted(parts)[:k]) for k in range(len(parts))] and sum(x for _, x in parts) <= 16
    assert len(packed) == 3200


def test_release_removes_scratch_tables(spark, edge):
    import os

    from sozgar.llm.common import release, shared_dir
    from sozgar.llm.neardup import near_duplicates

    near_duplicates(spark.read.parquet(f"{edge[0]}/documents.parquet").select("doc_id", "text")).collect()
    folder = shared_dir(spark).removeprefix("file:")
    assert [x for x in os.listdir(folder) if x.startswith("neardup-")]
    release(spark)
    assert not [x for x in os.listdir(folder) if x.startswith("neardup-")]
