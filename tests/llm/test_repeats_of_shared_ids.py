"""Repeats among many different texts without an id, or with the same one."""

from collections import Counter

import pytest

from sozgar.llm import anchors, repeats
from sozgar.llm.repeats import document, without_repeats
from tests.llm.conftest import words

LARGEST = (1 << 63) - 1


def kept_bytes(docs: list[tuple], window: int = 100) -> Counter:
    """(id, text, kept) by looking at every window of the documents in their order."""
    seen, out = set(), Counter()
    for i, text in docs:
        raw = text.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - window + 1):
            if raw[k : k + window] in seen:
                gone[k : k + window] = b"\1" * window
            seen.add(raw[k : k + window])
        out[i, text, bytes(c for c, g in zip(raw, gone, strict=True) if not g)] += 1
    return out


def in_order(df):
    return df.select("doc_id", "text", *document("doc_id", "text")).distinct().orderBy("d", "t", "u").collect()


def check(df, **options):
    wanted = kept_bytes([(r.doc_id, r.text) for r in in_order(df)])
    found = Counter((r.doc_id, r.text, bytes(r.kept)) for r in without_repeats(df, **options).distinct().collect())
    assert found == wanted
    return sum((len(text.encode()) - len(kept)) * n for (_, text, kept), n in wanted.items())


@pytest.mark.parametrize("group", [1024, 4])
def test_texts_that_share_an_id_are_told_apart(spark, group):
    shared = [words(1000 + k, 40) for k in range(30)]
    rows = []
    for i, first in ((None, 0), (7, 5000), (LARGEST, 9000)):
        for k in range(400):
            before, after = words(2000 + first + k, 5 + k % 30), words(20_000 + first + k, 3 + k % 7)
            rows.append((i, f"{before} {shared[k % 30]} {after}" if k % 3 else before))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in in_order(df)][-400:] == [None] * 400
    assert check(df, group=group) > 10_000


def test_a_text_whose_other_hash_collides_keeps_its_bytes(spark, monkeypatch):
    """Two rows without an id whose first hash is equal are told apart by the second."""
    from pyspark.sql import functions as F

    plain = repeats.document
    monkeypatch.setattr(repeats, "document", lambda doc_id, text: [c if k != 1 else F.lit(5).cast("long").alias("t") for k, c in enumerate(plain(doc_id, text))])
    passage = words(1, 60)
    rows = [(None, f"{words(2, 9)} {passage}"), (None, f"{words(3, 200)}"), (None, f"{passage} {words(4, 30)}"), (None, words(5, 90))]
    found = {r.text: len(r.text) - len(bytes(r.kept)) for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[rows[1][1]] == found[rows[3][1]] == 0 and sorted(found.values())[:3] == [0, 0, 0] and max(found.values()) >= len(passage)


@pytest.mark.parametrize(("bits", "group"), [(8, 1024), (8, 16), (4, 3), (0, 50)])
def test_few_bits_of_hash_give_the_same_result(spark, bits, group):
    shared = [words(40 + k, 30) for k in range(5)]
    rows = [(k, " ".join([words(100 + k, 20 + k % 9), shared[k % 5], words(300 + k % 7, 25), "ab" * (20 * (k % 4))])) for k in range(40)]
    df = spark.createDataFrame(rows + rows[:5] + [(None, rows[3][1]), (None, ""), (50, None)], "doc_id long, text string").fillna({"text": ""})
    assert check(df, bits=bits, group=group) > 3000


def test_periodic_passages_across_a_place_that_wraps():
    """A window's anchor depends on its bytes alone, also around multiples of 2**20."""
    import numpy as np

    from sozgar.llm.words import lay

    passage = b"one two, one two three; " * 9
    filler = bytes(97 + (k * k + k // 7) % 26 for k in range((1 << 20) - 120))
    buffer, starts = lay([filler + passage + b"the end", b"x" + passage + b"y"])
    anchor, h, first, last = anchors.anchors(buffer, starts, 100)
    places = {}
    for a, b, f, e in zip(anchor.tolist(), h.tolist(), first.tolist(), last.tolist(), strict=True):
        for w in range(f, e + 1):
            places.setdefault(buffer[w : w + 100].tobytes(), set()).add((a - w, b))
    assert all(len(v) == 1 for v in places.values())
    values = np.random.default_rng(1).integers(0, 5, 3000).astype(np.uint64) << np.uint64(40)
    assert anchors.rightmost_least(values, 30).tolist() == [max(range(i, i + 30), key=lambda k: (-int(values[k]), k)) for i in range(len(values) - 29)]
