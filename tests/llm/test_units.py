"""Kernels against brute force."""

import random
import zlib

import numpy as np
import pytest

from sozgar.llm.anchors import anchors
from sozgar.llm.html import main_text
from sozgar.llm.hyperminhash import band_keys, estimate, registers
from sozgar.llm.learning import BoostedTrees, Isotonic
from sozgar.llm.packing import best_fit, bin_completion, dominated, lower_bound, search
from sozgar.llm.quality import QualityModel, forward_backward
from sozgar.llm.shingles import shingle_sets
from sozgar.llm.suffixes import suffix_array
from sozgar.llm.tiff import decode_page, directories, encode_tiff, lzw_decode, lzw_encode, packbits_decode, packbits_encode, pages_of
from sozgar.llm.toxicity import ToxicityModel
from sozgar.llm.words import lay


@pytest.mark.parametrize("scheme", ["none", "packbits", "lzw", "deflate"])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", ["u1", "u2", "u4"])
def test_tiff(scheme, predictor, tile, order, kind):
    r = np.random.default_rng(3)
    pages = [(r.integers(0, 7, (37, 21, n)) * r.integers(0, 2, (37, 1, 1)) * 31).astype(kind) for n in (1, 3)]
    data = encode_tiff(pages, scheme, predictor, rows_per_strip=10, tile=tile, order=order)
    found = [decode_page(data, *d)[0] for d in directories(data)]
    assert len(found) == 2 and all((a == b).all() and a.dtype == b.dtype for a, b in zip(found, pages, strict=True))


@pytest.mark.parametrize(("encode", "decode"), [(packbits_encode, packbits_decode), (lzw_encode, lzw_decode)])
def test_compression(encode, decode):
    r = random.Random(1)
    for n in [0, 1, 2, 3, 127, 128, 129, 500, 20_000]:
        for letters in (1, 2, 200):
            raw = bytes(r.randrange(letters) for _ in range(n))
            assert decode(encode(raw), n) == raw
    raw = b"".join(bytes([r.randrange(256)]) * r.randrange(1, 300) for _ in range(200))
    assert decode(encode(raw), len(raw)) == raw


def test_broken_tiff():
    data = encode_tiff([np.zeros((5, 5), np.uint8)] * 2)
    for cut in range(0, len(data), 3):
        pages = list(pages_of(data[:cut]))
        assert not pages or pages[-1]["error"] or len(pages) == 2
    looped = bytearray(data)
    at = int.from_bytes(data[4:8], "little")
    n = int.from_bytes(data[at : at + 2], "little")
    looped[at + 2 + 12 * n : at + 6 + 12 * n] = data[4:8]
    assert [p["error"] for p in pages_of(bytes(looped))] == [None, "the directories form a loop"]
    assert list(pages_of(None)) == [] and list(pages_of(b"")) == []


def packs(counts, runs, capacity):
    used = {}
    for n, pattern in runs:
        assert sum(s * m for s, m in pattern) <= capacity
        for s, m in pattern:
            used[s] = used.get(s, 0) + n * m
    assert used == counts
    return sum(n for n, _ in runs)


def test_bin_completion_is_optimal_on_small_cases():
    r = random.Random(5)

    def least(items, capacity):
        best = [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for room in set(bins):
                if room >= items[i]:
                    rest = list(bins)
                    rest.remove(room)
                    go(i + 1, [*rest, room - items[i]])
            go(i + 1, [*bins, capacity - items[i]])

        go(0, [])
        return best[0]

    for _ in range(150):
        capacity = r.choice([10, 30, 50])
        items = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 9))), reverse=True)
        counts = {s: items.count(s) for s in items}
        n = least(items, capacity)
        assert lower_bound(counts, capacity) <= n <= packs(counts, best_fit(counts, capacity), capacity)
        assert packs(counts, bin_completion(counts, capacity), capacity) == n


def histogram(r, n, low, high):
    counts = {}
    for _ in range(n):
        s = r.randint(low, high)
        counts[s] = counts.get(s, 0) + 1
    return counts


def test_bin_completion_beats_best_fit():
    assert bin_completion({}) == []
    huge = {3000: 10**9, 1096: 10**9, 1: 7}
    assert packs(huge, bin_completion(huge, 4096), 4096) == 10**9 + 1
    r = random.Random(9)
    few = {s: 6000 + 100 * k for k, s in enumerate([1500, 1300, 1296, 1100, 1024, 900, 872, 640])}
    for counts, better in ((histogram(r, 5000, 800, 2600), 10), (histogram(r, 5000, 600, 1500), 5), (histogram(r, 50_000, 700, 1100), 50), (few, 500)):
        found = search(dict(counts), 4096)
        assert packs(counts, found.runs, 4096) == found.sequences and found.found_by == "bin completion" and not found.proven
        assert found.bound <= found.sequences <= found.best_fit - better


def test_bin_completion_near_the_bound():
    """60 pieces of 800 to 2600 in 60 histograms: the gaps to the bound add up to 24 at most, of best fit to more."""
    r = random.Random(1)
    gap = plain = 0
    for _ in range(60):
        counts = histogram(r, 60, 800, 2600)
        found = search(dict(counts), 4096)
        assert packs(counts, found.runs, 4096) == found.sequences >= found.bound == lower_bound(counts, 4096)
        gap, plain = gap + found.sequences - found.bound, plain + found.best_fit - found.bound
    assert gap <= 24 < plain


def test_dominance():
    def plain(filling, room, counts):
        items = [s for s, m in filling.items() for _ in range(m)]
        out = [s for s, n in counts.items() if n > filling.get(s, 0)]
        spare = room - sum(items)
        for bits in range(1 << len(items)):
            chosen = [s for i, s in enumerate(items) if bits >> i & 1]
            if any(sum(chosen) < x <= sum(chosen) + spare or (x == sum(chosen) and len(chosen) > 1) for x in out):
                return True
        return False

    r = random.Random(4)
    seen = set()
    for _ in range(2000):
        counts = {s: r.randint(1, 3) for s in r.sample(range(1, 14), r.randint(1, 6))}
        filling = {s: r.randint(1, n) for s, n in counts.items() if r.random() < 0.5}
        room = sum(s * m for s, m in filling.items()) + r.randint(0, 4)
        found = dominated(filling, room, sum(1 << s for s in counts), counts)
        assert found == plain(filling, room, counts)
        seen.add(found)
    assert len(seen) == 2


def test_suffix_array():
    r = random.Random(2)
    for _ in range(600):
        s = bytes(r.choice(r.choice([b"ab", b"a", b"abcd"])) for _ in range(r.randint(0, 50))) * r.randint(1, 3)
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    assert suffix_array(np.array([5, 300, 5, 300, 1])).tolist() == [4, 2, 0, 3, 1]


def test_anchors_cover_every_window():
    r = random.Random(4)
    texts = [bytes(r.choice(b"abc ") for _ in range(n)) for n in (0, 99, 100, 101, 700)] + [b"xy" * 200]
    buffer, starts = lay(texts)
    anchor, _, first, last = anchors(buffer, starts, 100)
    covered = sorted(i for a, b in zip(first.tolist(), last.tolist(), strict=True) for i in range(a, b + 1))
    assert covered == [s + k for s, t in zip(starts[:-1].tolist(), texts, strict=True) for k in range(len(t) - 99)]
    assert ((anchor >= last) & (anchor + 20 <= first + 100)).all()


def test_sketches():
    r = np.random.default_rng(1)
    for n in (1, 3, 7, 50, 3000):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        sketch = registers([a, a])
        assert (sketch[0] == sketch[1]).all() and (band_keys(sketch)[0] == band_keys(sketch)[1]).all()
    a = np.unique(r.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[:3600], r.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    sketch = registers([a, b])
    found, used = estimate(sketch[:1], sketch[1:], np.array([len(a)]), np.array([len(b)]))
    assert abs(found[0] - true) < 5 * np.sqrt(true * (1 - true) / used[0])


def test_shingle_sets():
    texts = [b"", b"  ", b"One", b"one", b"a b c d", b"a b c d e", b"A b\tc d\ne f", b"x " * 50]
    assert [len(s) for s in shingle_sets(texts)] == [0, 0, 1, 1, 1, 1, 2, 1]
    s = shingle_sets(texts)
    assert (s[2] == s[3]).all() and s[5][0] in s[6] and s[4][0] != s[5][0]


def test_forward_backward_against_enumeration():
    import itertools

    r = np.random.default_rng(0)
    lengths = [1, 4, 3, 0, 2]
    first = np.concatenate([[0], np.cumsum(lengths)])
    emission, step = r.normal(size=10), r.normal(size=(2, 2))
    marginal, pairs = forward_backward(emission, step, first)
    total = np.zeros((2, 2))
    for a, b in zip(first, first[1:], strict=False):
        mass, ones, two = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(b - a)):
            w = np.exp(sum(emission[a + i] * v for i, v in enumerate(y)) + sum(step[u, v] for u, v in zip(y, y[1:], strict=False)))
            mass += w
            ones += w * np.array(y)
            for u, v in zip(y, y[1:], strict=False):
                two[u, v] += w
        if b > a:
            assert np.allclose(marginal[a:b], ones / mass)
            total += two / mass
    assert np.allclose(pairs, total)


def test_trees_and_calibration():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    margin = BoostedTrees(trees=30, depth=3).fit(x[:1500], y[:1500]).margin(x[1500:])
    assert ((margin > 0) == (y[1500:] == 1)).mean() > 0.97
    scale = Isotonic().fit(margin, y[1500:])
    values = scale(np.linspace(-10, 10, 50))
    assert (np.diff(values) >= 0).all() and values.min() >= 0 and values.max() <= 1
    assert (Isotonic().fit(np.zeros(0), np.zeros(0), 0.2)(np.zeros(3)) == 0.2).all()
    assert len(BoostedTrees().fit(np.zeros((0, 3)), np.zeros(0)).margin(np.zeros((2, 3)))) == 2


def text_of(r, junk, toxic):
    sentence = lambda: " ".join("".join(r.choice("abdeginorst") for _ in range(r.randint(2, 8))) for _ in range(12))
    lines = [sentence() for _ in range(5)]
    if toxic:
        lines[2] += " you are a stupid id1ot you worthless trash"
    if junk:
        lines = [" ".join(w + r.choice(["$$$", "###", "&&&"]) for w in x.split()) for x in lines]
    return "\n".join(lines).encode()


def test_models_on_held_out_texts():
    r = random.Random(3)
    rows = [(text_of(r, k % 3 == 0, k % 5 == 0), float(k % 3 != 0), float(k % 5 == 0)) for k in range(400)]
    for model, label, limit in ((QualityModel(), 1, 0.5), (ToxicityModel(), 2, 0.5)):
        model.fit([x[0] for x in rows[:300]], np.array([x[label] for x in rows[:300]]))
        scores = model([x[0] for x in rows[300:]])
        assert ((scores > limit) == (np.array([x[label] for x in rows[300:]]) == 1)).mean() > 0.97
        assert len(model([b""])) == 1 and len(model([])) == 0


def test_html_layouts():
    page = """<html><head><title>T</title><script>var a="<p>x</p>";</script></head><body><header>Site</header><nav><a href=/>Home</a></nav>
    <div class="cookie-notice">We use cookies, really.</div><div id="content"><h1>Bosh sarlavha</h1><p>Birinchi xat boshi, uzun matn bilan &amp; vergul.<br>Davomi<p>Ikkinchi
    xat&nbsp;boshi.<ul><li>Bir<li>Ikki</ul><form><input><button>OK</button></form></div>
    <aside>Related</aside><div class="comments"><p>Reader comment, long, long, with, many, commas, that, should, not, win, at, all.</p></div><footer>&copy; 2024</footer></body></html>"""
    assert main_text(page) == "Bosh sarlavha\n\nBirinchi xat boshi, uzun matn bilan & vergul. Davomi\n\nIkkinchi xat boshi.\n\nBir\n\nIkki"
    assert main_text(None) == "" and main_text("<nav>menu</nav>") == "" and main_text("plain text") == "plain text"


def test_word_encoder_matches_the_tokenizer():
    from sozgar.llm.packing import tokenizer_path
    from sozgar.llm.tokenize import WordEncoder

    encoder = WordEncoder(tokenizer_path())
    texts = ["", "Salom, dunyo.", "don't we'll 12,3 ...x,. İstanbul ΣΑΣ, é́x", "A<|endoftext|>b", "x\x1cy\x85z\xa0w", "end.\nNext, line . , a.b a,b", "é. ö, ."]
    for _ in range(2):
        assert encoder.ids([t.encode() for t in texts]) == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert zlib.crc32(b"") == 0


def test_components(spark):
    from sozgar.llm.common import Scratch
    from sozgar.llm.components import components

    r = random.Random(6)
    path = list(range(1000, 1400))
    r.shuffle(path)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + list(zip(path, path[1:], strict=False)) + [(k, k + 1) for k in range(2000, 2300)] + [(5000 + k, 5000) for k in range(200)] + [(7, 7)]
    root = {v: v for e in edges for v in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert sorted((x.v, x.label) for x in found) == sorted((v, find(v)) for v in root)
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).collect() == []
