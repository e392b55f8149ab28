"""Quality and toxicity against plain re-implementations: features, marginals, scores that do not depend on the batch."""

import itertools
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sozgar.llm import quality, toxicity
from sozgar.llm.learning import labelled_sample
from sozgar.llm.toxicity import DISGUISE, NEAR, SECOND, Lexicon, ToxicityModel
from tests.llm.conftest import edge_rows
from tests.llm.test_units import text_of

TABLES = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"
LEXICON = Lexicon({"idiot": 2.0, "moron": 1.5, "loser": 1.0, "shit": 2.5, "cafard": 1.2, "ñandú": 3.0}, {"idio": 1.0, "schwach": 2.0, "ab": 0.5})
MARKS = b"#$%&*@^~_"
is_letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
lowered = lambda raw: bytes(c + 32 if 65 <= c <= 90 else c for c in raw)


def some_texts() -> list[bytes]:
    r = random.Random(8)
    made = [text_of(r, k % 3 == 0, k % 4 == 0) for k in range(30)]
    awkward = ["you IDIOT you id1ot! (m0r0n) idi*t", "Schwachkopf, schwachsinn tu es un cafard", "x" * 5000 + " sh1t." + "!" * 300, "a a A b\nB b\n\n\nÑANDÚ ñandú!!! |x|y| 3.14 1d10t", "...\n---\n!!!", "loser " * 50 + "you", "\r\n\t", "you " * 9 + "shit", "id1ot" + "9" * 60 + "idiot"]
    return [(t or "").encode() for _, t, *_ in edge_rows()] + made + [t.encode() for t in awkward]


def runs_of(raw: bytes, inside) -> list[bytes]:
    return [bytes(g) for k, g in itertools.groupby(raw, inside) if k]


def plain_toxicity(raw: bytes, lexicon: Lexicon) -> list[float]:
    table = {w.encode(): v for w, v in lexicon.words.items()}
    stems = {w.encode(): v for w, v in lexicon.stems.items()}
    holes = {(w[:i] + w[i + 1 :]) for w in lexicon.words if len(w) >= 5 for i in range(1, len(w) - 1)} - set(lexicon.words)
    holes = {h.encode() for h in holes}
    original = runs_of(raw, is_letter)
    words = [lowered(w) for w in original]
    stem = [max([v for s, v in stems.items() if w.startswith(s) and len(w) > len(s)], default=0.0) for w in words]
    weight = [max(table.get(w, 0.0), s) for w, s in zip(words, stem, strict=True)]
    second = [w in {x.encode() for x in SECOND} for w in words]
    hits = [i for i, v in enumerate(weight) if v > 0]
    near = sum(any(second[j] for j in range(max(i - NEAR, 0), min(i + NEAR + 1, len(words)))) for i in hits)
    tokens = raw.split()
    odd = lambda c: 48 <= c <= 57 or c in b"!" + MARKS + b"|.-"
    mixed = [t for t in tokens if any(map(odd, t)) and any(map(is_letter, t))]
    undo = {ord(a): ord(b) for a, b in DISGUISE.items()}

    def told(t: bytes) -> bool:
        plain = bytes(c for c in (undo.get(c, lowered(bytes([c]))[0]) for c in t) if is_letter(c))
        star, grown = b"*" in t or b"#" in t, len(plain) != sum(map(is_letter, t))
        return (table.get(plain, 0) > 0 and (grown or star)) or (plain in holes and star)

    def bare(t: bytes) -> bytes:
        inner = [i for i, c in enumerate(t) if is_letter(c) or 48 <= c <= 57 or c in b"@$+"]
        return t[inner[0] : inner[-1] + 1]

    disguised = sum(told(t) or told(bare(t)) for t in mixed)
    n, size, m = max(len(words), 1), max(len(raw), 1), max(len(hits), 1)
    count = lambda inside: sum(map(inside, raw))
    return [
        np.log1p(n), len(hits) / n, np.log1p(len(hits)), sum(weight) / n, max(weight, default=0.0), near / m, near / n, sum(second) / n, disguised / n, np.log1p(disguised), np.log1p(sum(s > 0 for s in stem)), float(len(hits) + disguised > 0),
        count(lambda c: 65 <= c <= 90) / size, sum(len(w) >= 3 and all(65 <= c <= 90 for c in w) for w in original) / n, raw.count(b"!") / size, raw.count(b"?") / size, count(lambda c: c in MARKS) / size, raw.count(b"|") / size,
        count(lambda c: 48 <= c <= 57) / size, count(lambda c: c in b".,;:") / size, count(lambda c: c >= 128) / size, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, size / n, len(mixed) / max(len(tokens), 1), raw.count(b"\n") / n,
    ]


def plain_lines(raw: bytes) -> list[list[float]]:
    lines = raw.split(b"\n")
    rows = []
    for line in lines:
        count = lambda inside, line=line: sum(map(inside, line))
        up, low, other = count(lambda c: 65 <= c <= 90), count(lambda c: 97 <= c <= 122), count(lambda c: c >= 128)
        words = [lowered(w) for w in line.split()]
        marked = [any(c in b"!|" + MARKS for c in w) for w in words]
        lettered = [any(map(is_letter, w)) for w in words]
        w, safe = max(len(words), 1), max(len(line), 1)
        rows.append([
            up / max(up + low + other, 1), float(up > 0.6 * max(up + low, 1)), count(lambda c: c in MARKS) / safe, line.count(b"|") / w, line.count(b"!") / w, count(lambda c: 48 <= c <= 57) / safe, count(lambda c: c in b".,;:") / w, (up + low + other) / safe,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / w, len(set(words)) / w, min(len(line) / w, 30) / 10, np.log1p(len(words)), sum(a and b for a, b in zip(marked, lettered, strict=True)) / w,
            sum(a and not b for a, b in zip(marked, lettered, strict=True)) / w, float(len(line) > 0 and sum(lowered(x) == lowered(line) for x in lines) > 1), float(len(line) == 0), other / safe,
        ])
    return rows


def plain_share(raw: bytes, field: quality.LineField) -> float:
    """The length-weighted good share of a text, line by line."""
    rows = plain_lines(raw)
    none = [0.0] * quality.WIDTH
    n = len(rows)
    scores = []
    for i, row in enumerate(rows):
        x = np.array([*row, *(rows[i - 1] if i else none), *(rows[i + 1] if i + 1 < n else none), 1.0, float(i == 0), float(i == n - 1)])
        scores.append(np.clip(float(((x - field.mean) / field.spread) @ field.weight), -40, 40))
    ahead, back = [np.array([0.0, scores[0]])], [np.zeros(2)]
    for s in scores[1:]:
        ahead.append(np.logaddexp(ahead[-1][0] + field.step[0], ahead[-1][1] + field.step[1]) + np.array([0.0, s]))
    for s in reversed(scores[1:]):
        back.append(np.logaddexp(field.step[:, 0] + back[-1][0], field.step[:, 1] + s + back[-1][1]))
    both = [a + b for a, b in zip(ahead, reversed(back), strict=True)]
    good = [np.exp(x[1] - np.logaddexp(*x)) for x in both]
    size = [len(line) + 1.0 for line in raw.split(b"\n")]
    return float(np.dot(good, size) / sum(size))


def test_toxicity_features():
    texts = some_texts()
    assert np.allclose(toxicity.features(texts, LEXICON), [plain_toxicity(t, LEXICON) for t in texts], rtol=1e-12, atol=1e-12)
    assert round(np.expm1(toxicity.features([b"id1ot" + b"!" * 60], LEXICON)[0, 9])) == 1  # however long the token is


def test_line_features_and_shares():
    texts = some_texts()
    rows, _, first = quality.line_features(texts)
    assert first.tolist() == np.cumsum([0, *(t.count(b"\n") + 1 for t in texts)]).tolist()
    assert np.allclose(rows, [row for t in texts for row in plain_lines(t)], rtol=1e-12, atol=1e-12)
    r = random.Random(3)
    model = quality.QualityModel().fit([text_of(r, k % 3 == 0, False) for k in range(90)], np.array([float(k % 3 != 0) for k in range(90)]))
    shares = np.array([plain_share(t, model.field) for t in texts])
    assert np.allclose(model(texts), np.clip(0.999 * model.calibration(shares) + 0.001 * shares, 0, 1), atol=1e-6)


@pytest.mark.skipif(not os.path.exists(TABLES), reason="needs the tables")
def test_features_do_not_depend_on_the_chunk():
    texts = [(t or "").encode() for (t,) in duckdb.sql(f"SELECT text FROM '{TABLES}/documents.parquet' ORDER BY doc_id").fetchall()]
    together = toxicity.features(texts, LEXICON)
    assert (together == np.concatenate([toxicity.features([t], LEXICON) for t in texts])).all()
    assert (toxicity.chunked_features(texts, LEXICON) == together).all()
    rows = quality.line_features(texts)[0]
    assert (rows == np.concatenate([quality.line_features([t])[0] for t in texts])).all()


@pytest.mark.skipif(not os.path.exists(LARGER), reason="needs the tables")
@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_scores_of_the_query(spark, module, label):
    """Held-out rows are ranked well, however the input is dealt; calibration is honest."""
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{LARGER}/labels.parquet")
    model = module.train(docs, labels)
    found = {(r.doc_id, r.score) for r in toxicity.score(docs, model).collect()}
    assert found == {(r.doc_id, r.score) for r in toxicity.score(docs.repartition(7, "lang", F.length("text")), model).collect()}
    known = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
    pairs = [(s, known[i]) for i, s in found if i in known and zlib.crc32(str(i).encode()) % 4 == 2]
    good, bad = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    assert good and bad
    assert np.mean([[(a > b) + 0.5 * (a == b) for b in bad] for a in good]) > 0.995
    assert np.mean([(s - y) ** 2 for s, y in pairs]) < 0.01


def test_samples_are_bounded_and_repeatable(spark):
    rows = [(i, f"text {i} " * 10) for i in range(60)] + [(7, "another text of seven"), (8, None), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1)], "doc_id long, toxic int")
    texts, y = labelled_sample(docs, labels, "toxic")
    assert len(texts) == len(y) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(60))
    assert texts == labelled_sample(docs.repartition(5), labels, "toxic")[0]
    assert len(labelled_sample(docs, labels, "toxic", rows=9)[0]) == 9
    assert 0 < sum(map(len, labelled_sample(docs, labels, "toxic", most=400)[0])) <= 400


@pytest.mark.parametrize("made", [[(1, None, None)], [(1, 7, -3)], []])
def test_labels_without_a_usable_row(spark, made):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame(made, "doc_id long, quality int, toxic int")
    for module, prior in ((toxicity, 0.0), (quality, 0.5)):
        scores = [r.score for r in toxicity.score(docs, module.train(docs, labels)).collect()]
        assert len(scores) == 2 and all(abs(s - prior) < 2e-3 for s in scores)


def test_folds_in_tasks_fit_as_here(spark):
    from sozgar.llm.learning import in_tasks

    r = random.Random(3)
    texts, y = [text_of(r, False, k % 4 == 0) for k in range(80)], np.array([float(k % 4 == 0) for k in range(80)])
    assert (ToxicityModel().fit(texts, y)(texts) == ToxicityModel().fit(texts, y, in_tasks(spark))(texts)).all()
