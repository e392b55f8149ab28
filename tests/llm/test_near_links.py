"""Near-duplicates at the similarity that the pipeline asks for."""

import corpus_pipeline
from pyspark.sql import functions as F

from sozgar.llm import neardup
from tests.llm.conftest import DOCUMENTS, words
from tests.llm.test_edges import shingles


def classes(texts: dict[int, str], link: int) -> dict[int, int]:
    """The smallest id of each document's class, by all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= link * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    return label


def shifted_texts() -> dict[int, str]:
    """Pairs of texts whose similarities run from 0.74 to 0.93 by hundredths."""
    out = {}
    for k in range(20):
        base = words(100 + k, 304).split()
        j = 0.74 + k / 100
        off = round(300 * (1 - j) / (1 + j))
        out[2 * k + 1], out[2 * k + 2] = " ".join(base), " ".join(base[off:] + words(200 + k, off).split())
    return out


def test_stage_takes_similarities_from_80_on(spark):
    texts = shifted_texts()
    wanted = {i for i, c in classes(texts, 80).items() if c == i}
    assert len(wanted) < len({i for i, c in classes(texts, 85).items() if c == i})
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], DOCUMENTS)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == wanted


def test_link_of_a_settled_member_to_a_set_far_from_the_pivot(spark, monkeypatch):
    """2 holds 1 and 3; 1, the pivot, is at 0.55 to 2 and at 0.36 to 3, which is at 0.81 to 2."""
    whole = words(300, 1004).split()
    texts = {1: " ".join(whole[:559]), 2: " ".join(whole), 3: " ".join(whole[190:])}
    monkeypatch.setattr(neardup, "bands", lambda rows: rows.select(F.lit(0).cast("long").alias("key"), "v"))
    for link in (80, 85):
        found = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), link=link).collect()
        assert {r.doc_id: r.component_id for r in found} == classes(texts, link)
