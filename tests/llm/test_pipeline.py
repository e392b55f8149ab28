"""Each pipeline stage on awkward rows and on none."""

from collections import Counter

import corpus_pipeline
from tests.llm.conftest import DOCUMENTS, edge_rows, words


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_return_the_columns_of_documents(spark, edge):
    rows = docs(spark, edge[0])
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, rows, edge[0]).columns == corpus_pipeline.COLUMNS, name


def test_empty(spark, edge):
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs(spark, edge[1]), edge[1]).collect() == []
    assert corpus_pipeline.run(spark, edge[1]).collect() == []


def test_near_dedup_keeps_one_of_each_class_and_null_ids(spark, edge):
    kept = Counter(r.doc_id for r in stage("near_dedup")(spark, docs(spark, edge[0]), edge[0]).collect())
    assert kept[1] == 1 and kept[2] == 0 and kept[3] == 0 and kept[7] == 1 and kept[8] == 0 and kept[None] == 2  # two different rows without an id
    assert kept[4] == kept[5] == kept[6] == 1


def test_repeats_leave_clean_rows_alone(spark, edge):
    found = {r.doc_id: r for r in stage("repeats")(spark, docs(spark, edge[0]).where("doc_id <> 2"), edge[0]).collect()}
    wanted = {r[0]: r for r in edge_rows()}
    for i in (1, 4, 5, 6, 7, 9, 14, 15):
        assert (found[i].text, found[i].n_chars) == (wanted[i][1], wanted[i][4])
    shared = edge_rows()[10][1].split("\n")[1]
    assert shared in found[10].text and shared not in found[11].text


def test_near_dedup_keeps_one_of_equal_rows(spark):
    rows = [(1, words(1, 40), "en", "a", 1)] * 3 + [(None, words(2, 40), "en", "a", 2)] * 4 + [(2, words(1, 40), "en", "b", 1), (3, "", "en", "a", 0), (3, "", "en", "b", 0), (3, None, "en", "a", 0), (4, words(4, 9), None, None, None)]
    found = Counter((r.doc_id, r.text or "") for r in stage("near_dedup")(spark, spark.createDataFrame(rows, DOCUMENTS), "").collect())
    assert found == Counter({(1, words(1, 40)): 1, (None, words(2, 40)): 1, (3, ""): 1, (4, words(4, 9)): 1})


def test_mix_takes_each_of_equal_rows_as_often_as_the_mixture_does(spark, edge):
    from sozgar.llm.mixing import measured, mix_rows

    rows = [(1, words(1, 40), "en", "a", 1)] * 10 + [(None, None, "en", "a", 2), (None, "", "en", "a", 2), (-1, "", "en", "a", 2)] + [(k, words(k, 5 + k), "en", "b" if k % 3 else None, k) for k in range(2, 40)]
    made = spark.createDataFrame(rows, DOCUMENTS)
    for df in (made, docs(spark, edge[0]).select(*corpus_pipeline.COLUMNS)):
        wanted = Counter()
        for r in mix_rows(measured(df), "doc_id", "size", "weight", "source", "text_hash").collect():
            wanted[tuple(r[c] for c in corpus_pipeline.COLUMNS)] += r.copies
        found = Counter(tuple(r) for r in stage("mix")(spark, df, "").collect())
        assert found == +wanted
    assert sum(n * len((r[1] or "").split()) for r, n in found.items())
    total = sum(len((r[1] or "").split()) for r in rows)
    taken = sum(len((r.text or "").split()) for r in stage("mix")(spark, made, "").where("doc_id = 1").collect())
    assert taken <= 5 / 8 * total + 1e-9 and taken % 40 == 0


def test_toxicity_drops_what_reaches_the_threshold(spark, edge):
    from sozgar.llm import toxicity

    rows = docs(spark, edge[0]).select(*corpus_pipeline.COLUMNS)
    scored = toxicity.score(rows, toxicity.train(rows, spark.read.parquet(f"{edge[0]}/labels.parquet"))).collect()
    wanted = Counter(tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in scored if r.score < toxicity.THRESHOLD)
    assert Counter(tuple(r) for r in stage("toxicity")(spark, rows, edge[0]).collect()) == wanted


def test_pack_places_every_piece(spark, edge):
    rows = stage("pack")(spark, docs(spark, edge[0]), edge[0]).collect()
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 4096 for v in held.values())
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r[0] for r in edge_rows())


def test_whole_run(spark, edge):
    rows = corpus_pipeline.run(spark, edge[0]).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 4096
