"""Dictionaries, checking, evaluation, service shapes, sources, sinks and streams."""

import bz2
import json
import lzma
import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from sozgar.functions import tokens
from sozgar.operators import dictionary, evaluation, service
from sozgar.operators.spelling import SpellChecker, similar, similar_by_length
from sozgar.sources import readers, writers
from sozgar.sources.readers import fetch
from sozgar.streaming.checks import check_batches, counted_words, debounced, latest, poll

ENTRIES = [("kitob", 12793), ("kitoblar", 900), ("maktab", 12000), ("yil", 483000), ("bilan", 90000), ("bu", 80000), ("juda", 70000), ("yaxshi", 60000), ("xona", 5000), ("yiil", 3), ("hato", 2), ("xato", 700), ("oʻrdak", 60), ("o'rdak", 50), ("ish", 400), ("ishchi", 300)]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, "word string, freq long").coalesce(1).persist()


@pytest.fixture(scope="module", params=["deletions", "lengths"])
def checker(request, entries):
    return SpellChecker(entries, join=request.param, persist=True)


def kinds(spark, checker, words):
    rows = checker.is_correct(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    return {r.word: r.match_kind for r in rows}


def test_match_kinds(spark, checker):
    assert kinds(spark, checker, ["kitob", "Kitob", "kitoblarimizdan", "maktabdagi", "kitoob", "yiilda", "yiil", "ishchi", "o'rdak", "oʻrdak", "ordak", "yaxshii"]) == {
        "kitob": "DIRECT", "Kitob": "DIRECT", "kitoblarimizdan": "STEM", "maktabdagi": "STEM", "kitoob": "", "yiilda": "", "yiil": "", "ishchi": "DIRECT", "o'rdak": "DIRECT", "oʻrdak": "DIRECT", "ordak": "", "yaxshii": "",
    }


def test_suggestions(spark, checker):
    words = ["kitoob", "kitop", "bilan", "billan", "ordak", "xonaalar", "hato", "Kitob", "zzzzzzz", ""]
    rows = {r.word: r.suggestions for r in checker.suggest(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert rows["kitoob"][0] == rows["kitop"][0] == "kitob" and rows["bilan"] == ["bilan"] and rows["Kitob"] == ["kitob"]
    assert "bilan" in rows["billan"] and rows["ordak"][0] == "o'rdak" and "xonalar" in rows["xonaalar"]
    assert rows["hato"][0] == "hato" and rows["hato"][1] == "xato" and rows["zzzzzzz"] == [] and rows[""] == []
    with pytest.raises(ValueError):
        checker.suggest(spark.createDataFrame([("a",)], "word string"), top_n=11)


def test_check_text(checker):
    found = checker.check_text("Bu kitoob juda yaxshii")
    assert (found["total_words"], found["errors_found"]) == (4, 2) and [e["word"] for e in found["errors"]] == ["kitoob", "yaxshii"]
    assert checker.check_text("Bu kitob juda yaxshi") == {"total_words": 4, "errors_found": 0, "errors": []}
    assert checker.check_text("")["total_words"] == 0
    assert checker.correct_word("kitoob") == "kitob" and checker.correct_word("zzzzzzz") == "zzzzzzz" and checker.suggest_word("kitop")[0] == "kitob"


def test_awkward_texts(spark, checker):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "kitoob"), (3, "kitob"), (4, "kitob " * 5000 + "kitoob")], "id int, text string")
    found = {(r.id, r.total_words, r.errors_found) for r in checker.check(rows.where("id <> 3"), ["id"]).collect()}
    assert found == {(1, 0, 0), (2, 0, 0), (4, 5001, 1)}
    assert checker.check(rows.limit(0), ["id"]).collect() == [] and checker.suggest(rows.limit(0), "text").collect() == []
    assert checker.suggest(spark.createDataFrame([(None,)], "word string")).collect() == []


def test_summary_counts_without_suggestions(spark, tmp_path):
    from sozgar.plans import catalogue

    spark.createDataFrame([(1, "kitob " * 200 + "maktab " * 6)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, 0, "Bu kitoob, kitoob!"), (1, 1, "Kitoblarimizdan maktab"), (1, 2, ""), (2, 0, None), (None, 0, "kitoob kitob"), (3, 0, "kitoob"), (3, 0, "kitob")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = catalogue.QUERIES["check_text_summary"](spark, str(tmp_path))
    expected = {(1, 0, 3, 3), (1, 1, 2, 0), (1, 2, 0, 0), (2, 0, 0, 0), (None, 0, 2, 1), (3, 0, 2, 1)}  # by the SQL: a key of null, or borne twice, is one group
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan and "tenths" not in plan and plan.count("Join") <= 5


def test_pipeline_and_service(spark, checker):
    rows = spark.createDataFrame([(1, "Бу китооб жуда яхши")], "id int, text string")
    found = checker.pipeline(rows, ["id"], script="cyrillic").first()
    assert found.converted == "Bu kitoob juda yaxshi" and found.original.startswith("Бу") and found.spell_check.errors_found == 1
    flat = service.check_and_transliterate(checker, rows, ["id"], script="cyrillic").first()
    error = flat.errors[0]
    assert (error.word, error.start, error.end) == ("kitoob", 3, 9) and flat.converted[3:9] == "kitoob"
    assert service.transliterated(rows, ["id"], mode=" Cyrillic-To-Latin ").first().mode == "cyrillic-to-latin"
    with pytest.raises(ValueError):
        service.check_and_transliterate(checker, rows, ["id"], script="arabic")
    with pytest.raises(Exception, match="10000"):
        service.check(checker, spark.createDataFrame([(1, "")], "id int, text string"), ["id"]).collect()
    errors = checker.errors(spark.createDataFrame([(1, "kitoob kitoob")], "id int, text string"), ["id"])
    left = service.without_ignored(errors, spark.createDataFrame([(1, "kitoob", 0)], "id int, word string, start int"), ["id"]).collect()
    assert [r.start for r in left] == [7]


def test_joins_agree(spark):
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abxhiyk'") for _ in range(r.randint(1, 7)))
    a = spark.createDataFrame(sorted({(word(),) for _ in range(150)}), "w string")
    b = spark.createDataFrame(sorted({(word(),) for _ in range(300)}), "word string")
    for most in (1, 2):
        assert set(similar(a, b, "w", "word", most).collect()) == set(similar_by_length(a, b, "w", "word", most).collect())


def test_dictionary_jobs(spark, entries):
    found = {r.word: r.freq for r in dictionary.normalised(entries).collect()}
    assert found["o'rdak"] == 110 and "oʻrdak" not in found
    folded = {r.word: r.freq for r in dictionary.roots(entries).collect()}
    assert folded["kitob"] == 12793 + 900 and "kitoblar" not in folded and folded["ishchi"] == 300
    stems = dictionary.iterated_stems(spark.createDataFrame([("kitoblardan",), ("kitob",)], "word string"), entries)
    assert {r.word: r.stems for r in stems.collect()} == {"kitoblardan": ["kitob"], "kitob": []}
    more = spark.createDataFrame([("kitob", 5), ("yangi", 3), ("kam", 2)], "word string, freq long")
    assert {r.word: r.freq for r in dictionary.extended(entries, more).collect()}.items() >= {"kitob": 12798, "yangi": 3}.items()
    assert [r.word for r in dictionary.top(entries, 2).collect()] == ["yil", "bilan"] and dictionary.bottom(entries, 1).first().word == "hato"
    assert dictionary.corpus_statistics(entries, dictionary.roots(entries)).first().words == len(ENTRIES)


def test_evaluation(spark, entries):
    checker = SpellChecker(entries)
    cases = evaluation.benchmark(entries, spark.createDataFrame([("kitobb", "kitob"), ("kitob", "kitob"), ("bu", "kitob"), ("zz", "yoq")], "input string, expected string"))
    rows = cases.collect()
    assert {r.type for r in rows} == {"phonetic", "double_char", "real"} and [r.input for r in rows if r.type == "real"] == ["kitobb"]
    judged = evaluation.judged(cases, checker, normalise=True)
    report = {r.type: r for r in evaluation.accuracy(judged).collect()}
    assert report[None].cases == len(rows) and 0 < report[None].top1 <= report[None].top3 <= 1
    assert evaluation.failures(judged).where("n > 3").count() == 0


def test_readers(spark, tmp_path):
    at = lambda name, data: (tmp_path / name).write_bytes(data) and str(tmp_path / name)
    path = at("d.json", json.dumps({"kitob": 5, "oʻrik": 2}, ensure_ascii=False).encode())
    assert {tuple(r) for r in readers.load_dictionary(spark, str(tmp_path / "none.json"), path).collect()} == {("kitob", 5), ("oʻrik", 2)}
    assert readers.read_dictionary(spark, str(tmp_path / "none.json")).collect() == []
    with pytest.raises(FileNotFoundError):
        readers.load_dictionary(spark, str(tmp_path / "none.json"))
    assert {r.word for r in readers.read_word_list(spark, at("w.txt", b"# all\nSalom # hi\n\nsalom\nx1\nrahmat\n")).collect()} == {"salom", "rahmat"}
    cases = at("c.json", json.dumps([{"input": "a", "expected": "b", "type": "real"}, {"input": "c", "expected": "d", "type": "x"}], indent=1).encode())
    assert readers.read_cases(spark, cases, "real").count() == 1 and readers.read_cases(spark, cases).count() == 2
    assert [tuple(r) for r in readers.read_typos(spark, at("t.csv", b"typo,correct,category\n kitoob , kitob,real\na,b,\n")).collect()] == [("kitoob", "kitob", "real"), ("a", "b", "?")]
    assert readers.read_messages(spark, at("m.txt", b"# c\n\nsalom\n")).count() == 1
    xml = b"<mediawiki><page><title>A</title><ns>0</ns><revision><text>bir</text></revision></page><page><title>B</title><ns>1</ns><revision><text>x</text></revision></page><page><title>C</title><revision><text>uch</text></revision></page><page><title>D</title><ns>0</ns><revision><text></text></revision></page></mediawiki>"
    assert sorted(r.title for r in readers.read_articles(spark, at("w.xml.bz2", bz2.compress(xml))).collect()) == ["A", "C"]
    lines = at("l.xz", lzma.compress("bir\n\n  ikki \nuch\n".encode()))
    assert [r.value for r in readers.read_xz_lines(spark, lines).collect()] == ["bir", "ikki", "uch"] and readers.read_xz_lines(spark, lines, most=2).count() == 2
    (tmp_path / "deep/er").mkdir(parents=True)
    at("deep/a.txt", b"x\ny")
    at("deep/er/b.txt", b"z")
    assert sorted(r.text for r in readers.read_folder(spark, str(tmp_path / "deep")).collect()) == ["x\ny", "z"]
    pages = spark.createDataFrame([(2, "<a href='/news/2024/b'>"), (1, "<a href='/news/2024/a'><a href='/news/2024/b'><a href='/x'>")], "id int, html string").withColumn("l", tokens.news_links("html", "https://e.org"))
    assert [r.url for r in readers.listing(pages, "l", "id", 5).collect()] == ["https://e.org/news/2024/a", "https://e.org/news/2024/b"]


def test_writers(spark, entries, tmp_path):
    path = str(tmp_path / "out.json")
    writers.export_dictionary(entries, path)
    written = json.loads(open(path, encoding="utf-8").read())
    assert written == dict(ENTRIES) and list(written)[:2] == ["yil", "bilan"] and "ʻ" in open(path, encoding="utf-8").read()
    table = str(tmp_path / "t.parquet")
    writers.write_dictionary(entries, table)
    writers.overwrite(dictionary.cleaned(spark.read.parquet(table)).where("freq >= 5"), table)
    assert spark.read.parquet(table).where("freq < 5").count() == 0 and sorted(os.listdir(tmp_path)) == [".out.json.crc", "out.json", "t.parquet"]
    writers.write_batches(spark.range(5).select(F.col("id").cast("string").alias("text")).coalesce(1), str(tmp_path / "b"), size=2)
    parts = [f for f in os.listdir(tmp_path / "b") if f.startswith("part")]
    assert len(parts) == 3 and "0\n\n1\n\n" in {open(tmp_path / "b" / p).read() for p in parts}
    writers.write_cases(spark.createDataFrame([("a", "b", "real")], "input string, expected string, type string"), str(tmp_path / "cases"))
    assert spark.read.json(str(tmp_path / "cases")).count() == 1


EDITS = "field string, ts timestamp, text string"


def edits(spark):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    steps = [("a", 0, "k"), ("a", 0.3, "ki"), ("a", 0.5, "kit"), ("a", 5, "kitob"), ("b", 1, "x"), ("a", 30, "end"), ("b", 30, "end")]
    return spark.createDataFrame([(f, t + timedelta(seconds=s), x) for f, s, x in steps], EDITS)


def test_debounce(spark, tmp_path):
    rows = sorted((r.field, r.text) for r in debounced(edits(spark)).collect())
    assert rows == [("a", "end"), ("a", "kit"), ("a", "kitob"), ("b", "end"), ("b", "x")]
    assert {r.field: r.text for r in latest(edits(spark)).collect()} == {"a": "end", "b": "end"}
    edits(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(edits(spark).schema).parquet(str(tmp_path / "in"))
    q = debounced(stream, late="1 second").writeStream.format("memory").queryName("quiet").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert {(r.field, r.text) for r in spark.table("quiet").collect()} >= {("a", "kit"), ("a", "kitob"), ("b", "x")}
    finally:
        q.stop()


def test_streams(spark, entries, tmp_path):
    spark.createDataFrame([(1, "Bu kitoob"), (2, "juda yaxshi")], "id int, text string").write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "m"))
    got = []
    q = check_batches(stream, SpellChecker(entries), lambda df, n: got.extend(df.collect()), ["id"]).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {r.id: r.errors_found for r in got} == {1: 1, 2: 0}
    q = counted_words(stream, tokens.corpus_words(F.lower("text"))).writeStream.format("memory").queryName("counted").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert {r.word for r in spark.table("counted").collect()} == {"bu", "kitoob", "juda", "yaxshi"}
    finally:
        q.stop()


def test_poll(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    lines = spark.readStream.text(str(folder))
    seen = []
    keep = lambda batch, number: seen.extend(r.value for r in batch.collect())
    assert not poll(lines, keep, "100 milliseconds", 1.0)
    assert seen == []
    (folder / "a.txt").write_text("salom\ndunyo\n")
    assert poll(lines, keep, "100 milliseconds", 60.0)
    assert sorted(seen) == ["dunyo", "salom"]

    def broken(batch, number):
        raise ValueError("sink broke")

    with pytest.raises(Exception, match="sink broke"):
        poll(lines, broken, "100 milliseconds", 60.0)


def test_fetch(spark):
    class Page(BaseHTTPRequestHandler):
        def do_GET(self):
            found = self.path == "/a"
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write("<p>oʻrik</p>".encode() if found else b"")

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        host = f"http://127.0.0.1:{server.server_port}"
        got = {r.url: r.html for r in fetch(spark, [f"{host}/a", f"{host}/b"]).collect()}
    finally:
        server.shutdown()
    assert got == {f"{host}/a": "<p>oʻrik</p>", f"{host}/b": None}
