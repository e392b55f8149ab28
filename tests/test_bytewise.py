"""Whole texts over Arrow batches give what the built-in expressions give."""

import random

import pytest
from pyspark.sql import functions as F

from sozgar.functions import bytewise, texts, tokens, translit
from sozgar.functions.sql import register
from sozgar.plans import catalogue

EXPRESSIONS = {
    "uz_transliterate": translit.transliterate,
    "uz_latin_to_cyrillic": translit.latin_to_cyrillic,
    "uz_maybe_transliterate": translit.maybe_transliterate,
    "uz_transliterate_mixed": translit.transliterate_mixed,
    "uz_detect_script": translit.detect_script,
    "uz_tokenize": tokens.tokenize,
    "uz_word_tokens": tokens.word_tokens,
    "uz_wiki_text": tokens.wiki_text,
    "uz_sanitise": texts.sanitise,
}


def odd_texts():
    r = random.Random(5)
    yield from (None, "", "  ", "'", "ʻa'ʻ'", "ЕЕ ее е", "ngʻ tsh Sh", "ab" * 9 + "ш", "ww шww шwww", "text \x01" * 2_000, "𐐀еща 𐐀Е", "kit😀е")
    plain = "abcdeshyngotSNGTCYoʻʼ' '' .,-\n\t\x1c\x00\x0b\x85\xa0_5²абвеЕеЕшщьЬъЯюЎўҒғ«»éê"
    for alphabet in (plain, plain + "😀中ſі҃", "abе ш'ʻ", "аnЕ1 "):
        for size in (3, 20, 150):
            for _ in range(40):
                yield "".join(r.choice(alphabet) for _ in range(r.randint(0, size)))
    marks = ["{{a|{{b}}}}", "[[a|b]]", "[http://c d]", "''x''", "<ref name=n>", "</ref>", "<ref x/>", "== h ==", "HTTP:q\xa0w ", "<!-- c", "-->", "{|", "|}", "[[File:a b]]", " ш ", "中", "\n"]
    for _ in range(150):
        yield "".join(r.choice(marks) for _ in range(r.randint(1, 10)))


def test_same_as_expressions(spark):
    register(spark)
    rows = spark.createDataFrame(list(enumerate(odd_texts())), "id int, x string")
    both = rows.select("x", *(y for name, f in EXPRESSIONS.items() for y in (F.expr(f"{name}(x)").alias(name), f("x").alias(f"{name}_"))))
    assert set(EXPRESSIONS) == set(bytewise.FUNCTIONS)
    for row in both.collect():
        for name in EXPRESSIONS:
            assert row[name] == row[f"{name}_"], (name, row.x)


@pytest.mark.parametrize("outside", ["", "中"])
def test_words_that_stay(outside):
    """Only a word with few Cyrillic letters stays, whichever way the text takes."""
    t = f"kitобlar шшww 1ее {outside} aaaш е"
    x = bytewise.pa.array([t])
    assert (bytewise.Texts(x).b[0] is None) == bool(outside)
    assert bytewise.transliterate_mixed(x).to_pylist() == [f"kitобlar shshww 1ee {outside} aaaш ye"]


def test_query_takes_whole_texts_in_batches(spark, tmp_path):
    """No letter-by-letter expression runs over the documents, and each text is worked on once for all functions."""
    spark.createDataFrame([(1, "Shahar yo'l '' == h =="), (2, ""), (3, "cccш {{x}} http://a.b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.sql_functions(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "replace(" not in plan and "translate(" not in plan and "regexp" not in plan
    text = catalogue._scripts(spark, str(tmp_path))
    wanted = text.select("id", *(F.array_join(f("text"), catalogue.BAR if name == "uz_tokenize" else " ") if "toke" in name else f("text") for name, f in EXPRESSIONS.items()))
    assert {r[0]: sorted(map(str, r[1:])) for r in found.collect()} == {r[0]: sorted(map(str, r[1:])) for r in wanted.collect()}
