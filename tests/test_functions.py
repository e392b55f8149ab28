"""Column functions on known pairs and by properties."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sozgar.functions import forms, texts, tokens, translit
from sozgar.functions.alphabet import SUFFIXES
from sozgar.functions.batch import tenths_of
from sozgar.functions.sql import register


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"id int, x {kind}")
    return [r.y for r in rows.select("id", f("x").alias("y")).orderBy("id").collect()]


def test_transliterate(spark):
    pairs = {"салом": "salom", "САЛОМ": "SALOM", "шаҳар": "shahar", "Европа": "Yevropa", "метро": "metro", "ғалла": "gʻalla", "ўрик": "oʻrik", "қўл": "qoʻl", "2025 йил": "2025 yil", "Ўзбекистон — буюк давлат.": "Oʻzbekiston — buyuk davlat.", "ЕВРОПА": "YeVROPA", "съезд": "s'ezd", "щит": "shit", "Е-ел": "Ye-yel", "": "", "ьЬ": ""}
    assert apply(spark, translit.transliterate, pairs) == list(pairs.values())


def test_back_to_cyrillic(spark):
    pairs = {"Salom": "Салом", "kitob": "кытоб", "shahar": "щаҳар", "yoʻl": "ёʻл", "ngʻ": "нғ", "o'": "оъ"}
    assert apply(spark, translit.latin_to_cyrillic, pairs) == list(pairs.values())


def test_round_trip(spark):
    r = random.Random(1)
    values = ["".join(r.choice("abcdefghijklmnopqrstuvxyzABSTY' .,12") for _ in range(r.randint(0, 40))) for _ in range(300)]
    assert apply(spark, lambda x: translit.transliterate(translit.latin_to_cyrillic(x)), values) == values


def test_mixed_and_script(spark):
    assert apply(spark, translit.transliterate_mixed, ["Bu kitob очень яхши — maktabda o'qiladi", "kitобlar", ""]) == ["Bu kitob ochen yaxshi — maktabda o'qiladi", "kitобlar", ""]
    assert apply(spark, translit.detect_script, ["maktab", "мактаб", "2025", ""]) == ["latin", "cyrillic", "latin", "latin"]
    with pytest.raises(ValueError):
        translit.convert("x", "auto-detect")


def test_mixed_script_in_long_pieces(spark):
    r = random.Random(9)
    letters = [*"аЕеёЁШщЪьҳғЎabw09_'ʻ -.É", "\n", "҂", "҃", "𐐀", "😀"]
    values = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["Еa " * 20_000, "аб " * 20_000, "a" * 50_000]
    rows = spark.createDataFrame(list(enumerate(values)), "id int, x string")
    register(spark)
    word = translit.WORD_CHAR
    by_word = F.array_join(F.transform(F.regexp_extract_all("x", F.lit(f"[{word}]+|[^{word}]+"), 0), lambda w: F.when(translit.cyrillic_share(w) > 0.3, translit.transliterate(w)).otherwise(w)), "")
    pieces = F.regexp_extract_all("x", F.lit(translit.PIECE), 0)
    found = rows.select("id", "x", by_word.alias("a"), translit.transliterate_mixed("x").alias("b"), F.expr("uz_transliterate_mixed(x)").alias("c"), F.array_join(pieces, "").alias("all"), F.size(pieces).alias("n")).orderBy("id").collect()
    assert [(x.b, x.c, x.all) for x in found] == [(x.a, x.a, x.x) for x in found]
    assert [x.n for x in found[-3:]] == [40_000, 1, 1]  # a text without words of both kinds is converted at once


def test_sql_functions(spark):
    assert "uz_transliterate_mixed" in register(spark)
    row = spark.sql("SELECT uz_transliterate('Европа') a, uz_tokenize('kitob, daftar') b, uz_transliterate_mixed('очень kitob') c, uz_flag_reason('the') d").first()
    assert tuple(row) == ("Yevropa", ["kitob", ",", " ", "daftar"], "ochen kitob", "common English word")


def test_tokens(spark):
    assert apply(spark, tokens.tokenize, ["kitob, daftar", "2025 yil", "café"]) == [["kitob", ",", " ", "daftar"], [" ", "yil"], ["caf"]]
    assert apply(spark, tokens.word_tokens, ["Bu o'g'il juda yaxshi!", "oʻrik", "gʼoya", "kitob'", ""]) == [["Bu", "o'g'il", "juda", "yaxshi"], ["oʻrik"], ["gʼoya"], ["kitob'"], []]


def test_spans_slice_back(spark):
    r = random.Random(2)
    values = ["", "😀 Bu kitoob! 😀juda", *("".join(r.choice("ab'ʻ 1é.\n") for _ in range(n)) for n in (1, 5, 63, 64, 65, 700, 3000))]
    for text, spans in zip(values, apply(spark, tokens.word_spans, values), strict=True):
        assert [text[s.start : s.end] for s in spans] == [s.word for s in spans]
        assert [s.word for s in spans] == apply(spark, tokens.word_tokens, [text])[0]


def test_suffixes(spark):
    assert len(SUFFIXES) == len(set(SUFFIXES)) == 66
    pairs = {"kitoblarimizdan": "kitob", "maktabdagi": "maktab", "abda": "abda", "aaadan": "aaa", "yaxshii": "yaxshii", "kitobi": "kitob", "xyzdan": "xyz"}
    assert apply(spark, forms.strip_suffix, pairs) == list(pairs.values())
    assert apply(spark, forms.iterative_strip, ["kitoblaringizdagi", "kitob"]) == [["kitoblaringiz", "kitob"], []]


def python_distance(a, b, cutoff=2.0):
    marks, near = "'ʻʼ", {x + y for p in ("xh", "iy", "uo", "bp", "dt") for x, y in (p, p[::-1])}
    gap = lambda c: 0.3 if c in marks else 1.0
    row = [0.0]
    for y in b:
        row.append(row[-1] + gap(y))
    for x in a:
        now = [row[0] + gap(x)]
        for j, y in enumerate(b):
            swap = 0.0 if x == y or (x in marks and y in marks) else 0.5 if x + y in near else 1.0
            now.append(min(row[j + 1] + gap(x), now[-1] + gap(y), row[j] + swap))
        if min(now) > cutoff + 1e-9:
            return cutoff + 1
        row = now
    return row[-1]


WORDS = st.text(alphabet="abdhiotuxy'ʻk", max_size=9)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_batch_distance(a, b):
    assert abs(tenths_of([a], [b])[0] / 10 - python_distance(a, b)) < 1e-6
    assert tenths_of([a], [b], 99)[0] == tenths_of([b], [a], 99)[0]


def test_distance_forms_agree(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abdhiotuxy'ʻk") for _ in range(r.randint(0, 9)))
    pairs = [("kitoob", "kitob"), ("kitop", "kitob"), ("kordim", "ko'rdim"), ("buldim", "bo'ldim"), ("aaaaaa", "bbbbbb"), ("", ""), *((word(), word()) for _ in range(300))]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", forms.weighted_distance("a", "b").alias("d")).collect()
    assert [round(r.d, 6) for r in rows] == [round(python_distance(r.a, r.b), 6) for r in rows]
    assert tenths_of([p[0] for p in pairs], [p[1] for p in pairs]).tolist() == [round(10 * r.d) for r in rows]
    assert [r.d for r in rows[:5]] == [1.0, 0.5, 0.3, 0.8, 3.0]


def test_typos_and_flags(spark):
    assert apply(spark, forms.phonetic_typo, ["kitob", "gng", "maktab"]) == ["kytob", None, "makdab"]
    assert apply(spark, forms.double_vowel_typo, ["kitob", "ota", "grr"]) == ["kiitob", "otaa", None]
    assert apply(spark, forms.flag_reason, ["a", "xx", "va", "sal0m", "the", "it's", "brrrr", "kitob"]) == [
        "single character", "2-char word not on allowlist", None, "contains non-Uzbek-Latin characters", "common English word", "English possessive/contraction", "zero vowels (likely garbage)", None,
    ]


def test_language_gate(spark):
    values = [None, "", "short", "Bu kitob juda yaxshi va foydali", "This is the plain English of an ordinary page", "Бу китоб жуда яхши экан", "o'zbek tilidagi matn yozilgan"]
    assert apply(spark, texts.likely_uzbek, values) == [False, False, True, True, False, False, True]
    assert apply(spark, lambda x: texts.likely_uzbek(x, document=True), values) == [False, False, True, True, False, False, True]


def test_edits(spark):
    text = 'Bu <kitoob> & "juda" yaxshii.'
    error = lambda w, s: (w, text.index(w), text.index(w) + len(w), s)
    row = spark.createDataFrame([(text, [error("yaxshii", []), error("kitoob", ["kitob", "kitoblar"])])], "t string, e array<struct<word:string,start:int,end:int,suggestions:array<string>>>")
    found = row.select(texts.highlight("t", F.col("e")).alias("h"), texts.apply_all("t", F.col("e")).alias("a"), texts.autocorrect("t", F.col("e")).alias("c"), texts.replace_everywhere("t", F.col("e")).alias("r")).first()
    assert found.h == 'Bu &lt;<span class="error" data-start="4" data-end="10" data-suggestions="[&quot;kitob&quot;,&quot;kitoblar&quot;]">kitoob</span>&gt; &amp; &quot;juda&quot; <span class="error" data-start="21" data-end="28" data-suggestions="[]">yaxshii</span>.'
    assert found.a == found.r == text.replace("kitoob", "kitob") and found.c == text


def test_small_texts(spark):
    assert apply(spark, texts.sanitise, ["  a\x00b\x07cd  ", "x", "", "y" * 10_000]) == ["abcd", None, None, "y" * 9_500]
    assert apply(spark, lambda x: texts.category(x, F.lit("o'rdak")), ["ordak", "or", "o'tdak"]) == ["Apostrof belgisi", "To'liqsiz so'z", "Imlo xatosi"]
    assert apply(spark, texts.is_content, ["File Edit View Insert Format", "Bu kitob juda yaxshi ekan", "qisqa"]) == [False, True, False]
    assert apply(spark, texts.without_menus, ["File Edit\nMatn\n\n\n\nyana"]) == ["Edit\nMatn\n\nyana"]
    assert apply(spark, lambda x: texts.longest(F.split(x, ",")), ["a,bbb,ccc", ""]) == ["bbb", ""]
    assert apply(spark, tokens.wiki_text, ["'''A''' [[B|c]] {{d}} [[E]]<ref>x</ref>"]) == ["A c  E"]
    lost = "Toshkent shahri<ref>http://a.uz/b</ref>poytaxt. Matn birinchi. Ikkinchi gap<ref name=x>kitob</ref> oxiri."
    nested = "a{{b|{{c|{{d|{{e}}}}}}}}f"
    assert apply(spark, tokens.wiki_text, [lost, nested]) == ["Toshkent shahripoytaxt. Matn birinchi. Ikkinchi gap oxiri.", "af"]


def test_replies(spark):
    rows = spark.createDataFrame([(3, [("kitoob", ["kitob", "b", "c", "d"]), ("zz", [])]), (2, [])], "n int, e array<struct<word:string,suggestions:array<string>>>")
    found = rows.select(texts.reply(F.col("n"), F.col("e")).alias("a"), texts.report(F.col("n"), F.col("e")).alias("b")).collect()
    assert found[0].a == "2 ta xato topildi:\n\n  - kitoob → kitob, b, c\n  - zz → " and found[1].a == "Xatosiz! (2 ta so'z tekshirildi)"
    assert found[0].b.endswith("  • zz  →  no suggestion") and found[1].b == "All 2 words look correct."
