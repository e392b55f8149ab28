"""Registered queries of the text engine and their DuckDB counterparts.

Queries read their tables whole, some together with inline rows. Arrays are flattened in results, so both engines compare scalars.
The dictionary of the checking queries is counted from ``documents`` (words seen three times or more).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sozgar.functions import batch, forms, texts, tokens, translit
from sozgar.functions.alphabet import ENGLISH_STOP, FUNCTION_WORDS, INTERFACE_WORDS, TELLING_SUFFIXES
from sozgar.functions.sql import register
from sozgar.operators import dictionary, evaluation, service
from sozgar.operators.spelling import SpellChecker, similar, similar_by_length
from sozgar.plans import fixtures, oracle
from sozgar.plans.oracle import DICT, TOKENS, counted, flag, maybe, mixed, spans, stems, stripped, suggested, tenths, transliterated
from sozgar.sources import readers, writers
from sozgar.streaming.checks import debounced, latest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BAR = " | "


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_counted(spark: SparkSession, sf_dir: str, name: str = "documents", least: int = 1) -> DataFrame:
    return dictionary.word_count(read(spark, sf_dir, name), tokens.corpus_words(F.lower("text")), least)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_counted(spark, sf_dir, least=3)


def checker(spark: SparkSession, sf_dir: str) -> SpellChecker:
    return SpellChecker(entries(spark, sf_dir), join="auto", persist=True)


def token_rows(df: DataFrame) -> DataFrame:
    return df.select(F.explode(tokens.word_tokens("text")).alias("word"))


def joined(c: Column | str) -> Column:
    return F.array_join(c, BAR)


# --- dictionaries --------------------------------------------------------------------------------


@query(counted("documents"))
def word_count(spark, sf_dir):
    return documents_counted(spark, sf_dir)


@query(counted("documents", 3))
def dict_build(spark, sf_dir):
    return entries(spark, sf_dir)


@query(f"SELECT * FROM ({counted('documents', 3)}) ORDER BY freq DESC, word LIMIT 50")
def dict_top50(spark, sf_dir):
    return dictionary.top(entries(spark, sf_dir), 50)


@query(f"SELECT * FROM ({counted('documents', 3)}) ORDER BY freq, word LIMIT 50")
def dict_bottom50(spark, sf_dir):
    return dictionary.bottom(entries(spark, sf_dir), 50)


@query(f"SELECT translate(word, 'ʻʼ', '''''') AS word, sum(freq)::BIGINT AS freq FROM (SELECT word, freq FROM {fixtures.values(fixtures.APOSTROPHE_WORDS, 'word, freq')} UNION ALL {counted('documents', 3)}) GROUP BY 1")
def dict_normalise(spark, sf_dir):
    inline = fixtures.table(spark, fixtures.APOSTROPHE_WORDS, "word string, freq long")
    return dictionary.normalised(inline.unionByName(entries(spark, sf_dir)))


@query(f"SELECT word, sum(freq)::BIGINT AS freq FROM ({counted('documents')} UNION ALL {counted('conversations')} UNION ALL {counted('benchmark')}) GROUP BY word")
def dict_merge(spark, sf_dir):
    return dictionary.merged(*(documents_counted(spark, sf_dir, t) for t in ("documents", "conversations", "benchmark")))


@query(f"SELECT word, sum(freq)::BIGINT AS freq FROM ({counted('documents', 3)} UNION ALL {counted('conversations', 3)}) GROUP BY word")
def dict_extend(spark, sf_dir):
    return dictionary.extended(entries(spark, sf_dir), documents_counted(spark, sf_dir, "conversations"))


@query(f"WITH {DICT} SELECT word, freq FROM ({counted('conversations')}) WHERE word NOT IN (SELECT word FROM dict)")
def dict_new_words(spark, sf_dir):
    return dictionary.new_words(documents_counted(spark, sf_dir, "conversations"), entries(spark, sf_dir))


@query(f"SELECT * FROM (SELECT word, freq, {flag('word')} AS reason FROM ({counted('documents')})) WHERE reason IS NOT NULL")
def dict_garbage_flags(spark, sf_dir):
    return dictionary.flagged(documents_counted(spark, sf_dir))


@query(f"SELECT reason, count(*)::BIGINT AS words, sum(freq)::BIGINT AS freq FROM (SELECT word, freq, {flag('word')} AS reason FROM ({counted('documents')})) WHERE reason IS NOT NULL GROUP BY reason")
def dict_garbage_summary(spark, sf_dir):
    return dictionary.flag_summary(documents_counted(spark, sf_dir))


@query(f"SELECT word, freq FROM ({counted('documents')}) WHERE {flag('word')} IS NULL")
def dict_clean(spark, sf_dir):
    return dictionary.cleaned(documents_counted(spark, sf_dir))


_ROOTS = f"""WITH {DICT.replace("translate(word, 'ʻʼ', '''''') AS word, sum(freq)::BIGINT", "word, sum(freq)::BIGINT")},
common AS (SELECT * FROM dict WHERE freq >= 100),
s1 AS ({stems("(SELECT word FROM dict WHERE freq < 1000)", "word", "common")}),
s2 AS ({stems("(SELECT DISTINCT stem AS word FROM s1)", "word", "common")}),
s3 AS ({stems("(SELECT DISTINCT stem AS word FROM s2)", "word", "common")}),
deep AS (SELECT s1.word, coalesce(s3.stem, s2.stem, s1.stem) AS root FROM s1 LEFT JOIN s2 ON s2.word = s1.stem LEFT JOIN s3 ON s3.word = s2.stem),
folded AS (SELECT coalesce(root, word) AS word, sum(freq)::BIGINT AS freq FROM dict LEFT JOIN deep USING (word) GROUP BY 1)
"""


@query(_ROOTS + "SELECT word, freq FROM folded")
def dict_roots_fold(spark, sf_dir):
    return dictionary.roots(entries(spark, sf_dir))


@query(_ROOTS + "SELECT w.words, w.tokens, r.roots, round(100.0 * (1 - r.roots / w.words::DOUBLE), 1)::DOUBLE AS reduction FROM (SELECT count(*)::BIGINT AS words, sum(freq)::BIGINT AS tokens FROM dict) w, (SELECT count(*)::BIGINT AS roots FROM folded) r")
def corpus_statistics(spark, sf_dir):
    words = entries(spark, sf_dir)
    return dictionary.corpus_statistics(words, dictionary.roots(words))


@query(f"SELECT word, freq FROM ({counted('documents', 3)}) ORDER BY md5('42 ' || word), word LIMIT 25")
def dict_review_sample(spark, sf_dir):
    return dictionary.review_sample(entries(spark, sf_dir), 25)


# --- script --------------------------------------------------------------------------------------

_SENTENCES = fixtures.values(list(enumerate(fixtures.SENTENCES)), "id, text")
_SCRIPTS = f"(SELECT id::BIGINT AS id, text FROM {_SENTENCES} UNION ALL SELECT 1000 + 3 * doc_id + k AS id, CASE k WHEN 0 THEN text WHEN 1 THEN {oracle.cyrillic('text')} ELSE text || ' ' || {oracle.cyrillic('text')} END AS text FROM documents, range(0, 3) AS _k(k))"


def _scripts(spark, sf_dir, back: Column | None = None) -> DataFrame:
    """The inline sentences, and every document as it is, in Cyrillic letters (``back``) and both one after the other."""
    back = translit.latin_to_cyrillic("text") if back is None else back
    forms_of = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array("text", back, F.concat("text", F.lit(" "), back))).alias("k", "text"))
    return fixtures.sentences(spark).unionByName(forms_of.select((1000 + 3 * F.col("doc_id") + F.col("k")).alias("id"), "text"))


@query(f"SELECT id, {transliterated('text')} AS latin FROM {_SCRIPTS}")
def translit_sentences(spark, sf_dir):
    return _scripts(spark, sf_dir).select("id", translit.transliterate("text").alias("latin"))


@query(f"SELECT doc_id, {oracle.cyrillic('text')} AS cyrillic FROM documents")
def latin_to_cyrillic(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", translit.latin_to_cyrillic("text").alias("cyrillic"))


@query(f"SELECT item_id, {transliterated(oracle.cyrillic('text'))} AS latin FROM benchmark")
def cyrillic_round_trip(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", translit.transliterate(translit.latin_to_cyrillic("text")).alias("latin"))


@query(f"SELECT id, CASE WHEN {oracle.cyrillic_share('text')} > 0.3 THEN 'cyrillic' ELSE 'latin' END AS script FROM {_SCRIPTS}")
def detect_script(spark, sf_dir):
    return _scripts(spark, sf_dir).select("id", translit.detect_script("text").alias("script"))


@query(f"SELECT id, {mixed('text')} AS latin FROM {_SCRIPTS}")
def translit_mixed(spark, sf_dir):
    return _scripts(spark, sf_dir).select("id", translit.transliterate_mixed("text").alias("latin"))


@query(f"SELECT id, {maybe('text')} AS latin FROM {_SCRIPTS}")
def translit_maybe(spark, sf_dir):
    return _scripts(spark, sf_dir).select("id", translit.maybe_transliterate("text").alias("latin"))


@query(f"SELECT id, {transliterated('text')} AS a, {oracle.cyrillic('text')} AS b, {mixed('text')} AS c FROM {_SCRIPTS}")
def translit_modes(spark, sf_dir):
    return _scripts(spark, sf_dir).select("id", *(translit.convert("text", m).alias(n) for m, n in zip(translit.MODES, "abc", strict=True)))


# --- tokens --------------------------------------------------------------------------------------


@query(f"SELECT item_id, array_to_string(regexp_extract_all(text, '{oracle.WORD}|[^{oracle.W}{oracle.SPACE}]|[{oracle.SPACE}]+'), '{BAR}') AS tokens FROM benchmark")
def tokenize_all(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", joined(tokens.tokenize("text")).alias("tokens"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{oracle.WORD}'))::INTEGER AS n, array_to_string(regexp_extract_all(text, '{oracle.WORD}'), ' ') AS words FROM documents")
def word_tokens(spark, sf_dir):
    found = tokens.word_tokens("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n"), F.array_join(found, " ").alias("words"))


@query(spans("conversations", "conv_id, turn"))
def word_spans(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(tokens.word_spans("text")).alias("s"))
    return rows.select("conv_id", "turn", "s.word", "s.start", "s.end")


@query(f"SELECT word, count(*)::BIGINT AS freq FROM (SELECT unnest(regexp_extract_all(lower({maybe('text')}), '{oracle.CORPUS}{{2,}}')) AS word FROM conversations) WHERE word NOT IN {oracle.words(tokens.BLOCKED_WEB)} GROUP BY word HAVING count(*) >= 3")
def web_words(spark, sf_dir):
    return dictionary.word_count(read(spark, sf_dir, "conversations"), tokens.web_words("text"), 3)


@query(f"SELECT word, count(*)::BIGINT AS freq FROM (SELECT lower(unnest(regexp_extract_all({maybe('text')}, '{oracle.CORPUS}{{2,}}'))) AS word FROM documents) GROUP BY word HAVING count(*) >= 3")
def encyclopedia_words(spark, sf_dir):
    return dictionary.word_count(read(spark, sf_dir, "documents"), tokens.encyclopedia_words("text"), 3)


@query(f"SELECT conv_id, turn, CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(t, '[{oracle.SPACE}]+')) END::INTEGER AS n FROM (SELECT conv_id, turn, regexp_replace(text, '^[{oracle.SPACE}]+|[{oracle.SPACE}]+$', '', 'g') AS t FROM conversations)")
def blank_words(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(tokens.blank_words("text")).alias("n"))


_HTML = "regexp_replace({}, '(?s)<!--.*?-->', ' ', 'g')"


_NEWS_DROPS = ("script", "style", "nav", "header", "footer", "aside")


def _html_text_sql(dropped: tuple[str, ...]) -> str:
    t = _HTML.format("html")
    for tag in dropped:
        t = f"regexp_replace({t}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    for a, b in tokens.ENTITIES:
        t = f"replace({t}, {oracle.text(a)}, {oracle.text(b)})"
    return t


def _html_sql(dropped: tuple[str, ...], blocked: list[str], least: int) -> str:
    t = _html_text_sql(dropped)
    return f"SELECT word, count(*)::BIGINT AS freq FROM (SELECT lower(unnest(regexp_extract_all({t}, '{oracle.CORPUS}{{3,}}'))) AS word FROM pages) WHERE word NOT IN {oracle.words(blocked)} GROUP BY word HAVING count(*) >= {least}"


@query(_html_sql(_NEWS_DROPS, tokens.BLOCKED_NEWS, 2))
def html_news_words(spark, sf_dir):
    return dictionary.word_count(read(spark, sf_dir, "pages"), tokens.news_words("html"), 2)


@query(_html_sql(("script", "style", "nav", "header", "footer"), tokens.BLOCKED_LAW, 2))
def html_law_words(spark, sf_dir):
    return dictionary.word_count(read(spark, sf_dir, "pages"), tokens.law_words("html"), 2)


_HOST = "https://example.org"
_RULED = """ || '<a href="/news/2024/' || page_id || '">a</a><a href="/news/2024/category/x">b</a><a href="/uz/docs/-' || page_id || '">c</a><a href="/uz/docs/x">d</a><a href="https://b.uz/uz/docs/7">e</a><a href="/news/2024/' || page_id || '">f</a>'"""


def _links_sql(kept: str = "true", html: str = "html") -> str:
    """(page_id, l): the distinct links of each page, in order."""
    found = f"""regexp_extract_all({html}, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)"""
    return f"SELECT page_id, list_filter(r, lambda x, i: list_position(r, x) = i) AS l FROM (SELECT page_id, list_transform(list_filter({found}, lambda x: {kept}), lambda x: CASE WHEN x LIKE 'http%' THEN x ELSE '{_HOST}' || x END) AS r FROM pages)"


def _with_ruled(spark, sf_dir) -> DataFrame:
    """Every page with links added that the rules for news and laws keep or leave."""
    ruled = F.expr("html" + _RULED)
    return read(spark, sf_dir, "pages").select("page_id", ruled.alias("html"))


@query(f"SELECT page_id, array_to_string(l, ' ') AS links FROM ({_links_sql()})")
def html_links(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(tokens.links("html", "", _HOST), " ").alias("links"))


@query(f"SELECT page_id, array_to_string(l, ' ') AS links FROM ({_links_sql("regexp_matches(x, '/news/[0-9]{4}/') AND NOT contains(x, '/category/')", 'html' + _RULED)})")
def news_links(spark, sf_dir):
    return _with_ruled(spark, sf_dir).select("page_id", F.array_join(tokens.news_links("html", _HOST), " ").alias("links"))


@query(f"SELECT page_id, array_to_string(l, ' ') AS links FROM ({_links_sql("regexp_matches(x, '/uz/docs/-?[0-9]+')", 'html' + _RULED)})")
def law_links(spark, sf_dir):
    return _with_ruled(spark, sf_dir).select("page_id", F.array_join(tokens.law_links("html", _HOST), " ").alias("links"))


@query(f"SELECT url FROM (SELECT page_id, unnest(l) AS url, generate_subscripts(l, 1) AS at_ FROM ({_links_sql()})) GROUP BY url ORDER BY min((page_id, at_)) LIMIT 50")
def html_listing(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", tokens.links("html", "", _HOST).alias("links"))
    return readers.listing(pages, "links", "page_id", 50)


_MARKED = "'{{x|{{y|{{z}}}}}} ' || coalesce(text, '') || '<ref name=n>http://a.uz/b</ref> [[a|b]] [http://c.uz d] [[File:f.png|thumb|e]] http://e.uz/f' || chr(10) || '== g ==' || chr(10)"


def _wiki_text_sql() -> str:
    out = "text"
    for pattern, by in tokens.WIKI_STEPS:
        out = f"regexp_replace({out}, {oracle.text(pattern)}, {oracle.text(by.replace('$1', chr(92) + '1'))}, 'g')"
    return out


def _wiki_sql(source: str) -> str:
    return f"SELECT id, {_wiki_text_sql()} AS text FROM ({source})"


@query(_wiki_sql(f"SELECT id, text FROM {fixtures.values(fixtures.WIKI, 'id, text')} UNION ALL SELECT doc_id + 1000 AS id, {_MARKED} AS text FROM documents"))
def wiki_strip(spark, sf_dir):
    """Inline markup, and every document inside markup."""
    marked = F.concat(F.lit("{{x|{{y|{{z}}}}}} '''"), F.coalesce("text", F.lit("")), F.lit("'''<ref name=n>http://a.uz/b</ref> [[a|b]] [http://c.uz d] [[File:f.png|thumb|e]] http://e.uz/f\n== g ==\n"))
    rows = read(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), marked.alias("text"))
    return fixtures.table(spark, fixtures.WIKI, "id long, text string").unionByName(rows).select("id", tokens.wiki_text("text").alias("text"))


_EDGES = f"'^[{oracle.SPACE}]+|[{oracle.SPACE}]+$', '', 'g'"
_SANITISED = f"CASE WHEN length(regexp_replace(text, {_EDGES})) >= 3 THEN substr(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), {_EDGES}), 1, 9500) END"


@query(f"SELECT id, {transliterated('text')} AS latin, {oracle.cyrillic('text')} AS cyrillic, {maybe('text')} AS maybe, {mixed('text')} AS mixed, CASE WHEN {oracle.cyrillic_share('text')} > 0.3 THEN 'cyrillic' ELSE 'latin' END AS script, array_to_string(regexp_extract_all(text, '{oracle.WORD}|[^{oracle.W}{oracle.SPACE}]|[{oracle.SPACE}]+'), '{BAR}') AS tokens, array_to_string(regexp_extract_all(text, '{oracle.WORD}'), ' ') AS words, {_wiki_text_sql()} AS plain, {_SANITISED} AS clean FROM {_SCRIPTS}")
def sql_functions(spark, sf_dir):
    """The SQL functions of texts."""
    register(spark)
    return _scripts(spark, sf_dir, F.expr("uz_latin_to_cyrillic(text)")).selectExpr(
        "id", "uz_transliterate(text) AS latin", "uz_latin_to_cyrillic(text) AS cyrillic", "uz_maybe_transliterate(text) AS maybe", "uz_transliterate_mixed(text) AS mixed", "uz_detect_script(text) AS script",
        f"array_join(uz_tokenize(text), '{BAR}') AS tokens", "array_join(uz_word_tokens(text), ' ') AS words", "uz_wiki_text(text) AS plain", "uz_sanitise(text) AS clean",
    )


@query(f"SELECT page_id, {_html_text_sql(_NEWS_DROPS)} AS text FROM pages")
def sql_html_text(spark, sf_dir):
    register(spark)
    return read(spark, sf_dir, "pages").selectExpr("page_id", "uz_html_text(html) AS text")


# --- word forms ----------------------------------------------------------------------------------

_SUFFIXED = f"(SELECT DISTINCT word || s AS word FROM ({counted('documents', 3)}), (SELECT unnest([{', '.join(map(oracle.text, ['', *oracle.SUFFIXES]))}]) AS s))"


def _suffixed(spark, sf_dir) -> DataFrame:
    """Every dictionary word, as it is and with every suffix put on, once each."""
    words = entries(spark, sf_dir).select("word")
    return words.select(F.explode(F.array(*map(F.lit, ["", *forms.SUFFIXES]))).alias("s"), "word").select(F.concat("word", "s").alias("word")).distinct()


@query(f"SELECT word, {stripped('word')} AS stem FROM {_SUFFIXED}")
def strip_suffix_free(spark, sf_dir):
    return _suffixed(spark, sf_dir).select("word", forms.strip_suffix("word").alias("stem"))


@query(f"WITH {DICT} {stems(_SUFFIXED, 'word')}")
def strip_suffix_vocabulary(spark, sf_dir):
    return dictionary.stems(_suffixed(spark, sf_dir), dictionary.normalised(entries(spark, sf_dir)))


_S1, _S2 = stripped("word"), stripped("s1")


@query(f"SELECT word, array_to_string(list_filter([CASE WHEN s1 <> word THEN s1 END, CASE WHEN s2 <> s1 THEN s2 END, CASE WHEN s3 <> s2 THEN s3 END], lambda x: x IS NOT NULL), '{BAR}') AS stems FROM (SELECT *, {stripped('s2')} AS s3 FROM (SELECT *, {_S2} AS s2 FROM (SELECT word, {_S1} AS s1 FROM {_SUFFIXED})))")
def iterative_strip(spark, sf_dir):
    return _suffixed(spark, sf_dir).select("word", joined(forms.iterative_strip("word")).alias("stems"))


_TYPED = f"(SELECT word, regexp_replace(word, '^(.[^aeiou]*)([aeiou])', '\\1\\2\\2') AS doubled, CASE WHEN regexp_matches(word, '[xhiyuobpdt]') THEN regexp_extract(word, '^([^xhiyuobpdt]*)', 1) || translate(substr(word, length(regexp_extract(word, '^([^xhiyuobpdt]*)', 1)) + 1, 1), 'xhiyuobpdt', 'hxyioupbtd') || substr(word, length(regexp_extract(word, '^([^xhiyuobpdt]*)', 1)) + 2) END AS swapped FROM ({counted('documents', 3)}))"


@query(f"SELECT word, swapped AS phonetic, CASE WHEN doubled <> word THEN doubled END AS double_char FROM {_TYPED}")
def typos(spark, sf_dir):
    return entries(spark, sf_dir).select("word", forms.phonetic_typo("word").alias("phonetic"), forms.double_vowel_typo("word").alias("double_char"))


@query(f"SELECT word, translate(lower(word), 'ʻʼ', '''''') AS normal, {flag('word')} AS reason, swapped AS phonetic, CASE WHEN doubled <> word THEN doubled END AS double_char FROM {_TYPED}")
def sql_word_functions(spark, sf_dir):
    """The SQL functions of words."""
    register(spark)
    return entries(spark, sf_dir).selectExpr("word", "uz_normalise(word) AS normal", "uz_flag_reason(word) AS reason", "uz_phonetic_typo(word) AS phonetic", "uz_double_vowel_typo(word) AS double_char")


@query(f"WITH pairs AS (SELECT a, b FROM {fixtures.values(fixtures.DISTANCES, 'a, b')} UNION ALL SELECT word, doubled FROM {_TYPED} UNION ALL SELECT word, swapped FROM {_TYPED} WHERE swapped IS NOT NULL) SELECT a, b, {tenths('a', 'b')} / 10.0::DOUBLE AS distance FROM pairs")
def weighted_distances(spark, sf_dir):
    inline = fixtures.table(spark, fixtures.DISTANCES, "a string, b string")
    words = entries(spark, sf_dir)
    doubled = words.select(F.col("word").alias("a"), F.coalesce(forms.double_vowel_typo("word"), "word").alias("b"))
    swapped = words.select(F.col("word").alias("a"), forms.phonetic_typo("word").alias("b")).where("b IS NOT NULL")
    return inline.unionByName(doubled).unionByName(swapped).select("a", "b", (batch.weighted_tenths("a", "b") / 10.0).alias("distance"))


# --- checking ------------------------------------------------------------------------------------

_CA, _CB = oracle.CLASS.format("t.w"), oracle.CLASS.format("d.word")
_SIMILAR = f"WITH {DICT}, t AS (SELECT DISTINCT lower(word) AS w FROM ({TOKENS}benchmark)) SELECT t.w, d.word FROM t JOIN dict d ON {_CA} = {_CB} AND length(d.word) BETWEEN length(t.w) - 2 AND length(t.w) + 2 WHERE levenshtein(t.w, d.word) <= 2"


def _benchmark_words(spark, sf_dir) -> DataFrame:
    return token_rows(read(spark, sf_dir, "benchmark")).select(forms.normal("word").alias("w")).distinct()


@query(_SIMILAR)
def similar_by_deletions(spark, sf_dir):
    return similar(_benchmark_words(spark, sf_dir), entries(spark, sf_dir).select("word"), "w", "word", 2)


@query(_SIMILAR)
def similar_by_lengths(spark, sf_dir):
    return similar_by_length(_benchmark_words(spark, sf_dir), entries(spark, sf_dir).select("word"), "w", "word", 2)


@query(f"WITH {oracle.checked(TOKENS + 'conversations')} SELECT DISTINCT word, match_kind, match_kind <> '' AS is_correct FROM ({TOKENS}conversations) t JOIN kinds ON w = translate(lower(word), 'ʻʼ', '''''')")
def is_correct(spark, sf_dir):
    return checker(spark, sf_dir).is_correct(token_rows(read(spark, sf_dir, "conversations")))


_BENCH = f"WITH {suggested(TOKENS + 'benchmark')} "


@query(_BENCH + "SELECT w, candidate, tenths, rank FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY tenths, freq DESC, candidate)::INTEGER AS rank FROM (SELECT * EXCLUDE (rank) FROM (SELECT *, 0 AS rank FROM measured WHERE path = 1 AND tenths <= 20))) WHERE rank <= 3")
def suggest_whole_words(spark, sf_dir):
    from pyspark.sql import Window

    c = checker(spark, sf_dir)
    words = _benchmark_words(spark, sf_dir)
    found = c.candidates(c.match_kinds(words).where("match_kind = ''").select("w")).where("path = 1 AND tenths <= 20")
    order = Window.partitionBy("w").orderBy("tenths", F.col("freq").desc(), "candidate")
    return found.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("w", "candidate", "tenths", "rank")


@query(_BENCH + "SELECT w, candidate, freq FROM rebuilt")
def suggest_rebuilt(spark, sf_dir):
    c = checker(spark, sf_dir)
    return c.rebuilt(c.match_kinds(_benchmark_words(spark, sf_dir)).where("match_kind = ''").select("w")).select("w", "candidate", "freq")


@query(_BENCH + f"SELECT DISTINCT t.word, match_kind, array_to_string(suggestions, '{BAR}') AS suggestions FROM ({TOKENS}benchmark) t JOIN answers ON w = translate(lower(t.word), 'ʻʼ', '''''')")
def suggest_full(spark, sf_dir):
    found = checker(spark, sf_dir).suggest(token_rows(read(spark, sf_dir, "benchmark")))
    return found.select("word", "match_kind", joined("suggestions").alias("suggestions"))


@query(_BENCH + f"SELECT DISTINCT t.word, coalesce(suggestions[1], t.word) AS correction FROM ({TOKENS}benchmark) t JOIN answers ON w = translate(lower(t.word), 'ʻʼ', '''''')")
def correct_word(spark, sf_dir):
    return checker(spark, sf_dir).correct(token_rows(read(spark, sf_dir, "benchmark")))


_KIND = f"WITH {oracle.checked(TOKENS + 'conversations')} "


@query(_KIND + f"SELECT conv_id, turn, count(word)::INTEGER AS total_words, count(CASE WHEN match_kind = '' THEN 1 END)::INTEGER AS errors_found FROM (SELECT conv_id, turn, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS word FROM (SELECT conv_id, turn, regexp_extract_all(text, '{oracle.WORD}') AS l FROM conversations)) LEFT JOIN kinds ON w = translate(lower(word), 'ʻʼ', '''''') GROUP BY conv_id, turn")
def check_text_summary(spark, sf_dir):
    return checker(spark, sf_dir).summary(read(spark, sf_dir, "conversations"), ["conv_id", "turn"])


_SPANS = f"errs AS (SELECT item_id, word, \"start\", \"end\", suggestions FROM ({spans('benchmark', 'item_id')}) JOIN answers ON w = translate(lower(word), 'ʻʼ', '''''') WHERE match_kind = '')"


@query(_BENCH.rstrip() + f",\n{_SPANS} SELECT item_id, word, \"start\", \"end\", array_to_string(suggestions, '{BAR}') AS suggestions FROM errs")
def check_spans(spark, sf_dir):
    found = checker(spark, sf_dir).errors(read(spark, sf_dir, "benchmark"), ["item_id"])
    return found.withColumn("suggestions", joined("suggestions"))


_ERRORS = f"SELECT b.item_id, len(regexp_extract_all(text, '{oracle.WORD}'))::INTEGER AS total_words, coalesce(n, 0)::INTEGER AS errors_found, coalesce(e, '') AS errors FROM benchmark b LEFT JOIN (SELECT item_id, count(*) AS n, string_agg(word || ': ' || array_to_string(suggestions, ','), '{BAR}' ORDER BY \"start\") AS e FROM errs GROUP BY item_id) x USING (item_id)"


def _flat_errors(c: Column | str) -> Column:
    return joined(F.transform(c, lambda e: F.concat(e["word"], F.lit(": "), F.array_join(e["suggestions"], ","))))


@query(_BENCH.rstrip() + f",\n{_SPANS} {_ERRORS}")
def check_text_errors(spark, sf_dir):
    found = checker(spark, sf_dir).check(read(spark, sf_dir, "benchmark"), ["item_id"])
    return found.withColumn("errors", _flat_errors("errors"))


@query(_BENCH.rstrip() + f""",
{_SPANS},
listed AS (SELECT item_id, count(*) AS n, string_agg('  - ' || word || ' → ' || array_to_string(suggestions, ', '), chr(10) ORDER BY "start") AS a, string_agg('  • ' || word || '  →  ' || CASE WHEN len(suggestions) > 0 THEN array_to_string(suggestions, ', ') ELSE 'no suggestion' END, chr(10) ORDER BY "start") AS b FROM errs GROUP BY item_id)
SELECT item_id, CASE WHEN n IS NULL THEN 'Xatosiz! (' || t || ' ta so''z tekshirildi)' ELSE n || ' ta xato topildi:' || chr(10) || chr(10) || a END AS reply,
CASE WHEN n IS NULL THEN 'All ' || t || ' words look correct.' ELSE 'Found ' || n || ' error(s) out of ' || t || ' words:' || chr(10) || chr(10) || b END AS report
FROM (SELECT item_id, len(regexp_extract_all(text, '{oracle.WORD}')) AS t FROM benchmark) LEFT JOIN listed USING (item_id)""")
def chat_replies(spark, sf_dir):
    found = checker(spark, sf_dir).check(read(spark, sf_dir, "benchmark"), ["item_id"])
    total, errors = F.col("total_words"), F.col("errors")
    return found.select("item_id", texts.reply(total, errors).alias("reply"), texts.report(total, errors).alias("report"))


@query(_BENCH.rstrip() + f",\n{_SPANS} {_ERRORS}")
def service_check(spark, sf_dir):
    found = service.check(checker(spark, sf_dir), read(spark, sf_dir, "benchmark"), ["item_id"])
    return found.withColumn("errors", _flat_errors("errors"))


_BACK = transliterated(oracle.cyrillic("text"))
_PIPE = f"WITH {suggested(f'SELECT unnest(regexp_extract_all(c, {oracle.text(oracle.WORD.replace(chr(39) * 2, chr(39)))})) AS word FROM (SELECT {_BACK} AS c FROM benchmark)')}"


_PIPE_ERRORS = f"{_PIPE},\n{_SPANS.replace(spans('benchmark', 'item_id'), spans(f'(SELECT item_id, {_BACK} AS text FROM benchmark)', 'item_id'))}"
_CONVERTED = f"({_ERRORS}) x JOIN (SELECT item_id, {oracle.cyrillic('text')} AS original, {_BACK} AS converted FROM benchmark) USING (item_id)"


@query(f"{_PIPE_ERRORS} SELECT x.item_id, original, converted, total_words, errors_found FROM {_CONVERTED}")
def pipeline_cyrillic(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").withColumn("text", translit.latin_to_cyrillic("text"))
    found = checker(spark, sf_dir).pipeline(rows, ["item_id"], script="cyrillic")
    return found.select("item_id", "original", "converted", "spell_check.total_words", "spell_check.errors_found")


@query(f"{_PIPE_ERRORS} SELECT x.item_id, original, converted, total_words, errors_found, errors FROM {_CONVERTED}")
def service_check_and_transliterate(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").withColumn("text", translit.latin_to_cyrillic("text"))
    found = service.check_and_transliterate(checker(spark, sf_dir), rows, ["item_id"], script="cyrillic")
    return found.withColumn("errors", _flat_errors("errors"))


@query(f"SELECT item_id, text AS original, {mixed('text')} AS converted, 'auto' AS mode FROM benchmark")
def service_transliterate(spark, sf_dir):
    return service.transliterated(read(spark, sf_dir, "benchmark"), ["item_id"])


# --- evaluation ----------------------------------------------------------------------------------


def _cases_sql(kind: str, column: str) -> str:
    return f"SELECT input, expected, '{kind}' AS type FROM (SELECT {column} AS input, word AS expected, freq, row_number() OVER (PARTITION BY {column} ORDER BY freq DESC, word) AS n FROM typed WHERE {column} IS NOT NULL AND {column} <> word AND {column} NOT IN (SELECT word FROM dict)) WHERE n = 1 ORDER BY freq DESC, expected LIMIT 100"


_CASES = f"typed AS (SELECT c.word, c.freq, doubled, swapped FROM (SELECT * FROM dict WHERE regexp_matches(word, '^[a-z'']{{4,10}}$') AND freq >= 20 ORDER BY freq DESC, word LIMIT 500) c JOIN {_TYPED} USING (word)), cases AS MATERIALIZED (FROM ({_cases_sql('phonetic', 'swapped')}) UNION ALL FROM ({_cases_sql('double_char', 'doubled')}))"


def _cases(spark, sf_dir) -> DataFrame:
    return evaluation.benchmark(entries(spark, sf_dir), least=20)


@query(f"WITH {DICT}, {_CASES} FROM cases")
def benchmark_cases(spark, sf_dir):
    return _cases(spark, sf_dir)


_PAIRS = "(SELECT unnest([swapped, doubled, doubled, word]) AS input, word AS expected FROM " + _TYPED.replace("HAVING count(*) >= 3", "HAVING count(*) >= 1") + ")"


@query(f"SELECT DISTINCT input, expected, 'real' AS type FROM {_PAIRS} WHERE input <> expected AND input NOT IN (SELECT word FROM ({counted('documents', 3)})) AND expected IN (SELECT word FROM ({counted('documents', 3)}))")
def real_cases(spark, sf_dir):
    """Cases of pairs as a reader collects them: typos of all words, also of such as the dictionary lacks, some twice, some no typos."""
    words = documents_counted(spark, sf_dir).select("word", forms.phonetic_typo("word").alias("swapped"), F.coalesce(forms.double_vowel_typo("word"), "word").alias("doubled"))
    pairs = words.select(F.explode(F.array("swapped", "doubled", "doubled", "word")).alias("input"), F.col("word").alias("expected"))
    return evaluation.real_cases(pairs, entries(spark, sf_dir))


_JUDGED = "WITH " + suggested("SELECT input AS word FROM cases").replace(DICT + ",", f"{DICT}, {_CASES},") + ", judged AS (SELECT c.*, suggestions, coalesce(suggestions[1] = expected, false) AS top1, coalesce(list_contains(suggestions, expected), false) AS top3 FROM cases c JOIN answers ON w = input) "


@query(_JUDGED + "SELECT type, count(*)::BIGINT AS cases, avg(top1::INTEGER)::DOUBLE AS top1, avg(top3::INTEGER)::DOUBLE AS top3 FROM judged GROUP BY GROUPING SETS ((), (type))")
def accuracy_by_type(spark, sf_dir):
    return evaluation.accuracy(evaluation.judged(_cases(spark, sf_dir), checker(spark, sf_dir)))


@query(_JUDGED + f"SELECT type, n, failed, input, expected, array_to_string(suggestions, '{BAR}') AS suggestions FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY input, expected)::INTEGER AS n, count(*) OVER (PARTITION BY type) AS failed FROM judged WHERE NOT top3) WHERE n <= 3")
def failures_top3(spark, sf_dir):
    found = evaluation.failures(evaluation.judged(_cases(spark, sf_dir), checker(spark, sf_dir)))
    return found.withColumn("suggestions", joined("suggestions"))


# --- texts ---------------------------------------------------------------------------------------


def _likely_sql(document: bool) -> str:
    curly = "‘’" if document else ""
    sample = lambda k, m: f"flatten(list_transform(range(0, {k}), lambda s: CASE WHEN len(l[s * z{k} + 1 : s * z{k} + z{k}]) <= {m} THEN l[s * z{k} + 1 : s * z{k} + z{k}] ELSE list_transform(range(0, {m}), lambda i: l[s * z{k} + 1 : s * z{k} + z{k}][i * (len(l[s * z{k} + 1 : s * z{k} + z{k}]) // {m}) + 1]) END))"
    count = lambda t, p: f"len(regexp_extract_all({t}, {oracle.text(p)}))"
    words = FUNCTION_WORDS if document else [*FUNCTION_WORDS, "bo'ldi"]
    hits = count("low", rf"\b(?:{'|'.join(words)})\b")
    plain = r"regexp_extract_all(low, '\b[a-z]{2,}\b')"
    dense = lambda k: f"(len({plain}) >= 4 AND {k} / greatest(len({plain}), 1)::DOUBLE > 0.15)"
    found = [
        f"{hits} >= 1" if document else f"({hits} >= 2 OR ({hits} >= 1 AND n >= 3))",
        f"regexp_matches(low, '[A-Za-z0-9_]{{3,}}(?:{'|'.join(TELLING_SUFFIXES)})\\b')",
        dense(f"len(list_filter({plain}, lambda w: contains(w, 'q')))"),
        dense(count("low", "sh|ch")),
        *([f"(length(text) > 100 AND {count('text', '(?i)' + chr(92) + 'b(?:' + '|'.join(ENGLISH_STOP) + ')' + chr(92) + 'b')} = 0)"] if document else []),
    ]
    mark = f"regexp_matches({'lower(text)' if document else 'low'}, '[og][''{curly}ʻʼʹ`´]')"
    return (
        f"SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN false WHEN length(regexp_replace(text, '[{oracle.SPACE}]', '', 'g')) < 15 THEN true WHEN regexp_matches(text, '[Ѐ-ӿ]') THEN false "
        f"WHEN {mark}{'' if document else ' AND n > 0'} THEN true WHEN n = 0 THEN false ELSE {' OR '.join(found)} END AS likely FROM (SELECT *, lower(array_to_string(CASE WHEN n <= {80 if document else 40} THEN l WHEN n <= 300 THEN {sample(3, 10)} ELSE {sample(5, 12)} END, ' ')) AS low FROM ("
        f"SELECT *, len(l) AS n, greatest(ceil(len(l) / 3.0), 1)::BIGINT AS z3, greatest(ceil(len(l) / 5.0), 1)::BIGINT AS z5 FROM (SELECT doc_id, text, regexp_extract_all(text, '[a-zA-Z][a-zA-Z''{curly}ʻʼʹ`´]*') AS l FROM documents)))"
    )


@query(_likely_sql(False))
def likely_uzbek_page(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", texts.likely_uzbek("text").alias("likely"))


@query(_likely_sql(True))
def likely_uzbek_document(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", texts.likely_uzbek("text", document=True).alias("likely"))


@query("SELECT doc_id, array_to_string(flatten(list_transform(range(0, 5), lambda s: CASE WHEN len(l[s * z + 1 : s * z + z]) <= 12 THEN l[s * z + 1 : s * z + z] ELSE list_transform(range(0, 12), lambda i: l[s * z + 1 : s * z + z][i * (len(l[s * z + 1 : s * z + z]) // 12) + 1]) END)), ' ') AS words FROM (SELECT doc_id, l, greatest(ceil(len(l) / 5.0), 1)::BIGINT AS z FROM (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z][a-zA-Z''ʻʼʹ`´]*') AS l FROM documents))")
def stratified_sample(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(texts.stratified_sample(tokens.client_words("text"), 5, 12), " ").alias("words"))


_NORM = "translate(lower({}), '‘’ʻʼ', '''''''''')"


@query(_BENCH.rstrip() + f",\n{_SPANS} SELECT item_id, \"start\", word, suggestions[1] AS suggestion, CASE WHEN replace({_NORM.format('word')}, '''', '') = replace({_NORM.format('suggestions[1]')}, '''', '') THEN 'Apostrof belgisi' WHEN abs(length(word) - length(suggestions[1])) > 3 THEN 'To''liqsiz so''z' ELSE 'Imlo xatosi' END AS category FROM errs WHERE len(suggestions) > 0")
def error_category(spark, sf_dir):
    found = checker(spark, sf_dir).errors(read(spark, sf_dir, "benchmark"), ["item_id"]).where(F.size("suggestions") > 0)
    first = F.element_at("suggestions", 1)
    return found.select("item_id", "start", "word", first.alias("suggestion"), texts.category("word", first).alias("category"))


@query(f"SELECT item_id, \"start\", CASE WHEN \"start\" > 30 THEN '…' || substr(text, greatest(\"start\" - 30, 0) + 1, least(\"start\", 30)) ELSE substr(text, greatest(\"start\" - 30, 0) + 1, least(\"start\", 30)) END AS before, CASE WHEN \"end\" + 30 < length(text) THEN substr(text, \"end\" + 1, 30) || '…' ELSE substr(text, \"end\" + 1, 30) END AS after FROM ({spans('benchmark', 'item_id')}) JOIN benchmark USING (item_id)")
def word_context(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(tokens.word_spans("text")).alias("s"))
    return rows.select("item_id", F.col("s.start").alias("start"), texts.context("text", F.col("s.start"), F.col("s.end")).alias("c")).select("item_id", "start", "c.before", "c.after")


def _with_errors(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark")
    return rows.join(checker(spark, sf_dir).check(rows, ["item_id"], spans=True), "item_id")


def _pieces_sql(wrong: str, right: str, lead: str = "") -> str:
    """The pieces of each text put together again, errors by ``wrong``, the rest by ``right``."""
    return f"""pieces AS (SELECT item_id, piece, at_, (sum(length(piece)) OVER (PARTITION BY item_id ORDER BY at_) - length(piece))::INTEGER AS "start" FROM (SELECT item_id, unnest(p) AS piece, generate_subscripts(p, 1) AS at_ FROM (SELECT item_id, regexp_extract_all(text, '{oracle.WORD}|[^a-zA-Z]+') AS p FROM benchmark)))
SELECT p.item_id, string_agg(CASE WHEN e.word IS NOT NULL{lead} THEN {wrong} ELSE {right} END, '' ORDER BY at_) AS text FROM pieces p LEFT JOIN errs e ON e.item_id = p.item_id AND e."start" = p."start" GROUP BY p.item_id"""


_ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_SPAN = "'<span class=\"error\" data-start=\"' || e.\"start\" || '\" data-end=\"' || e.\"end\" || '\" data-suggestions=\"' || " + _ESC.format("to_json(suggestions)::VARCHAR") + " || '\">' || e.word || '</span>'"


@query(_BENCH.rstrip() + f",\n{_SPANS},\n{_pieces_sql(_SPAN, _ESC.format('piece'))}")
def highlight_html(spark, sf_dir):
    return _with_errors(spark, sf_dir).select("item_id", texts.highlight("text", F.col("errors")).alias("text"))


@query(_BENCH.rstrip() + f",\n{_SPANS},\n{_pieces_sql('suggestions[1]', 'piece', ' AND len(suggestions) > 0')}")
def apply_all(spark, sf_dir):
    return _with_errors(spark, sf_dir).select("item_id", texts.apply_all("text", F.col("errors")).alias("text"))


@query(_BENCH.rstrip() + f""",
{_SPANS},
mended AS (SELECT DISTINCT item_id, word, suggestions[1] AS s FROM errs WHERE len(suggestions) > 0),
split AS (SELECT item_id, unnest(p) AS piece, generate_subscripts(p, 1) AS at_ FROM (SELECT item_id, regexp_split_to_array(regexp_replace(text, '^[{oracle.SPACE}]+|[{oracle.SPACE}]+$', '', 'g'), '[{oracle.SPACE}]+') AS p FROM benchmark))
SELECT x.item_id, string_agg(coalesce(m.s, piece), ' ' ORDER BY at_) AS text FROM split x LEFT JOIN mended m ON m.item_id = x.item_id AND m.word = piece GROUP BY x.item_id""")
def autocorrect(spark, sf_dir):
    return _with_errors(spark, sf_dir).select("item_id", texts.autocorrect("text", F.col("errors")).alias("text"))


@query(_BENCH.rstrip() + f",\n{_SPANS} SELECT b.item_id, CASE WHEN l IS NULL THEN text ELSE list_reduce(l, lambda t, e: replace(t, e.w, e.s), text) END AS text FROM benchmark b LEFT JOIN (SELECT item_id, list(struct_pack(w := word, s := suggestions[1]) ORDER BY \"start\" DESC) AS l FROM errs WHERE len(suggestions) > 0 GROUP BY item_id) x USING (item_id)")
def replace_everywhere(spark, sf_dir):
    return _with_errors(spark, sf_dir).select("item_id", texts.replace_everywhere("text", F.col("errors")).alias("text"))


@query(_BENCH.rstrip() + f",\n{_SPANS} SELECT e.item_id, \"start\", substr(text, 1, \"start\") || suggestions[1] || substr(text, \"end\" + 1) AS text FROM errs e JOIN benchmark b USING (item_id) WHERE len(suggestions) > 0")
def apply_one(spark, sf_dir):
    """Each error's first suggestion put into the text by itself."""
    rows = _with_errors(spark, sf_dir).select("item_id", "text", F.explode(F.filter("errors", lambda e: F.size(e["suggestions"]) > 0)).alias("e"))
    return rows.select("item_id", F.col("e.start").alias("start"), texts.apply_one("text", F.col("e"), F.element_at("e.suggestions", 1)).alias("text"))


@query(_BENCH.rstrip() + f",\n{_SPANS} SELECT item_id, word, \"start\" FROM errs WHERE \"start\" >= 20")
def ignored_filter(spark, sf_dir):
    """Errors but for those that a reader has ignored: here all that begin in a text's first twenty characters."""
    found = checker(spark, sf_dir).errors(read(spark, sf_dir, "benchmark"), ["item_id"])
    ignored = read(spark, sf_dir, "benchmark").select("item_id", F.explode(tokens.word_spans("text")).alias("s")).select("item_id", "s.word", "s.start").where("start < 20")
    return service.without_ignored(found, ignored, ["item_id"]).select("item_id", "word", "start")


@query(f"SELECT conv_id, turn, CASE WHEN length(regexp_replace(text, '^[{oracle.SPACE}]+|[{oracle.SPACE}]+$', '', 'g')) >= 3 THEN substr(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '^[{oracle.SPACE}]+|[{oracle.SPACE}]+$', '', 'g'), 1, 9500) END AS text FROM conversations")
def sanitise_requests(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", texts.sanitise("text").alias("text"))


@query(f"SELECT doc_id, coalesce(length(text) >= 20 AND len(w) >= 3 AND len(list_filter(w, lambda x: lower(x) IN {oracle.words(INTERFACE_WORDS)})) / greatest(len(w), 1)::DOUBLE < 0.5, false) AS content FROM (SELECT doc_id, text, regexp_extract_all(text, '[a-zA-Z]{{2,}}') AS w FROM documents)")
def content_heuristic(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", texts.is_content("text").alias("content"))


@query("SELECT conv_id, turn, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 10 AS long_enough FROM conversations")
def length_gate(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", texts.long_enough("text").alias("long_enough"))


# --- streams, as tables --------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, ts, event_type, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR, true)::INTEGER AS fresh, event_id FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e)
SELECT user_id AS field, max(ts) AS at, arg_max(event_type, (ts, event_type)) AS text FROM s GROUP BY user_id, n""")
def debounce_sessions(spark, sf_dir):
    edits = read(spark, sf_dir, "events").select(F.col("user_id").alias("field"), "ts", F.col("event_type").alias("text"))
    return debounced(edits, gap="1 hour")


@query("SELECT user_id AS field, max(ts) AS at, arg_max(event_type, (ts, event_type)) AS text FROM events GROUP BY user_id")
def latest_state(spark, sf_dir):
    return latest(read(spark, sf_dir, "events").select(F.col("user_id").alias("field"), "ts", F.col("event_type").alias("text")))


# --- files, written and read back -----------------------------------------------------------------


@cache
def _temporary() -> str:
    folder = tempfile.mkdtemp(prefix="sozgar-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _place(spark: SparkSession, name: str) -> str:
    """A place of this application in the shared folder; without one, a temporary folder, which only a single machine may use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = _temporary()
    return f"{folder.rstrip('/')}/sozgar-files/{spark.sparkContext.applicationId}/{name}"


@query(counted("documents", 3))
def file_dictionary_json(spark, sf_dir):
    """One JSON object, sorted by frequency, and back."""
    place = _place(spark, "dictionary.json")
    writers.export_dictionary(entries(spark, sf_dir), place)
    return readers.load_dictionary(spark, place + ".missing", place)


@query(counted("documents", 3))
def file_dictionary_table(spark, sf_dir):
    place = _place(spark, "dictionary.parquet")
    writers.write_dictionary(entries(spark, sf_dir), place)
    return readers.load_dictionary(spark, place)


@query(f"SELECT word, 2 * freq AS freq FROM ({counted('documents', 3)})")
def file_overwrite(spark, sf_dir):
    """A table replaced by a frame that reads it."""
    place = _place(spark, "overwritten.parquet")
    writers.write_dictionary(entries(spark, sf_dir), place)
    writers.overwrite(spark.read.parquet(place).withColumn("freq", 2 * F.col("freq")), place)
    return readers.load_dictionary(spark, place)


@query(f"SELECT DISTINCT word, 1::BIGINT AS freq FROM ({counted('documents', 3)}) WHERE regexp_matches(word, '^[a-z]')")
def file_word_list(spark, sf_dir):
    """Words with comments behind them and upper-case letters, and back."""
    place = _place(spark, "words.txt")
    lines = entries(spark, sf_dir).where("word RLIKE '^[a-z]'").select(F.explode(F.array(F.concat("word", F.lit(" # c")), F.upper("word"), F.lit("# c"))).alias("value"))
    lines.write.mode("overwrite").text(place)
    return readers.read_word_list(spark, place)


@query(f"WITH {DICT}, {_CASES} FROM cases")
def file_cases(spark, sf_dir):
    place = _place(spark, "cases.json")
    writers.write_cases(_cases(spark, sf_dir), place)
    return spark.read.schema("input string, expected string, type string").json(place)


@query(f"SELECT word AS input, doubled AS expected, '?' AS type FROM {_TYPED}")
def file_typos(spark, sf_dir):
    """Typos as CSV with blanks around the values and no category, and back."""
    place = _place(spark, "typos.csv")
    words = entries(spark, sf_dir).select("word", F.coalesce(forms.double_vowel_typo("word"), "word").alias("doubled"))
    rows = words.select(F.concat(F.lit(" "), "word").alias("typo"), F.concat("doubled", F.lit(" ")).alias("correct"), F.lit(None).cast("string").alias("category"))
    rows.write.mode("overwrite").csv(place, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_typos(spark, place)


@query(counted("documents"))
def file_batches(spark, sf_dir):
    """All texts in files of a thousand, read as a folder and counted."""
    place = _place(spark, "batches")
    writers.write_batches(read(spark, sf_dir, "documents").where("text IS NOT NULL"), place)
    return dictionary.word_count(readers.read_folder(spark, place), tokens.corpus_words(F.lower("text")))


@query(f"SELECT value FROM (SELECT unnest(string_split(text, chr(10))) AS value FROM conversations) WHERE trim(value, ' ') <> '' AND NOT starts_with(value, '#')")
def file_messages(spark, sf_dir):
    """Messages by line among comments and blank lines."""
    place = _place(spark, "messages.txt")
    rows = read(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.explode(F.array("text", F.lit("# c"), F.lit(" "))).alias("value"))
    rows.write.mode("overwrite").text(place)
    return readers.read_messages(spark, place)


@query("SELECT doc_id::VARCHAR AS title, length(regexp_replace(text, '\\s+', '', 'g'))::INTEGER AS n FROM documents WHERE regexp_matches(text, '\\S')")
def file_articles(spark, sf_dir):
    """A dump of articles, among pages of another name space, in bz2, and back."""
    place = _place(spark, "dump.xml")
    texts_of = read(spark, sf_dir, "documents").where("text RLIKE '[^ \t\n\r]'")
    pages = texts_of.select(F.explode(F.array(F.lit(0), F.lit(None).cast("int"), F.lit(1))).alias("ns"), "doc_id", "text").where("ns IS NOT NULL")
    rows = pages.select(F.concat("doc_id", F.when(F.col("ns") == 1, ":talk").otherwise("")).alias("title"), "ns", F.struct("text").alias("revision"))
    rows.write.format("xml").mode("overwrite").option("rowTag", "page").option("rootTag", "dump").option("compression", "bzip2").save(place)
    return readers.read_articles(spark, place).select("title", F.length(F.regexp_replace("text", r"\s+", "")).alias("n"))
