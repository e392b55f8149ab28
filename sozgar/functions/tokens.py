"""Tokens, spans and words of raw text, HTML and wiki markup as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sozgar.functions.alphabet import BLOCKED_LAW, BLOCKED_NEWS, BLOCKED_WEB
from sozgar.functions.translit import WORD_CHAR, col, maybe_transliterate

#: White space as Python's regular expressions know it.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = "[a-zA-Z][a-zA-Z'ʻʼ]*"
CLIENT_WORD = "[a-zA-Z][a-zA-Z'ʻʼʹ`´]*"
CLIENT_WORD_CURLY = "[a-zA-Z][a-zA-Z'‘’ʻʼʹ`´]*"
CORPUS_LETTERS = "[a-zA-ZʻʼoOgG']"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def tokenize(text: Column | str) -> Column:
    """Words, single punctuation marks and runs of white space in order; digits, marks of other scripts and the like are dropped."""
    return F.regexp_extract_all(col(text), F.lit(f"{WORD}|[^{WORD_CHAR}{SPACE}]|[{SPACE}]+"), 0)


def word_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(WORD), 0)


def client_words(text: Column | str, curly: bool = False) -> Column:
    return F.regexp_extract_all(col(text), F.lit(CLIENT_WORD_CURLY if curly else CLIENT_WORD), 0)


def word_spans(text: Column | str, block: int = 64) -> Column:
    """array<struct<word, start, end>>: code-point offsets, end exclusive.

    The text is cut into words and what lies between without loss. Lengths are added up in blocks of pieces and
    over the blocks, as an array that grows piece by piece would be copied each time.
    """
    spans = "array<struct<word:string,start:int,end:int>>"

    def inside(pieces: Column, start: Column) -> Column:
        def step(state: Column, piece: Column) -> Column:
            end = state["at"] + F.length(piece)
            span = F.struct(piece.alias("word"), state["at"].alias("start"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(piece.rlike("^[a-zA-Z]"), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

        return F.aggregate(pieces, F.struct(start.alias("at"), F.array().cast(spans).alias("spans")), step, lambda s: s["spans"])

    pieces = F.regexp_extract_all(col(text), F.lit(f"{WORD}|[^a-zA-Z]+"), 0)
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(p) / block).cast("int") - 1, F.lit(0))), lambda k: F.slice(p, k * block + 1, block))
    blocks = F.transform(F.array(pieces), cut)[0]
    sizes = lambda b: F.transform(b, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + F.length(x)))
    begins = lambda b: F.aggregate(sizes(b), F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    bound = F.transform(F.array(blocks), lambda b: F.struct(b.alias("b"), begins(b).alias("s")))[0]
    return F.transform(F.array(bound), lambda x: F.flatten(F.transform(F.arrays_zip(x["b"].alias("b"), F.slice(x["s"], 1, F.size(x["b"])).alias("s")), lambda y: inside(y["b"], y["s"]))))[0]


def corpus_words(text: Column | str, least: int = 2) -> Column:
    """Runs of Latin letters and apostrophes of a length of ``least`` or more."""
    return F.regexp_extract_all(col(text), F.lit(f"{CORPUS_LETTERS}{{{least},}}"), 0)


def not_blocked(words: Column, blocked: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(blocked))


def web_words(text: Column | str) -> Column:
    """Words of a web corpus line: converted if Cyrillic, lower case, blocked words left out."""
    return not_blocked(corpus_words(F.lower(maybe_transliterate(text))), BLOCKED_WEB)


def encyclopedia_words(text: Column | str) -> Column:
    return F.transform(corpus_words(maybe_transliterate(text)), F.lower)


def html_text(html: Column | str, dropped: tuple[str, ...] = ("script", "style", "nav", "header", "footer", "aside")) -> Column:
    """Text of a page without the dropped elements; tags become blanks."""
    out = F.regexp_replace(col(html), r"(?s)<!--.*?-->", " ")
    for tag in dropped:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for entity, character in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(character))
    return out


def news_words(html: Column | str) -> Column:
    return not_blocked(F.transform(corpus_words(html_text(html), 3), F.lower), BLOCKED_NEWS)


def law_words(html: Column | str) -> Column:
    return not_blocked(F.transform(corpus_words(html_text(html, ("script", "style", "nav", "header", "footer")), 3), F.lower), BLOCKED_LAW)


def links(html: Column | str, pattern: str, base: str, without: str | None = None) -> Column:
    """Distinct targets of links that match, in order, completed with ``base`` where they are relative."""
    found = F.regexp_extract_all(col(html), F.lit(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']"""), 1)
    kept = F.filter(found, lambda x: x.rlike(pattern) & (~x.contains(without) if without else F.lit(True)))
    return F.array_distinct(F.transform(kept, lambda x: F.when(x.startswith("http"), x).otherwise(F.concat(F.lit(base), x))))


def news_links(html: Column | str, base: str) -> Column:
    return links(html, r"/news/\d{4}/", base, "/category/")


def law_links(html: Column | str, base: str) -> Column:
    return links(html, r"/uz/docs/-?\d+", base)


#: Steps that undo wiki markup, in order: comments, references, tables, files, templates from the inside out, links, emphasis,
#: tags, and at the end headings and addresses (a reference's closing tag may follow an address).
WIKI_STEPS = [
    (r"(?s)<!--.*?-->", ""), (r"(?is)<ref[^>/]*/>", ""), (r"(?is)<ref[^>]*>.*?</ref>", ""), (r"(?s)\{\|.*?\|\}", ""), (r"(?i)\[\[File:[^\]]+\]\]", " "),
    *[(r"\{\{[^{}]*\}\}", "")] * 8,
    (r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1"), (r"\[\S+ ([^\]]*)\]", "$1"), (r"'{2,}", ""), (r"</?[a-zA-Z][^>]*>", ""), (r"={2,}[^=]+=+", " "), (r"(?i)http\S+", " "),
]
#: What every match of a step holds; a text without it stays as it is.
WIKI_SIGN = r"[<{\[]|''|==|(?i:http)"


def wiki_text(markup: Column | str) -> Column:
    """Plain text of wiki markup by ``WIKI_STEPS``; templates may nest eight deep. Texts without a sign of markup are passed by."""
    given = out = col(markup)
    for pattern, by in WIKI_STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.when(given.rlike(WIKI_SIGN), out).otherwise(given)


def blank_words(text: Column | str) -> Column:
    """Words between runs of white space; none for blank text."""
    trimmed = F.regexp_replace(col(text), f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))
