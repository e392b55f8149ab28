"""Whole-text expressions: language gate, samples, categories, context, highlighting and corrections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sozgar.functions.alphabet import ENGLISH_STOP, FUNCTION_WORDS, INTERFACE_WORDS, MENU_WORDS, TELLING_SUFFIXES
from sozgar.functions.tokens import SPACE, blank_words, client_words
from sozgar.functions.translit import CYRILLIC, col, let

_WORD = "[A-Za-z0-9_]"


def whole_words(words: list[str]) -> str:
    """A pattern for any of the words between ASCII word boundaries."""
    return f"(?<!{_WORD})(?:{'|'.join(words)})(?!{_WORD})"


def count_of(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1))


def section_sample(words: Column, count: int) -> Column:
    """``count`` words at equal strides from the first on; all if there are no more."""

    def strided(w: Column) -> Column:
        stride = F.floor(F.size(w) / count).cast("int")
        return F.when(F.size(w) <= count, w).otherwise(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.element_at(w, (i * stride + 1).cast("int"))))

    return let(words, strided)


def stratified_sample(words: Column, sections: int, per_section: int) -> Column:
    """Equal slices of the words, sampled one by one."""

    def cut(w: Column) -> Column:
        size = F.greatest(F.ceil(F.size(w) / sections).cast("int"), F.lit(1))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(sections - 1)), lambda s: section_sample(F.slice(w, s * size + 1, size), per_section)))

    return let(words, cut)


def likely_uzbek(text: Column | str, document: bool = False) -> Column:
    """Whether a text is likely Latin-script Uzbek. ``document``: the variant for editors of whole documents.

    Samples are taken at fixed strides, so the answer is the same each time.
    """
    t = col(text)
    marks = "['‘’ʻʼʹ`´]" if document else "['ʻʼʹ`´]"
    functional = whole_words(FUNCTION_WORDS if document else [*FUNCTION_WORDS, "bo'ldi"])

    def sampled(w: Column) -> Column:
        n = F.size(w)
        checked = F.when(n <= (80 if document else 40), w).when(n <= 300, stratified_sample(w, 3, 10)).otherwise(stratified_sample(w, 5, 12))
        return F.struct(n.alias("n"), F.lower(F.array_join(checked, " ")).alias("low"))

    def dense(x: Column) -> Column:
        plain = F.regexp_extract_all(x["low"], F.lit(f"(?<!{_WORD})([a-z]{{2,}})(?!{_WORD})"), 1)
        often = lambda p, k: (F.size(p) >= 4) & (k / F.greatest(F.size(p), F.lit(1)) > 0.15)
        return let(plain, lambda p: often(p, F.size(F.filter(p, lambda w: w.contains("q")))) | often(p, count_of(x["low"], "sh|ch")))

    def judged(x: Column) -> Column:
        hits = count_of(x["low"], functional)
        function = hits >= 1 if document else (hits >= 2) | ((hits >= 1) & (x["n"] >= 3))
        suffix = x["low"].rlike(f"{_WORD}{{3,}}(?:{'|'.join(TELLING_SUFFIXES)})(?!{_WORD})")
        found = function | suffix | dense(x)
        if document:
            found = found | ((F.length(t) > 100) & (count_of(t, "(?i:" + whole_words(ENGLISH_STOP) + ")") == 0))
        apostrophe = F.lower(t).rlike(f"[og]{marks}") if document else x["low"].rlike(f"[og]{marks}") & (x["n"] > 0)
        return F.when(apostrophe, True).when(x["n"] == 0, False).otherwise(found)

    words = client_words(t, document)
    return (
        F.when(t.isNull() | (t == ""), False)
        .when(F.length(F.regexp_replace(t, f"[{SPACE}]", "")) < 15, True)
        .when(t.rlike(f"[{CYRILLIC}]"), False)
        .otherwise(let(let(words, sampled), judged))
    )


def category(word: Column | str, suggestion: Column | str) -> Column:
    """What kind of error a suggestion mends: apostrophe, incomplete word or spelling."""
    norm = lambda c: F.translate(F.lower(col(c)), "‘’ʻʼ", "''''")
    w, s = norm(word), norm(suggestion)
    return (
        F.when(F.replace(w, F.lit("'"), F.lit("")) == F.replace(s, F.lit("'"), F.lit("")), "Apostrof belgisi").when(F.abs(F.length(w) - F.length(s)) > 3, "To'liqsiz so'z").otherwise("Imlo xatosi")
    )


def context(text: Column | str, start: Column, end: Column, width: int = 30) -> Column:
    """struct<before, after>: what surrounds a span, with an ellipsis where it is cut."""
    t = col(text)
    before = F.substring(t, F.greatest(start - width, F.lit(0)) + 1, F.least(start, F.lit(width)))
    after = F.substring(t, end + 1, F.lit(width))
    return F.struct(
        F.when(start > width, F.concat(F.lit("…"), before)).otherwise(before).alias("before"), F.when(end + width < F.length(t), F.concat(after, F.lit("…"))).otherwise(after).alias("after")
    )


def escape_html(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def by_start(errors: Column) -> Column:
    return F.array_sort(errors, lambda a, b: (a["start"] - b["start"]).cast("int"))


def highlight(text: Column | str, errors: Column) -> Column:
    """HTML with a span around each error (array<struct<word, start, end, suggestions>>); overlapping and out-of-range errors are skipped."""
    t = col(text)

    def step(state: Column, e: Column) -> Column:
        lead = escape_html(F.substring(t, state["at"] + 1, e["start"] - state["at"]))
        span = F.concat(
            F.lit('<span class="error" data-start="'), e["start"].cast("string"), F.lit('" data-end="'), e["end"].cast("string"), F.lit('" data-suggestions="'), escape_html(F.to_json(e["suggestions"])), F.lit('">'), escape_html(e["word"]), F.lit("</span>")
        )
        return F.when((e["start"] < state["at"]) | (e["end"] > F.length(t)), state).otherwise(F.struct(e["end"].alias("at"), F.concat(state["html"], lead, span).alias("html")))

    return F.aggregate(by_start(errors), F.struct(F.lit(0).alias("at"), F.lit("").alias("html")), step, lambda s: F.concat(s["html"], escape_html(F.substring(t, s["at"] + 1, F.length(t)))))


def apply_all(text: Column | str, errors: Column) -> Column:
    """The text with every error that has suggestions replaced by its first, from right to left."""
    usable = F.reverse(by_start(F.filter(errors, lambda e: F.size(e["suggestions"]) > 0)))
    return F.aggregate(usable, col(text), lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), F.element_at(e["suggestions"], 1), F.substring(t, e["end"] + 1, F.length(t))))


def apply_one(text: Column | str, error: Column, suggestion: Column) -> Column:
    t = col(text)
    return F.concat(F.substring(t, F.lit(1), error["start"]), suggestion, F.substring(t, error["end"] + 1, F.length(t)))


def autocorrect(text: Column | str, errors: Column) -> Column:
    """Blank-separated words that are errors replaced by their first suggestion, joined by single blanks; words with attached marks stay."""
    usable = F.filter(errors, lambda e: F.size(e["suggestions"]) > 0)
    found = F.transform(usable, lambda e: F.struct(e["word"].alias("key"), F.element_at(e["suggestions"], 1).alias("value")))
    last = lambda w: F.element_at(F.filter(found, lambda p: p["key"] == w), -1)["value"]
    return F.array_join(F.transform(blank_words(text), lambda w: F.when(F.exists(found, lambda p: p["key"] == w), last(w)).otherwise(w)), " ")


def replace_everywhere(text: Column | str, errors: Column) -> Column:
    """Every occurrence of each error's word replaced, last error first."""
    usable = F.reverse(F.filter(errors, lambda e: F.size(e["suggestions"]) > 0))
    return F.aggregate(usable, col(text), lambda t, e: F.replace(t, e["word"], F.element_at(e["suggestions"], 1)))


def sanitise(text: Column | str, most: int = 9_500, least: int = 3) -> Column:
    """Control characters out, trimmed, the first ``most`` characters; null if there are fewer than ``least``."""
    t = col(text)
    edges = f"^[{SPACE}]+|[{SPACE}]+$"
    clean = F.regexp_replace(F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), edges, "")
    return F.when(F.length(F.regexp_replace(t, edges, "")) >= least, F.substring(clean, 1, most))


def long_enough(text: Column | str, least: int = 10) -> Column:
    return F.length(F.regexp_replace(col(text), f"^[{SPACE}]+|[{SPACE}]+$", "")) >= least


def longest(candidates: Column, most: int = 10_000) -> Column:
    """The longest of several extracted texts (the first of equals), cut at ``most`` characters."""
    best = F.aggregate(candidates, F.lit("").cast("string"), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    return F.substring(best, 1, most)


def without_menus(text: Column | str) -> Column:
    """Menu words at line starts, toolbar lines and surplus blank lines out."""
    out = F.regexp_replace(col(text), rf"(?m)^({'|'.join(MENU_WORDS)})\s*", "")
    out = F.regexp_replace(out, r"(?m)^(Menus|Main toolbar|Last edit was .*)$", "")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_content(text: Column | str) -> Column:
    """At least 20 characters and three words of which fewer than half belong to user interfaces."""
    words = F.regexp_extract_all(col(text), F.lit("[a-zA-Z]{2,}"), 0)
    interface = F.size(F.filter(words, lambda w: F.lower(w).isin(INTERFACE_WORDS)))
    return F.coalesce((F.length(col(text)) >= 20) & (F.size(words) >= 3) & (interface / F.greatest(F.size(words), F.lit(1)) < 0.5), F.lit(False))


def _lines(head: Column, errors: Column, line, none: Column) -> Column:
    return F.when(F.size(errors) == 0, none).otherwise(F.concat(head, F.lit("\n\n"), F.array_join(F.transform(errors, line), "\n")))


def reply(total: Column, errors: Column, most: int = 3) -> Column:
    """A chat reply: the number of errors and the first suggestions of each."""
    line = lambda e: F.concat(F.lit("  - "), e["word"], F.lit(" → "), F.array_join(F.slice(e["suggestions"], 1, most), ", "))
    none = F.concat(F.lit("Xatosiz! ("), total.cast("string"), F.lit(" ta so'z tekshirildi)"))
    return _lines(F.concat(F.size(errors).cast("string"), F.lit(" ta xato topildi:")), errors, line, none)


def report(total: Column, errors: Column) -> Column:
    """A report of all errors with all their suggestions."""
    line = lambda e: F.concat(F.lit("  • "), e["word"], F.lit("  →  "), F.when(F.size(e["suggestions"]) > 0, F.array_join(e["suggestions"], ", ")).otherwise("no suggestion"))
    none = F.concat(F.lit("All "), total.cast("string"), F.lit(" words look correct."))
    return _lines(F.concat(F.lit("Found "), F.size(errors).cast("string"), F.lit(" error(s) out of "), total.cast("string"), F.lit(" words:")), errors, line, none)
