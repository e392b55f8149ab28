"""Conversion between Cyrillic and Latin script as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sozgar.functions.alphabet import CYRILLIC_TO_LATIN, DIGRAPHS_BACK, SINGLES_BACK

#: The class of word characters, spelled out because the word boundary of regular expressions differs between Java versions.
WORD_CHAR = r"\p{L}\p{N}_"
CYRILLIC = r"\x{0400}-\x{04FF}"
#: A single word of both Cyrillic and other characters, or what lies between two such words, as long as it is.
#: Possessive repeats keep the match from recursing, so the length of a text does not matter.
PIECE = f"(?:[^{WORD_CHAR}]++|[{WORD_CHAR}&&[{CYRILLIC}]]++(?![{WORD_CHAR}])|[{WORD_CHAR}&&[^{CYRILLIC}]]++(?![{WORD_CHAR}]))++|[{WORD_CHAR}]++"
MODES = ("cyrillic-to-latin", "latin-to-cyrillic", "auto")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with a value that is computed once; inside lambdas repeated expressions are not shared otherwise."""
    return F.transform(F.array(value), body)[0]


def transliterate(text: Column | str) -> Column:
    """Cyrillic to Latin. Е at the start of a word is Ye; other characters stay. Texts without Cyrillic are passed by."""
    given = out = col(text)
    for letter, spelling in (("Е", "Ye"), ("е", "ye")):
        # The letter first, as most places end there; a letter beyond 16 bits in the class makes Java look back by whole characters.
        out = F.regexp_replace(out, f"{letter}(?<![{WORD_CHAR}\U00010400]{letter})", spelling)
    for letter, spelling in CYRILLIC_TO_LATIN.items():
        if len(spelling) == 2:
            out = F.replace(out, F.lit(letter), F.lit(spelling))
    single = {k: v for k, v in CYRILLIC_TO_LATIN.items() if len(v) == 1}
    dropped = "".join(k for k, v in CYRILLIC_TO_LATIN.items() if not v)
    return F.when(given.rlike(f"[{CYRILLIC}]"), F.translate(out, "".join(single) + dropped, "".join(single.values()))).otherwise(given)


def latin_to_cyrillic(text: Column | str) -> Column:
    """Latin to Cyrillic: digraphs one after the other over the whole text, then single letters."""
    out = col(text)
    for spelling, letter in DIGRAPHS_BACK:
        out = F.replace(out, F.lit(spelling), F.lit(letter))
    return F.translate(out, "".join(SINGLES_BACK), "".join(SINGLES_BACK.values()))


def cyrillic_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{CYRILLIC}]+", "")) / F.greatest(F.length(text), F.lit(1))


def detect_script(token: Column | str) -> Column:
    """'cyrillic' if more than 30 % of the characters are, else 'latin'."""
    return F.when(cyrillic_share(col(token)) > 0.3, "cyrillic").otherwise("latin")


def transliterate_mixed(text: Column | str) -> Column:
    """Converts the words that are mainly Cyrillic; other words and what stands between stay."""
    return F.array_join(F.transform(F.regexp_extract_all(col(text), F.lit(PIECE), 0), transliterate_piece), "")


def transliterate_piece(piece: Column) -> Column:
    """A piece of ``PIECE`` converted. Only a word of both kinds is weighed: any other is wholly Cyrillic or has nothing to convert."""
    return F.when(piece.rlike(f"[^{WORD_CHAR}]") | (cyrillic_share(piece) > 0.3), transliterate(piece)).otherwise(piece)


def maybe_transliterate(text: Column | str) -> Column:
    """Converts the whole text if Cyrillic characters are more than a tenth of its word characters."""
    t = col(text)
    words = F.length(F.regexp_replace(t, f"[^{WORD_CHAR}]+", ""))
    cyrillic = F.length(F.regexp_replace(t, f"[^{CYRILLIC}]+", ""))
    return F.when((words > 0) & (cyrillic / F.greatest(words, F.lit(1)) > 0.1), transliterate(t)).otherwise(t)


def convert(text: Column | str, mode: str) -> Column:
    """By mode: cyrillic-to-latin, latin-to-cyrillic or auto (word by word); others are an error."""
    found = mode.strip().lower()
    if found not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    return {"cyrillic-to-latin": transliterate, "latin-to-cyrillic": latin_to_cyrillic, "auto": transliterate_mixed}[found](text)
