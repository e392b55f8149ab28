"""Script conversion, tokens and clean text over Arrow batches of whole texts.

The built-in expressions in ``translit``, ``tokens`` and ``texts`` run over a text once for each letter that they replace.
Here a text becomes one byte for each character (``CHARSET``), and bytes are replaced, counted and dropped at the speed of
memory. A text with a character outside ``CHARSET`` takes the same steps as a string. Both give what the expressions give
(tested); a word character is a letter, a number or "_" as this Python's Unicode tables have them.
"""

from __future__ import annotations

import codecs
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sozgar.functions.alphabet import CYRILLIC_TO_LATIN, DIGRAPHS_BACK, SINGLES_BACK
from sozgar.functions.tokens import WIKI_STEPS, WORD

# Shipped by value: executors need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of an Arrow batch, where the session has not chosen otherwise; long texts make batches large.
BATCH_ROWS = 250
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"

#: Character of each byte: ASCII, the letters that are converted, their marks, and others that are frequent beside them.
CHARSET = ("".join(map(chr, range(128))) + "".join(CYRILLIC_TO_LATIN) + "ʻʼ" + "\xa0‘’“”„«»–—…№•°©´ʹ" + "éèêëçßüäöóñíúâîáàôÉÈÊÇÜÖÄÓÑÍÚÂÎÁ").ljust(256, "￾")[:256]


def code(s: str) -> bytes:
    return bytes(map(CHARSET.index, s))


def table(pairs: dict[str, str]) -> bytes:
    return bytes(CHARSET.index(pairs.get(c, c)) for c in CHARSET)


def among(chars: bytes) -> bytes:
    """The bytes as what stands inside a character class."""
    return b"".join(b"\\x%02x" % c for c in chars)


USED = CHARSET.rstrip("￾")
CYRILLIC8 = code("".join(c for c in USED if "Ѐ" <= c <= "ӿ"))
WORD8 = code("".join(c for c in USED if c.isalnum() or c == "_"))
NOT_WORD8 = code("".join(c for c in USED if not (c.isalnum() or c == "_")))
CONTROLS = bytes([*range(9), 11, 12, *range(14, 32)])

#: Е at the start of a word; the letter first, as most places end there.
STARTS = [(re.compile(f"{e}(?<!\\w{e})"), ye) for e, ye in (("Е", "Ye"), ("е", "ye"))]
STARTS8 = [(re.compile(among(code(e)) + b"(?<![" + among(WORD8) + b"]" + among(code(e)) + b")"), code(ye)) for e, ye in (("Е", "Ye"), ("е", "ye"))]
LATIN = str.maketrans(CYRILLIC_TO_LATIN)
LATIN8 = table({k: v for k, v in CYRILLIC_TO_LATIN.items() if len(v) == 1})
PAIRS8 = [(code(k), code(v)) for k, v in CYRILLIC_TO_LATIN.items() if len(v) == 2]
DROPPED8 = code("".join(k for k, v in CYRILLIC_TO_LATIN.items() if not v))
BACK = str.maketrans(SINGLES_BACK)
BACK8 = table(SINGLES_BACK)
DIGRAPHS8 = [(code(a), code(b)) for a, b in DIGRAPHS_BACK]
#: c: a Cyrillic word character, n: another word character, blank: the rest.
KINDS8 = bytes(ord("c" if i in CYRILLIC8 and i in WORD8 else "n" if i in WORD8 else " ") for i in range(256))
BESIDE8 = re.compile(b"cnn|nnc")
CYRILLIC, WORDS, NOT_WORD = re.compile("[Ѐ-ӿ]+"), re.compile(r"\w+"), re.compile(r"\W+")

TOKENS, LATIN_WORDS = re.compile(rf"{WORD}|[^\w\s]|\s+"), re.compile(WORD)
#: Parts of tokens: 1 a Latin letter, 2 what only goes on with a word, 3 the apostrophe, which does so or stands alone, 4 white space, 5 a mark, 0 what is dropped.
PARTS8 = bytes(1 if c.isascii() and c.isalpha() else 2 if c in "ʻʼ" else 3 if c == "'" else 4 if c.isspace() else 0 if c.isalnum() or c == "_" or c == "￾" else 5 for c in CHARSET)
WIDTHS = np.array([len(c.encode()) for c in CHARSET], np.int32)
#: Java's classes are those of ASCII.
WIKI = [(re.compile(pattern, re.ASCII), by.replace("$1", r"\1")) for pattern, by in WIKI_STEPS]
CONTROL = re.compile("[" + "".join(map("\\x{:02x}".format, CONTROLS)) + "]+")


class Texts:
    """The texts of an Arrow array: ``s`` as strings, ``b`` as bytes of ``CHARSET`` (none where a character is outside)."""

    def __init__(self, x: pa.Array):
        self.x = x
        try:
            self.s = x.to_pylist()
        except UnicodeDecodeError:
            self.s = [None if v is None else v.decode("utf-8", "replace") for v in x.cast(pa.binary()).to_pylist()]
        into = codecs.charmap_build(CHARSET)
        self.b = [None if s is None else self.encoded(s, into) for s in self.s]
        self.kept = {}

    @staticmethod
    def encoded(s: str, into) -> bytes | None:
        try:
            return codecs.charmap_encode(s, "strict", into)[0]
        except UnicodeEncodeError:
            return None

    def each(self, name: str, f) -> list:
        """``f`` of each text's string and bytes, worked out once for all functions that ask; null for null."""
        if name not in self.kept:
            self.kept[name] = [None if s is None else f(s, b) for s, b in zip(self.s, self.b, strict=True)]
        return self.kept[name]

    def latin(self) -> list:
        return self.each("latin", lambda s, b: s if s.isascii() else to_latin(s) if b is None else decoded(to_latin8(b)))

    def cyrillic(self) -> list:
        """How many characters of each text are Cyrillic."""
        return self.each("cyrillic", lambda s, b: 0 if s.isascii() else len(s) - (len(CYRILLIC.sub("", s)) if b is None else len(b.translate(None, CYRILLIC8))))


def opened(x: pa.Array) -> Texts:
    """The texts of a batch, shared by all functions that a worker runs over it. ``sys`` holds them, as each function is shipped with its own globals."""
    buffer = x.buffers()[1]
    key = (buffer and buffer.address, x.offset, len(x))
    last = sys.__dict__.get("_sozgar_texts")
    if last is None or last[0] != key or buffer is None:
        last = sys.__dict__["_sozgar_texts"] = (key, Texts(x))  # holds the array, so its address is not given to another
    return last[1]


def decoded(b: bytes) -> str:
    return codecs.charmap_decode(b, "strict", CHARSET)[0]


def to_latin(s: str) -> str:
    for pattern, by in STARTS:
        s = pattern.sub(by, s)
    return s.translate(LATIN)


def to_latin8(b: bytes) -> bytes:
    for pattern, by in STARTS8:
        b = pattern.sub(by, b)
    for letter, spelling in PAIRS8:
        b = b.replace(letter, spelling)
    return b.translate(LATIN8, DROPPED8)


def to_cyrillic(s: str) -> str:
    for spelling, letter in DIGRAPHS_BACK:
        s = s.replace(spelling, letter)
    return s.translate(BACK)


def to_cyrillic8(b: bytes) -> bytes:
    for spelling, letter in DIGRAPHS8:
        b = b.replace(spelling, letter)
    return b.translate(BACK8)


def by_word(s: str) -> str:
    """Converted, but for the words that are Cyrillic to 30 % or less."""
    out, at = [], 0
    for m in WORDS.finditer(s):
        w = m[0]
        n = 0 if w.isascii() else len(w) - len(CYRILLIC.sub("", w))
        if n and not n / len(w) > 0.3:
            out += [to_latin(s[at : m.start()]), w]
            at = m.end()
    return "".join([*out, to_latin(s[at:])])


def by_word8(b: bytes, kinds: bytes) -> bytes | None:
    """As ``by_word``; none if every word is converted. A word that stays has two other word characters in a row beside a Cyrillic one."""
    out, at, end = [], 0, 0
    for m in BESIDE8.finditer(kinds):
        if m.start() < end:
            continue
        start, end = kinds.rfind(b" ", end, m.start()) + 1 or end, kinds.find(b" ", m.start())
        end = len(b) if end < 0 else end
        if not kinds.count(b"c", start, end) / (end - start) > 0.3:
            out += [to_latin8(b[at:start]), b[start:end]]
            at = end
    return b"".join([*out, to_latin8(b[at:])]) if out else None


def mixed_text(s: str, b: bytes | None, latin: str, cyrillic: int) -> str:
    if b is None or not cyrillic:
        return by_word(s) if cyrillic else s
    found = by_word8(b, b.translate(KINDS8))
    return latin if found is None else decoded(found)


def maybe_text(s: str, b: bytes | None, latin: str, cyrillic: int) -> str:
    words = cyrillic and len(NOT_WORD.sub("", s) if b is None else b.translate(None, NOT_WORD8))
    return latin if words and cyrillic / words > 0.1 else s


def transliterate(x: pa.Array) -> pa.Array:
    return pa.array(opened(x).latin(), pa.string())


def latin_to_cyrillic(x: pa.Array) -> pa.Array:
    return pa.array([None if s is None else to_cyrillic(s) if b is None else decoded(to_cyrillic8(b)) for s, b in zip(opened(x).s, opened(x).b, strict=True)], pa.string())


def maybe_transliterate(x: pa.Array) -> pa.Array:
    t = opened(x)
    return pa.array([None if s is None else maybe_text(s, b, y, n) for s, b, y, n in zip(t.s, t.b, t.latin(), t.cyrillic(), strict=True)], pa.string())


def transliterate_mixed(x: pa.Array) -> pa.Array:
    t = opened(x)
    return pa.array([None if s is None else mixed_text(s, b, y, n) for s, b, y, n in zip(t.s, t.b, t.latin(), t.cyrillic(), strict=True)], pa.string())


def detect_script(x: pa.Array) -> pa.Array:
    t = opened(x)
    return pa.array(["cyrillic" if s and n / len(s) > 0.3 else "latin" for s, n in zip(t.s, t.cyrillic(), strict=True)], pa.string())


class Parts:
    """The characters of all texts of a batch one after the other (``flat``), which of them belong to words and which to other tokens."""

    def __init__(self, bs: list):
        self.flat = np.frombuffer(b"\0".join([b or b"" for b in bs]) + b"\0", np.uint8)
        self.ends = np.cumsum([len(b or b"") + 1 for b in bs])
        parts = np.frombuffer(self.flat.tobytes().translate(PARTS8), np.uint8).copy()
        parts[self.ends - 1] = 0  # between two texts
        at = np.arange(len(parts), dtype=np.int32)
        letter = np.maximum.accumulate(np.where(parts == 1, at, -1))
        other = np.maximum.accumulate(np.where((parts == 0) | (parts > 3), at, -1))
        self.word = letter > other  # from the first letter of a run on
        self.space = parts == 4
        self.alone = (parts == 5) | ((parts == 3) & ~self.word)

    def cut(self, kept: np.ndarray, starts: np.ndarray, nulls: list) -> pa.Array:
        """The pieces of each text: the kept characters, a piece from each start on."""
        chars = self.flat[kept]
        at = np.concatenate([[0], np.cumsum(WIDTHS[chars])]).astype(np.int32)  # places of the characters among UTF-8 bytes
        offsets = np.append(at[:-1][starts[kept]], at[-1])
        ends = np.concatenate([[0], np.cumsum(starts)[self.ends - 1]]).astype(np.int32)
        values = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(decoded(chars.tobytes()).encode()))
        return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(nulls, pa.bool_()))


def first(x: np.ndarray) -> np.ndarray:
    """Where a run begins."""
    return x & ~np.concatenate([[False], x[:-1]])


def found(x: pa.Array, pattern: re.Pattern, words: bool) -> pa.Array:
    """The words of each text, or all its tokens; ``pattern`` is for texts with characters outside ``CHARSET``."""
    t = opened(x)
    nulls = [s is None for s in t.s]
    if not t.s or any(b is None and not null for b, null in zip(t.b, nulls, strict=True)):
        return pa.array([None if s is None else pattern.findall(s) for s in t.s], pa.list_(pa.string()))
    p = t.kept["parts"] = t.kept.get("parts") or Parts(t.b)
    if words:
        return p.cut(p.word, first(p.word), nulls)
    return p.cut(p.word | p.space | p.alone, first(p.word) | first(p.space) | p.alone, nulls)


def tokenize(x: pa.Array) -> pa.Array:
    return found(x, TOKENS, False)


def word_tokens(x: pa.Array) -> pa.Array:
    return found(x, LATIN_WORDS, True)


def plain(s: str, b: bytes | None) -> str:
    """Without wiki markup; texts without a sign of markup are passed by."""
    b = s.encode() if b is None else b
    if any(sign in b for sign in (b"<", b"{", b"[", b"''", b"==")) or b"http" in b.lower():
        for pattern, by in WIKI:
            s = pattern.sub(by, s)
    return s


def wiki_text(x: pa.Array) -> pa.Array:
    return pa.array(opened(x).each("plain", plain), pa.string())


def clean(s: str, b: bytes | None, most: int = 9_500, least: int = 3) -> str | None:
    bare = s.strip()
    if len(bare) < least:
        return None
    if b is None or len(b.translate(None, CONTROLS)) < len(b):
        bare = CONTROL.sub("", s).strip()
    return bare[:most]


def sanitise(x: pa.Array) -> pa.Array:
    return pa.array(opened(x).each("clean", clean), pa.string())


FUNCTIONS = {
    "uz_transliterate": (transliterate, "string"),
    "uz_latin_to_cyrillic": (latin_to_cyrillic, "string"),
    "uz_maybe_transliterate": (maybe_transliterate, "string"),
    "uz_transliterate_mixed": (transliterate_mixed, "string"),
    "uz_detect_script": (detect_script, "string"),
    "uz_tokenize": (tokenize, "array<string>"),
    "uz_word_tokens": (word_tokens, "array<string>"),
    "uz_wiki_text": (wiki_text, "string"),
    "uz_sanitise": (sanitise, "string"),
}


def register(spark: SparkSession) -> list[str]:
    """The functions of whole texts as temporary SQL functions; returns their names. Lowers the rows of an Arrow batch from Spark's default."""
    if spark.conf.get(_BATCH_KEY, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))
    for name, (make, kind) in FUNCTIONS.items():
        spark.udf.register(name, F.arrow_udf(make, kind))
    return list(FUNCTIONS)
