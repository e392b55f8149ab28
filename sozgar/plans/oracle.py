"""DuckDB text of the operators, assembled from the same fixed values."""

from __future__ import annotations

from sozgar.functions.alphabet import CYRILLIC_TO_LATIN, DIGRAPHS_BACK, PARTNER, SHORT_WORDS, SINGLES_BACK, SUFFIXES, VOWELS
from sozgar.functions.alphabet import ENGLISH_NOISE as NOISE

W = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = "[a-zA-Z][a-zA-Z''ʻʼ]*"
CORPUS = "[a-zA-ZʻʼoOgG'']"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(items: list[str]) -> str:
    return "(" + ", ".join(map(text, items)) + ")"


def transliterated(t: str) -> str:
    for letter, spelling in (("Е", "Ye"), ("е", "ye")):
        for _ in range(2):  # neighbours share the character between them
            t = f"regexp_replace({t}, '(^|[^{W}]){letter}', '\\1{spelling}', 'g')"
    for letter, spelling in CYRILLIC_TO_LATIN.items():
        if len(spelling) == 2:
            t = f"replace({t}, '{letter}', '{spelling}')"
    single = {k: v for k, v in CYRILLIC_TO_LATIN.items() if len(v) == 1}
    dropped = "".join(k for k, v in CYRILLIC_TO_LATIN.items() if not v)
    return f"translate({t}, {text(''.join(single) + dropped)}, {text(''.join(single.values()))})"


def cyrillic(t: str) -> str:
    for spelling, letter in DIGRAPHS_BACK:
        t = f"replace({t}, '{spelling}', '{letter}')"
    return f"translate({t}, {text(''.join(SINGLES_BACK))}, {text(''.join(SINGLES_BACK.values()))})"


def cyrillic_share(t: str) -> str:
    return f"length(regexp_replace({t}, '[^Ѐ-ӿ]', '', 'g')) / greatest(length({t}), 1)::DOUBLE"


def mixed(t: str) -> str:
    return f"coalesce(array_to_string(list_transform(regexp_extract_all({t}, '[{W}]+|[^{W}]+'), lambda x: CASE WHEN {cyrillic_share('x')} > 0.3 THEN {transliterated('x')} ELSE x END), ''), '')"


def maybe(t: str) -> str:
    n = f"length(regexp_replace({t}, '[^{W}]', '', 'g'))"
    return f"CASE WHEN {n} > 0 AND length(regexp_replace({t}, '[^Ѐ-ӿ]', '', 'g')) / greatest({n}, 1)::DOUBLE > 0.1 THEN {transliterated(t)} ELSE {t} END"


def strippable(stem: str, suffix: str) -> str:
    return f"(length({stem}) >= 3 AND {suffix} IN {words(SUFFIXES)} AND NOT ({suffix} = 'i' AND right({stem}, 1) IN {words(list(VOWELS))}))"


def stripped(w: str) -> str:
    cases = " ".join(f"WHEN length({w}) > {k} AND {strippable(f'left({w}, length({w}) - {k})', f'right({w}, {k})')} THEN left({w}, length({w}) - {k})" for k in range(12, 0, -1))
    return f"(CASE {cases} ELSE {w} END)"


def flag(w: str) -> str:
    return (
        f"CASE WHEN length({w}) = 1 THEN 'single character' WHEN length({w}) = 2 AND {w} NOT IN {words(SHORT_WORDS)} THEN '2-char word not on allowlist' "
        f"WHEN NOT regexp_matches({w}, '^[a-zA-ZʻʼoOgG'']+$') THEN 'contains non-Uzbek-Latin characters' WHEN {w} IN {words(NOISE)} THEN 'common English word' "
        f"WHEN {w} LIKE '%''s' OR {w} LIKE '%''t' THEN 'English possessive/contraction' WHEN length({w}) >= 5 AND NOT regexp_matches({w}, '[{VOWELS}]') THEN 'zero vowels (likely garbage)' END"
    )


def tenths(a: str, b: str) -> str:
    gap = lambda c: f"CASE WHEN {c} IN ('''', 'ʻ', 'ʼ') THEN 3 ELSE 10 END"
    pairs = ", ".join(text(x + y) for x, y in PARTNER.items())
    swap = f"CASE WHEN x = b_[j] OR (x IN ('''', 'ʻ', 'ʼ') AND b_[j] IN ('''', 'ʻ', 'ʼ')) THEN 0 WHEN x || b_[j] IN ({pairs}) THEN 5 ELSE 10 END"
    first = f"list_reduce(range(1, len(b_) + 1), lambda row, j: list_append(row, row[-1] + {gap('b_[j]')}), [0::BIGINT])"
    row = f"list_reduce(range(1, len(b_) + 1), lambda now, j: list_append(now, least(before[j + 1] + {gap('x')}, now[-1] + {gap('b_[j]')}, before[j] + {swap})), [(before[1] + {gap('x')})::BIGINT])"
    row = row.replace("x = b_", "a_[i] = b_").replace("x IN", "a_[i] IN").replace("x || b_", "a_[i] || b_")
    last = f"list_reduce(range(1, len(a_) + 1), lambda before, i: {row}, {first})"
    chars = lambda c: f"list_filter(string_split({c}, ''), lambda z: z <> '')"
    return f"(SELECT CASE WHEN len(a_) > 0 AND list_min(l_) > 20 THEN 30 ELSE l_[-1] END FROM (SELECT a_, {last} AS l_ FROM (SELECT {chars(a)} AS a_, {chars(b)} AS b_)))"


COUNTED = f"SELECT unnest(regexp_extract_all(lower(text), '{CORPUS}{{2,}}')) AS word FROM "


def counted(source: str, least: int = 1) -> str:
    return f"SELECT word, count(*)::BIGINT AS freq FROM ({COUNTED}{source}) GROUP BY word HAVING count(*) >= {least}"


DICT = f"dict AS MATERIALIZED (SELECT translate(word, 'ʻʼ', '''''') AS word, sum(freq)::BIGINT AS freq FROM ({counted('documents', 3)}) GROUP BY 1)"


def ways(source: str, column: str) -> str:
    return (
        f"SELECT {column}, left({column}, length({column}) - k) AS stem, right({column}, k) AS suffix, k FROM {source}, range(1, 13) AS _k(k) "
        f"WHERE length({column}) - k >= 3 AND {strippable(f'left({column}, length({column}) - k)', f'right({column}, k)')}"
    )


def stems(source: str, column: str, vocabulary: str = "dict") -> str:
    return f"SELECT s.{column} AS {column}, arg_max(stem, k) AS stem, arg_max(v.freq, k) AS stem_freq FROM ({ways(source, column)}) s JOIN {vocabulary} v ON v.word = s.stem GROUP BY s.{column}"


CLASS = "translate(left({}, 1), 'xyupt', 'hiobd')"


def checked(tokens: str) -> str:
    """CTEs: dict, toks (w), kinds (w, match_kind), unknown (w)."""
    return f"""{DICT},
toks AS MATERIALIZED (SELECT DISTINCT translate(lower(word), 'ʻʼ', '''''') AS w FROM ({tokens})),
found AS (SELECT w, d.word IS NOT NULL AS direct FROM toks LEFT JOIN (SELECT word FROM dict WHERE freq >= 5) d ON d.word = w),
stem AS ({stems("(SELECT w FROM found WHERE NOT direct)", "w")}),
kinds AS MATERIALIZED (SELECT f.w, CASE WHEN direct THEN 'DIRECT' WHEN s.w IS NOT NULL THEN 'STEM' ELSE '' END AS match_kind FROM found f LEFT JOIN (SELECT w FROM stem WHERE stem_freq >= 100) s ON s.w = f.w),
unknown AS MATERIALIZED (SELECT w FROM kinds WHERE match_kind = '' AND w <> '')"""


def suggested(tokens: str, top_n: int = 3) -> str:
    """CTEs as ``checked``, and ranked (w, candidate, freq, path, tenths, rank), answers (w, match_kind, suggestions)."""
    a, b = CLASS.format("u.w"), CLASS.format("d.word")
    suffix_list = "unnest([" + ", ".join(text(s) for s in SUFFIXES) + "])"
    return f"""{checked(tokens)},
whole AS MATERIALIZED (SELECT u.w, d.word AS candidate, d.freq, 1 AS path FROM unknown u JOIN dict d ON {a} = {b} AND length(d.word) BETWEEN length(u.w) - 2 AND length(u.w) + 2 WHERE levenshtein(u.w, d.word) <= 2),
suffix AS (SELECT s, length(s) AS size FROM (SELECT {suffix_list} AS s)),
parts AS (SELECT DISTINCT w, left(w, length(w) - size) AS part, size FROM unknown, suffix WHERE length(w) >= size + 3),
near AS (SELECT p.part, d.word AS root FROM (SELECT DISTINCT part FROM parts) p JOIN (SELECT word FROM dict WHERE freq >= 100) d ON {CLASS.format("p.part")} = {b} AND abs(length(d.word) - length(p.part)) <= 1 WHERE levenshtein(p.part, d.word) <= 1),
fresh AS MATERIALIZED (SELECT DISTINCT w, root || s AS candidate FROM parts JOIN near USING (part) JOIN suffix USING (size) WHERE levenshtein(w, root || s) <= 2 AND root || s NOT IN (SELECT word FROM dict)),
rooted AS ({stems("(SELECT DISTINCT candidate FROM fresh)", "candidate")}),
rebuilt AS (SELECT w, candidate, coalesce(stem_freq, 1)::BIGINT AS freq, 2 AS path FROM fresh LEFT JOIN rooted USING (candidate)),
measured AS MATERIALIZED (SELECT *, {tenths("w", "candidate")}::INTEGER AS tenths FROM (FROM whole UNION ALL FROM rebuilt)),
ranked AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY tenths, freq DESC, path, candidate)::INTEGER AS rank FROM measured WHERE tenths <= 20) WHERE rank <= {top_n}),
answers AS MATERIALIZED (SELECT k.w, match_kind, CASE WHEN match_kind <> '' THEN [k.w] ELSE coalesce(l, []) END AS suggestions FROM kinds k LEFT JOIN (SELECT w, list(candidate ORDER BY rank) AS l FROM ranked GROUP BY w) r ON r.w = k.w)"""


TOKENS = f"SELECT unnest(regexp_extract_all(text, '{WORD}')) AS word FROM "


def spans(source: str, keys: str, t: str = "text") -> str:
    """(keys, word, start, end) of every word of a table."""
    return f"""SELECT {keys}, word, (start_ - length(word))::INTEGER AS "start", start_::INTEGER AS "end" FROM (
SELECT {keys}, word, sum(length(word)) OVER (PARTITION BY {keys} ORDER BY at_) AS start_ FROM (
SELECT {keys}, unnest(p) AS word, generate_subscripts(p, 1) AS at_ FROM (SELECT {keys}, regexp_extract_all({t}, '{WORD}|[^a-zA-Z]+') AS p FROM {source}))) WHERE regexp_matches(word, '^[a-zA-Z]')"""
