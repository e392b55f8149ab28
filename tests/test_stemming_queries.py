"""Stemming queries over every dictionary word, against brute force."""

import pytest

from sozgar.functions.alphabet import LONGEST_SUFFIX, MIN_STEM, SUFFIXES, VOWELS
from sozgar.plans.catalogue import QUERIES

WORDS = [f"{a}{b}{c}{d}" for a in "bkm" for b in "aiou" for c in ("l", "zd", "ram") for d in ("", "a", "i", "on", "ut", "im", "iz", "ar", "la", "or", "eb")]


def ways(word: str) -> list[str]:
    """All stems that a suffix leaves, that of the longest suffix first."""
    cuts = [(word[:-n], word[-n:]) for n in range(min(LONGEST_SUFFIX, len(word) - 1), 0, -1)]
    return [a for a, b in cuts if len(a) >= MIN_STEM and b in SUFFIXES and not (b == "i" and a[-1] in VOWELS)]


def chain(word: str) -> str:
    found = []
    for _ in range(3):
        if not ways(word):
            break
        word = ways(word)[0]
        found.append(word)
    return " | ".join(found)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stemming"))
    spark.createDataFrame([(k, " ".join(WORDS)) for k in range(3)], "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def test_every_dictionary_word_gets_its_stems(spark, folder):
    assert len(set(WORDS)) == len(WORDS) > 300
    words = {w + s for w in WORDS for s in ["", *SUFFIXES]}
    known = set(WORDS)
    run = lambda name: QUERIES[name](spark, folder).collect()
    assert {r.word: r.stem for r in run("strip_suffix_free")} == {w: (ways(w) or [w])[0] for w in words}
    assert {(r.word, r.stem, r.stem_freq) for r in run("strip_suffix_vocabulary")} == {(w, next(s for s in ways(w) if s in known), 3) for w in words if known & set(ways(w))}
    assert {r.word: r.stems for r in run("iterative_strip")} == {w: chain(w) for w in words}
