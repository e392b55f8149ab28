"""Disguised words count alike in small and in large chunks."""

import random

import numpy as np

from sozgar.llm.toxicity import Lexicon, ToxicityModel, features
from tests.llm.test_units import text_of

LEXICON = Lexicon({"idiot": 2.0, "moron": 2.0, "loser": 2.0, "shit": 2.0}, {})
DISGUISED = ["id1ot,", "m0ron.", "(l0ser)", "$hit", "($hit)", "id1ot!", "m0r0n!!", '"l0s3r"', "id*ot", "*idiot*", "idi*t?", "1di0t", "id1o+", "!d1ot"]
CLEAN = ["idiot,", "Idiot.", "(loser)", "loser!", "well-known", "end.", "a1b2", "3.14x"]


def crowd(n: int) -> bytes:
    return " ".join(f"word{k}x. it's" for k in range(n)).encode()


def test_disguised_words_count_at_every_size():
    for text, many in [(w, 1) for w in DISGUISED] + [(w, 0) for w in CLEAN]:
        alone = features([text.encode()], LEXICON)[0]
        assert round(np.expm1(alone[9])) == many, text
        assert (features([crowd(3000), text.encode(), crowd(3000)], LEXICON)[1] == alone).all(), text
    assert round(np.expm1(features([crowd(3000) + b" " + " ".join(DISGUISED).encode()], LEXICON)[0, 9])) == len(DISGUISED)


def test_a_text_scores_alike_alone_and_in_a_crowd():
    r = random.Random(3)
    rows = [(text_of(r, False, k % 5 == 0), float(k % 5 == 0)) for k in range(200)]
    model = ToxicityModel().fit([x[0] for x in rows], np.array([x[1] for x in rows]))
    texts = [x[0] + b" (id1ot), m0ron." for x in rows[:20]]
    together = model([crowd(3000), *texts, crowd(3000)])[1:-1]
    assert np.allclose(together, [model([t])[0] for t in texts], atol=1e-9, rtol=0)
