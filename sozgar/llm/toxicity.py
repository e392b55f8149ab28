"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features: density of a lexicon (seed words, and words and stems learned from the labelled sample),
second-person words near lexicon words, capitals, punctuation, and disguised words (digits and marks for
letters, or letters parted by marks, looked for with and without the punctuation around the word). What
the lexicon learns must stand in several different contexts, so copies of one document teach nothing.

Defined results: null and empty texts have all-zero features and are scored like any text; very long
texts are scored whole; without usable labels every score is the prior; a text's features, and so its score,
do not depend on the texts that share a batch with it, so repeated rows get equal scores; an empty table gives an empty result; extra columns are ignored by the query and carried by ``score``.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sozgar.llm.common import bound_batches, boxed, column, held_out, slices, text_bytes, unboxed
from sozgar.llm.learning import FOLDS, BoostedTrees, Isotonic, Runner, folds, here, in_tasks, labelled_sample, sigmoid
from sozgar.llm.words import BLANK, CHUNK, LETTER, LOWER, RunHasher, hash_runs, hash_word, lay, runs

# Common English insults and second-person words of the corpus languages.
SEEDS = "clown disgusting dumb dumbass filth filthy freak garbage hate idiot idiotic idiots imbecile jerk kill loser losers lowlife moron moronic morons pathetic pig retard scum scumbag shit stupid trash ugly useless vermin worthless".split()
SECOND = "you your yours yourself yourselves ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes tus vosotros contigo".split()
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
CLASSES = ("upper", "lower", "other_letter", "digit", "bang", "ask", "mark", "pipe", "stop", "line", "blank", "rest")
NEAR = 6

CLASS = np.full(256, 11, np.uint8)
CLASS[0x41:0x5B], CLASS[0x61:0x7B], CLASS[0x80:], CLASS[0x30:0x3A] = 0, 1, 2, 3
for _k, _marks in ((4, b"!"), (5, b"?"), (6, b"#$%&*@^~_"), (7, b"|"), (8, b".,;:"), (9, b"\n"), (10, b" \t\r\v\f")):
    CLASS[list(_marks)] = _k
UNMASK = LOWER.copy()
for _a, _b in DISGUISE.items():
    UNMASK[ord(_a)] = ord(_b)
#: What outer punctuation is not: letters, digits and marks that stand for a letter at the ends of words.
INNER = LETTER.copy()
INNER[list(b"0123456789@$+")] = True


class Lexicon:
    """Hashes and weights of words and stems, and hashes of the words with one letter left out (for starred letters)."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.keys, self.weights = self._table(words)
        self.stem_keys, self.stem_weights = self._table(stems)
        self.stem_sizes = sorted({len(x.encode()) for x in stems})
        self.second = np.sort(np.array([hash_word(w) for w in SECOND], np.uint64))
        holes = {w[:i] + w[i + 1 :] for w in words if len(w) >= 5 for i in range(1, len(w) - 1)} - set(words)
        self.holes = np.sort(np.array([hash_word(w) for w in holes], np.uint64))

    @staticmethod
    def _table(weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        pairs = sorted((hash_word(w), v) for w, v in weights.items())
        return np.array([k for k, _ in pairs], np.uint64), np.array([v for _, v in pairs], np.float64)

    @staticmethod
    def _find(hashes: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, weights[at], 0.0)

    def weight(self, hashes: np.ndarray) -> np.ndarray:
        return self._find(hashes, self.keys, self.weights)

    def stem_weight(self, hasher: RunHasher, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The largest weight of a stem with which each word begins."""
        found = np.zeros(len(starts))
        for size in self.stem_sizes:
            long = np.flatnonzero(ends - starts > size)
            found[long] = np.maximum(found[long], self._find(hasher(starts[long], starts[long] + size), self.stem_keys, self.stem_weights))
        return found


def member(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(hashes), bool)
    return keys[np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)] == hashes


def spans_in(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the runs one after another, and the run of each."""
    lengths = ends - starts
    owner = np.repeat(np.arange(len(starts)), lengths)
    return buffer[np.arange(len(owner)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)], owner


def without_outer(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs without punctuation at their ends; each has a letter."""
    inner = np.flatnonzero(INNER[buffer])
    return inner[np.searchsorted(inner, starts)], inner[np.searchsorted(inner, ends) - 1] + 1


def unmasked(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run: the hash of its letters with the disguise undone, whether it has a star, whether undoing made letters."""
    n = len(starts)
    raw, owner = spans_in(buffer, starts, ends)
    plain = UNMASK[raw]
    letter = LETTER[plain]
    sizes = np.bincount(owner[letter], minlength=n)
    last = np.cumsum(sizes)
    starred = np.bincount(owner[(raw == 0x2A) | (raw == 0x23)], minlength=n) > 0
    return hash_runs(plain[letter], last - sizes, last), starred, sizes != np.bincount(owner[LETTER[raw]], minlength=n)


def features(texts: list[bytes], lexicon: Lexicon) -> np.ndarray:
    """One row of dense features per text."""
    n = len(texts)
    buffer, at = lay(texts)
    lengths = np.diff(at)
    doc = np.repeat(np.arange(n), lengths)
    counts = np.bincount(doc * len(CLASSES) + CLASS[buffer], minlength=n * len(CLASSES)).reshape(n, -1).astype(float)
    counts[:, 9] -= 1  # the line feed laid after the text
    lower = LOWER[buffer]
    starts, ends = runs(LETTER[buffer])
    hasher = RunHasher(lower)
    hashes, owner = hasher(starts, ends), doc[starts] if len(starts) else np.zeros(0, int)
    words = np.maximum(np.bincount(owner, minlength=n), 1).astype(float)
    per = lambda w, who=owner: np.bincount(who, w, n)
    stem = lexicon.stem_weight(hasher, starts, ends)
    weight = np.maximum(lexicon.weight(hashes), stem)
    hit = weight > 0
    second = member(hashes, lexicon.second)
    near = np.zeros(len(hashes))
    places = np.flatnonzero(second)
    if len(places) and hit.any():
        mine = np.flatnonzero(hit)
        k = np.searchsorted(places, mine)
        for side in (np.maximum(k - 1, 0), np.minimum(k, len(places) - 1)):
            near[mine] = np.maximum(near[mine], (np.abs(places[side] - mine) <= NEAR) & (owner[places[side]] == owner[mine]))
    top = np.zeros(n)
    np.maximum.at(top, owner[hit], weight[hit])
    loud = np.zeros(len(buffer) + 1)
    np.cumsum(CLASS[buffer] == 0, out=loud[1:])
    capital = (loud[ends] - loud[starts] == ends - starts) & (ends - starts >= 3)
    again = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]) if len(hashes) else np.zeros(0, bool)
    # Disguised words: runs of non-blanks that mix letters with digits or marks.
    t_starts, t_ends = runs(~BLANK[buffer])
    odd = np.zeros(len(buffer) + 1)
    np.cumsum(np.isin(CLASS[buffer], (3, 4, 6, 7)) | (buffer == 0x2E) | (buffer == 0x2D), out=odd[1:])
    letters = np.zeros(len(buffer) + 1)
    np.cumsum(LETTER[buffer], out=letters[1:])
    n_odd, n_letters = odd[t_ends] - odd[t_starts], letters[t_ends] - letters[t_starts]
    mixed = np.flatnonzero((n_odd > 0) & (n_letters > 0))
    disguised = np.zeros(n)
    if len(mixed):
        whole, starred, grown = unmasked(buffer, t_starts[mixed], t_ends[mixed])
        bare, bare_starred, bare_grown = unmasked(buffer, *without_outer(buffer, t_starts[mixed], t_ends[mixed]))
        found = (lexicon.weight(whole) > 0) & (grown | starred) | member(whole, lexicon.holes) & starred
        found |= (lexicon.weight(bare) > 0) & (bare_grown | bare_starred) | member(bare, lexicon.holes) & bare_starred
        disguised = np.bincount(doc[t_starts[mixed]], found, n)
    size = np.maximum(lengths - 1, 1).astype(float)
    hits = per(hit)
    tokens_per = np.maximum(np.bincount(doc[t_starts], minlength=n) if len(t_starts) else np.zeros(n), 1)
    columns = [
        np.log1p(words), hits / words, np.log1p(hits), per(weight) / words, top, per(near) / np.maximum(hits, 1), per(near) / words, per(second) / words,
        disguised / words, np.log1p(disguised), np.log1p(per(stem > 0)), (hits + disguised > 0).astype(float), counts[:, 0] / size, per(capital) / words, counts[:, 4] / size, counts[:, 5] / size, counts[:, 6] / size, counts[:, 7] / size,
        counts[:, 3] / size, counts[:, 8] / size, counts[:, 2] / size, np.bincount(owner[1:], again, n) / words if len(owner) else np.zeros(n), size / words,
        np.bincount(doc[t_starts], (n_odd > 0) & (n_letters > 0), n) / tokens_per if len(t_starts) else np.zeros(n), counts[:, 9] / words,
    ]
    return np.stack(columns, axis=1)


def chunked_features(texts: list[bytes], lexicon: Lexicon) -> np.ndarray:
    rows, some, held = [], [], 0
    for t in texts:
        some.append(t)
        held += len(t)
        if held >= CHUNK:
            rows.append(features(some, lexicon))
            some, held = [], 0
    if some:
        rows.append(features(some, lexicon))
    return np.concatenate(rows) if rows else np.zeros((0, 25))


def letter_words(text: bytes) -> list[bytes]:
    return bytes(np.where(LETTER[a := np.frombuffer(text, np.uint8)], LOWER[a], 32).astype(np.uint8)).split() if text else []


def learn_lexicon(texts: list[bytes], toxic: np.ndarray, contexts: int = 4, odds: float = 2.5, stem_odds: float = 2.0) -> Lexicon:
    """Seed words, learned words and learned stems with their log odds of standing in toxic texts.

    A learned word or stem stands between ``contexts`` or more different pairs of neighbours in toxic texts; a
    stem has 3 letters and 4 bytes or more, begins several different words, and no part of it is a stem.
    """
    stems_of = lambda w: {w[:k] for k in range(3, min(len(w), 9)) if len(w[:k].encode()) >= 4}
    around: dict[str, set] = {}
    begun: dict[str, set] = {}
    there, stem_there = Counter(), Counter()
    for t in (t for t, label in zip(texts, toxic, strict=True) if label):
        words = [w.decode(errors="ignore") for w in letter_words(t)]
        there.update(set(words))
        stem_there.update({x for w in set(words) for x in stems_of(w)})
        for a, w, b in zip(["", *words], words, [*words[1:], ""], strict=False):
            around.setdefault(w, set()).add((a, b))
    for w in there:
        for x in stems_of(w):
            if stem_there[x] >= contexts:
                begun.setdefault(x, set()).add(w)
    n_toxic, n_other = max(toxic.sum(), 1), max(len(toxic) - toxic.sum(), 1)
    least = max(contexts, 0.005 * n_toxic)
    varied = lambda pairs: len(pairs) >= least and len({a for a, _ in pairs}) >= 3 and len({b for _, b in pairs}) >= 3
    words = {w for w, pairs in around.items() if len(w) >= 3 and varied(pairs)} | set(SEEDS)
    stems = {x for x, found in begun.items() if len(found) >= 4 and stem_there[x] >= least and len(set().union(*(around[w] for w in found))) >= 2 * least}
    elsewhere, stem_elsewhere = Counter(), Counter()
    for t in (t for t, label in zip(texts, toxic, strict=True) if not label):
        distinct = {w.decode(errors="ignore") for w in set(letter_words(t))}
        elsewhere.update(distinct & words)
        stem_elsewhere.update({w[:k] for w in distinct for k in range(3, min(len(w), 9))} & stems)
    score = lambda w, a, b: float(np.log((a[w] + 0.5) / (n_toxic + 1)) - np.log((b[w] + 0.5) / (n_other + 1)))
    found = {w: max(s, 1.0) for w in words if (s := score(w, there, elsewhere)) >= odds or w in SEEDS}
    kept: dict[str, float] = {}
    for x in sorted(stems, key=lambda x: (len(x), x)):
        if not any(x.startswith(y) for y in kept) and (s := score(x, stem_there, stem_elsewhere)) >= stem_odds:
            kept[x] = s
    return Lexicon(found, kept)


def _fit(texts: list[bytes], toxic: np.ndarray) -> tuple[Lexicon, BoostedTrees]:
    lexicon = learn_lexicon(texts, toxic)
    return lexicon, BoostedTrees().fit(chunked_features(texts, lexicon), toxic)


def _fold(k: int, sample: tuple[list[bytes], np.ndarray]) -> tuple[dict, dict, dict] | np.ndarray:
    """Margins of the texts of fold k by a model of the others; beyond the folds, the model of all."""
    texts, toxic = sample
    if k == FOLDS:
        lexicon, trees = _fit(texts, toxic)
        return lexicon.words, lexicon.stems, vars(trees)  # plain values: workers need not have the package on their path
    inside = folds(len(texts)) != k
    if not inside.any() or inside.all():
        return np.zeros((~inside).sum())
    lexicon, trees = _fit([t for t, i in zip(texts, inside, strict=True) if i], toxic[inside])
    return trees.margin(chunked_features([t for t, i in zip(texts, inside, strict=True) if not i], lexicon))


class ToxicityModel:
    def fit(self, texts: list[bytes], toxic: np.ndarray, runner: Runner = here) -> ToxicityModel:
        *margins, (words, stems, trees) = runner(_fold, (texts, toxic), FOLDS + 1)
        self.lexicon, self.trees = Lexicon(words, stems), BoostedTrees()
        vars(self.trees).update(trees)
        part, margin = folds(len(texts)), np.zeros(len(texts))
        for k in range(FOLDS):  # the calibration sees only margins of texts that neither lexicon nor trees have seen
            margin[part == k] = margins[k]
        self.calibration = Isotonic().fit(margin, toxic, prior=float(toxic.mean()) if len(toxic) else 0.0)
        return self

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Calibrated scores; a thousandth of the raw score parts equal calibrated values."""
        margin = self.trees.margin(chunked_features(texts, self.lexicon))
        return np.clip(0.999 * self.calibration(margin) + 0.001 * sigmoid(margin), 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return ToxicityModel().fit(*labelled_sample(docs, labels, "toxic"), in_tasks(docs.sparkSession))


def score(df: DataFrame, model, text: str = "text", output: str = "score") -> DataFrame:
    """Adds the model's score of every whole text."""
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    carried = df.select(*(column(c) for c in df.columns if c != output))
    schema = T.StructType([T.StructField("row", carried.schema), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in slices(batches, "text"):
            values = shared.value(text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(values, pa.float64())], ["row", "score"])

    scored = df.select(boxed(carried), column(text).alias("text")).mapInArrow(run, schema)
    return scored.select(*unboxed(carried, carried.columns), F.col("score").alias(output))


THRESHOLD = 0.3


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
