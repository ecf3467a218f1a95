"""Language identification: a linear-chain conditional random field over words.

Words are the runs of letters of a text, lower-cased. A word's emission score for each
language is the sum of the weights of its features: prefixes and suffixes of 1 to 3
letters, letter 2- and 3-grams with word ends, the word itself, and the lexicons it is in
(for each language, words that are common in its training text). Neighbouring words are
tied by learned transition weights. Forward-backward gives each word's distribution over
languages, so a code-switched text is labelled word by word; a document's language is the
one with the largest sum of marginals, and that sum per word is its score.

Training: lines of labelled documents, at most ``TRAIN_LINES`` for each language (a
documented bound; drawn by a hash of document and line, so any of them may be and reruns
agree), of ``TRAIN_WORDS`` words in the middle of longer ones. A line's words have its
document's language; a third of the sequences splice pieces of two lines, so that
transitions between languages are seen. All languages of the labels are learned; the model
takes ``SLOTS`` numbers (0.5 MB) for each, and is sent to the executors with the function.

A text is cut into sequences of ``SEQUENCE`` words, all of them labelled; only ties across
those cuts are lost.

Defined results: a text that is null or has no letter is ``und`` with score 0; repeated
rows are predicted alike; without labelled rows every text is ``und``; an empty table
gives no rows. Language, source and id are no inputs of a prediction.
"""

import zlib
from itertools import chain

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, release, table, trim_driver

TRAIN_LINES, TRAIN_WORDS, EPOCHS, BATCH, RATE, L2 = 1500, 60, 4, 32, 0.2, 1e-6
SLOTS, SEQUENCE, CACHE_WORDS, CACHE_NAMES, LEXICON, FOLD_SEED = 1 << 17, 64, 150_000, 50_000, 300, 17
UNKNOWN = "und"
_letters = regex.compile(r"\p{L}+").findall


class _Slots(dict):
    """Slots of names that begin with one letter, by the rest of the name; at most ``CACHE_NAMES`` are kept."""

    def __init__(self, letter: str):
        self.letter = letter

    def __missing__(self, rest: str) -> int:
        if len(self) >= CACHE_NAMES:
            self.clear()
        self[rest] = found = zlib.crc32(f"{self.letter}{rest}".encode()) % SLOTS
        return found


_lexicon_slots, _prefix_slots, _suffix_slots, _gram_slots = map(_Slots, "xpsg")


def features(word: str, lexicons: dict[str, int]) -> list[int]:
    """Slots of a word's features."""
    marked, n = f"^{word}$", len(word)
    out = [zlib.crc32(f"w{word}".encode()) % SLOTS, _lexicon_slots[str(lexicons.get(word, 0))]]
    out += [_prefix_slots[word[:k]] for k in (1, 2, 3) if n >= k]
    out += [_suffix_slots[word[-k:]] for k in (1, 2, 3) if n >= k]
    out += [_gram_slots[marked[i : i + 2]] for i in range(n + 1)]
    out += [_gram_slots[marked[i : i + 3]] for i in range(n)]
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray, pairs: bool = False):
    """Marginals (sequences, words, languages) of padded sequences; with pairs, also expected transitions, summed."""
    n, steps, k = scores.shape
    top = scores.max(2, keepdims=True)
    e, t = np.exp(scores - top), np.exp(transition - transition.max())
    alive = np.arange(steps) < lengths[:, None]
    a, b = np.empty_like(e), np.ones_like(e)
    a[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for i in range(1, steps):
        x = (a[:, i - 1] @ t) * e[:, i]
        a[:, i] = x / x.sum(1, keepdims=True)
    for i in range(steps - 2, -1, -1):
        x = (b[:, i + 1] * e[:, i + 1]) @ t.T
        x /= x.sum(1, keepdims=True)
        b[:, i] = np.where(alive[:, i + 1, None], x, 1.0)
    m = a * b
    m /= m.sum(2, keepdims=True)
    m *= alive[..., None]
    if not pairs:
        return m
    total = np.zeros((k, k))
    for i in range(steps - 1):
        x = a[:, i, :, None] * t * (b[:, i + 1] * e[:, i + 1])[:, None, :]
        x /= x.sum((1, 2), keepdims=True)
        total += x[alive[:, i + 1]].sum(0)
    return m, total


class Model:
    """Emission weights by feature slot, transition weights, and the languages they are for."""

    def __init__(self, languages: list[str], weights: np.ndarray, transition: np.ndarray, lexicons: dict[str, int]):
        self.languages, self.weights, self.transition, self.lexicons = languages, weights, transition, lexicons
        self._reset()

    def _reset(self):
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.languages)), np.float32)

    def __getstate__(self):
        return self.languages, self.weights, self.transition, self.lexicons

    def __setstate__(self, state):
        self.__init__(*state)

    def emissions(self, words: list[str]) -> np.ndarray:
        """(words, languages) scores; each distinct word is scored once."""
        new = set(words).difference(self.place)
        if len(self.place) + len(new) > CACHE_WORDS and self.place:
            self._reset()
            new = set(words)
        if new:
            at, need = len(self.place), len(self.place) + len(new)
            if need > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(need, 2 * len(self.table)) - len(self.table), self.table.shape[1]), np.float32)])
            slots = [features(w, self.lexicons) for w in new]
            sizes = np.fromiter(map(len, slots), np.int64, len(slots))
            flat = np.fromiter(chain.from_iterable(slots), np.int64, int(sizes.sum()))
            self.table[at:need] = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0)
            self.place.update(zip(new, range(at, need), strict=True))
        return self.table[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list[str | None]) -> list[tuple[np.ndarray, list[str]]]:
        """For each text the marginals (words, languages) of its words."""
        words = [_letters((t or "").lower()) for t in texts]
        many = np.fromiter(map(len, words), np.int64, len(words))
        scores = self.emissions([w for x in words for w in x])
        pieces = -(-many // SEQUENCE)
        first = np.repeat(np.cumsum(many) - many, pieces) + SEQUENCE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        lengths = np.minimum(SEQUENCE, np.repeat(np.cumsum(many), pieces) - first)
        out = np.empty(scores.shape)
        for c in range(0, len(first), 512):
            s, n = first[c : c + 512], lengths[c : c + 512]
            at = s[:, None] + np.minimum(np.arange(n.max()), n[:, None] - 1)
            m = forward_backward(scores[at], n, self.transition)
            alive = np.arange(n.max()) < n[:, None]
            out[at[alive]] = m[alive]
        return [(x, w) for x, w in zip(np.split(out, np.cumsum(many)[:-1]), words, strict=True)] if len(words) else []

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """Language, score and number of language switches of each text."""
        if not self.languages:
            return [(UNKNOWN, 0.0, 0)] * len(texts)
        out = []
        for marginals, words in self.label(texts):
            if not len(words):
                out.append((UNKNOWN, 0.0, 0))
                continue
            share = marginals.sum(0) / len(words)
            best = int(share.argmax())
            path = marginals.argmax(1)
            out.append((self.languages[best], float(min(1.0, max(0.0, share[best]))), int((path[1:] != path[:-1]).sum())))
        return out


def train(lines: list[tuple[str, str]], seed: int = FOLD_SEED) -> Model:
    """lines: (language, text). Stochastic gradient ascent on the conditional likelihood, with AdaGrad steps."""
    rng = np.random.default_rng(seed)
    languages = sorted({x for x, _ in lines})
    code = {x: i for i, x in enumerate(languages)}
    k = len(languages)
    by: dict[int, list[list[str]]] = {i: [] for i in range(k)}
    seen: list[dict[str, int]] = [{} for _ in range(k)]
    for language, text in lines:
        if words := _letters(text.lower()):
            start = max(0, (len(words) - TRAIN_WORDS) // 2)
            by[code[language]].append(words[start : start + TRAIN_WORDS])
            for w in by[code[language]][-1]:
                seen[code[language]][w] = seen[code[language]].get(w, 0) + 1
    lexicons: dict[str, int] = {}
    for i in range(k):
        for w in sorted(seen[i], key=lambda w, i=i: (-seen[i][w], w))[:LEXICON]:
            lexicons[w] = lexicons.get(w, 0) | 1 << i
    whole = [(w, [i] * len(w)) for i in range(k) for w in by[i]]
    model = Model(languages, np.zeros((SLOTS, k), np.float32), np.zeros((k, k)), lexicons)
    if k < 2:
        return model
    grown, grown_t = np.full((SLOTS, k), 1e-3, np.float32), np.full((k, k), 1e-3)
    known = {w: np.unique(features(w, lexicons)) for x, _ in whole for w in x}
    for _ in range(EPOCHS):
        order = rng.permutation(len(whole))
        sequences = [whole[i] for i in order]
        for i in range(0, len(sequences) - 1, 3):  # splice a third of them with another one
            (a, la), (b, lb) = sequences[i], whole[int(rng.integers(len(whole)))]
            cut, start = int(rng.integers(1, len(a) + 1)), int(rng.integers(0, len(b)))
            sequences[i] = (a[:cut] + b[start:] + a[cut:], la[:cut] + lb[start:] + la[cut:])
        for c in range(0, len(sequences), BATCH):
            part = sequences[c : c + BATCH]
            n = np.array([len(w) for w, _ in part])
            slots = [known[w] for x, _ in part for w in x]
            sizes = np.fromiter(map(len, slots), np.int64, len(slots))
            flat = np.concatenate(slots)
            scores = np.add.reduceat(model.weights[flat], np.cumsum(sizes) - sizes, axis=0)
            alive = np.arange(n.max()) < n[:, None]
            padded = np.zeros((len(part), n.max(), k))
            padded[alive] = scores
            m, expected = forward_backward(padded, n, model.transition, pairs=True)
            gold = np.concatenate([y for _, y in part])
            grad = -m[alive]
            grad[np.arange(len(gold)), gold] += 1
            observed = np.zeros((k, k))
            for _, y in part:
                np.add.at(observed, (y[:-1], y[1:]), 1)
            used, inverse = np.unique(flat, return_inverse=True)
            row = np.repeat(np.arange(len(slots)), sizes)
            g = np.stack([np.bincount(inverse, grad[row, j], len(used)) for j in range(k)], 1) - L2 * model.weights[used]
            grown[used] += g * g
            model.weights[used] += RATE * g / np.sqrt(grown[used])
            g = observed - expected
            grown_t += g * g
            model.transition += RATE * g / np.sqrt(grown_t)
    model._reset()
    return model


def fold() -> Column:
    """The remainder that holds a document out of training if it is 1."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def fit(docs: DataFrame, train_lines: int = TRAIN_LINES) -> Model:
    """Learn from a bounded sample of lines of labelled documents (text, lang, and doc_id for the fold)."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(fold(), F.lit(0)) != 1))
    lines = labelled.select("lang", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.col("line").rlike(r"\p{L}"))
    counts = lines.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return train([])
    # about twice as many as are wanted pass by their hash, so what is sorted and sent has a bound at any size
    key = F.xxhash64("doc_id", "pos", "line")
    middle = F.expr("substring(line, cast(greatest(1, length(line) div 2 - 400) as int), 800)")  # about TRAIN_WORDS words around the middle
    own_counts = docs.sparkSession.createDataFrame([tuple(r) for r in counts], "lang string, _n long")
    passing = lines.join(F.broadcast(own_counts), "lang").filter(F.pmod(key, F.col("_n")) < 2 * train_lines + 100)
    drawn = passing.select("lang", key.alias("_key"), middle.alias("line"))
    own = Window.partitionBy("lang").orderBy("_key", "line")
    drawn = drawn.withColumn("_place", F.row_number().over(own)).filter(F.col("_place") <= train_lines)
    model = train([(r[0], r[1]) for r in drawn.select("lang", "line", "_place").orderBy("lang", "_place").collect()])
    trim_driver(docs.sparkSession)
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and n_switches; columns of these names are replaced."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x languages numbers, whatever the input
    names = ["lang_pred", "score", "n_switches"]

    def run(texts):
        import pyarrow as pa

        rows = [r for at in range(0, len(texts), 64) for r in shared.value.predict(texts[at : at + 64].to_pylist())]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int32()))]
        release()
        return pa.StructArray.from_arrays(columns, names)

    (said,) = fresh(docs.columns, "_said")
    labelled = docs.withColumn(said, F.arrow_udf(run, "lang_pred string, score double, n_switches int")(F.col(text_col).cast("string")))
    return labelled.select(*[c for c in docs.columns if c.lower() not in names], *[F.col(said)[n].alias(n) for n in names])


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_switches")
