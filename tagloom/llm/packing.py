"""Packing documents into fixed windows by non-negative least squares.

A document's ids are cut into full windows and one remainder. Remainders are counted by
length, in steps of ``STEP`` ids; the histogram has 256 bars at any input size. All
combinations of up to ``DEPTH`` bars that fill a window exactly are enumerated, and
non-negative least squares (active set) finds how often to repeat each so that the
histogram is used up. The counts are rounded; what is over is packed greedily, longest
first. This plan is a list of intervals "ranks a..b of bar l take slot k of sequences
s..": its size depends on the bars only. Remainders then get a rank in their bar and look
up their interval, so no sequence is built on the driver.

Words are encoded once in a worker and cached as bytes. That is exact where no token can
span white space and lower-casing goes character by character, which holds for the
characters of ``SAFE`` outside special tokens' strings; other texts are encoded whole.

Defined results: null and empty texts are the end id alone; repeated rows are documents
of their own; a null doc_id is carried; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ON_RELEASE, Scratch, release, table

WINDOW, STEP, DEPTH, END_ID = 2048, 8, 3, 1
BARS = WINDOW // STEP
#: Texts of these characters only may be encoded word by word.
SAFE = r"[\t-\r\x20-\x7e¡-įı-ɏ‐-‧‰-⁞]*"
#: How the tokenizer splits lower-cased text into parts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CACHE_WORDS, BUCKET_ROWS = 50_000, 5_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bar int"


class Recent:
    """The last entries that were asked for, between limit and twice limit of them."""

    def __init__(self, limit: int):
        self.limit, self.now, self.old = limit, {}, {}

    def missing(self, keys: set) -> list:
        """Those of keys that are not known; the others are in ``now`` from here on, until the next call."""
        new = keys.difference(self.now)
        if len(self.now) + len(new) > self.limit and self.now:
            self.now, self.old, new = {}, self.now, keys
        out = []
        for k in new:
            if (v := self.old.get(k)) is None:
                out.append(k)
            else:
                self.now[k] = v
        return out


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, the end id last."""

    def __init__(self, path: str, cache_words: int | None = None):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.safe = Tokenizer.from_file(path), re.compile(SAFE)
        self.parts = regex.compile(SPLIT).findall
        self.words, self.pieces = Recent(cache_words or CACHE_WORDS), Recent(cache_words or CACHE_WORDS)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # the tokens that end a part of a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.end = END_ID.to_bytes(4, "little")
        del vocabulary
        release(False)

    def _encode(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        """Encode new words by their parts, all new parts in one call."""
        split = [x if len(x := self.parts(w)) != 1 or x[0] != w else (w,) for w in words]  # one string for both
        if new := self.pieces.missing({p for x in split for p in x}):
            ids = self._encode(" ".join(new))
            cuts = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
            if len(cuts) != len(new) + 1:
                raise ValueError("a part of a word has more or less than one end token")
            data = ids.tobytes()
            self.pieces.now.update(zip(new, (data[4 * s : 4 * e] for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)), strict=True))
        get = self.pieces.now.__getitem__
        self.words.now.update((w, b"".join(map(get, x))) for w, x in zip(words, split, strict=True))

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if "<|" in text or not self.safe.fullmatch(text):
            return self._encode(text).tobytes() + self.end
        words = text.lower().split()
        if new := self.words.missing(set(words)):
            self._learn(new)
        return b"".join(map(self.words.now.__getitem__, words)) + self.end


_encoders: dict[str, Encoder] = {}
ON_RELEASE.append(_encoders.clear)


def encoder(path: str, cache_words: int | None = None) -> Encoder:
    """The worker's encoder; its cache outlives a task, until the worker's next one of another operator."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, cache_words)
    return _encoders[path]


def cut(ids: bytes, window: int = WINDOW):
    """(start, length, crc32) of the pieces of a document."""
    n = len(ids) // 4
    view = memoryview(ids)
    return [(s, min(window, n - s), zlib.crc32(view[4 * s : 4 * (s + window)])) for s in range(0, n, window)]


def pieces(docs: DataFrame, path: str, cache_words: int | None = None) -> DataFrame:
    """The pieces of documents (doc_id, text); bar 0 is a full window."""

    def run(batches):
        import pyarrow as pa

        encode = encoder(path, cache_words)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py())
                n = len(ids) // 4
                rows += [(doc, s, k, crc, n, 0 if k == WINDOW else -(-k // STEP)) for s, k, crc in cut(ids)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 5 else pa.int64()) for i, x in enumerate(zip(*rows, strict=True))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bar"])
        release(False)  # the cache stays

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE)


def combinations(bars: int = BARS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Descending bars, depth at most, that add up to a window."""
    found = []

    def grow(rest: int, most: int, chosen: tuple[int, ...]):
        if rest == 0:
            found.append(chosen)
        elif len(chosen) < depth:
            for b in range(min(rest, most), 0, -1):
                if b * (depth - len(chosen)) < rest:
                    break
                grow(rest - b, b, (*chosen, b))

    grow(bars, bars, ())
    return found


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 that minimises ``|a x - b|``: the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        k = int(gain.argmax())
        if gain[k] <= tolerance * max(1.0, np.abs(b).max()):
            break
        active[k] = True
        while active.any():
            on = np.flatnonzero(active)
            part = a[:, on]
            gram = part.T @ part
            s = np.linalg.solve(gram + np.eye(len(on)) * 1e-10, part.T @ b)
            if s.min() > 0:
                x[:] = 0
                x[on] = s
                break
            low = s <= 0
            old = x[on]
            step = np.min(np.where(low, old / np.maximum(old - s, 1e-300), np.inf))
            x[on] = old + step * (s - old)
            gone = on[(x[on] <= 1e-12) & low]
            if not len(gone):
                gone = on[low]
            x[gone] = 0
            active[gone] = False
    return x


def plan(counts: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(bars of a sequence, how many such sequences) that use up counts[1..BARS]."""
    bars = len(counts) - 1
    left = np.asarray(counts, np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    ways = combinations(bars, depth)
    if left[1:].sum():
        a = np.zeros((bars, len(ways)))
        for j, way in enumerate(ways):
            for b in way:
                a[b - 1, j] += 1
        share = nnls(a, left[1:].astype(float))
        for j in np.argsort(-share, kind="stable"):
            if (n := int(share[j] + 0.5)) == 0:
                break
            need = {b: len(list(g)) for b, g in groupby(ways[j])}
            if n := min(n, *(int(left[b]) // m for b, m in need.items())):
                out.append((ways[j], n))
                for b, m in need.items():
                    left[b] -= n * m
    while left[1:].any():  # each turn uses up one bar at least
        rest, way, have = bars, [], left.copy()
        while rest and (fits := np.flatnonzero(have[1 : rest + 1])).size:
            b = int(fits[-1]) + 1
            way.append(b)
            have[b] -= 1
            rest -= b
        need = {b: way.count(b) for b in set(way)}
        n = min(int(left[b]) // m for b, m in need.items())
        out.append((tuple(way), n))
        for b, m in need.items():
            left[b] -= n * m
    return out


def intervals(chosen: list[tuple[tuple[int, ...], int]], n_full: int) -> tuple[list[tuple], int]:
    """(bar, first rank, end rank, first sequence, slot) of every slot, and the number of sequences."""
    rows, used, base = [(0, 0, n_full, 0, 0)] if n_full else [], {}, n_full
    for way, n in chosen:
        for slot, b in enumerate(way):
            at = used.get(b, 0)
            rows.append((b, at, at + n, base, slot))
            used[b] = at + n
        base += n
    return rows, base


def pack(docs: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS, cache_words: int | None = None) -> DataFrame:
    """docs: doc_id and text. path: the tokenizer's file, the same on all executors."""
    spark = docs.sparkSession
    p = Scratch(spark, "pack").write(pieces(docs, path, cache_words))
    counts = np.zeros(BARS + 1, np.int64)
    for b, n in p.groupBy("bar").count().collect():  # one row for each bar
        counts[b] = n
    rows, _ = intervals(plan(counts), int(counts[0]))
    slots = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "bar int, first long, end long, base long, slot int")
    buckets = max(1, -(-int(counts.max()) // bucket_rows))
    p = p.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("bar").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = p.groupBy("bar", "_bucket").count().select("bar", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("bar", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    p = p.join(starts, ["bar", "_bucket"]).withColumn("_rank", F.col("_start") + F.row_number().over(own) - 1)
    p = p.join(F.broadcast(slots), "bar").filter((F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("end")))
    p = p.withColumn("sequence_id", F.col("base") + F.col("_rank") - F.col("first"))
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return p.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), cache_words=500_000)  # alone in its workers
