"""Passages that documents share word for word, wherever they begin and end.

A passage may lie inside paragraphs that differ otherwise, so whole paragraphs don't show
it. Of the windows of ``WINDOW`` words of a text, the one with the smallest hash among
each ``SELECT`` neighbouring ones is selected (winnowing, a MinHash of each stretch): any
two equal stretches of ``MIN_PASSAGE`` words or more select an equal window, wherever they
are. Equal windows are one group; its smallest (doc_id, place) is the first. Windows of a
text that follow one another as their firsts do are one run. A run is extended word by
word on both sides as far as the text with the firsts agrees, ``SELECT`` words at most,
beyond which another window would have been selected. Runs that reach ``MIN_PASSAGE``
words are repeats.

What a text shares with others than the firsts is found by ``rest``: of a text with runs,
each stretch of ``MIN_PASSAGE`` words that holds a window of a run and is not part of a
repeat is grouped with its equals, and all but the first occurrence are repeats as well.
No stretch is lost by that: if its first occurrence lies where a window of it occurs first
of all, the run with that window covers it; else it is in no repeat there, and has a run.

Hashes of 128 bits stand for windows. Words are compared after lower-casing A-Z.

Equal windows are counted with partial aggregation, and the join back to them has one row
for each window on its other side, so a passage that a third of all documents share is
split like any skewed join. Of a text's own repeats the first stays: words that belong to
the first occurrence are never part of a run in the same text.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import near
from .common import Scratch, releasing

WINDOW, SELECT, MIN_PASSAGE = 26, 25, 50
_EXTEND = SELECT
_words = re.compile(r"[^\x20\x09-\x0D]+").finditer


def selected(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW, select: int = SELECT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, place in it and two hashes (n, 2) of the selected windows of items of words (first[i]..first[i+1])."""
    n = np.diff(first)
    many = np.maximum(n - window + 1, 0)
    total = int(many.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    item = np.repeat(np.arange(len(n)), many)
    begin = np.cumsum(many) - many
    at = np.arange(total) - begin[item]
    start = at + first[:-1][item]
    up, down = near._pow(len(hashes) + 1)
    both = []
    for k in range(2):
        sums = np.append(np.uint64(0), np.cumsum(near.mix(hashes + np.uint64(k)) * up[: len(hashes)]))
        both.append(near.mix((sums[start + window] - sums[start]) * down[start] + np.uint64(k)))
    # the order: a hash's upper bits, then the last place; items are apart by a gap of no value
    gap = select - 1
    value = np.full(total + gap * (len(n) + 1), np.uint64(2**64 - 1))
    where = np.arange(total) + gap * (item + 1)
    low = np.uint64((1 << 24) - 1)
    value[where] = (both[0] & ~low) | (low - (at.astype(np.uint64) & low))
    least, have = value, 1
    while have < select:  # minima of 2, 4, .. neighbours
        step = min(have, select - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    most, have = least, 1  # a window is selected if it is the least of a stretch that holds it: the greatest of their leasts
    while have < select:
        step = min(have, select - have)
        most = np.maximum(most[:-step], most[step:])
        have += step
    kept = np.flatnonzero(value[where] == most[where - gap])
    # of equal windows that follow one another in a periodic text, one in each stretch is enough
    again = np.append(False, (both[0][kept][1:] == both[0][kept][:-1]) & (item[kept][1:] == item[kept][:-1]) & (np.diff(at[kept]) < select))
    if again.any():
        begins = np.flatnonzero(~again)
        turn = (at[kept] - at[kept][begins[np.cumsum(~again) - 1]]) // select
        kept = kept[~again | (turn != np.append(-1, turn[:-1]))]
    return item[kept], at[kept], np.stack([both[0][kept], both[1][kept]], 1)


def windows(docs: DataFrame) -> DataFrame:
    """rid, doc_id, pos and the hashes h1, h2 of the selected windows of docs (doc_id, text, rid)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rids, ids = batch.column(0).to_numpy(), batch.column(1)
            for at in range(0, batch.num_rows, 128):
                items = near.Items([x.as_py().encode().lower() for x in batch.column(2)[at : at + 128]])
                item, pos, h = selected(items.words, items.first)
                h = h.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rids[item + at]), ids.take(pa.array(item + at)), pa.array(pos, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["rid", "doc_id", "pos", "h1", "h2"])

    return docs.filter(F.col("text").isNotNull()).select("rid", F.col("doc_id").cast("long"), "text").mapInArrow(releasing(run), "rid long, doc_id long, pos int, h1 long, h2 long")


def _context(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (rid, start, end): hashes of up to SELECT words to the left of start, nearest first, and to the right of end."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for rid, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                w = near.word_hashes(text.as_py().encode().lower())[0].astype("<u4")
                for p in spans:
                    s, e = p["start"], p["end"]
                    for out, x in zip(rows, (rid, s, e, w[max(0, s - _EXTEND) : s][::-1].tobytes(), w[e : e + _EXTEND].tobytes()), strict=True):
                        out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["first_rid", "first_start", "first_end", "left", "right"])

    spans = wanted.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    small = wanted.count() <= near.BROADCAST_IDS
    found = docs.select("rid", "text").join(F.broadcast(spans) if small else spans, "rid")
    return found.select("rid", "text", "spans").mapInArrow(releasing(run), "first_rid long, first_start int, first_end int, left binary, right binary")


def runs(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """rid and its runs (start, end, first_start where the first is in the same text else null, left, right).

    docs: rid (one for each different content), doc_id and text."""
    seen = scratch.write(windows(docs))
    repeated = seen.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
    matched = scratch.write(seen.join(repeated.hint("merge"), ["h1", "h2"]))
    scratch.drop(seen)
    place = F.struct("doc_id", "rid", "pos")
    firsts = matched.groupBy("h1", "h2").agg(F.min(place).alias("f")).select("h1", "h2", F.col("f.rid").alias("first_rid"), F.col("f.pos").alias("first_pos"))
    pairs = matched.join(firsts, ["h1", "h2"]).filter((F.col("rid") != F.col("first_rid")) | (F.col("pos") != F.col("first_pos")))
    own = Window.partitionBy("rid").orderBy("pos")
    before = lambda c: F.lag(c).over(own)
    follows = (before("first_rid") == F.col("first_rid")) & (F.col("pos") - before("pos") == F.col("first_pos") - before("first_pos")) & (F.col("pos") - before("pos") <= WINDOW)
    pairs = pairs.select("rid", "pos", "first_rid", "first_pos").distinct().withColumn("_new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    pairs = pairs.withColumn("_run", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = pairs.groupBy("rid", "_run", "first_rid").agg(F.min("pos").alias("start"), F.max("pos").alias("_last"), F.min("first_pos").alias("first_start"))
    found = found.select("rid", "start", (F.col("_last") + WINDOW).alias("end"), "first_rid", "first_start", (F.col("first_start") + F.col("_last") + WINDOW - F.col("start")).alias("first_end"))
    found = scratch.write(found)
    scratch.drop(matched)
    wanted = found.select(F.col("first_rid").alias("rid"), F.col("first_start").alias("start"), F.col("first_end").alias("end")).distinct()
    context = _context(docs, wanted).dropDuplicates(["first_rid", "first_start", "first_end"])
    out = found.join(context, ["first_rid", "first_start", "first_end"])
    return out.select("rid", "start", "end", F.when(F.col("rid") == F.col("first_rid"), F.col("first_start")).alias("first_start"), "left", "right")


def rest(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """Runs (as ``runs`` has them, without context) of docs (rid, doc_id, text, runs) in stretches that no run covers."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                item, pos, hashes = [], [], []
                for i in range(at, min(at + 128, batch.num_rows)):
                    w = near.word_hashes(batch.column(2)[i].as_py().encode().lower())[0]
                    found = batch.column(3)[i].as_py()
                    begins = _uncovered(w.astype("<u4"), found)
                    if len(begins):
                        item.append(np.full(len(begins), i))
                        pos.append(begins)
                        hashes.append(_stretches(w, begins))
                if item:
                    item, h = np.concatenate(item), np.concatenate(hashes).view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(item)), batch.column(1).take(pa.array(item)), pa.array(np.concatenate(pos), pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["rid", "doc_id", "pos", "h1", "h2"])

    seen = docs.select("rid", F.col("doc_id").cast("long"), "text", "runs").mapInArrow(releasing(run), "rid long, doc_id long, pos int, h1 long, h2 long")
    seen = scratch.write(seen.distinct())
    firsts = seen.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "rid", "pos")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2", F.col("f.rid").alias("first_rid"), F.col("f.pos").alias("first_pos"))
    again = seen.join(firsts.hint("merge"), ["h1", "h2"]).filter((F.col("rid") != F.col("first_rid")) | (F.col("pos") != F.col("first_pos")))
    none = F.lit(b"")
    again = again.select("rid", F.col("pos").alias("start"), (F.col("pos") + MIN_PASSAGE).alias("end"), F.when(F.col("rid") == F.col("first_rid"), F.col("first_pos")).alias("first_start"), none.alias("left"), none.alias("right"))
    out = scratch.write(again)
    scratch.drop(seen)
    return out


def _stretches(w: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Two hashes of the MIN_PASSAGE words from each of begins."""
    up, down = near._pow(len(w) + 1)
    both = []
    for k in range(2):
        sums = np.append(np.uint64(0), np.cumsum(near.mix(w + np.uint64(k)) * up[: len(w)]))
        both.append(near.mix((sums[begins + MIN_PASSAGE] - sums[begins]) * down[begins] + np.uint64(k)))
    return np.stack(both, 1)


def _extended(w: np.ndarray, r: dict) -> tuple[int, int]:
    """Start and end of a run with the words around it that agree."""
    left, right = np.frombuffer(r["left"], "<u4"), np.frombuffer(r["right"], "<u4")
    s, e = r["start"], r["end"]
    return s - _common(w[max(0, s - len(left)) : s][::-1], left), e + _common(w[e : e + len(right)], right)


def _uncovered(w: np.ndarray, found: list[dict]) -> np.ndarray:
    """Starts of the stretches of MIN_PASSAGE words that hold a window of a run and lie in no run."""
    if len(w) < MIN_PASSAGE:
        return np.zeros(0, np.int64)
    wanted = np.zeros(len(w) + 1, np.int64)
    covered = np.zeros(len(w) + 1, np.int64)
    last = len(w) - MIN_PASSAGE + 1  # starts are before this
    for r in found:
        lo, hi = max(0, r["start"] + WINDOW - MIN_PASSAGE), min(last, r["end"] - WINDOW + 1)
        if lo < hi:
            wanted[lo] += 1
            wanted[hi] -= 1
        s, e = _extended(w, r)
        if e - s >= MIN_PASSAGE:
            covered[s] += 1
            covered[e - MIN_PASSAGE + 1] -= 1
    return np.flatnonzero((np.cumsum(wanted) > 0) & (np.cumsum(covered) == 0))


def repeats(text: str, found: list[dict]) -> list[tuple[int, int]]:
    """Ranges of characters (start, end) of the repeats of a text with these runs, apart from each other and in order."""
    w = near.word_hashes(text.encode().lower())[0].astype("<u4")
    gone, kept = np.zeros(len(w), bool), np.zeros(len(w), bool)
    for r in found:
        s, e = r["start"], r["end"]
        s2, e2 = _extended(w, r)
        if e2 - s2 < MIN_PASSAGE:
            continue
        gone[s2:e2] = True
        if r["first_start"] is not None:
            f = r["first_start"]
            kept[max(0, f - (s - s2)) : f + (e2 - s)] = True
    gone &= ~kept
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    if not len(edge):
        return []
    spans = [m.span() for m in _words(text)]
    return [(spans[s][0], spans[e - 1][1]) for s, e in zip(edge[::2], edge[1::2], strict=True)]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    return int(apart[0]) if len(apart) else n
