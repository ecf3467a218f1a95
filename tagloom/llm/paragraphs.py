"""Substring dedup by paragraphs: MinHash banding, exact Jaccard, components.

A paragraph is a line; its set is its 5-word shingles after lower-casing A-Z, where each
character of a script without blanks is a word. With fewer than ``MIN_WORDS`` words only
equal paragraphs can reach a likeness of 0.8 (3 shingles of 4 are too few). Of ``BANDS * ROWS``
MinHash values each band is a bucket key, and a bit of each is the sketch; the number of bands is the fewest that show a pair at a likeness of
0.8 with probability ``RECALL``. Of the paragraphs that collide, those whose sketches
agree too little (more than 5 standard deviations under 0.8) are dropped; the others are
compared by the exact Jaccard index of whole sets, and of each component one occurrence
stays.

``op8_paragraph_dedup`` leaves single lines of under ``LEAST_WORDS`` words: a repeated
short line is no passage, and ``lines`` is there for it. With them, a third of the documents of
sf0.1 that are no copies would be cut, nearly all for a line of 8 to 19 words.

Bands of whole paragraphs can't show a passage that is a part of paragraphs which differ
otherwise: its likeness is far below any threshold. Such passages, of 50 words or more,
are found by ``passages`` and cut out as well, all but their first occurrence.

See ``segments`` for what happens to nulls, copies and empty tables.
"""

from __future__ import annotations

import re
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near, passages
from .common import Scratch, fresh, table
from .segments import Method, removals, row_id

SHINGLE, PERCENT, ROWS, RECALL, MIN_WORDS, LEAST_WORDS = 5, 80, 4, 0.998, 8, 20
BANDS = near.banding(PERCENT / 100, ROWS, RECALL)
SAMPLES = BANDS * ROWS
_flips = (1 - PERCENT / 100) / 2  # of the bits of two paragraphs at the limit
MAX_APART = int(np.ceil(SAMPLES * _flips + 5 * (SAMPLES * _flips * (1 - _flips)) ** 0.5))


#: Thai, Lao, Burmese, Khmer, kana, Han; marks stay with their letter.
_unspaced = re.compile("([\u0e01-\u0e30\u0e32\u0e33\u0e40-\u0e46\u0e81-\u0eb0\u0eb2\u0eb3\u0ebd-\u0ec6\u1000-\u102a\u1780-\u17b3\u3041-\u3096\u30a1-\u30fa\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af])")


def normalise(text: str) -> bytes:
    if not text.isascii():
        text = _unspaced.sub(r" \1", text)
    return text.encode().lower()


def fuzzy(items: near.Items) -> np.ndarray:
    return items.n_words >= MIN_WORDS


def blocks(items: near.Items) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Items, keys of their bands, and one bit of each sample."""
    hashes, first = items.shingles(SHINGLE)
    low = near.minima(hashes, first, SAMPLES)
    bits = (near.mix(low) >> np.uint64(63)) << np.arange(SAMPLES, dtype=np.uint64)
    return [(np.arange(len(low)), near.band_keys(low, BANDS, ROWS).view(np.uint64), near.sized(np.bitwise_or.reduce(bits, axis=1), items.n_words))]


def labels(groups: list[tuple]) -> list[np.ndarray]:
    return [near.set_labels(items, SHINGLE, PERCENT, known) for items, known, *_ in groups]


METHOD = Method("paragraphs", normalise, blocks, BANDS, MAX_APART, MAX_APART, labels, lambda pairs: pairs, 1, fuzzy, False)


def shorten(text: str, gone: list[int], ranges: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """text without its paragraphs at the places gone and without ranges of characters; all that went, as ranges in order.

    A paragraph of which no word is left goes; of two blanks that meet at a cut one stays."""
    out, went, at, k, drop = [], [], 0, 0, set(gone)
    for place, line in enumerate(text.split("\n")):
        end = at + len(line)
        own = [(max(s, at), min(e, end)) for s, e in ranges[k:] if s < end and e > at] if place not in drop else [(at, end)]
        while k < len(ranges) and ranges[k][1] <= end:
            k += 1
        if not own:
            out.append(line)
        else:
            went += own
            left, begin = "", at
            for s, e in own:
                left += text[begin:s]
                begin = e + (left[-1:] in ("", " ") and text[e : min(e + 1, end)] == " ")
            left += text[begin:end]
            if left.strip(" \t\r\x0b\x0c"):
                out.append(left)
        at = end + 1
    return "\n".join(out), went


def method_for(min_words: int) -> Method:
    """The method for paragraphs of so many words at least; shorter ones stay."""
    return replace(METHOD, min_words=min_words, fuzzy=lambda items: items.n_words >= max(min_words, MIN_WORDS))


def dedup_paragraphs(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """docs with its text shortened, n_paragraphs, and removed (ranges of characters of the text as it was).

    Paragraphs of under min_words words go only as parts of passages. Columns of the names
    n_paragraphs and removed are replaced."""
    scratch = Scratch(docs.sparkSession, METHOD.label)
    lines = removals(scratch, docs, method_for(min_words)).withColumnRenamed("_rid", "rid")
    found = passages.runs(scratch, docs.select(row_id().alias("rid"), "doc_id", "text"))
    found = scratch.write(found)
    by_text = lambda x: x.groupBy("rid").agg(F.collect_list(F.struct("start", "end", "first_start", "left", "right")).alias("runs"))
    texts = docs.select(row_id().alias("rid"), "doc_id", "text").join(by_text(found).hint("merge"), "rid")
    found = by_text(found.unionByName(passages.rest(scratch, texts)))
    rid, gone, runs, made = fresh(docs.columns, "_rid", "_gone", "_runs", "_made")
    both = scratch.write(lines.join(found, "rid", "full").select(F.col("rid").alias(rid), F.col("_gone").alias(gone), F.col("runs").alias(runs)))

    def cut(texts, places, stretches):
        import pyarrow as pa

        rows = []
        for t, p, r in zip(texts, places, stretches, strict=True):
            p, r, t = p.as_py(), r.as_py(), t.as_py()
            if t is None or p is None and r is None:
                rows.append({"text": t, "removed": []})
                continue
            text, went = shorten(t, p or [], passages.repeats(t, r or []))
            rows.append({"text": text, "removed": [{"start": s, "end": e} for s, e in went]})
        return pa.array(rows, pa.struct([("text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))

    cutter = F.arrow_udf(cut, "text string, removed array<struct<start int, end int>>")
    d = docs.withColumn(rid, row_id()).join(both.hint("merge"), rid, "left").withColumn(made, cutter("text", gone, runs))  # the same plan at every size
    return d.select(
        *[F.col(made)["text"].alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_paragraphs", "removed")],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).alias("n_paragraphs"),
        F.col(made)["removed"].alias("removed"),
    )


def op8_paragraph_dedup(spark, sf_dir):
    d = dedup_paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"), LEAST_WORDS)
    return d.select("doc_id", "n_paragraphs", F.size("removed").alias("n_removed"), F.col("removed").alias("removed_ranges"), "text")
