"""MinHash near-duplicates of documents with odd sketches.

A document's set is its distinct 3-word shingles after lower-casing A-Z. ``SAMPLES``
MinHash values are taken; the first ``BANDS * ROWS`` make bucket keys, and all are folded
into a bitmap of ``BITS`` parities (an odd sketch). For two bitmaps the number of ones in
their XOR tells how many samples differ; at high likeness it is a sharp estimate, so a
bucket's pairs whose XOR has over ``MAX_ODD`` ones are apart. At a likeness of 0.85 about
19 of 128 samples differ (sd 4), which toggle 38 of the 512 parities, about 36 ones; 84
ones are reached past 6 sd. What is left is confirmed on full shingle sets.

A pair at exactly 0.85 meets in no bucket with probability 7e-6.

Defined results: null or word-less text has an empty set, is linked with nothing and kept;
repeated rows are equal documents of one id; a null doc_id gets the component of its
equals if there are any, else null, and is not kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near
from .common import Scratch, releasing, table

SHINGLE, PERCENT, SAMPLES, ROWS, BANDS, BITS, MAX_ODD = 3, 85, 128, 4, 16, 512, 84


def odd_sketches(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(items, bits / 8) parities of the samples (items, k) hashed to bits places."""
    n, k = values.shape
    place = (near.mix(values + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)).astype(np.int64)
    ones = np.bincount((place + np.arange(n)[:, None] * bits).ravel(), minlength=n * bits) & 1
    return np.packbits(ones.astype(bool).reshape(n, bits), axis=1)


def signatures(docs: DataFrame, shingle: int = SHINGLE, samples: int = SAMPLES, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest (of the word sequence; null without words), keys, sk."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                part = [(x.as_py() or "").encode().lower() for x in texts[at : at + 256]]
                items = near.Items(part)
                h, first = items.shingles(shingle)
                counts = [1 + int(np.count_nonzero(np.diff(np.sort(h[s:e])))) if e > s else 0 for s, e in zip(first[:-1], first[1:], strict=True)]
                digest = items.sequence_hashes()
                low = near.minima(h, first, samples)
                keys, sk = near.band_keys(low, bands, rows), odd_sketches(low)
                none = items.n_words == 0
                yield pa.RecordBatch.from_arrays(
                    [ids[at : at + 256], pa.array(counts, pa.int64()), pa.array([None if z else x.tobytes() for x, z in zip(digest, none, strict=True)], pa.binary()), pa.array(list(keys), pa.list_(pa.int64())), pa.array([x.tobytes() for x in sk], pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "keys", "sk"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(releasing(run), "doc_id long, n_shingles long, digest binary, keys array<long>, sk binary")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, max_odd: int = MAX_ODD) -> DataFrame:
    """docs: doc_id and text. Returns doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession, "minhash")
    sig = scratch.write(signatures(docs, shingle, SAMPLES, bands, rows))
    classes = sig.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("root"), F.first("keys").alias("keys"), F.first("sk").alias("sk"))
    classes = scratch.write(classes.withColumn("id", F.monotonically_increasing_id()))
    links = near.candidates(scratch, classes.select(F.explode("keys").alias("key"), "id"), classes.select("id", "sk"), near.popcount_apart, max_odd)
    if links.isEmpty():
        found = classes.select("digest", "root")
    else:
        groups = near.components(scratch, links)
        wanted = scratch.write(groups.join(classes.select("id", "digest", "root"), "id").filter(F.col("root").isNotNull()).withColumnRenamed("root", "doc_id"))
        texts = near.only_ids(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), wanted, "doc_id")
        items = with_digest(texts).join(wanted, ["doc_id", "digest"]).select("comp", "id", "item")
        labels = near.settle(scratch, items, lambda groups: [near.set_labels(x, shingle, percent, known) for x, known, *_ in groups])
        joined = classes.select("id", "digest", "root").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        roots = scratch.write(joined.groupBy("label").agg(F.min("root").alias("_root")))
        found = joined.join(roots, "label").select("digest", F.col("_root").alias("root"))
    out = sig.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def with_digest(docs: DataFrame) -> DataFrame:
    """doc_id, digest and item (the lower-cased text's bytes) of documents with words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = [(x.as_py() or "").encode().lower() for x in batch.column(1)[at : at + 256]]
                digest = near.Items(part).sequence_hashes()
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 256], pa.array([x.tobytes() for x in digest], pa.binary()), pa.array(part, pa.binary())], names=["doc_id", "digest", "item"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), "doc_id long, digest binary, item binary")


def op9_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
