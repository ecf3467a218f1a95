"""Removing near-duplicate lines or paragraphs: what both operators share.

A document's segments are its ``\\n``-separated lines. ``Method`` says how a segment is
normalised and sketched and how two are compared. Of each group of linked segments the
occurrence in the smallest (doc_id, place) stays and the others go, whether in other
documents or in the same one. A blank segment is never removed.

Defined results: a null text stays null, has no segments; rows repeated in full are one
document, and each copy gets the same result; of rows with one doc_id and several texts
each is a document; a null doc_id sorts first; an empty table gives no rows. Columns other
than doc_id and text are carried through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near
from .common import FEW_ROWS, Scratch, fresh, releasing


@dataclass(frozen=True)
class Method:
    label: str
    normalise: Callable[[str], bytes]  # of a whole text; keeps its line ends
    blocks: Callable[[near.Items], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]  # items, their bucket keys and sketches
    n_blocks: int  # keys of an item, about
    strong: int  # bits of sketches that may differ for links that make groups
    limit: int  # bits that may differ for a pair to be compared
    labels: Callable[[list[tuple[list[bytes], np.ndarray | None]]], list[np.ndarray]]  # of groups, see ``near.settle``
    pairs: Callable  # of pairs (a, b, x, y: the items), those that are linked
    min_words: int  # segments with fewer stay
    fuzzy: Callable[[near.Items], np.ndarray]  # which items are compared by likeness
    masks: bool  # whether normalising makes different digits or marks equal
    merged: int | None = None  # groups of more candidates that are not strong are put together where they share items
    most_items: int | None = None  # a group beyond these is compared in blocks
    most_chars: int | None = None
    central: Callable[[list[bytes]], tuple[int, float]] | None = None
    many: int | None = None  # segments from which on strong falls by a bit with each doubling
    bound: tuple[Callable[[list[bytes]], np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]] | None = None  # a short row for each item, and which pairs of rows may be of linked items

    def strong_at(self, n: int) -> int:
        """strong for n segments.

        Unlike segments that chance brings under strong grow with the square of n and families of copies with n, so at some size
        nearly all families hang together in one group, which takes the square of its size to compare. A bit less lets a third
        to a quarter of them pass. Nothing is lost: what strong links don't join is compared by pairs."""
        return self.strong if self.many is None else max(0, self.strong - round(math.log2(max(1, n / self.many))))


def row_id():
    """Tells rows of different content apart."""
    return F.xxhash64("doc_id", "text")


SLICE = 128


def _slices(texts, method: Method):
    """Place of the first text, its texts' lines as items, and the lines, of slices of a column of texts."""
    for at in range(0, len(texts), SLICE):
        lines = [method.normalise(x.as_py() or "").split(b"\n") for x in texts[at : at + SLICE]]
        flat = [y for x in lines for y in x]
        yield at, np.fromiter(map(len, lines), np.int64, len(lines)), near.Items(flat), flat


def occurrences(docs: DataFrame, method: Method) -> DataFrame:
    """doc_id, rid, seg, and two hashes (id and id2) of each segment that is not blank."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, rids, texts = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
            for at, many, items, flat in _slices(texts, method):
                row = np.repeat(np.arange(len(many)), many)
                seg = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                digests, words = items.sequence_hashes(), items.n_words
                if method.masks:  # what is compared for equality only is told apart as it was
                    fuzzy = method.fuzzy(items)
                    own = [i for i in np.flatnonzero(~fuzzy).tolist() if b"0" in flat[i] or not items.n_words[i]]
                    raw = [y for x in texts[at : at + SLICE] for y in (x.as_py() or "").encode().split(b"\n")] if own else []
                    exact = near.Items([raw[i] for i in own])
                    digests[own] = exact.sequence_hashes()
                    words = items.n_words.copy()
                    words[own] = exact.n_words
                good = np.flatnonzero(words >= method.min_words)
                d = digests[good].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row[good] + at)), pa.array(rids[row[good] + at]), pa.array(seg[good], pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1])],
                    names=["doc_id", "rid", "seg", "id", "id2"],
                )

    return docs.mapInArrow(releasing(run), "doc_id long, rid long, seg int, id long, id2 long")


def candidate_links(scratch: Scratch, docs: DataFrame, n_segments: int, method: Method) -> DataFrame:
    """Links (a, b) between ids of segments that may be near each other."""

    def items_of(batch):
        for _, _, items, _ in _slices(batch.column(0), method):
            fuzzy = np.flatnonzero(method.fuzzy(items))
            if len(fuzzy):
                own = items.only(fuzzy)
                ids = own.sequence_hashes()[:, 0].view(np.int64)
                yield [(ids[i], keys, sketch) for i, keys, sketch in method.blocks(own)]

    return near.meet(scratch, docs.select("text"), items_of, n_segments, method.n_blocks, method.strong_at(n_segments), method.limit)


def _wanted_items(docs: DataFrame, wanted: DataFrame, method: Method) -> DataFrame:
    """id and item of wanted (rid, seg, id); many rids are fetched by shuffle, few by broadcast."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, items = [], []
            for text, picks in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                lines = method.normalise(text.as_py()).split(b"\n")
                for p in picks:
                    ids.append(p["id"])
                    items.append(b" ".join(lines[p["seg"]].split()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.binary())], names=["id", "item"])

    picks = wanted.groupBy(F.col("rid").alias("_rid")).agg(F.collect_list(F.struct("seg", "id")).alias("picks"))
    small = wanted.count() <= near.BROADCAST_IDS
    found = docs.select(row_id().alias("_rid"), "text").join(F.broadcast(picks) if small else picks, "_rid")
    return found.select("text", "picks").mapInArrow(releasing(run), "id long, item binary")


def _with_items(scratch: Scratch, pairs: DataFrame, items: DataFrame) -> DataFrame:
    """pairs (a, b) with their items x and y."""
    x, y = (items.select(F.col("id").alias(e), F.col("item").alias(n)) for e, n in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b")


def _hopeful(scratch: Scratch, pairs: DataFrame, items: DataFrame, method: Method) -> DataFrame:
    """Those of pairs (a, b) that ``method.bound`` leaves open, so that whole items are fetched for these only."""
    if method.bound is None:
        return pairs
    row_of, open_ = method.bound

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), near.binary(row_of(batch.column(1).to_pylist()))], names=["id", "row"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                yield batch.select(["a", "b"]).filter(pa.array(open_(near._fixed(batch.column(2)), near._fixed(batch.column(3)))))

    made = scratch.write(items.select("id", "item").mapInArrow(releasing(rows), "id long, row binary"))
    x, y = (made.select(F.col("id").alias(e), F.col("row").alias(n)) for e, n in (("a", "x"), ("b", "y")))
    return scratch.write(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(releasing(run), "a long, b long"))


def linked_segments(scratch: Scratch, docs: DataFrame, seen: DataFrame, links: DataFrame, method: Method) -> DataFrame:
    """id and label of the segments that exact links join; links: what ``near.meet`` found.

    Strong links make groups that are compared as wholes. Of what is left, groups and pairs
    whose members are not joined yet are compared: groups of several in the same way, single
    pairs one by one."""
    place = F.struct("doc_id", "rid", "seg")

    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    small = ids.count() <= near.BROADCAST_IDS
    wanted = seen.join(F.broadcast(ids) if small else ids, "id").groupBy("id").agg(F.min(place).alias("at"))
    wanted = scratch.write(wanted.select("id", "at.rid", "at.seg"))
    items = scratch.write(_wanted_items(docs, wanted, method), wide=True)  # the texts are read once for both steps
    as_links = lambda labels: labels.filter("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))
    compare = lambda groups: near.settle(scratch, groups, method.labels, method.most_items, method.most_chars, method.central)
    sure, joined = links.filter("g is null").select("a", "b"), None
    if not sure.isEmpty():
        joined = scratch.write(as_links(compare(near.components(scratch, sure).join(items, "id"))))
    rest = links.filter("g is not null")
    if not rest.isEmpty():
        parts = near.components(scratch, joined).select("id", F.col("comp").alias("part")) if joined is not None and not joined.isEmpty() else None
        part_of = lambda d, e, to: d.withColumn(to, F.col(e)) if parts is None else d.join(parts.select(F.col("id").alias(e), F.col("part").alias(to)), e, "left").withColumn(to, F.coalesce(to, e))
        pairs = part_of(part_of(rest.filter(F.col("g") == near.PAIR).select("a", "b"), "a", "_p"), "b", "_q").filter("_p <> _q").select("a", "b")
        more = [method.pairs(_with_items(scratch, _hopeful(scratch, pairs, items, method), items)).select("a", "b")]
        larger = rest.filter(F.col("g") != near.PAIR)
        if not larger.isEmpty():
            ends = larger.select("g", F.col("a").alias("id")).unionByName(larger.select("g", F.col("b").alias("id"))).distinct()
            members = scratch.write(part_of(ends, "id", "part"))
            open_ = members.groupBy("g").agg(F.count(F.lit(1)).alias("_n"), F.min("part").alias("_p"), F.max("part").alias("_q")).filter("_p <> _q").select("g", "_n")
            members = scratch.write(members.join(open_, "g"))
            most = method.merged or near.MAX_ITEMS
            several = members.filter(f"_n <= {most}").select("g", "id", "part")
            large = members.filter(f"_n > {most}")
            if not large.isEmpty():  # the same lines meet in several blocks: one group of what they have in common
                ties = larger.join(large.select("g").distinct(), "g").select("a", "b")
                merged = large.select("id", "part").distinct().join(near.components(scratch, ties), "id")
                several = several.unionByName(merged.select(F.col("comp").alias("g"), "id", "part"))
            if not several.isEmpty():
                more.append(as_links(compare(several.join(items, "id").select(F.col("g").alias("comp"), "id", "item", "part"))))
        for m in more:
            joined = m if joined is None else joined.unionByName(m)
        joined = scratch.write(joined.distinct())
    if joined is None or joined.isEmpty():
        return None
    return near.components(scratch, joined).select("id", F.col("comp").alias("label"))


def removals(scratch: Scratch, docs: DataFrame, method: Method) -> DataFrame:
    """_rid and the places (seg, from 0) of its segments that go; documents that lose none are absent."""
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), row_id().alias("rid"), F.col("text").cast("string").alias("text"))
    seen = scratch.write(occurrences(texts, method))
    n = seen.count()
    links = candidate_links(scratch, texts, n, method)
    scratch.free()  # what was shuffled for them is twice the input
    place = F.struct("doc_id", "rid", "seg")
    scratch.few = links.count() <= FEW_ROWS
    linked = linked_segments(scratch, docs, seen, links, method)
    scratch.few = n <= FEW_ROWS
    scratch.drop(links)
    if linked is None:
        named = seen.withColumn("label", F.col("id"))
    else:
        small = linked.count() <= near.BROADCAST_IDS
        named = seen.join(F.broadcast(linked) if small else linked, "id", "left")
        # the second hash tells apart what is compared for equality only
        named = named.withColumn("id2", F.when(F.col("label").isNull(), F.col("id2"))).withColumn("label", F.coalesce("label", "id"))
    key = ["label", "id2"]
    named = named.select("doc_id", "rid", "seg", *key)
    repeated = named.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("keep")).filter("_n > 1")
    repeated = scratch.write(repeated.select(F.col("label").alias("_l"), F.col("id2").alias("_i"), F.col("keep.rid").alias("keep_rid"), F.col("keep.seg").alias("keep_seg")))
    gone = named.join(repeated.hint("merge"), (F.col("label") == F.col("_l")) & F.col("id2").eqNullSafe(F.col("_i")))
    gone = gone.filter((F.col("rid") != F.col("keep_rid")) | (F.col("seg") != F.col("keep_seg")))
    out = scratch.write(gone.groupBy(F.col("rid").alias("_rid")).agg(F.sort_array(F.collect_set("seg")).alias("_gone")))
    scratch.drop(seen, repeated)
    return out


def remove(docs: DataFrame, method: Method) -> DataFrame:
    """docs with its text shortened, and the columns n_segments and removed (places from 0)."""
    gone = removals(Scratch(docs.sparkSession, method.label), docs, method)
    rid, places = fresh(docs.columns, "_rid", "_gone")
    gone = gone.select(F.col("_rid").alias(rid), F.col("_gone").alias(places))
    d = docs.withColumn(rid, row_id()).join(gone.hint("shuffle_hash"), rid, "left")  # the same plan at every size
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(places, i)), "\n")
    return d.select(
        *[F.when(F.col(places).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_segments", "removed")],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_segments"),
        F.coalesce(places, F.array().cast("array<int>")).alias("removed"),
    )
