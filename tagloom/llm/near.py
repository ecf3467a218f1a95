"""What the near-duplicate operators share: shingle hashes, buckets, components, checks.

Items (documents, paragraphs, lines) equal after normalising are one class. A class has a
sketch and bucket keys. ``candidates`` (documents) and ``meet`` (lines and paragraphs, of
which there are many more) link classes that meet in a bucket and whose sketches are not
clearly apart; ``components`` gives connected groups of links; ``settle`` compares whole
items inside a group exactly. A group of candidates holds every link that a bucket shows,
so the exact step loses none, and no pair list is made: within a bucket or group only a
spanning forest of links is written.

Hot groups: copies are collapsed before; a bucket over ``BIG_BUCKET`` (``meet``: over
``HOT`` among the ``FLUSH`` items that a task holds at a time, or over ``BIG_PART``) links
all its members, those that other tasks hold too, to one leader (a superset of its links) without comparing them; a group
over ``MAX_ITEMS`` or ``MAX_CHARS`` is compared in blocks of bounded size, with a few of
its items first, so that near copies of one text take time in proportion to their number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, releasing

BIG_BUCKET, MAX_ITEMS, MAX_CHARS, SMALL_BUCKET, PAIRS_BUCKET, PIVOTS = 1024, 2048, 8_000_000, 6, 1024, 8
BROADCAST_IDS, DRIVER_LINKS = 400_000, 200_000
#: Bytes of groups that are compared in one go, as many short ones cost little more than a few.
TOGETHER = 4 << 20
FLUSH, HOT, BIG_PART, PART_ENTRIES, MAX_PARTS, TASK_PARTS = 16_384, 256, 8192, 1 << 18, 1 << 20, 12
_ENTRY = np.dtype([("key", "<u4"), ("id", "<i8"), ("sk", "<u8"), ("size", "u1")])
#: A size of 255 is a leader's: what it stands for may be near anything in its bucket.
STEP, STEPS, STAR = 1.05, 6, 255
#: The group of pairs that are in no larger one.
PAIR = 0

_rng = np.random.default_rng(7_654_321)
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE, _SEGMENT = 0xD1342543DE82EF95, 1 << 19
BLANKS = b" \t\n\x0b\x0c\r"
_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _SEGMENT + 4096)
        inverse = pow(_BASE, -1, 2**64)
        made = []
        for b in (_BASE, inverse):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word ``[^\\x20\\x09-\\x0D]+`` of a buffer, by prefix sums."""
    return _scan(buffer)[:2]


def _scan(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and bytes of each word."""
    hashes, starts, sizes, at = [], [], [], 0
    n = len(buffer)
    while at < n:
        end = n
        if n - at > _SEGMENT:  # cut before a blank
            end = max(buffer.rfind(b" ", at, at + _SEGMENT), buffer.rfind(b"\n", at, at + _SEGMENT))
            if end <= at:
                end = min((x for x in (buffer.find(b" ", at + _SEGMENT), buffer.find(b"\n", at + _SEGMENT)) if x > 0), default=n)
        a = np.frombuffer(buffer, np.uint8, end - at, at)
        word = np.empty(len(a) + 2, bool)
        word[0] = word[-1] = False
        np.logical_and(a != 32, a - np.uint8(9) > 4, out=word[1:-1])  # as BLANKS
        edge = np.flatnonzero(word[1:] != word[:-1])
        s, e = edge[::2], edge[1::2]
        up, down = _pow(len(a) + 1)
        total = np.empty(len(a) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _MULT))
        starts.append(s + at)
        sizes.append(e - s)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(sizes)


def binary(values: np.ndarray):
    """An Arrow array with the bytes of each row of a matrix."""
    import pyarrow as pa

    values = np.ascontiguousarray(values)
    width = values.shape[1] * values.itemsize
    ends = pa.py_buffer(np.arange(len(values) + 1, dtype=np.int32) * np.int32(width))
    return pa.BinaryArray.from_buffers(pa.binary(), len(values), [None, ends, pa.py_buffer(values)])


class _Stream:
    """The bytes of a buffer's words one after the other, without what is between them."""

    def __init__(self, buffer: bytes):
        self._buffer, self._bytes, self._windows = buffer, None, None

    def bytes(self) -> np.ndarray:
        if self._bytes is None:
            self._bytes = np.frombuffer(self._buffer.translate(None, BLANKS), np.uint8)
        return self._bytes

    def windows(self) -> np.ndarray:
        """The 8 bytes from each byte on, the first one lowest; zeros follow the last."""
        if self._windows is None:
            a = self.bytes()
            h = np.zeros(len(a) + 8, np.uint64)
            h[: len(a)] = a
            for step in (1, 2, 4):
                h[:-step] |= h[step:] << np.uint64(8 * step)
            self._windows = h[: len(a)]
        return self._windows


class Items:
    """Words of items that lie one after the other in a buffer.

    first[i]..first[i+1] are the words of item i."""

    def __init__(self, parts: list[bytes]):
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        begins = np.cumsum(sizes + 1) - sizes - 1
        buffer = b"\n".join(parts)
        self.words, starts, self.sizes = _scan(buffer)
        self.first = np.append(np.searchsorted(starts, begins), len(starts)).astype(np.int64)
        self.n_words = np.diff(self.first)
        place = np.append(0, np.cumsum(self.sizes))[self.first]
        self._begin, self._end, self._stream = place[:-1], place[1:], _Stream(buffer)

    def only(self, items: np.ndarray) -> Items:
        """The items at these places (rising)."""
        out = Items.__new__(Items)
        wanted = np.zeros(len(self.n_words), bool)
        wanted[items] = True
        kept = np.repeat(wanted, self.n_words)
        out.words, out.sizes, out.n_words = self.words[kept], self.sizes[kept], self.n_words[items]
        out.first = np.append(0, np.cumsum(out.n_words))
        out._begin, out._end, out._stream = self._begin[items], self._end[items], self._stream
        return out

    def grams(self, k: int, share: int = 0, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the stretches of k bytes (7 at most) of an item's words without the blanks, and first[i]..first[i+1] by item.

        Of the stretches one in 2**share is used, drawn by a hash of its own. own: the items that are wanted (rising), else all."""
        begin, end = (self._begin, self._end) if own is None else (self._begin[own], self._end[own])
        size, windows = end - begin, self._stream.windows()
        if share and len(size) and size.min() >= k and 2 * size.sum() > len(windows):  # nearly all: those used are looked for where they are
            h = windows & np.uint64((1 << 8 * k) - 1)
            used = np.flatnonzero(h * _MULT < np.uint64(1 << (64 - share)))
            s, e = np.searchsorted(used, begin), np.searchsorted(used, end - (k - 1))
            many = e - s
            first = np.append(0, np.cumsum(many))
            h = h[used[np.arange(first[-1]) + np.repeat(s - first[:-1], many)]]
            return mix(h + _MULT), first
        many = np.where(size >= k, size - k + 1, (size > 0).astype(np.int64))  # a stretch ends in its item; a shorter item is one
        first = np.append(0, np.cumsum(many))
        at = np.arange(first[-1])
        at += np.repeat(begin - first[:-1], many)
        h = windows[at]
        h &= np.uint64((1 << 8 * k) - 1)
        if (short := np.flatnonzero((size > 0) & (size < k))).size:
            h[first[short]] &= (np.uint64(1) << (8 * size[short]).astype(np.uint64)) - np.uint64(1)
        if share:
            used = np.flatnonzero(h * _MULT < np.uint64(1 << (64 - share)))
            h, first = h[used], np.searchsorted(used, first)
        return mix(h + _MULT), first

    def sequence_hashes(self) -> np.ndarray:
        """Two 64-bit hashes of each item's word sequence."""
        n, out = len(self.n_words), np.zeros((len(self.n_words), 2), np.uint64)
        full = np.flatnonzero(self.n_words)
        if len(full):
            place = (np.arange(len(self.words)) - np.repeat(self.first[:-1], self.n_words)).astype(np.uint64)
            for k in range(2):
                v = mix(self.words + mix(place * _MULT + np.uint64(k + 1)))
                out[full, k] = np.add.reduceat(v, self.first[:-1][full])
        return out if n else np.zeros((0, 2), np.uint64)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows and first[i]..first[i+1] by item; the whole sequence of an item with fewer words."""
        w, n = self.words, self.n_words
        many = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
        first = np.append(0, np.cumsum(many))
        at = np.repeat(self.first[:-1], many) + np.arange(first[-1]) - np.repeat(first[:-1], many)
        h = np.zeros(len(at), np.uint64)
        short = np.repeat((n < k) & (n > 0), many)
        length = np.repeat(n, many)
        for j in range(k):
            x = w[np.minimum(at + j, max(len(w) - 1, 0))] if len(w) else h
            if short.any():
                x = np.where(short & (j >= length), np.uint64(0), x)
            h = h * _MULT + x
        return mix(h + np.where(short, length, 0).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), first


def minima(hashes: np.ndarray, first: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """MinHash: (items, k) smallest values under k multipliers; items without shingles get the largest value."""
    mult = np.random.default_rng(seed).integers(0, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(first) - 1
    out = np.full((k, n), np.uint64(2**64 - 1))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(first, first[at] + 16_384, "right")) - 1)
        full = np.flatnonzero(np.diff(first[at : end + 1])) + at
        if len(full):
            h, starts = hashes[first[at] : first[end]], first[full] - first[at]
            buffer = np.empty_like(h)
            for j in range(k):
                np.multiply(h, mult[j], out=buffer)
                out[j, full] = np.minimum.reduceat(buffer, starts)
        at = end
    return out.T


def banding(threshold: float, rows: int, recall: float) -> int:
    """The fewest bands of so many rows that show a pair at the threshold with this probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(items, bands) keys of the first bands * rows minima."""
    out = np.empty((len(values), bands), np.int64)
    for b in range(bands):
        h = np.full(len(values), np.uint64(b + 1))
        for r in range(rows):
            h = mix(h * _MULT + values[:, b * rows + r])
        out[:, b] = h.view(np.int64)
    return out


# -- links inside buckets ---------------------------------------------------------------


def popcount_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which sketches differ."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


def samples_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """16-bit samples in which sketches differ."""
    return (a.view(np.uint16) != b.view(np.uint16)).sum(-1, dtype=np.int32)


def _labels(n: int, near, start: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable index of each of n, where near(i) tells which of i+1.. i is linked to; start: labels that are known."""
    label = np.arange(n) if start is None else start.copy()
    for i in range(n - 1):
        j = np.flatnonzero(near(i)) + i + 1
        if len(j):
            met = np.unique(np.append(label[j], label[i]))
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    return label


def _bucket_links(key, ids, sketch, apart, limit):
    """Links (smaller place first) of rows in order of key."""
    n = len(key)
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(begin, n))
    of = np.repeat(size, size)
    found = []
    small = of <= SMALL_BUCKET
    for d in range(1, min(SMALL_BUCKET, n)):
        i = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
        if not len(i):
            break
        for c in range(0, len(i), 200_000):
            k = i[c : c + 200_000]
            k = k[apart(sketch[k], sketch[k + d]) <= limit]
            found.append(np.stack([ids[k], ids[k + d]], 1))
    for s, m in zip(begin[size > SMALL_BUCKET], size[size > SMALL_BUCKET], strict=True):
        own = sketch[s : s + m]
        root = _labels(m, lambda i, own=own: apart(own[i], own[i + 1 :]) <= limit)
        j = np.flatnonzero(root != np.arange(m))
        found.append(np.stack([ids[s + root[j]], ids[s + j]], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _names(k: np.ndarray, i: np.ndarray) -> np.ndarray:
    return mix(mix(k.astype(np.uint64) + _MULT) ^ i.view(np.uint64)).view(np.int64)


def _pair_names(pair: np.ndarray) -> np.ndarray:
    """Groups of single pairs."""
    return _names(mix(pair[:, 0].copy().view(np.uint64)), pair[:, 1].copy())


def _bucket_clusters(key, ids, sketch, apart, strong, limit):
    """Strong links, and (group, id, id) links of what is further apart, of rows in order of key.

    A group is one pair in buckets of up to ``PAIRS_BUCKET``, else a part of a bucket that links of
    limit bits connect; those that strong links connect as a whole are left out."""
    n = len(key)
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:n])
    size = np.diff(np.append(begin, n))
    small = np.repeat(size <= SMALL_BUCKET, size)
    sure, rest = [np.zeros((0, 2), np.int64)], [np.zeros((0, 3), np.int64)]
    for d in range(1, min(SMALL_BUCKET, n)):
        i = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
        if not len(i):
            break
        for c in range(0, len(i), 200_000):
            k = i[c : c + 200_000]
            bits = apart(sketch[k], sketch[k + d])
            pair = np.sort(np.stack([ids[k], ids[k + d]], 1), axis=1)
            sure.append(pair[bits <= strong])
            far = pair[(bits > strong) & (bits <= limit)]
            rest.append(np.column_stack([_pair_names(far), far]))
    triangles: dict[int, tuple] = {}
    for s, m in zip(begin[size > SMALL_BUCKET], size[size > SMALL_BUCKET], strict=True):
        own = sketch[s : s + m]
        if m <= PAIRS_BUCKET:
            if m not in triangles:
                if len(triangles) > 64:
                    triangles.clear()
                triangles[m] = np.triu_indices(m, 1)
            i, j = triangles[m]
            bits = apart(own[i], own[j])
            near = np.flatnonzero(bits <= limit)
            i, j, bits = i[near], j[near], bits[near]
            root, tied = np.arange(m), bits <= strong
            if tied.any():
                ends, first = _reached(i[tied], j[tied])
                root[ends] = first
            linked = np.flatnonzero(root != np.arange(m))
            sure.append(np.stack([ids[s + root[linked]], ids[s + linked]], 1))
            far = root[i] != root[j]
            pair = np.sort(np.stack([ids[s + i[far]], ids[s + j[far]]], 1), axis=1)
            rest.append(np.column_stack([_pair_names(pair), pair]))
            continue
        root = _labels(m, lambda i, own=own: apart(own[i], own[i + 1 :]) <= strong)
        j = np.flatnonzero(root != np.arange(m))
        sure.append(np.stack([ids[s + root[j]], ids[s + j]], 1))
        wide = _labels(m, lambda i, own=own: apart(own[i], own[i + 1 :]) <= limit, root)
        mixed = np.flatnonzero(np.isin(wide, wide[root != wide]))
        mixed = mixed[wide[mixed] != mixed]
        if len(mixed):
            a, b = ids[s + wide[mixed]], ids[s + mixed]
            rest.append(np.column_stack([_names(np.full(len(a), key[s], np.uint64), a), a, b]))
    return np.concatenate(sure), np.concatenate(rest)


def by_group(batches, columns, run, least: int = 0):
    """Call run(table) on whole groups of a stream sorted by its first column, of least bytes unless it ends; yields what it returns."""
    import pyarrow as pa

    held: list = []

    def ready(last: bool):
        t = pa.Table.from_batches(held).select(columns).combine_chunks()
        held.clear()
        if not t.num_rows:
            return None
        key = t.column(0).to_numpy()
        cut = len(key) if last else int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if cut < len(key):
            held.extend(t.slice(cut).to_batches())
        return t.slice(0, cut) if cut else None

    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= least and (t := ready(False)) is not None:
            yield from run(t)
    if held and (t := ready(True)) is not None:
        yield from run(t)


def _fixed(column) -> np.ndarray:
    """(rows, bytes) of a binary column whose values have one length."""
    values = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def candidates(scratch: Scratch, keys: DataFrame, sketches: DataFrame, apart, limit: int) -> DataFrame:
    """Links (a, b) between classes that share a bucket.

    keys: key long, id long. sketches: id long, sk binary of one length. apart and limit:
    a function of two arrays of sketches and what it may be at most."""
    own = Window.partitionBy("key")
    members = keys.select("key", "id", F.count(F.lit(1)).over(own).alias("n"), F.min("id").over(own).alias("leader")).filter("n > 1")
    members = scratch.write(members)
    stars = members.filter((F.col("n") > BIG_BUCKET) & (F.col("id") != F.col("leader"))).select(F.col("leader").alias("a"), F.col("id").alias("b"))

    def link(batches):
        import pyarrow as pa

        def run(t):
            key, ids = t.column(0).to_numpy(), t.column(1).to_numpy()
            e = np.unique(np.sort(_bucket_links(key, ids, _fixed(t.column(2)), apart, limit), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

        yield from by_group(batches, ["key", "id", "sk"], run)

    small = members.filter(F.col("n") <= BIG_BUCKET).select("key", "id").join(sketches, "id").select("key", "id", "sk")
    linked = small.repartition(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "id").mapInArrow(releasing(link), "a long, b long")
    out = scratch.write(stars.unionByName(linked).distinct())
    scratch.drop(members)
    return out


def sized(sketch: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(n, 2) sketches of 64 bits and sizes in steps of a twentieth, for ``sized_apart``."""
    steps = np.minimum(STAR - 1, np.log(np.maximum(sizes, 1)) / np.log(STEP))
    return np.stack([sketch, steps.astype(np.uint64)], 1)


def sized_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which sketches differ; all of them if the sizes' ratio is surely under 0.8."""
    far = np.abs(a[..., 1].astype(np.int16) - b[..., 1].astype(np.int16)) > STEPS
    return np.where(far, 64, np.bitwise_count(a[..., 0] ^ b[..., 0]))


def _flush(held: list, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order of (part, key), where each part begins, and links of hot buckets, of held (kind, ids, keys, sketches)."""
    once = []  # each item once in each kind of blocks
    for kind in sorted({x[0] for x in held}):
        i, k, x = (np.concatenate(y) for y in zip(*[h[1:] for h in held if h[0] == kind], strict=True))
        new = np.unique(i, return_index=True)[1]
        once.append((i[new], k[new], x[new]))
    key = np.concatenate([k.ravel() for _, k, _ in once])
    many = np.concatenate([np.full(len(k), k.shape[1]) for _, k, _ in once])
    order = np.argsort(key)
    owner = np.repeat(np.arange(len(many)), many)[order]
    key, ids = key[order], np.concatenate([i for i, _, _ in once])[owner]
    sk = np.concatenate([x for _, _, x in once])[owner]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    size = np.diff(np.append(begin, len(key)))
    hot, links = np.repeat(size > HOT, size), np.zeros((0, 2), np.int64)
    if hot.any():
        leader = np.repeat(begin, size)
        later = hot & (leader != np.arange(len(key)))
        links = np.unique(np.stack([ids[leader[later]], ids[later]], 1), axis=0)
        sk[hot, 1] = STAR
        key, ids, sk = key[~later], ids[~later], sk[~later]
    out = np.empty(len(key), _ENTRY)
    out["key"], out["id"], out["sk"], out["size"] = key.astype(np.uint32), ids, sk[:, 0], sk[:, 1]
    part = (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    return out, np.searchsorted(part, np.arange(parts + 1)), links


def meet(scratch: Scratch, docs: DataFrame, items_of, n_items: int, blocks: int, strong: int, limit: int) -> DataFrame:
    """Links (g, a, b) between items that share a bucket and are limit bits apart at most (``sized_apart``).

    g is null for links of strong bits at most; others are in groups g (see ``_bucket_clusters``), single pairs in group ``PAIR``.
    items_of(batch) yields lists of (ids, keys, sketches) for slices of a batch of docs: longs (n), a
    key of 64 bits for each block (n, blocks), and what ``sized`` returns. n_items and
    blocks, about, tell how many parts the keys are dealt over. A key's upper half is its part, by
    range; its lower half is what is compared there. A task packs the entries of a part into
    one value for each ``FLUSH`` items, so what is shuffled and sorted is a few rows of bytes; a task reads
    ``TASK_PARTS`` parts, about 66 MB, so that its sort needs no disk at any size."""
    tasks = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    parts = int(min(MAX_PARTS, max(tasks, n_items * blocks // PART_ENTRIES + 1)))
    flush_at, readers = max(FLUSH, parts // 4), max(tasks, -(-parts // TASK_PARTS))

    def deal(batches):
        import pyarrow as pa

        def pack():
            entries, at, links = _flush(held, parts)
            held.clear()
            full = np.flatnonzero(np.diff(at))
            ends = pa.py_buffer((np.append(at[full], len(entries)) * _ENTRY.itemsize).astype(np.int32))
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(full), [None, ends, pa.py_buffer(entries)])
            stars = [links.tobytes() if k == 0 and len(links) else None for k in range(len(full))]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), blobs, pa.array(stars, pa.binary())], names=["part", "entries", "stars"])

        held, n = [], 0
        for batch in batches:
            for found in items_of(batch):
                for kind, one in enumerate(found):
                    held.append((kind, *one))
                n += max((len(x[0]) for x in found), default=0)
                if n >= flush_at:
                    yield from pack()
                    n = 0
        if held:
            yield from pack()

    def link(batches):
        import pyarrow as pa

        def run(t):
            part = t.column(0).to_numpy()
            begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            for s, e in zip(begin, np.append(begin[1:], len(part)), strict=True):
                x = np.frombuffer(b"".join(t.column(1)[int(i)].as_py() for i in range(s, e)), _ENTRY)
                key, ids, sk = x["key"].astype(np.uint64), x["id"].copy(), np.stack([x["sk"], x["size"].astype(np.uint64)], 1)
                order = np.argsort(key << np.uint64(32) | ids.view(np.uint64) & np.uint64(0xFFFFFFFF))
                key, ids = key[order], ids[order]
                starred = np.unique(key[sk[order, 1] == STAR])
                once = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))
                key, ids, order = key[once], ids[once], order[once]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                size = np.diff(np.append(first, len(key)))
                found = [np.frombuffer(y.as_py(), np.int64).reshape(-1, 2) for y in t.column(2)[int(s) : int(e)] if y.is_valid]
                of = np.repeat(size, size)
                big = (of > BIG_PART) | np.isin(key, starred)
                if big.any():
                    leader = np.repeat(first, size)
                    later = big & (leader != np.arange(len(key)))
                    found.append(np.stack([ids[leader[later]], ids[later]], 1))
                open_ = np.flatnonzero((of > 1) & ~big)
                rest = np.zeros((0, 3), np.int64)
                if len(open_):
                    sure, rest = _bucket_clusters(key[open_].astype(np.uint32), ids[open_], sk[order[open_]], sized_apart, strong, limit)
                    found.append(sure)
                    rest[rest[:, 0] == _pair_names(rest[:, 1:]), 0] = PAIR
                links = np.unique(np.sort(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(np.zeros(len(links), np.int64), rest[:, 0]), mask=np.arange(len(links) + len(rest)) < len(links)), pa.array(np.append(links[:, 0], rest[:, 1])), pa.array(np.append(links[:, 1], rest[:, 2]))],
                    names=["g", "a", "b"],
                )

        yield from by_group(batches, ["part", "entries", "stars"], run)

    dealt = docs.mapInArrow(releasing(deal), "part long, entries binary, stars binary")
    linked = dealt.repartition(readers, "part").sortWithinPartitions("part").mapInArrow(releasing(link), "g long, a long, b long")
    return scratch.write(linked.distinct())


def _reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in links (a, b), rising, and the smallest id that each reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while ((up := new[new]) != new).any():
            new = up
        if (new == label).all():
            return ids, ids[label]
        label = new


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """id and comp (the smallest id reachable) of every id in links (a, b).

    Each round points every node to its smallest neighbour, follows pointers to the end,
    and contracts; a round's tables are written, so lineage stays short and a lost
    executor costs one round at most. The number of rounds is logarithmic in practice.
    Up to ``DRIVER_LINKS`` links, by count, are followed on the driver."""
    import pyarrow as pa

    links = links.filter("a <> b").select("a", "b")
    if links.count() <= DRIVER_LINKS:  # a round costs more than all of them
        ids, comp = _reached(*(c.to_numpy() for c in links.toArrow().columns))
        return scratch.write(scratch.spark.createDataFrame(pa.table({"id": ids, "comp": comp})))
    edges = scratch.write(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = None
    while True:
        point = scratch.write(edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("comp")))
        while True:  # pointer jumping: a chain of length n ends after log n steps
            up = point.select(F.col("id").alias("comp"), F.col("comp").alias("_up"))
            new = scratch.write(point.join(up, "comp").select("id", F.col("_up").alias("comp"), (F.col("_up") != F.col("comp")).alias("moved")))
            moved = not new.filter("moved").isEmpty()
            scratch.drop(point)
            point = new.select("id", "comp")
            point._tagloom_path = new._tagloom_path
            if not moved:
                break
        if labels is None:
            labels = point
        else:
            up = point.select(F.col("id").alias("comp"), F.col("comp").alias("_up"))
            joined = scratch.write(labels.join(up, "comp", "left").select("id", F.coalesce("_up", "comp").alias("comp")))
            scratch.drop(labels, point)
            labels = joined
        # edges between groups; a group's name is one of its ids, so labels has the groups too
        left = edges.join(labels.select(F.col("id").alias("u"), F.col("comp").alias("cu")), "u").join(labels.select(F.col("id").alias("v"), F.col("comp").alias("cv")), "v")
        nxt = scratch.write(left.filter("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct())
        scratch.drop(edges)
        edges = nxt
        if edges.isEmpty():
            scratch.drop(edges)
            return labels


# -- exact comparison inside groups -----------------------------------------------------


def set_labels(texts: list[bytes], k: int, percent: int, start: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable over links with 100 * intersection >= percent * union of k-word shingle sets."""
    hashes, first = Items(texts).shingles(k)
    sets = [np.unique(hashes[first[i] : first[i + 1]]) for i in range(len(texts))]
    n, size = len(sets), np.array([len(x) for x in sets])
    if n == 2 and start is None:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([0, 0 if size.all() and 100 * both >= percent * (size.sum() - both) else 1])
    owner = np.repeat(np.arange(n), size)
    flat, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    owner, inverse = owner[keep], column[inverse[keep]]
    width = max(64, (1 << 24) // n // 64 * 64)
    common = np.zeros((n, n), np.int32)
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    for c in range(0, int(shared.sum()), width):
        s, e = np.searchsorted(inverse, [c, c + width])
        bits = np.zeros((n, width), bool)
        bits[owner[s:e], inverse[s:e] - c] = True
        rows = np.packbits(bits, axis=1).view(np.uint64)
        for i in range(n - 1):
            common[i, i + 1 :] += np.bitwise_count(rows[i] & rows[i + 1 :]).sum(1, dtype=np.int32)
    return _labels(n, lambda i: (size[i] > 0) & (100 * common[i, i + 1 :] >= percent * (size[i] + size[i + 1 :] - common[i, i + 1 :])), start)


def settle(scratch: Scratch, groups: DataFrame, labels_of, most_items: int | None = None, most_chars: int | None = None, central=None) -> DataFrame:
    """id and label of items of groups (comp long, id long, item binary) that are linked to others.

    label is another id that exact links reach, the smallest of a group where items have no part;
    ids that keep their own are absent. labels_of(list of (items, labels known
    or None, sides or None)) gives the smallest reachable index for each item of each group. One item may come several times.
    A third value given to it is None or each item's side: then items of one side need not be compared with each other.
    groups may have part, equal for items that are known to be linked; then one item for
    each part that is joined to another one has a row. An item of several groups may have several.
    most_items and most_chars: beyond these a group is compared in blocks. central(list of
    items) gives the index of the one that is most like all others, and how far it is from them."""
    most_items, most_chars = most_items or MAX_ITEMS, most_chars or MAX_CHARS
    groups = scratch.write(groups if "part" in groups.columns else groups.withColumn("part", F.col("id")), wide=True)
    size = groups.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("item")).alias("chars"))
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(most_items)), F.ceil(F.col("chars") / F.lit(most_chars))).cast("int")
    large = scratch.write(size.withColumn("_blocks", blocks).filter("_blocks > 1").select("comp", "_blocks"))

    def run_groups(batches):
        import pyarrow as pa

        def run(t):
            key, ids, items, parts = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2), t.column(3).to_numpy()
            sides = t.column(4).to_numpy() if t.num_columns > 4 else None
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            owns, given = [], []
            for s, e in zip(begin, np.append(begin[1:], len(key)), strict=True):
                own = ids[s:e]
                new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                own = own[new]
                if len(own) < 2:
                    continue
                part = parts[s:e][new]
                known, first, inverse = np.unique(part, return_index=True, return_inverse=True)
                owns.append((own, np.sort(first)))
                side = None if sides is None else sides[s:e][new]
                given.append(([items[int(s + i)].as_py() for i in new], first[inverse] if len(known) < len(part) else None, side if side is not None and side.any() else None))
            a, b = [], []
            for (own, first), root in zip(owns, labels_of(given) if given else [], strict=True):
                j = first[root[first] != first]  # a row for each part that is joined to another one
                a.append(own[j])
                b.append(own[root[j]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["id", "label"])

        yield from by_group(batches, ["key", "id", "item", "part", "side"], run, TOGETHER)

    tasks = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes may be much to compare: as many tasks as there may be

    def inside(keyed: DataFrame) -> DataFrame:
        keyed = keyed if "side" in keyed.columns else keyed.withColumn("side", F.lit(0))
        return keyed.repartition(tasks, "key").sortWithinPartitions("key", "id").mapInArrow(releasing(run_groups), "id long, label long")

    if large.isEmpty():
        return scratch.write(inside(groups.select(F.col("comp").alias("key"), "id", "item", "part")))
    done = inside(groups.join(large, "comp", "left_anti").select(F.col("comp").alias("key"), "id", "item", "part"))
    links = _large_links(scratch, groups.join(large, "comp"), inside, most_items, most_chars, central)
    if links.isEmpty():
        return scratch.write(done)
    return scratch.write(done.unionByName(components(scratch, links).select("id", F.col("comp").alias("label"))))


def _central(batches, central):
    """comp, id, item and far of the most central item of each group (key) of a stream."""
    import pyarrow as pa

    def run(t):
        key = t.column(0).to_numpy()
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        at, far = [], []
        for s, e in zip(begin, np.append(begin[1:], len(key)), strict=True):
            i, d = central([t.column(2)[int(j)].as_py() for j in range(s, e)])
            at.append(int(s) + i)
            far.append(float(d))
        rows = t.take(pa.array(at, pa.int64())).combine_chunks()
        yield pa.RecordBatch.from_arrays([rows.column(3).combine_chunks(), rows.column(1).combine_chunks(), rows.column(2).combine_chunks(), rows.column(4).combine_chunks(), pa.array(far)], names=["comp", "id", "item", "part", "far"])

    yield from by_group(batches, ["key", "id", "item", "comp", "part"], run)


def _large_links(scratch: Scratch, big: DataFrame, inside, most_items: int, most_chars: int, central=None) -> DataFrame:
    """Links (a, b) that join what exact links join in large groups (comp, id, item, _blocks).

    First the items are dealt over half blocks, and each half block is compared together
    with ``PIVOTS`` items of its group, the most central ones if ``central`` finds them: that costs a share of the group's size, and joins
    most of what near copies of one text there are. Then only items outside the group's
    largest part are compared with all that are in other parts, in pairs of half blocks."""
    half = lambda x, n: F.pmod(F.xxhash64(x), n).cast("int")
    tasks = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    big = big.withColumn("_m", (2 * F.col("_blocks")).cast("int"))
    if central is None:
        pivots = big.groupBy("comp", "_m", half("id", F.lit(PIVOTS)).alias("_k")).agg(F.min_by(F.struct("id", "item", "part"), F.xxhash64("id", F.lit(1))).alias("_p"))
    else:  # of the most central items of the half blocks, those that are nearest to their others
        keyed = big.select(F.xxhash64("comp", half("id", F.col("_m"))).alias("key"), "id", "item", "comp", "part").repartition(tasks, "key").sortWithinPartitions("key", "id")
        middle = keyed.mapInArrow(releasing(lambda b: _central(b, central)), "comp long, id long, item binary, part long, far double").join(big.select("comp", "_m").distinct(), "comp")
        pivots = middle.groupBy("comp", "_m", half("id", F.lit(PIVOTS)).alias("_k")).agg(F.min_by(F.struct("id", "item", "part"), F.struct("far", "id")).alias("_p"))
    pivots = pivots.select("comp", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_at"), "_p.*")
    dealt = big.select("comp", half("id", F.col("_m")).alias("_at"), "id", "item", "part").unionByName(pivots)
    as_links = lambda keyed: inside(keyed).filter("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b")).distinct()
    links = scratch.write(as_links(dealt.select(F.xxhash64("comp", "_at").alias("key"), "id", "item", "part")))
    part = big.select("comp", "id", F.col("part").alias("_known")).distinct()
    if not links.isEmpty():  # those of one part beforehand are linked as well
        ties = links.unionByName(big.filter("id <> part").select(F.col("id").alias("a"), F.col("part").alias("b"))).distinct()
        part = part.join(components(scratch, ties).select("id", F.col("comp").alias("_part")), "id", "left")
    else:
        part = part.withColumn("_part", F.lit(None).cast("long"))
    part = scratch.write(part.select("comp", "id", F.coalesce("_part", "_known", "id").alias("_part")))
    sizes = part.groupBy("comp", "_part").agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.groupBy("comp").agg(F.max_by("_part", F.struct("_n", "_part")).alias("_main"))
    rest = scratch.write(part.join(largest, "comp").filter(F.col("_part") != F.col("_main")).select("comp", "id"))
    if rest.isEmpty():
        return links
    found = big.join(part, ["comp", "id"]).join(rest.withColumn("_out", F.lit(True)), ["comp", "id"], "left").withColumn("_out", F.col("_out").isNotNull())
    size = found.filter("_out").groupBy("comp").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length("item")).alias("_c"))
    # blocks of what is outside, each half a block at most
    size = size.select("comp", F.greatest(F.ceil(2 * F.col("_n") / F.lit(most_items)), F.ceil(2 * F.col("_c") / F.lit(most_chars))).cast("int").alias("_u"))
    found = found.join(size, "comp").withColumn("_at", F.when(F.col("_out"), half("id", F.col("_u"))).otherwise(half("id", F.col("_m"))))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    with_main = lambda u, m: F.xxhash64("comp", F.lit("main"), u, m)
    sided = lambda key, side: F.struct(key.alias("key"), side.cast("int").alias("side"))
    # a half block is compared in itself once, where it meets itself; elsewhere only with the other one
    outside = F.concat(
        F.transform(every(F.col("_u")), lambda b: sided(F.xxhash64("comp", F.lit("rest"), F.least("_at", b), F.greatest("_at", b)), F.when(F.col("_at") == b, 0).when(F.col("_at") < b, 1).otherwise(2))),
        F.transform(every(F.col("_m")), lambda m: sided(with_main(F.col("_at"), m), F.lit(1))),
    )
    keys = F.when(F.col("_out"), outside).otherwise(F.transform(every(F.col("_u")), lambda u: sided(with_main(u, F.col("_at")), F.lit(2))))
    found = found.select(F.explode(keys).alias("_k"), "id", "item", F.col("_part").alias("part"))
    return scratch.write(links.unionByName(as_links(found.select("_k.key", "id", "item", "part", "_k.side"))))


def only_ids(docs: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows of docs whose column is in wanted; broadcast if that is small, else by shuffle."""
    wanted = wanted.select(column).distinct()
    small = wanted.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(wanted) if small else wanted, column, "left_semi")
