"""Sequencing records as DataFrames: FASTQ, SAM and BAM.

``open_reads`` gives, for any of them, one row a record: group, file, ordinal, and a string
column for each wanted tag. FASTQ has name (with its @), seq and qual; SAM and BAM have
query and the auxiliary tags. SAM is read as text by Spark's own reader; FASTQ and BAM by
Python data sources, BAM in parallel by BGZF blocks. Files are opened through pyarrow's
file systems, so local paths and URIs that these know both work.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tagloom.config import InputFile
from tagloom.operators.combos import zip_mates

FASTQ_TAGS = ("name", "seq", "qual")
SEQUENCE = "=ACMGRSVTWYHKDBN"
#: Ordinals of these are (piece << bits) + place in the piece.
PIECE_BITS = {"bam": 24, "sam": 33}


class UnknownFileType(ValueError):
    pass


def kind_of(path: str) -> str:
    for end, kind in ((".bam", "bam"), (".sam", "sam"), (".fastq.gz", "fastq"), (".fq.gz", "fastq"), (".fastq", "fastq"), (".fq", "fastq")):
        if path.endswith(end):
            return kind
    raise UnknownFileType(path)


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        system, at = fs.FileSystem.from_uri(path)
    else:
        system, at = fs.LocalFileSystem(), path
    return system.open_input_file(at)


# -- FASTQ ------------------------------------------------------------------------------


def fastq_records(lines: Iterator[bytes]) -> Iterator[tuple[str, str, str]]:
    """Name, sequence and quality; ends at the first blank name line."""
    lines = iter(lines)
    for name in lines:
        if not (name := name.rstrip(b"\r\n")):
            return
        seq, _, qual = (next(lines, b"").rstrip(b"\r\n") for _ in range(3))
        yield name.decode(), seq.decode(), qual.decode()


class FastqSource(DataSource):
    """One partition a file: a gzip stream can't be split. Options: path (several by commas), tags."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return "ordinal long, " + ", ".join(f"`{t}` string" for t in _tags(self.options, FASTQ_TAGS))

    def reader(self, schema):
        return FastqReader(self.options)


@dataclass
class Piece(InputPartition):
    path: str
    start: int = 0
    end: int = 0

    def __post_init__(self):
        super().__init__((self.path, self.start, self.end))


def _tags(options, default=()) -> list[str]:
    return [t for t in (options.get("tags") or ",".join(default)).split(",") if t]


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.tags = options["path"].split(","), _tags(options, FASTQ_TAGS)

    def partitions(self):
        return [Piece(p) for p in self.paths]

    def read(self, piece):
        at = [FASTQ_TAGS.index(t) if t in FASTQ_TAGS else None for t in self.tags]
        with _open(piece.path) as raw:
            stream = gzip.GzipFile(fileobj=raw) if piece.path.endswith(".gz") else raw
            for i, r in enumerate(fastq_records(_lines(stream))):
                yield (i, *[None if k is None else r[k] for k in at])


def _lines(raw, size: int = 1 << 22) -> Iterator[bytes]:
    rest = b""
    while data := raw.read(size):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


# -- BAM --------------------------------------------------------------------------------


def bgzf_blocks(f) -> Iterator[tuple[int, int]]:
    """Offset and size of each block; only headers are read."""
    at, end = 0, f.size()
    while at < end:
        f.seek(at)
        head = f.read(12)
        if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError(f"no BGZF block at {at}")
        extra = f.read(struct.unpack_from("<H", head, 10)[0])
        i, size = 0, None
        while i < len(extra):
            tag, n = extra[i : i + 2], struct.unpack_from("<H", extra, i + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", extra, i + 4)[0] + 1
            i += 4 + n
        if size is None:
            raise ValueError(f"no block size at {at}")
        yield at, size
        at += size


def bgzf_read(f, at: int) -> tuple[bytes, int]:
    """Inflated block and the offset of the next; empty at the end of the file."""
    if at >= f.size():
        return b"", at
    f.seek(at)
    head = f.read(12)
    n = struct.unpack_from("<H", head, 10)[0]
    extra = f.read(n)
    i = 0
    while extra[i : i + 2] != b"BC":
        i += 4 + struct.unpack_from("<H", extra, i + 2)[0]
    size = struct.unpack_from("<H", extra, i + 4)[0] + 1
    return zlib.decompress(f.read(size - 12 - n - 8), -15), at + size


_SCALARS = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def bam_record(data: bytes) -> dict[str, str]:
    """query and auxiliary tags of a record (without its size)."""
    n_name, n_cigar, n_seq = data[8], struct.unpack_from("<H", data, 12)[0], struct.unpack_from("<i", data, 16)[0]
    at = 32 + n_name + 4 * n_cigar
    packed = data[at : at + (n_seq + 1) // 2]
    seq = "".join(SEQUENCE[b >> 4] + SEQUENCE[b & 15] for b in packed)[:n_seq]
    at += (n_seq + 1) // 2 + n_seq
    out = {"query": seq}
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            out[tag] = data[at:end].decode()
            at = end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{_SCALARS[sub]}", data, at + 5)
            out[tag] = ",".join(map(str, values))
            at += 5 + n * struct.calcsize(_SCALARS[sub])
        else:
            (v,) = struct.unpack_from("<" + _SCALARS[kind], data, at)
            out[tag] = v.decode() if kind == "A" else str(v)
            at += struct.calcsize(_SCALARS[kind])
    return out


def _plausible(data: bytes, at: int, n_refs: int) -> bool:
    """Whether a record may start here: its fields agree with each other."""
    if at + 36 > len(data):
        return False
    size, ref, pos, n_name, _, _, n_cigar, _, n_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if size < 32 or not -1 <= ref < n_refs or not -1 <= mate < n_refs or pos < -1 or mate_pos < -1 or n_name < 1 or n_seq < 0:
        return False
    if 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq > size or size > 1 << 28:
        return False
    end = at + 36 + n_name - 1
    return end >= len(data) or data[end] == 0 and all(33 <= c <= 126 for c in data[at + 36 : end])


def record_start(data: bytes, n_refs: int, last: bool) -> int | None:
    """Offset of the first record of data cut at any place: a chain of records follows from it."""
    for at in range(len(data) - 4):
        i, n = at, 0
        while n < 8 and _plausible(data, i, n_refs):
            i += 4 + struct.unpack_from("<i", data, i)[0]
            n += 1
        if n and (n == 8 or i == len(data) or (i > len(data) - 36 and (n > 1 or not last))):
            return at
    return None


def bam_header(f) -> tuple[int, int, int]:
    """Number of references, and the block and place in it of the first record."""
    data, at, starts = b"", 0, []

    def need(n):
        nonlocal data, at
        while len(data) < n:
            starts.append((len(data), at))
            more, at = bgzf_read(f, at)
            if not more and at >= f.size():
                raise ValueError("BAM header is cut off")
            data += more

    need(8)
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    i = 8 + struct.unpack_from("<i", data, 4)[0]
    need(i + 4)
    n_refs = struct.unpack_from("<i", data, i)[0]
    i += 4
    for _ in range(n_refs):
        need(i + 4)
        i += 8 + struct.unpack_from("<i", data, i)[0]
        need(i)
    begin, block = max((s for s in starts if s[0] <= i), default=(0, 0))
    return n_refs, block, i - begin


class BamSource(DataSource):
    """Options: path (several by commas), tags, blocks (BGZF blocks a partition, 500 by default: 32 MB inflated)."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return "ordinal long, " + ", ".join(f"`{t}` string" for t in _tags(self.options, ("query",)))

    def reader(self, schema):
        return BamReader(self.options)


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.tags, self.blocks = options["path"].split(","), _tags(options, ("query",)), int(options.get("blocks") or 500)

    def partitions(self):
        out = []
        for p in self.paths:
            with _open(p) as f:
                offsets = [at for at, _ in bgzf_blocks(f)]
                cuts = offsets[:: self.blocks] + [f.size()]
            out += [Piece(p, s, e) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def read(self, piece):
        """Records that start in the piece's blocks; ordinal is (offset of the piece << 24) + place."""
        with _open(piece.path) as f:
            n_refs, block, place = bam_header(f)
            at, end = max(piece.start, block), f.size()
            if at >= piece.end:
                return
            parts, own = [], 0
            first = at == block
            while at < piece.end:
                more, at = bgzf_read(f, at)
                parts.append(more)
            data = b"".join(parts)
            own = len(data)
            i = place if first else record_start(data, n_refs, piece.end >= end)
            n = 0
            while i is not None and i < own:
                while i + 4 > len(data) or i + 4 + struct.unpack_from("<i", data, i)[0] > len(data):
                    if at >= end:
                        return
                    more, at = bgzf_read(f, at)
                    data += more
                size = struct.unpack_from("<i", data, i)[0]
                tags = bam_record(data[i + 4 : i + 4 + size])
                yield ((piece.start << 24) + n, *[tags.get(t) for t in self.tags])
                n += 1
                i += 4 + size


# -- SAM and the registry ---------------------------------------------------------------


def read_sam(spark: SparkSession, path: str, tags: list[str]) -> DataFrame:
    """ordinal rises along the file; it is no count."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.length("value") > 0)).withColumn("ordinal", F.monotonically_increasing_id())
    cells = F.split("value", "\t")
    aux = F.slice(cells, 12, 1_000_000)
    find = lambda t: F.regexp_replace(F.get(F.filter(aux, lambda x: x.startswith(f"{t}:")), F.lit(0)), "^[^:]*:[^:]*:", "")
    return lines.select("ordinal", *[(F.get(cells, F.lit(9)) if t == "query" else find(t)).alias(t) for t in tags])


def numbered(reads: DataFrame, bits: int) -> DataFrame:
    """reads with their places in the file as ordinals, where these were (piece << bits) + place in the piece.

    The records of each piece are counted and the counts summed up, one row for each piece."""
    d = reads.withColumn("_piece", F.shiftright("ordinal", bits))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = d.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n")).select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.col("ordinal") - F.shiftleft("_piece", bits)
    return d.join(bases, "_piece").withColumn("ordinal", F.col("_base") + place).select(*reads.columns)


def read_file(spark: SparkSession, path: str, tags: list[str], blocks: int = 500) -> DataFrame:
    """ordinal and tags of a file."""
    kind = kind_of(path)
    if kind == "sam":
        return read_sam(spark, path, tags)
    spark.dataSource.register(FastqSource if kind == "fastq" else BamSource)
    return spark.read.format(kind).option("tags", ",".join(tags)).option("blocks", blocks).load(path)


def open_reads(spark: SparkSession, files: list[InputFile], tags: list[str]) -> DataFrame:
    """Tag columns (prefix and tag) of one input group; its files are mates, joined place by place, up to the end of the shortest.

    SAM and BAM mates are scanned twice, as their places in the file are counted first. tags: with prefixes; only these are read."""
    tables = []
    for f in files:
        own = [t[len(f.prefix) :] for t in tags if t.startswith(f.prefix)] if f.prefix else list(tags)
        d = read_file(spark, f.path, own)
        if len(files) > 1 and (kind := kind_of(f.path)) in PIECE_BITS:
            d = numbered(d, PIECE_BITS[kind])
        tables.append((f.prefix, d))
    if len(tables) == 1:
        p, d = tables[0]
        return d.select(*[F.col(c).alias(p + c) for c in d.columns if c != "ordinal"])
    return zip_mates(tables, ("ordinal",)).drop("ordinal")


def union_groups(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
