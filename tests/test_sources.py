"""Sources, sinks and the staged pipeline on files made here."""

import gzip
import json
import random
import struct
import zlib

import pytest

from tagloom import cli, config
from tagloom.sources import records, tables


def bgzf(data: bytes, block: int) -> bytes:
    """data in BGZF blocks of the given size, with the empty block that ends a file."""
    out = b""
    for part in [data[i : i + block] for i in range(0, len(data), block)] + [b""]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
        out += head + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def bam(reads, block=700, refs=2) -> bytes:
    text = b"@HD\tVN:1.6\n"
    data = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", refs)
    for i in range(refs):
        name = b"r%d\0" % i
        data += struct.pack("<i", len(name)) + name + struct.pack("<i", 1000)
    for k, (seq, tags) in enumerate(reads):
        name = b"read%d\0" % k
        codes = [records.SEQUENCE.index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
        aux = b"".join(t.encode() + b"Z" + v.encode() + b"\0" for t, v in tags.items()) + b"NMi" + struct.pack("<i", 3)
        body = struct.pack("<iiBBHHHiiii", -1, -1, len(name), 0, 0, 0, 4, len(seq), -1, -1, 0) + name + packed + b"\xff" * len(seq) + aux
        data += struct.pack("<i", len(body)) + body
    return bgzf(data, block)


@pytest.fixture
def reads():
    r = random.Random(5)
    return [("".join(r.choice("ACGTN") for _ in range(r.randint(1, 60))), {"B2": f"T{k}"}) for k in range(300)]


@pytest.mark.parametrize("blocks", [1, 3, 1000])
def test_bam_pieces_make_the_whole(spark, tmp_path, reads, blocks):
    path = tmp_path / "a.bam"
    path.write_bytes(bam(reads))
    d = records.read_file(spark, str(path), ["query", "B2", "NM", "XX"], blocks).orderBy("ordinal").collect()
    assert [(r["query"], r["B2"]) for r in d] == [(s, t["B2"]) for s, t in reads]
    assert {(r["NM"], r["XX"]) for r in d} == {("3", None)}


def test_bam_with_a_long_header_and_no_reads(spark, tmp_path):
    path = tmp_path / "b.bam"
    path.write_bytes(bam([], block=20, refs=50))
    assert records.read_file(spark, str(path), ["query"], 2).count() == 0


def test_fastq(spark, tmp_path):
    text = b"@a x\nACGT\n+\nIIII\n@b\nGG\n+\nII\n\n@never\nA\n+\nI\n"
    (tmp_path / "a.fastq").write_bytes(text)
    with gzip.open(tmp_path / "a.fastq.gz", "wb") as f:
        f.write(text)
    for name in ("a.fastq", "a.fastq.gz"):
        d = records.read_file(spark, str(tmp_path / name), ["seq", "name"]).orderBy("ordinal").collect()
        assert [(r["name"], r["seq"]) for r in d] == [("@a x", "ACGT"), ("@b", "GG")]
    with pytest.raises(records.UnknownFileType):
        records.kind_of("a.txt")


def test_sam(spark, tmp_path):
    line = "r{0}\t4\t*\t0\t0\t*\t*\t0\t0\t{1}\tII\tRG:Z:g\tB2:Z:{2}\n"
    (tmp_path / "a.sam").write_text("@HD\tVN:1\n" + line.format(0, "ACG", "T:T") + line.format(1, "GG", "C"))
    d = records.read_file(spark, str(tmp_path / "a.sam"), ["query", "B2", "ZZ"]).orderBy("ordinal").collect()
    assert [(r["query"], r["B2"], r["ZZ"]) for r in d] == [("ACG", "T:T", None), ("GG", "C", None)]


def test_mates_are_zipped(spark, tmp_path):
    (tmp_path / "1.fastq").write_text("@a\nAA\n+\nII\n@b\nCC\n+\nII\n")
    (tmp_path / "2.fastq").write_text("@a\nGG\n+\nII\n")
    files = [config.InputFile(str(tmp_path / f"{i}.fastq"), "", f"R{i}") for i in (1, 2)]
    assert [tuple(r) for r in records.open_reads(spark, files, ["R1seq", "R2seq"]).collect()] == [("AA", "GG")]


@pytest.fixture
def project(tmp_path):
    (tmp_path / "in.csv").write_text("file,group,prefix\nr.fastq,,R1\n")
    (tmp_path / "regex.csv").write_text('prefix,tag,regex\nR1,seq,"^(?P<sample>[ACGT]{5})(?P<grna>[ACGT]{3})(?P<lid>[ACGT]+)"\n')
    (tmp_path / "sample.csv").write_text("name,barcode\ns0,ACGTA\ns1,TTTTT\n")
    (tmp_path / "grna.csv").write_text("name,barcode,extra\ng0,AAA,1\ng1,CCC,2\n")
    (tmp_path / "bc.csv").write_text("barcode,type,referencefile,threshold,min_length,max_length\nsample,reference,sample.csv,auto,-,-\ngrna,reference,grna.csv,0,-,-\nlid,random,-,-,6,6\n")
    (tmp_path / "th.csv").write_text("sample,threshold\ns0,2\n")
    (tmp_path / "cat.csv").write_text("grna,category\ng0,control\ng1,x\n")
    reads = ["ACGTAAAAGGGGGG"] * 9 + ["ACGTCAAAGGGGGT"] + ["ACGTACCCTTTTTT"] * 4 + ["TTTTTAAACACACA"] * 3 + ["GGG"]
    (tmp_path / "r.fastq").write_text("".join(f"@{i}\n{s}\n+\n{s}\n" for i, s in enumerate(reads)))
    return tmp_path


def test_stages_end_to_end(spark, project):
    run = lambda *a: cli.main([*a], spark)
    at = lambda x: str(project / x)
    out = ["--outdir", at("out")]
    run("demultiplex", at("in.csv"), *out, "--regex-file", at("regex.csv"), "--barcode-file", at("bc.csv"))
    run("error-correct", *out, "--barcode-file", at("bc.csv"))
    run("hopping-removal", "sample", "sample,grna", *out)
    run("threshold", *out, "--threshold-file", at("th.csv"))
    run("pvalue", *out, "--category-file", at("cat.csv"), "--N", "1000")
    d = tables.read_table(spark, at("out/data/error_correct.parquet"))
    assert sorted(tuple(r) for r in d.select("sample", "grna", "lid", "reads").collect()) == [("s0", "g0", "GGGGGG", 10), ("s0", "g1", "TTTTTT", 4), ("s1", "g0", "CACACA", 3)]
    assert sorted(r["lid"] for r in tables.read_table(spark, at("out/data/threshold.parquet")).collect()) == ["GGGGGG", "TTTTTT"]
    assert json.loads((project / "out/stats/error_correct_statistics.json").read_text()) == {"lids_before": 4, "lids_after": 3, "reads_before": 17, "reads_after": 17}
    assert tables.read_table(spark, at("out/data/pvalues.csv")).count() == 2
    made = (project / "out/data/demultiplex.parquet").stat().st_mtime_ns
    run("demultiplex", at("in.csv"), *out, "--regex-file", at("regex.csv"), "--barcode-file", at("bc.csv"))
    assert (project / "out/data/demultiplex.parquet").stat().st_mtime_ns == made
    (project / "r.fastq").write_text("@0\nACGTAAAAGGGGGG\n+\nI\n")
    run("demultiplex", at("in.csv"), *out, "--regex-file", at("regex.csv"), "--barcode-file", at("bc.csv"))
    assert tables.read_table(spark, at("out/data/demultiplex.parquet")).first()["reads"] == 1
    run("to-csv", at("out/data/demultiplex.parquet"), at("x.csv"))
    run("to-parquet", at("x.csv"), at("y.parquet"))
    run("merge", at("y.parquet"), at("y.parquet"), "--out", at("z.parquet"))
    assert tables.read_table(spark, at("z.parquet")).first()["reads"] == 2


def test_config_readers(project):
    h = config.read_hierarchy(str(project / "bc.csv"))
    assert [(b.name, b.kind, b.threshold, b.min_length) for b in h] == [("sample", "reference", 1, None), ("grna", "reference", 0, None), ("lid", "random", 0, 6)]
    (project / "bad.csv").write_text("tag,regex\nXX,a\n")
    with pytest.raises(KeyError):
        config.read_regexes(str(project / "bad.csv"))
    (project / "f.csv").write_text("file\na.bam\nb.bam\n")
    assert list(config.read_inputs(str(project / "f.csv"))) == ["a.bam", "b.bam"]


def test_mates_of_sam_files_with_unlike_lines_stay_in_order(spark, tmp_path):
    n, files = 3000, []
    for k, width in ((1, 4), (2, 90)):
        p = tmp_path / f"r{k}.sam"
        p.write_text("@HD\tx\n" + "".join(f"q{i}\t0\t*\t0\t0\t*\t*\t0\t0\t{'ACGT' * width}\t*\tBC:Z:{k}_{i}\n" for i in range(n + (5 if k == 2 else 0))))
        files.append(records.InputFile(str(p), "g", f"R{k}"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = records.open_reads(spark, files, ["R1BC", "R2BC"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["R1BC"], r["R2BC"]) for r in got) == sorted((f"1_{i}", f"2_{i}") for i in range(n))
