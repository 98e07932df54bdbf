"""Files: splits, gzip, damaged records, archives and the command line."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from readlake import api, cli
from readlake.sources import archive, files


def fastq(n: int, seed: int = 1, quality: str = "@+F:") -> str:
    r, out = random.Random(seed), []
    for i in range(n):
        size = r.randint(1, 60)
        bases = "".join(r.choice("ACGTNacgt") for _ in range(size))
        comment = r.choice(["+", f"+run.{i} x/{size}", "+other"])
        out += [f"@run.{i} x/{size}", bases, comment, "".join(r.choice(quality) for _ in range(size))]
    return "\n".join(out) + "\n"


def rows(df):
    return [tuple(r) for r in df.orderBy("file_idx", "rec").select("id", "bases", "comment", "qual").collect()]


def records(text: str):
    lines = text.split("\n")[:-1]
    return [tuple(lines[i : i + 4]) for i in range(0, len(lines), 4)]


@pytest.mark.parametrize("split", [1 << 20, 997, 203])
def test_splits(spark, tmp_path, split):
    text = fastq(120)
    (tmp_path / "a.fastq").write_text(text)
    assert rows(api.open_reads(spark, str(tmp_path / "a.fastq"), split_bytes=split)) == records(text)


def test_quality_of_plus_signs(spark, tmp_path):
    text = fastq(60, quality="+")
    (tmp_path / "a.fastq").write_text(text)
    assert rows(api.open_reads(spark, str(tmp_path / "a.fastq"), split_bytes=301)) == records(text)


def test_gzip_by_content_all_members(spark, tmp_path):
    a, b = fastq(20, 1), fastq(20, 2)
    (tmp_path / "x.fastq").write_bytes(gzip.compress(a.encode()) + gzip.compress(b.encode()))
    assert rows(api.open_reads(spark, str(tmp_path / "x.fastq"))) == records(a) + records(b)


def test_line_ends_and_damage(spark, tmp_path):
    good = fastq(5)
    (tmp_path / "crlf").write_bytes(good.replace("\n", "\r\n").encode())
    assert rows(api.open_reads(spark, str(tmp_path / "crlf"))) == records(good)
    (tmp_path / "bad").write_text(good + "@x\nAC\n+\nF\n" + good)
    assert len(rows(api.open_reads(spark, str(tmp_path / "bad")))) == 11
    assert rows(api.open_reads(spark, str(tmp_path / "bad"), "DROPMALFORMED")) == records(good) * 2
    with pytest.raises(Exception, match="no valid record"):
        api.open_reads(spark, str(tmp_path / "bad"), "FAILFAST").collect()


def test_blank_lines(tmp_path):
    (tmp_path / "t").write_text("\nA\n\nBC\n\n\n")
    assert [x for _, x in files.lines(str(tmp_path / "t"))] == [b"", b"A", b"", b"BC", b"", b""]


def test_content_md5(tmp_path):
    text = b">chr1\nATCG\n" * 100
    (tmp_path / "a.fa").write_bytes(text)
    (tmp_path / "b").write_bytes(gzip.compress(text))
    assert files.content_md5(str(tmp_path / "a.fa")) == files.content_md5(str(tmp_path / "b")) and files.content_md5(str(tmp_path / "b"))[1] == len(text)


def test_fasta(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 first\nATCG\nNNAC\n\n>chr2\nGG\n")
    df = api.open_reference(spark, str(tmp_path / "g.fa"))
    assert [tuple(r) for r in df.orderBy("base0").collect()] == [(0, "chr1", 0, "ATCGNNAC"), (0, "chr2", 8, "GG")]


def genome(n: int, seed: int = 9) -> str:
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def mapped_reads(g: str, n: int) -> str:
    r, out = random.Random(4), []
    for i in range(n):
        at, size = r.randrange(len(g) - 80), r.choice([20, 60, 80])
        s = list(g[at : at + size])
        s[r.randrange(size)] = r.choice("ACGTN")
        s = "".join(s)
        if i % 3 == 0:
            s = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        out += [f"@r.{i}", s.lower() if i % 7 == 0 else s, "+", "F" * size]
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("with_reference", [False, True])
def test_archive_round_trip(spark, tmp_path, with_reference):
    g = genome(3000)
    (tmp_path / "g.fa").write_text(">c1\n" + g[:1000] + "\n>c2\n" + g[1000:] + "\n")
    text = mapped_reads(g, 80) if with_reference else fastq(80)
    (tmp_path / "r.fastq").write_text(text)
    ref = str(tmp_path / "g.fa") if with_reference else None
    out = str(tmp_path / "r.rla")
    api.compress(spark, str(tmp_path / "r.fastq"), out, ref)
    segments = api.open_reference(spark, ref) if ref else None
    assert rows(archive.read(spark, out, segments)) == records(text)
    assert archive.damaged(spark, out, segments).count() == 0
    api.decompress(spark, out, str(tmp_path / "back"), ref)
    assert "".join(p.read_text() for p in sorted((tmp_path / "back").glob("part-*"))) == text
    with pytest.raises(Exception):
        api.compress(spark, str(tmp_path / "r.fastq"), out, ref)


def test_region_query_and_index(spark, tmp_path):
    g = genome(3000)
    (tmp_path / "g.fa").write_text(">c1\n" + g[:1000] + "\n>c2\n" + g[1000:] + "\n")
    (tmp_path / "r.fastq").write_text(mapped_reads(g, 60))
    api.compress(spark, str(tmp_path / "r.fastq"), str(tmp_path / "r.rla"), str(tmp_path / "g.fa"))
    got = api.query(spark, str(tmp_path / "r.rla"), "c2:1-500", str(tmp_path / "g.fa"))
    want = spark.read.parquet(str(tmp_path / "r.rla/reads")).where((F.col("mdir") < 2) & F.col("mpos").between(1000, 1499))
    assert got.count() == want.count() > 0
    api.index(spark, str(tmp_path / "g.fa"), str(tmp_path / "g.index"))
    assert spark.read.parquet(str(tmp_path / "g.index/postings")).count() == 3000 // 32


def test_packed_reference(spark, tmp_path):
    g = genome(20000)
    (tmp_path / "g.fa").write_text(">c1\n" + g[:5000] + "\n>c2\n" + g[5000:] + "\n")
    text = mapped_reads(g[:6000], 50)
    (tmp_path / "r.fastq").write_text(text)
    api.compress(spark, str(tmp_path / "r.fastq"), str(tmp_path / "r.rla"), str(tmp_path / "g.fa"), pack=True)
    assert rows(archive.read(spark, str(tmp_path / "r.rla"))) == records(text)
    kept = spark.read.parquet(str(tmp_path / "r.rla/reference"))
    assert kept.where("seq = repeat('A', length(seq))").count() > 0 and kept.count() == api.open_reference(spark, str(tmp_path / "g.fa")).count()


def test_wrong_reference(spark, tmp_path):
    g = genome(3000)
    (tmp_path / "g.fa").write_text(">c1\n" + g + "\n")
    (tmp_path / "h.fa").write_text(">c1\n" + g[:-5] + "\n")
    (tmp_path / "r.fastq").write_text(mapped_reads(g, 10))
    api.compress(spark, str(tmp_path / "r.fastq"), str(tmp_path / "r.rla"), str(tmp_path / "g.fa"))
    with pytest.raises(ValueError, match="3000 bases"):
        api.decompress(spark, str(tmp_path / "r.rla"), str(tmp_path / "x"), str(tmp_path / "h.fa"))


def test_index_cache(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1\n" + genome(3000) + "\n")
    for _ in range(2):
        assert api.cached_index(spark, str(tmp_path / "g.fa"), str(tmp_path / "cache")).count() == 93
    (tmp_path / "g.fa").write_text(">c1\n" + genome(6400) + "\n")
    assert api.cached_index(spark, str(tmp_path / "g.fa"), str(tmp_path / "cache")).count() == 200
    assert len([p for p in (tmp_path / "cache").iterdir() if p.is_dir()]) == 2


def test_pipes(spark, tmp_path, monkeypatch, capsys):
    import io
    import sys

    text = fastq(12)
    monkeypatch.setattr(sys, "stdin", type("In", (), {"buffer": io.BytesIO(text.encode())}))
    assert cli.main(["compress", "-", "-o", str(tmp_path / "a.rla")]) == 0
    assert cli.main(["decompress", str(tmp_path / "a.rla"), "-o", "-"]) == 0
    assert capsys.readouterr().out == text


def test_command_line(tmp_path, capsys):
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip()
    a = cli.parser().parse_args(["compress", "x.fastq.gz", "-f", "-r", "g.fa"])
    assert a.force and a.reference == "g.fa"
    assert files.output_name("a/x.fastq.gz", "out") == "out/x.fastq.rla" and files.restored_name("out/x.fastq.rla", zipped=True) == "out/x.fastq.gz"


def test_stream(spark, tmp_path):
    from readlake.streaming.micro import read_stream, stream_to_blocks

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.fastq").write_text(fastq(10, i))
    q = read_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("reads_in").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("reads_in").count() == 30
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):  # the second time there is nothing new
        stream_to_blocks(read_stream(spark, str(tmp_path / "in")), out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == 30


def restored(folder) -> bytes:
    return b"".join(p.read_bytes() for p in sorted(folder.glob("part-*")))


def test_bytes_come_back_as_they_were(spark, tmp_path):
    """Characters beyond ASCII, carriage returns, and both in one file."""
    text = fastq(20).replace("@run", "@r\xe9n").encode("latin-1")
    for name, raw in (("latin", text), ("crlf", fastq(20).replace("\n", "\r\n").encode()), ("mixed", text + fastq(5).replace("\n", "\r\n").encode() + text)):
        (tmp_path / name).write_bytes(raw)
        api.compress(spark, str(tmp_path / name), str(tmp_path / f"{name}.rla"))
        assert archive.meta(spark, str(tmp_path / f"{name}.rla")).get("kind") != "binary"
        api.decompress(spark, str(tmp_path / f"{name}.rla"), str(tmp_path / f"{name}.back"))
        assert restored(tmp_path / f"{name}.back") == raw


def test_binary_files(spark, tmp_path, monkeypatch):
    """What is no FASTQ goes to blocks and comes back byte for byte; a damaged block fails it."""
    from readlake.sources import blocks

    monkeypatch.setattr(blocks, "SIZE", 1000)
    (tmp_path / "in").mkdir()
    content = {"a.bin": random.Random(1).randbytes(4321), "b.fastq": (fastq(10) + "@broken\nAC\n").encode(), "empty": b"", "z.gz": gzip.compress(b"not reads" * 50)}
    for name, raw in content.items():
        (tmp_path / "in" / name).write_bytes(raw)
    api.compress(spark, str(tmp_path / "in"), str(tmp_path / "x.rla"), level=1)
    api.decompress(spark, str(tmp_path / "x.rla"), str(tmp_path / "back"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "back").iterdir()} == content
    assert spark.read.parquet(str(tmp_path / "x.rla/data")).where("name = 'a.bin'").count() == 5
    bad = spark.read.parquet(str(tmp_path / "x.rla/data")).withColumn("md5", F.when((F.col("name") == "a.bin") & (F.col("block_id") == 2), "x").otherwise(F.col("md5")))
    bad.write.parquet(str(tmp_path / "y.rla/data"))
    spark.read.parquet(str(tmp_path / "x.rla/meta")).write.parquet(str(tmp_path / "y.rla/meta"))
    with pytest.raises(ValueError, match="1 damaged"):
        api.decompress(spark, str(tmp_path / "y.rla"), str(tmp_path / "no"))
    api.decompress(spark, str(tmp_path / "y.rla"), str(tmp_path / "some"), mode="DROPMALFORMED")
    assert (tmp_path / "some" / "a.bin").read_bytes() == content["a.bin"][:2000] + bytes(1000) + content["a.bin"][3000:]


def test_damaged_blocks_of_reads(spark, tmp_path):
    (tmp_path / "r.fastq").write_text(fastq(60))
    api.compress(spark, str(tmp_path / "r.fastq"), str(tmp_path / "r.rla"))
    reads = spark.read.parquet(str(tmp_path / "r.rla/reads"))
    reads.withColumn("qual", F.regexp_replace("qual", "^.", "#")).write.partitionBy("file_idx").parquet(str(tmp_path / "d.rla/reads"))
    for name in ("blocks", "meta"):
        spark.read.parquet(str(tmp_path / f"r.rla/{name}")).write.parquet(str(tmp_path / f"d.rla/{name}"))
    with pytest.raises(ValueError, match="1 damaged"):
        api.decompress(spark, str(tmp_path / "d.rla"), str(tmp_path / "no"))
    api.decompress(spark, str(tmp_path / "d.rla"), str(tmp_path / "none"), mode="DROPMALFORMED")
    assert restored(tmp_path / "none") == b""
    api.decompress(spark, str(tmp_path / "d.rla"), str(tmp_path / "all"), mode="PERMISSIVE")
    assert len(restored(tmp_path / "all")) == len(fastq(60))


def test_reference_of_several_files(spark, tmp_path):
    g = genome(9000)
    (tmp_path / "ref").mkdir()
    (tmp_path / "ref" / "c1.fa").write_text(">c1\n" + g[:4500] + "\n")
    (tmp_path / "ref" / "c2.fa").write_text(">c2\n" + g[4500:] + "\n")
    df = api.open_reference(spark, str(tmp_path / "ref"))
    assert "".join(r["seq"] for r in df.orderBy("base0").collect()) == g
    text = mapped_reads(g, 40)
    (tmp_path / "r.fastq").write_text(text)
    api.compress(spark, str(tmp_path / "r.fastq"), str(tmp_path / "r.rla"), str(tmp_path / "ref"))
    api.decompress(spark, str(tmp_path / "r.rla"), str(tmp_path / "back"), str(tmp_path / "ref"))
    assert restored(tmp_path / "back").decode() == text
