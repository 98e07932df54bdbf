"""What each query keeps small as its tables grow."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from readlake.functions import codecs
from readlake.operators import kernels as N
from readlake.operators import mapping as M
from readlake.operators import reference as X
from readlake.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TURN = str.maketrans("ACGTN", "TGCAC")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def mixed(spark):
    """Reads of many lengths, some with N, small letters, repeats or nothing, and a reference that holds most of them."""
    r = random.Random(21)
    g = "".join(r.choice("ACGT") for _ in range(9000)) + "ATCG" * 300 + "".join(r.choice("ACGT") for _ in range(802))
    g = g[:5000] + g[1000:1400] + g[5400:]
    reads = []
    for i in range(150):
        n = r.choice([30, 31, 35, 36, 37, 64, 100, 101, 102, 103, 700])
        at = r.randrange(len(g) - n)
        s = list(g[at : at + n])
        for _ in range(r.randint(0, 5)):
            s[r.randrange(n)] = r.choice("ACGTNacgt")
        s = "".join(s)
        reads.append((i, s.upper()[::-1].translate(TURN) if i % 2 else s))
    reads += [(900, ""), (901, "ATCG" * 40), (902, "N" * 50)]
    d = spark.createDataFrame(reads, "rid long, bases string")
    seg = spark.createDataFrame([(a, g[a : a + n]) for a, n in ((0, 700), (700, 3), (703, 6000), (6703, len(g)))], "base0 long, seq string")
    return dict(reads), g, d, seg


def probes(s: str) -> list[tuple[int, str, int]]:
    """Offset, canonical 31-mer, other strand, one by one."""
    s = s.upper().replace("N", "G")
    kmers = [s[o : o + 31] for o in range(len(s) - 30)] if len(s) > 35 else []
    return [(o, k, 0) if k[15] in "GT" else (o, k[::-1].translate(TURN), 1) for o, k in enumerate(kmers)]


def places(reads: dict, g: str) -> dict:
    """Candidates of each read, one by one."""
    post: dict = {}
    for p in range(0, len(g) - 30, 32):
        k = g[p : p + 31]
        post.setdefault(k if k[15] in "GT" else k[::-1].translate(TURN), []).append((int(k[15] not in "GT"), p))
    found: dict = {}
    for rid, s in reads.items():
        for off, key, flip in probes(s):
            for rn, (way, p) in enumerate(sorted(post.get(key, ()))[:16], 1):
                at = p - off if way == flip else p - (len(s) - 31 - off)
                if 0 <= at <= len(g) - len(s):
                    found.setdefault(rid, []).append((off, rn, at, way ^ flip))
    return found


def test_long_reads_are_never_broadcast(spark):
    """rows of supplier look small, the reads made of them are not."""
    assert "Broadcast" not in plan(QUERIES["q_long_read_roundtrip"](spark, SF))
    assert "Broadcast" not in plan(QUERIES["q_map_roundtrip"](spark, SF))


def test_long_reads_place_is_compared_once(mixed):
    """a read of 700 bases has some 20 seeds, all at one place."""
    reads, g, _, seg = mixed
    index = N.Index(*N.reference(seg))
    s = g[2000:2700]
    assert len(index.candidates(N.CODE[np.frombuffer(s.encode(), np.uint8)][None])[0]) > 15
    assert [len(x) for x in index.places(N.CODE[np.frombuffer(s.encode(), np.uint8)][None])] == [1] * 6


def test_scores_without_a_row_a_probe(spark, mixed):
    """places, hits and mismatches of odd reads in both forms; no probe is a row of the plan."""
    assert "Generate" not in plan(QUERIES["q_extend_score"](spark, SF)).split("MapInArrow")[0] and "Join" not in plan(QUERIES["q_extend_score"](spark, SF))
    reads, g, d, seg = mixed
    want: dict = {}
    for rid, c in places(reads, g).items():
        s = reads[rid].upper().replace("N", "G")
        for _, _, at, way in c:
            own = s[::-1].translate(TURN) if way else s
            want.setdefault((rid, at, way), [0, sum(x != y for x, y in zip(own, g[at : at + len(s)], strict=True))])[0] += 1
    for in_task in (True, False):
        assert {(x["rid"], x["mpos"], x["mdir"]): [x["hits"], x["mm"]] for x in M.scored(d, M.Held(seg, in_task)).collect()} == want


def test_probe_sums_without_a_row_a_probe(spark, mixed):
    """sums of odd reads; no probe is a row of the plan."""
    assert "Generate" not in plan(QUERIES["q_probe_kmers"](spark, SF))
    reads, _, d, _ = mixed
    pack = lambda k: sum("ACTG".index(c) << 2 * (30 - i) for i, c in enumerate(k))
    want = {rid: (len(p), sum(x[2] for x in p), sum(pack(x[1]) % 1000003 for x in p)) for rid, s in reads.items() if (p := probes(s))}
    assert {x["rid"]: (x["n"], x["flips"], x["sum"]) for x in M.probe_sums(d).collect()} == want


def test_seed_hits_without_a_row_a_probe(spark, mixed):
    """candidates of odd reads in both forms. With a large reference only probes that pass the filter of its keys meet the postings."""
    assert "Join" not in plan(QUERIES["q_seed_join"](spark, SF))
    reads, g, d, seg = mixed
    want = sorted((rid, *c) for rid, cs in places(reads, g).items() for c in cs)
    for in_task in (True, False):
        assert sorted((x["rid"], x["off"], x["rn"], x["mpos"], x["mdir"]) for x in M.candidates(d, M.Held(seg, in_task)).collect()) == want
    keys = np.random.default_rng(1).integers(0, 1 << 62, 20_000, dtype=np.uint64)
    bits = N.filter_bits(10_000)
    held = N.filled(N.slots(keys[:10_000], bits), bits)
    assert N.passes(held, bits, keys[:10_000]).all() and N.passes(held, bits, keys[10_000:]).mean() < 0.08


def test_both_forms_of_mapping_and_restoring(spark, mixed):
    """The same rows from both forms, and reads come back."""
    reads, _, d, seg = mixed
    rows = []
    for in_task in (True, False):
        held = M.Held(seg, in_task)
        m = M.map_reads(d, seg, held)
        rows.append(sorted(map(tuple, m.collect())))
        assert {x["rid"]: x["bases"] for x in M.restored(m, d, seg, held).collect()} == {k: v.upper().replace("N", "G") for k, v in reads.items()}
    assert rows[0] == rows[1] and len(rows[0]) == len(reads)


def test_driver_gets_two_bits_a_base(mixed):
    """the reference comes to the driver packed, and its seeds are made of that."""
    _, g, _, seg = mixed
    packed, size = N.reference(seg)
    assert size == len(g) and len(packed) <= len(g) / 4 + 16
    assert N.Reference(packed, size).windows(np.array([0, 1, 702, len(g) - 50]), 50).tolist() == [["ACTG".index(c) for c in g[a : a + 50]] for a in (0, 1, 702, len(g) - 50)]


def test_coverage_isn_t_a_row_a_byte_of_each_read(spark):
    """reads upon each other are one piece before they are dealt out; pieces in the plan, not bytes."""
    m = spark.range(0, 40_000, 1, 2).selectExpr("1 + id % 1000 AS mpos", "100 AS len")
    p = X._pieces(m, 4, 1 << 14)
    assert p.count() <= 12
    assert sorted(x["byte"] for x in X.covered_bytes(m).collect()) == list(range(275))
    assert "Aggregate" not in plan(X.covered_bytes(m))


def covered(rows: list) -> set:
    return {p for at, n in rows if at > 0 for p in range(at, at + n)}


def test_coverage_of_odd_mappings(spark, mixed):
    """against one base after the other; cells, borders, empty and unmapped reads, a last quad that isn't full."""
    _, g, _, seg = mixed
    r = random.Random(5)
    for n in (0, 1, 400):
        rows = [(r.choice([0, 4096, 4095, 8192, 1, r.randrange(len(g) - 300)]), r.choice([0, 1, 3, 4, 100, 300])) for _ in range(n)] + ([(len(g) - 3, 3), (0, 9)] if n else [])
        m = spark.createDataFrame(rows, "mpos long, len int")
        bases = sorted(covered(rows))
        quads = {p // 4 for p in bases}
        assert sorted(x["byte"] for x in X.covered_bytes(m).collect()) == sorted(quads)
        for cell in (64, 1 << 20):
            los = [p for i, p in enumerate(bases) if i == 0 or bases[i - 1] != p - 1]
            his = [p + 1 for i, p in enumerate(bases) if i + 1 == len(bases) or bases[i + 1] != p + 1]
            assert sorted((x["lo"], x["hi"]) for x in X.covered_intervals(m, cell).collect()) == list(zip(los, his, strict=True))
        value = lambda b: sum("ACTG".index(c) << (6 - 2 * i) for i, c in enumerate(g[4 * b : 4 * b + 4]))
        assert sorted(map(tuple, X.masked(seg, m).select("byte", "value").collect())) == [(b, value(b) if b in quads else 0) for b in range(len(g) // 4)]


def test_mask_joins_chunks_not_bytes(spark):
    """neither the reference nor the coverage is a row a byte before the last step."""
    m = spark.createDataFrame([(5, 10)], "mpos long, len int")
    seg = spark.createDataFrame([(0, "ACGT" * 5000)], "base0 long, seq string")
    p = plan(X.masked(seg, m))
    assert "Join" not in p and p.count("Generate") == 1


def test_transform_of_repetitive_and_wide_texts():
    """the inverse takes its steps together, whatever their number and the alphabet; it was a loop over characters."""
    r = random.Random(9)
    for n in (0, 1, 2, 3, 255, 256, 257, 258, 511, 513, 1000):
        for letters in ("a", "ab\n", "é😀x\n", "".join(map(chr, range(300, 1500)))):
            for t in ((letters * n)[:n], "".join(r.choice(letters) for _ in range(n))):
                s = t + "\0"
                b = codecs.bwt(t)
                assert codecs.unbwt(b) == t
                if n < 300:
                    assert b == "".join(x[-1] for x in sorted(s[i:] + s[:i] for i in range(len(s))))
    t = "".join(r.choice("abcdefgh \n") for _ in range(1 << 18))
    b = codecs.bwt(t)
    a = time.process_time()
    codecs.unbwt(b)
    new = time.process_time() - a
    a = time.process_time()
    order, out, i = np.argsort(codecs._codes(b, "\0"), kind="stable").tolist(), [], 0
    for _ in range(len(t)):
        i = order[i]
        out.append(i)
    assert new < time.process_time() - a


def test_batches_are_taken_in_slices(spark):
    """of a batch, as many rows are objects at once as have a megabyte; a long row is by itself and rows of nothing count."""
    rows = [None, b"", b"x" * (1 << 21), *[b"y" * 4096] * 1000, None]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.binary())], names=["k", "data"])
    parts = list(codecs.slices(b, 1))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([b]))
    assert [x.num_rows for x in parts][:2] == [2, 1] and all(x.num_rows <= 257 for x in parts)
    assert [x.num_rows for x in codecs.slices(b.slice(3, 300), 1)] == [256, 44]
    d = spark.createDataFrame(list(enumerate(rows)), "k int, data binary").coalesce(1)
    z = codecs.compress(d, "data")
    assert [x["data"] for x in codecs.decompress(z, "data").orderBy("k").collect()] == rows


def test_archive_round_trip_holds_its_reference_once(spark, monkeypatch):
    """the reference came to the driver for writing, and again for reading."""
    came = []
    real = N.reference
    monkeypatch.setattr(N, "reference", lambda s: came.append(1) or real(s))
    d = QUERIES["q_archive_roundtrip"](spark, SF)
    assert len(came) == 1 and all(x["ok"] == 1 for x in d.collect()) and len(came) == 1
