"""Each query does the whole of its job: what a shorter way would leave out is looked for here."""

import random
from collections import Counter

from readlake.functions import bases as B
from readlake.functions import codecs
from readlake.operators import mapping as M
from readlake.plans import queries, views
from readlake.plans.queries import QUERIES
from readlake.sources import archive

SF = "/root/testdata/sf0.001"


def test_long_reads_come_back_whole(spark, tmp_path):
    r = random.Random(11)
    g = "".join(r.choice("ACGT") for _ in range(41_003))  # the last quad isn't full
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = [g[4000:9000], turn(g[4095:9095]), g[7:20_007], turn(g[21_003:]), g[100:8292], g[-5000:], "A" * 5000, g[-100:]]
    reads = [s[:50] + ("A" if s[50] != "A" else "C") + s[51:] for s in reads[:-2]] + reads[-2:]
    d = spark.createDataFrame(list(enumerate(reads)), "rid long, bases string")
    seg = spark.createDataFrame([(i, g[i : i + 700]) for i in range(0, len(g), 700)], "base0 long, seq string")
    a = {x["rid"]: tuple(x) for x in M.map_in_tasks(d, seg, 2000).collect()}
    assert a == {x["rid"]: tuple(x) for x in M.map_by_join(d, seg).collect()}
    assert [a[i][1:4] for i in range(8)] == [(4000, 0, 1), (4095, 1, 1), (7, 0, 1), (21_003, 1, 1), (100, 0, 1), (36_003, 0, 1), (0, 2, -1), (40_903, 0, 0)]
    back = M.restored(M.map_reads(d, seg), d, seg).collect()
    assert {x["rid"]: x["bases"] for x in back} == dict(enumerate(reads))
    fq = spark.createDataFrame([(0, i // 3, i, f"@r{i}", s, "+", "F" * len(s)) for i, s in enumerate(reads)], "file_idx int, block_id long, rec long, id string, bases string, comment string, qual string")
    archive.write(fq, str(tmp_path / "a"), seg)
    assert {x["rec"]: x["bases"] for x in archive.read(spark, str(tmp_path / "a"), seg).collect()} == dict(enumerate(reads))
    assert archive.damaged(spark, str(tmp_path / "a"), seg).count() == 0


def test_coverage_counts_every_mapped_read(spark):
    placed = [x["mpos"] for x in QUERIES["q_map_best"](spark, SF).collect() if x["mdir"] < 2 and x["mpos"] > 0]
    bases = sorted({p for m in placed for p in range(m, m + 100)})
    covered = {p // 4 for p in bases}
    assert {x["byte"] for x in QUERIES["q_coverage_bytes"](spark, SF).collect()} == covered
    los = [p for i, p in enumerate(bases) if i == 0 or bases[i - 1] != p - 1]
    his = [p + 1 for i, p in enumerate(bases) if i + 1 == len(bases) or bases[i + 1] != p + 1]
    assert sorted((x["lo"], x["hi"]) for x in QUERIES["q_coverage_intervals"](spark, SF).collect()) == list(zip(los, his, strict=True))
    s = "".join(x["seq"] for x in views.segments(spark, SF).orderBy("base0").collect())
    value = lambda b: sum("ACTG".index(c) << (6 - 2 * i) for i, c in enumerate(s[4 * b : 4 * b + 4]))
    assert {x["byte"]: x["value"] for x in QUERIES["q_ref_mask"](spark, SF).collect()} == {b: value(b) if b in covered else 0 for b in range(len(s) // 4)}


def test_bwt_takes_every_line(spark):
    texts = ["\none\ntwo\n", "abc\n" * 500, "", "é\n😀x\n", "no line feed"] + ["".join(random.Random(i).choice("ab\n") for _ in range(i)) for i in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in queries.bwt(d).collect():
        t = texts[x["doc_id"]] + "\0"
        assert x["bwt"] == "".join(r[-1] for r in sorted(t[i:] + t[:i] for i in range(len(t)))) and x["ok"] == 1


def test_bwt_blocks():
    for n in (0, 1, 6, 7, 8, 21, 50):
        t = ("abcab\n" * 9)[:n]
        b = codecs.bwt_blocks(t, 7)
        assert codecs.unbwt_blocks(b, 7) == t and len(b) == n + max(1, -(-n // 7))


def test_packed_words_hold_every_base(spark):
    whole = {x["p_partkey"]: x["mm"] for x in QUERIES["q_hamming"](spark, SF).collect()}
    assert {x["p_partkey"]: x["mm"] for x in QUERIES["q_packed_hamming"](spark, SF).collect()} == whole
    for x in QUERIES["q_pack2bit"](spark, SF).collect():
        bits = "".join(f"{w:0{2 * n}b}" for w, n in zip(map(int, x["packed"].split(",")), (31, 31, 2), strict=True))
        assert f"{int(bits, 2):032x}" == x["bytes"]
    r = random.Random(4)
    rows = [(n, "".join(r.choice("ACGT") for _ in range(n)), "".join(r.choice("ACGT") for _ in range(n))) for n in (0, 1, 31, 32, 62, 63, 200)]
    d = spark.createDataFrame(rows, "n int, a string, b string").select("n", B.pack_words("a").alias("w"), B.packed_words_hamming(B.pack_words("a"), B.pack_words("b")).alias("p"), B.hamming("a", "b").alias("h"))
    assert all(x["p"] == x["h"] and len(x["w"]) == -(-x["n"] // 31) for x in d.collect())


def test_kmers_cross_segment_borders(spark):
    s = "".join(x["seq"] for x in views.segments(spark, SF).orderBy("base0").collect())
    key = lambda k: sum("ACTG".index(c) * 4 ** (len(k) - 1 - i) for i, c in enumerate(k))
    counts = Counter(key(s[i : i + 8]) for i in range(len(s) - 7))
    assert {x["key"]: x["n"] for x in QUERIES["q_kmer_count"](spark, SF).collect()} == counts
    places = {}
    for i in range(len(s) - 5):
        k = s[i : i + 6]
        flip = int(k[2] not in "GT")
        places.setdefault(key(k[::-1].translate(str.maketrans("ACGT", "TGCA")) if flip else k), []).append((flip, i))
    want = {(k, p, f, n + 1) for k, v in places.items() for n, (f, p) in enumerate(sorted(v)[:16])}
    assert {(x["key"], x["pos"], x["dir"], x["rn"]) for x in QUERIES["q_seed_topk"](spark, SF).collect()} == want
