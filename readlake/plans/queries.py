"""The engine's queries by name."""

from __future__ import annotations

import os
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bases as B
from ..functions import codecs
from ..functions import quality as Q
from ..operators import integrity as V
from ..operators import mapping as M
from ..operators import reads as R
from ..operators import reference as X
from ..operators import streams as S
from ..operators.totals import running_total
from . import views
from .views import table


def _fq(work):
    return lambda spark, sf: work(views.fq(spark, sf))


def _docs(work):
    return lambda spark, sf: work(table(spark, sf, "documents"))


def block_classify(spark, sf: str) -> DataFrame:
    found = R.classify(views.broken(views.fq(spark, sf)).where("block_id % 2 = 1")).unionByName(R.classify(views.fq(spark, sf).where("block_id % 2 = 0")))
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("block_id"), F.lit(1).cast("long").alias("n_rec"), R.classify_head(F.encode("html", "UTF-8")).alias("block_type"))
    heads = spark.sql("SELECT -1L AS block_id, 0L AS n_rec, X'1F8B0800' AS h UNION ALL SELECT -2L, 0L, X'42414D01'").select("block_id", "n_rec", R.classify_head(F.col("h")).alias("block_type"))
    return found.withColumn("origin", F.lit("reads")).unionByName(pages.withColumn("origin", F.lit("pages"))).unionByName(heads.withColumn("origin", F.lit("heads")))


def read_generation(spark, sf: str) -> DataFrame:
    g = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 10).alias("block_id")).agg(F.max("n_chars").alias("max_len"))
    return g.select("block_id", "max_len", R.generation(F.col("max_len")).alias("generation"))


def block_assign(reads: DataFrame) -> DataFrame:
    d = running_total(reads, "rec", R.record_bytes(), "total")
    return d.select("rec", F.floor((F.col("total") - 1) / 8192).alias("block"), "total")


def id_roundtrip(reads: DataFrame) -> DataFrame:
    t = R.id_tokens(reads)
    g = t.groupBy("block_id", "rec").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.concat("token", "sep").alias("x")))), lambda s: s["x"]), "").alias("back"))
    return g.join(reads.select("block_id", "rec", "id"), ["block_id", "rec"]).select("rec", "back", (F.col("back") == F.col("id")).cast("int").alias("ok"))


def n_roundtrip(reads: DataFrame) -> DataFrame:
    d = reads.select("rec", "bases", R.strip_n(F.col("bases")).alias("stripped"), R.n_places(F.col("bases")).alias("places"))
    back = R.restore_n(F.col("stripped"), F.col("places"), F.length("bases"))
    return d.select("rec", back.alias("back"), (back == F.col("bases")).cast("int").alias("ok"))


def running_mean(reads: DataFrame) -> DataFrame:
    d = reads.select("rec", F.posexplode(Q.symbols(F.col("qual"))).alias("pos", "q"))
    w = Window.partitionBy("rec").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("rec", F.col("pos").cast("int").alias("pos"), F.floor(F.sum(F.col("q") + 33).over(w) / (F.col("pos") + 1)).cast("long").alias("mean"))


def quality_quant(reads: DataFrame) -> DataFrame:
    s = reads.select(F.explode(Q.symbols(F.col("qual"))).alias("q")).groupBy("q").agg(F.count("*").alias("n"))
    return s.select(F.col("q").cast("int").alias("q"), Q.quantised(F.col("q")).cast("int").alias("quant"), "n")


def newline_index(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", F.posexplode(F.slice(F.split("text", "\n", -1), F.lit(1), F.size(F.split("text", "\n", -1)) - 1)).alias("line", "t"))
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("doc_id", F.col("line").cast("int").alias("line"), (F.sum(F.length("t") + 1).over(w) - 1).cast("long").alias("pos"))


def verify_md5(docs: DataFrame) -> DataFrame:
    stored = F.md5(F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    d = V.verify(docs.select("doc_id", "text", stored.alias("md5")), "text")
    return d.select("doc_id", "damaged", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))


def coder_choice(docs: DataFrame) -> DataFrame:
    n = F.octet_length("text").cast("long")
    return docs.select("doc_id", n.alias("n"), F.when((n > codecs.WHOLE[0]) & (n < codecs.WHOLE[1]), "fc").otherwise("bwt").alias("coder"))


def crc(docs: DataFrame) -> DataFrame:
    return V.with_checks(docs.select("doc_id", "text"), "text").select("doc_id", "md5", "crc")


def ratio(docs: DataFrame) -> DataFrame:
    n, kept = F.octet_length("text").cast("long"), F.length(F.array_join(F.array_distinct(F.split("text", "\n", -1)), "\n")).cast("long")
    g = docs.groupBy("lang").agg(F.sum(n).alias("read"), F.sum(kept).alias("written"))
    return g.select("lang", "read", "written", F.round(F.col("written") * 100.0 / F.col("read"), 6).alias("ratio"))


def skip_damaged(docs: DataFrame) -> DataFrame:
    stored = F.md5(F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return V.verify(docs.select("doc_id", "text", stored.alias("md5")), "text", mode="DROPMALFORMED").select("doc_id", "md5")


def bwt(docs: DataFrame) -> DataFrame:
    def run(batches):
        for whole in batches:
            for b in codecs.slices(whole, 1):
                texts = b.column(1).to_pylist()
                t = [codecs.bwt_blocks(x) for x in texts]
                ok = [int(codecs.unbwt_blocks(y) == x) for x, y in zip(texts, t, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t, pa.string()), pa.array(ok, pa.int32())], names=["doc_id", "bwt", "ok"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).mapInArrow(run, "doc_id bigint, bwt string, ok int")


def _pair(spark, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", views.seg(k).alias("a"), views.seg(k + 1).alias("b"))


def _seg(work):
    return lambda spark, sf: work(_pair(spark, sf))


def ref_substr(spark, sf: str) -> DataFrame:
    w = X.windows(views.segments(spark, sf), 100, 64)
    return w.select("pos", F.col("kmer").alias("seq"), B.encode_bases("kmer").alias("codes"))


def canonical_kmer(spark, sf: str) -> DataFrame:
    w = X.windows(views.segments(spark, sf), X.K)
    return w.select("pos", B.canonical("kmer").alias("kmer"), B.flipped("kmer").alias("dir"))


def kmer_count(spark, sf: str) -> DataFrame:
    w = X.windows(views.segments(spark, sf), 8, 1)
    return w.groupBy(B.pack("kmer").alias("key")).agg(F.count("*").alias("n"))


def seed_topk(spark, sf: str) -> DataFrame:
    w = X.windows(views.segments(spark, sf), 6, 1)
    return X.postings(w.select("pos", B.pack(B.canonical("kmer", 3)).alias("key"), B.flipped("kmer", 3).alias("dir")))


def ref_match(spark, sf: str) -> DataFrame:
    """What an archive of the reference says of the reference itself, of one a segment shorter, and of one with another base."""
    s = views.segments(spark, sf)
    facts = V.sequence_facts(s)
    first = F.substring("seq", 7, 1)
    other = F.when(F.col("base0") == views.SEG, F.concat(F.substring("seq", 1, 6), F.when(first == "A", F.lit("C")).otherwise(F.lit("A")), F.expr("substring(seq, 8)"))).otherwise(F.col("seq"))
    variants = {"same": s, "short": s.where(F.col("base0") < facts["len"] - views.SEG), "other": s.select("base0", other.alias("seq"))}
    found = [(name, *(lambda f: (f["len"], V.compare_facts(facts, f)))(V.sequence_facts(v))) for name, v in variants.items()]
    return spark.createDataFrame(found, "name string, len long, verdict string")


def seed_join(spark, sf: str) -> DataFrame:
    return M.candidates(views.reads(spark, sf), M.Held(views.segments(spark, sf)))


def extend_score(spark, sf: str) -> DataFrame:
    return M.scored(views.reads(spark, sf), M.Held(views.segments(spark, sf)))


def mapped(spark, sf: str) -> DataFrame:
    return M.map_reads(views.reads(spark, sf), views.segments(spark, sf))


def map_roundtrip(spark, sf: str) -> DataFrame:
    r, s = views.reads(spark, sf), views.segments(spark, sf)
    held = M.Held(s)
    back = M.restored(M.map_reads(r, s, held), r, s, held).withColumnRenamed("bases", "back")
    return r.hint("shuffle_merge").join(back, "rid").select("rid", "back", (F.col("back") == F.col("bases")).cast("int").alias("ok"))


def _cover(work):
    def run(spark, sf: str) -> DataFrame:
        m = mapped(spark, sf).where(F.col("mdir") < 2).select("mpos", F.length("diff").alias("len"))
        return work(m, views.segments(spark, sf))

    return run


def position_range(spark, sf: str) -> DataFrame:
    m = mapped(spark, sf)
    return m.where((F.col("mdir") < 2) & F.col("mpos").between(1000, 4999)).select("rid", "mpos", "mdir")


def block_index(spark, sf: str) -> DataFrame:
    m = mapped(spark, sf).where(F.col("mdir") < 2)
    return m.groupBy(F.floor(F.col("rid") / 1000).alias("block_id")).agg(F.min("mpos").alias("min_pos"), F.max("mpos").alias("max_pos"), F.count("*").alias("n"))


def _affix(work):
    def run(spark, sf: str) -> DataFrame:
        p = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 500).alias("g"), "p_partkey", F.concat("p_brand", F.lit(" "), "p_type", F.lit(" "), "p_name").alias("t"))
        return work(S.affixes(p, "g", "p_partkey", "t"))

    return run


def affix_roundtrip(d: DataFrame) -> DataFrame:
    back = S.restore(F.col("prev"), F.col("prefix").cast("int"), F.col("suffix").cast("int"), F.col("middle"))
    return d.select("p_partkey", back.alias("back"), (back == F.col("text")).cast("int").alias("ok"))


def ordered_merge(spark, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"), F.count("*").alias("n"))
    return g.select("conv_id", "n", F.md5(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")).alias("md5"))


def archive_union(spark, sf: str) -> DataFrame:
    d = views.fq(spark, sf)
    a = d.where("rec % 2 = 0").groupBy("block_id").agg(F.count("*").alias("n_rec"))
    b = d.where("rec % 2 = 1").groupBy("block_id").agg(F.count("*").alias("n_rec"))
    return V.union_archives(a, b).select("file_idx", "block_id", "n_rec")


def level_block_size(spark, sf: str) -> DataFrame:
    size = F.create_map(*[F.lit(x) for kv in R.LEVELS.items() for x in kv])
    d = table(spark, sf, "documents").select(F.explode(F.sequence(F.lit(1), F.lit(9))).alias("level"), F.octet_length("text").alias("n"))
    g = d.groupBy("level").agg(F.sum("n").alias("bytes"))
    s = F.element_at(size, F.col("level")).cast("long")
    return g.select("level", s.alias("block_size"), F.ceil(F.col("bytes") / s).cast("long").alias("blocks"))


def meta_json(spark, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    doc = F.to_json(F.struct(F.col("event_type").alias("type"), F.struct(F.col("user_id").alias("id"), (F.col("event_id") % 7).alias("k")).alias("stream")))
    back = F.from_json("doc", "type string, stream struct<id: bigint, k: bigint>")
    return e.select("event_id", doc.alias("doc")).select("event_id", "doc", back["type"].alias("type"), back["stream"]["id"].alias("id"), back["stream"]["k"].alias("k"))


def archive_roundtrip(spark, sf: str) -> DataFrame:
    """Reads to an archive with a reference and back: each block's MD5 before and after."""
    from ..sources import archive

    base = (spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.gettempdir()).rstrip("/")
    path = f"{base}/readlake-archive-{os.urandom(8).hex()}"
    d = views.fq(spark, sf).select(F.lit(0).alias("file_idx"), "block_id", "rec", "id", "bases", "comment", "qual")
    s = views.segments(spark, sf)
    held = M.Held(s)  # both ways
    archive.write(d, path, s, held=held)
    now = archive.block_md5(archive.read(spark, path, s, held=held)).select("block_id", F.col("md5").alias("back"))
    return archive.block_md5(d).select("block_id", "n_rec", "n_bytes", "md5").join(now, "block_id").withColumn("ok", (F.col("md5") == F.col("back")).cast("int"))


def binary_roundtrip(docs: DataFrame) -> DataFrame:
    """Texts as files of bytes: cut in blocks of 4096, compressed, restored and put together again in order."""
    from ..sources import blocks

    d = docs.select("doc_id", F.encode("text", "UTF-8").alias("data")).where(F.col("data").isNotNull())
    back = blocks.unpacked(blocks.packed(blocks.cut(d, "data", 4096))).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block_id", "data"))).alias("b"), F.sum("n_bytes").alias("n"), F.min(F.col("ok").cast("int")).alias("ok"))
    whole = F.aggregate("b", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["data"]))
    return back.select("doc_id", "n", F.size("b").cast("long").alias("blocks"), F.md5(whole).alias("md5"), "ok")


def long_read_roundtrip(spark, sf: str) -> DataFrame:
    """Reads of 100 to 12,000 bases, mapped, kept as place and difference, and restored."""
    r, s = views.long_reads(spark, sf), views.segments(spark, sf)
    held = M.Held(s)
    back = M.restored(M.map_reads(r, s, held), r, s, held).withColumnRenamed("bases", "back")
    return r.hint("shuffle_merge").join(back, "rid").select("rid", F.length("back").cast("long").alias("n"), F.md5("back").alias("md5"), (F.col("back") == F.col("bases")).cast("int").alias("ok"))


def streamed_counts(spark, sf: str) -> DataFrame:
    """Events by type and hour, read as a stream with a watermark; the state is complete when the files are read."""
    from ..streaming.micro import windowed_counts

    return windowed_counts(spark, f"{sf}/events.parquet")


QUERIES = {
    "q_preanalysis": _fq(R.preanalysis),
    "q_block_classify": block_classify,
    "q_fastq_validate": lambda spark, sf: R.validate(views.broken(views.fq(spark, sf))),
    "q_read_generation": read_generation,
    "q_block_assign": _fq(block_assign),
    "q_id_separators": _fq(R.first_separators),
    "q_id_tokens": _fq(R.id_tokens),
    "q_id_layout_consistent": _fq(lambda d: R.layouts(d).select("block_id", "consistent")),
    "q_id_token_stats": _fq(lambda d: R.token_stats(d).drop("first_token")),
    "q_id_mode": _fq(lambda d: R.layouts(d).select("block_id", "mode")),
    "q_id_coder_choice": _fq(R.coder_choice),
    "q_id_roundtrip": _fq(id_roundtrip),
    "q_base_stats": _fq(R.base_stats),
    "q_n_positions": _fq(R.n_positions),
    "q_n_strip": _fq(lambda d: d.select("rec", R.strip_n(F.col("bases")).alias("stripped"), B.n_count("bases").alias("n"))),
    "q_n_roundtrip": _fq(n_roundtrip),
    "q_len_delta": _fq(R.length_deltas),
    "q_base_concat": _fq(R.joined),
    "q_comment_type": _fq(R.comment_type),
    "q_quality_freq": _fq(R.quality_freq),
    "q_quality_context": _fq(R.quality_contexts),
    "q_quality_running_mean": _fq(running_mean),
    "q_quality_quant": _fq(quality_quant),
    "q_encode_bases": _fq(lambda d: d.select("rec", B.encode_bases("bases").alias("codes"))),
    "q_decode_bases": _fq(lambda d: d.select("rec", B.decode_bases(B.encode_bases("bases")).alias("back"))),
    "q_newline_index": _docs(newline_index),
    "q_block_md5": _docs(lambda d: d.select("doc_id", F.md5("text").alias("md5"), F.octet_length("text").cast("long").alias("n"))),
    "q_verify_md5": _docs(verify_md5),
    "q_coder_choice": _docs(coder_choice),
    "q_crc": _docs(crc),
    "q_ratio": _docs(ratio),
    "q_sample_fingerprint": _docs(lambda d: d.select("doc_id", V.sampled_fingerprint(F.col("text")).alias("fp"))),
    "q_skip_damaged": _docs(skip_damaged),
    "q_bwt": _docs(bwt),
    "q_pack2bit": _seg(lambda d: d.select("p_partkey", F.array_join(B.pack_words("a").cast("array<string>"), ",").alias("packed"), B.pack_bytes("a").alias("bytes"))),
    "q_revcomp": _seg(lambda d: d.select("p_partkey", B.revcomp("a").alias("rc"))),
    "q_hamming": _seg(lambda d: d.select("p_partkey", B.hamming("a", "b").alias("mm"))),
    "q_packed_hamming": _seg(lambda d: d.select("p_partkey", B.packed_words_hamming(B.pack_words("a"), B.pack_words("b")).alias("mm"))),
    "q_diff_keep": _seg(lambda d: d.select("p_partkey", B.diff_keep("a", "b").alias("diff"))),
    "q_diff_xor": _seg(lambda d: d.select("p_partkey", B.diff_xor("a", "b").alias("diff"))),
    "q_ref_substr": ref_substr,
    "q_seed_extract": lambda spark, sf: X.windows(views.segments(spark, sf), X.K),
    "q_canonical_kmer": canonical_kmer,
    "q_kmer_count": kmer_count,
    "q_seed_topk": seed_topk,
    "q_ref_match": ref_match,
    "q_probe_kmers": lambda spark, sf: M.probe_sums(views.reads(spark, sf)),
    "q_seed_join": seed_join,
    "q_extend_score": extend_score,
    "q_map_best": lambda spark, sf: mapped(spark, sf).drop("diff"),
    "q_map_diff": lambda spark, sf: mapped(spark, sf).select("rid", "diff"),
    "q_map_roundtrip": map_roundtrip,
    "q_coverage_bytes": _cover(lambda m, s: X.covered_bytes(m)),
    "q_coverage_intervals": _cover(lambda m, s: X.covered_intervals(m)),
    "q_ref_mask": _cover(lambda m, s: X.masked(s, m)),
    "q_position_range": position_range,
    "q_block_index": block_index,
    "q_affix_prefix": _affix(lambda d: d.select("p_partkey", "prefix")),
    "q_affix_suffix": _affix(lambda d: d.select("p_partkey", "suffix")),
    "q_affix_middle": _affix(lambda d: d.select("p_partkey", "middle")),
    "q_affix_roundtrip": _affix(affix_roundtrip),
    "q_ordered_merge": ordered_merge,
    "q_archive_union": archive_union,
    "q_level_block_size": level_block_size,
    "q_meta_json": meta_json,
    "q_archive_roundtrip": archive_roundtrip,
    "q_binary_roundtrip": _docs(binary_roundtrip),
    "q_long_read_roundtrip": long_read_roundtrip,
    "q_stream_counts": streamed_counts,
}
