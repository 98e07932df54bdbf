"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readlake.llm import common as C
from readlake.llm import op1_quality, op4_mix, op8_pack, op9_simhash, op10_repeats

#: SQL can't express the near-duplicate, suffix and tokenizer stages.
ORACLE_SQL = None

#: Bytes of a passage: one of 50 words is longer, and prose doesn't repeat so much by chance.
PASSAGE = 200

_SCRATCH: list[str] = []


def _stage(work):
    """``work`` as a stage: what the stage before it left in the shared folder goes first, as its result is written by now."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        C.drop_scratch(spark, _SCRATCH)
        before = set(C.live_scratch())
        out = work(spark, docs, sf_dir)
        _SCRATCH[:] = [p for p in C.live_scratch() if p not in before]
        return out

    run_stage.__name__, run_stage.__doc__ = work.__name__, work.__doc__
    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return op1_quality.keep(docs, C.table(spark, sf_dir, "labels"))


@_stage
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8."""
    return op9_simhash.keep(docs)


@_stage
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages of ``PASSAGE`` bytes and more that are there elsewhere too."""
    return op10_repeats.cut(docs, length=PASSAGE)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return op4_mix.emit(docs)


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each packed piece, with its token ids."""
    import public_tokenizers

    return op8_pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
