"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept:

1. toxicity: documents that score as toxic go.
2. near_dedup: one document of each near-duplicate class stays, the one of least id.
3. decontamination: words in benchmark windows are cut; documents that consist of
   them by more than half go.
4. pii: validated personal values become pseudonyms of the same format.
5. packing: the rest is tokenised and packed into windows.

All but the last return the columns of their input; ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm import decontamination, near_dedup, packing, pii, toxicity
from gaugeflow.llm.queries import pii_key, tokenizer_path
from gaugeflow.llm.shared import cut, table

#: SQL has neither edit alignment nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def _through(docs: DataFrame, added: tuple[str, ...], stage: Callable[[DataFrame], DataFrame], changed: bool = False) -> DataFrame:
    """Run ``stage`` with columns that clash with its own set aside; return the columns of ``docs``."""
    clash = [c for c in docs.columns if c in added]
    out = stage(docs.withColumnsRenamed({c: f"own_{c}" for c in clash}))
    if changed and "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"own_{c}").alias(c) if c in clash else F.col(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _through(docs, toxicity.ADDED, lambda d: toxicity.score(d, lexicon).where(F.col("score") < toxicity.THRESHOLD))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")

    def stage(d: DataFrame) -> DataFrame:
        marked = decontamination.within_limits(decontamination.decontaminate(d, items))
        return marked.withColumn("text", F.col("clean_text"))

    return _through(docs, decontamination.ADDED, stage, changed=True)


def hide_personal_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _through(docs, pii.ADDED, partial(pii.pseudonymise, key=pii_key(spark)), changed=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Workers also hold what the stages before have left, so the tables are smaller here.
    return packing.pack(docs, tokenizer_path(), load=partial(packing.word_tokenizer, most_chunks=200_000, most_runs=400_000))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("pii", hide_personal_values),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
