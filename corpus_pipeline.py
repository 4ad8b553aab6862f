"""From raw documents to packed sequences, in five stages of text operators.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of ``documents``; the last one returns packed pieces.
Between stages the rows are written as Parquet to the shared folder and read
again, so a lost executor costs no more than its part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from moraine.llm import exact_dedup, jaccard, mixing, packing, toxicity
from moraine.llm.common import table
from moraine.session import drop_scratch, dropped, recorded_scratch, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: dict[str, list[str]] = {}  # by application, scratch folders of the stage that ran last


def stage(run_stage: Stage) -> Stage:
    """A stage that first removes the scratch folders of the stage before it.

    A stage's result is written before the next stage is called, so by then
    nothing reads them; those of the last stage go with the driver.
    """
    @wraps(run_stage)
    def scoped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT.setdefault(spark.sparkContext.applicationId, [])
        drop_scratch(spark, left)
        with recorded_scratch() as made:
            out = run_stage(spark, docs, sf_dir)
        left += made
        return out

    return scoped


@stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the random field does not score as toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id."""
    return exact_dedup.drop_copies(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of shingle links: five words, a similarity of 0.8."""
    return jaccard.keep_one(docs, words=5, percent=80)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, at weights 1, 2, 3 in turn."""
    return mixing.mixed(docs, placed=False)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources), ("packing", pack_sequences),
]

#: No SQL: the random field, the drawn mix and the tokenizer have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row; each one's input goes once its output is written, the last one's with the driver."""
    docs = table(spark, sf_dir, "documents")
    for name, of_stage in STAGES[:-1]:
        before, docs = docs, staged(of_stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    _LEFT.pop(spark.sparkContext.applicationId)  # the caller reads the last stage's result whenever it likes
    return out
