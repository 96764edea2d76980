"""Corpus pipeline over ``documents``: five operators of ``vigil.llm`` in turn.

Every stage reads what its predecessor wrote as Parquet and works on all of it.
All but the last return the columns of ``documents`` and drop rows: junk by the
quality rules, copies, near-copies (five-word shingles, similarity of 0.8), and
what the target mixture does not draw. The last adds the pieces of each text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import exact_dedup, mixing, near_dedup, pieces, quality_rules
from vigil.llm.common import materialise, read, release, scratch

#: Scratch tables of the stage before; its output is written once the next begins.
_BEFORE: list[str] = []


def _stage(work):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _BEFORE)
        with scratch() as made:
            out = work(docs)
        _BEFORE.extend(made)
        return out

    run_stage.__doc__ = work.__doc__
    return run_stage


@_stage
def quality(docs: DataFrame) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


@_stage
def exact(docs: DataFrame) -> DataFrame:
    """One document of each group of copies."""
    return exact_dedup.drop_copies(docs)


@_stage
def near(docs: DataFrame) -> DataFrame:
    """One document of each component of near-copies."""
    return near_dedup.drop_near(docs, width=5, percent=80)


@_stage
def mix(docs: DataFrame) -> DataFrame:
    """A sample with the target mixture."""
    return mixing.keep_mixture(docs)


@_stage
def encode(docs: DataFrame) -> DataFrame:
    """All documents with their pieces."""
    return pieces.encode_texts(docs)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: Minimum-covariance estimates with approximate quartiles and Viterbi
#: segmentation are not expressible in SQL; tests/llm holds run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
