"""A training corpus from ``documents``: rules, near-duplicates, personal data, mixture, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame that the next one gets after it was written and read again.
All but the last return the columns of ``documents``, further columns of any name among them; every decision takes effect
on the rows or texts themselves. SQL cannot express the trained stages, so ``ORACLE_SQL`` is None and the tests compare the
stages with brute force.

Odd inputs. Null and empty texts fail the first stage's base rule; in the later stages they are ordinary texts without
words (near-duplicates of each other, nothing to mask, taken or not as the mixture's threshold says, packed as an end id).
Very long texts are read whole in every stage. Repeated rows and ties are judged alike, and one row of them stays in
near_duplicates, whatever their ids (null ids too). Rows with null ids, sources, languages or lengths are kept as they are.
An empty table gives an empty result at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import mixing, packing, pii, quality, simhash
from quern.session import materialise, prepare, table

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the calibrated classifier keep; null, empty and other texts under 20 words go."""
    model = quality.quality_model(docs, table(spark, sf_dir, "labels"))
    mark = "quern_quality_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    return quality.verdicts(docs, model, prefix=mark).where(F.col(f"{mark}kept")).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity 0.8 on five words) one row: the smallest id, then the smallest digest."""
    return simhash.first_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with the personal data of its text masked; null texts stay null."""
    return pii.redact(docs, pii.train(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix to target weights takes them, three times at most; a null source is a source."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed-length sequences, every window mixed to the sources' weights."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
