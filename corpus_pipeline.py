"""Documents made ready for training: toxic ones rejected, one of each group of near
copies kept, repeated passages removed, personal data masked, and the rest packed.

Each stage is a table of its own: it is written to the shared folder as Parquet and read
again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import exact_substrings, packing, pii, simhash, toxicity
from webloom.llm.common import discard, read, scratch, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labels whose documents are at hand; drops what it finds toxic."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id stays."""
    return simhash.one_of_each(docs)


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where it is given, made to follow the text."""
    n = F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.lit(0)))
    return docs.select(*[n.cast(kind).alias(c) if c == "n_chars" else F.col(c) for c, kind in docs.dtypes])


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings found more than once; ``n_chars``
    follows the text.  A document of which nothing is left stays, empty; null stays null."""
    return _counted(exact_substrings.without_repeats(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with e-mail and IP addresses, card and phone numbers masked."""
    return _counted(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in sequences of at most 2048 tokens."""
    return packing.pack(docs, packing.definition())


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", remove_repeats),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: SQL has no tokenizer, so the last stage cannot be said in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's tables, its input among them, go when its result is written; those that the
    last one reads stay."""
    source = docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            result = written(stage(spark, docs, sf_dir), keep=True)
        if docs is not source:
            discard(docs)
        docs = result
    return STAGES[-1][1](spark, docs, sf_dir)
