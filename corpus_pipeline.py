"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage reads what its predecessor wrote and returns a DataFrame; all but the last return
the columns of ``documents``.  A stage's decision takes effect on the rows it returns:
toxic documents go, one document of each near-duplicate group stays, contaminated documents
go, secrets are cut out of the texts that stay, and what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmesh.llm import common, decontaminate, packing, secrets, similar
from rillmesh.llm import toxicity as toxicity_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic by a model learnt from the labels of the table's documents.

    Null and empty texts score 0 and stay, as do all rows if no label or only one class is there; repeated rows and rows
    that share an id are each judged by their text, very long ones by all of it; a score of just 0.5 counts as toxic; an
    empty table stays empty; other columns than those of ``documents`` go."""
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity_model.fit(docs, labels.where(common.id_fold(F.col("doc_id"), 5) != 0))
    return toxicity_model.apply(docs, model, COLUMNS).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every class of near-duplicates: texts whose sets of five-word
    shingles have a Jaccard similarity of 0.8 or more, SimHash finding the close ones.

    The smallest id of a class stays, null ids last; of equal ids and different texts the earliest row, of
    rows that are equal in both the first by its columns.  Rows that share an id or have none stay if their
    texts are no near-duplicates; texts without words (null, empty) are copies of each other; very long texts are
    compared whole; an empty table stays empty; other columns than those of ``documents`` go."""
    return similar.without_near_duplicates(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the contamination rule marks.

    Null and empty texts have no words and stay; repeated rows and rows that share an id are each judged by their text,
    very long ones by all of it; just a twentieth of the words counts as contaminated; an empty benchmark drops
    nothing, an empty table stays empty; other columns than those of ``documents`` go."""
    items = common.table(spark, sf_dir, "benchmark")
    return decontaminate.find(docs, items, COLUMNS).where("not contaminated").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts secrets out of the texts; every document stays, its length is counted anew where something was cut.

    Null texts stay null and empty ones empty; spans that overlap or touch are one cut; repeated rows and rows that share
    an id are each scanned by themselves, very long ones whole; an empty table stays empty; other columns than those of
    ``documents`` go."""
    found = secrets.find(docs, [c for c in COLUMNS if c != "text"], redact=True)
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length("redacted").cast("long")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all remaining documents into sequences; the ids come along.

    A null or empty text is the end id alone; repeated rows and rows that share an id are packed each by itself, very long
    ones over several sequences; an empty table gives no piece; other columns than id and text are not read."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packed),
]

#: The stages hash, learn and tokenize, which SQL cannot express; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
