"""A pipeline over the documents: quality classifier, near duplicates, benchmark decontamination, secrets, packing.

Each stage takes the documents that its predecessor kept, as a Parquet table in the shared folder, and all but the
last return the columns of documents. Whatever other columns there are, of any name, travel along unread. Stages take
rows one by one, unless they say otherwise: null ids, repeated rows and texts of any length are documents like others,
a null text counts as empty and stays null, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.decontaminate import clean_documents
from tidewright.llm.importance import select_documents
from tidewright.llm.jaccard_join import Join, first_of_each
from tidewright.llm.packing import pack_along_curve
from tidewright.llm.secret_scan import redact_secrets
from tidewright.llm.store import dropped, owned, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the result of a stage reads, by input and stage.
_READ: dict[tuple[str, str], list[DataFrame]] = {}


def _after(before: str | None) -> Callable[[Stage], Stage]:
    """A stage owns the tables that its result reads. They go when the stage after it begins with the same input, as
    the result is written by then; no other tables are touched."""

    def mark(work: Stage) -> Stage:
        @wraps(work)
        def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            dropped(*_READ.pop((sf_dir, before), ()))
            with owned() as made:
                out = work(spark, docs, sf_dir)
            _READ.setdefault((sf_dir, work.__name__), []).extend(made)
            return out

        return stage

    return mark


@_after(None)
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards labelled documents of good quality; what it doesn't draw goes.

    Documents without words weigh 0, which is near the middle; null ids share one noise value.
    """
    return select_documents(docs, table(spark, sf_dir, "labels"))


@_after("classify")
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: five-word shingles, similarity 0.8 or more.

    Documents without words and null ids stay; of rows with equal ids and texts one stays.
    """
    return first_of_each(docs, Join(words=5, percent=80, counted_share=0.27))


@_after("drop_near_duplicates")
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; those without words stay."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


@_after("decontaminate")
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars, if there is such a column, follows."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


@_after("redact")
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens along a space-filling curve; a null or empty text is its end mark alone."""
    return pack_along_curve(docs)


STAGES = [("quality classifier", classify), ("near duplicates", drop_near_duplicates), ("decontamination", decontaminate), ("secrets", redact), ("packing", pack)]

#: SQL expresses neither the classifier nor the tokenizer; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, as a table in the shared folder that belongs to the caller."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        dropped(*_READ.pop((sf_dir, stage.__name__), ()))
        if k:
            dropped(before)
    return docs
