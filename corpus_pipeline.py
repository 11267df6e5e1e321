"""From ``documents`` to a training mix: toxicity, repeated lines, near duplicates, benchmark passages, source weights.

Every stage is a function of (spark, docs, sf_dir) over all rows that the one
before kept, with the columns of ``documents``; the last returns the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from popspark.llm import decontamination, toxicity
from popspark.llm.columns import free
from popspark.llm.durable import durable, table
from popspark.llm.jaccard import one_of_each_component
from popspark.llm.lines import WORD, dedup_lines
from popspark.llm.mixing import mixed_documents
from popspark.llm.queries import toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5.

    A row is scored by its own text, so rows that share an id are told apart and
    repeated rows go or stay together; a null or empty text scores as the bias
    says. An empty table gives no rows; any column names pass through.
    """
    (score,) = free(docs.columns, 1)
    return toxicity.score(docs, toxicity_model(spark, sf_dir), out_col=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; one that keeps no word of those it had goes.

    Null and wordless texts stay as they are. Texts under one id or none are
    told apart, rows alike in id and text are no copies of one another (the
    next stage keeps one). ``n_chars`` follows a text that changes; a null one
    where it does not stays null. An empty table gives no rows. Other columns
    pass through, also those called n_lines or n_removed in any case.
    """
    clash = [c for c in docs.columns if c.lower() in ("n_lines", "n_removed")]
    aside = dict(zip(clash, free(docs.columns, len(clash))))
    d = dedup_lines(docs.withColumnsRenamed(aside))
    d = d.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    length = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    d = d.withColumn("n_chars", length).drop("n_lines", "n_removed")
    return d.withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; all without a word stay.

    Ties, null ids and rows that share an id are as in ``one_of_each_component``.
    """
    return one_of_each_component(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark``; null and wordless ones contain none. Rows are judged one by one."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken (repeats counted), their virtual finish time and place in the mix.

    Texts without a word are not taken; rows that share an id or have none get
    the words of their own text; an empty table gives no rows.
    """
    return mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: No stage but the last can be written in SQL; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)
    return docs
