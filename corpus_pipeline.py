"""A corpus pipeline: language, toxicity, near-duplicates, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.llm import decontaminate, language, packing, simhash, toxicity
from wavecrest.llm.common import held_out, scratch, table

#: Documents with a lower score of their predicted language are rejected; texts in two languages score about a half and stay.
LEAST_LANGUAGE_SCORE = 0.25


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has, in either case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; those without a letter or of a low score go, so null and empty texts do.

    Repeated rows are decided alike and stay as often as they came; rows with a null id or lang are decided by their text. An empty table, or one from which no language
    can be learned, gives no rows. All columns stay as they are, whatever their names.
    """
    into = _free(docs, "_language")
    model = language.fit_language(docs.where(~held_out("doc_id", 4, 2)))
    found = language.identify(docs, model, into=into)
    return found.where((F.col(f"{into}.lang_pred") != language.UND) & (F.col(f"{into}.score") >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a toxicity score under one half, learned from the labelled ones.

    Null and empty texts are scored by the bias alone. Repeated rows are decided alike; rows with a null id have no label and are scored. An empty table gives no
    rows. All columns stay as they are, whatever their names.
    """
    into = _free(docs, "_toxicity")
    machine = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)))
    return toxicity.score_toxicity(docs, machine, into=into).where(F.col(into) < 0.5).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that of the smallest id, rows with a null id last.

    Near-duplicates are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 at least, found by
    wide SimHash words; empty and null texts are one group. Of repeated rows one stays; rows that repeat an id with other texts are decided apart. An empty table gives no rows.
    """
    return simhash.without_similar(docs, width=5, least=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no window of a benchmark item occurs, so null and empty texts stay.

    Repeated rows are decided alike. An empty table gives no rows; an empty benchmark keeps all. All columns stay as they are, whatever their names.
    """
    into = _free(docs, "_contamination")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), into=into)
    return found.where(~F.col(f"{into}.contaminated")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of the documents in packed sequences; of an empty table there are none. Null sources and texts, repeated rows and other columns are as ``pack_documents`` has it."""
    return packing.pack_documents(docs, packing.text_tokens(), F.col("source"), packing.text_cluster())


STAGES = [("language", language_id), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("packing", packed)]

#: The classifiers of the first stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
