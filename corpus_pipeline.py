"""A corpus from raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame;
all but the last return the columns they were given, whatever their names. A stage's work tables lie in a folder of its own, which
the next stage over the same tables removes: what a stage returns has to be written before that is called. Those of the last stage stay.
An empty table gives an empty table in every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelark.llm import language, leaks, mixing, neardup, tokens
from sievelark.llm.queries import table, vocabulary
from sievelark.plans.shared import byte_setting, remove_folder, work_folder, write_shared

BATCH_BYTES = 4 << 20
"""Most bytes of an Arrow batch between the JVM and Python, set for the session by the first stage: what a worker holds does not
follow from the length of the texts. Smaller settings stay."""

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_USED: dict[tuple[str, str, int], list[str]] = {}
"""Folders of stages whose results may still be read, by application, tables and place of the stage."""


def _in_own_folder(place: int) -> Callable[[Stage], Stage]:
    def folder_of(stage: Stage) -> Stage:
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            application = spark.sparkContext.applicationId
            if byte_setting(spark, _BATCH) > BATCH_BYTES:
                spark.conf.set(_BATCH, str(BATCH_BYTES))
            for used in _USED.pop((application, sf_dir, place - 1), []):
                remove_folder(spark, used)
            with work_folder(spark) as folder:
                _USED.setdefault((application, sf_dir, place), []).append(folder)
                return stage(spark, docs, sf_dir)

        return run_stage

    return folder_of


@_in_own_folder(0)
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; without labelled rows it rejects all. NULL texts, empty texts and texts without
    a letter are rejected; texts of any length are read whole; repeated rows are judged alike."""
    out = "__language"
    while out in docs.columns:
        out += "_"
    found = language.identify(docs, language.fit(language.learnable(docs)), out=out)
    return found.filter(F.col(out)["accepted"]).drop(out)


@_in_own_folder(1)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that share 0.8 of their five-word shingles: the one with the least id (NULL last). Of
    repeated rows one stays; texts without words are classes of their own."""
    return neardup.one_per_class(docs)


@_in_own_folder(2)
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Texts without words hold none; repeated rows are judged alike; without
    a benchmark all stay."""
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


@_in_own_folder(3)
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, a row for each pass over its source. Texts without words are never taken; repeated rows
    are documents of their own; NULL is a source like others."""
    return mixing.mixed_documents(docs)


@_in_own_folder(4)
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder, and per document what they hold. A NULL or empty text is its end id alone; ties in the id go by
    the hash of the text, NULL ids come first."""
    return tokens.token_table(docs, vocabulary())


STAGES = [
    ("language", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_files", token_files),
]

ORACLE_SQL = None
"""SQL cannot train the language model of the first stage; tests/llm checks each stage against a plain version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
