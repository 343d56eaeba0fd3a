"""A corpus pipeline: language ID, line dedup, near-dedup, mixing to target weights, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept; all but
the last return the columns of ``documents``. ``run`` applies them in order, each written as Parquet in
the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import language_id, line_dedup, mixing, near_dups, packing
from strataloom.llm.common import discard, materialize
from strataloom.llm.queries import vocabulary

#: Documents whose language is less certain than this are rejected, as are those without letters.
LEAST_SCORE = 0.5


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its own columns of these names, in any case, put aside, and how they are called meanwhile."""
    clash = {c: f"_own_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in names}
    return docs.withColumnsRenamed(clash), clash


def _back(df: DataFrame, docs: DataFrame, clash: dict[str, str]) -> DataFrame:
    """The columns of ``docs``, those that were put aside as they came."""
    return df.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, null texts among them, or without a certain language. Where no document has a
    language to learn from, all go. Repeated rows stay or go together; columns named like the results stay."""
    model = language_id.fit(language_id.learnable(docs))
    d, clash = _aside(docs, "lang_pred", "score")
    known = language_id.with_language(d, model)
    return _back(known.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs, clash)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; no document goes, though one may be left empty, and a null text is. Columns named like the
    results stay."""
    d, clash = _aside(docs, "kept", "n_lines", "n_dropped")
    d = line_dedup.dedup_lines(d).withColumn("text", F.col("kept")).withColumn("n_chars", F.char_length("kept").cast("long"))
    return _back(d, docs, clash)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, the one of the least doc_id; of rows that tie, any one. Rows
    without words all stay. All columns stay; no rows give none."""
    return near_dups.first_of_each(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out whole documents so that the sources, a null one among them, meet their target weights. Documents
    without words have size 0 and are left out or kept with no effect on the weights. All columns stay; no rows give none."""
    return mixing.mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the packed sequences; a null text has its end id alone, and repeated rows are packed one by one.
    No rows give none."""
    return packing.pack(docs, vocabulary())


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("mixing", mix_stage), ("packing", pack_stage)]

#: The stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
