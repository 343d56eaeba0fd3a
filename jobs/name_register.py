"""Incremental job: a register of output names for acquisition notes, in which no name clashes with another.

    python -m jobs.name_register --notes .../documents.parquet --out DIR --checkpoint DIR [--config jobs/name_register.json]

Every document is the note of an acquisition; its first line is the stem of its output files, as far as it may stand in
a file name, numbered where the stem was given before. Each run takes the files of notes that are new since the last
one, known by the stream's checkpoint, and numbers on from the register; names once given stay. A batch that is
run again after a failure replaces what it had written. Writes ``register``, partitioned by batch and source."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import read_config, session
from strataloom.operators import naming

log = logging.getLogger("name_register")

#: Characters of a stem, and files of notes that one batch takes (null: all that are new).
DEFAULTS = {"longest": 32, "files_a_batch": None}
SCHEMA = "doc_id long, stem string, n_chars long, number long, prefix string, batch long, source string"


def register(spark: SparkSession, out: str) -> DataFrame:
    """The register as it stands; without rows before the first batch."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{out}/register")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def name_batch(notes: DataFrame, batch: int, out: str, longest: int) -> int:
    """Names one batch of notes (doc_id, text, source) and writes it; the rows written. Names go by doc_id in a batch."""
    spark = notes.sparkSession
    rows = notes.select("doc_id", naming.stem(F.col("text"), longest).alias("stem"), F.char_length("text").cast("long").alias("n_chars"), "source")
    used = register(spark, out).where(F.col("batch") < batch).select("stem", "number")  # a batch that is run again doesn't see itself
    named = naming.numbered(rows, "doc_id", used).withColumn("batch", F.lit(batch).cast("long"))
    # a source's rows are spread over the tasks that write it
    w = named.repartition("source", F.pmod(F.xxhash64("doc_id"), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "source")
    w.parquet(f"{out}/register")
    written = register(spark, out).where(F.col("batch") == batch).count()
    log.info("batch %s: %s names written to %s", batch, written, out)
    return written


def run(spark: SparkSession, notes: str, out: str, checkpoint: str, config: dict | None = None) -> dict:
    """Names all notes that are new, waits for the stream to end, and returns what was read and written."""
    c = DEFAULTS | (config or {})
    notes = notes.rstrip("/")
    stream = spark.readStream.schema(spark.read.parquet(notes).schema)
    if c["files_a_batch"]:
        stream = stream.option("maxFilesPerTrigger", c["files_a_batch"])
    read, written = {}, {}

    def one(batch: DataFrame, n: int) -> None:
        read[n] = batch.count()
        written[n] = name_batch(batch, n, out, c["longest"])

    pattern = f"{notes[:-1]}[{notes[-1]}]"  # as a pattern, since a stream's plain path cannot be one file
    query = stream.parquet(pattern).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = {"notes read": sum(read.values()), "batches": len(written), "names written": sum(written.values())}
    log.info("%s -> %s: %s", notes, out, done)
    return done


#: The register by SQL, where one batch has all notes.
ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, source, length(text) AS n_chars, regexp_replace(substring(trim(split_part(coalesce(text, ''), chr(10), 1)), 1, 32), '[^\p{L}\p{N}_-]', '_', 'g') AS clean FROM documents
), n AS (
    SELECT *, CASE WHEN clean = '' THEN 'output' ELSE clean END AS stem, row_number() OVER (PARTITION BY stem ORDER BY doc_id) AS number FROM d
)
SELECT doc_id, source, n_chars, stem, number, CASE WHEN number = 1 AND NOT regexp_matches(stem, '_[0-9]+$') THEN stem ELSE stem || '_' || number END AS prefix FROM n
"""


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("notes", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", help="JSON file of settings")
    a = p.parse_args(argv)
    spark = session("name_register")
    try:
        run(spark, a.notes, a.out, a.checkpoint, read_config(spark, a.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
