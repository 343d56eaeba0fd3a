"""Line dedup on levelled sorted runs of line hashes.

A run is a table of line hashes, bucketed and sorted by hash, with a number of documents that hold the line and the
largest doc_id among them. A new batch is aggregated per line and merge-anti-joined with the runs: lines that no
run has are fresh, and make the batch's own run at level 0; a level that has ``fanout`` runs is compacted into one
run of the next level. So every line is in one run alone, that of the batch which had it first. Lines of a batch that
are not fresh are counted on in runs of increments, compacted in the same way, and a line's whole count is that of
its run with its increments. Runs share their bucketing, so neither the joins nor a compaction of increments
shuffles a run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, discard, drop_path, materialize, scratch_path, shuffle_width

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: F.Column) -> F.Column:
    """The line stripped of white space at both ends, with A-Z lower-cased (other letters stay)."""
    s = F.btrim(line, F.lit(WS_CHARS))
    ascii_only = F.octet_length(s) == F.char_length(s)  # there, the quick lower() gives the same
    return F.when(ascii_only, F.lower(s)).otherwise(F.translate(s, UPPER, UPPER.lower()))


def key_hash(key: F.Column) -> F.Column:
    """128 bits in two columns: under 1e-14 odds that any two of 1e12 lines collide."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def lines_of(text: F.Column) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """The levelled runs of one corpus, kept in the shared folder as bucketed tables."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or shuffle_width(spark)
        self.levels: list[list[str]] = []
        self.increments: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch_path(self.spark, name)
        (
            rows.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
            .option("compression", "zstd").option("path", self.paths[name]).saveAsTable(name)
        )
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        drop_path(self.spark, self.paths.pop(name))

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _table(self, name: str) -> DataFrame:
        return self.spark.table(name).select("h1", "h2", "n_docs", "max_doc")

    def _together(self, names: list[str]) -> DataFrame:
        """All rows of runs that have no line in common."""
        every = self._table(names[0])
        for name in names[1:]:
            every = every.unionByName(self._table(name))
        return every

    def _summed(self, names: list[str]) -> DataFrame:
        """One row per line hash over runs of increments, merged two by two: a full outer merge join of runs of one
        bucketing keeps it, where an aggregation over their union would be given wrong groups."""
        every = self._table(names[0])
        for name in names[1:]:
            more = self._table(name).withColumnsRenamed({"n_docs": "n2", "max_doc": "m2"})
            both = every.hint("merge").join(more, ["h1", "h2"], "full")
            n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n2", F.lit(0))
            every = both.select("h1", "h2", n.alias("n_docs"), F.greatest("max_doc", "m2").alias("max_doc"))
        return every

    def known(self) -> DataFrame | None:
        """One row per line hash, or None before the first batch: the lines of each run with their increments."""
        if not self.runs():
            return None
        more = [name for level in self.increments for name in level]
        out = None
        for name in self.runs():
            lines = self._table(name)
            if more:
                added = self._summed(more).withColumnsRenamed({"n_docs": "n2", "max_doc": "m2"})
                both = lines.hint("merge").join(added, ["h1", "h2"], "left")
                lines = both.select("h1", "h2", (F.col("n_docs") + F.coalesce("n2", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "m2").alias("max_doc"))
            out = lines if out is None else out.unionByName(lines)
        return out

    def fresh(self, batch: DataFrame) -> DataFrame:
        """Rows (h1, h2, ...) of a batch whose line is in no run: one merge anti-join for each run."""
        for name in self.runs():
            batch = batch.join(self.spark.table(name).hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (doc_id, h1, h2): its fresh lines as a run, and of its other lines what it adds to their counts;
        then compact full levels."""
        per_line = batch.distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))
        if not self.runs():
            self._add(self.levels, self._write(per_line), self._together)
            return
        per_line = materialize(per_line, "line-batch")
        name = self._write(self.fresh(per_line))
        again = self._write(per_line.join(self.spark.table(name).hint("merge"), ["h1", "h2"], "left_anti"))
        discard(per_line)
        self._add(self.levels, name, self._together)
        self._add(self.increments, again, self._summed)

    def _add(self, levels: list[list[str]], name: str, compacted: Callable[[list[str]], DataFrame]) -> None:
        if not levels:
            levels.append([])
        levels[0].append(name)
        k = 0
        while len(levels[k]) >= self.fanout:
            merged = self._write(compacted(levels[k]))
            for old in levels[k]:
                self._drop(old)
            levels[k] = []
            if len(levels) == k + 1:
                levels.append([])
            levels[k + 1].append(merged)
            k += 1

    def drop(self) -> None:
        for name in [*self.runs(), *(name for level in self.increments for name in level)]:
            self._drop(name)
        self.levels, self.increments = [], []


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 3) -> DataFrame:
    """``docs`` with ``kept`` (text without dropped lines), ``n_lines`` and ``n_dropped``; all columns stay.

    A line whose key has at least ``min_chars`` code points and lies in at least ``min_docs`` documents is
    kept only in the largest doc_id that holds it. Rows with one doc_id count as one document, and the
    batches are dealt by doc_id so that they meet in one batch. A null doc_id counts as one document that
    never is the largest one and loses no line. Null text: one empty line, kept as ''. Repeated lines of one
    document go, or stay, together. Empty input: no rows. Columns named like the results are replaced.
    """
    spark = docs.sparkSession
    d = docs.drop("kept", "n_lines", "n_dropped")
    # texts tell rows of one doc_id apart, and are hashed before they are split; a place is a line's number
    lines = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    lines = lines.select("doc_id", "t", F.posexplode(lines_of(F.col("text"))).alias("at", "_line"))
    lines = lines.withColumn("_k", line_key(F.col("_line"))).where(F.char_length("_k") >= min_chars)
    lines = lines.select("doc_id", "t", "at", key_hash(F.col("_k")).alias("_h")).select("doc_id", "t", "at", "_h.h1", "_h.h2")
    lines = lines.withColumn("batch", F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(batches)).cast("int"))
    lines = materialize(lines, "lines", partition_by="batch")
    runs = LineRuns(spark)
    try:
        for b in range(batches):
            runs.add(lines.where(F.col("batch") == b).select("doc_id", "h1", "h2"))
        often = materialize(runs.known().where(F.col("n_docs") >= min_docs).select("h1", "h2", "max_doc"), "often-lines")
    finally:
        runs.drop()

    # AQE splits a line that very many documents hold; the lists below are at most one document's places
    losing = lines.join(often, ["h1", "h2"]).where(F.col("doc_id") < F.col("max_doc"))
    losing = losing.groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).agg(F.collect_set("at").alias("_gone"))
    d = d.join(losing, (d["doc_id"] == losing["_d"]) & (F.xxhash64(d["text"]) == losing["_t"]), "left").drop("_d", "_t")

    def stay(lines: F.Column) -> F.Column:
        # a difference of sets of whole numbers keeps the order and takes time in proportion to the lines
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
        kept = F.when(F.col("_gone").isNull(), lines).otherwise(F.transform(places, lambda i: F.get(lines, i)))
        return F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(kept)).alias("gone"), F.array_join(kept, "\n").alias("kept"))

    # as the variable of a lambda, the lines are split once and not anew for each place
    d = d.withColumn("_r", F.get(F.transform(F.array(lines_of(F.col("text"))), stay), 0))
    return d.select(*docs.drop("kept", "n_lines", "n_dropped").columns, F.col("_r.n").cast("long").alias("n_lines"), F.col("_r.gone").cast("long").alias("n_dropped"), F.col("_r.kept").alias("kept"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, (o.top IS NOT NULL AND k.doc_id < o.top) AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
