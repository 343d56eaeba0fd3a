"""Secret scans on an incremental blob ledger.

Every historical version of a file is content-addressed by the SHA-256 of its text. The ledger holds one
row for each pair of blob and rule version that was ever scanned, with its findings; a scan looks only at
blobs whose pair is not in the ledger yet, and joins the findings back to all paths that hold the blob.
Every rule begins at a place that its own match cannot contain again, so a scan takes linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, text_chunks

#: Kinds in their order; each is (kind, pattern, group to report, least length of what counts, group that counts).
BASE_RULES = (
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 8, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 16, 0),
    ("hex", re.compile(r"[0-9a-f]+"), 32, 0),
)
#: Rules of the method beyond the base ones.
MORE_RULES = (
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 1, 0),
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 1, 0),
    ("hook", re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}"), 1, 0),
    ("chat", re.compile(r"(?<![A-Za-z0-9_-])xox[abprs]-[A-Za-z0-9-]{20,}"), 1, 0),
    ("cloud", re.compile(r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"), 1, 0),
    ("pay", re.compile(r"(?<![A-Za-z0-9_])[rs]k_live_[A-Za-z0-9]{20,}"), 1, 0),
)
RULE_VERSION = "1.1"
#: Steps in which the paths come to the ledger, as commits would; each scans what no step before it had.
STEPS = 2
FINDINGS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
# the same runs of 32 hex digits and more, found without stopping at shorter ones
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_NEEDS = {"pem": "-----BEGIN ", "jwt": "eyJ", "hook": "gh", "chat": "xox", "cloud": "AIza", "pay": "k_live_"}
_HINT = re.compile(r"(?ai)pass(?:word|wd)|secret|token|api_?key")


def find_spans(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, is base) in code points, by start and then kind as listed."""
    out = []
    for order, (kind, pattern, least, group) in enumerate((*BASE_RULES, *MORE_RULES)):
        if kind == "hex":
            pattern = _LONG_HEX
        elif kind == "assign" and not _HINT.search(text) or kind == "access" and "AKIA" not in text:
            continue
        elif kind in _NEEDS and _NEEDS[kind] not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), order, m.end(), kind))
    return [(s, e, kind, order < len(BASE_RULES)) for s, order, e, kind in sorted(out)]


def digest(text: str) -> tuple[int, int, int, str, str]:
    spans = find_spans(text)
    show = lambda xs: ",".join(f"{k}:{s}:{e}" for s, e, k, _ in xs)
    base = [x for x in spans if x[3]]
    count = lambda kind: sum(x[2] == kind for x in base)
    return count("assign"), count("access"), count("hex"), hashlib.sha256(show(base).encode()).hexdigest(), show(spans)


class BlobLedger:
    """Findings by (blob, rule_version) in a Parquet folder of the shared store."""

    SCHEMA = f"blob string, rule_version string, {FINDINGS}"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "blob-ledger")
        self.spark.createDataFrame([], self.SCHEMA).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        """Each pair once; scans at one time may both have added a pair, with the same findings."""
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).dropDuplicates(["blob", "rule_version"])

    def scan(self, versions: DataFrame, rule_version: str = RULE_VERSION) -> None:
        """Scan the blobs of ``versions`` (blob, text) that the ledger lacks under this rule version and add
        them. One text of each blob meets in the aggregation, combined before the shuffle."""
        seen = self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("rule_version") == rule_version).select("blob")
        unseen = versions.join(seen, "blob", "left_anti").groupBy("blob").agg(F.first("text").alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in text_chunks(batches, 1):
                found = list(zip(*(digest(t or "") for t in b.column(1).to_pylist()), strict=True))
                cols = [b.column(0), pa.array([rule_version] * b.num_rows), *(pa.array(c, pa.int64()) for c in found[:3]), *(pa.array(c, pa.string()) for c in found[3:])]
                yield pa.RecordBatch.from_arrays(cols, ["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

        unseen.mapInArrow(run, self.SCHEMA).write.mode("append").option("compression", "zstd").parquet(self.path)


def scan_paths(versions: DataFrame, ledger: BlobLedger | None = None, rule_version: str = RULE_VERSION, steps: int = STEPS) -> DataFrame:
    """The paths come to the ledger in ``steps``, and a blob that an earlier step or scan has is not scanned again. Findings of every row of ``versions`` (doc_id as path, text): doc_id, blob, n_assign, n_access, n_hex,
    base_sha256, spans. Null text is an empty blob with no findings. Repeated rows each get their findings.
    Empty input: no rows. Other columns are ignored. Texts are scanned whole.
    """
    ledger = ledger or BlobLedger(versions.sparkSession)
    blobs = versions.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("blob"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for k in range(steps):
        ledger.scan(blobs.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) == k).select("blob", "text"), rule_version)
    known = ledger.rows().where(F.col("rule_version") == rule_version).drop("rule_version")
    return blobs.select("doc_id", "blob").join(known, "blob").select("doc_id", "blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
