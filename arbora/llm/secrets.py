"""Secret scan over an incremental blob ledger.

Each version of each path is addressed by the SHA-256 of its content.  The
ledger is a table of (blob, rule version) pairs already scanned and another of
their findings.  A run scans only the pairs that the ledger lacks, one text for
each blob however many paths hold it, appends both tables and joins findings
back to every path.

Only ids move between tasks to choose the texts; texts move once, hashed by
path, to meet the work list, so copies of one blob spread over all tasks.

Defined cases: a null content is the empty blob and has no findings; repeated
rows are kept, null paths too; a hundred thousand paths of one blob are one
scan; very long contents are scanned whole; spans that start together stand in
the order of their kinds; extra columns, of whatever names, stay in ``redact``
and are ignored otherwise; no rows give no rows and an unchanged ledger.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import storage, textkit

#: Goes up with every change to a rule below; a new version makes all blobs unseen.
RULE_VERSION = 1

# The base kinds.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_MIN, ACCESS_MIN = 8, 16

#: Kinds beside the base ones: (kind, what a text with a match contains, pattern).
MORE = (
    ("github", "gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    ("slack", "xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    ("jwt", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")),
    ("pem", "-----BEGIN", re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----")),
    ("google", "AIza", re.compile(r"\bAIza[A-Za-z0-9_-]{35}")),
)
KINDS = ("assign", "access", "hex", *(k for k, _, _ in MORE))
_KEYWORD = re.compile(r"(?i:passw|secret|token|api_?key)", re.A)

SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then kind as listed; code points, end exclusive."""
    found = []
    if _KEYWORD.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for k, (_, sign, pattern) in enumerate(MORE, 3):
        if sign in text:
            found += [(m.start(), k, m.end()) for m in pattern.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        blobs, found = [], []
        for blob, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if spans := find_spans(text.as_py() or ""):
                blobs.append(blob)
                found.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(found, kind)], ["blob", "spans"])
    batch = None
    textkit.release()


class BlobLedger:
    """The pairs scanned so far and their findings, as two Parquet tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return storage.no_rows(self.spark, schema)

    def seen(self) -> DataFrame:
        return self._table("seen", "blob string, rule_version int")

    def findings(self) -> DataFrame:
        return self._table("findings", f"blob string, rule_version int, spans {SPANS}")

    def update(self, versions: DataFrame, path: str, content: str, rule_version: int = RULE_VERSION) -> DataFrame:
        """Scan what is unseen in ``versions`` (columns ``path`` and ``content``); return path, blob, spans (null: none)."""
        text = F.coalesce(F.col(content), F.lit(""))
        addressed = versions.select(F.col(path).alias("path"), F.sha2(text, 256).alias("blob"))
        addressed, address_path = storage.materialize(addressed, "blobs")
        # One path of each unseen blob; the count of a path's rows does not matter, any of them has the text if the blob agrees.
        work = addressed.groupBy("blob").agg(F.min("path").alias("path"))
        done = self.seen().where(F.col("rule_version") == rule_version).select("blob")
        work = work.join(done, "blob", "left_anti").withColumnRenamed("path", "one").withColumnRenamed("blob", "wanted")
        texts = versions.select(F.col(path).alias("path"), text.alias("content")).where(F.length("content") > 0)
        picked = texts.join(work.hint("shuffle_hash"), F.col("path").eqNullSafe(F.col("one")) & (F.sha2(F.col("content"), 256) == F.col("wanted")), "inner")
        found = picked.select(F.col("wanted").alias("blob"), "content").mapInArrow(_scan, f"blob string, spans {SPANS}")
        new, _ = storage.materialize(found.dropDuplicates(["blob"]), "findings")
        new.withColumn("rule_version", F.lit(rule_version)).select("blob", "rule_version", "spans").write.mode("append").parquet(f"{self.path}/findings")
        # Written last: if a run fails before this, its blobs count as unseen and are scanned again.
        work.select(F.col("wanted").alias("blob"), F.lit(rule_version).alias("rule_version")).write.mode("append").parquet(f"{self.path}/seen")
        # As a table of its own, so that the join exchanges both sides and a blob of very many paths can be split.
        known, _ = storage.materialize(self.findings().where(F.col("rule_version") == rule_version).dropDuplicates(["blob"]).select("blob", "spans"), "known")
        return addressed.join(known, "blob", "left")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", ledger: str | None = None) -> DataFrame:
    """Every row's key with its blob and spans; a ledger of this run's own unless a path is given."""
    spark = docs.sparkSession
    found = BlobLedger(spark, ledger or storage.new_path(spark, "ledger")).update(docs, key, text)
    return found.withColumn("spans", F.coalesce("spans", F.array().cast(SPANS))).withColumnRenamed("path", key)


def joined(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end, comma-joined, of some kinds or all."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; rows without findings stay as they are.

    Overlapping spans are replaced as one.  Rows meet their findings by blob, in a join that adaptive
    execution may split where one blob has very many copies; most rows without findings do not go there.
    """
    found, _ = storage.materialize(scan(docs, key, text).where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"]), "found")
    names, blob, spans = docs.columns, storage.free_name(docs, "blob"), storage.free_name(docs, "spans")
    own = docs.withColumn(blob, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    flagged = storage.marked(own, blob, found.select("blob"), flag := storage.free_name(own, "flag"))
    both = flagged.where(F.col(flag)).join(found.select(F.col("blob").alias(blob), F.col("spans").alias(spans)), blob, "left")
    merged = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc)
        .when(s["start"] < acc["at"], F.struct(acc["out"].alias("out"), s["end"].alias("at")))
        .otherwise(F.struct(F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"), s["end"].alias("at"))),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.lit(2**31 - 1) - acc["at"])),
    )
    done = both.withColumn(text, F.when(F.col(spans).isNotNull(), merged).otherwise(F.col(text)))
    return done.select(*names).union(flagged.where(~F.col(flag)).select(*names))
