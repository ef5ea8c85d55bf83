"""Secret scans with an incremental ledger of blobs, in DataFrame functions only.

Every version of a text is named by the SHA-256 of its content. The ledger is a folder
with two Parquet tables. ``findings`` holds which (blob, rule version) pairs have been
scanned and what each rule version found; ``paths`` holds which document, or path, ever
held which blob. A scan reads only blobs for which some rule version is missing, each
content once however many paths and versions hold it, applies only the missing rules,
appends to both tables and joins the findings back to all paths. A changed rule gets a
new version and is then unseen for every blob; findings of rule versions that are not
asked for stay in the ledger and are not reported.

Rules: ``assign``, ``access`` and ``hex`` are the base; ``pem`` and ``service`` add
key headers and tokens with known prefixes. Matches of a rule are leftmost and do
not overlap; those that fail its length are dropped.

Null texts are empty and have no findings. Repeated rows share one blob and each
gets the findings. Null ids are kept. The time for a very long text with very many
matches stays in proportion to them. Other columns are left out; an empty table
scans nothing.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import texts
from tracewell.llm.spans import SPAN, counted, hits, listed, of_kinds, spans
from tracewell.storage import keep, scratch_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``checked`` is the group whose length counts."""

    kind: str
    version: int
    pattern: str
    checked: int = 0
    at_least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def found(self, text: Column, rank: int) -> Column:
        all_hits = hits(text, self.pattern)
        if self.checked:
            all_hits = F.filter(all_hits, lambda h: F.length(F.regexp_extract(h["hit"], self.pattern, self.checked)) >= self.at_least)
        elif self.at_least:
            all_hits = F.filter(all_hits, lambda h: h["end"] - h["start"] >= self.at_least)
        return spans(all_hits, self.kind, rank)


BASE = (  # fixed values: the base patterns; a run of hex shorter than asked could only be dropped, so the pattern asks at once
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
RULES = (
    *BASE,
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("service", 1, r"(?:gh[opsur]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})"),
)
FINDINGS = f"blob string, found map<string, {SPAN}>"  # by rule version, for each that has been applied
PATHS = "doc_id long, blob string"


def read_ledger(spark: SparkSession, ledger: str | None, part: str = "findings") -> DataFrame:
    """One of the ledger's tables; empty where nothing has been written yet."""
    schema = FINDINGS if part == "findings" else PATHS
    if ledger:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{part}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.read.schema(schema).parquet(f"{ledger}/{part}")
    return spark.createDataFrame([], schema)


def named(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.sha2("text", 256).alias("blob"), "text")


def scan(versions: DataFrame, known: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings of the (blob, rule version) pairs of ``versions`` (text) that ``known`` lacks."""
    asked = F.array(*(F.lit(r.key) for r in rules))
    blobs = versions.select(F.sha2("text", 256).alias("blob"), "text").dropDuplicates(["blob"])
    done = known.groupBy(F.col("blob").alias("_blob")).agg(F.array_distinct(F.flatten(F.collect_list(F.map_keys("found")))).alias("done"))  # a row per scan of the blob
    todo = blobs.join(done, blobs["blob"] == done["_blob"], "left").select(
        "blob", "text", F.array_except(asked, F.coalesce("done", F.array().cast("array<string>"))).alias("rules")).filter(F.size("rules") > 0)
    found = F.map_filter(F.create_map(*(x for rank, r in enumerate(rules) for x in (
        F.lit(r.key), F.when(F.array_contains("rules", r.key), r.found(F.col("text"), rank))))), lambda _, spans: spans.isNotNull())
    return todo.select("blob", found.cast(f"map<string, {SPAN}>").alias("found"))


def report(refs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, found): the findings of just these rule versions on every row of ``refs`` (doc_id, blob)."""
    keys = [r.key for r in rules]
    asked = F.flatten(F.map_values(F.map_filter("found", lambda key, _: key.isin(keys))))
    per_blob = ledger.select(F.col("blob").alias("_blob"), asked.alias("found")).filter(F.size("found") > 0)
    per_blob = per_blob.groupBy("_blob").agg(F.flatten(F.collect_list("found")).alias("found"))  # a row per scan of the blob
    return refs.join(per_blob, refs["blob"] == per_blob["_blob"], "left").select(
        "doc_id", F.coalesce("found", F.array().cast(SPAN)).alias("found"))


def update(docs: DataFrame, ledger_path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what the ledger has not seen and write it there, paths too: all findings, old and new."""
    spark, rows = docs.sparkSession, texts(docs)
    known = read_ledger(spark, ledger_path)
    keep_to(scan(rows, known, rules), f"{ledger_path}/findings")
    seen = read_ledger(spark, ledger_path, "paths").select(F.col("doc_id").alias("_id"), F.col("blob").alias("_blob"))
    refs = named(rows).select("doc_id", "blob").distinct()
    keep_to(refs.join(seen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("blob") == F.col("_blob")), "left_anti"), f"{ledger_path}/paths")
    return read_ledger(spark, ledger_path)


def keep_to(fresh: DataFrame, path: str) -> None:
    """Append to a table that the rows themselves are compared with: written apart first, as the table may not grow under the reader."""
    keep(fresh).write.mode("append").parquet(path)


def scan_all(docs: DataFrame, ledger_path: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what the ledger has not seen, append to it, and report on these rows: (doc_id, found).

    Without a path the ledger lives below the shared folder for this call.
    """
    ledger = update(docs, ledger_path or scratch_path(docs.sparkSession, "ledger"), rules)
    return report(named(texts(docs)).select("doc_id", "blob"), ledger, rules)


def report_all(spark: SparkSession, ledger_path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, found) of every path and version that the ledger has ever seen."""
    return report(read_ledger(spark, ledger_path, "paths"), read_ledger(spark, ledger_path), rules)


def scan_in_steps(docs: DataFrame) -> DataFrame:
    """(doc_id, found) by all rules, when the base rules had been applied before: the second step applies the others only."""
    ledger_path = scratch_path(docs.sparkSession, "ledger")
    update(docs, ledger_path, BASE)
    return scan_all(docs, ledger_path)


def digests(found: DataFrame) -> DataFrame:
    base = of_kinds(F.col("found"), [r.kind for r in BASE])
    return found.select(
        "doc_id", *(counted(F.col("found"), r.kind).alias(f"n_{r.kind}") for r in BASE),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
