"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger has a row for each (blob, rule version) that
was scanned, with what was found. A run scans only pairs that the ledger lacks, each blob once however many paths hold it,
and joins findings back to all paths.

Defined cases: a null text is the empty text; a null doc_id is a path like any other; repeated rows give repeated
results; other columns are ignored; an empty table gives an empty result. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodetext.llm import shared

#: Raised whenever a rule changes, so that ledgers scan all blobs anew under it.
RULES_VERSION = "1"
#: Kinds in the order in which findings that begin together are listed; the first three are the base.
KINDS = ["assign", "access", "hex", "pem", "jwt", "github"]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_RULES = {
    # A run shorter than the bound can't hold a longer one, so the bound can stand in these two patterns.
    "access": re.compile(r"AKIA[A-Z0-9]{14,}"),
    "hex": re.compile(r"[0-9a-f]{16,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    "jwt": re.compile(r"(?<![\w-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.ASCII),
    "github": re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}", re.ASCII),
}
_FOUND = "blob binary, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_SCHEMA = pa.schema([("blob", pa.binary()), *((c, pa.int64()) for c in ("n_assign", "n_access", "n_hex")), ("base_sha256", pa.string()), ("spans", pa.string())])


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end) of all findings, sorted."""
    out = []
    if ":" in text or "=" in text:
        out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    for kind, pattern in _RULES.items():
        out += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text)]
    return sorted(out)


def digest(found: list[tuple[int, int, int]]) -> dict:
    join = lambda rows: ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in rows)
    base = [x for x in found if x[1] < 3]
    return {
        **{f"n_{KINDS[k]}": sum(x[1] == k for x in base) for k in range(3)},
        "base_sha256": hashlib.sha256(join(base).encode()).hexdigest(),
        "spans": join(found),
    }


def _scan(batches):
    for b in batches:
        rows = [{"blob": blob, **digest(find_secrets(text))} for blob, text in zip(b.column("blob").to_pylist(), b.column("text").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null) and blob."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules_version: str = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings for each row of docs, ledger with the new scans). A ledger has the columns of findings by blob and rules_version."""
    all_versions = versions(docs)
    paths = shared.save(all_versions.select("doc_id", "blob"), "paths")
    unseen = paths.groupBy("blob").agg(F.min("doc_id").alias("holder"))  # one path holds the text for all
    if ledger is not None:
        known = ledger.where(F.col("rules_version") == rules_version).dropDuplicates(["blob"])
        unseen = unseen.join(known.select("blob"), "blob", "left_anti")
    unseen = unseen.withColumnRenamed("blob", "wanted")
    texts = all_versions.join(unseen, F.col("doc_id").eqNullSafe(F.col("holder")) & (F.col("blob") == F.col("wanted"))).select("blob", "text")
    # repeated rows give a blob twice; saved, so that the join below has nothing but exchanges beneath it and large blobs can be split
    found = shared.save(shared.save(texts.mapInArrow(_scan, _FOUND), "found").dropDuplicates(["blob"]), "findings")
    new = found.withColumn("rules_version", F.lit(rules_version))
    full = new if ledger is None else ledger.unionByName(new)
    current = found if ledger is None else shared.save(found.unionByName(known.drop("rules_version")), "current")
    return paths.join(current, "blob").drop("blob"), full


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(shared.table(spark, sf_dir, "documents"))[0].select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
