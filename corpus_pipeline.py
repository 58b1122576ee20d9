"""A training corpus from `documents`: language ID, line dedup, near duplicates, decontamination, packing.

STAGES are (name, function); each function takes (spark, docs, sf_dir), docs being what the stage before kept, written as Parquet and read again. All but the last
return the columns of docs. A stage first deletes the scratch tables that the stage before it made over the same folder; other tables stay.

Defined cases: those of the operators. Rows with a null or letterless text go in the first stage, and rows whose label the network contradicts with a high score; a null label becomes the network's. Rows
with a null doc_id are linked with nothing and keep their lines; of rows with one doc_id and one text the near-duplicate stage keeps one (the first in the order of their JSON), rows with one doc_id and
different texts are one document and stay or go together; without labelled documents nothing has a known language, and nothing is kept.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodetext.llm import decontaminate, jaccard_join, language_id, line_dedup, packing, shared


_left: dict[tuple[str, str], list[str]] = {}


@contextlib.contextmanager
def _scratch(spark: SparkSession, sf_dir: str):
    """Deletes what the stage before left, and remembers what this one leaves."""
    key = (spark.sparkContext.applicationId, sf_dir)
    for path in _left.pop(key, []):
        shared.delete(spark, path)
    with shared.scratch() as paths:
        yield
    _left[key] = paths


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language (null ones, those without letters, and all if there is nothing to learn from) and those in another language than their label says; labels those without."""
    with _scratch(spark, sf_dir):
        model = language_id.fit(docs.select("doc_id", "text", "lang").where(shared.id_remainder("doc_id", 5) != 0))
        return language_id.without_rejected(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that op9's rule drops; n_chars follows."""
    own = {c: shared.fresh(docs.columns) + c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}  # the operator has columns of these names
    with _scratch(spark, sf_dir):
        out = line_dedup.dedup_lines(docs.withColumnsRenamed(own)).drop("n_lines", "n_dropped").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest doc_id stays, once."""
    with _scratch(spark, sf_dir):
        found = jaccard_join.jaccard_components(docs)
        added = shared.fresh(docs.columns)
        loser, twice, own_text, place = (added + x for x in ("loser", "twice", "text", "place"))
        losers = shared.save(found.where("component_id <> doc_id").select(F.col("doc_id").alias(loser)).distinct(), "losers")
        kept = docs.join(losers, F.col("doc_id") == F.col(loser), "left_anti")
        repeated = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(twice)).count().where("count > 1").select(twice)
        if repeated.isEmpty():
            return kept
        repeated = shared.save(repeated, "repeated")
        once = kept.join(repeated, F.col("doc_id") == F.col(twice), "left_anti")
        again = kept.join(repeated, F.col("doc_id") == F.col(twice), "left_semi").withColumn(own_text, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
        first = F.row_number().over(Window.partitionBy("doc_id", own_text).orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))))
        return once.unionByName(again.withColumn(place, first).where(F.col(place) == 1).drop(place, own_text))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    with _scratch(spark, sf_dir):
        return decontaminate.decontaminate(docs, shared.table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence."""
    with _scratch(spark, sf_dir):
        return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The first stage's network can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    root = f"{shared.scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{root}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            shared.delete(spark, f"{root}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
