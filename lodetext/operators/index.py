"""Index tables of one text column: postings by block of rows, term statistics and blocks, all as Parquet.

A block is BLOCK_ROWS consecutive rows of one file. Postings only prune; rows are verified against their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodetext.functions.tokenizer import TOKENIZERS, tokens, with_tokens

BLOCK_ROWS = 1000
#: A segment's tables are cut into ranges of about so many bytes; what a posting takes at most once its columns are encoded.
RANGE_BYTES, POSTING_BYTES = 256 << 20, 8


def located(spark: SparkSession, files: list[str], columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Rows with the file and the place in it: _file, _row. With a schema no file is opened beforehand, and columns that a file lacks are null."""
    df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(*files)
    return df.select(*([F.col(f"`{c}`") for c in columns] if columns is not None else ["*"]), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def tokenised(rows: DataFrame, column: str, tokenizer: str, block_rows: int) -> DataFrame:
    if TOKENIZERS[tokenizer] is tokens:
        rows, by_column, _ = with_tokens(rows, [column])
        found = by_column[column]
    else:
        found = TOKENIZERS[tokenizer](F.col(f"`{column}`"))
    return rows.select("_file", F.expr(f"_row div {block_rows}").alias("block"), F.coalesce(found, F.array().cast("array<string>")).alias("tokens"))


def postings(rows: DataFrame) -> DataFrame:
    """term, file, block, and in how many rows of the block the term is. Summed within tasks before anything is moved."""
    return rows.select("_file", "block", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term", "_file", "block").agg(F.count(F.lit(1)).alias("row_hits")).withColumnRenamed("_file", "file")


def blocks(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("_file").alias("file"), "block").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("tokens")).cast("long").alias("tokens"))


def term_stats(found: DataFrame) -> DataFrame:
    return found.groupBy("term").agg(F.sum("row_hits").alias("df"))


def _count(batches, block_rows: int):
    """Arrow batches of file, no, block, n and terms to those of COUNTED. Rows of a block follow one another, so each term comes once a block, unless a batch or a split parts the block: part, its rows being fewer than block_rows.

    A batch's postings are in order of term and block: sorting them all then merges runs.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ["file", "no", "block", "term", "rows", "tokens", "part"]
    for b in batches:
        if not b.num_rows:
            continue
        no, block, terms = (b.column(b.schema.get_field_index(c)) for c in ("no", "block", "terms"))
        a, k = no.to_numpy(zero_copy_only=False), block.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (k[1:] != k[:-1])])
        rows = np.diff(np.r_[starts, len(a)])
        first = pa.array(starts)
        tokens = np.add.reduceat(b.column(b.schema.get_field_index("n")).to_numpy(zero_copy_only=False).astype(np.int64), starts)
        none = pa.nulls(len(starts), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("file")).take(first), no.take(first), block.take(first), none, pa.array(rows.astype(np.int64)), pa.array(tokens), pa.array(rows < block_rows)], names)
        run = np.repeat(np.repeat(np.arange(len(starts)), rows), np.diff(terms.offsets.to_numpy()))
        coded = terms.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        words = coded.dictionary.take(pa.array(order))
        pairs, hits = np.unique(place[coded.indices.to_numpy()] * len(starts) + run, return_counts=True)
        for k in range(0, len(pairs), 100_000):
            term, run = np.divmod(pairs[k : k + 100_000], len(starts))
            at = pa.array(starts[run])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(run), pa.string()), no.take(at), block.take(at), words.take(pa.array(term)), pa.array(hits[k : k + 100_000].astype(np.int64)), pa.nulls(len(run), pa.int64()), pa.array(rows[run] < block_rows)], names)


#: Postings, and blocks in rows without a term, which alone have the file's name. no: the hash of that name.
COUNTED = "file string, no long, block long, term string, rows long, tokens long, part boolean"


def counted(rows: DataFrame, block_rows: int) -> DataFrame:
    """Postings and blocks in one pass over the tokens, summed within batches; nothing is moved."""
    one = rows.select(F.col("_file").alias("file"), F.xxhash64("_file").alias("no"), "block", F.size("tokens").alias("n"), F.array_distinct("tokens").alias("terms"))
    return one.mapInArrow(lambda batches: _count(batches, block_rows), COUNTED)


def ranged(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Sorted disjoint ranges of the keys: as many as rows need by RANGE_BYTES, where that is more than there are shuffle partitions."""
    n = -(-rows * POSTING_BYTES // RANGE_BYTES)
    few = n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # without a number, small ranges are joined
    return (df.repartitionByRange(*keys) if few else df.repartitionByRange(n, *keys)).sortWithinPartitions(*keys)


def index_segment(rows: DataFrame, block_rows: int, path: str) -> dict:
    """A segment of the rows of tokenised(). Texts are read and tokenised once: what is counted is saved, as finding the ranges reads it again. Only postings of parted blocks are summed by a shuffle."""
    spark = rows.sparkSession
    counted(rows, block_rows).write.parquet(f"{path}/counted")
    saved = spark.read.schema(COUNTED).parquet(f"{path}/counted")
    in_blocks = saved.where("term IS NULL").groupBy("file", "block").agg(F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"))
    hits = saved.where("term IS NOT NULL").select("term", "no", "block", F.col("rows").alias("row_hits"), "part")
    parted = hits.where("part").groupBy("term", "no", "block").agg(F.sum("row_hits").alias("row_hits"))
    totals = write_segment(hits.where("NOT part").drop("part").unionByName(parted), in_blocks, path)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/counted")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return totals


def write_segment(found: DataFrame, in_blocks: DataFrame, path: str) -> dict:
    """Writes the tables of one segment, sorted by term for min/max pruning (and by reversed term for suffixes); returns its totals.

    Postings are cut by term, file and block, so that a term in every block is dealt over ranges like any other. They are moved with the hash of the file's name (no) in
    its place, and get the name when they are written.
    """
    spark = found.sparkSession
    in_blocks.write.parquet(f"{path}/blocks")
    placed = spark.read.parquet(f"{path}/blocks").withColumn("no", F.xxhash64("file"))
    b = placed.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0)), F.countDistinct("file"), F.countDistinct("no")).first()
    if b[2] != b[3]:
        raise ValueError("two files have names of one hash")
    if "no" not in found.columns:
        found = found.select("term", F.xxhash64("file").alias("no"), "block", "row_hits")
    named = ranged(found, b[1], "term", "no", "block").join(F.broadcast(placed.select("file", "no").distinct()), "no")
    named.select("term", "file", "block", "row_hits").write.parquet(f"{path}/postings")
    ranged(term_stats(spark.read.parquet(f"{path}/postings")), 0, "term").withColumn("reversed", F.reverse("term")).write.parquet(f"{path}/terms")
    saved = spark.read.parquet(f"{path}/terms")
    ranged(saved, 0, "reversed").write.parquet(f"{path}/suffixes")
    t = saved.agg(F.min("term"), F.max("term"), F.count(F.lit(1))).first()
    return {"min_term": t[0], "max_term": t[1], "term_count": t[2], "total_rows": b[0], "total_tokens": b[1]}
