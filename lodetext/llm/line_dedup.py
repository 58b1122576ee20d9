"""Line dedup over the whole corpus: hashes are range-partitioned and sorted, first occurrences are streamed out.

Every line gets a key (stripped of ASCII white space, A-Z lowered) and a 128-bit hash of it. Hashes are dealt by range over
(hash, document descending, position), so a hash that holds a third of all lines is cut over many partitions. Each sorted
partition is streamed twice: once for the two runs at its edges (two rows a partition reach the driver, whatever the data),
once for the decisions. What is returned per document is a compressed keep bitmap, not text.

Defined cases: a null or empty text is one empty line; rows with a null doc_id keep all lines and count nowhere; rows with one
doc_id are one document; columns other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodetext.llm import shared

_LINES = "h1 long, h2 long, doc_id long, row long, pos int"


def _order() -> list[F.Column]:
    return [F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("row"), F.col("pos")]


def _row_key(text: F.Column) -> F.Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _hash_lines(min_chars: int):
    from xxhash import xxh3_128_digest

    blanks = shared.BLANKS.encode()

    def run(batches):
        shared.drop_caches()
        for b in batches:
            digests, at, pos = [], [], []
            for k, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                if len(text) < min_chars:
                    continue
                for p, line in enumerate(text.lower().split(b"\n")):
                    key = line.strip(blanks)
                    if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                        digests.append(xxh3_128_digest(key))
                        at.append(k)
                        pos.append(p)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), b.column("doc_id").take(take), b.column("row").take(take), pa.array(pos, pa.int32())],
                names=["h1", "h2", "doc_id", "row", "pos"],
            )

    return run


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first row always does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _edges(batches):
    """For the first and the last run of a partition: its hash, how many documents, the first and last of them."""
    from pyspark import TaskContext

    first, last, runs = None, None, 0
    for b in batches:
        h1, h2, doc = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "doc_id"))
        if not len(h1):
            continue
        begin = np.flatnonzero(_changes(h1, h2))
        docs = np.add.reduceat(_changes(h1, h2, doc).astype(np.int64), begin)
        final = np.append(begin[1:], len(h1)) - 1
        for k in {0, len(begin) - 1} if len(begin) > 1 else {0}:
            run = [int(h1[begin[k]]), int(h2[begin[k]]), int(docs[k]), int(doc[begin[k]]), int(doc[final[k]])]
            if k == 0 and last and last[:2] == run[:2]:
                last[2] += run[2] - (last[4] == run[3])
                last[4] = run[4]
            else:
                last = run
            if k == 0:
                first = first or last
        runs += len(begin)
    if first:
        rows = [first, last] if first is not last else [first]
        yield pa.RecordBatch.from_pylist([dict(zip(("pid", "h1", "h2", "docs", "top", "low"), [TaskContext.get().partitionId(), *r], strict=True)) for r in rows], schema=pa.schema([("pid", pa.int32()), *((c, pa.int64()) for c in ("h1", "h2", "docs", "top", "low"))]))


def _resolve(edges: list) -> dict[int, dict[tuple[int, int], tuple[int, int]]]:
    """For each partition, the number of documents and the keeper of each run that may go on in a neighbour."""
    out: dict = {}
    chain: list = []

    def close() -> None:
        if len(chain) > 1:
            total = sum(e.docs for e in chain) - sum(x.low == y.top for x, y in zip(chain, chain[1:]))
            for e in chain:
                out.setdefault(e.pid, {})[e.h1, e.h2] = (total, chain[0].top)

    for e in sorted(edges, key=lambda e: (e.pid, e.h1, e.h2)):
        if chain and (e.h1, e.h2) != (chain[-1].h1, chain[-1].h2):
            close()
            chain.clear()
        chain.append(e)
    close()
    return out


def _stream_drops(known: dict, min_docs: int):
    names = ["doc_id", "row", "pos"]

    def run(batches):
        from pyspark import TaskContext

        mine = known.get(TaskContext.get().partitionId(), {})
        held = None  # rows of a run that isn't over and hasn't enough documents yet
        hot = None  # hash, keeper and last document of a run that has

        def decide(cols, over):
            """Rows to drop, rows to hold back and the state of the last run."""
            nonlocal hot
            h1, h2, doc = cols[:3]
            begin = np.flatnonzero(_changes(h1, h2))
            docs = np.add.reduceat(_changes(h1, h2, doc).astype(np.int64), begin)
            keeper = doc[begin].copy()
            if hot and (h1[0], h2[0]) == hot[0]:
                docs[0], keeper[0] = min_docs, hot[1]
            for k in {0, len(begin) - 1}:
                if (key := (int(h1[begin[k]]), int(h2[begin[k]]))) in mine:
                    docs[k], keeper[k] = mine[key]
            ends = np.append(begin[1:], len(h1))
            keep_back = None
            if not over:
                if docs[-1] >= min_docs:
                    hot = ((h1[-1], h2[-1]), keeper[-1])
                else:
                    keep_back = [c[begin[-1] :] for c in cols]
                    hot = None
            run_of = np.repeat(np.arange(len(begin)), ends - begin)
            drop = (docs[run_of] >= min_docs) & (doc != keeper[run_of])
            return pa.RecordBatch.from_arrays([pa.array(c[drop]) for c in cols[2:]], names=names), keep_back

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", *names)]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            out, held = decide(cols, False)
            yield out
        if held:
            yield decide(held, True)[0]

    return run


@F.pandas_udf(T.BinaryType())
def _bitmap(dropped: pd.Series) -> pd.Series:
    def pack(pos) -> bytes:
        keep = np.ones(int(max(pos)) // 8 * 8 + 8, bool)  # whole bytes: the bits after the last dropped line keep theirs
        keep[np.asarray(pos)] = False
        return zlib.compress(np.packbits(keep).tobytes(), 6)

    return dropped.map(pack)


def kept_lines(lines: list, bitmap: bytes | None) -> list:
    """The lines that a keep bitmap leaves; lines beyond its end stay."""
    if not bitmap:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
    return [x for k, x in enumerate(lines) if k >= len(bits) or bits[k]]


@F.pandas_udf(T.StringType())
def _apply(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else "\n".join(kept_lines(t.split("\n"), b)) for t, b in zip(text, bitmap, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, row (hash of the text), keep (bitmap), n_dropped: for documents that lose lines; all others keep every line."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _row_key(F.col("text")).alias("row"), "text")
    lines = shared.save(rows.mapInArrow(_hash_lines(min_chars), _LINES), "lines")
    ordered = shared.checkpointed(lines.repartitionByRange(shared.partitions(docs.sparkSession), *_order()).sortWithinPartitions(*_order()))
    edges = ordered.mapInArrow(_edges, "pid int, h1 long, h2 long, docs long, top long, low long").collect()  # two rows a partition at most
    drops = ordered.mapInArrow(_stream_drops(_resolve(edges), min_docs), "doc_id long, row long, pos int")
    return drops.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("p")).select("doc_id", "row", _bitmap("p").alias("keep"), F.size("p").cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with text replaced by the kept lines, and n_lines (before) and n_dropped, which replace columns of these names."""
    p = shared.fresh(docs.columns)
    bitmaps = keep_bitmaps(docs, min_chars, min_docs).toDF(f"{p}id", f"{p}row", f"{p}keep", f"{p}dropped")
    keyed = docs.withColumn(f"{p}key", _row_key(F.col("text")))
    joined = keyed.join(bitmaps, (F.col("doc_id") == F.col(f"{p}id")) & (F.col(f"{p}key") == F.col(f"{p}row")), "left")
    text, keep = F.coalesce("text", F.lit("")), F.col(f"{p}keep")
    out = joined.withColumn(f"{p}text", F.coalesce(_apply(F.when(keep.isNotNull(), F.col("text")), keep), text))
    return out.select(
        *[F.col(f"{p}text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")],
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(f"{p}dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: A-Z only; DuckDB's lower() would lower every letter.
_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
  FROM documents),
keyed AS (SELECT doc_id, pos, line, {_KEY} AS k FROM lines),
often AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, pos, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
