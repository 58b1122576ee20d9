"""Benchmark decontamination by spaced-seed hashing.

Words (runs of ASCII letters, digits and other characters that aren't ASCII punctuation or white space, lowered) are hashed under
fixed masks that ignore chosen positions of a window; every stretch that the rule below accepts has a window that meets its original under one of the masks (masks_for).
Window hashes of documents and benchmark items are joined; each hit is verified along its diagonal by the longest stretch that begins and ends
with an equal word and has at most one differing word for every four equal ones. A document is contaminated by an item if the equal words of that stretch
reach `least` or, for shorter items, all of the item's words.

The benchmark is taken in blocks of at most BLOCK_BYTES of text, one pass over the documents a block: within a block, the benchmark's side of the hash join is a table of bounded size
(40 bytes a word at most, made once and shipped as arrays) on every executor, and documents aren't shuffled. One block serves any common benchmark.

Defined cases: null or empty texts, on either side, match nothing; a null doc_id gives rows like any other; a null item_id is an item of its own;
repeated rows give repeated rows; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodetext.llm import shared

#: Fixed masks over windows of words: 1 is looked at, 0 is ignored.
MASKS = ("1111", "1110111", "111", "11", "1")
BLOCK_BYTES = 4 << 20
_FILTER_BITS = 20
_HITS = "doc_id long, item_id long, matched long, length long, doc_start long, doc_end long"


def _seeds(h: np.ndarray, mask: str, k: int) -> np.ndarray:
    """The hash of the window at each position, under one mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, 0x51ED270B7A1E0F3D + k, np.uint64)
    for p, bit in enumerate(mask):
        if bit == "1":
            total += h[p : p + n] * np.uint64(0x9E3779B97F4A7C15 + 2 * (p + 17) * 0x10001)
    return shared.mix(total)


def masks_for(words: int, least: int) -> tuple[str, ...]:
    """Masks of which one hits every stretch that counts for an item of so many words.

    d differing words part e equal ones, e >= 4 d, into d + 1 runs at most, and one run has e / (d + 1) words or more: four at least if e >= 12,
    but for four runs of three words with a differing word between each, which the spaced mask hits. An item of fewer than `least` words has to be there whole.
    """
    if words < least:
        return ("1" * min(words, 4),) if words else ()
    least = max(least, 1)
    run = min(-(-max(least, 4 * d) // (d + 1)) for d in range(6))
    return MASKS[:2] if least == 12 else ("1" * min(run, 4),)


class Benchmark:
    """Word and window hashes of one block of items, under the masks that each item needs."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: int = 12):
        self.ids = [i for i, _ in items]
        with np.errstate(over="ignore"):
            words, at = shared.word_hashes([(t or "").encode() for _, t in items], "plain")
            self.words, self.at = words, at
            item, pos, seed, mask = [], [], [], []
            for i in range(len(items)):
                w = words[at[i] : at[i + 1]]
                for m in masks_for(len(w), least):
                    k = MASKS.index(m)
                    s = _seeds(w, m, k)
                    seed.append(s)
                    item.append(np.full(len(s), i, np.int32))
                    pos.append(np.arange(len(s), dtype=np.int32))
                    mask.append(np.full(len(s), k, np.int8))
            cat = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
            seed, item, pos, mask = cat(seed, np.uint64), cat(item, np.int32), cat(pos, np.int32), cat(mask, np.int8)
        self.tables = {}
        for k in range(len(MASKS)):
            mine = np.flatnonzero(mask == k)
            mine = mine[np.argsort(seed[mine], kind="stable")]
            known = np.zeros(1 << _FILTER_BITS, bool)
            known[(seed[mine] >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            if len(mine):
                self.tables[k] = (known, seed[mine], item[mine], pos[mine])


def stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(equal words, begin, end) of the longest stretch with equal ends and at most a differing word for every four equal ones."""
    score = np.concatenate(([0], np.cumsum(np.where(equal, 1, -4))))
    # for each end the first begin with a score no higher; lows only fall
    lows = np.minimum.accumulate(score)
    begin = np.searchsorted(-lows, -score, side="left")
    k = int(np.argmax(np.arange(len(score)) - begin))
    at = np.flatnonzero(equal[begin[k] : k]) + begin[k]
    return (len(at), int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0, 0)


def _hits(bench: Benchmark, words: np.ndarray) -> set[tuple[int, int]]:
    """(item, diagonal) of all window hits in the words of one batch; a diagonal is the place of the item's first word."""
    out: set[tuple[int, int]] = set()
    for k, (known, seeds, items, pos) in bench.tables.items():
        s = _seeds(words, MASKS[k], k)
        at = np.flatnonzero(known[(s >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(seeds, s[at], "left"), np.searchsorted(seeds, s[at], "right")
        for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            out.update(zip(items[a:b].tolist(), (p - pos[a:b]).tolist(), strict=True))
    return out


def overlaps(bench: Benchmark, texts: list[bytes | None], least: int) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, equal words, the item's words, begin, end) by place of text and item; the best stretch for each pair."""
    words, at = shared.word_hashes(texts, "plain")
    best: dict = {}
    for item, diagonal in sorted(_hits(bench, words)):
        a, b = int(bench.at[item]), int(bench.at[item + 1])
        for d in range(int(np.searchsorted(at, max(diagonal, 0), "right")) - 1, len(texts)):  # a diagonal can leave a text
            if at[d] >= diagonal + b - a:
                break
            lo, hi = max(diagonal, int(at[d])), min(diagonal + b - a, int(at[d + 1]))
            if hi <= lo:
                continue
            n, x, y = stretch(words[lo:hi] == bench.words[a + lo - diagonal : a + hi - diagonal])
            if n and n >= min(least, b - a):
                best[d, item] = max(best.get((d, item), (0,)), (n, b - a, lo + x - int(at[d]), lo + y - int(at[d])))
    return [(d, i, *r) for (d, i), r in sorted(best.items())]


def _search(block, least: int):
    def run(batches):
        bench = block.value
        with np.errstate(over="ignore"):
            for ids, texts in shared.byte_batches(batches, ["doc_id", "text"]):
                rows = [(ids[d], bench.ids[i], *r) for d, i, *r in overlaps(bench, texts, least)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in _HITS.split(", ")])

    return run


def _without(block, least: int):
    def run(batches):
        bench = block.value
        with np.errstate(over="ignore"):
            for b in batches:
                keep, done = np.ones(b.num_rows, bool), 0
                for (texts,) in shared.byte_batches([b.select(["text"])], ["text"]):
                    for d, *_ in overlaps(bench, texts, least):
                        keep[done + d] = False
                    done += len(texts)
                yield b.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame, least: int):
    """The benchmark's items, as broadcasts of about BLOCK_BYTES of text with their tables."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield benchmark.sparkSession.sparkContext.broadcast(Benchmark([tuple(r) for r in part.toLocalIterator()], least))


def contaminations(docs: DataFrame, benchmark: DataFrame, least: int = 12) -> DataFrame:
    """A row for each document and benchmark item that overlap: item_id, equal words, the item's words, the stretch in the document's words."""
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [rows.mapInArrow(_search(block, least), _HITS) for block in _blocks(benchmark, least)]
    return functools.reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], _HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 12) -> DataFrame:
    """The rows of docs that overlap with no item; no row is moved."""
    for block in _blocks(benchmark, least):
        docs = docs.mapInArrow(_without(block, least), docs.schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
