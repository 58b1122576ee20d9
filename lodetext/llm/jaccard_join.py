"""Jaccard join of word shingle sets by token-combination prefixes, exact, with connected components of its links.

Method. Shingles get one global order: class of frequency first (from a fixed-size count sketch over all documents), hash second.
With tau = n - ceil(t * n), a document's prefix is extended until its rare shingles, plus for each group of frequent ones their
number less one, reach tau + 1. Two documents with similarity t or more then share a rare shingle or two frequent ones of
one group within their prefixes: rare shingles are indexed singly, frequent ones as pairs of one group (groups by hash, their
number by size zones that overlap by the size ratio 1/t). What shares an index entry is verified on the full sets.

Copies: documents with one set are one class (a 64-bit fingerprint of the set), and only classes are joined. Pairs: each entry links its
members to its first one, in one of ORDERS orders by hash (entries of very frequent shingles by way of salted smaller ones). Then pairs of one entry that still lie in different
components are taken as well. Parity bits, which each class keeps (two bits a shingle), bound the difference of two sets from below, so most pairs that aren't similar go before whole sets
are compared. So every link between different sets is either found or lies within one component.

Which entry makes an open pair: two similar sets have nothing in common before their first common shingle, so there the shingles from it on must be enough
for both, and the smaller set has it in the first ninth of its shingles (at 80 per cent). Only such members of an entry look for larger ones, and an entry leaves out pairs that have met
in an earlier one, as far as the first HEADS open entries of both tell. So a pair is made about once, however many entries it shares. The number of pairs is still that
of dissimilar sets with a common entry that neither bound tells apart, which grows faster than the table where groups of half-similar documents do.

Defined cases: a text without words, or null, has an empty set and is linked with nothing; a text with fewer words than a shingle has
its whole sequence as one; a null doc_id is linked with nothing and has a null component; rows with one doc_id are one node; other columns are
ignored; an empty table gives an empty result. Different sets or shingles are taken for one with probability 2**-64 a pair.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodetext.llm import shared

#: Cells of the count sketch, as a power of two, and into how many chunks it is dealt.
SKETCH_BITS, CHUNKS = 22, 64
#: log2 of the count from which a shingle's entries are salted.
SALT_FROM = 14
#: Size zones: (least size, sizes below, groups of frequent shingles; 0: all shingles are indexed singly).
ZONES = ((4, 80, 0), (64, 640, 8), (512, 5120, 32), (4096, 1 << 62, 256))
#: log2 of the excess count from which a shingle is frequent.
FREQUENT = 10
#: Orders by which entries choose their first member.
ORDERS = 32
#: The filter of candidate documents has this many bits for each, within these bounds (as powers of two).
FILTER_SHARE, FILTER_BITS = 16, (16, 30)
#: 64-bit words of the short parity bits that every class has.
SHORT = 8
#: Open entries with more members than this are dealt to several tasks.
OPEN_MEMBERS = 2048
#: So many of a class's first open entries tell whether two classes have met before; fewer only repeat pairs.
HEADS = 8
#: Places in a set's order, rounded down to one of these (exact below 25, then within 4 per cent); the code after the last stands for entries of frequent pairs.
PLACES = np.unique(np.floor(np.concatenate((np.arange(25), 25 * 1.04 ** np.arange(230)))).astype(np.int64))[:255]
#: Bytes of text whose words are hashed at once.
BATCH = 1 << 20

_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(texts: list[bytes | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, at = shared.word_hashes(texts, "blank")
    if len(h) >= width:
        s = h[: len(h) - width + 1] * _shift(0)
        for k in range(1, width):
            s = s + h[k : len(h) - width + 1 + k] * _shift(k)
        s = shared.mix(s)
    out = []
    for k in range(len(texts)):
        a, b = int(at[k]), int(at[k + 1])
        if b - a >= width:
            out.append(np.unique(s[a : b - width + 1]))
        elif b > a:
            few = np.uint64(b - a)
            for w in h[a:b]:
                few = shared.mix(np.array([few * _MULTIPLIERS[0] + w], np.uint64))[0]
            out.append(np.array([few], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _shift(k: int) -> np.uint64:
    return _MULTIPLIERS[k % 5] + np.uint64(k // 5)


def _fingerprint(s: np.ndarray) -> int:
    return int(shared.mix(np.array([np.add.reduce(shared.mix(s + np.uint64(1)))], np.uint64)).astype(np.int64)[0])


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


# Pass A: classes and the sketch --------------------------------------------

_WORDS = [f"p{k}" for k in range(SHORT)]
_KINDS = f"kind int, doc_id long, fp long, n int, {', '.join(f'{w} long' for w in _WORDS)}, parity binary, chunk int, counts binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), *((w, pa.int64()) for w in _WORDS), ("parity", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])


def _classes_and_counts(width: int):
    def run(batches):
        with np.errstate(over="ignore"):
            counts = np.zeros(1 << SKETCH_BITS, np.uint32)
            seen = _Seen()
            for ids, texts in shared.byte_batches(batches, ["doc_id", "text"], BATCH):
                sets = shingle_sets(texts, width)
                fps = [_fingerprint(s) for s in sets]
                fresh = [s for s, f in zip(sets, fps, strict=True) if seen.add(f)]
                if fresh:
                    cell, often = np.unique(_cells(np.concatenate(fresh)), return_counts=True)
                    counts[cell] += often.astype(np.uint32)
                n = len(ids)
                bits = [parity_bits(s) for s in sets]
                short = np.array([fold(x, SHORT) for x in bits], np.uint64).reshape(-1, SHORT).view(np.int64)
                parity = [x.tobytes() if len(x) > SHORT else None for x in bits]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), *(pa.array(short[:, k].copy()) for k in range(SHORT)), pa.array(parity, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_SCHEMA)
            if counts.any():
                n = CHUNKS
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.int64()) for _ in _WORDS), pa.nulls(n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array([_squeeze(c) for c in np.split(counts, n)], pa.binary())], schema=_SCHEMA)

    return run


class _Seen:
    """Fingerprints that a task has met lately; forgetting one costs only a repeated row."""

    def __init__(self, bits: int = 18):
        self.slots, self.mask = np.zeros(1 << bits, np.int64), (1 << bits) - 1

    def add(self, fp: int) -> bool:
        """Whether it is new."""
        at = fp & self.mask
        if self.slots[at] == fp:
            return False
        self.slots[at] = fp
        return True


def parity_bits(s: np.ndarray, words: int | None = None) -> np.ndarray:
    """For each cell, as bits of 64-bit integers, whether an odd number of shingles falls into it: 64 * SHORT cells or, for large sets, the power of two from twice their size.

    Two sets' bits differ in no more cells than they have shingles apart, also after both are folded.
    """
    words = words or max(SHORT, 1 << (max(1, 2 * len(s) - 1).bit_length() - 6 if len(s) > 32 else 0))
    cell = (shared.mix(s + np.uint64(11)) >> np.uint64(20)).astype(np.int64) % (64 * words)
    return np.packbits((np.bincount(cell, minlength=64 * words) & 1).astype(np.uint8)).view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The parity bits of the same set for fewer cells."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _squeeze(counts: np.ndarray) -> bytes:
    """Counts in the least of 1, 2 or 4 bytes that hold them, compressed."""
    most = int(counts.max())
    return zlib.compress(counts.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes(), 1)


def _add_counts(batches):
    """Sums the counts of each chunk; rows of a chunk follow one another."""
    at, total = None, None
    for b in batches:
        for chunk, counts in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
            if chunk != at and total is not None:
                yield _chunk(at, total)
            if chunk != at:
                at, total = chunk, np.zeros((1 << SKETCH_BITS) // CHUNKS, np.uint64)
            part = zlib.decompress(counts)
            total += np.frombuffer(part, f"<u{len(part) // len(total)}")
    if total is not None:
        yield _chunk(at, total)


def _chunk(at: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "counts"])


def frequency_levels(counts: np.ndarray) -> np.ndarray:
    """For each cell, 0 if its count is what chance gives, else log2 of the excess over the mean."""
    mean = counts.mean()
    excess = counts - mean
    level = np.zeros(len(counts), np.uint8)
    high = excess > max(16, 5 * np.sqrt(mean))
    level[high] = np.log2(excess[high]).astype(np.uint8)
    return level


# Pass B: index entries ------------------------------------------------------


def signatures(s: np.ndarray, level: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry hash, level, place in the set's order or -1 for a pair of frequent shingles) of the index entries of one set; level: of each shingle of s."""
    n = len(s)
    tau = n - -(-percent * n // 100)
    order = np.lexsort((s, level))
    s, level = s[order], level[order]
    out, levels, places = [], [], []
    for zone, (least, below, groups) in enumerate(ZONES):
        if not least <= n < below:
            continue
        if not groups:
            out.append(s[: tau + 1])
            levels.append(level[: tau + 1])
            places.append(np.arange(tau + 1))
            continue
        rare = int(np.searchsorted(level, FREQUENT))
        if rare > tau:
            out.append(s[: tau + 1])
            levels.append(level[: tau + 1])
            places.append(np.arange(tau + 1))
            continue
        group = (s[rare:] >> np.uint64(8)).astype(np.int64) % groups
        _, first = np.unique(group, return_index=True)
        adds = np.ones(len(group), np.int64)
        adds[first] = 0  # the first of a group adds nothing
        end = int(np.searchsorted(rare + np.cumsum(adds), tau + 1)) + 1
        out.append(s[:rare])
        levels.append(level[:rare])
        places.append(np.arange(rare))
        by = np.argsort(group[:end], kind="stable")
        members, of, lv = s[rare:][:end][by], group[:end][by], level[rare:][:end][by]
        begin = np.flatnonzero(np.diff(of, prepend=-1))
        for a, b in zip(begin, np.append(begin[1:], len(of)), strict=True):
            i, j = np.triu_indices(b - a, 1)
            x, y = members[a:b][i], members[a:b][j]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            out.append(shared.mix(lo * _MULTIPLIERS[1] + shared.mix(hi + np.uint64(zone))))
            levels.append(np.minimum(lv[a:b][i], lv[a:b][j]))
            places.append(np.full(len(i), -1))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.uint8), np.empty(0, np.int64)
    sig, first = np.unique(np.concatenate(out), return_index=True)
    return sig, np.concatenate(levels)[first], np.concatenate(places)[first]


def size_and_place(n: int, places: np.ndarray) -> np.ndarray:
    """n and a code of each place in one integer."""
    code = np.where(places < 0, len(PLACES), np.searchsorted(PLACES, places, "right") - 1)
    return (n << 8) + code


def _size(x: np.ndarray) -> np.ndarray:
    return (x >> 8).astype(np.int32)


def _place(x: np.ndarray) -> np.ndarray:
    """The rounded place, -1 for pairs of frequent shingles."""
    return np.append(PLACES, -1)[x & 255].astype(np.int32)


def _index(width: int, percent: int, levels):
    def run(batches):
        table = np.frombuffer(levels.value, np.uint8)
        seen = _Seen()
        with np.errstate(over="ignore"):
            for _, texts in shared.byte_batches(batches, ["doc_id", "text"], BATCH):
                sig, fps, sizes, salts = [], [], [], []
                for s in shingle_sets(texts, width):
                    fp = _fingerprint(s)
                    if len(s) < 4 or not seen.add(fp):  # smaller sets are similar to equal ones only
                        continue
                    t, lv, places = signatures(s, table[_cells(s)], percent)
                    sig.append(t)
                    fps.append(fp)
                    sizes.append(size_and_place(len(s), places))
                    salts.append(np.where(lv >= SALT_FROM, 1 + (fp & 0x7FFFFFFF) % (1 << np.maximum(lv.astype(np.int64) - SALT_FROM + 1, 0)), 0))
                if sig:
                    times = [len(t) for t in sig]
                    sigs = np.concatenate(sig)
                    place = shared.mix(np.repeat(np.array(fps, np.int64), times).view(np.uint64) ^ _order_key(sigs))
                    yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(np.concatenate(salts).astype(np.int32)), pa.array(place.view(np.int64)), pa.array(np.concatenate(sizes))], names=["sig", "salt", "place", "size"])

    return run


def _order_key(sigs: np.ndarray) -> np.ndarray:
    """What fingerprints are mixed with, so that the entry's members are sorted in its own order."""
    return sigs % np.uint64(ORDERS) * _MULTIPLIERS[3]


_MEMBERS = "sig long, salt int, fp long, n int, at int, cfp long, cn int"


def _stars(batches):
    """Entries with two classes or more: each member beside the first; one row of a salted part goes on as well."""
    cols = ("sig", "salt", "place", "size")
    held = None

    def emit(c, over):
        nonlocal held
        sig, salt, fp, size = c
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])
        begin = np.flatnonzero(new)
        distinct = new.copy()
        distinct[1:] |= fp[1:] != fp[:-1]
        sizes = np.add.reduceat(distinct.astype(np.int64), begin)
        run = np.cumsum(new) - 1
        if not over:  # of the last run only its first row is needed again
            tail = begin[-1]
            many = sizes[-1] > 1
            held = [x[[tail, -1]] if many else x[[tail]] for x in c]
        keep = distinct & ((sizes[run] > 1) | (salt > 0))
        first = begin[run]
        fp = (shared.unmix(fp.view(np.uint64)) ^ _order_key(sig.view(np.uint64))).view(np.int64)
        n = _size(size)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (sig, salt, fp, n, _place(size), fp[first], n[first])], names=["sig", "salt", "fp", "n", "at", "cfp", "cn"])

    for b in batches:
        if b.num_rows:
            c = [b.column(x).to_numpy(zero_copy_only=False) for x in cols]
            if held is not None:
                c = [np.concatenate(x) for x in zip(held, c, strict=True)]
            with np.errstate(over="ignore"):
                yield emit(c, False)


# Verification ---------------------------------------------------------------

#: Shingle hashes are compared by so many of their upper bytes.
_KEPT = 6


def _set_bits(bits: int):
    """The bits of each chunk of the filter; rows of a chunk follow one another."""
    size = (1 << bits) // CHUNKS

    def run(batches):
        at, total = None, None
        for b in batches:
            cells = b.column("cell").to_numpy(zero_copy_only=False)
            for chunk in dict.fromkeys((cells // size).tolist()):
                if chunk != at and total is not None:
                    yield _chunk(at, np.packbits(total))
                if chunk != at:
                    at, total = chunk, np.zeros(size, bool)
                total[cells[cells // size == chunk] % size] = True
        if total is not None:
            yield _chunk(at, np.packbits(total))

    return run


def _wanted(width: int, bits):
    """fp, n and whole sets of the documents that the filter lets through."""

    def run(batches):
        wanted = np.frombuffer(bits.value, np.uint8)
        with np.errstate(over="ignore"):
            for b in batches:
                cell = b.column("cell").to_numpy(zero_copy_only=False)
                hit = (wanted[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1
                b = b.filter(pa.array(hit.astype(bool)))
                for (texts,) in shared.byte_batches([b], ["text"], BATCH):
                    sets = shingle_sets(texts, width)
                    whole = [shared.pack_sorted(s >> np.uint64(64 - 8 * _KEPT), _KEPT) for s in sets]
                    yield pa.RecordBatch.from_arrays([pa.array([_fingerprint(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(whole, pa.binary())], names=["fp", "n", "payload"])

    return run


@F.pandas_udf(T.LongType())
def _apart(a: pd.Series, b: pd.Series) -> pd.Series:
    def count(x: bytes | None, y: bytes | None) -> int:
        if x is None or y is None:
            return 0
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        least = min(len(p), len(q))
        return int(np.bitwise_count(fold(p, least) ^ fold(q, least)).sum())

    return pd.Series([count(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    def count(x: bytes, y: bytes) -> int:
        both = np.concatenate((shared.unpack_sorted(x, _KEPT), shared.unpack_sorted(y, _KEPT)))
        both.sort(kind="stable")
        return int(np.count_nonzero(both[1:] == both[:-1]))

    return pd.Series([count(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def _collect_chunks(df: DataFrame, dtype, size: int) -> np.ndarray:
    """A fixed number of chunks of fixed size."""
    out = np.zeros(size, dtype)
    for r in df.collect():
        part = np.frombuffer(r.counts, dtype)
        out[r.chunk * len(part) : (r.chunk + 1) * len(part)] = part
    return out


def _words_apart(p: str, q: str) -> F.Column:
    """In how many cells the short parity bits with these prefixes differ."""
    return functools.reduce(lambda u, v: u + v, [F.bit_count(F.col(f"{p}{k}").bitwiseXOR(F.col(f"{q}{k}"))) for k in range(SHORT)])


class _Verifier:
    def __init__(self, docs: DataFrame, reps: DataFrame, width: int, percent: int):
        self.docs, self.reps, self.width, self.percent = docs, reps, width, percent

    def may_be_similar(self, apart: F.Column, total: F.Column) -> F.Column:
        return apart * (100 + self.percent) <= total * (100 - self.percent)

    def close(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that their parity bits leave, with documents that have these sets."""
        side = lambda end, p, wide: self.reps.select(F.col("fp").alias(end), F.col("doc").alias(f"d{end}"), F.col("n").alias(f"n{end}"), *[F.col(w).alias(f"{p}{k}") for k, w in enumerate(_WORDS)], F.col("parity").alias(wide))
        total = F.col("na") + F.col("nb")
        both = pairs.join(side("a", "p", "pa"), "a").join(side("b", "q", "pb"), "b").where(self.may_be_similar(_words_apart("p", "q"), total))
        return shared.save(both.where(self.may_be_similar(_apart("pa", "pb"), total)).select("a", "b", "da", "db"), f"{name}-close")

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) of close() whose sets are similar, compared whole."""
        spark = pairs.sparkSession
        bits = min(max((FILTER_SHARE * 2 * pairs.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
        cell = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits).alias("cell")
        cells = pairs.select(cell("da")).unionByName(pairs.select(cell("db"))).distinct().repartition(shared.partitions(spark), F.shiftright("cell", bits - 6)).sortWithinPartitions("cell")
        filtered = spark.sparkContext.broadcast(_collect_chunks(cells.mapInArrow(_set_bits(bits), "chunk int, counts binary"), np.uint8, 1 << (bits - 3)).tobytes())
        sets = shared.save(self.docs.select(cell("doc_id"), "text").mapInArrow(_wanted(self.width, filtered), "fp long, n long, payload binary"), f"{name}-sets")
        side = lambda end: sets.select(F.col("fp").alias(end), F.col("n").alias(f"n{end}"), F.col("payload").alias(f"p{end}"))
        total = F.col("na") + F.col("nb")
        whole = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", total.alias("total"), _common("pa", "pb").alias("common"))
        out = shared.save(whole.where(F.lit(100) * F.col("common") >= F.lit(self.percent) * (F.col("total") - F.col("common"))).select("a", "b").distinct(), f"{name}-links")
        shared.discard(sets)
        filtered.unpersist()
        return out


# Components -----------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the nodes that links (a, b) hold, by alternating large and small stars."""
    edges = shared.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # large star: every neighbour larger than a node gets the smallest of the neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: smaller neighbours and the node itself get the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, edges = edges, shared.save(small, "edges")
        shared.discard(last)
        # done once every node has one smaller neighbour or is the smaller one of its neighbours
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("over"), F.lit(0).alias("under")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("over"), F.lit(1).alias("under")))
        if ends.groupBy("node").agg(F.sum("over").alias("over"), F.max("under").alias("under")).where("over + under > 1").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


# The join -------------------------------------------------------------------


def _meetings(members: DataFrame, labels: DataFrame, verify: _Verifier) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of one entry that lie in different components and may be similar by their places and short parity bits, few of them repeated; the saved table that they are made of."""
    label = members.select("sig", "fp", "n", "at").join(labels, F.col("fp") == F.col("node"), "left").select("sig", "fp", "n", "at", F.coalesce("component", "fp").alias("label"))
    # whether the shingles from here on are enough for a larger set
    seeks = verify.may_be_similar(F.col("at").cast("long"), F.col("n"))
    # an entry of two members has been compared whole
    mixed = label.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"), F.max(seeks).alias("sought")).where("lo <> hi and size > 2 and sought")
    mixed = mixed.select("sig", F.ceil(F.col("size") / OPEN_MEMBERS).cast("int").alias("deals"))
    rows = shared.save(label.join(mixed, "sig"), "open-entries")
    # entries of single shingles by place, then those of pairs by hash
    order = F.row_number().over(Window.partitionBy("fp", "pair").orderBy("at", "sig"))
    heads = rows.select("fp", "at", "sig", F.expr("at < 0").alias("pair")).withColumn("k", order).where(F.col("k") <= HEADS).groupBy("fp").agg(F.collect_list(F.struct("at", "sig")).alias("heads"))
    single = lambda h: (h["at"] >= 0) & ((F.col("at") < 0) | (h["at"] < F.col("at")))
    pair = lambda h: (h["at"] < 0) & (F.col("at") < 0) & (h["sig"] < F.col("sig"))
    before = F.transform(F.filter("heads", lambda h: single(h) | pair(h)), lambda h: h["sig"])
    found = rows.join(verify.reps.select("fp", *_WORDS), "fp").join(heads, "fp").select("sig", "fp", "n", "at", "label", "deals", before.alias("before"), *_WORDS)
    found = shared.save(found, "open")
    shared.discard(rows)
    x = found.where(seeks).select("sig", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.col("fp").alias("a"), "n", "at", F.col("label").alias("la"), "before", *_WORDS)
    y = found.select("sig", F.pmod(F.hash("fp"), F.col("deals")).alias("deal"), F.col("fp").alias("b"), F.col("n").alias("cn"), F.col("at").alias("cat"), F.col("label").alias("lb"), F.col("before").alias("cbefore"), *[F.col(w).alias(f"q{k}") for k, w in enumerate(_WORDS)])
    fits = F.lit(100) * F.col("n").cast("long") >= F.lit(verify.percent) * F.col("cn").cast("long")
    total = F.col("n").cast("long") + F.col("cn")
    rest = F.least(F.col("n") - F.col("at"), F.col("cn") - F.col("cat")).cast("long")
    enough = (F.col("at") < 0) | (rest * (100 + verify.percent) >= total * verify.percent)
    near = verify.may_be_similar(_words_apart("p", "q"), total)
    meet = x.join(y, ["sig", "deal"]).where("(n < cn or (n = cn and a < b)) and la <> lb").where(fits).where(enough).where(near).where(~F.arrays_overlap("before", "cbefore"))
    return meet.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), found


def _open_pairs(members: DataFrame, labels: DataFrame, pairs: DataFrame, verify: _Verifier) -> DataFrame:
    """Pairs of one entry that lie in different components, weren't compared yet and may be similar."""
    meet, found = _meetings(members, labels, verify)
    out = shared.save(meet.distinct().join(pairs, ["a", "b"], "left_anti"), "pairs-open")
    shared.discard(found)
    return out


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id."""
    if percent < 80:
        raise ValueError("the size zones hold for 80 per cent or more")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = shared.save(rows.mapInArrow(_classes_and_counts(width), _KINDS), "classes")
    classes = first.where("kind = 0").select("doc_id", "fp", "n")
    counts = first.where("kind = 1").select("chunk", "counts").repartition(shared.partitions(spark), "chunk").sortWithinPartitions("chunk").mapInArrow(_add_counts, "chunk int, counts binary")
    levels = spark.sparkContext.broadcast(frequency_levels(_collect_chunks(counts, np.uint64, 1 << SKETCH_BITS)).tobytes())
    known = first.where("kind = 0 and doc_id is not null and n > 0")
    reps = shared.save(known.groupBy("fp").agg(F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in ("n", *_WORDS, "parity")]), "sets")

    present = rows.where("doc_id is not null and text is not null")
    entries = present.mapInArrow(_index(width, percent, levels), "sig long, salt int, place long, size long")
    order = ["sig", "salt", "place"]
    members = shared.save(entries.repartition(shared.partitions(spark), "sig", "salt").sortWithinPartitions(*order).mapInArrow(_stars, _MEMBERS), "members")

    fits = F.lit(100) * F.least("n", "cn") >= F.lit(percent) * F.greatest("n", "cn")
    near = members.where(F.col("fp") != F.col("cfp")).where(fits).select(F.least("fp", "cfp").alias("a"), F.greatest("fp", "cfp").alias("b"))
    salted = members.where("salt > 0").select("sig", F.col("cfp").alias("fp"), F.col("cn").alias("n")).distinct()
    heads = salted.groupBy("sig").agg(F.min(F.struct("fp", "n")).alias("c")).select("sig", F.col("c.fp").alias("cfp"), F.col("c.n").alias("cn"))
    far = salted.join(heads, "sig").where(F.col("fp") != F.col("cfp")).where(fits).select(F.least("fp", "cfp").alias("a"), F.greatest("fp", "cfp").alias("b"))
    pairs = shared.save(near.unionByName(far).distinct(), "pairs")

    verify = _Verifier(present, reps, width, percent)
    # rows with one doc_id and different sets tie their classes together as links do
    twice = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("doc_id", "a")
    same_id = known.select("doc_id", "fp").join(twice, "doc_id").where("fp <> a").select("a", F.col("fp").alias("b"))
    labels = components(verify.links(verify.close(pairs, "first"), "first").unionByName(same_id))
    more = _open_pairs(members, labels, pairs, verify)
    if not more.isEmpty():
        found = verify.links(verify.close(more, "second"), "second")
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))

    # of each component the least doc_id, then of each class
    least = labels.join(reps.select(F.col("fp").alias("node"), "doc"), "node").groupBy("component").agg(F.min("doc").alias("least"))
    linked = labels.join(least, "component").select(F.col("node").alias("fp"), "least")
    by_class = reps.select("fp", "doc").join(linked, "fp", "left").select(F.col("fp").alias("_fp"), F.coalesce("least", "doc").alias("component_id"))
    by_class = shared.save(by_class, "by-class")  # so that the join below has nothing but exchanges beneath it and large groups of copies can be split
    found = classes.join(by_class, (F.col("fp") == F.col("_fp")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(shared.table(spark, sf_dir, "documents"))
