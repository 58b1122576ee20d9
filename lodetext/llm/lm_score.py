"""Language-model scores of whole texts by context-tree weighting over bytes, beside a smoothed unigram base.

Model. A byte is eight binary decisions, each in the node of the bits before it. For every context of 0 to `depth` bytes, Krichevsky-Trofimov
estimates of each decision are mixed over all depths with the weights of context-tree weighting, P_w = 1/2 P_e + 1/2 prod P_w(children), from the counts of all
training texts. A text is scored by the trained tree as it stands: each decision has the mixture of the estimates along its context, where the deepest context seen in
training takes the weight that is left. A text's bytes (A-Z lowered) are followed by an end byte, so scores are log10 probabilities of whole texts, and -score / log10(2) / bytes is
the code length in bits per byte. Counts of byte strings are summed over all training texts, and every context seen there has its nodes, at every depth and whatever the corpus's size.

The tree is never in one place. Documents are first saved in blocks of at most BLOCK_BYTES of text, with each block's distinct strings and words and their counts in training texts, dealt
into parts: words by hash, strings by the context's last SPLIT bytes, so that a part has whole branches of the tree. Each part's counts give the probabilities of its branches, the nodes above
them (2**16 contexts of SPLIT bytes at most) are mixed in the driver, and each block gets the probabilities of its own strings back.

Base. The counts of words are summed in the same way, and each block gets the totals of its own words back. No vocabulary is broadcast or collected. A string or word is one entry of a block,
however frequent it is, so no part is hot.

Defined cases: a null text is empty (one token, the end); a null doc_id is held out; repeated rows each count; other columns are ignored; an
empty table gives an empty result, and without training texts every token has probability 1 in the base and every decision 1/2 in the model. Words are told apart by a 64-bit hash. A NUL within a
text counts as the end byte in the model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodetext.llm import shared

DEPTH = 5
#: Branches of the tree are told apart by so many bytes of context; nodes above them are in one place.
SPLIT = 2
#: Bytes of text in a block (one longer text is a block of its own), and bytes that are looked at together.
BLOCK_BYTES, SLICE = 16 << 20, 1 << 20
_DOC, _STRINGS, _WORDS = 0, 1, 2
_END = np.uint64(0x6A09E667F3BCC909)  # stands for the hash of the end token
_EMPTY = np.uint64(2**64 - 1)
_SAVED = "kind int, block long, doc_id long, held_out boolean, text string, part int, keys binary, n binary"
_TOTALS = "kind int, part int, keys binary, n binary, total long, known long, nodes binary, zeros binary, ones binary, log_w binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# Byte strings ---------------------------------------------------------------


def _slices(text: bytes, depth: int) -> list[tuple[bytes, bytes]]:
    """(bytes before, bytes) that make up a text and its end, SLICE bytes at most in each."""
    text = b"\0" * depth + text + b"\0"
    return [(text[k : k + depth], text[k + depth : k + depth + SLICE]) for k in range(0, len(text) - depth, SLICE)]


def _slice_strings(slices: list[tuple[bytes, bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The depth + 1 bytes that end at each byte of each slice, as integers; and where slices begin."""
    a = np.frombuffer(b"".join(x for s in slices for x in s), np.uint8)
    key = np.zeros(len(a) - depth, np.uint64)
    for k in range(depth + 1):
        key <<= np.uint64(8)
        key |= a[k : len(a) - depth + k]
    lengths = np.array([len(t) for _, t in slices], np.int64)
    begin = np.concatenate(([0], np.cumsum(lengths)))
    skip = np.repeat(np.arange(len(slices)) * depth, lengths)
    return key[np.arange(begin[-1]) + skip], begin


def _strings(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The depth + 1 bytes that end at each byte of each text and at its end, as integers; and where texts begin."""
    return _slice_strings([(b"\0" * depth, t + b"\0") for t in texts], depth)


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    begin = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return x[begin], np.diff(np.append(begin, len(x)))


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    begin = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[begin], np.add.reduceat(c, begin)


def _merge_some(keys: list, counts: list) -> tuple[list, list]:
    """The lists, merged into one array each once they are long."""
    if len(keys) < 2 or sum(map(len, keys)) < 1_000_000:
        return keys, counts
    k, c = _merge(keys, counts)
    return [k], [c]


def _turn(keys: np.ndarray, depth: int) -> np.ndarray:
    """Strings with the bytes of the context in reverse, so that sorted ones of one node are neighbours. Turned twice they are as before."""
    out = keys & np.uint64(255)
    for k in range(depth):
        out |= (keys >> np.uint64(8 * (k + 1)) & np.uint64(255)) << np.uint64(8 * (depth - k))
    return out


# Blocks ---------------------------------------------------------------------


def _by_bytes(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with `most` bytes together; a longer one stands alone."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > most:
            yield start, k
            start, size = k, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def _words(text: bytes) -> Iterator[bytes]:
    """A text, cut at blanks into parts of about SLICE bytes; a longer word stays whole."""
    start = 0
    while len(text) - start > SLICE:
        end = max(text.rfind(c, start, start + SLICE) for c in (b" ", b"\n", b"\t"))
        if end <= start:
            break
        yield text[start:end]
        start = end
    yield text[start:] if start else text


class _Block:
    """Distinct strings and words of a block's texts, with their counts in training texts."""

    def __init__(self, number: int, depth: int, parts: int):
        self.number, self.depth, self.parts, self.size, self.rows = number, depth, parts, 0, 0
        self.found: dict[int, tuple[list, list]] = {_STRINGS: ([], []), _WORDS: ([], [])}

    def _add(self, kind: int, x: np.ndarray, seen: int) -> None:
        if len(x):
            keys, counts = _counted(x)
            mine = self.found[kind]
            mine[0].append(keys)
            mine[1].append(counts * seen)
            self.found[kind] = _merge_some(*mine)

    def add(self, texts: list[bytes], held: list[bool]) -> None:
        for seen in (0, 1):
            mine = [t for t, h in zip(texts, held, strict=True) if h != seen]
            for a, b in _by_bytes(mine, SLICE):
                slices = [x for t in mine[a:b] for x in _slices(t, self.depth)]
                for i, j in _by_bytes([x for _, x in slices], SLICE):
                    self._add(_STRINGS, _slice_strings(slices[i:j], self.depth)[0], seen)
                for part in _words(mine[a]) if b == a + 1 else [b"\n".join(mine[a:b])]:
                    self._add(_WORDS, shared.word_hashes([part], "blank")[0], seen)
            self._add(_WORDS, np.full(len(mine), _END), seen)
        self.size += sum(map(len, texts))
        self.rows += len(texts)

    def found_rows(self) -> Iterator[pa.RecordBatch]:
        for kind, (keys, counts) in self.found.items():
            if not keys:
                continue
            k, c = _merge(keys, counts)
            if kind == _STRINGS:
                k = _turn(k, self.depth)
                hashed = shared.mix(k >> np.uint64(8 * (self.depth + 1 - min(SPLIT, self.depth))))
            else:
                hashed = k
            part = (hashed % np.uint64(self.parts)).astype(np.int32)
            order = np.lexsort((k, part))
            k, c, part = k[order], c[order], part[order]
            begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            cut = [*begin.tolist(), len(k)]
            data = [[shared.pack_sorted(k[i:j], _width(kind, self.depth)) for i, j in zip(cut, cut[1:])], [shared.pack(c[i:j], 8) for i, j in zip(cut, cut[1:])]]
            n = len(begin)
            yield pa.RecordBatch.from_arrays([_kinds(kind, n), pa.array(np.full(n, self.number, np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string()), pa.array(part[begin]), *(pa.array(x, pa.binary()) for x in data)], names=_names(_SAVED))


def _width(kind: int, depth: int) -> int:
    return depth + 1 if kind == _STRINGS else 8


def _kinds(kind: int, n: int) -> pa.Array:
    return pa.array(np.full(n, kind, np.int32))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _in_blocks(depth: int, parts: int):
    """The rows with the number of their block, and the block's strings and words by part."""

    def run(batches):
        from pyspark import TaskContext

        shared.drop_caches()
        number = TaskContext.get().partitionId() << 33
        block = _Block(number, depth, parts)
        with np.errstate(over="ignore"):
            for b in batches:
                texts = [(t or b"").lower() for t in b.column("text").cast(pa.binary()).to_pylist()]
                held, start = b.column("held_out").to_pylist(), 0
                while start < len(texts):
                    end, size = start, block.size
                    while end < len(texts) and (size + len(texts[end]) <= BLOCK_BYTES or (end == start and not block.rows)):
                        size += len(texts[end])
                        end += 1
                    if end > start:
                        block.add(texts[start:end], held[start:end])
                        rows, n = b.slice(start, end - start), end - start
                        yield pa.RecordBatch.from_arrays([_kinds(_DOC, n), pa.array(np.full(n, block.number, np.int64)), rows.column("doc_id"), rows.column("held_out"), rows.column("text").cast(pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=_names(_SAVED))
                    if end < len(texts):
                        yield from block.found_rows()
                        number += 1
                        block = _Block(number, depth, parts)
                    start = end
            yield from block.found_rows()

    return run


# Context tree ---------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] -= np.log(y[low])
        y[low] += 1
    r = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y


#: Of k + 1/2 and of k + 1, for most counts.
_HALVES, _WHOLES = log_gamma(np.arange(1024) + 0.5), log_gamma(np.arange(1024) + 1.0)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of any order of so many zeros and ones."""
    total = zeros + ones
    out = _HALVES[np.minimum(zeros, 1023).astype(np.int64)] + _HALVES[np.minimum(ones, 1023).astype(np.int64)] - _WHOLES[np.minimum(total, 1023).astype(np.int64)] - math.log(math.pi)
    many = np.flatnonzero(total > 1023)
    out[many] = log_gamma(zeros[many] + 0.5) + log_gamma(ones[many] + 0.5) - log_gamma(total[many] + 1.0) - math.log(math.pi)
    return out


def _decisions(turned: np.ndarray, counts: np.ndarray, depth: int):
    """For each of the eight decisions: an order of the strings, their nodes (bits before, context) in it, bits, and how often each had a zero and a one."""
    sym, ctx, n = turned & np.uint64(255), turned >> np.uint64(8), counts.astype(np.float64)
    for b in range(8):
        nodes = (np.uint64(1 << b) | sym >> np.uint64(8 - b)) << np.uint64(8 * depth) | ctx
        order = np.argsort(nodes, kind="stable")
        bit = (sym[order] >> np.uint64(7 - b) & np.uint64(1)).astype(np.float64)
        yield order, nodes[order], bit, n[order] * (1 - bit), n[order] * bit


def _climb(nodes, zeros, ones, depth: int, split: int, log_w=None) -> list[tuple]:
    """From sorted nodes of `depth` up to `split`: for each depth, from `split` down, where each node begins among those below, nodes, zeros, ones, logs of both probabilities.

    Nodes that training didn't see count for nothing. log_w: of the nodes themselves, if they aren't leaves.
    """
    levels = []
    for d in range(depth, split - 1, -1):
        nodes = nodes if d == depth else nodes >> np.uint64(8)
        begin = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1])))
        nodes, zeros, ones = nodes[begin], np.add.reduceat(zeros, begin), np.add.reduceat(ones, begin)
        log_e = log_kt(zeros, ones)
        if d < depth:
            log_w = np.logaddexp(log_e, np.add.reduceat(log_w, begin)) - math.log(2)
        elif log_w is None:
            log_w = log_e
        levels.append((begin, nodes, zeros, ones, log_e, log_w))
    return levels[::-1]


def _descend(levels: list[tuple], below: int, mixed, left, one, leaves: bool):
    """What is mixed so far, the weight that is left, and the probability of a one where the context is seen no deeper, for the `below` entries under the last level; given those above the first."""
    for k, (begin, _, zeros, ones, log_e, log_w) in enumerate(levels):
        kt = (ones + 0.5) / (zeros + ones + 1)
        one = np.where(zeros + ones > 0, mixed + left * kt, one)
        stop = 1.0 if leaves and k == len(levels) - 1 else np.exp(np.minimum(0, log_e - math.log(2) - log_w))
        mixed, left = mixed + left * stop * kt, left * (1 - stop)
        times = np.diff(np.append(begin, below if k == len(levels) - 1 else len(levels[k + 1][1])))
        mixed, left, one = (np.repeat(x, times) for x in (mixed, left, one))
    return mixed, left, one


def _branches(turned: np.ndarray, counts: np.ndarray, depth: int, split: int) -> list[np.ndarray]:
    """Nodes of depth `split` over whole branches of the tree, their zeros, ones and log probabilities."""
    found = []
    for _, nodes, _, zeros, ones in _decisions(turned, counts, depth):
        _, top, z, o, _, w = _climb(nodes, zeros, ones, depth, split)[0]
        found.append((top, z, o, w))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _top(nodes, zeros, ones, log_w, split: int) -> tuple[np.ndarray, ...]:
    """The sorted nodes of depth `split`, and what reaches each from above."""
    order = np.argsort(nodes)
    nodes, zeros, ones, log_w = (x[order] for x in (nodes, zeros, ones, log_w))
    levels = _climb(nodes, zeros, ones, split, 0, log_w)
    n = len(levels[0][1])
    return nodes, *_descend(levels[:-1], len(nodes), np.zeros(n), np.ones(n), np.full(n, 0.5), False)


def _log_probabilities(turned: np.ndarray, counts: np.ndarray, depth: int, split: int, top: tuple) -> np.ndarray:
    """log10 of the probability of each sorted string's last byte after the others, for whole branches of the tree."""
    out = np.zeros(len(turned))
    for order, nodes, bit, zeros, ones in _decisions(turned, counts, depth):
        levels = _climb(nodes, zeros, ones, depth, split)
        at = np.searchsorted(top[0], levels[0][1])
        one = _descend(levels, len(nodes), *(x[at] for x in top[1:]), True)[2]
        out[order] += np.log10(np.where(bit == 1, one, 1 - one))
    return out


@dataclass
class Tree:
    """A whole tree in one place: sorted strings of depth + 1 bytes, and their counts in training."""

    keys: np.ndarray
    counts: np.ndarray
    depth: int

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each string's last byte after the others."""
        k, c = _merge([self.keys, keys], [self.counts, np.zeros(len(keys), np.int64)])
        turned, split = _turn(k, self.depth), min(SPLIT, self.depth)
        logs = _log_probabilities(turned, c, self.depth, split, _top(*_branches(turned, c, self.depth, split), split))
        return logs[np.searchsorted(k, keys)]


def build(keys: np.ndarray, counts: np.ndarray, depth: int) -> Tree:
    return Tree(keys, counts, depth)


def _part_totals(depth: int, split: int):
    """A row for each kind and part: distinct keys, their counts, the counts' sum and how many aren't zero; for strings the part's nodes of depth `split`."""

    def run(batches):
        parts: dict = {}
        with np.errstate(over="ignore"):
            for b in batches:
                for kind, part, k, n in zip(*(b.column(c).to_pylist() for c in ("kind", "part", "keys", "n")), strict=True):
                    keys, counts = parts.get((kind, part), ([], []))
                    parts[kind, part] = _merge_some([*keys, shared.unpack_sorted(k, _width(kind, depth))], [*counts, shared.unpack(n, 8, np.int64)])
            for kind, part in list(parts):
                k, c = _merge(*parts.pop((kind, part)))
                found = [x.tobytes() for x in _branches(k, c, depth, split)] if kind == _STRINGS else [None] * 4
                data = [shared.pack_sorted(k, _width(kind, depth)), shared.pack(c, 8)]
                sums = [int(c.sum()), int(np.count_nonzero(c))]
                yield pa.RecordBatch.from_arrays([_kinds(kind, 1), pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in data), *(pa.array([x], pa.int64()) for x in sums), *(pa.array([x], pa.binary()) for x in found)], names=_names(_TOTALS))

    return run


def _replies(depth: int, split: int, top):
    """For each block's keys their counts (words) or log probabilities (strings), from rows sorted by kind, part and block; block -1 has a part's totals, and comes first."""

    def run(batches):
        known = values = None
        with np.errstate(over="ignore"):
            for b in batches:
                for kind, block, k, n in zip(*(b.column(c).to_pylist() for c in ("kind", "block", "keys", "n")), strict=True):
                    data, k = k, shared.unpack_sorted(k, _width(kind, depth))
                    if block == -1:
                        c = shared.unpack(n, 8, np.int64)
                        known, values = k, c if kind == _WORDS else _log_probabilities(k, c, depth, split, top.value).astype(np.float32)
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array([block]), _kinds(kind, 1), pa.array([data], pa.binary()), pa.array([shared.pack(values[np.searchsorted(known, k)], 8)], pa.binary())], names=["block", "kind", "keys", "values"])

    return run


class Table:
    """An open-addressed table of a block's strings and their log probabilities."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        size = 1 << max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.keys, self.logs = np.full(size, _EMPTY), np.zeros(size, np.float32)
        slot, todo = shared.mix(keys) & np.uint64(size - 1), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == _EMPTY
            self.keys[slot[todo[free]]] = keys[todo[free]]
            mine = self.keys[slot[todo]] == keys[todo]
            self.logs[slot[todo[mine]]] = logs[todo[mine]]
            todo = todo[~mine]
            slot[todo] = (slot[todo] + np.uint64(1)) & np.uint64(size - 1)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """For strings that are in the table."""
        mask = np.uint64(len(self.keys) - 1)
        slot = shared.mix(keys) & mask
        found, out = self.keys[slot], self.logs[slot]
        rest = np.flatnonzero(found != keys)
        while len(rest):
            slot[rest] = (slot[rest] + np.uint64(1)) & mask
            out[rest] = self.logs[slot[rest]]
            rest = rest[self.keys[slot[rest]] != keys[rest]]
        return out


# Scores ---------------------------------------------------------------------


def _read(rows: pa.Table, kind: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys and values of one kind that a block got back."""
    mine = rows.filter(pc.equal(rows.column("kind"), kind))
    keys = [shared.unpack_sorted(x, _width(kind, depth)) for x in mine.column("keys").to_pylist()]
    t = np.float32 if kind == _STRINGS else np.int64
    values = [shared.unpack(x, t().itemsize, t) for x in mine.column("values").to_pylist()]
    return np.concatenate([np.empty(0, np.uint64), *keys]), np.concatenate([np.empty(0, t), *values])


def _score_block(depth: int, n_train: int, n_distinct: int):
    floor = math.log10(n_train + 0.1 * (n_distinct + 1))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            keys, logs = _read(right, _STRINGS, depth)
            strings = Table(_turn(keys, depth), logs)
            h, c = _read(right, _WORDS, depth)
            order = np.argsort(h)
            h, c = h[order], c[order]
            texts = [(t or b"").lower() for t in left.column("text").cast(pa.binary()).to_pylist()]
            n = len(texts)
            n_tokens, n_known, base, score = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)

            def add_words(hashes, of):
                found = c[np.searchsorted(h, hashes)]
                np.add.at(n_known, of, found > 0)
                np.add.at(base, of, np.log10(found + 0.1) - floor)

            for a, b in _by_bytes(texts, SLICE):
                for part in _words(texts[a]) if b == a + 1 else [None]:
                    hashes, at = shared.word_hashes(texts[a:b] if part is None else [part], "blank")
                    n_tokens[a:b] += np.diff(at)
                    add_words(hashes, np.repeat(np.arange(a, b), np.diff(at)))
                slices = [(k, x) for k in range(a, b) for x in _slices(texts[k], depth)]
                for i, j in _by_bytes([x for _, (_, x) in slices], SLICE):
                    found, begin = _slice_strings([x for _, x in slices[i:j]], depth)
                    np.add.at(score, [k for k, _ in slices[i:j]], np.add.reduceat(strings.lookup(found).astype(np.float64), begin[:-1]))
            add_words(np.full(n, _END), np.arange(n))
            return pa.table(
                {
                    "doc_id": left.column("doc_id"),
                    "held_out": left.column("held_out"),
                    "n_tokens": pa.array(n_tokens),
                    "n_known": pa.array(n_known),
                    "train_tokens": pa.array(np.full(n, n_train, np.int64)),
                    "base_score": pa.array(base),
                    "score": pa.array(score),
                }
            )

    return run


def score(docs: DataFrame, held_out: F.Column, depth: int = DEPTH) -> DataFrame:
    """The scores of all rows of docs, learned from those for which held_out is false."""
    spark, split, parts = docs.sparkSession, min(SPLIT, depth), shared.partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    saved = shared.save(rows.mapInArrow(_in_blocks(depth, parts), _SAVED), "blocks")
    found = saved.where(F.col("kind") != _DOC).select("kind", "part", "block", "keys", "n")
    totals = shared.save(found.repartitionById(parts, "part").mapInArrow(_part_totals(depth, split), _TOTALS), "tree")
    n_train, n_distinct = totals.where(F.col("kind") == _WORDS).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    got = totals.where(F.col("kind") == _STRINGS).select("nodes", "zeros", "ones", "log_w").toArrow()  # bounded by the nodes of `split` bytes
    if not got.num_rows:
        return spark.createDataFrame([], _SCORES)
    columns = [np.frombuffer(b"".join(got.column(c).to_pylist()), t) for c, t in (("nodes", np.uint64), ("zeros", float), ("ones", float), ("log_w", float))]
    top = spark.sparkContext.broadcast(_top(*columns, split))
    asked = found.withColumn("n", F.lit(None).cast("binary")).unionByName(totals.select("kind", "part", F.lit(-1).cast("long").alias("block"), "keys", "n"))
    replies = asked.repartitionById(parts, "part").sortWithinPartitions("kind", "part", "block").mapInArrow(_replies(depth, split, top), "block long, kind int, keys binary, values binary")
    blocks = saved.where(F.col("kind") == _DOC).select("block", "doc_id", "held_out", "text")
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_score_block(depth, n_train, n_distinct), _SCORES)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return score(docs, shared.id_remainder("doc_id", 10) == 0)
