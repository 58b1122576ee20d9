"""Harmonic packing of documents into fixed-length sequences.

A document's ids are cut into pieces. Piece lengths fall into reciprocal-capacity classes: class k takes lengths up to
capacity // k, and each of its bins is filled with exactly k pieces. Since documents may be cut, a remainder is cut to the
largest class length that it reaches, unless it already fills its class to within `slack`; what is shorter than capacity // MOST
stays whole in the class of its own length. Every worker fills bins of every class by itself. What stays over (fewer than k pieces a
class and worker) is filled class by class, for groups of workers and then for all, and what stays over from that (a number of pieces that the
capacity bounds, whatever the data) goes into the last bins by first fit in falling order of length.

Defined cases: a null or empty text gives the end id alone; a null doc_id is packed like any other; repeated rows are
separate documents; other columns are ignored; an empty table gives no piece. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodetext.llm import shared

#: Remainders are cut to capacity // k for k up to this.
MOST = 64
#: Bytes of a Python worker's cache of words and their ids.
CACHE_BYTES = 24 << 20
#: Pieces of an output batch.
BATCH = 5_000
#: Workers whose leftover pieces are put together first.
GROUP = 32

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int, worker long, sequence_id long, offset long"
_COLUMNS = [x.split()[0] for x in _PIECE.split(", ")]
_encoders: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_BLANK, _PUNCTUATION, _ALNUM = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_BLANK[list(shared.BLANKS.encode())] = True
_ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True
_PUNCTUATION[[c for c in range(33, 127) if not _ALNUM[c]]] = True
#: What splits a text for tokenizers whose words can be encoded one by one.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _by_words(spec: dict) -> bool:
    """Whether the tokenizer lowers, drops white space, splits at it and between letters and other characters, and marks the ends of words."""
    steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    model = spec.get("model") or {}
    return steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": _SPLIT} and bool(split.get("invert")) and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")


def _cut_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end: what stands between blanks, with punctuation behind a letter or digit apart."""
    a = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff((~_BLANK[a]).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    last = np.where(_PUNCTUATION[a], -1, np.arange(len(a)))
    np.maximum.accumulate(last, out=last)
    core = last[ends - 1] + 1 if len(ends) else ends
    apart = (core > starts) & (core < ends)
    apart[apart] = _ALNUM[a[core[apart] - 1]]
    twice = np.ones(len(starts), np.int64) + apart
    at = np.cumsum(twice) - twice
    s, e = np.repeat(starts, twice), np.repeat(ends, twice)
    e[at[apart]] = s[at[apart] + 1] = core[apart]
    return s, e


class Encoder:
    """Texts to their ids. Words (_cut_words) are looked up by a 64-bit hash of their lowered bytes in a cache of bounded size, those used longest ago leave it; new words are encoded together.

    Texts that may hold a special token, and all texts of tokenizers of another kind, go through the tokenizer whole.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.whole, self.most = Tokenizer.from_file(path), cache_bytes
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.by_words = _by_words(json.load(f))
        self.last = np.zeros(self.whole.get_vocab_size(), bool)
        self.last[[i for t, i in self.whole.get_vocab().items() if t.endswith("</w>")]] = True
        nul = self._ids("\0")
        self.nul = ("\0", nul[0]) if len(nul) == 1 else ("\0", -1)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.begin, self.size, self.used, self.ids, self.turn = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4"), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")

    def _encode(self, words: list[str], mark: tuple[str, int] | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each has; words of letters alone end with a marked id, others are set apart by a mark."""
        joined = self._ids(" ".join(words) if mark is None else f" {mark[0]} ".join([*words, ""]))
        at = np.flatnonzero(self.last[joined] if mark is None else joined == mark[1])
        if len(at) == len(words):
            size = np.diff(at, prepend=-1)
            return (joined, size) if mark is None else (joined[joined != mark[1]], size - 1)
        found = [self._ids(w) for w in words]
        return np.concatenate([np.empty(0, "<u4"), *found]), np.fromiter(map(len, found), np.int64, len(words))

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        plain = np.fromiter(map(str.isalpha, words), bool, len(words))
        for kind in (True, False):
            mine = np.flatnonzero(plain == kind)
            if not len(mine):
                continue
            ids, size = self._encode([words[k] for k in mine.tolist()], None if kind else self.nul)
            begin = len(self.ids) + np.cumsum(size) - size
            order = np.argsort(joined := np.concatenate((self.hashes, hashes[mine])), kind="stable")
            self.hashes = joined[order]
            self.begin, self.size = np.concatenate((self.begin, begin))[order], np.concatenate((self.size, size))[order]
            self.used = np.concatenate((self.used, np.full(len(mine), self.turn)))[order]
            self.ids = np.concatenate((self.ids, ids))

    def _forget(self) -> None:
        """Half of the cache goes if it is too large."""
        if 32 * len(self.hashes) + 4 * len(self.ids) <= self.most:
            return
        keep = np.sort(np.argsort(-self.used, kind="stable")[: len(self.hashes) // 2])
        self.ids = self.ids[_ranges(self.begin[keep], self.size[keep])]
        self.hashes, self.size, self.used = self.hashes[keep], self.size[keep], self.used[keep]
        self.begin = np.cumsum(self.size) - self.size

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = b"\n".join(texts) + b"\n"
        starts, ends = _cut_words(data)
        u, first, inverse = np.unique(shared.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        self.turn += 1
        at = np.minimum(np.searchsorted(self.hashes, u), max(0, len(self.hashes) - 1))
        new = np.flatnonzero(self.hashes[at] != u) if len(self.hashes) else np.arange(len(u))
        if len(new):
            self._learn(u[new], [data[s:e].decode() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, u)
        self.used[at] = self.turn
        at = at[inverse]
        size = self.size[at]
        ids = self.ids[_ranges(self.begin[at], size)]
        self._forget()
        total = np.concatenate(([0], np.cumsum(size)))
        where = np.cumsum([0] + [len(t) + 1 for t in texts])
        return ids, total[np.searchsorted(starts, where)]

    def __call__(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        odd = [not self.by_words or any(x in t for x in self.special) for t in texts]
        ids, at = self._words([b"" if o else t for t, o in zip(texts, odd, strict=True)])
        for k, t in enumerate(texts):
            yield self._ids(t.decode()) if odd[k] else ids[at[k] : at[k + 1]]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ..., size[0] of them, then the same for the next."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = made = Encoder(path)
        shared.caches["packing"] = made.clear
    return _encoders[path]


def cut(length: int, capacity: int, slack: float) -> list[tuple[int, int]]:
    """(class, length) of the pieces of a document, in order."""
    out = [(1, capacity)] * (length // capacity)
    rest = length % capacity
    while rest:
        fits = capacity // rest
        if fits * rest >= capacity * (1 - slack) or -(-capacity // rest) > MOST:
            out.append((fits, rest))
            break
        k = -(-capacity // rest)
        out.append((k, capacity // k))
        rest -= capacity // k
    return out


class _Bins:
    """Open bins of one worker: class k closes a bin with its k-th piece."""

    def __init__(self, level: int, worker: int):
        self.open: dict[int, list[list]] = {}
        self.next = level << 60 | worker << 36

    def add(self, row: list) -> list[list]:
        k = row[5]
        pieces = self.open.setdefault(k, [])
        pieces.append(row)
        if len(pieces) < k:
            return []
        del self.open[k]
        at = 0
        for r in pieces:
            r[7:9] = [self.next, at]
            at += r[2]
        self.next += 1
        return pieces

    def rest(self) -> list[list]:
        return [r for k in sorted(self.open) for r in self.open[k]]


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32() if c == "k" else pa.int64() for c in _COLUMNS]
    columns = zip(*rows, strict=True) if rows else [[] for _ in _COLUMNS]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=_COLUMNS)


def _worker() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _encode_and_fill(path: str, end_id: int, capacity: int, slack: float):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode, me = encoder(path), _worker()
        bins, rows = _Bins(0, me), []
        with np.errstate(over="ignore"):
            for b in batches:
                for docs, texts in shared.byte_batches([b], ["doc_id", "text"], keep="packing"):
                    for doc, got in zip(docs, encode([t or b"" for t in texts]), strict=True):
                        ids = memoryview(got.tobytes() + end)
                        total, at = len(ids) // 4, 0
                        for k, n in cut(total, capacity, slack):
                            rows += bins.add([doc, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), total, k, me, None, None])
                            at += n
                        if len(rows) > BATCH:
                            yield _batch(rows)
                            rows = []
        yield _batch(rows + bins.rest())

    return run


def _fill(level: int):
    def run(batches):
        bins, rows = _Bins(level, _worker()), []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += bins.add(list(r))
                if len(rows) > BATCH:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows + bins.rest())

    return run


def _first_fit(capacity: int):
    def run(batches):
        rows = sorted((list(r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (-r[2], r[0] is None, r[0], r[1], r[6]))
        used: list[int] = []
        for r in rows:
            at = next((i for i, u in enumerate(used) if u + r[2] <= capacity), len(used))
            if at == len(used):
                used.append(0)
            r[7:9] = [3 << 60 | at, used[at]]
            used[at] += r[2]
        yield _batch(rows)

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048, end_id: int = 1, slack: float = 0.01) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; sequences are gapless."""
    spark = docs.sparkSession
    path = tokenizer_path or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = shared.save(rows.mapInArrow(_encode_and_fill(path, end_id, capacity, slack), _PIECE), "pieces")
    filled, done = first, []
    for level, keys in ((1, ["k", F.floor(F.col("worker") / GROUP)]), (2, ["k"])):
        done.append(filled.where("sequence_id is not null"))
        over = filled.where("sequence_id is null").repartition(shared.partitions(spark), *keys).sortWithinPartitions("k", "worker", "doc_id", "start", "ids_crc32")
        filled = shared.save(over.mapInArrow(_fill(level), _PIECE), "pieces-over")
    done.append(filled.where("sequence_id is not null"))
    # fewer than k pieces of each class, however many documents there are
    done.append(filled.where("sequence_id is null").repartition(1).mapInArrow(_first_fit(capacity), _PIECE))
    filled = functools.reduce(DataFrame.unionByName, done)
    return filled.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(shared.table(spark, sf_dir, "documents"))
