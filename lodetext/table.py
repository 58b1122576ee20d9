"""A searchable table: data files of Parquet, index segments beside them, and a log of versions."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodetext.functions.tokenizer import TOKENIZERS
from lodetext.operators import index as I
from lodetext.operators import scan_search as S
from lodetext.plans import pruning as P
from lodetext.plans import query as Q
from lodetext.sources.catalog import data_files
from lodetext.sources.store import Store, VersionLog

SCORES = ("none", "indexed", "all")
STATS = ("global", "segment")
#: Upper bounds of the size tiers of compaction, in bytes of postings.
TIERS = (1 << 20, 10 << 20, 100 << 20, 1 << 30)
COMPACT_AT = 4
GRACE_SECONDS = 3600
#: Up to how many candidate blocks their list is broadcast; beyond, it is joined by shuffle.
BROADCAST_BLOCKS = 200_000


class NotFound(Exception):
    pass


class NotIndexed(Exception):
    pass


@dataclass
class IndexResult:
    column: str
    segments_created: int
    files_indexed: int
    version: int


@dataclass
class CompactResult:
    segments_merged: int
    segments_created: int
    stale_segments_cleaned: int


@dataclass
class VacuumResult:
    files_deleted: int
    deleted: list[str] = field(default_factory=list)


@dataclass
class SearchStats:
    segments_touched: int = 0
    candidate_blocks: int = 0
    total_rows: int = 0
    indexed_rows_scanned: int = 0
    unindexed_rows_scanned: int = 0
    unindexed_files_scanned: int = 0
    rows_matched: int = 0
    elapsed_ms: int = 0

    @property
    def rows_scanned(self) -> int:
        return self.indexed_rows_scanned + self.unindexed_rows_scanned


def batch_id(column: str, files: list[str]) -> str:
    """The same for the same files in any order; differs by column."""
    return "sha256:" + hashlib.sha256("".join(f"{x}\n" for x in [column, *sorted(files)]).encode()).hexdigest()


class SearchTable:
    """create() or open(); then register_files(), index(), search(), compact(), vacuum().

    Files may differ in their columns: the table has all of them, and a column that a file lacks is null there and matches nothing.
    """

    def __init__(self, spark: SparkSession, root: str, mode: str = "rw"):
        self.spark, self.root, self.mode = spark, root.rstrip("/"), mode
        self.store = Store(spark, self.root)
        self.log = VersionLog(self.store)

    # life cycle

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str, location: str, columns: list[str] = (), tokenizer: str = "lowercase_words") -> SearchTable:
        table = cls(spark, root)
        if tokenizer not in TOKENIZERS:
            raise ValueError(f"unknown tokenizer: {tokenizer}")

        def first(state):
            if state is not None:
                raise FileExistsError(f"there is a table in {root}")
            return {"format_version": 1, "table_id": uuid.uuid4().hex, "name": name, "location": location, "files": [], "segments": [], "pointers": {}, "columns": {c: {"status": "active", "tokenizer": tokenizer} for c in columns}}

        table.log.commit(first)
        return table

    @classmethod
    def open(cls, spark: SparkSession, root: str, mode: str = "r") -> SearchTable:
        table = cls(spark, root, mode)
        table.state()
        return table

    def state(self) -> dict:
        state = self.log.load()
        if state is None:
            raise NotFound(f"no table in {self.root}: run create-table or add-index first")
        return state

    def _change(self, change) -> dict:
        if self.mode != "rw":
            raise PermissionError("the table was opened for reading")
        return self.log.commit(lambda state: change(state) if state is not None else self.state())

    def columns(self) -> list[str]:
        return [c for c, v in self.state()["columns"].items() if v["status"] == "active"]

    def add_index(self, column: str, tokenizer: str = "lowercase_words") -> None:
        def change(state):
            if state["columns"].get(column, {}).get("status") == "active":
                raise ValueError(f"{column} is indexed already")
            return state | {"columns": state["columns"] | {column: {"status": "active", "tokenizer": tokenizer}}}

        self._change(change)

    def drop_index(self, column: str) -> None:
        def change(state):
            if state["columns"].get(column, {}).get("status") != "active":
                raise NotIndexed(column)
            return state | {
                "columns": state["columns"] | {column: state["columns"][column] | {"status": "dropped"}},
                "segments": [s for s in state["segments"] if s["column"] != column],
                "pointers": {c: p for c, p in state["pointers"].items() if c != column},
            }

        self._change(change)

    def register_files(self, files: list[str] | None = None) -> list[str]:
        """Adds data files (all of the table's location, by default); a search scans those that no segment covers."""
        found = files if files is not None else data_files(self.spark, self.state()["location"])
        found = [self._qualified(f) for f in found]

        self._register(found, lambda f: True)
        return found

    def replace_files(self, folder: str, files: list[str]) -> list[str]:
        """In one commit the files of a folder go and the given ones come: a batch that is written again leaves nothing of its first attempt."""
        folder = self._qualified(folder).rstrip("/") + "/"
        found = [self._qualified(f) for f in files]
        self._register(found, lambda f: not f.startswith(folder))
        return found

    def _register(self, found: list[str], stays) -> None:
        known = set(self.state()["files"])
        new = [f for f in found if f not in known]
        # footers are read once, by tasks; later reads take the schema from the state
        schema = self.spark.read.option("mergeSchema", "true").parquet(*new).schema if new else T.StructType()

        def change(state):
            files = [f for f in state["files"] if stays(f)]
            have = set(files)
            files += [f for f in found if f not in have]
            columns = {c.name: c for c in self._schema(state).fields} | {c.name: c for c in schema.fields if c.name not in self._schema(state).names}
            return state | {"files": files, "schema": T.StructType(list(columns.values())).json()} if files != state["files"] else None

        self._change(change)

    def _schema(self, state: dict) -> T.StructType:
        return T.StructType.fromJson(json.loads(state["schema"])) if state.get("schema") else T.StructType()

    def _read(self, state: dict, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self._schema(state)).parquet(*files)

    def remove_files(self, files: list[str]) -> None:
        gone = {self._qualified(f) for f in files}
        self._change(lambda state: state | {"files": [f for f in state["files"] if f not in gone]})

    def _qualified(self, path: str) -> str:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(where).toString()  # as in _metadata.file_path

    # index

    def index(self, columns: list[str] | None = None, files: list[str] | None = None, block_rows: int = I.BLOCK_ROWS) -> list[IndexResult]:
        """Indexes the files that a column's segments don't cover yet."""
        if files is not None or not self.state()["files"]:
            self.register_files(files)
        out = []
        for column in columns or self.columns():
            state = self.state()
            if state["columns"].get(column, {}).get("status") != "active":
                raise NotIndexed(column)
            known = {f for s in state["segments"] if s["column"] == column for f in s["files"]}
            wanted = [self._qualified(f) for f in files] if files is not None else state["files"]
            schema = self._schema(state)
            todo = [f for f in wanted if f not in known] if column in schema.names else []
            if not todo:
                out.append(IndexResult(column, 0, 0, self.log.version()))
                continue
            kind = schema[column].dataType
            if not isinstance(kind, T.StringType):
                raise TypeError(f"{column} is {kind.simpleString()}; only strings are indexed")
            rows = I.tokenised(I.located(self.spark, todo, [column], schema), column, state["columns"][column]["tokenizer"], block_rows)
            segment = self._write(column, todo, lambda path, rows=rows: I.index_segment(rows, block_rows, path), block_rows, "append")
            batch = segment["batch_id"]

            def change(state, segment=segment, batch=batch, column=column):
                if any(s["batch_id"] == batch for s in state["segments"]):
                    return None
                return state | {"segments": [*state["segments"], segment], "pointers": state["pointers"] | {column: len(state["files"])}}

            self._change(change)
            out.append(IndexResult(column, 1, len(todo), self.log.version()))
        return out

    def _write(self, column: str, files: list[str], write: Callable[[str], dict], block_rows: int, job: str) -> dict:
        path = f"segments/{column}-{uuid.uuid4().hex}"
        totals = write(f"{self.root}/{path}")
        return {"path": path, "column": column, "files": sorted(files), "block_rows": block_rows, "job": job, "batch_id": batch_id(column, files), **totals}

    # search

    def search(self, query: Q.Query | dict, select: list[str] | None = None, limit: int | None = None, score: str | bool = "none", stats_scope: str = "global", scan_above: float = 1.0, wide: bool = False) -> DataFrame:
        """text, the selected columns and, unless score is "none", score. Complete whatever is indexed.

        score: "none", "indexed" (rows of unindexed files have a null score) or "all". With a score and a limit: the best, ties by file and row. An index is passed over if the
        share of rows that may match is above scan_above. wide: a wildcard may stand for any number of terms; otherwise more than 1,024 are an error.
        """
        score = {True: "all", False: "none"}.get(score, score)
        if score not in SCORES or stats_scope not in STATS:
            raise ValueError(f"score is one of {SCORES}, stats_scope of {STATS}")
        query = Q.from_json(query) if isinstance(query, dict) else query
        hits, columns = self._hits(query, score, stats_scope, scan_above, wide)
        main = Q.columns(query)[0]
        extra = [c for c in columns if c != main] if select == ["*"] else [c for c in select or [] if c != main]
        if clash := {"text", "score"} & set(extra):
            raise ValueError(f"selected columns clash with those of the result: {sorted(clash)}")
        if missing := set(extra) - set(columns):
            raise ValueError(f"unknown columns: {sorted(missing)}")
        out = [F.col(f"`{main}`").alias("text"), *[F.col(f"`{c}`") for c in extra]]
        if score == "none":
            hits = hits.select(*out)
            return hits if limit is None else hits.limit(limit)
        hits = hits.select(*out, "score", "_file", "_row")
        if limit is not None:
            hits = S.top(hits, limit, "_file", "_row")
        return hits.drop("_file", "_row")

    def _cover(self, state: dict, query: Q.Query) -> tuple[dict[str, list[dict]], list[str], list[str]]:
        """Live segments of each column, the files that all of them cover, and the others."""
        by_column = {c: [s for s in state["segments"] if s["column"] == c] for c in Q.columns(query)}
        covered = set(state["files"])
        for segments in by_column.values():
            covered &= {f for s in segments for f in s["files"]}
        return by_column, [f for f in state["files"] if f in covered], [f for f in state["files"] if f not in covered]

    def _hits(self, query: Q.Query, score: str, scope: str, scan_above: float, wide: bool = False) -> tuple[DataFrame, list[str]]:
        state = self.state()
        if not state["files"]:
            empty = self.spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in Q.columns(query)]))
            return empty.selectExpr("*", "cast(null as double) as score", "'' as _file", "0L as _row"), empty.columns
        by_column, indexed, tail = self._cover(state, query)
        schema = self._schema(state)
        if missing := set(Q.columns(query)) - set(schema.names):
            raise ValueError(f"unknown columns: {sorted(missing)}")
        terms = S.wanted_terms(query)
        parts = []
        stats = self._stats(by_column, indexed, tail, terms, state) if score != "none" or scan_above < 1 else None
        if indexed:
            block_rows = {s["block_rows"] for v in by_column.values() for s in v}
            rows = I.located(self.spark, indexed, schema=schema)
            if len(block_rows) == 1 and not (stats and P.selectivity(self._merged_df(stats), next(iter(stats.values())).rows, query) > scan_above):
                rows = self._pruned(state, query, by_column, indexed, block_rows.pop(), wide)
            if rows is not None:
                if score != "none" and scope == "segment" and len(by_column) == 1:
                    parts += self._by_segment(rows, query, by_column, terms)
                else:
                    parts.append(S.matches(rows, query, stats if score != "none" else None))
        if tail:
            found = S.matches(I.located(self.spark, tail, schema=schema), query, stats if score == "all" else None)
            parts.append(found.withColumn("score", F.lit(None).cast("double")) if score == "indexed" else found)
        if not parts:
            parts = [S.matches(I.located(self.spark, state["files"][:1], schema=schema).limit(0), query, stats if score != "none" else None)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), schema.names

    def _merged_df(self, stats: dict[str, S.ColumnStats]) -> dict:
        return {t: n for s in stats.values() for t, n in s.df.items()}

    def _stats(self, by_column, indexed, tail, terms, state: dict | None = None) -> dict[str, S.ColumnStats]:
        """Exact statistics: sums of the index where it covers live files alone, and one pass over the other files."""
        out = {}
        for column, wanted in terms.items():
            segments = by_column[column]
            exact = all(t.kind == "exact" for t in wanted) and all(set(s["files"]) <= set(indexed) for s in segments)
            rest = tail if exact else [*indexed, *tail]
            total = S.ColumnStats(0, 0, {})
            if exact and segments:
                df = P.document_frequencies(self.spark, [f"{self.root}/{s['path']}" for s in segments], wanted)
                total = S.ColumnStats(sum(s["total_rows"] for s in segments), sum(s["total_tokens"] for s in segments), df)
            if rest:
                total = total.plus(S.collect_stats(self._read(state or self.state(), rest), {column: wanted})[column])
            out[column] = total
        return out

    def _by_segment(self, rows: DataFrame, query: Q.Query, by_column, terms) -> list[DataFrame]:
        """Each segment's rows, scored with its own statistics; a file in several segments counts for the last."""
        (column, segments), out = next(iter(by_column.items())), []
        of = {f: k for k, s in enumerate(segments) for f in s["files"]}
        for k, s in enumerate(segments):
            df = P.document_frequencies(self.spark, [f"{self.root}/{s['path']}"], terms[column])
            own = {column: S.ColumnStats(s["total_rows"], s["total_tokens"], df)}
            mine = [f for f in s["files"] if of[f] == k]
            if mine:
                out.append(S.matches(rows.where(F.col("_file").isin(mine)), query, own))
        return out

    def _pruned(self, state: dict, query: Q.Query, by_column, indexed: list[str], block_rows: int, wide: bool = False) -> DataFrame | None:
        """Rows of candidate blocks: other files aren't opened, other blocks are left out before anything is tokenised."""
        blocks = P.candidate_blocks(self.spark, by_column, self.root, query, wide)
        per_file = {r.file: r["count"] for r in blocks.groupBy("file").count().collect()}  # as many rows as files
        files = [f for f in indexed if f in per_file]
        if not files:
            return None
        rows = I.located(self.spark, files, schema=self._schema(state))
        wanted = blocks.select(F.col("file").alias("_file"), F.col("block").alias("_block"))
        if sum(per_file.values()) <= BROADCAST_BLOCKS:
            wanted = F.broadcast(wanted)
        return rows.withColumn("_block", F.floor(F.col("_row") / block_rows).cast("long")).join(wanted, ["_file", "_block"], "left_semi").drop("_block")

    def search_stats(self, query: Q.Query | dict, matched: int | None = None) -> SearchStats:
        """What a search without limit touches. matched: the number of its hits, if they were counted already."""
        start, query = time.time(), Q.from_json(query) if isinstance(query, dict) else query
        state = self.state()
        if not state["files"]:
            return SearchStats()
        by_column, indexed, tail = self._cover(state, query)
        touched = {s["path"] for m in Q.leaves(query) for s in P.prune_segments(by_column[m.column], m)}
        scanned = blocks = 0
        if indexed:
            found = P.candidate_blocks(self.spark, by_column, self.root, query)
            sizes = [self.spark.read.parquet(f"{self.root}/{s['path']}/blocks") for s in next(iter(by_column.values()))]
            in_blocks = reduce(DataFrame.unionByName, sizes).join(found, ["file", "block"], "left_semi")
            blocks, scanned = in_blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
        tail_rows = self._read(state, tail).count() if tail else 0
        if matched is None:
            matched = self._hits(query, "none", "global", 1.0)[0].count()
        return SearchStats(len(touched), blocks, self._read(state, state["files"]).count(), scanned, tail_rows, len(tail), matched, int(1000 * (time.time() - start)))

    # maintenance

    def compact(self, column: str) -> CompactResult:
        """Merges segments of one size tier, four or more at a time, and any that hold files which aren't live; their postings go, so document frequencies stay exact."""
        state = self.state()
        live = set(state["files"])
        mine = [s for s in state["segments"] if s["column"] == column]
        tiers: dict[int, list[dict]] = {}
        for s in mine:
            size = sum(st.getLen() for st in self._statuses(s["path"]))
            tiers.setdefault(sum(size >= t for t in TIERS), []).append(s)
        merged, created, stale, new = [], [], 0, []
        for group in tiers.values():
            old = [s for s in group if not set(s["files"]) <= live]
            if len(group) < COMPACT_AT and not old:
                continue
            stale += len(old)
            for rows in sorted({s["block_rows"] for s in group}):
                part = [s for s in group if s["block_rows"] == rows]
                merged += part
                files = sorted({f for s in part for f in s["files"]} & live)
                if not files:
                    continue
                last = {f: s["path"] for s in part for f in s["files"] if f in live}  # a file in several segments counts for the last
                found, in_blocks = (self._parts(part, last, what) for what in ("postings", "blocks"))
                new.append(self._write(column, files, lambda path, found=found, in_blocks=in_blocks: I.write_segment(found, in_blocks, path), rows, "compact"))
        gone = {s["path"] for s in merged}
        if gone:

            def change(state):
                if not gone <= {s["path"] for s in state["segments"]}:
                    return None
                return state | {"segments": [s for s in state["segments"] if s["path"] not in gone] + new}

            named = {s["path"] for s in self._change(change)["segments"]}
            if not {s["path"] for s in new} <= named or gone & named:  # another writer was first: nothing was merged, and what was written for it goes
                for s in new:
                    self.store.delete(s["path"])
                return CompactResult(0, 0, 0)
            created = new
        return CompactResult(len(merged), len(created), stale)

    def _parts(self, segments: list[dict], last: dict[str, str], what: str) -> DataFrame:
        """One table of several segments, of each the files that count for it. Nothing is moved: segments whose files all count are read as they are, of the others rows are left out by a broadcast list."""
        whole, parts = [], []
        for s in segments:
            path, mine = f"{self.root}/{s['path']}/{what}", [f for f in s["files"] if last.get(f) == s["path"]]
            if len(mine) == len(s["files"]):
                whole.append(path)
            elif mine:
                names = self.spark.createDataFrame([(f,) for f in mine], "file string")
                parts.append(self.spark.read.parquet(path).join(F.broadcast(names), "file", "left_semi"))
        return reduce(DataFrame.unionByName, [*([self.spark.read.parquet(*whole)] if whole else []), *parts])

    def _statuses(self, path: str):
        where = self.store._path(f"{path}/postings")
        return self.store._fs.listStatus(where)

    def vacuum(self, grace_seconds: float = GRACE_SECONDS) -> VacuumResult:
        """Deletes segment folders that no current segment names and that are older than the grace time."""
        if self.mode != "rw":
            raise PermissionError("the table was opened for reading")
        used = {s["path"] for s in self.state()["segments"]}
        gone = [p for n in self.store.names("segments") if (p := f"segments/{n}") not in used and self.store.age_seconds(p) >= grace_seconds]
        for p in gone:
            self.store.delete(p)
        return VacuumResult(len(gone), gone)
