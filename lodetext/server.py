"""Searches over HTTP and Arrow Flight."""

from __future__ import annotations

import contextlib
import json
import threading
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from lodetext.plans import query as Q
from lodetext.table import NotFound, NotIndexed, SearchTable

DEFAULTS = {"address": "127.0.0.1:0", "timeout_seconds": 300, "tables": {}}


class Timeout(Exception):
    pass


@contextlib.contextmanager
def all_at_once(hits: DataFrame):
    """The hits and their number. They are found by all tasks together and kept on the executors' disks, so that fetching them partition by partition searches nothing."""
    hits = hits.persist(StorageLevel.DISK_ONLY)
    try:
        yield hits, hits.count()
    finally:
        hits.unpersist()


class Searches:
    """Tables by name. Every request reads the newest version of its table."""

    def __init__(self, spark: SparkSession, config: dict):
        self.spark, self.config = spark, DEFAULTS | config

    def table(self, name: str) -> SearchTable:
        if name not in self.config["tables"]:
            raise NotFound(f"table {name} not found")
        return SearchTable.open(self.spark, self.config["tables"][name])

    def describe(self, name: str) -> dict:
        state = self.table(name).state()
        return {"name": name, "table_id": state["table_id"], "indexed_columns": [c for c, v in state["columns"].items() if v["status"] == "active"], "files": len(state["files"])}

    def prepare(self, name: str, request: dict) -> DataFrame:
        table = self.table(name)
        search = request.get("search") or {k: request[k] for k in ("column", "match", "operator") if k in request}
        query = Q.from_json(search)
        for c in Q.columns(query):
            if c not in table.columns():
                raise NotIndexed(f"column {c} is not indexed")
        return table.search(query, request.get("select") or [], request.get("limit"), request.get("score", "none"))

    def run(self, name: str, request: dict) -> dict:
        """Rows and statistics; the work is cancelled at the time limit."""
        tag, start = f"search-{uuid.uuid4().hex}", time.time()
        hits = self.prepare(name, request)
        timer = threading.Timer(self.config["timeout_seconds"], self.spark.sparkContext.cancelJobsWithTag, [tag])
        self.spark.sparkContext.addJobTag(tag)
        timer.start()
        try:
            query = Q.from_json(request.get("search") or {k: request[k] for k in ("column", "match", "operator") if k in request})
            if request.get("limit") is not None:
                rows, stats = [json.loads(r) for r in hits.toJSON().collect()], self.table(name).search_stats(query)
            else:
                with all_at_once(hits) as (hits, matched):
                    rows = [json.loads(r) for r in hits.toJSON().toLocalIterator()]
                stats = self.table(name).search_stats(query, matched)
        except Exception as e:
            if time.time() - start >= self.config["timeout_seconds"]:
                raise Timeout("the search took too long") from e
            raise
        finally:
            timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)
        return {"rows": rows, "stats": {"candidate_blocks": stats.candidate_blocks, "rows_scanned": stats.rows_scanned, "rows_matched": stats.rows_matched, "elapsed_ms": int(1000 * (time.time() - start))}}


def http_server(searches: Searches) -> ThreadingHTTPServer:
    """GET /health, /tables, /tables/{name}; POST /v1/tables/{name}/search. Call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def answer(self, code: int, body) -> None:
            data = (body if isinstance(body, str) else json.dumps(body)).encode()
            self.send_response(code)
            self.send_header("Content-Type", "text/plain" if isinstance(body, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def guarded(self, work) -> None:
            try:
                self.answer(200, work())
            except NotFound as e:
                self.answer(404, {"error": str(e)})
            except Timeout as e:
                self.answer(408, {"error": str(e)})
            except (NotIndexed, ValueError, KeyError) as e:
                self.answer(400, {"error": str(e)})
            except Exception as e:
                self.answer(500, {"error": str(e)})

        def do_GET(self) -> None:
            parts = self.path.strip("/").split("/")
            if parts == ["health"]:
                self.answer(200, "ok")
            elif parts == ["tables"]:
                self.guarded(lambda: {"tables": sorted(searches.config["tables"])})
            elif len(parts) == 2 and parts[0] == "tables":
                self.guarded(lambda: searches.describe(parts[1]))
            else:
                self.answer(404, {"error": "no such route"})

        def do_POST(self) -> None:
            parts = self.path.strip("/").split("/")
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if len(parts) == 4 and parts[:2] == ["v1", "tables"] and parts[3] == "search":
                self.guarded(lambda: searches.run(parts[2], json.loads(body)))
            else:
                self.answer(404, {"error": "no such route"})

    host, _, port = searches.config["address"].rpartition(":")
    return ThreadingHTTPServer((host, int(port)), Handler)


def flight_server(searches: Searches, location: str = "grpc://127.0.0.1:0"):
    """get_flight_info and do_get; a ticket is the JSON of a search request with its table."""
    import pyarrow as pa
    import pyarrow.flight as fl

    class Server(fl.FlightServerBase):
        def _hits(self, ticket: bytes) -> DataFrame:
            request = json.loads(ticket)
            try:
                return searches.prepare(request["table"], request)
            except (NotFound, NotIndexed, ValueError, KeyError) as e:
                raise fl.FlightServerError(str(e)) from e

        def get_flight_info(self, context, descriptor):
            hits = self._hits(descriptor.command)
            schema = hits.limit(0).toArrow().schema
            return fl.FlightInfo(schema, descriptor, [fl.FlightEndpoint(descriptor.command, [])], -1, -1)

        def do_get(self, context, ticket):
            hits = self._hits(ticket.ticket)
            schema = hits.limit(0).toArrow().schema

            def batches():
                # partition by partition, so that the server holds one at a time
                with all_at_once(hits) as (found, _):
                    yield from found.toLocalIterator(prefetchPartitions=True)

            def grouped():
                rows = []
                for r in batches():
                    rows.append(r.asDict(recursive=True))
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

            return fl.GeneratorStream(schema, grouped())

    return Server(location)
