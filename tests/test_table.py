import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from lodetext.operators import scan_search as S
from lodetext.plans.query import And, Match, Or
from lodetext.sources.store import Conflict, Store
from lodetext.table import NotFound, NotIndexed, SearchTable

FIVE = ["error timeout connection refused", "success response ok", "error connection reset", "warning slow query", "error timeout database"]


@pytest.fixture
def table(spark, tmp_path):
    def make(*paths, columns=("description",), index=True, block_rows=25):
        t = SearchTable.create(spark, f"file://{tmp_path}/table", "test", paths[0] if paths else str(tmp_path), list(columns))
        if paths:
            t.register_files(list(paths))
        if index and paths:
            t.index(files=list(paths), block_rows=block_rows)
        return t

    return make


def q(text, operator="or"):
    return Match("description", text, operator)


def test_and_or_and_stats(table, write_parquet):
    t = table(write_parquet("roundtrip", 100, FIVE))
    assert t.search(q("error timeout", "and")).count() == 40 and t.search(q("error timeout")).count() == 60
    stats = t.search_stats(q("error"))
    assert stats.rows_matched == 60 and stats.candidate_blocks == 4 and stats.rows_scanned == 100 and stats.segments_touched == 1


def test_schema_select_and_limit(table, write_parquet):
    t = table(write_parquet("a", 10, ["error here"]))
    assert t.search(q("error"), limit=1).columns == ["text"]
    rows = t.search(q("error"), ["id"], 3)
    assert rows.columns == ["text", "id"] and rows.count() == 3
    assert t.search(q("error"), ["*"], score="all").columns == ["text", "id", "score"]
    with pytest.raises(ValueError):
        t.search(q("error"), ["nope"])
    with pytest.raises(ValueError):
        t.search(q("error"), score="some")


def test_two_appends_and_pruning(table, write_parquet):
    a, b = write_parquet("a", 20, ["alpha bravo charlie"]), write_parquet("b", 20, ["delta echo foxtrot"])
    t = table(a)
    t.index(files=[b])
    assert [t.search(q(x)).count() for x in ("alpha", "delta", "nonexistent", "!!")] == [20, 20, 0, 0]
    stats = t.search_stats(q("alpha"))
    assert stats.rows_scanned == 20 and stats.segments_touched == 1


def test_indexing_twice_is_one_commit(table, write_parquet):
    a = write_parquet("a", 20, ["hello world"])
    t = table(a)
    before = t.log.version()
    assert t.index(files=[a])[0].segments_created == 0 and t.log.version() == before and t.search(q("hello")).count() == 20


@pytest.mark.parametrize("score", ["none", "indexed", "all"])
def test_mixed_coverage(table, write_parquet, score):
    a, b = write_parquet("a", 20, ["error timeout connection", "success response ok"]), write_parquet("b", 20, ["Error reset", "fine"])
    t = table(a)
    t.register_files([a, b])
    hits = t.search(q("error"), score=score)
    assert hits.count() == 20
    if score != "none":
        assert hits.where("score is null").count() == (10 if score == "indexed" else 0)
        scan = S.search(t.spark.read.parquet(a, b), q("error"), scored=True)
        if score == "all":
            assert sorted(round(r.score, 9) for r in hits.collect()) == sorted(round(r.score, 9) for r in scan.collect())
    t.index(["description"])
    assert t.search(q("error"), score="all").where("score is not null").count() == 20


def test_scored_limit_is_the_best(table, write_parquet):
    texts = ["error", "error one two three four", "error " + "word " * 11, "success response ok completed"]
    t = table(write_parquet("topk", 120, texts))
    rows = t.search(q("error"), ["id"], 5, "all").collect()
    assert [r.text for r in rows] == ["error"] * 5 and [r.id for r in rows] == [0, 4, 8, 12, 16]
    assert t.search(q("error error"), [], 1, "all").first().score == pytest.approx(2 * rows[0].score)
    assert t.search(q("error"), [], 1, "all", stats_scope="segment").first().score == pytest.approx(rows[0].score)


def test_nulls_and_wildcards(table, write_parquet):
    t = table(write_parquet("n", 30, ["connect now", None, "reconnect later"]))
    assert [t.search(q(x)).count() for x in ("connect", "con*", "*connect", "null")] == [10, 10, 20, 0]
    stats = t._stats(*t._cover(t.state(), q("connect")), S.wanted_terms(q("connect")))
    assert stats["description"].rows == 30 and stats["description"].tokens == 40


def test_many_expansions_fail(spark, tmp_path):
    spark.range(1500).select(F.concat(F.lit("x"), "id").alias("description")).coalesce(1).write.parquet(f"{tmp_path}/many")
    t = SearchTable.create(spark, f"file://{tmp_path}/table", "many", f"{tmp_path}/many", ["description"])
    t.index()
    from lodetext.functions.tokenizer import Term
    from lodetext.plans.pruning import expansions

    with pytest.raises(ValueError):
        expansions(spark, [f"{t.root}/{s['path']}" for s in t.state()["segments"]], Term("x", "prefix"))
    assert len(expansions(spark, [f"{t.root}/{s['path']}" for s in t.state()["segments"]], Term("x123", "prefix"))) == 11


def test_trees_agree_with_scan(table, write_parquet):
    a = write_parquet("a", 100, FIVE)
    t = table(a)
    for query in (And((q("error"), q("timeout reset"))), Or((q("warning"), q("error database", "and"))), And((q("error"), q("missing")))):
        assert t.search(query).count() == S.search(t.spark.read.parquet(a), query).count()


def test_lifecycle(table, write_parquet):
    paths = [write_parquet(f"f{i}", 10, [f"alpha word{i}"]) for i in range(4)]
    t = table(*paths, index=False)
    for p in paths:
        t.index(files=[p])
    t.remove_files(paths[:1])
    assert t.search(q("alpha")).count() == 30
    done = t.compact("description")
    assert (done.segments_merged, done.segments_created, done.stale_segments_cleaned) == (4, 1, 1)
    assert t.search(q("alpha")).count() == 30 and t.search(q("word0")).count() == 0
    segment = t.state()["segments"][0]
    assert segment["total_rows"] == 30
    assert t.spark.read.parquet(f"{t.root}/{segment['path']}/terms").where("term = 'alpha'").first().df == 30
    assert t.vacuum().files_deleted == 0 and t.vacuum(0).files_deleted == 4 and t.search(q("alpha")).count() == 30
    t.drop_index("description")
    assert t.columns() == [] and t.search(q("alpha")).count() == 30
    t.add_index("description")
    with pytest.raises(ValueError):
        t.add_index("description")
    with pytest.raises(PermissionError):
        SearchTable.open(t.spark, t.root).drop_index("description")
    with pytest.raises(NotFound):
        SearchTable.open(t.spark, t.root + "-none")


def test_only_strings_are_indexed(table, write_parquet):
    t = table(write_parquet("a", 5, ["x"]), columns=("id",), index=False)
    with pytest.raises(TypeError):
        t.index()
    with pytest.raises(NotIndexed):
        t.index(["other"])


def test_empty_table(table):
    t = table(index=False)
    assert t.search(q("anything")).count() == 0 and t.search_stats(q("anything")).rows_matched == 0


def test_commits_are_exclusive(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.create("a", "1")
    with pytest.raises(Conflict):
        s.create("a", "2")
    assert s.read("a") == "1"


def test_half_written_versions_are_passed_over(table, write_parquet):
    t = table(write_parquet("a", 10, ["error here"]))
    stream = t.store._fs.create(t.store._path("metadata/v99.json"), False)
    stream.close()
    assert t.search(q("error")).count() == 10
    t.add_index("id2")
    assert t.columns() == ["description", "id2"] and t.log.version() == 100
    assert not [n for n in t.store.names("metadata") if n.endswith(".part")]


def test_two_writers_lose_nothing(spark, tmp_path):
    SearchTable.create(spark, f"file://{tmp_path}/t", "t", str(tmp_path), [])
    tables = [SearchTable(spark, f"file://{tmp_path}/t") for _ in range(4)]
    threads = [threading.Thread(target=t.add_index, args=(f"c{k}",)) for k, t in enumerate(tables)]
    [x.start() for x in threads], [x.join() for x in threads]
    assert sorted(tables[0].columns()) == ["c0", "c1", "c2", "c3"]


def test_files_with_other_columns(spark, table, write_parquet, tmp_path):
    spark.createDataFrame([(1, "x")], "id int, other string").coalesce(1).write.parquet(f"{tmp_path}/other")
    other = spark.read.parquet(f"{tmp_path}/other").inputFiles()
    t = table(write_parquet("a", 10, ["error here"]))
    t.register_files(other)
    assert t.search(q("error"), ["*"]).columns == ["text", "id", "other"] and t.search(q("error")).count() == 10
    assert t.search(Match("other", "x"), ["id"]).count() == 1
    t.index()
    assert t.search(q("error"), score="all").count() == 10


def test_a_lost_compaction_reports_nothing(table, write_parquet, monkeypatch):
    files = [write_parquet(f"f{k}", 10, ["error here"]) for k in range(4)]
    t = table(files[0], block_rows=1000)
    for f in files[1:]:
        t.index(files=[f])
    inner = t._write

    def late(*a):
        out = inner(*a)
        assert len(t.store.names("segments")) == 5
        SearchTable(t.spark, t.root).drop_index("description")
        return out

    monkeypatch.setattr(t, "_write", late)
    result = t.compact("description")
    assert (result.segments_merged, result.segments_created) == (0, 0) and len(t.store.names("segments")) == 4


def test_a_replayed_batch(spark, table, write_parquet, tmp_path):
    t = table(columns=["description"])
    for text in ("first try", "second try"):
        spark.createDataFrame([(1, text)], "id int, description string").write.parquet(f"{tmp_path}/batch-0/{text[0]}")
        files = t.replace_files(f"{tmp_path}/batch-0", spark.read.parquet(f"{tmp_path}/batch-0/{text[0]}").inputFiles())
        t.index(files=files)
    assert [r.text for r in t.search(q("try")).collect()] == ["second try"] and t.search(q("first")).count() == 0


def test_wide_wildcards_fail_in_a_search(spark, table, tmp_path):
    spark.createDataFrame([(i, f"x{i}") for i in range(1100)], "id int, description string").coalesce(1).write.parquet(f"{tmp_path}/wide")
    t = table(*spark.read.parquet(f"{tmp_path}/wide").inputFiles())
    for text in ("x*", "*1 x*"):
        with pytest.raises(ValueError, match="1024"):
            t.search(q(text))
    assert t.search(q("*99")).count() == 11 and t.search(q("x109*")).count() == 11


def test_many_files_in_the_state(table, monkeypatch):
    t = table()
    many = [f"file:///data/f{k}.parquet" for k in range(100_000)]
    t.log.commit(lambda state: state | {"files": many})
    by_column, indexed, tail = t._cover(t.state(), q("x"))
    assert indexed == [] and len(tail) == 100_000


def test_http(spark, table, write_parquet):
    from lodetext.server import Searches, http_server

    t = table(write_parquet("a", 100, FIVE))
    server = http_server(Searches(spark, {"tables": {"test": t.root}}))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def get(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, json.dumps(body).encode() if body is not None else None)) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    assert get("/health") == (200, "ok") and json.loads(get("/tables")[1]) == {"tables": ["test"]}
    assert json.loads(get("/tables/test")[1])["indexed_columns"] == ["description"] and get("/tables/none")[0] == 404
    code, body = get("/v1/tables/test/search", {"search": {"column": "description", "match": "error timeout", "operator": "and"}, "limit": 3, "score": "indexed"})
    answer = json.loads(body)
    assert code == 200 and len(answer["rows"]) == 3 and answer["stats"]["rows_matched"] == 40
    assert get("/v1/tables/none/search", {"search": {"column": "description", "match": "x"}})[0] == 404
    assert get("/v1/tables/test/search", {"search": {"column": "id", "match": "x"}})[0] == 400
    server.shutdown()


def test_flight(spark, table, write_parquet):
    fl = pytest.importorskip("pyarrow.flight")
    from lodetext.server import Searches, flight_server

    t = table(write_parquet("a", 100, FIVE))
    server = flight_server(Searches(spark, {"tables": {"test": t.root}}))
    client = fl.connect(f"grpc://127.0.0.1:{server.port}")
    ticket = json.dumps({"table": "test", "search": {"column": "description", "match": "error timeout", "operator": "and"}, "select": ["id"], "score": "indexed"}).encode()
    assert client.do_get(fl.Ticket(ticket)).read_all().num_rows == 40
    assert client.get_flight_info(fl.FlightDescriptor.for_command(ticket)).schema.names == ["text", "id", "score"]
    with pytest.raises(Exception, match="not found"):
        client.do_get(fl.Ticket(json.dumps({"table": "none", "column": "description", "match": "x"}).encode())).read_all()
    server.shutdown()


def test_cli(spark, write_parquet, tmp_path, capsys):
    from lodetext.cli import main

    a, root = write_parquet("a", 100, FIVE), f"file://{tmp_path}/cli"
    main(["create-table", "--table", root, "--name", "t", "--location", a, "--columns", "description"], spark)
    main(["index", "--table", root], spark)
    out = main(["query", "--table", root, "--column", "description", "--match", "error timeout", "--operator", "and", "--limit", "2"], spark)
    assert len(out["rows"]) == 2 and out["stats"]["rows_matched"] == 40


def test_streams(spark, write_parquet, tmp_path):
    from lodetext.streaming.ingest import index_arrivals, stream_match, windowed_hits

    source = tmp_path / "in"
    spark.createDataFrame([(1, "error one", "2024-01-01 00:00:10"), (2, "fine", "2024-01-01 00:00:20"), (3, "Error two", "2024-01-01 00:05:00")], "id int, description string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(str(source))
    stream = spark.readStream.schema("id int, description string, at timestamp").parquet(str(source))
    for name, df, mode in (("m", stream_match(stream, q("error")), "append"), ("w", windowed_hits(stream, q("error"), "at", "1 minute", "10 minutes"), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("m").count() == 2 and sorted(r.hits for r in spark.table("w").collect()) == [1, 1]
    t = SearchTable.create(spark, f"file://{tmp_path}/t", "s", f"file://{tmp_path}/data", ["description"])
    index_arrivals(stream, t, f"file://{tmp_path}/cp").awaitTermination()
    assert t.search(q("error")).count() == 2 and t.search_stats(q("error")).unindexed_files_scanned == 0


def test_table_function(spark):
    from lodetext.functions.sql import register_table_function

    rows = spark.createDataFrame([(1, "one two", 5), (2, "Two three", 6), (3, None, 7), (4, "", 8)], "id long, text string, query int")
    register_table_function(spark, "lt_some", rows)
    found = lambda q: [tuple(r) for r in spark.sql(q).orderBy("id").collect()]
    assert found("SELECT id, query FROM lt_some('two', 'or')") == [(1, 5), (2, 6)]
    assert found("SELECT id FROM lt_some('three TWO', 'and')") == [(2,)]
    assert found("SELECT id FROM lt_some('', 'and') UNION ALL SELECT id FROM lt_some('', 'or')") == []


def test_ranges_by_size(spark, monkeypatch):
    """A term that is in most blocks is dealt over several ranges; all ranges are disjoint and sorted."""
    from lodetext.operators import index as I

    monkeypatch.setattr(I, "RANGE_BYTES", 400)
    rows = spark.range(600).selectExpr("if(id % 3 = 0, concat('w', id), 'the') AS term", "'f' AS file", "id AS block", "1L AS row_hits")
    parts = I.ranged(rows, 600, "term", "file", "block").rdd.mapPartitions(lambda p: [[(r.term, r.file, r.block) for r in p]]).collect()
    parts = sorted(p for p in parts if p)
    assert len(parts) > 8 and sum(map(len, parts)) == 600
    assert [x for p in parts for x in p] == sorted(x for p in parts for x in p)
    assert sum(any(t == "the" for t, _, _ in p) for p in parts) > 1
