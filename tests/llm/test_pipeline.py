import random
from collections import defaultdict

import corpus_pipeline

WORDS = [a + b for a in ("kal", "mor", "tin", "sul", "ver") for b in ("a", "en", "ito", "us", "or", "ing")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def test_every_stage_takes_effect(spark, tmp_path):
    rng = random.Random(1)
    texts = {i: prose(rng, 60) for i in range(60)}
    line = "a line of more than forty characters that many documents hold"
    for i in range(10, 16):
        texts[i] = f"{line}\n{texts[i]}"
    texts[30] = texts[20].upper()
    texts[31] = texts[20] + " tail"
    item = prose(rng, 20)
    texts[40] += " " + item
    texts[50], texts[51], texts[52] = None, "12345 !!", ""
    docs = spark.createDataFrame([(i, t, "xx", "s", None if t is None else len(t)) for i, t in texts.items()] + [(5, texts[5], "xx", "s", len(texts[5]))], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id].append(r)
    assert sorted(pieces) == [i for i in texts if i not in (30, 31, 40, 50, 51, 52)]
    assert all(sum(p.length for p in v) == v[0].doc_tokens for v in pieces.values())

    stages = dict(corpus_pipeline.STAGES)
    kept = stages["line dedup"](spark, docs.where("text is not null"), str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if line in r.text) == [15] and all(r.n_chars == len(r.text) for r in kept.collect())


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_awkward_rows(spark, awkward, tmp_path):
    """Rows of one doc_id and text count once, those of one doc_id and different texts stay together; clashing and null columns, very long texts and a null doc_id pass."""
    docs = awkward.withColumn("N_Lines", awkward.doc_id)
    items = spark.createDataFrame([(1, "no benchmark passage that any document holds in its text at all here")], "item_id long, text string")
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        columns, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns
        kept[name] = sorted(r.doc_id or 0 for r in docs.collect())
    assert kept["language ID"] == [0, 3, 4, 4, 5, 5] and kept["n-gram Jaccard join"] == kept["benchmark decontamination"] == [0, 3, 4, 5, 5]
    assert set(kept["packing"]) == {0, 3, 4, 5}


def test_tables_of_others_stay(spark, docs, tmp_path):
    """A packing result that is still unread can be read after a pipeline run over another folder."""
    from lodetext.llm import packing

    table = docs(["some words to pack"] * 3)
    table.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    mine = packing.pack(table)
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 1
    assert mine.select("doc_id").distinct().count() == 3
