"""The engine's functions for SQL: lt_tokenize, lt_match_any, lt_match_all and lt_bm25, as SQL functions over built-in expressions, and searches as table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lodetext.functions.bm25 import B, K1

_WORDS = r"regexp_extract_all(t, '([\\p{IsAlphabetic}\\p{N}]+)', 1)"
_TOKENS = f"filter(transform({_WORDS}, w -> lower(translate(w, 'Σ', 'σ'))), w -> octet_length(w) <= 256)"


def register(spark: SparkSession) -> None:
    """Temporary functions; Catalyst inlines them. Texts are taken as NFC."""
    for name, args, kind, body in (
        ("lt_tokenize", "t STRING", "ARRAY<STRING>", _TOKENS),
        ("lt_match_any", "t STRING, q STRING", "BOOLEAN", "coalesce(arrays_overlap(lt_tokenize(t), lt_tokenize(q)), false)"),
        ("lt_match_all", "t STRING, q STRING", "BOOLEAN", "coalesce(size(lt_tokenize(q)) > 0 AND size(array_except(lt_tokenize(q), lt_tokenize(t))) = 0 AND t IS NOT NULL, false)"),
        ("lt_bm25", "tf DOUBLE, dl DOUBLE, avg_dl DOUBLE, df DOUBLE, n DOUBLE", "DOUBLE", f"ln((n - df + 0.5) / (df + 0.5) + 1) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * dl / avg_dl))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")


def register_table_function(spark: SparkSession, name: str, rows, column: str = "text") -> None:
    """name(query, operator) in FROM: the rows (of a DataFrame) whose column holds any ('or') or all ('and') words of the query.

    A SQL function that Catalyst inlines: filters and columns of the statement around it reach the scan. It reads no index, so it is complete whatever is indexed.
    """
    register(spark)
    rows.createOrReplaceTempView(f"{name}_rows")
    listed = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in rows.schema.fields)
    found = ", ".join(f"d.`{c}`" for c in rows.columns)
    test = f"if({name}.operator = 'and', lt_match_all(d.`{column}`, {name}.query), lt_match_any(d.`{column}`, {name}.query))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(query STRING, operator STRING) RETURNS TABLE({listed}) RETURN SELECT {found} FROM {name}_rows d WHERE {test}")


def register_search(spark: SparkSession, name: str, hits) -> None:
    """A search result as a view, so that SQL can join, group and rank it."""
    hits.createOrReplaceTempView(name)
