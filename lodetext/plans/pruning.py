"""From an index to candidate blocks: which segments, terms and blocks a query can touch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodetext.functions.tokenizer import MAX_EXPANSIONS, Term
from lodetext.plans import query as Q


def overlaps(segment: dict, term: Term) -> bool:
    """Whether the segment's range of terms can hold the term; suffixes aren't ordered, so they always can."""
    low, high = segment["min_term"], segment["max_term"]
    if low is None or low == "":
        return segment["term_count"] != 0
    if term.kind == "suffix":
        return True
    if term.kind == "prefix":
        return term.text <= high and (low <= term.text or low.startswith(term.text))
    return low <= term.text <= high


def prune_segments(segments: list[dict], match: Q.Match) -> list[dict]:
    test = all if match.operator == "and" else any
    return [s for s in segments if match.terms and test(overlaps(s, t) for t in match.terms)]


def _term_filter(term: Term, column: str = "term"):
    return {"exact": F.col(column) == term.text, "prefix": F.col(column).startswith(term.text), "suffix": F.col(column).endswith(term.text)}[term.kind]


def standing_for(spark: SparkSession, paths: list[str], term: Term) -> DataFrame:
    """All terms of the index that a wildcard stands for, however many."""
    if term.kind == "suffix":
        found = spark.read.parquet(*[f"{p}/suffixes" for p in paths]).where(F.col("reversed").startswith(term.text[::-1]))
    else:
        found = spark.read.parquet(*[f"{p}/terms" for p in paths]).where(_term_filter(term))
    return found.select("term").distinct()


def expansions(spark: SparkSession, paths: list[str], term: Term) -> list[str]:
    """The terms of the index that a wildcard stands for; an error beyond MAX_EXPANSIONS."""
    if term.kind == "exact":
        return [term.text]
    out = [r.term for r in standing_for(spark, paths, term).limit(MAX_EXPANSIONS + 1).collect()]
    if len(out) > MAX_EXPANSIONS:
        raise ValueError(f"{term.text!r} stands for more than {MAX_EXPANSIONS} terms")
    return sorted(out)


def document_frequencies(spark: SparkSession, paths: list[str], terms: list[Term]) -> dict[Term, int]:
    """In how many indexed rows each exact term is."""
    exact = [t for t in terms if t.kind == "exact"]
    if not exact or not paths:
        return dict.fromkeys(terms, 0)
    rows = spark.read.parquet(*[f"{p}/terms" for p in paths]).where(F.col("term").isin([t.text for t in exact])).groupBy("term").agg(F.sum("df").alias("df")).collect()
    found = {r.term: r.df for r in rows}
    return {t: found.get(t.text, 0) for t in terms}


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def expanded(spark: SparkSession, root: str, segments: list[dict], match: Q.Match) -> list[list[str]]:
    """For each distinct term of a leaf the words of the segments that it stands for; prefixes come from the terms, suffixes from the reversed terms."""
    paths = [f"{root}/{s['path']}" for s in segments]
    return [expansions(spark, paths, t) if paths else [] for t in dict.fromkeys(match.terms)]


def blocks_of(found: DataFrame, term: Term) -> DataFrame:
    return found.where(_term_filter(term)).select("file", "block").distinct()


def leaf_blocks(spark: SparkSession, segments: list[dict], root: str, match: Q.Match, wide: bool = False) -> DataFrame:
    """The blocks that may hold a match of one leaf. wide: wildcards are tested on the postings, whatever number of terms they stand for, and no terms go through the driver."""
    kept = prune_segments(segments, match)
    if not kept:
        return spark.createDataFrame([], "file string, block long")
    found = spark.read.parquet(*[f"{root}/{s['path']}/postings" for s in kept])
    if wide:
        tests = [_term_filter(t) for t in dict.fromkeys(match.terms)]
        any_term = found.where(reduce(lambda a, b: a | b, tests))
    else:
        words = expanded(spark, root, kept, match)
        tests = [F.col("term").isin(group) for group in words]
        any_term = found.where(F.col("term").isin(sorted({w for group in words for w in group})))
    if match.operator == "or" or len(tests) == 1:
        return any_term.select("file", "block").distinct()
    # one pass over the postings of all terms, instead of a join for each
    each = [F.max(test.cast("int")).alias(f"h{i}") for i, test in enumerate(tests)]
    all_of = any_term.groupBy("file", "block").agg(*each)
    return all_of.where(reduce(lambda a, b: a & b, [F.col(f"h{i}") == 1 for i in range(len(tests))])).select("file", "block")


def candidate_blocks(spark: SparkSession, by_column: dict[str, list[dict]], root: str, query: Q.Query, wide: bool = False) -> DataFrame:
    if isinstance(query, Q.Match):
        return leaf_blocks(spark, by_column[query.column], root, query, wide)
    parts = [candidate_blocks(spark, by_column, root, p, wide) for p in query.parts]
    return reduce(intersect if isinstance(query, Q.And) else union, parts)


def selectivity(df: dict[Term, int], rows: int, query: Q.Query) -> float:
    """An estimate of the share of rows that match: the least of AND, the sum of OR, at most 1."""
    if not rows:
        return 0.0
    if isinstance(query, Q.Match):
        shares, all_of = [df.get(t, rows if t.kind != "exact" else 0) / rows for t in query.terms] or [0.0], query.operator == "and"
    else:
        shares, all_of = [selectivity(df, rows, p) for p in query.parts], isinstance(query, Q.And)
    return min(shares) if all_of else min(1.0, sum(shares))
