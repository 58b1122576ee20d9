"""Search without an index: the plain form, and the one by which all others are checked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodetext.functions import bm25
from lodetext.functions.tokenizer import Term, computed_once, holds, occurrences, unused_prefix, with_tokens
from lodetext.plans import query as Q


@dataclass(frozen=True)
class ColumnStats:
    """Corpus statistics of one column: rows, tokens, and how many rows hold each term."""

    rows: int
    tokens: int
    df: dict[Term, int]

    def plus(self, other: ColumnStats) -> ColumnStats:
        return ColumnStats(self.rows + other.rows, self.tokens + other.tokens, {t: self.df.get(t, 0) + other.df.get(t, 0) for t in {*self.df, *other.df}})


def wanted_terms(query: Q.Query) -> dict[str, list[Term]]:
    """Each column's distinct terms."""
    out: dict[str, list[Term]] = {}
    for m in Q.leaves(query):
        out.setdefault(m.column, [])
        out[m.column] += [t for t in m.terms if t not in out[m.column]]
    return out


def collect_stats(df: DataFrame, terms: dict[str, list[Term]]) -> dict[str, ColumnStats]:
    """One aggregate over df for all columns and terms."""
    aggs = [F.count(F.lit(1)).alias("n")]
    df, by_column, _ = with_tokens(df.select(*[F.col(f"`{c}`") for c in terms]), list(terms))
    for i, (column, wanted) in enumerate(terms.items()):
        found = by_column[column]
        aggs.append(F.sum(F.coalesce(F.size(found), F.lit(0))).alias(f"t{i}"))
        aggs += [F.sum(F.coalesce(holds(found, t), F.lit(False)).cast("long")).alias(f"d{i}_{j}") for j, t in enumerate(wanted)]
    r = df.agg(*aggs).first()
    return {c: ColumnStats(r.n, r[f"t{i}"] or 0, {t: r[f"d{i}_{j}"] or 0 for j, t in enumerate(w)}) for i, (c, w) in enumerate(terms.items())}


def scored(rows: DataFrame, query: Q.Query, found: dict[str, Column], stats: dict[str, ColumnStats]) -> DataFrame:
    """Matching rows with score: the sum over matching leaves of the BM25 scores of their terms; a repeated term counts each time. Each term is counted once a row."""
    prefix = unused_prefix(rows)
    places = {(c, t): f"{prefix}tf{k}" for k, (c, t) in enumerate((c, t) for c, wanted in wanted_terms(query).items() for t in wanted)}
    counted = computed_once(rows, {n: occurrences(found[c], t) for (c, t), n in places.items()}) if places else rows
    total = F.lit(0.0)
    for m in Q.leaves(query):
        s = stats[m.column]
        average = bm25.average_length(s.tokens, s.rows)
        length = F.size(found[m.column])
        leaf = F.lit(0.0)
        for t in m.terms:
            leaf = leaf + bm25.score_column(F.col(places[m.column, t]), length, average, s.df.get(t, 0), s.rows)
        holding = [F.coalesce(F.col(places[m.column, t]) > 0, F.lit(False)) for t in m.terms]
        total = total + F.when(Q.fold(holding, m.operator == "and"), leaf).otherwise(F.lit(0.0))
    return counted.withColumn("score", total).drop(*places.values())


def matches(df: DataFrame, query: Q.Query, stats: dict[str, ColumnStats] | None = None) -> DataFrame:
    """The matching rows of df; with statistics, and their score."""
    rows, found, added = with_tokens(df, Q.columns(query), lambda low: Q.prefilter(query, low))
    hits = rows.where(Q.condition(query, found))
    return (hits if stats is None else scored(hits, query, found, stats)).drop(*added)


def search(df: DataFrame, query: Q.Query, scored: bool = False, stats: dict[str, ColumnStats] | None = None) -> DataFrame:
    if scored and stats is None:
        stats = collect_stats(df, wanted_terms(query))
    return matches(df, query, stats if scored else None)


def top(hits: DataFrame, limit: int | None, *ties: str) -> DataFrame:
    """Best first, nulls last, ties in the order of the given columns."""
    ordered = hits.orderBy(F.desc_nulls_last("score"), *ties)
    return ordered if limit is None else ordered.limit(limit)


def hits_by(hits: DataFrame, *keys: str) -> DataFrame:
    return hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))


def hit_share(hits: DataFrame, everything: DataFrame, key: str) -> DataFrame:
    """Each key's rows, hits and the share of hits; keys without hits as well."""
    totals = everything.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    return totals.join(hits_by(hits, key), key, "left").select(key, "total", F.coalesce("hits", F.lit(0)).alias("hits"), F.round(F.coalesce("hits", F.lit(0)) / F.col("total"), 6).alias("share"))
