"""Search expressions: a tree of and/or over matches of one column each."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodetext.functions.tokenizer import Term, holds, parse_terms

OPERATORS = ("or", "and")


@dataclass(frozen=True)
class Match:
    """Rows whose column holds any (`or`) or all (`and`) terms of the text."""

    column: str
    text: str
    operator: str = "or"

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise ValueError(f"operator must be one of {OPERATORS}: {self.operator!r}")
        parse_terms(self.text)

    @property
    def terms(self) -> list[Term]:
        return parse_terms(self.text)


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


Query = Match | And | Or


def match_text(column: str, text: str, operator: str = "or") -> Match:
    return Match(column, text, operator)


def multi_column(columns: list[str], text: str, operator: str = "or", across: str = "or") -> Query:
    """One text over several columns."""
    parts = tuple(Match(c, text, operator) for c in columns)
    return parts[0] if len(parts) == 1 else (And if across == "and" else Or)(parts)


def from_json(value: dict) -> Query:
    """{"column", "match", "operator"?}, {"and": [...]} or {"or": [...]}."""
    if not isinstance(value, dict):
        raise ValueError(f"a search expression is an object: {value!r}")
    if "not" in value or "regex" in value:
        raise ValueError("NOT and regular expressions aren't supported")
    for name, kind in (("and", And), ("or", Or)):
        if name in value:
            if set(value) != {name} or not isinstance(value[name], list) or not value[name]:
                raise ValueError(f"{name!r} takes an array that isn't empty, and nothing beside it")
            return kind(tuple(from_json(x) for x in value[name]))
    if extra := set(value) - {"column", "match", "operator"}:
        raise ValueError(f"unknown keys: {sorted(extra)}")
    if not isinstance(value.get("column"), str) or not isinstance(value.get("match"), str):
        raise ValueError("a match needs a column and a text")
    return Match(value["column"], value["match"], value.get("operator", "or"))


def leaves(query: Query) -> Iterator[Match]:
    if isinstance(query, Match):
        yield query
    else:
        for part in query.parts:
            yield from leaves(part)


def columns(query: Query) -> list[str]:
    return list(dict.fromkeys(m.column for m in leaves(query)))


def fold(parts: list[Column], all_of: bool) -> Column:
    return reduce(lambda a, b: a & b if all_of else a | b, parts) if parts else F.lit(False)


def leaf_condition(match: Match, tokens: Column) -> Column:
    return fold([holds(tokens, t) for t in match.terms], match.operator == "and")


def condition(query: Query, tokens: dict[str, Column]) -> Column:
    """Whether a row matches, given each column's tokens. Null texts never match."""
    if isinstance(query, Match):
        return F.coalesce(leaf_condition(query, tokens[query.column]), F.lit(False))
    return fold([condition(p, tokens) for p in query.parts], isinstance(query, And))


def prefilter(query: Query, low: dict[str, Column]) -> Column:
    """A cheap condition that every match fulfils: the terms as substrings of the lowered texts, before anything is tokenised."""
    if isinstance(query, Match):
        return F.coalesce(fold([F.contains(low[query.column], F.lit(t.text)) for t in query.terms], query.operator == "and"), F.lit(False))
    return fold([prefilter(p, low) for p in query.parts], isinstance(query, And))
