"""Text analysis: the tokenizer as a Column and in Python, and the grammar of query text."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import regex
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TOKEN_BYTES = 256
MAX_EXPANSIONS = 1024
_WORD = r"[\p{IsAlphabetic}\p{N}]+"
_QUERY_WORD = regex.compile(r"[\p{Alphabetic}\p{N}]+")


@F.pandas_udf(T.StringType())
def _nfc(text):
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@functools.lru_cache(maxsize=1)
def _unsettled() -> str:
    """A pattern of the characters that NFC can change: those it replaces, and those it can join to what stands before."""
    found = set()
    for c in range(0x300, 0x110000):
        if 0xAC00 <= c <= 0xD7A3 or 0xD800 <= c <= 0xDFFF:
            continue
        if unicodedata.normalize("NFC", chr(c)) != chr(c) or unicodedata.combining(chr(c)):
            found.add(c)
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            found.add(int(parts[1], 16))
    found |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # vowels and finals of Hangul syllables
    runs, at = [], sorted(found)
    for c in at:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def unsettled(text: Column) -> Column:
    """Whether NFC may change the text. Never for ASCII, nor for dashes, quotes and composed letters."""
    beyond = (F.octet_length(text) != F.length(text)) & text.rlike(r"[^\x00-\x{2ff}]")  # what the long pattern needs not look at
    return F.coalesce(beyond & text.rlike(_unsettled()), F.lit(False))


def normalised(text: Column) -> Column:
    """NFC. Rows pass by a Python worker, but only texts that NFC may change are sent to it."""
    return F.coalesce(_nfc(F.when(unsettled(text), text)), text)


def lowered(text: Column) -> Column:
    """Lower case character by character: a final sigma stays as any other."""
    return F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))


def _short(found: Column) -> Column:
    return F.filter(found, lambda t: F.octet_length(t) <= MAX_TOKEN_BYTES)


def _split(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1))


def settled_tokens(text: Column, low: Column | None = None) -> Column:
    """tokens() of texts that are NFC already; low: their lowered form, if at hand."""
    # one letter becomes two when it is lowered, the second of which would part words
    return _short(F.when(F.contains(text, F.lit("İ")), F.transform(_split(text), lowered)).otherwise(_split(lowered(text) if low is None else low)))


def tokens(text: Column, normalise: bool = True) -> Column:
    """Lower-case runs of letters and digits, in order and with repeats; longer than 256 bytes are left out; null stays null."""
    return settled_tokens(normalised(text) if normalise else text)


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with added columns that are computed once a row: the optimiser doesn't write a generator's expressions into what uses them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def unused_prefix(df: DataFrame) -> str:
    prefix = "_lt_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def with_tokens(df: DataFrame, columns: list[str], keep: Callable[[dict[str, Column]], Column] | None = None) -> tuple[DataFrame, dict[str, Column], list[str]]:
    """df with each column's tokens, where they are, and the names of what was added.

    Texts are lowered once and tokenised once. keep: a condition on the lowered texts that rows must fulfil, unless NFC may change one of them; it is tested
    before anything is tokenised or sent to Python.
    """
    prefix = unused_prefix(df)
    name = {c: [f"{prefix}{kind}{k}" for kind in ("low", "odd", "nfc", "tokens")] for k, c in enumerate(columns)}
    text = {c: F.col(f"`{c}`").cast("string") for c in columns}
    df = computed_once(df, {n: x for c in columns for n, x in zip(name[c][:2], (lowered(text[c]), unsettled(text[c])), strict=True)})
    if keep is not None:
        any_odd = functools.reduce(lambda a, b: a | b, [F.col(name[c][1]) for c in columns])
        df = df.where(any_odd | keep({c: F.col(name[c][0]) for c in columns}))
    df = df.withColumns({name[c][2]: _nfc(F.when(F.col(name[c][1]), text[c])) for c in columns})
    found = {name[c][3]: F.when(F.col(name[c][2]).isNotNull(), settled_tokens(F.col(name[c][2]))).otherwise(settled_tokens(text[c], F.col(name[c][0]))) for c in columns}
    df = computed_once(df, found)
    return df, {c: F.col(name[c][3]) for c in columns}, [n for c in columns for n in name[c]]


def _words(text: str) -> list[str]:
    """Split by the data's own pattern in the JVM, as its tables of characters may be of another Unicode version; in Python only while there is no JVM."""
    if SparkContext._active_spark_context is None:
        return _QUERY_WORD.findall(text)
    out, found = [], SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(_WORD).matcher(text)
    while found.find():
        out.append(found.group())
    return out


def tokenize(text: str) -> list[str]:
    """tokens() of one text, for queries."""
    found = ("".join(c.lower() for c in w) for w in _words(unicodedata.normalize("NFC", text)))
    return [t for t in found if len(t.encode()) <= MAX_TOKEN_BYTES]


#: Tokenizers by the name that table metadata keeps.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"lowercase_words": tokens}


@dataclass(frozen=True)
class Term:
    """A token to match: exactly, as a prefix or as a suffix."""

    text: str
    kind: str = "exact"


def parse_terms(text: str) -> list[Term]:
    """Query text to terms. `*` stands only as the first or last character of an atom whose rest is exactly one token."""
    out = []
    for atom in re.split(r"\s+", text.strip()):
        if "*" not in atom:
            out += [Term(t) for t in tokenize(atom)]
            continue
        body = atom.strip("*")
        if atom.count("*") != 1 or "*" in body or (words := tokenize(body)) and len(words) != 1 or not words:
            raise ValueError(f"a wildcard is one leading or trailing * on a single word: {atom!r}")
        out.append(Term(words[0], "prefix" if atom.endswith("*") else "suffix"))
    return out


def holds(found: Column, term: Term) -> Column:
    """Whether an array of tokens holds the term."""
    if term.kind == "exact":
        return F.array_contains(found, term.text)
    test = (lambda t: t.startswith(term.text)) if term.kind == "prefix" else (lambda t: t.endswith(term.text))
    return F.exists(found, test)


def occurrences(found: Column, term: Term) -> Column:
    """How often it does."""
    if term.kind == "exact":
        return F.size(found) - F.size(F.array_remove(found, term.text))
    test = (lambda t: t.startswith(term.text)) if term.kind == "prefix" else (lambda t: t.endswith(term.text))
    return F.size(F.filter(found, test))
