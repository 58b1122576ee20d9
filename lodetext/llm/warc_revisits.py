"""Resolution of not-modified revisits in a web archive, as an as-of join.

A revisit record (status 304) has headers but no body. It is resolved to the latest earlier full response of the same canonical URL; their validators are checked (entity tags, or
dates of last modification where a tag is missing on either side), and the stored headers are brought up to date with those that a 304 may change.

The as-of join is made by time slices: within each (URL, slice) by a window, and from earlier slices by the last full response of each. A URL that holds a third of all
records is so dealt over SLICES tasks, and only one row a URL and slice is carried on.

Statuses: resolved; mismatch (validators differ); unchecked (neither side's validators can be compared); missing (no earlier full response, or no URL). A response at the very time of a revisit isn't earlier;
of responses at one time the larger record_id counts. Null times are treated as a missing response or revisit without match. Null headers are empty. Repeated rows give repeated rows. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodetext.llm import shared

SLICES = 128
#: Query parameters that don't identify a page.
TRACKING = r"^(ref|fbclid|gclid|sid|sessionid|phpsessid|utm_[^=]*)(=.*)?$"
#: Stored headers that a not-modified response may not replace: they describe the body.
KEPT = ("content-length", "content-type", "content-encoding", "content-range", "transfer-encoding", "content-location")
#: Captures between a page and its revisit in the query below.
LAG = 60


def canonical_url(url: F.Column) -> F.Column:
    """Without fragment, tracking parameters, default port, `www.` or `m.` host prefix; scheme and host lowered, parameters sorted."""
    whole = F.regexp_replace(F.trim(url), r"#.*$", "")
    origin = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0)), r"^(http://.*):80$|^(https://.*):443$", "$1$2"), r"://(www|m)\.", "://")
    rest = F.regexp_replace(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path = F.regexp_extract(rest, r"^[^?]*", 0)
    query = F.regexp_replace(F.regexp_extract(rest, r"\?.*$", 0), r"^\?", "")
    params = F.sort_array(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("(?i)" + TRACKING)))
    return F.concat(origin, F.when(path == "", "/").otherwise(path), F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def merged_headers(stored: F.Column, update: F.Column) -> F.Column:
    """Names are lowered already. The stored headers, with those of the 304 that don't describe a body."""
    fresh = F.map_filter(update, lambda k, v: ~k.isin(*KEPT))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)


def resolve(captures: DataFrame, slices: int | None = None) -> DataFrame:
    """For captures (record_id, url, ts, full, etag, last_modified, headers): a row for each that isn't full. slices: by default as many as there are shuffle partitions, SLICES at least."""
    slices = slices or max(SLICES, shared.partitions(captures.sparkSession))
    none = F.create_map().cast("map<string,string>")
    rows = captures.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("canonical"), F.col("ts").cast("long").alias("ts"), F.coalesce("full", F.lit(False)).alias("full"),
        F.col("etag"), F.col("last_modified"), F.coalesce("headers", none).alias("headers"),
    )
    cuts = rows.agg(F.percentile_approx("ts", [k / slices for k in range(1, slices)], 10_000)).first()[0] or []
    marks = F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<bigint>")
    rows = rows.withColumn("slice", F.coalesce(F.size(F.filter(marks, lambda c: c <= F.col("ts"))), F.lit(0)))
    stored = F.struct("ts", "record_id", "etag", "last_modified", F.map_entries("headers").alias("headers"))
    # urls and times that are null match nothing; they are dealt by their record
    spread = F.when(F.col("canonical").isNull() | F.col("ts").isNull(), F.col("record_id"))
    rows = rows.withColumn("hit", F.when(F.col("full") & F.col("canonical").isNotNull() & F.col("ts").isNotNull(), stored)).withColumn("spread", spread)
    within = Window.partitionBy("canonical", "slice", "spread").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max("hit").over(within)).where("not full").drop("hit")
    last = rows.where("hit is not null").groupBy("canonical", "slice").agg(F.max("hit").alias("hit"))
    # slices of a URL that hold revisits get the last full response of an earlier slice
    needs = near.where("near is null and canonical is not null and ts is not null").select("canonical", "slice").distinct()
    carried = (
        needs.withColumn("hit", F.lit(None).cast(last.schema["hit"].dataType)).withColumn("asks", F.lit(True)).unionByName(last.withColumn("asks", F.lit(False)))
        .withColumn("far", F.max("hit").over(Window.partitionBy("canonical").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)))
        .where("asks and far is not null").select("canonical", "slice", "far")
    )
    got = near.join(carried, ["canonical", "slice"], "left").withColumn("hit", F.when(F.col("ts").isNotNull(), F.coalesce("near", "far")))
    tags, dates = F.col("etag") == F.col("hit.etag"), F.col("last_modified") == F.col("hit.last_modified")
    same = F.coalesce(tags, dates)
    status = F.when(F.col("hit").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    usable = status.isin("resolved", "unchecked")
    return got.select(
        "record_id", F.col("canonical").alias("canonical_url"), status.alias("status"), F.col("hit.record_id").alias("response_id"),
        F.when(usable, merged_headers(F.map_from_entries("hit.headers"), F.col("headers"))).alias("headers"),
    )


def captures_of_pages(pages: DataFrame, lag: int = LAG) -> DataFrame:
    """A capture log of `pages`: each page once as a full response, and once as a not-modified revisit `lag` captures later."""
    tag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", tag.alias("etag"), F.octet_length("html").cast("string").alias("size"))
    header = lambda *kv: F.map_filter(F.create_map(*[x if isinstance(x, F.Column) else F.lit(x) for x in kv]), lambda k, v: v.isNotNull())
    full = page.select((2 * F.col("page_id")).alias("record_id"), "url", (2 * F.col("page_id")).alias("ts"), F.lit(True).alias("full"), "etag", F.lit(None).cast("string").alias("last_modified"),
                       header("content-type", "text/html", "content-length", F.col("size"), "etag", F.col("etag"), "age", "0").alias("headers"))
    again = page.select((2 * F.col("page_id") + 1).alias("record_id"), "url", (2 * (F.col("page_id") + lag) + 1).alias("ts"), F.lit(False).alias("full"), "etag", F.lit(None).cast("string").alias("last_modified"),
                        header("content-length", "0", "etag", F.col("etag"), "age", F.col("page_id").cast("string")).alias("headers"))
    return full.unionByName(again)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(captures_of_pages(shared.table(spark, sf_dir, "pages")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return found.select("record_id", "canonical_url", "status", "response_id", lines.alias("headers"))


ORACLE = rf"""
WITH p AS (
  SELECT page_id, '"' || md5(html) || '"' AS etag, strlen(html) AS size, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')), '^(http://.*):80$|^(https://.*):443$', '\1\2'), '://(www|m)\.', '://') AS origin,
         regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS rest FROM p),
d AS (
  SELECT *, regexp_extract(rest, '^[^?]*') AS path,
         list_sort(list_filter(string_split(regexp_replace(regexp_extract(rest, '\?.*$'), '^\?', ''), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i){TRACKING}'))) AS params FROM c),
k AS (
  SELECT page_id, etag, size, origin || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical FROM d),
r AS (SELECT 2 * page_id + 1 AS record_id, 2 * (page_id + {LAG}) + 1 AS ts, page_id, etag, canonical FROM k),
f AS (SELECT 2 * page_id AS response_id, 2 * page_id AS ts, etag AS stored, canonical, size FROM k)
SELECT r.record_id, r.canonical AS canonical_url,
       CASE WHEN f.response_id IS NULL THEN 'missing' WHEN r.etag = f.stored THEN 'resolved' WHEN r.etag <> f.stored THEN 'mismatch' ELSE 'unchecked' END AS status, f.response_id,
       CASE WHEN r.etag = f.stored THEN 'age: ' || r.page_id || chr(10) || 'content-length: ' || f.size || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || r.etag END AS headers
FROM r ASOF LEFT JOIN f ON r.canonical = f.canonical AND r.ts > f.ts
"""
