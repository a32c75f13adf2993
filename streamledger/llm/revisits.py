"""WARC: resolution of not-modified revisits.

A revisit record (HTTP 304, or an identical payload digest) has no body. Its content is that of the latest full response
captured strictly earlier under the same canonical URL, if the validators agree; the revisit's headers then
update the stored ones, except those that describe the payload or the connection (as a cache does on a 304).

The as-of join is a window over a URL's captures in order of time. URLs with more than a thousandth of all records are cut into
time ranges first; a range's first captures get the last response of the ranges before it, so a URL that
holds a third of all records is many windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize

#: Header fields that a 304 doesn't update.
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-location", "content-md5", "content-range", "content-type", "etag",
    "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
TRACKING = "^(utm_[^=]*|gclid|fbclid)(=.*)?$"
RANGES = 256
HOT_LEAST = 10_000


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without a last slash, query sorted and without tracking
    parameters; no scheme, user or fragment. Null and blank stay null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#[^\\n]*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_extract(bare, "^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(path, "/+$", "")
    query = F.regexp_extract(bare, "^[^?]*[?]([^\\n]*)$", 1)
    parts = F.array_sort(F.filter(F.split(query, "&", -1), lambda x: (x != "") & ~x.rlike(TRACKING)))
    joined = F.array_join(parts, "&")
    full = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))
    return F.when(F.trim(url) != "", full)


def header_map(headers: Column) -> Column:
    """Names in lower case; of names that differ in case only the last value stays; null: empty."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(record_id, url_key, response_id, outcome, headers, body) of every revisit in ``records``.

    ``records`` has record_id, kind ('response' or 'revisit'; others are ignored), url, ts (long), status, headers (map of strings),
    digest (of the payload) and body. Full responses have status 200 and a time. outcome: 'resolved'; 'unchecked' (resolved, but
    the revisit has no validator); 'changed' (ETag, else Last-Modified, else digest disagrees: no content); 'no_capture' (no
    earlier full response, or no url or time). ETags are compared weakly; a validator that only the revisit has
    disagrees. Of responses at one time the greatest record_id counts. Rows that repeat are resolved one by one. Bodies of any length come
    whole. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    rows = records.where("kind = 'response' AND status = 200 AND ts IS NOT NULL OR kind = 'revisit'").select(
        "record_id", F.col("kind") == "response", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), header_map(F.col("headers")).alias("headers"), "digest", "body"
    ).toDF("record_id", "full", "url_key", "ts", "headers", "digest", "body")
    rows = rows.where("NOT full OR url_key IS NOT NULL")
    lost = rows.where("NOT full AND (url_key IS NULL OR ts IS NULL)")
    rows = rows.where("url_key IS NOT NULL AND ts IS NOT NULL")
    counts = materialize(rows.groupBy("url_key").agg(F.count("*").alias("n")), "url-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(HOT_LEAST, total // 1000)).select("url_key", F.lit(True).alias("hot"))  # under 1000 rows
    hot_rows = bool(hot.take(1))
    if hot_rows:  # the times at which each hot url is cut are its own: a crawl may visit it in one burst
        at = F.percentile_approx("ts", [i / RANGES for i in range(1, RANGES)], 10000).alias("cuts")
        cuts = materialize(rows.join(F.broadcast(hot), "url_key").groupBy("url_key").agg(at), "url-cuts")
        before = F.filter(F.coalesce("cuts", F.array().cast("array<bigint>")), lambda x: x < F.col("ts"))
        rows = rows.join(F.broadcast(cuts), "url_key", "left").withColumn("range", F.size(before)).drop("cuts")
    else:
        rows = rows.withColumn("range", F.lit(0))
    answer = F.struct("record_id", "headers", "digest", "body")
    window = Window.partitionBy("url_key", "range").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.withColumn("found", F.last(F.when(F.col("full"), answer), ignorenulls=True).over(window)).where("NOT full")
    if hot_rows:
        split = rows.where("full").join(F.broadcast(hot.select("url_key")), "url_key")
        heads = split.groupBy("url_key", "range").agg(F.max_by(answer, F.struct("ts", "record_id")).alias("last"))
        every = met.select("url_key", "range").distinct().join(F.broadcast(hot.select("url_key")), "url_key")
        steps = heads.join(every, ["url_key", "range"], "full")
        before = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
        steps = steps.withColumn("earlier", F.last("last", ignorenulls=True).over(before)).where("earlier IS NOT NULL").select("url_key", "range", "earlier")
        met = met.join(steps, ["url_key", "range"], "left").withColumn("found", F.coalesce("found", "earlier")).drop("earlier")
    met = met.drop("range").unionByName(lost.withColumn("found", F.lit(None).cast(met.schema["found"].dataType)))
    mine, theirs = F.col("headers"), F.col("found.headers")
    tag, date = F.element_at(mine, "etag"), F.element_at(mine, "last-modified")
    agrees = F.when(tag.isNotNull(), F.coalesce(_weak(tag) == _weak(F.element_at(theirs, "etag")), F.lit(False))).when(date.isNotNull(), F.coalesce(date == F.element_at(theirs, "last-modified"), F.lit(False))).when(F.col("digest").isNotNull(), F.coalesce(F.col("digest") == F.col("found.digest"), F.lit(False)))
    outcome = F.when(F.col("found").isNull(), "no_capture").when(agrees.isNull(), "unchecked").when(agrees, "resolved").otherwise("changed")
    update = F.map_filter(mine, lambda k, v: ~k.isin(*NOT_MERGED))
    stay = F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(update), k))
    good = outcome.isin("resolved", "unchecked")
    return met.select("record_id", "url_key", F.col("found.record_id").alias("response_id"), outcome.alias("outcome"), F.when(good, F.map_concat(stay, update)).alias("headers"), F.when(good, F.col("found.body")).alias("body"))


DAY = 86_400_000


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl of ``pages``: each page as a full response, revisited later; every eleventh also before.

    Validators follow from the page: every fifth revisit shows another ETag, every seventh only a date, every thirteenth only a digest.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    p, i = pages.where("page_id IS NOT NULL"), F.col("page_id")
    at = i * 60_000
    modified = F.concat(F.lit("day "), F.floor(i / 100).cast("string"))
    digest = F.sha1("html")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    full = p.select((i * 3).alias("record_id"), F.lit("response").alias("kind"), "url", at.alias("ts"), F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), text(tag), F.lit("Last-Modified"), text(modified), F.lit("Content-Length"), text(F.octet_length("html")), F.lit("Date"), text(at), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"), digest.alias("digest"), F.col("html").alias("body"))
    later = at + DAY * (1 + i % 3)
    shown = F.when(i % 13 == 0, F.create_map(F.lit("date"), text(later))).when(i % 7 == 0, F.create_map(F.lit("Last-Modified"), text(modified), F.lit("date"), text(later), F.lit("Content-Length"), F.lit("0")))
    shown = shown.otherwise(F.create_map(F.lit("ETAG"), F.when(i % 5 == 0, '"other"').otherwise(F.concat(F.lit("W/"), text(tag))), F.lit("date"), text(later), F.lit("cache-control"), F.lit("max-age=90"), F.lit("content-length"), F.lit("0")))
    visit = lambda number, when: p.select((i * 3 + number).alias("record_id"), F.lit("revisit").alias("kind"), "url", when.alias("ts"), F.lit(304).alias("status"), shown.alias("headers"), F.when(i % 13 == 0, digest).alias("digest"), F.lit(None).cast("string").alias("body"))
    return full.union(visit(1, later)).union(visit(2, at - 1).where("(record_id - 2) % 33 = 0"))


def op3_warc_revisits(spark, sf_dir: str) -> DataFrame:
    """Every revisit of a crawl of all pages, resolved."""
    out = resolve_revisits(crawl_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    field = lambda n: F.element_at("headers", n)
    return out.select("record_id", "url_key", "response_id", "outcome", field("etag").alias("etag"), field("last-modified").alias("last_modified"), field("content-length").alias("content_length"), field("date").alias("date"), field("cache-control").alias("cache_control"), F.md5("body").alias("body_md5"))


OP3_SQL = rf"""
WITH b AS (SELECT page_id AS i, html, url,
    regexp_replace(regexp_replace(trim(url), '#[^\n]*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages WHERE page_id IS NOT NULL),
h AS (SELECT i, html, bare,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^[^@]*@', ''), '^www[.]', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*[?]([^\n]*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))), '&') AS q FROM b),
k AS (SELECT i, html, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url_key,
    '"' || substr(md5(html), 1, 16) || '"' AS tag, 'day ' || CAST(i // 100 AS VARCHAR) AS modified FROM h),
r AS (SELECT i * 3 AS id, i, url_key, i * 60000 AS ts, tag, modified, html, CAST(strlen(html) AS VARCHAR) AS size, sha1(html) AS digest FROM k),
v AS (SELECT i * 3 + 1 AS id, i, url_key, i * 60000 + {DAY} * (1 + i % 3) AS ts, i * 60000 + {DAY} * (1 + i % 3) AS shown, tag, modified, html FROM k
  UNION ALL SELECT i * 3 + 2, i, url_key, i * 60000 - 1, i * 60000 + {DAY} * (1 + i % 3), tag, modified, html FROM k WHERE i % 11 = 0),
e AS (SELECT id, i, url_key, ts, shown,
    CASE WHEN i % 13 = 0 OR i % 7 = 0 THEN NULL WHEN i % 5 = 0 THEN '"other"' ELSE tag END AS etag,
    CASE WHEN i % 13 <> 0 AND i % 7 = 0 THEN modified END AS modified,
    CASE WHEN i % 13 = 0 THEN sha1(html) END AS digest,
    CASE WHEN i % 13 = 0 OR i % 7 = 0 THEN NULL ELSE 'max-age=90' END AS cache FROM v),
m AS (SELECT e.*, r.id AS rid, r.tag AS rtag, r.modified AS rmod, r.size AS rsize, r.html AS rhtml, r.digest AS rdig,
    row_number() OVER (PARTITION BY e.id ORDER BY r.ts DESC NULLS LAST, r.id DESC NULLS LAST) AS n
  FROM e LEFT JOIN r ON e.url_key = r.url_key AND r.ts < e.ts),
o AS (SELECT *, CASE WHEN rid IS NULL THEN 'no_capture'
    WHEN etag IS NOT NULL THEN CASE WHEN etag = rtag THEN 'resolved' ELSE 'changed' END
    WHEN modified IS NOT NULL THEN CASE WHEN modified = rmod THEN 'resolved' ELSE 'changed' END
    WHEN digest IS NOT NULL THEN CASE WHEN digest = rdig THEN 'resolved' ELSE 'changed' END ELSE 'unchecked' END AS outcome
  FROM m WHERE n = 1)
SELECT id AS record_id, url_key, rid AS response_id, outcome,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN rtag END AS etag,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN coalesce(modified, rmod) END AS last_modified,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN rsize END AS content_length,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN CAST(shown AS VARCHAR) END AS date,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN coalesce(cache, 'max-age=60') END AS cache_control,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN md5(rhtml) END AS body_md5
FROM o
"""
