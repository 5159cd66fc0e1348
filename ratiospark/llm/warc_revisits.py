"""Revisit records of web archives resolved to the full responses they confirm.

A "not modified" revisit has no body: it stands for the latest earlier full
response at the same canonical URL.  That as-of join runs on distinct moments of a
URL, cut into stretches of time with about as many rows each, so that a URL with
a large share of all captures is spread over tasks: within a stretch a window
finds the latest earlier response, and what an earlier stretch hands on comes from
one row for each URL and stretch.  Validators decide whether the response is the
one confirmed; then the revisit's permitted headers replace the stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratiospark.llm.workspace import Workspace

#: Header fields a 304 response may renew.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that name a visit, not a page.
TRACKING = r"^(utm_[^=]*|fbclid|gclid|sessionid|phpsessid|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host without www and default port, path without its last slash, sorted query without tracking; null stays null."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www[0-9]*\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(""))


def _entries(headers: Column) -> Column:
    """Header fields with names in lower case; of names that differ in case only, the first."""
    lower = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.filter(lower, lambda e, i: F.array_position(F.transform(lower, lambda x: x["key"]), e["key"]) == i + 1)


def _field(entries: str, name: str) -> Column:
    return F.get(F.filter(F.col(entries), lambda e: e["key"] == name), F.lit(0))["value"]


def latest_earlier(work: Workspace, probes: DataFrame, points: DataFrame, rows_each: int = 20_000, most_stretches: int = 10_000) -> DataFrame:
    """(key, ts, point_ts) for the distinct (key, ts) of ``probes``: the greatest ts of ``points`` at the key before it, null if none.

    Stretches are ranges of time, dealt out by Spark's range partitioning, and numbered by their partition.
    """
    both = work.save(probes.select("key", "ts", F.lit(0).alias("point")).unionByName(points.select("key", "ts", F.lit(1).alias("point"))).distinct())
    n = min(most_stretches, max(1, both.saved_rows // rows_each))
    both = work.save(both.repartitionByRange(n, "ts").withColumn("stretch", F.spark_partition_id()))
    within = Window.partitionBy("key", "stretch").orderBy("ts", "point").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("here", F.last(F.when(F.col("point") == 1, F.col("ts")), ignorenulls=True).over(within)).where("point = 0").drop("point")
    tops = both.groupBy("key", "stretch").agg(F.max(F.when(F.col("point") == 1, F.col("ts"))).alias("top"))
    before = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    handed = tops.withColumn("handed", F.last("top", ignorenulls=True).over(before)).where("handed IS NOT NULL").select("key", "stretch", "handed")
    return found.join(handed, ["key", "stretch"], "left").select("key", "ts", F.coalesce("here", "handed").alias("point_ts"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records`` (record_id, url, ts long, kind, status, headers map, digest).

    Columns: record_id, url_key, ts, source_id, outcome, headers (merged, names in
    lower case), digest (the source's).  ``outcome`` is "resolved"; "mismatch" if
    entity tags (compared weakly) or, without two of them, modification dates
    differ; "unverified" if the records share no validator; "no_response" if no
    full response (kind "response", status 200) is earlier.  Headers and digest
    are given for resolved ones only.  Of responses at one moment the greatest
    record_id counts; a response at the revisit's own moment is not earlier.
    Revisits with a null URL or time find no response; records of other kinds or a
    null one are left out; repeated rows are each returned, and bodies and other
    columns are not read.
    """
    work = Workspace(records.sparkSession)
    rows = records.select(F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("key"), F.col("ts").cast("long").alias("ts"), "kind", "status", _entries(F.col("headers")).alias("entries"), "digest")
    full = rows.where("kind = 'response' AND status = 200 AND key IS NOT NULL AND ts IS NOT NULL")
    points = work.save(full.groupBy("key", "ts").agg(F.max_by(F.struct("record_id", "entries", "digest"), F.coalesce("record_id", F.lit(-1))).alias("source")))
    revisits = work.save(rows.where("kind = 'revisit'").select("record_id", "key", "ts", "entries"))
    when = work.save(latest_earlier(work, revisits.where("key IS NOT NULL AND ts IS NOT NULL"), points).where("point_ts IS NOT NULL"))
    sources = when.join(points.withColumnRenamed("ts", "point_ts"), ["key", "point_ts"]).select("key", "ts", "source.*").toDF("key", "ts", "source_id", "stored", "source_digest")
    joined = revisits.join(work.save(sources), ["key", "ts"], "left")
    tags = [F.regexp_replace(_field(e, "etag"), "^W/", "") for e in ("stored", "entries")]
    dates = [_field(e, "last-modified") for e in ("stored", "entries")]
    outcome = (
        F.when(F.col("stored").isNull(), "no_response")
        .when(tags[0].isNotNull() & tags[1].isNotNull(), F.when(tags[0] == tags[1], "resolved").otherwise("mismatch"))
        .when(dates[0].isNotNull() & dates[1].isNotNull(), F.when(dates[0] == dates[1], "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    new = F.filter("entries", lambda e: e["key"].isin(*PERMITTED))
    kept = F.filter("stored", lambda e: ~F.exists(new, lambda x: x["key"] == e["key"]))
    merged = F.map_from_entries(F.array_sort(F.concat(kept, new)))
    resolved = F.col("outcome") == "resolved"
    return joined.withColumn("outcome", outcome).select("record_id", F.col("key").alias("url_key"), "ts", "source_id", "outcome", F.when(resolved, merged).alias("headers"), F.when(resolved, F.col("source_digest")).alias("digest"))


def page_records(pages: DataFrame) -> DataFrame:
    """Captures made of the pages: three requests of each that were answered in full, and three revisits among them.

    Every seventh answer is a 404, and every third page changes from capture to
    capture, so the latest earlier answer is often not the one to resolve to, or
    not the one confirmed; the second revisit falls on the moment of the third
    answer.  A revisit confirms the content of its time by a weak entity tag, but
    for each tenth page, which has another tag, and each tenth after it, which has
    none.
    """
    html = F.coalesce("html", F.lit(""))

    def times(name: str) -> DataFrame:
        """The pages three times, with the content's version then, its tag and size."""
        rows = pages.select("page_id", "url", html.alias("html"), F.explode(F.array(*map(F.lit, range(3)))).alias(name))
        rows = rows.withColumn("version", F.when(F.col("page_id") % 3 == 0, F.col(name)).otherwise(0))
        tag = F.concat(F.lit('"'), F.md5(F.concat("html", F.repeat(F.lit(" "), F.col("version")))), F.lit('"'))
        return rows.select("page_id", "url", name, tag.alias("tag"), (F.length("html") + F.col("version")).cast("string").alias("size"))

    answers = times("capture").withColumn("ts", F.col("page_id") * 3600 + F.col("capture") * 100_000)
    response = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("size"), F.lit("ETag"), F.col("tag"), F.lit("Date"), F.col("ts").cast("string"), F.lit("Server"), F.lit("archive"))
    status = F.when((F.col("page_id") + F.col("capture")) % 7 == 3, 404).otherwise(200)
    responses = answers.select((F.col("page_id") * 8 + F.col("capture")).alias("record_id"), "url", "ts", F.lit("response").alias("kind"), status.alias("status"), response.alias("headers"), F.col("tag").alias("digest"))
    later = F.col("page_id") * 3600 + F.get(F.array(F.lit(50_000), F.lit(200_000), F.lit(300_000)), F.col("visit"))
    visits = times("visit").withColumn("ts", later)
    other = F.col("page_id") % 10
    confirm = F.when(other == 8, F.lit('"other"')).when(other != 9, F.concat(F.lit("W/"), F.col("tag")))
    revisit = F.map_filter(F.create_map(F.lit("etag"), confirm, F.lit("Date"), F.col("ts").cast("string"), F.lit("Expires"), (F.col("ts") + 600).cast("string"), F.lit("Content-Length"), F.lit("0"), F.lit("Server"), F.lit("edge")), lambda k, v: v.isNotNull())
    revisits = visits.select((F.col("page_id") * 8 + 4 + F.col("visit")).alias("record_id"), "url", "ts", F.lit("revisit").alias("kind"), F.lit(304).alias("status"), revisit.alias("headers"), F.lit(None).cast("string").alias("digest"))
    return responses.unionByName(revisits)


#: ``resolve_revisits`` over ``page_records`` in DuckDB's SQL; headers as sorted lines.
REVISITS_SQL = r"""
    WITH base AS (
        SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
        FROM pages),
    split AS (
        SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '')
                  || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
               list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'),
                   lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|fbclid|gclid|sessionid|phpsessid|ref)(=|$)'))) AS query
        FROM base),
    keyed AS (
        SELECT page_id, place || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS key, i,
               '"' || md5(html || repeat(' ', CASE WHEN page_id % 3 = 0 THEN i ELSE 0 END)) || '"' AS tag, length(html) + CASE WHEN page_id % 3 = 0 THEN i ELSE 0 END AS size
        FROM split, range(0, 3) t(i)),
    answers AS (SELECT page_id * 8 + i AS id, key, page_id * 3600 + i * 100000 AS ts, tag, size FROM keyed WHERE (page_id + i) % 7 <> 3),
    points AS (SELECT key, ts, max(id) AS id FROM answers GROUP BY ALL),
    revisits AS (
        SELECT page_id * 8 + 4 + i AS record_id, key, page_id * 3600 + [50000, 200000, 300000][i + 1] AS at, CASE page_id % 10 WHEN 8 THEN '"other"' WHEN 9 THEN NULL ELSE tag END AS confirm
        FROM keyed),
    found AS (SELECT r.*, p.id FROM revisits r ASOF LEFT JOIN points p ON r.key = p.key AND r.at > p.ts)
    SELECT f.record_id, f.key AS url_key, f.at AS ts, f.id AS source_id,
           CASE WHEN f.id IS NULL THEN 'no_response' WHEN f.confirm IS NULL THEN 'unverified' WHEN f.confirm = s.tag THEN 'resolved' ELSE 'mismatch' END AS outcome,
           CASE WHEN f.confirm = s.tag THEN 'content-length: ' || s.size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || f.at || chr(10)
               || 'etag: W/' || f.confirm || chr(10) || 'expires: ' || (f.at + 600) || chr(10) || 'server: archive' END AS headers,
           CASE WHEN f.confirm = s.tag THEN s.tag END AS digest
    FROM found f LEFT JOIN answers s ON s.id = f.id"""
