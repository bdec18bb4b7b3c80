"""WARC revisits: each not-modified record gets the latest earlier full response of its canonical URL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, shuffle_partitions, small, written

# Parameters that only track a visit, and the headers that a 304 answer may bring up to date (RFC 9110, 15.4.5).
TRACKING = ("fbclid", "gclid", "ref", "sessionid", "sid")
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, www., default port, fragment, closing slashes and tracking; parameters sorted. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, "^[^/?]*", 0)
    name = F.regexp_replace(F.regexp_replace(F.lower(host), "^www[0-9]*\\.", ""), ":(80|443)$", "")
    rest = F.substring(bare, F.length(host) + 1, F.length(bare))
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    asked = F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(asked, lambda p: (p != "") & ~p.startswith("utm_") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
    query = F.array_join(kept, "&")
    return F.concat(name, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def last_before(rows: DataFrame, by: str, order: list, value: str, name: str) -> DataFrame:
    """Replaces `value` by the latest non-null `value` of the rows that precede a row in `order` within its `by` (no nulls).

    Rows are dealt out by range of (by, order), so that a hot key fills many tasks. Each task carries the value itself
    forward, so that nothing is joined on it, and adds a row that says with which keys it begins and ends and what it
    ends with; from these, one for each task, the next tasks' first keys get what came before.
    """
    ranged = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), by, *order).sortWithinPartitions(by, *order).withColumn("__pid", F.spark_partition_id())

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, head, opening, pid, schema = None, None, None, True, None, None
        for b in batches:
            if not b.num_rows:
                continue
            schema, n, values = b.schema, b.num_rows, b.column(value)
            pid = b.column("__pid")[0].as_py()
            runs = b.column(by).dictionary_encode()
            codes = runs.indices.to_numpy(zero_copy_only=False)
            start = np.r_[True, codes[1:] != codes[:-1]]
            ends = np.flatnonzero(start)[1] if start.sum() > 1 else n
            first = runs.dictionary[int(codes[0])].as_py()
            head = first if head is None else head
            same = first == key
            # before each row: the position of the last value in its run, n for the one held from earlier batches, or none
            at = np.where(values.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1)
            seen = np.maximum.accumulate(np.r_[-1, at])
            run_start = np.maximum.accumulate(np.where(start, np.arange(n), 0))
            last = np.where(seen[:-1] >= run_start, seen[:-1], -1)
            if same and held is not None:
                last[:ends] = np.where(last[:ends] >= 0, last[:ends], n)
            pool = pa.concat_arrays([values, pa.array([held], values.type)])
            carried = pool.take(pa.array(last, pa.int64(), mask=last < 0))
            opens = np.zeros(n, bool)
            if opening:
                opens[:ends] = first == head
            opening = opening and start.sum() == 1 and first == head
            if seen[-1] >= run_start[-1]:
                held = values[int(seen[-1])].as_py()
            elif not (same and start.sum() == 1):
                held = None
            key = runs.dictionary[int(codes[-1])].as_py()
            yield pa.RecordBatch.from_arrays([*[carried if c == value else b.column(c) for c in schema.names], pa.array(opens), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=[*schema.names, "__opens", "__head", "__tail"])
        if schema is not None:
            told = {"__pid": pid, value: held}
            yield pa.RecordBatch.from_arrays([*[pa.array([told.get(f.name)], f.type) for f in schema], pa.array([False]), pa.array([head]), pa.array([key])], names=[*schema.names, "__opens", "__head", "__tail"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    table = written(map_batches(ranged, carry, f"{fields}, __opens boolean, __head string, __tail string"), name)
    none = F.lit(None).cast(rows.schema[value].dataType)
    ends = table.where("__head is not null").select("__pid", F.explode(F.array(F.struct(F.col("__head").alias("key"), F.lit(0).alias("kind"), none.alias("held")), F.struct(F.col("__tail").alias("key"), F.lit(1).alias("kind"), F.col(value).alias("held")))).alias("e")).select("__pid", "e.*")
    earlier = Window.partitionBy("key").orderBy("__pid", "kind").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("__carried", F.last("held", ignorenulls=True).over(earlier)).where("kind = 0 and __carried is not null").select("__pid", "__carried")
    back = table.where("__head is null").join(small(starts), "__pid", "left")
    return back.withColumn(value, F.coalesce(value, F.when(F.col("__opens"), F.col("__carried")))).drop("__pid", "__opens", "__head", "__tail", "__carried")


def resolve(records: DataFrame) -> DataFrame:
    """records(record_id, url, type, time, etag, last_modified, headers map) -> every record with canonical_url, source_id, outcome, merged_headers.

    type: `response` (a full one) or `revisit`, which any other type counts as. A revisit's source is the response with
    the same canonical URL and the latest time before its own (of equal times the largest id; of equal ids one by its
    validators and headers). Outcome: `full` for responses; `resolved` if the entity tags agree (weakly), or, where one
    has none, the modification times; `unverified` if there is nothing to compare; `mismatch` if they differ; `orphan`
    without an earlier response. A resolved or unverified revisit has the source's headers, with those that a 304 answer
    may change taken from itself. Nulls: a record without a URL, time or id is an orphan if it is a revisit and never a
    source; null headers are none. There is a row for each row, also of equal ids and equal rows; an empty table gives no
    rows. Columns that have the names of results are replaced. All columns are moved once: leave payloads out and join
    them by source_id.
    """
    records = records.drop("canonical_url", "source_id", "outcome", "merged_headers")
    columns = records.columns
    full = F.coalesce(F.col("type") == "response", F.lit(False))
    source = F.struct(F.col("record_id").alias("id"), F.col("etag").alias("etag"), F.col("last_modified").alias("modified"), F.col("headers").alias("headers"))
    tie = F.xxhash64("etag", "last_modified", F.array_sort(F.map_entries("headers")))
    keyed = written(records.withColumns({"canonical_url": canonical_url(F.col("url")), "__full": full.cast("int"), "__tie": tie, "__source": F.when(full, source)}), "captures")
    usable = F.col("canonical_url").isNotNull() & F.col("time").isNotNull() & F.col("record_id").isNotNull()
    # at one time revisits come first, so that what stands before a row is earlier than it
    placed = last_before(keyed.where(usable), "canonical_url", ["time", "__full", "record_id", "__tie"], "__source", "revisits")
    none = F.lit(None).cast(keyed.schema["__source"].dataType)
    out = placed.unionByName(keyed.where(~usable).withColumn("__source", none)).withColumn("__source", F.when(F.col("__full") == 0, F.col("__source")))

    def strong(tag: str) -> Column:
        return F.regexp_replace(F.col(tag), "^W/", "")

    agree = F.coalesce(strong("etag") == strong("__source.etag"), F.col("last_modified") == F.col("__source.modified"))
    outcome = F.when(F.col("__full") == 1, "full").when(F.col("__source").isNull(), "orphan").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    no_headers = F.create_map().cast("map<string,string>")
    own, theirs = F.coalesce("headers", no_headers), F.coalesce("__source.headers", no_headers)
    fresh = F.map_filter(own, lambda k, _: F.lower(k).isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.array_contains(F.transform(F.map_keys(fresh), lambda x: F.lower(x)), F.lower(k))), fresh)
    out = out.withColumn("source_id", F.col("__source.id")).withColumn("outcome", outcome)
    return out.withColumn("merged_headers", F.when(F.col("outcome").isin("resolved", "unverified"), merged).when(F.col("outcome") == "full", own)).select(*columns, "canonical_url", "source_id", "outcome", "merged_headers")


def captures(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) as a capture log: a response for each page, and a revisit of the same entity at
    another spelling of its URL, at a time that the URL's hash gives: before or after other captures of the URL."""
    time = F.col("page_id") * 60
    tag = F.md5(F.coalesce("html", F.lit("")))
    length = F.length(F.coalesce("html", F.lit(""))).cast("string")
    later = time + F.conv(F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 7), 16, 10).cast("long") % 600_000 - 60_000
    none = F.lit(None).cast("string").alias("last_modified")
    full = F.struct((F.col("page_id") * 2).alias("record_id"), F.col("url"), F.lit("response").alias("type"), time.alias("time"), F.col("tag").alias("etag"), none, F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("length"), F.lit("date"), time.cast("string"), F.lit("etag"), F.col("tag")).alias("headers"))
    again = F.struct((F.col("page_id") * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), F.lit("revisit").alias("type"), later.alias("time"), F.concat(F.lit("W/"), "tag").alias("etag"), none, F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), later.cast("string"), F.lit("etag"), F.col("tag")).alias("headers"))
    return pages.select("page_id", "url", tag.alias("tag"), length.alias("length")).select(F.explode(F.array(full, again)).alias("x")).select("x.*")


def resolved_captures(pages: DataFrame) -> DataFrame:
    """The outcome for each record of captures(pages), headers as sorted lines."""
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("merged_headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return resolve(captures(pages)).select("record_id", "canonical_url", "type", F.col("time").alias("capture_time"), "source_id", "outcome", lines.alias("merged_headers"))


ORACLE_SQL = """
with pages_ as (
  select page_id, url, md5(coalesce(html, '')) as etag, length(coalesce(html, '')) as n,
    page_id * 60 + ('0x' || substr(md5(coalesce(url, '')), 1, 7))::bigint % 600000 - 60000 as later from pages
), log as (
  select page_id * 2 as record_id, url, 'response' as type, page_id * 60 as capture_time, etag, n from pages_
  union all select page_id * 2 + 1, url || '#again', 'revisit', later, etag, 0 from pages_
), bare as (
  select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as b from log
), parts as (
  select *, regexp_extract(b, '^[^/?]*') as host, substr(b, length(regexp_extract(b, '^[^/?]*')) + 1) as rest from bare
), asked as (
  select *, array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'),
    lambda p: p <> '' and not starts_with(p, 'utm_') and split_part(p, '=', 1) not in ('fbclid', 'gclid', 'ref', 'sessionid', 'sid'))), '&') as q from parts
), canon as (
  select *, regexp_replace(regexp_replace(lower(host), '^www[0-9]*\\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(rest, '^[^?]*'), '/+$', '') || case when q <> '' then '?' || q else '' end as canonical_url from asked
), placed as (
  select *, last_value(case when type = 'response' then record_id end ignore nulls) over (partition by canonical_url
    order by capture_time, (type = 'response')::int, record_id rows between unbounded preceding and 1 preceding) as before_id from canon
), joined as (
  select p.*, case when p.type = 'revisit' then p.before_id end as source_id, s.etag as s_etag, s.n as s_n from placed p
  left join log s on p.type = 'revisit' and s.record_id = p.before_id
), told as (
  select *, case when type = 'response' then 'full' when source_id is null then 'orphan' when etag = s_etag then 'resolved' else 'mismatch' end as outcome from joined
)
select record_id, canonical_url, type, capture_time, source_id, outcome, case when outcome in ('full', 'resolved') then
  'content-length: ' || (case when outcome = 'full' then n else s_n end) || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || capture_time || chr(10) || 'etag: ' || etag end as merged_headers
from told
"""
