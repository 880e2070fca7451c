"""The captures table that the registered queries run on, derived from pages and events, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlstrata.functions.keys import with_keys
from crawlstrata.functions.urls import URL

PAGE = r"^([a-z]+)://([^/?#]+)(.*)$"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is one capture of page ``event_id % n``; ``k`` is the round of capture."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.length("html").alias("len"))
    n = pages.count()
    part = lambda k: F.regexp_extract("url", PAGE, k)
    pages = pages.select("page_id", "url", "len", part(1).alias("sch"), part(2).alias("h"), part(3).alias("rest"))
    after = pages.select(F.col("page_id").alias("next_id"), F.col("url").alias("next_url"), F.col("rest").alias("next_rest"))
    e = read(spark, sf_dir, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("sts"), "event_type", "value")
    e = e.withColumn("page_id", F.col("event_id") % n).withColumn("next_id", (F.col("event_id") + 1) % n).withColumn("k", ((F.col("event_id") - F.col("page_id")) / n).cast("long"))
    e = e.join(pages, "page_id").join(after, "next_id")
    kind = F.col("event_type")
    purchase = kind == "purchase"
    turn = F.col("k") % 10
    at = F.concat(F.col("sch"), F.lit("://"))
    media = (F.col("page_id") + F.col("k")) % 4
    return e.select(
        F.concat(F.lit("urn:uuid:"), F.col("event_id").cast("string")).alias("rid"),
        F.when(turn == 0, F.concat(at, "h", F.lit("/"))).when(turn == 1, F.concat(at, "h", F.lit(":8080"), "rest")).when(turn == 2, F.concat(at, F.lit("user:pw@"), "h", "rest")).otherwise(F.col("url")).alias("uri"),
        "sts",
        F.when(kind == "signup", 302).when(kind == "error", 404).otherwise(200).alias("hsc"),
        F.when(purchase, "revisit").otherwise("response").alias("srt"),
        F.when(media == 0, "text/html; charset=utf-8").when(media == 1, "text/html").when(media == 2, "application/pdf").alias("mct"),
        (F.col("len") + 200).cast("long").alias("cle"),
        F.floor(F.col("value") * 100).cast("long").alias("ple"),
        (300 + F.col("event_id") % 5000).cast("long").alias("rle"),
        F.concat(F.lit("warcfile:crawl-"), F.lpad((F.col("event_id") % 40).cast("string"), 3, "0"), F.lit(".warc.gz#"), (F.col("event_id") * 1000).cast("string")).alias("ref"),
        F.when(purchase & (F.col("event_id") >= n) & (F.col("event_id") % 3 != 0), F.concat(F.lit("urn:uuid:"), (F.col("event_id") - n).cast("string"))).alias("roi"),
        F.when(purchase, F.col("url")).alias("rou"),
        F.when(purchase, F.col("sts") - F.expr("interval 1 hour")).alias("rod"),
        F.when((kind == "signup") & (F.col("event_id") % 3 != 0), F.col("next_url")).when(kind == "signup", F.col("next_rest")).alias("location"),
        F.lit(None).cast("string").alias("dig"),
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_keys(raw_captures(spark, sf_dir))


def page_url(spark: SparkSession, sf_dir: str, page_id: int = 3) -> str:
    """The URL that the search queries ask for."""
    return read(spark, sf_dir, "pages").where(F.col("page_id") == page_id).select("url").first()[0]


def suffixes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("com",), ("net",), ("org",)], "rule string")


def parts_sql(uri: str) -> str:
    """SQL columns host, psu, path of a URL expression."""
    g = lambda k: f"regexp_extract({uri}, '{URL}', {k})"
    port = f"case when (lower({g(1)}), {g(4)}) in (('http', '80'), ('https', '443'), ('ws', '80'), ('wss', '443'), ('ftp', '21')) then '' else {g(4)} end"
    host = f"array_to_string(list_reverse(string_split(lower({g(3)}), '.')), ',') || ','"
    psu = f"({port}) || ':' || lower({g(1)}) || case when {g(2)} <> '' then '@' || {g(2)} else '' end || ':'"
    path = f"case when {g(5)} = '' then '/' else {g(5)} end || case when {g(6)} = '?' then '' else {g(6)} end || case when {g(7)} = '#' then '' else {g(7)} end"
    return f"{host} as host, {psu} as psu, {path} as path"


RAW = """n as (select count(*) as n from pages),
b as (select page_id, url, length(html) as len,
  regexp_extract(url, '^([a-z]+)://([^/?#]+)(.*)$', 1) as sch,
  regexp_extract(url, '^([a-z]+)://([^/?#]+)(.*)$', 2) as h,
  regexp_extract(url, '^([a-z]+)://([^/?#]+)(.*)$', 3) as rest from pages),
e as (select event_id, date_trunc('second', ts) as sts, event_type, value, n.n as n,
  event_id % n.n as page_id, (event_id + 1) % n.n as next_id,
  cast((event_id - event_id % n.n) / n.n as bigint) as k from events cross join n),
raw as (select 'urn:uuid:' || cast(e.event_id as varchar) as rid,
  case when e.k % 10 = 0 then b.sch || '://' || b.h || '/'
       when e.k % 10 = 1 then b.sch || '://' || b.h || ':8080' || b.rest
       when e.k % 10 = 2 then b.sch || '://user:pw@' || b.h || b.rest
       else b.url end as uri,
  e.sts as sts,
  case e.event_type when 'signup' then 302 when 'error' then 404 else 200 end as hsc,
  case when e.event_type = 'purchase' then 'revisit' else 'response' end as srt,
  case (b.page_id + e.k) % 4 when 0 then 'text/html; charset=utf-8' when 1 then 'text/html' when 2 then 'application/pdf' end as mct,
  cast(b.len + 200 as bigint) as cle, cast(floor(e.value * 100) as bigint) as ple, cast(300 + e.event_id % 5000 as bigint) as rle,
  'warcfile:crawl-' || lpad(cast(e.event_id % 40 as varchar), 3, '0') || '.warc.gz#' || cast(e.event_id * 1000 as varchar) as ref,
  case when e.event_type = 'purchase' and e.event_id >= e.n and e.event_id % 3 <> 0 then 'urn:uuid:' || cast(e.event_id - e.n as varchar) end as roi,
  case when e.event_type = 'purchase' then b.url end as rou,
  case when e.event_type = 'purchase' then e.sts - interval '1' hour end as rod,
  case when e.event_type = 'signup' and e.event_id % 3 <> 0 then b2.url when e.event_type = 'signup' then b2.rest end as location
from e join b on b.page_id = e.page_id join b b2 on b2.page_id = e.next_id)"""

CAP = f"""{RAW},
keyed as (select *, strftime(sts, '%Y%m%d%H%M%S') as ts14, cast(epoch(sts) as bigint) as unix,
  regexp_extract(ref, '^([^:]*):(.*)#([^#]*)$', 2) as filename, cast(regexp_extract(ref, '^([^:]*):(.*)#([^#]*)$', 3) as bigint) as "offset",
  {parts_sql("uri")} from raw),
cap as (select *, host || '//' || psu || path as ssu, host || path || ' ' || ts14 || ' ' || psu || ' ' || srt as key from keyed),
req as (select {parts_sql("url")}, url, replace(array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/?#]+)', 1), '.')), ','), '', '') as rev from pages where page_id = 3)"""


def over(select: str) -> str:
    """A statement over cap (the captures with their keys) and req (the URL asked for)."""
    return f"with {CAP}\n{select}"
