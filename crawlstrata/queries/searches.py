"""Registered queries: scopes, dates, filters, orders, and derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlstrata.functions import formats, keys, times, urls
from crawlstrata.operators import lists
from crawlstrata.plans.search import SearchRequest, scan_key_prefix, search
from crawlstrata.queries.fixture import captures, over, page_url, parts_sql, read

QUERIES: dict = {}
SQL: dict[str, str] = {}
FROM, TO = "20240110", "202402"


def query(name: str, sql: str | None):
    """Register a query, with its SQL."""

    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _searched(name: str, sql: str, url: bool = True, columns: tuple[str, ...] = ("rid", "key"), **request) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = SearchRequest(url=page_url(spark, sf_dir) if url else None, **request)
        return search(captures(spark, sf_dir), asked).select(*columns)

    query(name, over(sql))(run)


SAME = "c.host = r.host and c.path = r.path"
JOIN = "from cap c cross join req r where"
_searched("search_exact", f"select rid, key {JOIN} {SAME}")
_searched("search_verbatim", f"select rid, key {JOIN} {SAME} and c.psu = r.psu", match_type="verbatim")
_searched("search_prefix", f"select rid, key {JOIN} c.host = r.host and starts_with(c.path, regexp_replace(r.path, '[?#].*$', ''))", match_type="prefix")
_searched("search_host", f"select rid, key {JOIN} c.host = r.host", match_type="host")
_searched("search_domain", f"select rid, key {JOIN} starts_with(c.host, r.host)", match_type="domain")
_searched("search_all", "select rid, key from cap", url=False)
_searched("date_range", "select rid, key from cap where unix >= epoch(timestamp '2024-01-10') and unix < epoch(timestamp '2024-03-01')", url=False, from_=FROM, to=TO)
_searched("date_range_open_end", "select rid, key from cap where unix >= epoch(timestamp '2024-01-20 12:00:00')", url=False, from_="2024012012")
_searched("filter_contains", "select rid, key from cap where mct like '%html%'", url=False, filters=("mct:html",))
_searched("filter_equals", "select rid, key from cap where hsc = 404", url=False, filters=("=hsc:404",))
_searched("filter_regex", "select rid, key from cap where regexp_matches(uri, 'example\\.(com|org)/en')", url=False, filters=(r"~uri:example\.(com|org)/en",))
_searched("filter_negated", "select rid, key from cap where hsc <> 200", url=False, filters=("!hsc:200",))
_searched("filter_and", "select rid, key from cap where hsc = 200 and mct like '%pdf%' and srt <> 'revisit'", url=False, filters=("=hsc:200", "mct:pdf", "!=srt:revisit"))
_searched("filter_missing", "select rid, key from cap where mct is null", url=False, filters=("=mct:",))
_searched("filter_present", "select rid, key from cap where mct is not null", url=False, filters=("!=mct:",))
_searched("filter_unknown_field", "select rid, key from cap where false", url=False, filters=("nosuch:x",))
_searched("filter_remapped", "select rid, key from cap where hsc = 302 and mct like '%html%'", url=False, filters=("=status:302", "mime:html"), remap={"status": "hsc", "mime": "mct"})
_searched("order_ascending", "select rid, key from cap order by key limit 25", url=False, limit=25)
_searched("order_reverse", "select rid, key from cap order by key desc limit 25", url=False, sort="reverse", limit=25)
_searched("limit_after_filter", "select rid, key from cap where hsc = 404 order by key limit 10", url=False, filters=("=hsc:404",), limit=10)
NEAR = "abs(c.unix - 1706745600), case when c.unix >= 1706745600 then 1 else 0 end, case when c.unix >= 1706745600 then key end, key desc"
_searched("closest_order", f"select rid, key {JOIN} {SAME} order by {NEAR} limit 12", sort="closest", closest="20240201", limit=12)
_searched("closest_order_verbatim", f"select rid, key {JOIN} {SAME} and c.psu = r.psu order by {NEAR} limit 5", sort="closest", closest="20240201", limit=5, match_type="verbatim")
_searched("fields_projected", f"select uri, hsc, mct {JOIN} {SAME}", columns=("uri", "hsc", "mct"), fields=("uri", "hsc", "mct"))


@query("replay_prefix_cap", over("select rid, key from cap where host = (select host from cap group by host order by count(*) desc, host limit 1) and starts_with(path, '/') order by key limit 1000"))
def replay_prefix_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix search of the host with the most captures, which has more than the cap."""
    held = captures(spark, sf_dir)
    host = held.groupBy("host").count().orderBy(F.desc("count"), "host").select(urls.desurt_domain("host")).first()[0]
    return search(held, SearchRequest(url=f"http://{host}/", match_type="prefix").for_replay()).select("rid", "key")


@query("replay_closest_verbatim", over(f"select rid, key {JOIN} {SAME} and c.psu = r.psu order by {NEAR} limit 3"))
def replay_closest_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = SearchRequest(url=page_url(spark, sf_dir), sort="closest", closest="20240201", limit=3).for_replay()
    return search(captures(spark, sf_dir), asked).select("rid", "key")


@query("search_composed", over(f"select rid, key {JOIN} starts_with(c.host, r.host) and c.unix >= epoch(timestamp '2024-01-10') and c.hsc = 200 and c.mct like '%html%' order by key desc limit 20"))
def search_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"url": [page_url(spark, sf_dir)], "matchType": ["domain"], "from": [FROM], "filter": ["=status:200", "mime:html"], "sort": ["reverse"], "limit": ["20"]}
    asked = SearchRequest.parse(values, {"status": "hsc", "mime": "mct"})
    return search(captures(spark, sf_dir), asked).select("rid", "key")


@query("scan_key_prefix", over("select rid, key from cap where starts_with(key, 'com,') and srt = 'response' and unix >= epoch(timestamp '2024-01-10')"))
def scan_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_key_prefix(captures(spark, sf_dir), "com,", from_=FROM, filters=("=srt:response",)).select("rid", "key")


@query("captures_scan", over("select rid, uri, ssu, host, psu, path, ts14, unix, key, filename, \"offset\" from cap"))
def captures_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).select("rid", "uri", "ssu", "host", "psu", "path", "ts14", "unix", "key", "filename", "offset")


@query("ssurt", f"with p as (select page_id, {parts_sql('url')} from pages) select page_id, host || '//' || psu || path as ssu from p")
def ssurt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", urls.ssurt("url").alias("ssu"))


@query("ssurt_host", f"with p as (select page_id, {parts_sql('url')} from pages) select page_id, host || '//' as host from p")
def ssurt_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", urls.ssurt_host("url").alias("host"))


@query(
    "surt",
    """with q as (select page_id, url, '(' || array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/?#]+)', 1), '.')), ',') || ',)' as h,
 regexp_extract(url, '://[^/?#]+([^?#]*)', 1) as p, regexp_extract(url, '\\?([^#]*)', 1) as s from pages),
i as (select page_id, unnest(string_split(s, '&')) as item, generate_subscripts(string_split(s, '&'), 1) as pos from q where s <> ''),
o as (select page_id, string_agg(item, '&' order by split_part(item, '=', 1), pos) as s from i group by page_id)
select q.page_id, h || case when p = '' then '/' else p end || coalesce('?' || o.s, '') as surt from q left join o on o.page_id = q.page_id""",
)
def surt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", urls.surt("url").alias("surt"))


@query("split_ssurt", over("select rid, host, psu, path from cap"))
def split_ssurt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).select("rid", urls.split_ssurt("ssu").alias("s")).select("rid", "s.host", "s.psu", "s.path")


@query("desurt_domain", over("select rid, array_to_string(list_reverse(string_split(trim(host, ','), ',')), '.') as domain from cap"))
def desurt_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).select("rid", urls.desurt_domain("host").alias("domain"))


@query("cdx_key_parsed", over("select rid, host as domain, path, ts14, unix, split_part(psu, ':', 1) as port, regexp_extract(psu, ':([a-z]+)', 1) as scheme, regexp_extract(psu, '@(.*):$', 1) as userinfo, srt from cap"))
def cdx_key_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).select("rid", keys.parse_cdx_key("key").alias("k")).select("rid", "k.domain", "k.path", "k.ts14", "k.unix", "k.port", "k.scheme", "k.userinfo", "k.srt")


@query("ts14", "select event_id, strftime(ts, '%Y%m%d%H%M%S') as ts14 from events")
def ts14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", times.ts14(F.col("ts").cast("timestamp")).alias("ts14"))


@query("rfc3339_to14", "select event_id, strftime(ts, '%Y%m%d%H%M%S') as ts14 from events")
def rfc3339_to14(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return read(spark, sf_dir, "events").select("event_id", times.rfc3339_to14(text).alias("ts14"))


DIGITS = "substr(strftime(ts, '%Y%m%d%H%M%S'), 1, 4 + 2 * cast(event_id % 6 as int))"


def _digits() -> F.Column:
    return F.substring(times.ts14(F.col("ts").cast("timestamp")), F.lit(1), (4 + 2 * (F.col("event_id") % 6)).cast("int"))


@query("parse14", f"select event_id, cast(epoch(strptime({DIGITS} || substr('00000101000000', 5 + 2 * cast(event_id % 6 as int)), '%Y%m%d%H%M%S')) as bigint) as unix from events")
def parse14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", times.range_start(_digits()).alias("unix"))


@query("range_end", "select event_id, cast(epoch(date_trunc(u, ts) + case u when 'year' then interval 1 year when 'month' then interval 1 month when 'day' then interval 1 day when 'hour' then interval 1 hour when 'minute' then interval 1 minute else interval 1 second end) as bigint) - 1 as unix from (select event_id, ts, case event_id % 6 when 0 then 'year' when 1 then 'month' when 2 then 'day' when 3 then 'hour' when 4 then 'minute' else 'second' end as u from events)")
def range_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", times.range_end(_digits()).alias("unix"))


@query("parse_ref", over("select rid, 'warcfile' as scheme, filename, \"offset\" from cap"))
def parse_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).select("rid", keys.parse_ref("ref").alias("r")).select("rid", "r.scheme", "r.filename", "r.offset")


@query("mime_group", over("select rid, split_part(mct, ';', 1) as mime from cap where mct is not null"))
def mime_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).where("mct is not null").select("rid", keys.mime_group("mct").alias("mime"))


@query("default_scheme", "select page_id, case when page_id % 2 = 0 then url else 'http://' || regexp_extract(url, '://(.*)$', 1) end as url from pages")
def default_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_extract("url", "://(.*)$", 1))
    return read(spark, sf_dir, "pages").select("page_id", urls.with_default_scheme(bare).alias("url"))


@query("absolute_location", over("select rid, case when starts_with(location, '/') then regexp_extract(uri, '^([a-z]+://[^/?#]+)', 1) || location else location end as target from cap where location is not null"))
def absolute_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).where("location is not null").select("rid", urls.absolute_location("uri", "location").alias("target"))


@query("replay_row", over("select ssu as urlkey, ts14 as \"timestamp\", uri as url, mct as mime, cast(hsc as varchar) as status, '' as digest, cast(rle as varchar) as length from cap"))
def replay_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.replay_row(captures(spark, sf_dir))


@query("replay_lines", over("""select ssu || ' ' || ts14 || ' {"urlkey":"' || ssu || '","timestamp":"' || ts14 || '","url":"' || uri || '",' || coalesce('"mime":"' || mct || '",', '') || '"status":"' || hsc || '","digest":"","length":"' || rle || '"}' as line from cap"""))
def replay_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.replay_json(captures(spark, sf_dir))


CAPTURE = """'{"uri":"' || uri || '","hsc":' || hsc || ',' || coalesce('"mct":"' || mct || '",', '') || '"ref":"' || ref || '","rid":"' || rid || '","cle":"' || cle || '",' || case when ple <> 0 then '"ple":"' || ple || '",' else '' end || '"rle":"' || rle || '",' || coalesce('"rou":"' || rou || '",', '') || coalesce('"rod":"' || strftime(rod, '%Y-%m-%dT%H:%M:%SZ') || '",', '') || coalesce('"roi":"' || roi || '",', '') || '"ssu":"' || ssu || '","sts":"' || strftime(sts, '%Y-%m-%dT%H:%M:%SZ') || '","srt":"' || srt || '"}'"""


@query("capture_json", over(f"select {CAPTURE} as line from cap"))
def capture_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.capture_json(captures(spark, sf_dir))


@query("cdxj_lines", over(f"select ssu || ' ' || ts14 || ' ' || srt || ' ' || {CAPTURE} as line from cap"))
def cdxj_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.cdxj(captures(spark, sf_dir))


@query("list_ids", over("select rid, filename, \"offset\" from cap order by rid limit 100"))
def list_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.list_ids(captures(spark, sf_dir), 100)
