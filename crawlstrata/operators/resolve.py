"""Bulk lookups: ids, files, nearest captures in time, revisits, redirects, replay.

Each takes a table of requests and gives a table of answers; nothing is looked up one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlstrata.functions import urls
from crawlstrata.operators import ranges
from crawlstrata.scratch import written

#: Status codes that redirect.
REDIRECTS = (301, 302, 307, 308)


def resolve_ids(requests: DataFrame, ids: DataFrame) -> DataFrame:
    """Add ``ref`` to requests with ``rid``; empty where the id is unknown."""
    return requests.join(ids.select("rid", "ref"), "rid", "left").withColumn("ref", F.coalesce("ref", F.lit("")))


def resolve_paths(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``path`` and ``size`` to rows with ``filename``."""
    return refs.join(files.select(F.col("name").alias("filename"), "path", "size"), "filename", "left")


def get_captures(requests: DataFrame, captures: DataFrame) -> DataFrame:
    return requests.join(captures, "key")


def scoped(requests: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path and psu of a URL column to requests."""
    parts = urls.split_ssurt(urls.ssurt(urls.with_default_scheme(url)))
    return requests.withColumn("_scope", parts).select("*", "_scope.host", "_scope.path", "_scope.psu").drop("_scope")


def _united(requests: DataFrame, captures: DataFrame, scope: list[str], request: Column, capture: Column) -> DataFrame:
    """Requests (side 0) and the captures that they may want (side 1), in ranges of URL and time."""
    held = ranges.asked_only(captures, requests, scope)
    asked = requests.select(*scope, F.col("at").alias("_t"), F.lit(0).alias("_side"), F.lit("").alias("_key"), F.xxhash64(*requests.columns).alias("_tie"), request.alias("_request"))
    held = held.select(*scope, F.col("unix").alias("_t"), F.lit(1).alias("_side"), F.col("key").alias("_key"), F.lit(0).cast("long").alias("_tie"), capture.alias("_capture"))
    return ranges.spread_large(asked.unionByName(held, allowMissingColumns=True), scope, ["_t", "_side", "_key", "_tie"])


def closest(requests: DataFrame, captures: DataFrame, verbatim: bool = False, answer: tuple[str, ...] = ("rid", "key", "ref", "unix")) -> DataFrame:
    """The capture nearest in time of each request (host, path, psu and instant ``at`` in seconds); nulls where there is none.

    Adds a struct ``nearest`` of the answer columns. Only captures of asked URLs are shuffled. They and the requests are united and put
    in order once by ranges of URL and time, so that a URL with a third of all captures is split over tasks; the capture before the first
    and after the last one of a range comes from its neighbours. Forward wins only if it is strictly nearer.
    """
    scope = ["host", "path", *(["psu"] if verbatim else [])]
    columns = list(dict.fromkeys([*answer, "unix", "key"]))
    # What stands in the columns of the order is not written twice.
    own = {"unix": F.col("_t"), "key": F.col("_key")}
    mine = {"at": F.col("_t"), **{c: F.col(c) for c in scope}}
    rest = lambda names, known: F.struct(F.lit(True).alias("_"), *[c for c in names if c not in known])
    both = _united(requests, captures, scope, rest(requests.columns, mine), rest(columns, own))
    capture = F.when(F.col("_side") == 1, F.struct(*[own.get(c, F.col(f"_capture.{c}")).alias(c) for c in columns]))
    place = F.when(F.col("_side") == 1, F.struct("_t", "_key"))
    edge = ranges.carried(both, scope, {"_first": F.min_by(capture, place), "_last": F.max_by(capture, place)}, {"_earlier": ("_last", "last"), "_later": ("_first", "first")})
    held = ranges.dealt(both, scope).withColumn("_held", capture).drop("_capture")
    known = ", ".join((ranges.PART, *scope))
    beside = lambda f: F.expr(f"{f}(_held, 1) ignore nulls over (partition by {known} order by _t, _side, _key)")
    seen = held.select("*", beside("lag").alias("_before"), beside("lead").alias("_after"))
    seen = ranges.with_carried(seen.where("_side = 0"), edge, scope)
    seen = seen.select(*scope, "_request", "_t", F.coalesce("_before", "_earlier").alias("_before"), F.coalesce("_after", "_later").alias("_after"))
    back, ahead = F.col("_t") - F.col("_before.unix"), F.col("_after.unix") - F.col("_t")
    forward = F.col("_before").isNull() | (ahead < back)
    nearest = F.when(F.col("_after").isNotNull() & forward, F.col("_after")).otherwise(F.col("_before"))
    return seen.select(*[mine.get(c, F.col(f"_request.{c}")).alias(c) for c in requests.columns], nearest.alias("nearest"))


def closest_k(requests: DataFrame, captures: DataFrame, k: int, verbatim: bool = False) -> DataFrame:
    """The k nearest captures of each request, with ``rank`` from 1. Requests have a column ``request``.

    Captures of a URL are numbered in time, range by range; a request between two of them can only want the k numbers on either side,
    so it is joined with 2k captures at most, however many its URL has.
    """
    scope = ["host", "path", *(["psu"] if verbatim else [])]
    both = _united(requests.select(*scope, "at", "request"), captures, scope, F.col("request"), F.col("rid"))
    edge = ranges.carried(both, scope, {"_n": F.sum("_side")}, {"_passed": ("_n", "sum")})
    order = ranges.within(scope).orderBy("_t", "_side", "_key").rowsBetween(Window.unboundedPreceding, 0)
    both = ranges.with_carried(ranges.dealt(both, scope).withColumn("_own", F.sum("_side").over(order)), edge, scope).withColumn("_number", F.col("_own") + F.coalesce("_passed", F.lit(0)))
    numbers = F.sequence(F.greatest(F.col("_number") - (k - 1), F.lit(1)), F.col("_number") + k)
    wanted = both.where("_side = 0").select(*scope, F.col("_request").alias("request"), F.col("_t").alias("at"), F.explode(numbers).alias("_number"))
    found = wanted.join(both.where("_side = 1").select(*scope, "_number", F.col("_t").alias("unix"), F.col("_key").alias("key"), F.col("_capture").alias("rid")), [*scope, "_number"])
    later = F.col("unix") >= F.col("at")
    nearest = Window.partitionBy("request").orderBy(F.abs(F.col("unix") - F.col("at")), later, F.when(later, F.col("key")).asc(), F.when(~later, F.col("key")).desc())
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("request", "rank", "rid", "key")


def resolve_revisits(captures: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """For revisits (those with a rid of ``among``, if given): rid, original (rid of the capture it stands for), original_ref, outcome.

    By record id if there is one, else by the nearest capture of the refers-to URI at the refers-to date (own date where it
    is missing). Outcomes: ok, not_found, no_reference.
    """
    revisits = captures.where("srt = 'revisit'")
    if among is not None:
        revisits = ranges.asked_only(revisits, among, ["rid"]).join(among.select("rid").distinct(), "rid", "left_semi")
    revisits = revisits.select("rid", "roi", "rou", F.coalesce(F.unix_timestamp("rod"), F.col("unix")).alias("at"))
    named = revisits.where("roi is not null")
    originals = ranges.asked_only(captures.select(F.col("rid").alias("roi"), F.col("rid").alias("original"), F.col("ref").alias("original_ref")), named, ["roi"])
    by_id = named.join(originals.hint("merge"), "roi", "left")
    by_id = by_id.select("rid", "original", "original_ref", F.when(F.col("original").isNull(), "not_found").otherwise("ok").alias("outcome"))
    dated = revisits.where("roi is null and rou is not null")
    found = closest(scoped(dated, "rou").select("rid", "at", "host", "path", "psu"), captures.where("srt <> 'revisit' or roi is not null"), verbatim=True)
    by_date = found.select("rid", F.col("nearest.rid").alias("original"), F.col("nearest.ref").alias("original_ref"), F.when(F.col("nearest").isNull(), "not_found").otherwise("ok").alias("outcome"))
    none = F.lit(None).cast("string")
    neither = revisits.where("roi is null and rou is null").select("rid", none.alias("original"), none.alias("original_ref"), F.lit("no_reference").alias("outcome"))
    return by_id.unionByName(by_date).unionByName(neither)


def merge_revisits(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """Records (rid, headers, block) of revisits with the payload of their originals: headers from the revisit, block from the original.

    The planner takes records for as small as the list of files that they come from; the hints keep it from sending all blocks through the driver.
    """
    pairs = resolved.where("outcome = 'ok'").select("rid", "original").hint("merge")
    revisit = records.select("rid", "headers").hint("merge")
    original = records.select(F.col("rid").alias("original"), "block").hint("merge")
    return pairs.join(revisit, "rid").join(original, "original").select("rid", "original", "headers", "block")


def resolve_redirects(captures: DataFrame, location: str = "location", among: DataFrame | None = None) -> DataFrame:
    """For redirects (those with a rid of ``among``, if given): rid, target (absolute URL), nearest (rid of its capture nearest in time), outcome (ok, not_found)."""
    asked = captures.where(F.col("hsc").isin(*REDIRECTS) & F.col(location).isNotNull())
    if among is not None:
        asked = ranges.asked_only(asked, among, ["rid"]).join(among.select("rid").distinct(), "rid", "left_semi")
    asked = asked.select("rid", urls.absolute_location("uri", location).alias("target"), F.col("unix").alias("at"))
    found = closest(scoped(asked, "target"), captures, verbatim=True)
    return found.select("rid", "target", F.col("nearest.rid").alias("nearest"), F.when(F.col("nearest").isNull(), "not_found").otherwise("ok").alias("outcome"))


def replay_plan(requests: DataFrame, captures: DataFrame, location: str = "location") -> DataFrame:
    """Columns request, rid, ref, outcome: what replays each (request, url, at).

    The nearest capture answers; a revisit through its original, a redirect through the capture of its target. Only
    revisits and redirects that are hit are resolved. Outcomes: ok, not_found, refers_to_not_found, redirect, redirect_not_found, error.
    """
    # Every step below reads the captures again.
    captures = written(captures.select("rid", "uri", "key", "ref", "unix", "host", "path", "psu", "srt", "roi", "rou", "rod", "hsc", F.col(location).alias("_location")))
    location = "_location"
    asked = scoped(requests.select("request", "url", "at")).drop("url")
    hit = written(closest(asked, captures, verbatim=True, answer=("rid", "ref")).select("request", F.col("nearest.rid").alias("rid"), F.col("nearest.ref").alias("ref")))
    hits = hit.where("rid is not null").select("rid")
    originals = resolve_revisits(captures, hits).withColumnRenamed("outcome", "revisit_outcome")
    jumps = resolve_redirects(captures, location, hits).select("rid", F.col("nearest").alias("jump"), F.col("outcome").alias("jump_outcome"))
    joined = hit.join(originals, "rid", "left").join(jumps, "rid", "left")
    revisit, redirect = F.col("revisit_outcome").isNotNull(), F.col("jump_outcome").isNotNull()
    outcome = (
        F.when(F.col("rid").isNull(), "not_found")
        .when(revisit & (F.col("revisit_outcome") == "not_found"), "refers_to_not_found")
        .when(revisit & (F.col("revisit_outcome") == "no_reference"), "error")
        .when(redirect & (F.col("jump_outcome") == "ok"), "redirect")
        .when(redirect, "redirect_not_found")
        .otherwise("ok")
    )
    rid: Column = F.when(outcome == "redirect", F.col("jump")).otherwise(F.col("rid"))
    ref = F.when(outcome == "redirect", F.lit(None)).when(revisit, F.col("original_ref")).otherwise(F.col("ref"))
    return joined.select("request", rid.alias("rid"), ref.alias("ref"), outcome.alias("outcome"))
