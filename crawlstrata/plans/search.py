"""Search over the captures table: scope of a URL, date range, field filters, order and limit.

Scopes are written as string prefixes of the key, which Parquet readers prune with, and the order as a sort with a limit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlstrata.functions import times, urls
from crawlstrata.plans.filters import REPLAY_NAMES, all_filters

MATCH_TYPES = ("exact", "verbatim", "prefix", "host", "domain")
SORTS = ("asc", "reverse", "closest")
OUTPUTS = ("json", "cdxj")
ONE_ROW = pa.table({"one": [1]})


@dataclass(frozen=True)
class SearchRequest:
    url: str | None = None
    match_type: str = "exact"
    from_: str = ""
    to: str = ""
    filters: tuple[str, ...] = ()
    sort: str = "asc"
    closest: str | None = None
    limit: int = 0
    fields: tuple[str, ...] = ()
    output: str = ""
    remap: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, values: dict[str, list[str]], remap: dict[str, str] | None = None) -> SearchRequest:
        """A request from the parameters of a query string; ValueError where one is wrong."""
        get = lambda name: (values.get(name) or [""])[0]
        match, sort, output, closest, limit = get("matchType"), get("sort"), get("output"), get("closest"), get("limit")
        if match and match not in MATCH_TYPES:
            raise ValueError(f"matchType must be one of {MATCH_TYPES}, was {match!r}")
        if sort and sort not in SORTS:
            raise ValueError(f"sort must be one of {SORTS}, was {sort!r}")
        if output and output not in OUTPUTS:
            raise ValueError(f"output must be one of {OUTPUTS}, was {output!r}")
        if limit and not re.fullmatch(r"[+-]?[0-9]+", limit):
            raise ValueError(f"limit must be an integer, was {limit!r}")
        if sort == "closest" and closest and not get("url"):
            raise ValueError("sort=closest needs a url")
        for name in ("from", "to", "closest"):
            if get(name) and not re.fullmatch(r"([0-9]{2}){2,7}", get(name)):
                raise ValueError(f"{name} must be 4, 6, 8, 10, 12 or 14 digits, was {get(name)!r}")
        if sort == "closest" and not closest:
            sort = "asc"
        return cls(get("url") or None, match or "exact", get("from"), get("to"), tuple(values.get("filter") or ()), sort or "asc", closest or None, int(limit or 0), tuple(get("fields").split(",")) if get("fields") else (), output, remap or {})

    def for_replay(self, prefix_cap: int = 1000) -> SearchRequest:
        """Replay defaults: other field names, a cap on prefix searches without a limit, and verbatim scope for closest."""
        limit = prefix_cap if self.match_type == "prefix" and self.limit <= 0 else self.limit
        match = "verbatim" if self.sort == "closest" and self.match_type == "exact" else self.match_type
        return replace(self, limit=limit, match_type=match, remap=REPLAY_NAMES)


def _values(spark: SparkSession, **columns: Column) -> dict[str, object]:
    """Literals that column functions give. The one row is local, so the optimizer folds them and no job runs."""
    return spark.createDataFrame(ONE_ROW).select(*[c.alias(k) for k, c in columns.items()]).collect()[0].asDict()


def url_scope(spark: SparkSession, url: str) -> dict[str, str]:
    """host, psu and path of a request's URL, and path0: the path without query and fragment."""
    full = urls.with_default_scheme(F.lit(url))
    cut = F.regexp_replace(full, r"[?#].*$", "")
    found = _values(spark, ok=urls.url_ok(full), whole=urls.split_ssurt(urls.ssurt(full)), cut=urls.split_ssurt(urls.ssurt(cut)))
    if not found["ok"]:
        raise ValueError(f"not a URL: {url!r}")
    return {**found["whole"].asDict(), "path0": found["cut"]["path"]}


def match(captures: DataFrame, url: str | None, match_type: str = "exact") -> Column:
    """The scope of a URL as a predicate on key (and psu)."""
    if match_type not in MATCH_TYPES:
        raise ValueError(f"match type must be one of {MATCH_TYPES}, was {match_type!r}")
    if url is None:
        if match_type == "verbatim":
            raise ValueError("a verbatim search needs a url")
        return F.lit(True)
    at = url_scope(captures.sparkSession, url)
    host, path = at["host"], at["path"]
    key = F.col("key")
    if match_type == "exact":
        return key.startswith(f"{host}{path} ")
    if match_type == "verbatim":
        return key.startswith(f"{host}{path} ") & (F.col("psu") == at["psu"])
    if match_type == "prefix":
        return key.startswith(host + at["path0"])
    if match_type == "host" or not host.endswith(","):
        return key.startswith(f"{host}/")
    return key.startswith(host)


def date_range(spark: SparkSession, from_: str = "", to: str = "") -> Column:
    """Captures from the first second of ``from_`` to the last second of ``to``; an empty end is open."""
    start = times.range_start(F.lit(from_)) if from_ else F.lit(None)
    end = times.range_end(F.lit(to)) if to else F.lit(None)
    found = _values(spark, a=start, b=end)
    if from_ and found["a"] is None or to and found["b"] is None:
        raise ValueError(f"not a date range: {from_!r} to {to!r}")
    if from_ and to and found["a"] > found["b"]:
        raise ValueError("from must not be after to")
    out = F.lit(True)
    if from_:
        out = out & (F.col("unix") >= found["a"])
    if to:
        out = out & (F.col("unix") <= found["b"])
    return out


def scan_key_prefix(captures: DataFrame, prefix: str, from_: str = "", to: str = "", filters: tuple[str, ...] = (), limit: int = 0) -> DataFrame:
    """Raw prefix of the key, with date range and filters, in key order."""
    found = captures.where(F.col("key").startswith(prefix) & date_range(captures.sparkSession, from_, to) & all_filters(captures, list(filters)))
    return limited(found.orderBy("key"), limit)


def limited(df: DataFrame, limit: int) -> DataFrame:
    return df.limit(limit) if limit > 0 else df


def closest_order(instant: int) -> list[Column]:
    """Nearest first; at equal distance the earlier side first. The later side goes up in key order, the earlier side down."""
    later = F.col("unix") >= instant
    return [F.abs(F.col("unix") - instant), later, F.when(later, F.col("key")).asc(), F.when(~later, F.col("key")).desc()]


def search(captures: DataFrame, request: SearchRequest, where: Column | None = None) -> DataFrame:
    """The captures that a request asks for. ``where``: any further predicate."""
    spark = captures.sparkSession
    closest = request.sort == "closest" and request.closest
    if closest and not request.url:
        raise ValueError("sort=closest needs a url")
    # Nearest in time is a search of one URL, whatever the match type.
    scope = ("verbatim" if request.match_type == "verbatim" else "exact") if closest else request.match_type
    found = captures.where(match(captures, request.url, scope) & date_range(spark, request.from_, request.to) & all_filters(captures, list(request.filters), request.remap))
    if where is not None:
        found = found.where(where)
    if closest:
        instant = _values(spark, t=times.range_start(F.lit(request.closest)))["t"]
        if instant is None:
            raise ValueError(f"not a date: {request.closest!r}")
        found = found.orderBy(*closest_order(instant))
    else:
        found = found.orderBy(F.col("key").desc() if request.sort == "reverse" else F.col("key"))
    found = limited(found, request.limit)
    return found.select(*[request.remap.get(f, f) for f in request.fields]) if request.fields else found
