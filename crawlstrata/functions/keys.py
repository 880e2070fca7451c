"""Keys and references of captures, and derived fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlstrata.functions.once import once
from crawlstrata.functions.times import parse14, ts14
from crawlstrata.functions.urls import split_ssurt, ssurt


def cdx_key(host: Column, path: Column, ts: Column, psu: Column, record_type: Column) -> Column:
    """``com,example,/path 20200101000000 8080:http: response``."""
    return F.concat(host, path, F.lit(" "), ts, F.lit(" "), psu, F.lit(" "), F.coalesce(record_type, F.lit("")))


def parse_cdx_key(key: Column | str) -> Column:
    """struct<domain, path, ts14, unix, port, scheme, userinfo, psu, srt>; parts that are missing are empty (unix: null)."""
    k = F.col(key) if isinstance(key, str) else key
    words = F.split(k, " ")
    part = lambda n: F.coalesce(F.try_element_at(words, F.lit(n)), F.lit(""))
    place, psu = part(1), part(3)
    slash = F.locate("/", place)
    domain = F.when(slash > 0, F.substring(place, F.lit(1), slash - 1)).otherwise(place)
    path = F.when(slash > 0, F.substring(place, slash, F.length(place))).otherwise("")
    port = F.regexp_extract(psu, "^([^:]*):", 1)
    scheme = F.regexp_extract(psu, "^[^:]*:([^:@]*)", 1)
    userinfo = F.regexp_extract(psu, "^[^:]*:[^:@]*@(.*?):?$", 1)
    return F.struct(domain.alias("domain"), path.alias("path"), part(2).alias("ts14"), F.unix_timestamp(parse14(part(2))).alias("unix"), port.alias("port"), scheme.alias("scheme"), userinfo.alias("userinfo"), psu.alias("psu"), part(4).alias("srt"))


def parse_ref(ref: Column | str) -> Column:
    """struct<scheme, filename, offset> of ``warcfile:name#123``; offset is null unless it is a decimal number."""
    r = F.col(ref) if isinstance(ref, str) else ref
    pattern = r"^([^:]*):(.*)#([^#]*)$"
    offset = F.regexp_extract(r, pattern, 3)
    return F.struct(F.regexp_extract(r, pattern, 1).alias("scheme"), F.regexp_extract(r, pattern, 2).alias("filename"), F.when(offset.rlike("^[0-9]{1,18}$"), offset.cast("long")).alias("offset"))


def mime_group(mct: Column | str) -> Column:
    """Media type before its first semicolon."""
    return F.substring_index(F.col(mct) if isinstance(mct, str) else mct, ";", 1)


@once
def _parts() -> list[Column]:
    # As the output of a generator the key is computed once; a condition on a plain column would compute it again.
    return [F.explode_outer(F.array(ssurt("uri"))).alias("ssu"), split_ssurt("ssu").alias("_parts"), parse_ref("ref").alias("_ref")]


@once
def _fields() -> list[Column]:
    return [*map(F.col, ("_parts.host", "_parts.psu", "_parts.path")), ts14("sts").alias("ts14"), F.unix_timestamp("sts").alias("unix"), *map(F.col, ("_ref.filename", "_ref.offset"))]


def with_keys(captures: DataFrame) -> DataFrame:
    """Add ssu, host, psu, path, ts14, unix, key, filename and offset to captures with uri, sts, srt and ref. Rows whose uri is no URL go."""
    ssu, parts, ref = _parts()
    out = captures.select(*[ssu if c == "ssu" else c for c in captures.columns], *([] if "ssu" in captures.columns else [ssu])).where("ssu is not null")
    out = out.select("*", parts, ref)
    out = out.select("*", *_fields()).drop("_parts", "_ref")
    return out.withColumn("key", cdx_key(F.col("host"), F.col("path"), F.col("ts14"), F.col("psu"), F.col("srt")))
