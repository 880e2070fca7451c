"""URL columns: parts, sortable keys (SSURT, SURT), domains, redirect targets. All are built-in expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: scheme, userinfo, host, port, path, query, fragment
URL = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):(?://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]*)(?::([0-9]*))?)?([^?#]*)(\?[^#]*)?(#.*)?$"
PARTS = ("scheme", "userinfo", "host", "port", "path", "query", "fragment")
SEPARATOR = "\u0001"
#: The default ports of schemes whose paths are never empty.
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
#: Suffix rules up to this number are broadcast.
FEW_RULES = 100_000
IPV4 = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"
SCHEME = r"^[a-z][a-z0-9+\-.]+(:.*)"
#: A path with a segment of one or two dots, and one that ends with such a segment.
DOTS = r"(?i)^(/|/.*/)(\.|%2e){1,2}(/|$)"
LAST_DOTS = r"(?i)/(\.|%2e){1,2}$"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_dots(path: Column | str) -> Column:
    """A path that begins with a slash, without its segments ``.`` and ``..`` (dots may be encoded as %2e).

    Segments are put on a stack, the text so far: ``..`` takes the last one off, ``.`` leaves it alone. A path that ended with either ends with a slash.
    """
    p = _column(path)

    def step(done: Column, segment: Column) -> Column:
        dots = F.regexp_replace(segment, "(?i)%2e", ".")
        return F.when(dots == "..", F.regexp_replace(done, "/[^/]*$", "")).when(dots == ".", done).otherwise(F.concat(done, F.lit("/"), segment))

    folded = F.aggregate(F.split(F.substring(p, 2, 1 << 30), "/"), F.lit(""), step)
    return F.when(p.rlike(DOTS), F.concat(folded, F.when(p.rlike(LAST_DOTS), "/").otherwise(""))).otherwise(p)


def url_parts(url: Column | str) -> Column:
    """Array of the normalised parts (PARTS) of an absolute URL, null where it is none. One regular expression for all.

    Scheme and host are lower-cased, default ports and empty queries and fragments dropped, an empty path becomes ``/``, dot segments are folded.
    """
    raw = F.split(F.regexp_replace(_column(url), URL, SEPARATOR.join(f"${k}" for k in range(1, 8))), SEPARATOR, -1)

    def normal(p: Column) -> Column:
        scheme = F.lower(p[0])
        special = scheme.isin(*DEFAULT_PORTS)
        default = F.create_map(*[F.lit(x) for pair in DEFAULT_PORTS.items() for x in pair])[scheme]
        port = F.when(default == p[3], "").otherwise(p[3])
        path = F.when(special & (p[4] == ""), "/").otherwise(p[4])
        empty = lambda c, mark: F.when(c == mark, "").otherwise(c)
        return F.array(scheme, p[1], F.lower(p[2]), port, fold_dots(path), empty(p[5], "?"), empty(p[6], "#"))

    return F.when(F.size(raw) == len(PARTS), F.transform(F.array(raw), normal)[0])


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def url_ok(url: Column | str) -> Column:
    """Whether the column forms below cover a URL: false for hosts that are not ASCII or hold encoded characters, and for backslashes."""
    u = _column(url)
    plain = _let(url_parts(u), lambda p: p.isNotNull() & p[2].rlike(r"^[\x21-\x24\x26-\x7e]*$"))
    return F.coalesce(~u.rlike(r"[\\\t\n\r]") & plain, F.lit(False))


def _reversed(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(","))


def _host_part(host: Column) -> Column:
    keep = host.startswith("[") | host.rlike(IPV4)
    return F.when(host == "", "").when(keep, F.concat(host, F.lit("//"))).otherwise(F.concat(_reversed(host), F.lit("//")))


def _userinfo(info: Column) -> Column:
    user, password = F.substring_index(info, ":", 1), F.regexp_extract(info, "^[^:]*:(.*)$", 1)
    return F.when(F.coalesce(user, F.lit("")) == "", "").otherwise(F.concat(F.lit("@"), user, F.when(password != "", F.concat(F.lit(":"), password)).otherwise("")))


def ssurt(url: Column | str) -> Column:
    """Sortable key with all parts: ``com,example,//8080:http@user:pw:/path?q#f``."""
    return _let(url_parts(url), lambda p: F.concat(_host_part(p[2]), p[3], F.lit(":"), p[0], _userinfo(p[1]), F.lit(":"), p[4], p[5], p[6]))


def ssurt_host(url: Column | str) -> Column:
    """Host part of the sortable key: ``com,example,//``."""
    return _let(url_parts(url), lambda p: _host_part(p[2]))


def surt(url: Column | str, include_scheme: bool = False) -> Column:
    """Classic key ``(com,example,)/path?a=1&b=2``: query parameters sorted by name (stable), no fragment."""

    def build(p: Column) -> Column:
        named = F.transform(F.split(F.substring(p[5], 2, 1 << 30), "&"), lambda x, k: F.struct(F.substring_index(x, "=", 1).alias("name"), k.alias("at"), x.alias("item")))
        query = F.when(p[5] == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.transform(F.array_sort(named), lambda x: x["item"]), "&")))
        head = F.concat(p[0], F.lit("://(")) if include_scheme else F.lit("(")
        return F.concat(head, _reversed(p[2]), F.lit(")"), p[4], query)

    return _let(url_parts(url), build)


def split_ssurt(key: Column | str) -> Column:
    """struct<host, psu, path> of a sortable key; psu is port, scheme and userinfo with their colons."""

    def cut(s: Column) -> Column:
        whole, at, rest, slash = s["k"], s["at"], s["rest"], F.locate("/", s["rest"])
        host = F.when(at > 0, F.substring(whole, F.lit(1), at - 1)).otherwise(whole)
        psu = F.when(at == 0, "").when(slash > 0, F.substring(rest, F.lit(1), slash - 1)).otherwise(rest)
        path = F.when(at == 0, "").when(rest == "", "/").when(slash > 0, F.substring(rest, slash, F.length(rest))).otherwise("")
        return F.struct(host.alias("host"), psu.alias("psu"), path.alias("path"))

    def mark(k: Column) -> Column:
        at = F.locate("//", k)
        return F.struct(k.alias("k"), at.alias("at"), F.substring(k, at + 2, F.length(k)).alias("rest"))

    return _let(_let(_column(key), mark), cut)


def desurt_domain(host: Column | str) -> Column:
    """``www.example.com`` of ``com,example,www,``."""
    return F.array_join(F.reverse(F.split(F.btrim(_column(host), F.lit(",")), ",")), ".")


def with_default_scheme(url: Column | str) -> Column:
    """Prepend ``http://`` where no lower-case scheme leads."""
    u = _column(url)
    return F.when(u.rlike(SCHEME), u).otherwise(F.concat(F.lit("http://"), u))


def absolute_location(base: Column | str, location: Column | str) -> Column:
    """A redirect's target. Locations with a scheme stay; others resolve against the base, and dot segments of their paths are folded."""
    to = _column(location)
    path, rest = F.regexp_extract(to, "(?s)^([^?#]*)", 1), F.regexp_extract(to, "(?s)^[^?#]*(.*)$", 1)

    def build(p: Column) -> Column:
        authority = F.concat(p[0], F.lit("://"), F.when(p[1] != "", F.concat(p[1], F.lit("@"))).otherwise(""), p[2], F.when(p[3] != "", F.concat(F.lit(":"), p[3])).otherwise(""))
        folder = F.regexp_replace(p[4], "[^/]*$", "")
        return (
            F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), to)
            .when(to.startswith("//"), F.concat(p[0], F.lit(":"), to))
            .when(to.startswith("/"), F.concat(authority, fold_dots(path), rest))
            .when(to.startswith("?"), F.concat(authority, p[4], to))
            .when(to.startswith("#"), F.concat(authority, p[4], p[5], to))
            .when(to == "", F.concat(authority, p[4], p[5]))
            .otherwise(F.concat(authority, fold_dots(F.concat(folder, path)), rest))
        )

    return _let(url_parts(base), build)


def suffix_rules(lists: DataFrame, text: str = "value", private: bool = True) -> DataFrame:
    """Column rule: the rules of a suffix list in its public format, as ``with_target`` takes them. One row holds one whole list, of some 10,000 lines.

    A rule is a line up to its first white space; ``//`` begins a comment. Names that are not ASCII are given in Punycode. Without ``private``
    the rules between the marks of the private section are left out.
    """
    whole = F.col(text) if private else F.regexp_replace(text, r"(?s)// ===BEGIN PRIVATE DOMAINS===.*?(// ===END PRIVATE DOMAINS===|\z)", "")

    @F.pandas_udf("string")
    def punycode(rules: pd.Series) -> pd.Series:
        return rules.map(lambda r: ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in r.split(".")))

    rule = F.lower(F.regexp_extract("line", r"^\s*(\S*)", 1))
    rules = lists.select(F.explode(F.split(whole, r"\r?\n")).alias("line")).select(rule.alias("rule")).where(~F.col("rule").startswith("//") & (F.col("rule") != ""))
    ascii_ = F.col("rule").rlike(r"^[\x21-\x7e]*$")
    return rules.where(ascii_).unionByName(rules.where(~ascii_).select(punycode("rule").alias("rule"))).distinct()


def with_target(df: DataFrame, suffixes: DataFrame, host: str = "host") -> DataFrame:
    """Add ``target``: the registered domain of a SURT host under a table of suffix rules (column ``rule``), else the domain.

    Rules are public suffixes such as ``com``, ``*.ck`` and ``!www.ck``. Distinct hosts are resolved once. The rules are broadcast if they
    are found to be few, as the public list is.
    """
    rules = suffixes.select("rule").distinct()
    few = rules.limit(FEW_RULES + 1).count() <= FEW_RULES
    hosts = df.select(F.col(host).alias("_host")).distinct()
    labels = F.filter(F.split(F.btrim("_host", F.lit(",")), ","), lambda x: x != "")
    hosts = hosts.withColumn("_labels", labels).withColumn("_ip", F.col("_host").rlike(IPV4) | F.col("_host").startswith("["))
    name = lambda n: F.array_join(F.reverse(F.slice("_labels", F.lit(1), n)), ".")
    each = hosts.where(~F.col("_ip")).select("_host", "_labels", F.explode(F.sequence(F.lit(1), F.greatest(F.size("_labels"), F.lit(1)))).alias("_n"))
    tail = name(F.col("_n"))
    star = F.concat(F.lit("*"), F.when(F.col("_n") > 1, F.concat(F.lit("."), name(F.col("_n") - 1))).otherwise(""))
    candidates = each.select("_host", "_labels", "_n", F.explode(F.array(tail, star, F.concat(F.lit("!"), tail))).alias("rule"))
    hits = candidates.join(F.broadcast(rules) if few else rules, "rule")
    exception = F.col("rule").startswith("!")
    best = hits.groupBy("_host").agg(F.max(F.struct(exception.alias("exception"), F.col("_n").alias("n"))).alias("best"))
    known = hosts.join(best, "_host", "left")
    suffix = F.when(F.col("best.exception"), F.col("best.n") - 1).otherwise(F.col("best.n"))
    suffix = F.coalesce(suffix, F.lit(1))
    domain = desurt_domain("_host")
    target = F.when(F.col("_ip") | (F.size("_labels") <= suffix), domain).otherwise(name(suffix + 1))
    targets = known.select(F.col("_host").alias(host), target.alias("target"))
    return df.join(targets, host, "left")
