import calendar
import itertools
from datetime import datetime, timedelta, timezone

from crawlstrata.functions import keys, times, urls

#: Scheme, its default port, user, host, its sortable form, port, and the rest of a URL: every combination is tried.
SCHEMES = [("http", "80"), ("https", "443"), ("gemini", "")]
USERS = ["", "ann", "ann:s3cret"]
HOSTS = [("pear.net", "net,pear,"), ("Old.PEAR.net", "net,pear,old,"), ("7.pear.net", "net,pear,7,"), ("10.1.2.3", "10.1.2.3"), ("[2001:db8::5]", "[2001:db8::5]")]
PORTS = ["", "default", "8443"]
RESTS = [("", "/"), ("/", "/"), ("/Pick/ripe?kind=a&b", "/Pick/ripe?kind=a&b"), ("/x?y#z", "/x?y#z")]


def combinations():
    """(URL, host, port and scheme and user, path) by the rules: labels turned round, a default port and an empty user left out."""
    for (scheme, usual), user, (host, turned), port, (rest, path) in itertools.product(SCHEMES, USERS, HOSTS, PORTS, RESTS):
        if not rest and scheme == "gemini" or port == "default" and not usual:
            continue
        number = usual if port == "default" else port
        url = f"{scheme}://{user}{'@' * bool(user)}{host}{':' * bool(number)}{number}{rest}"
        yield url, turned, f"{'' if port == 'default' else port}:{scheme}{'@' * bool(user)}{user}:", path


def column(spark, rows, expression):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"c{j} string" for j in range(len(rows[0]))))
    return [r[0] for r in df.select("k", expression.alias("v")).orderBy("k").select("v").collect()]


def test_ssurt(spark):
    every = list(combinations())
    assert len(every) > 300
    assert column(spark, [(u,) for u, *_ in every], urls.ssurt("c0")) == [f"{host}//{psu}{path}" for _, host, psu, path in every]
    assert column(spark, [("pear net",), (None,)], urls.ssurt("c0")) == [None, None]


def test_surt(spark):
    """Labels turned round in brackets, addresses too; the query sorted by name and stable; no fragment; the scheme if asked for."""
    rows = [
        ("https://old.pear.net:443", "(net,pear,old,)/", "https://"),
        ("http://10.1.2.3/a/b", "(3,2,1,10,)/a/b", "http://"),
        ("http://[2001:db8::5]/a", "([2001:db8::5],)/a", "http://"),
        ("http://pear.net/a?z=1&m=2&a=3&m=1#top", "(net,pear,)/a?a=3&m=2&m=1&z=1", "http://"),
    ]
    assert column(spark, [(u,) for u, *_ in rows], urls.surt("c0")) == [w for _, w, _ in rows]
    assert column(spark, [(u,) for u, *_ in rows], urls.surt("c0", True)) == [f"{scheme}{w}" for _, w, scheme in rows]


def test_split_ssurt(spark):
    every = [(f"{host}//{psu}{path}", (host, psu, path)) for _, host, psu, path in combinations()]
    every += [("net,pear,", ("net,pear,", "", "")), ("net,pear,//", ("net,pear,", "", "/")), ("net,pear,//8:x:", ("net,pear,", "8:x:", ""))]
    assert [tuple(r) for r in column(spark, [(u,) for u, _ in every], urls.split_ssurt("c0"))] == [w for _, w in every]


def test_desurt(spark):
    assert column(spark, [("test,example,",), ("test,example,www,",), (",,test,example,",)], urls.desurt_domain("c0")) == ["example.test", "www.example.test", "example.test"]


def test_key(spark):
    """Parts of a key are put together and taken apart again; those that are missing are empty."""
    rows = []
    for k, (_, host, psu, path) in enumerate(combinations()):
        at = datetime(2011, 3, 4, 5, 6, 7, tzinfo=timezone.utc) + timedelta(days=37 * k)
        port, _, rest = psu.partition(":")
        scheme, _, user = rest.removesuffix(":").partition("@")
        rows.append((f"{host}{path} {at:%Y%m%d%H%M%S} {psu} response", (host, path, f"{at:%Y%m%d%H%M%S}", int(at.timestamp()), port, scheme, user, psu, "response")))
    rows = [r for r in rows if r[1][0].endswith(",")]
    rows.append(("net,pear,/q 20110304050607", ("net,pear,", "/q", "20110304050607", 1299215167, "", "", "", "", "")))
    assert [tuple(r) for r in column(spark, [(u,) for u, _ in rows], keys.parse_cdx_key("c0"))] == [w for _, w in rows]


def test_ranges(spark):
    """A prefix of 14 digits stands for its first and its last second."""
    rows = []
    for text in ("2004", "200402", "200302", "201012", "20121231", "2012063023", "201206302359", "20120630235958"):
        fields = [int(text[:4]), *(int(text[k : k + 2]) for k in range(4, len(text), 2))]
        first = datetime(*(fields + [1] * max(0, 3 - len(fields))), tzinfo=timezone.utc)
        step = {4: 366 if calendar.isleap(first.year) else 365, 6: calendar.monthrange(first.year, first.month)[1], 8: 1}.get(len(text), 0) * 86400 or {10: 3600, 12: 60, 14: 1}[len(text)]
        rows.append((text, int(first.timestamp()), int(first.timestamp()) + step - 1))
    rows += [(bad, None, None) for bad in ("20041", "2012063023595", "20O4", " ", "")]
    texts = [(t,) for t, *_ in rows]
    assert column(spark, texts, times.range_start("c0")) == [a for _, a, _ in rows]
    assert column(spark, texts, times.range_end("c0")) == [b for *_, b in rows]


def test_rfc3339(spark):
    assert column(spark, [("2011-09-30T21:08:55Z",), ("2011-09-30T21:08:55.5+01:00",), ("nonsense",)], times.rfc3339_to14("c0")) == ["20110930210855", "20110930200855", None]


def test_refs(spark):
    rows = [("warcfile:a.warc.gz#12", ("warcfile", "a.warc.gz", 12)), ("warcfile:a.warc.gz#0x1f", ("warcfile", "a.warc.gz", None)), ("bad", ("", "", None))]
    assert [tuple(r) for r in column(spark, [(u,) for u, _ in rows], keys.parse_ref("c0"))] == [w for _, w in rows]


def test_locations(spark):
    base = "http://u:p@example.com:81/a/b?q#f"
    rows = [("https://x.org/", "https://x.org/"), ("//x.org/c", "http://x.org/c"), ("/c", "http://u:p@example.com:81/c"), ("?z", "http://u:p@example.com:81/a/b?z"), ("#z", "http://u:p@example.com:81/a/b?q#z"), ("c", "http://u:p@example.com:81/a/c"), ("", "http://u:p@example.com:81/a/b?q")]
    assert column(spark, [(base, t) for t, _ in rows], urls.absolute_location("c0", "c1")) == [w for _, w in rows]


def fold(path):
    """Dot segments by a stack."""
    stack, parts = [], path.split("/")[1:]
    for k, x in enumerate(parts):
        dots = x.lower().replace("%2e", ".")
        if dots == "..":
            stack[-1:] = []
        elif dots != ".":
            stack.append(x)
        if dots in (".", "..") and k == len(parts) - 1:
            stack.append("")
    return "/" + "/".join(stack)


def test_dot_segments(spark):
    """All paths of up to four of these segments, in URLs and as locations."""
    every = ["/" + "/".join(p) for n in range(1, 5) for p in itertools.product(["", ".", "..", "a", "%2E.", "..b", ".%2e%2e"], repeat=n)]
    assert len(every) > 2500 and fold("/a/../../b/.") == "/b/"
    assert column(spark, [(p,) for p in every], urls.fold_dots("c0")) == [fold(p) for p in every]
    some = [p for p in every if not p.startswith("//")][::7]
    assert column(spark, [(f"http://pear.net{p}?x=/../y#/./z",) for p in some], urls.ssurt("c0")) == [f"net,pear,//:http:{fold(p)}?x=/../y#/./z" for p in some]
    base = "http://pear.net/k/m/n?q"
    assert column(spark, [(base, f"{p}?x=/../y") for p in some], urls.absolute_location("c0", "c1")) == [f"http://pear.net{fold(p)}?x=/../y" for p in some]
    relative = [p[1:] for p in some if p[1:]]
    assert column(spark, [(base, f"{p}#/../y") for p in relative], urls.absolute_location("c0", "c1")) == [f"http://pear.net{fold('/k/m/' + p)}#/../y" for p in relative]
    assert column(spark, [("mailto:a/../b",)], urls.ssurt("c0")) == [":mailto:a/../b"]


def test_suffix_list(spark):
    text = "// a comment\n// ===BEGIN ICANN DOMAINS===\ncom\nCO.uk  trailing words\n\n*.ck\r\n!www.ck\n\u516c\u53f8.cn\n// ===END ICANN DOMAINS===\n// ===BEGIN PRIVATE DOMAINS===\npages.dev\n// ===END PRIVATE DOMAINS===\nnet\n"
    lists = spark.createDataFrame([(text,)], "value string")
    public = {"com", "co.uk", "*.ck", "!www.ck", "xn--55qx5d.cn", "net"}
    assert {r["rule"] for r in urls.suffix_rules(lists).collect()} == public | {"pages.dev"}
    assert {r["rule"] for r in urls.suffix_rules(lists, private=False).collect()} == public
    assert urls.suffix_rules(lists.limit(0)).collect() == []


def test_many_rules_are_not_broadcast(spark, monkeypatch):
    rules = spark.createDataFrame([("com",), ("uk",), ("co.uk",)], "rule string")
    df = spark.createDataFrame([("uk,co,bbc,news,",)], "host string")
    monkeypatch.setattr(urls, "FEW_RULES", 2)
    found = urls.with_target(df, rules)
    assert [r["target"] for r in found.collect()] == ["bbc.co.uk"]


def test_default_scheme(spark):
    rows = [("example.com/", "http://example.com/"), ("localhost:8080/", "localhost:8080/"), ("HTTP://x", "http://HTTP://x"), ("https://x", "https://x")]
    assert column(spark, [(u,) for u, _ in rows], urls.with_default_scheme("c0")) == [w for _, w in rows]


def test_targets(spark):
    rules = spark.createDataFrame([("com",), ("uk",), ("co.uk",), ("*.ck",), ("!www.ck",)], "rule string")
    hosts = {"com,example,www,": "example.com", "uk,co,bbc,news,": "bbc.co.uk", "uk,co,": "co.uk", "ck,other,a,b,": "a.other.ck", "ck,www,a,": "www.ck", "127.0.0.1": "127.0.0.1", "zz,q,a,": "q.zz"}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r["host"]: r["target"] for r in urls.with_target(df, rules).collect()} == hosts


def test_url_ok(spark):
    assert column(spark, [("http://a.com/",), ("http://bücher.de/",), ("http://a.com/%2e%2e/b",), ("http://a%2ecom/",), ("http:\\\\a",)], urls.url_ok("c0")) == [True, False, True, False, False]
