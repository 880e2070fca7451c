"""URL filter: rules first, then a tree of path templates per host with labelled purity.

The tree is built level by level. A path segment stays as it is if it is frequent below its parent; the others become a
wildcard of their shape (digits, hexadecimal, any word, each with its file ending). At every level, sibling branches stand in
order of their labelled shares of good pages, and neighbours that are statistically alike (two-proportion test) are merged into one
branch ``{any0}``, ``{any1}``, ..., below which the tree goes on: bad siblings join each other, and good ones. The purity of a branch is its labelled share of good pages, smoothed
by that of its parent, the host's by that of all; a template is rejected if its purity falls below a threshold.

Every statistic counts all pages. A hot host is pre-aggregated by path segment before it is shuffled, and the few names
below a parent are copied over ``SALTS`` parts in the joins, so no task gets all pages of a host.

Defined results: a null url, or one without ``://``, has empty host and path and is judged with all such pages; urls of
any length are read whole, and segments beyond ``max_depth`` count as one; repeated urls count each; a page whose path
names no document is unlabelled; an empty table gives none; without labels nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlstrata.llm.common import stash, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of the query: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
SALTS = 8
#: Parents with more than one of this many segments are joined by broadcast; there are fewer than this many.
HOT_SHARE = 1000
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: str) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path(url: str) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def matching_rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null. A rule fits its host and all subdomains."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shape(segment: Column) -> Column:
    """The wildcard of a segment."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    kind = F.when(stem.rlike("^[0-9]+$"), "{number}").when(stem.rlike("^[0-9a-fA-F-]{8,}$"), "{hex}").otherwise("{word}")
    return F.concat(kind, ending)


def _salted(rows: DataFrame, few: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with a table of few rows for each parent; a hot key is dealt over ``SALTS`` parts."""
    few = few.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return rows.join(few, [*on, "_salt"], how)


def _with_totals(counts: DataFrame) -> DataFrame:
    """Counts of segments with ``all_n``, the pages of all segments of their parent.

    A parent with more than a thousandth of all segments (there are fewer than a thousand) is joined by broadcast, so that no task gets all of one.
    """
    totals = stash(counts.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.count("*").alias("_segments")))
    bound = (totals.agg(F.sum("_segments")).first()[0] or 0) / HOT_SHARE
    hot = totals.where(F.col("_segments") > bound).drop("_segments")
    cold = totals.where(F.col("_segments") <= bound).drop("_segments")
    both = ["host", "template"]
    return counts.join(F.broadcast(hot), both).unionByName(counts.join(F.broadcast(hot.select(*both)), both, "left_anti").join(cold, both))


def merged(branches: DataFrame, alike: float) -> DataFrame:
    """Columns host, template, _name, _branch, _labelled, _good: sibling branches (host, template, _name, labelled, good) in groups of alike ones.

    Labelled siblings stand in order of their share of good pages; neighbours are told apart by a two-proportion test, and those that are not
    are one branch ``{any}``, numbered from the worst. Unlabelled ones stay as they are.
    """
    share = F.col("good") / F.col("labelled")
    order = Window.partitionBy("host", "template").orderBy("_share", "_name")
    known = branches.where("labelled > 0").withColumn("_share", share)
    known = known.withColumn("_l", F.lag("labelled").over(order)).withColumn("_g", F.lag("good").over(order))
    p = (F.col("good") + F.col("_g")) / (F.col("labelled") + F.col("_l"))
    spread = F.sqrt(p * (1 - p) * (1 / F.col("labelled") + 1 / F.col("_l")))
    z = (F.col("_share") - F.col("_g") / F.col("_l")) / F.when(spread > 0, spread)
    known = known.withColumn("_new", F.coalesce((z >= alike).cast("int"), F.lit(0)))
    known = known.withColumn("_group", F.sum("_new").over(order))
    group = Window.partitionBy("host", "template", "_group")
    several = F.count("*").over(group) > 1
    any_ = F.concat(F.lit("{any"), F.col("_group").cast("string"), F.lit("}"))
    known = known.select("host", "template", "_name", F.when(several, any_).otherwise(F.col("_name")).alias("_branch"), F.sum("labelled").over(group).alias("_labelled"), F.sum("good").over(group).alias("_good"))
    zero = F.lit(0).cast("long")
    rest = branches.where("labelled = 0").select("host", "template", "_name", F.col("_name").alias("_branch"), zero.alias("_labelled"), zero.alias("_good"))
    return known.unionByName(rest)


def grow(paths: DataFrame, max_depth: int = 8, least_share: float = 0.02, least_count: int = 8, alike: float = 1.96, weight: float = 10.0) -> DataFrame:
    """Add ``template`` (array of strings) and ``purity`` to rows with id, host, path and good (0, 1 or null).

    Paths deeper than ``max_depth`` keep their remaining segments as one, so nothing is left out.
    """
    sums = [F.count("*").alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")]
    add = [F.sum(c).alias(c) for c in ("n", "labelled", "good")]
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rest = F.array_join(F.slice("_all", F.lit(max_depth), F.size("_all")), "/")
    rows = paths.withColumn("_all", segments).withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    rows = rows.withColumn("_all", F.when(F.size("_all") > max_depth, F.concat(F.slice("_all", 1, max_depth - 1), F.array(rest))).otherwise(F.col("_all")))
    rows = stash(rows.withColumn("template", F.array().cast("array<string>")))
    depth, n, good = rows.agg(F.coalesce(F.max(F.size("_all")), F.lit(0)), F.count("good"), F.coalesce(F.sum("good"), F.lit(0))).first()
    prior = (good + 1) / (n + 1)
    hosts = rows.groupBy("host").agg(*sums).select("host", ((F.col("good") + weight * F.lit(prior)) / (F.col("labelled") + weight)).alias("purity"))
    rows = _salted(rows, hosts, ["host"], "inner")
    for level in range(1, depth + 1):
        here = F.try_element_at("_all", F.lit(level))
        counts = stash(rows.where(here.isNotNull()).groupBy("host", "template", here.alias("_segment")).agg(*sums))
        counts = _with_totals(counts)
        often = (F.col("n") >= least_count) & (F.col("n") >= F.col("all_n") * least_share)
        kept = counts.where(often).select("host", "template", "_segment", F.col("_segment").alias("_literal"))
        branches = counts.withColumn("_name", F.when(often, F.col("_segment")).otherwise(shape(F.col("_segment")))).groupBy("host", "template", "_name").agg(*add)
        branches = merged(branches, alike)
        rows = _salted(rows.withColumn("_segment", here), kept, ["host", "template", "_segment"], "left")
        rows = _salted(rows.withColumn("_name", F.coalesce("_literal", shape(F.col("_segment")))), branches, ["host", "template", "_name"], "left")
        deeper = F.col("_branch").isNotNull()
        rows = rows.withColumn("template", F.when(deeper, F.concat("template", F.array("_branch"))).otherwise(F.col("template")))
        rows = rows.withColumn("purity", F.when(deeper, (F.col("_good") + weight * F.col("purity")) / (F.col("_labelled") + weight)).otherwise(F.col("purity")))
        rows = rows.drop("_segment", "_literal", "_name", "_branch", "_labelled", "_good")
        if level < depth:
            rows = stash(rows)
    return rows.drop("_all", "_salt")


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Columns: id, host, path, rule, template, purity, verdict.

    ``labels`` has doc (the number that a page's path ends in) and good (0 or 1).
    """
    urls = pages.select(F.col(id_col).alias("_id"), host(url_col).alias("host"), path(url_col).alias("path"))
    number = F.regexp_extract("path", r"([0-9]{1,18})(?:\.[A-Za-z]{1,5})?/?$", 1)
    # Pages that name no document get one of many keys that no document has.
    urls = urls.withColumn("_doc", F.when(number != "", number.cast("long")).otherwise(-1 - F.pmod(F.xxhash64("_id", "path"), F.lit(1 << 20))))
    known = labels.where(F.col("doc") >= 0).groupBy(F.col("doc").alias("_doc")).agg(F.min("good").alias("good"))
    rows = grow(urls.join(known, "_doc", "left"))
    judged = rows.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("purity") < threshold, "block").otherwise("allow"))
    return judged.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), F.concat_ws("/", "template").alias("template"), "purity", verdict.alias("verdict"))


def op4_path_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page. A page is good if the document that its path names is of quality 1 and not toxic."""
    labels = table(spark, sf_dir, "labels")
    good = labels.where("quality is not null and toxic is not null").select(F.col("doc_id").alias("doc"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    return judge(table(spark, sf_dir, "pages"), good).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op4_path_template_tree": op4_path_template_tree}


def _oracle(max_depth: int = 8) -> str:
    """The query in SQL, with one round of statements for each level of the tree."""
    seg = "t.segs[{k}]"
    shape_sql = "case when regexp_matches({s}, '^[0-9]+$') then '{{number}}' when regexp_matches({s}, '^[0-9a-fA-F-]{{8,}}$') then '{{hex}}' else '{{word}}' end || regexp_extract({seg}, '(\\.[A-Za-z]{{1,5}})$', 1)"
    levels = []
    for k in range(1, max_depth + 1):
        here = seg.format(k=k)
        wild = shape_sql.format(s=f"regexp_replace({here}, '\\.[A-Za-z]{{1,5}}$', '')", seg=here)
        levels.append(f"""c{k} as (select host, template, segs[{k}] as seg, count(*) as n from t{k - 1} where len(segs) >= {k} group by all),
f{k} as (select c.host, c.template, c.seg from c{k} c join (select host, template, sum(n) as total from c{k} group by all) s on s.host = c.host and s.template = c.template where c.n >= 8 and c.n >= s.total * 0.02),
n{k} as (select t.*, case when len(t.segs) >= {k} then case when f.seg is not null then {here} else {wild} end end as name
 from t{k - 1} t left join f{k} f on f.host = t.host and f.template = t.template and f.seg = {here}),
b{k} as (select host, template, name, count(good) as l, coalesce(sum(good), 0) as g from n{k} where name is not null group by all),
a{k} as (select *, g / l as share, lag(l) over w as pl, lag(g) over w as pg from (select *, g / l as sh from b{k} where l > 0) window w as (partition by host, template order by sh, name)),
z{k} as (select *, (g + pg) / (l + pl) as p from a{k}),
s{k} as (select *, coalesce(case when (share - pg / pl) / nullif(sqrt(p * (1 - p) * (1 / l + 1 / pl)), 0) >= 1.96 then 1 else 0 end, 0) as new from z{k}),
g{k} as (select *, sum(new) over (partition by host, template order by share, name) as grp from s{k}),
r{k} as (select host, template, name, case when count(*) over v > 1 then '{{any' || cast(grp as varchar) || '}}' else name end as branch, sum(l) over v as l, sum(g) over v as g from g{k} window v as (partition by host, template, grp)
 union all select host, template, name, name, 0, 0 from b{k} where l = 0),
t{k} as (select n.page_id, n.host, n.path, n.good, n.segs, case when n.name is null then n.template else list_append(n.template, r.branch) end as template, case when n.name is null then n.purity else (r.g + 10.0 * n.purity) / (r.l + 10.0) end as purity
 from n{k} n left join r{k} r on r.host = n.host and r.template = n.template and r.name = n.name)""")
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then " for h, p, _ in rules]
    rule = "case " + " ".join(f"{f}'{h}{p}'" for f, (h, p, _) in zip(fits, rules, strict=True)) + " end"
    verdict = "case " + " ".join(f"{f}'{v}'" for f, (*_, v) in zip(fits, rules, strict=True)) + " end"
    return f"""with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(coalesce(url, ''), '{PARTS}', 2) as path from pages),
known as (select doc_id as doc, min(case when quality = 1 and toxic = 0 then 1 else 0 end) as good from labels where quality is not null and toxic is not null and doc_id >= 0 group by doc_id),
s as (select u.*, known.good, list_filter(string_split(path, '/'), lambda x: x <> '') as every from u left join known on known.doc = try_cast(nullif(regexp_extract(path, '([0-9]{{1,18}})(?:\\.[A-Za-z]{{1,5}})?/?$', 1), '') as bigint)),
hosts as (select host, (coalesce(sum(good), 0) + 10.0 * (select (coalesce(sum(good), 0) + 1) / (count(good) + 1) from s)) / (count(good) + 10.0) as purity from s group by host),
t0 as (select page_id, s.host, path, good, case when len(every) > {max_depth} then list_append(every[1:{max_depth - 1}], array_to_string(every[{max_depth}:], '/')) else every end as segs, cast([] as varchar[]) as template, purity from s join hosts on hosts.host = s.host),
{(","+chr(10)).join(levels)}
select page_id, host, path, {rule} as rule, coalesce({verdict}, case when purity < 0.5 then 'block' else 'allow' end) as verdict from t{max_depth}"""


ORACLE_SQL = {"op4_path_template_tree": _oracle()}
