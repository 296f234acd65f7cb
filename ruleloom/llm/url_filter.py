"""URL filters by a path-template tree, in DataFrame functions only.

Each host's paths form a tree. A first segment that is frequent on its host, or
found there on many hosts, stays literal and names a branch; below it a segment
that is frequent at its level of the branch, or found at that level on many
hosts, stays literal; all others become wildcards, at every depth. A template
is the path so generalised, and its prefixes are the tree's inner nodes.

Rules label the urls they fit. A host's labels speak for a template, or an
inner node, where they cover at least half of its urls; a few that a narrow
rule picks out say nothing about the others. Sibling templates of one shape
(literals as wildcards) whose block rates do not differ significantly from
their pooled rate are merged and share their counts. The same branch on
different hosts is one branch of the tree of all hosts, where each host whose
labels speak has one vote, its block rate, so that no hot host outvotes others.

A template's purity is its block rate, smoothed by the votes of the same
template on all hosts, those by the votes of the prefix above, and so on up to
the share in all labels. Templates at or above the limit are rejected; where a
host has no labels of its own, the votes of others decide.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.plans.durable import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A literal segment has at least so many urls and one in PART of its branch's urls at its level, or so many hosts and one in PART of all.
LEAST, LEAST_HOSTS, PART = 3, 8, 20
#: Weight of the prior in labelled urls or hosts, the limit of purity, and of |z| for siblings that merge.
PRIOR, REJECT, Z = 4.0, 0.8, 1.96
#: Block rates are summed as millionths, so that reruns agree.
UNIT = 1_000_000
#: Rows of a table that are sent to every executor at most; more are joined by a shuffle.
SEND_ROWS = 200_000


@dataclass(frozen=True)
class Rule:
    """Fits the host and its subdomains where the path starts with ``path``; written host + path."""

    verdict: str
    host: str
    path: str = "/"


RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: str | Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: str | Column) -> Column:
    """From the host's end up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fitting(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null; of equally long ones the first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SEND_ROWS else df


def _literals(here: DataFrame, hosts: int) -> DataFrame:
    """(host, branch, level, seg) of the segments that stay literal."""
    counts = materialize(here.groupBy("host", "branch", "level", "seg").agg(F.count("*").alias("n")), "op3-segments")
    common = counts.select("host", "level", "seg").distinct().groupBy("level", "seg").agg(F.count("*").alias("hosts"))
    common = common.where((F.col("hosts") >= LEAST_HOSTS) & (F.col("hosts") * PART >= hosts))
    every = counts.groupBy("host", "branch", "level").agg(F.sum("n").alias("every"))
    keep = counts.join(common, ["level", "seg"], "left").where((F.col("n") >= LEAST) | F.col("hosts").isNotNull()).join(every, ["host", "branch", "level"])
    return materialize(keep.where((F.col("n") * PART >= F.col("every")) | F.col("hosts").isNotNull()).select("host", "branch", "level", "seg"), "op3-literals")


def templates(urls: DataFrame) -> DataFrame:
    """``urls`` (with host, path) and ``template``, of literal and wildcard segments; empty for a path without segments."""
    rows = urls.withColumn("_segs", F.filter(F.split("path", "/"), lambda x: x != "")).withColumn("_row", F.monotonically_increasing_id())
    rows = materialize(rows, "op3-rows")
    hosts = rows.select("host").distinct().count()
    first = rows.select("_row", "host", F.lit("").alias("branch"), F.lit(0).alias("level"), F.get("_segs", F.lit(0)).alias("seg")).where("seg is not null")
    keep = _literals(first, hosts).select("host", F.col("seg").alias("_first"), F.lit(True).alias("_is"))
    head = F.when(F.size("_segs") == 0, "").when(F.col("_is"), F.col("_first")).otherwise("*")
    rows = rows.withColumn("_first", F.get("_segs", F.lit(0))).join(_sent(keep), ["host", "_first"], "left").withColumn("branch", head).drop("_first", "_is")
    rows = materialize(rows, "op3-branches")
    below = rows.where("size(_segs) > 1").select("_row", "host", "branch", F.posexplode("_segs").alias("level", "seg")).where("level > 0")
    keep = _literals(below, hosts).withColumn("_is", F.lit(True))
    pieces = below.join(_sent(keep), ["host", "branch", "level", "seg"], "left")
    pieces = pieces.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("level", F.when(F.col("_is"), F.col("seg")).otherwise("*").alias("piece")))).alias("_rest"))  # one url's segments
    rest = F.coalesce(F.array_join(F.concat(F.array(F.lit("")), F.col("_rest.piece")), "/"), F.lit(""))
    rows = rows.join(pieces, "_row", "left").withColumn("template", F.when(F.size("_segs") == 0, "").otherwise(F.concat(F.lit("/"), "branch", rest)))
    return rows.drop("_segs", "_row", "_rest", "branch")


def prefixes(template: Column) -> Column:
    """The template's prefixes with their lengths, from the root, empty, to itself."""
    parts = F.filter(F.split(template, "/"), lambda x: x != "")
    upto = lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, F.greatest(k, F.lit(1))), "/")))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("length"), upto(k).alias("prefix")))


def purities(nodes: DataFrame) -> DataFrame:
    """(host, template, purity) from (host, template, told, bad, urls), one row a host and template."""
    overall = nodes.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("told")), F.lit(0.0))).first()[0]
    speaks = (F.col("told") > 0) & (F.col("told") * 2 >= F.col("urls"))
    inner = nodes.select("host", "told", "bad", "urls", F.explode(prefixes(F.col("template"))).alias("x")).groupBy("host", F.col("x.prefix").alias("prefix"))
    inner = inner.agg(*(F.sum(c).alias(c) for c in ("told", "bad", "urls"))).where(speaks)
    votes = inner.groupBy("prefix").agg(F.sum(F.expr(f"bad * {UNIT} div told")).alias("rates"), F.count("*").alias("voters"))
    paths = nodes.select("template").distinct().select("template", F.explode(prefixes(F.col("template"))).alias("x")).select("template", "x.length", "x.prefix")
    chain = paths.join(votes, "prefix", "left").where("voters is not null").groupBy("template").agg(F.array_sort(F.collect_list(F.struct("length", "rates", "voters"))).alias("chain"))  # one entry a segment
    smooth = F.aggregate("chain", F.lit(overall), lambda p, x: (x["rates"] / F.lit(UNIT) + p * PRIOR) / (x["voters"] + F.lit(PRIOR)))
    priors = chain.select("template", smooth.alias("prior"))

    # siblings near their pooled rate merge; the others keep to themselves
    shape = F.regexp_replace("template", "/[^/]+", "/*")
    heard = nodes.where(speaks).select("host", "template", "told", "bad", shape.alias("shape"))
    pooled = heard.groupBy("host", "shape").agg((F.sum("bad") / F.sum("told")).alias("rate"))
    p = F.col("rate")
    spread = F.sqrt(F.greatest(p * (1 - p), F.lit(1e-4)) / F.col("told"))
    heard = heard.join(pooled, ["host", "shape"]).withColumn("merged", F.when(F.abs(F.col("bad") / F.col("told") - p) <= Z * spread, "").otherwise(F.col("template")))
    pools = heard.groupBy("host", "shape", "merged").agg(F.sum("bad").alias("b"), F.sum("told").alias("t"))
    heard = heard.join(pools, ["host", "shape", "merged"]).select("host", "template", "b", "t")
    out = nodes.select("host", "template").join(priors, "template", "left").join(heard, ["host", "template"], "left")
    purity = (F.coalesce("b", F.lit(0)) + F.coalesce("prior", F.lit(overall)) * PRIOR) / (F.coalesce("t", F.lit(0)) + F.lit(PRIOR))
    return out.select("host", "template", F.round(purity, 6).alias("purity"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, template, purity) for every row of ``pages``.

    verdict is that of the longest fitting rule, else block or allow by the
    purity of the url's template. A null url, or one without ://, has an empty
    host, path and template; repeated rows and null ids stay; other columns are
    ignored. Without any labelled url purity is 0 and everything is allowed.
    """
    rows = pages.select(F.col(id_col).alias("id"), host(url_col).alias("host"), path(url_col).alias("path"))
    rows = rows.withColumn("fit", fitting(rules, F.col("host"), F.col("path"))).select("id", "host", "path", "fit.rule", F.col("fit.verdict").alias("given"))
    rows = materialize(templates(rows), "op3-templates")
    told = F.col("given").isNotNull().cast("long")
    bad = F.coalesce((F.col("given") == "block").cast("long"), F.lit(0).cast("long"))
    nodes = materialize(rows.groupBy("host", "template").agg(F.sum(told).alias("told"), F.sum(bad).alias("bad"), F.count("*").alias("urls")), "op3-nodes")
    judged = materialize(purities(nodes), "op3-purities")
    out = rows.join(_sent(judged), ["host", "template"])
    verdict = F.coalesce("given", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
