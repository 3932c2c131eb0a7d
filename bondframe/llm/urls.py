"""URL filter: host rules, then a path-template tree judged by labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .common import docs_only

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of the tree; what lies deeper counts as part of the last level.
DEPTH = 4
#: A node with more children than this has a variable segment there.
FANOUT = 16
#: Siblings whose bad share lies within so many standard errors are merged.
Z = 2.0
#: Pseudo-rows of the parent's share in a smoothed share.
ALPHA = 8.0
#: A template with a smoothed bad share of this or more is rejected.
REJECT = 0.5
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
VARIABLE = r"[0-9a-fA-F]{8,}|[0-9]+"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null.

    rules: (verdict, "domain/path") pairs. A rule fits its domain and all
    subdomains when the path starts with the rule's.
    """
    found = []
    for verdict, rule in rules:
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*found)) if found else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def _share(bad: Column, n: Column, parent: Column) -> Column:
    return (bad + parent * ALPHA) / (n + F.lit(ALPHA))


def template_tree(paths: DataFrame) -> DataFrame:
    """(host, shape, template, bad_share) of every distinct path shape.

    ``paths``: host, shape, n (rows), labelled, bad, one row per host and
    shape. Level by level from the host down, a node's children are
    generalised to "*" when they are variable (the node has over FANOUT
    children and this one less than one FANOUT-th of its rows) or when their
    bad share lies within Z standard errors of the siblings' pooled share;
    generalised siblings become one branch, so their subtrees merge. A
    template's share is smoothed by its host's, that by the whole table's.
    """
    total = paths.agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l")).select(F.coalesce((F.col("b") + 1.0) / (F.col("l") + 2.0), F.lit(0.5)).alias("share"))
    segs = F.split(F.col("shape"), "/", DEPTH + 1)
    tree = paths.withColumn("segs", segs).withColumn("template", F.lit(""))
    for level in range(1, DEPTH + 1):
        seg = F.get("segs", F.lit(level))
        tree = tree.withColumn("seg", seg)
        kids = tree.filter("seg IS NOT NULL").groupBy("host", "template", "seg").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        kids = cut(kids, "url-kids")
        nodes = kids.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("l").alias("all_l"), F.sum("b").alias("all_b"), F.count("*").alias("fan"))
        pooled = (F.col("all_b") + 1.0) / (F.col("all_l") + 2.0)
        # |b - l p| <= Z sqrt(l p (1 - p)), without a division by l
        alike = F.abs(F.col("b") - F.col("l") * pooled) <= F.lit(Z) * F.sqrt(F.col("l") * pooled * (F.lit(1.0) - pooled))
        variable = (F.col("fan") > FANOUT) & (F.col("n") * FANOUT < F.col("all_n"))
        named = kids.join(nodes, ["host", "template"]).select("host", "template", "seg", F.when(variable | alike, F.lit("*")).otherwise(F.col("seg")).alias("name"))
        tree = tree.join(named, ["host", "template", "seg"], "left")
        tree = tree.withColumn("template", F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name")))
        tree = cut(tree.drop("seg", "name"), "url-tree")
    leaf = tree.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    hosts = tree.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    hosts = hosts.crossJoin(F.broadcast(total)).select("host", _share(F.col("hb"), F.col("hl"), F.col("share")).alias("host_share"))  # total is one row
    leaf = leaf.join(hosts, "host").select("host", "template", _share(F.col("b"), F.col("l"), F.col("host_share")).alias("bad_share"))
    return tree.select("host", "shape", "template").join(leaf, ["host", "template"])


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, bad_share) of every page.

    ``labels``: (key bigint, bad int); a page is labelled when the last
    number in its path is a key (rows of one key count as one, bad if any
    is; null keys or marks are ignored). A rule's verdict holds, else a page
    is blocked when its template's smoothed bad share is REJECT or more.
    Null urls and urls without "://" have empty host and path and share one
    template. Repeated rows stay; an empty table gives an empty result.
    """
    p = docs_only(pages, page_id="bigint", url="string")
    p = p.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.select("*", F.regexp_replace("path", VARIABLE, "#").alias("shape"), F.expr(r"try_cast(regexp_extract(path, '.*?([0-9]{1,18})[^0-9]*$', 1) AS bigint)").alias("key"))
    l = docs_only(labels, key="bigint", bad="int").filter("key IS NOT NULL AND bad IS NOT NULL").groupBy("key").agg(F.max("bad").alias("bad"))
    p = cut(p.join(l, "key", "left").drop("key"), "url-pages")
    paths = p.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = template_tree(cut(paths, "url-paths"))
    out = p.join(tree, ["host", "shape"]).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bad_share") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), "template", "bad_share")
