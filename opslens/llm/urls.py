"""URL filter: explicit rules first, then a path-template tree per host judged by labelled purity.

The tree of a host is grown from the root, one path segment a level.  Under a node, a segment is *variable* if
the node's children are many and thin (at least ``many`` different ones with fewer than ``thin`` pages each on
average); variable segments become a wildcard that keeps the segment's shape, digits as 0 and letters as a.

Labels flow down the tree.  A branch of ``weight`` labels or more that differ significantly from its parent's has its
own purity, smoothed towards the parent's.  The other siblings with labels are pooled: in one pool, or in two, below
and above their common share, if they scatter about it more than chance has it.  A pool that differs from the parent gives
its smoothed purity to all its branches; one that does not takes the parent's, as a branch without labels does.
A page is blocked if the purity of its template, the share of good labels, lies below ``least``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import staged

#: Levels of the tree; what follows of a path is one more segment.
LEVELS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; rules: (verdict, host, path)."""
    rule = verdict = F.lit(None).cast("string")
    for said, of, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule = F.when(fits, of + start).otherwise(rule)
        verdict = F.when(fits, said).otherwise(verdict)
    return rule, verdict


def shape(segment: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(segment, "[0-9]+", "0"), r"[^0./_-]+", "a")
    # A segment of many parts has one shape, however many they are.
    return F.concat(F.lit("*"), F.when(F.length(plain) <= 12, plain).otherwise("..."))


def templates(pages: DataFrame, host_col: str, path_col: str, many: int = 8, thin: float = 4.0) -> DataFrame:
    """``pages`` with ``nodes``, the template prefixes of each page from its host's root to its leaf."""
    parts = F.filter(F.split(F.col(path_col), "/", LEVELS + 2), lambda s, i: i > 0)
    rows = staged(pages.withColumns({"segments": parts, "nodes": F.array(F.lit(""))}), "paths")
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(deepest):
        here = F.get("segments", F.lit(level))
        node = F.element_at("nodes", -1)
        children = rows.filter(F.size("segments") > level).groupBy(F.col(host_col).alias("of"), node.alias("parent"), here.alias("child")).agg(F.count("*").alias("n"))
        kind = children.groupBy("of", "parent").agg(F.count("*").alias("different"), F.sum("n").alias("held"))
        variable = kind.filter((F.col("different") >= many) & (F.col("held") < thin * F.col("different"))).select("of", "parent", F.lit(True).alias("variable"))
        joined = rows.join(variable, (F.col(host_col) == F.col("of")) & (node == F.col("parent")), "left")
        segment = F.when(F.col("variable"), shape(here)).otherwise(here)
        grown = F.when(F.size("segments") > level, F.concat("nodes", F.array(F.concat(node, F.lit("/"), segment)))).otherwise(F.col("nodes"))
        rows = staged(joined.withColumn("nodes", grown).drop("of", "parent", "variable"), "paths")
    return rows.drop("segments")


def pooled(level: DataFrame, z: float) -> DataFrame:
    """``level`` with ``good`` and ``n`` of the branches that do not stand ``alone`` replaced by their pool's."""
    good, n = F.col("good"), F.col("n")
    rest = level.filter("n > 0 and not alone")
    shares = rest.groupBy("host", "parent").agg((F.sum("good") / F.sum("n")).alias("share"))
    spread = F.col("share") * (1 - F.col("share"))
    # Squared deviations of k branches of one purity sum to k, with this variance; a sum beyond z of its roots parts them.
    square = (good - n * F.col("share")) ** 2 / (n * spread)
    scatter = rest.join(shares, ["host", "parent"]).filter(spread > 0).groupBy("host", "parent")
    parted = scatter.agg(F.sum(square).alias("squares"), F.count("*").alias("k"), F.sum(2 + (1 / spread - 6) / n).alias("variance"))
    parted = parted.filter("squares > k * 1.000001 + %r * sqrt(greatest(variance, 0))" % z).select("host", "parent", F.lit(True).alias("parted"))
    pools = shares.join(parted, ["host", "parent"], "left")
    side = F.when(F.col("parted"), (good < n * F.col("share")).cast("int")).otherwise(-1)
    sums = rest.join(pools, ["host", "parent"]).groupBy("host", "parent", side.alias("side")).agg(F.sum("good").alias("pool_good"), F.sum("n").alias("pool_n"))
    own = level.join(pools, ["host", "parent"], "left").withColumn("side", F.when(~F.col("alone") & (n > 0), side))
    own = own.join(sums, ["host", "parent", "side"], "left")
    return own.select("host", "depth", "node", "above", F.coalesce("pool_good", "good").alias("good"), F.coalesce("pool_n", "n").alias("n"))


def purities(labelled: DataFrame, host_col: str, weight: float, z: float) -> DataFrame:
    """(host, node, purity) of every node; labelled: rows with ``nodes`` and ``good`` (0, 1 or null)."""
    total = labelled.agg(F.sum("good").alias("good"), F.count("good").alias("n")).first()
    base = ((total["good"] or 0) + 1.0) / (total["n"] + 2.0)
    nodes = labelled.select(F.col(host_col).alias("host"), "good", F.posexplode("nodes").alias("depth", "node"), F.col("nodes").alias("path"))
    nodes = nodes.withColumn("parent", F.get("path", F.col("depth") - 1))
    counted = staged(nodes.groupBy("host", "depth", "node", "parent").agg(F.sum("good").alias("good"), F.count("good").alias("n")), "nodes")
    deepest = counted.agg(F.max("depth")).first()[0]
    known = None
    for depth in range((-1 if deepest is None else deepest) + 1):
        level = counted.filter(F.col("depth") == depth)
        if known is None:
            level = level.withColumn("above", F.lit(base))
        else:
            level = level.join(known.select("host", F.col("node").alias("parent"), F.col("purity").alias("above")), ["host", "parent"])
        good, n, above = F.col("good"), F.col("n"), F.col("above")
        differs = (n > 0) & (F.abs(good - n * above) > z * F.sqrt(n * above * (1 - above)))
        level = level.withColumn("good", F.coalesce("good", F.lit(0)))
        if depth:
            level = pooled(staged(level.withColumn("alone", differs & (n >= weight)), "level"), z)
        purity = F.when(differs, (good + weight * above) / (n + weight)).otherwise(above)
        level = staged(level.select("host", "depth", "node", purity.alias("purity")), "purities")
        known = level
        made = level if depth == 0 else made.union(level)
    return made.select("host", "node", "purity") if known is not None else counted.select("host", "node", F.lit(base).alias("purity"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = (), id_col: str = "page_id", url_col: str = "url", many: int = 8, thin: float = 4.0, least: float = 0.5, weight: float = 5.0, z: float = 2.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row of ``pages``.

    ``labels``: (id, good 0 or 1); an id with several labels counts by the smallest, null labels and ids not at
    all.  A null url or one without ``://`` has an empty host and path.  Rows that repeat stay and count each.
    Without labels every template is as pure as the prior, one half, and allowed.
    """
    named = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    grown = templates(named, "host", "path", many, thin)
    one = labels.filter("id is not null and good in (0, 1)").groupBy("id").agg(F.min("good").cast("int").alias("good"))
    labelled = grown.join(one, "id", "left").withColumn("template", F.element_at("nodes", -1))
    judged = purities(labelled, "host", weight, z).withColumnRenamed("node", "template")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("purity") < least, "block").otherwise("allow")
    return labelled.join(judged, ["host", "template"]).select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(said, method).alias("verdict"), "template", "purity"
    )
