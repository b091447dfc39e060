"""URL filter by a path-template tree, in DataFrame functions only.

Each host's paths form a tree of segments, of any depth.  Segments that vary (digits, or few urls each among many siblings)
become wildcards, and labelled branches that are shown to have the same share of blocked urls as their labelled siblings
merge into the wildcard; a branch without labels stays by itself.  A template, i.e. a path of the generalised tree, is
rejected if its smoothed share of blocked urls among its own labelled ones is high enough.  The labels are the verdicts of the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxquarry.llm.storage import cut

# Fixed values: (host, path, verdict) of the rules.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what stands after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased, and then up to ``? #`` or the end; else empty."""
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, begin, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(begin)
        out = F.when(fits, F.struct(F.lit(name + begin).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _names(branches: DataFrame, many: int, rare: float, least: int, critical: float) -> DataFrame:
    """(host, parent, segment, name): what each branch is called in templates, itself or a wildcard.

    branches: host, parent, segment, n, blocked, labelled.  Besides segments that vary, a branch merges if it and its siblings have ``least`` labelled
    urls each and their shares of blocked ones are less than ``critical`` standard errors apart.
    """
    sums = lambda: [F.sum(c).alias(c) for c in ("n", "blocked", "labelled")]
    child = branches.groupBy("host", "parent", "segment").agg(*sums())
    above = child.groupBy("host", "parent").agg(F.count("*").alias("all_children"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "blocked", "labelled")])
    both = child.join(above, ["host", "parent"])
    variable = F.col("segment").contains("#") | ((F.col("all_children") > many) & (F.col("n") < rare * F.col("all_n")))
    n1, n0 = F.col("labelled"), F.col("all_labelled") - F.col("labelled")
    p1, p0 = (F.col("blocked") + 0.5) / (n1 + 1), (F.col("all_blocked") - F.col("blocked") + 0.5) / (n0 + 1)
    p = (F.col("all_blocked") + 1.0) / (F.col("all_labelled") + 2.0)
    alike = (n1 >= least) & (n0 >= least) & (F.abs(p1 - p0) < critical * F.sqrt(p * (1 - p) * (1 / (n1 + 1) + 1 / (n0 + 1))))
    return both.select("host", "parent", "segment", F.when(variable | alike, "*").otherwise(F.col("segment")).alias("name"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] | None = None, many: int = 20, rare: float = 0.1, least: int = 5, critical: float = 2.0, prior: float = 2.0, purity: float = 0.9) -> DataFrame:
    """One row for each row of ``pages``: (id, host, path, rule, verdict, template, purity).

    verdict is the longest fitting rule's, else ``block`` if the template's smoothed purity is ``purity`` or more, else ``allow``.
    Smoothing adds ``prior`` labelled urls, half of them blocked, so a template without labels is allowed.  Null urls and urls without
    ``://`` have an empty host and path, and are allowed unless their template is rejected; repeated rows are each
    answered; extra columns are ignored, whatever their names; an empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("segments", F.filter(F.split(F.regexp_replace("path", r"\d+", "#"), "/"), lambda s: s != ""))
    # one row for each host and shape of path; partial counts are made before the shuffle
    tree = rows.groupBy("host", "segments").agg(
        F.count("*").alias("n"), F.count_if(F.col("found.verdict") == "block").alias("blocked"), F.count("found.verdict").alias("labelled")
    )
    tree = cut(tree, "url-tree")
    # a branch is known by the hash of the segments before it and its own
    step = lambda k: F.struct(k.alias("level"), F.xxhash64(F.slice("segments", F.lit(1), k - 1)).alias("parent"), F.element_at("segments", k).alias("segment"))
    steps = F.when(F.size("segments") > 0, F.transform(F.sequence(F.lit(1), F.size("segments")), step))
    branches = cut(tree.select("host", "segments", "n", "blocked", "labelled", F.inline(steps)), "url-branches")
    named = branches.join(_names(branches, many, rare, least, critical), ["host", "parent", "segment"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("level", "name"))), lambda x: x["name"])
    named = named.groupBy("host", "segments").agg(F.concat(F.lit("/"), F.array_join(ordered, "/")).alias("template"))
    tree = cut(tree.join(named, ["host", "segments"], "left").withColumn("template", F.coalesce("template", F.lit(""))), "url-templates")
    templates = tree.groupBy("host", "template").agg(((F.sum("blocked") + prior / 2) / (F.sum("labelled") + prior)).alias("purity"))
    judged = tree.select("host", "segments", "template").join(templates, ["host", "template"])
    out = rows.join(judged, ["host", "segments"], "left")
    own = F.when(F.col("purity") >= purity, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), F.concat("host", "template").alias("template"), "purity")
