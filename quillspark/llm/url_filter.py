"""URL filtering by listed rules and a tree of path templates with labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import broadcast_if_small, forget, written

#: (verdict, host, path): the fixed rules of the query.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
Z = 1.96  #: branches whose label share differs less than this many standard errors are similar
MIN_LABELS = 5  #: with fewer labels a branch is similar to any
PRIOR_LABELS = 5.0
MIN_PURITY = 0.5
MAX_BROADCAST = 200_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(raw, upper, upper.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; of equally long ones a block."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The path's segments with digits and long hex runs generalised."""
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    return F.transform(
        parts, lambda s: F.regexp_replace(F.regexp_replace(s, "[0-9a-f]{12,}|[0-9A-F]{12,}", "{h}"), "[0-9]+", "{n}")
    )


def rejected_templates(keyed: DataFrame, labelled: DataFrame) -> DataFrame:
    """``(host, segs)`` whose template is rejected.

    ``keyed(host, segs)`` are all pages, ``labelled(host, segs, bad)`` those
    with a label. Pages are first summed by generalised path; each level of the
    tree is then one aggregation and a join of those sums: below a node,
    segments become a wildcard if their share of bad labels is like that of the
    node (or has too few labels to tell). Levels go on as deep as paths branch:
    a path that is alone below its node is finished. A template is rejected if
    its share of good labels, smoothed towards that of all labels, is under
    ``MIN_PURITY``.
    """
    sums = (
        keyed.select("host", "segs", F.lit(0).alias("lab"), F.lit(0).alias("bad"))
        .union(labelled.select("host", "segs", F.lit(1), F.col("bad").cast("int")))
        .groupBy("host", "segs")
        .agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    )
    tree = written(sums.withColumn("tmpl", F.col("segs")), "templates")
    finished, d = [], 0
    while True:
        d += 1
        at = tree.withColumn("node", F.slice("tmpl", 1, d - 1)).withColumn("child", F.get("tmpl", F.lit(d - 1)))
        child = at.filter("child is not null").groupBy("host", "node", "child").agg(
            F.sum("lab").alias("lab"), F.sum("bad").alias("bad"), F.count("*").alias("paths")
        )
        child = written(child, "children")
        node = child.groupBy("host", "node").agg(
            F.sum("lab").alias("all_lab"), F.sum("bad").alias("all_bad"), F.count("*").alias("children"), F.sum("paths").alias("below")
        ).filter("below > 1")
        p = F.coalesce(F.try_divide("all_bad", "all_lab"), F.lit(0.0))
        err = F.sqrt(F.col("lab") * p * (1 - p))
        similar = (F.col("lab") < MIN_LABELS) | (F.abs(F.col("bad") - F.col("lab") * p) <= Z * err)
        judged = child.join(node, ["host", "node"]).select(
            "host", "node", "child", ((F.col("children") > 1) & similar).alias("merge")
        )
        after = written(
            at.join(judged, ["host", "node", "child"], "left").select(
                "host", "segs", "lab", "bad",
                F.when(
                    F.col("merge"),
                    F.concat(F.slice("tmpl", 1, d - 1), F.array(F.lit("*")), F.expr(f"slice(tmpl, {d + 1}, greatest(size(tmpl) - {d}, 0))")),
                ).otherwise(F.col("tmpl")).alias("tmpl"),
                F.col("merge").isNotNull().alias("going"),
            ),
            "templates",
        )
        forget(child)
        finished.append(after.filter("not going").drop("going"))
        tree = after.filter("going").drop("going")
        if tree.isEmpty():
            break
    tree = finished[0]
    for f in finished[1:]:
        tree = tree.union(f)
    tree = written(tree, "templates")
    total = tree.agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad")).first()
    prior = 1 - (total.bad / total.lab if total and total.lab else 0.0)
    bad_templates = (
        tree.groupBy("host", "tmpl")
        .agg(F.sum("lab").alias("tl"), F.sum("bad").alias("tb"))
        .filter((F.col("tl") - F.col("tb") + PRIOR_LABELS * prior) / (F.col("tl") + PRIOR_LABELS) < MIN_PURITY)
    )
    return tree.join(bad_templates, ["host", "tmpl"], "left_semi").select("host", "segs")


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of each page's url.

    The longest rule that fits the host (or a domain above it) and begins the
    path gives the verdict; without one, the page is blocked if its path's
    template is rejected by :func:`rejected_templates`, else allowed.
    ``labels(doc_id, quality, toxic)`` are those of the documents that pages
    show: a url's last number is its document's id. Bad is toxic or of quality
    zero; a label's null columns count as good.

    A null url, or one without ``://``, has an empty host and path. Repeated
    rows are judged alike and a null id is carried along. An empty table gives
    none; without labels nothing is rejected.
    """
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    keyed = base.withColumn("segs", segments(F.col("path")))
    number = F.expr("try_cast(regexp_extract(path, '(?<![0-9])([0-9]++)[.a-z]*+/?$', 1) AS BIGINT)")
    known = (
        labels.filter("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("number"))
        .agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False)).cast("int")).alias("bad"))
    )
    labelled = keyed.withColumn("number", number).filter("number is not null").join(known, "number").select(
        "host", "segs", "bad"
    )
    gone = written(rejected_templates(keyed.select("host", "segs"), labelled), "rejected")
    gone = gone.select(F.col("host").alias("gh"), F.col("segs").alias("gs"), F.lit(True).alias("gone"))
    gone = broadcast_if_small(gone, MAX_BROADCAST, F.length("gh") + F.length(F.array_join("gs", "/")) + F.size("gs") * 8 + 64)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return keyed.join(gone, (F.col("host") == F.col("gh")) & (F.col("segs") == F.col("gs")), "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("gone"), "block").otherwise("allow")).alias("verdict"),
    )
