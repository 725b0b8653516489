"""URL filters: rules, and a path-template tree learnt from what the rules label, merged level by level; SQL functions only."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cairn.llm import store

#: Of the published query: (allow or block, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: A path that ends, and a wildcard, among the children of a node; no segment is empty or holds a slash.
END, WILD = "", "/*"
LOWERED = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.substring_index(F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit("")), "#", 1)
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, *LOWERED), F.substring(rest, F.length(host) + 1, F.length(rest))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def templates(urls: DataFrame, fan_out: int, prior_weight: float, purity: float, overlap: float) -> DataFrame:
    """(host, p, rejected): a verdict for each raw path shape of urls(host, p, label), p being all segments of the path.

    From the host down, a node with over fan_out children turns them into one wildcard, and sibling branches whose
    shares of urls for each child (and for ending there) overlap by at least `overlap` are merged, the one of most urls
    first, whatever their labels. Leaves have no children to compare and stay apart. Labels are summed over what was
    merged. A template is rejected if it holds a labelled url and (blocked + prior_weight * share blocked overall) /
    (labelled + prior_weight) is at least `purity`. A shape alone below its node has nothing to merge with and is done,
    so there are as many rounds as levels that shapes share, not as the longest path has segments.
    """
    counts = F.count(F.lit(1)).alias("urls"), F.count("label").alias("labelled"), F.count(F.when(F.col("label") == "block", 1)).alias("blocked")
    shapes = urls.groupBy("host", "p").agg(*counts)
    left, done, level = store.written(shapes.withColumn("node", F.col("host")), "url-shapes"), [], 0
    overall = left.agg(F.coalesce(F.try_divide(F.sum("blocked"), F.sum("labelled")), F.lit(0.0)).alias("overall"))  # one row
    while not left.isEmpty():
        alone = left.groupBy("node").agg(F.count(F.lit(1)).alias("shapes"))
        x = left.join(alone, "node").withColumns({"s": F.get("p", F.lit(level)), "below": F.coalesce(F.get("p", F.lit(level + 1)), F.lit(END))})
        ends = F.col("s").isNull() | (F.col("shapes") == 1)
        rest = F.concat(F.lit("/"), F.array_join(F.slice("p", level + 1, F.greatest(F.size("p") - level, F.lit(0))), "/"))
        done.append(x.filter(ends).select("host", "p", "labelled", "blocked", F.concat("node", rest).alias("template")))
        x = x.filter(~ends).drop("shapes")
        x = _wild(x, ["node"], "s", fan_out)
        leaders = _leaders(_wild(x, ["node", "s"], "below", fan_out), overlap)
        x = x.join(leaders, ["node", "s"]).select("host", "p", "urls", "labelled", "blocked", F.concat_ws("/", "node", "leader").alias("node"))
        left, level = store.written(x, "url-shapes"), level + 1
    if not done:
        return shapes.select("host", "p", F.lit(False).alias("rejected"))
    ended = reduce(DataFrame.unionByName, done)
    whole = ended.groupBy("template").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("k")).crossJoin(F.broadcast(overall))
    score = (F.col("k") + prior_weight * F.col("overall")) / (F.col("n") + prior_weight)
    return ended.join(whole.select("template", ((score >= purity) & (F.col("n") > 0)).alias("rejected")), "template").select("host", "p", "rejected")


def _wild(x: DataFrame, above: list[str], name: str, fan_out: int) -> DataFrame:
    """x with one wildcard in the column for all its children, ends aside, where they are over fan_out."""
    # distinct() first, so that a node with very many children is counted by many tasks
    wide = x.filter(F.col(name) != END).select(*above, name).distinct().groupBy(*above).agg(F.count(F.lit(1)).alias("children")).filter(F.col("children") > fan_out)
    x = x.join(wide, above, "left")
    return x.withColumn(name, F.when(F.col("children").isNotNull() & (F.col(name) != END), F.lit(WILD)).otherwise(F.col(name))).drop("children")


def _leaders(x: DataFrame, overlap: float) -> DataFrame:
    """(node, s, leader) of the branches s of x(node, s, below, urls): the first branch, by falling urls, that it is like."""
    child = x.groupBy("node", "s", "below").agg(F.sum("urls").alias("urls"))
    branch = child.groupBy("node", "s").agg(F.sum("urls").alias("urls"), F.map_from_entries(F.collect_list(F.struct("below", F.col("urls").cast("double")))).alias("c"))
    branch = branch.withColumn("c", F.transform_values("c", lambda _, n: n / F.col("urls")))
    # fan_out branches a node at most, of fan_out children and an end each
    node = branch.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("urls")).alias("o"), "s", F.array_sort(F.map_entries("c")).alias("c")))).alias("b"))
    alike = f"aggregate(x.c, 0D, (t, e) -> t + aggregate(y.c, 0D, (u, f) -> u + IF(e.below = f.below, least(e.share, f.share), 0D))) >= {overlap - 1e-9}D"
    entry = "array<struct<o:bigint,s:string,c:array<struct<below:string,share:double>>>>"
    node = node.withColumn("b", F.col("b").cast(entry))
    led = f"aggregate(b, CAST(array() AS {entry}), (acc, x) -> IF(size(x.c) = 1 AND x.c[0].below = '{END}' OR NOT exists(acc, y -> {alike}), concat(acc, array(x)), acc))"
    first = f"IF(size(x.c) = 1 AND x.c[0].below = '{END}', x.s, element_at(filter(led, y -> {alike}), 1).s)"
    out = node.withColumn("led", F.expr(led)).select("node", F.explode(F.expr(f"transform(b, x -> struct(x.s AS s, {first} AS leader))")).alias("m"))
    return out.select("node", "m.s", "m.leader")


def url_verdicts(pages: DataFrame, rules=RULES, fan_out: int = 12, prior_weight: float = 2.0, purity: float = 0.8, overlap: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A url that a rule fits gets that rule's verdict, and labels its template; the others are blocked if their
    template is rejected. Digits in a segment count as one symbol; all segments of a path count.
    A null url or one without :// has an empty host and path, fits no rule and is allowed unless such urls are
    labelled otherwise, which they can't be. Repeated rows each get their row; other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    x = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    x = x.withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    x = x.select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("label"), F.transform(parts, lambda s: F.regexp_replace(s, "[0-9]+", "<n>")).alias("p"))
    rejected = templates(x, fan_out, prior_weight, purity, overlap).filter("rejected")
    out = x.join(rejected, ["host", "p"], "left")
    method = F.when(F.coalesce("rejected", F.lit(False)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", method).alias("verdict"))
