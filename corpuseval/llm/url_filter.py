"""URL filters: fixed rules first, then a tree of path templates for each host.

A url's host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; its path goes on up to
``?``, ``#`` or the end.  A rule (action, host, path) fits its host and all subdomains where the path starts with the rule's;
the longest rule that fits gives the verdict, and those verdicts are the labels of the method.

Of rules of equal length that of the longer host goes first, then by action, host and path in order of text.

Tree: each host is a root.  Level by level a path segment that holds a fair share of its parent's urls stays as it is, and all
rarer ones become ``*``; so a parent has at most 1 / ``MIN_SHARE`` literal children.  Children that labels fall on are taken in
order of their share of blocked urls, and one that does not differ from the branch before it (a test of two
proportions) is merged with it: ``/de|en``, or ``/*`` where the wildcard is among them.  Merged branches grow on as one.
``*`` and ``|`` within segments are written ``%2A`` and ``%7C``.

A branch grows as long as ``MIN_URLS`` of its urls go on; of what fewer urls share, deeper segments do not show in the template.

Purity: each label counts in one template, that where its url ends in the tree.  The share of blocked labels there is smoothed by the parent's
purity, the root's by the share of all labels.  A template is rejected from ``REJECT`` on, and only if it has labels of its own: a branch
that no rule touches is not judged by its siblings, and is allowed.

A null url, or one without ``://``, has an empty host and path, which no rule fits.  Every row is judged once; repeated rows
are judged alike and count as often as they are there.  An empty table gives no rows.  Rules are literals of the plan and at
most ``MAX_RULES``.  Urls are only counted, by sums on the map side, so a large host is no large task; segments that are
rarer than ``MIN_URLS`` go before anything is joined, and nothing but the overall share and counts of rows is collected.  Each level writes the urls
that go on and takes only these to the next, so a few urls of very many segments cost small jobs and not scans of all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuseval.llm._session import stored

#: A segment stays literal from this share of its parent's urls on, and from this number.
MIN_SHARE, MIN_URLS = 0.02, 3
#: Deviations up to which shares do not differ, labels that the overall share counts, and the share that rejects.
SIMILAR, PRIOR, REJECT = 1.96, 2.0, 0.8
MAX_RULES = 1_000
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    at = F.locate("://", url) if isinstance(url, str) else F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: F.Column, path: F.Column, rules=RULES) -> F.Column:
    """The longest rule that fits as ``struct<rule, action>``, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    found = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action")))
        for action, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    ]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,action:string>")


def _merged(kids: F.Column) -> F.Column:
    """Branches (``names``, ``n``, ``bad``) of children (``share``, ``segment``, ``n``, ``bad``): in order of shares, like ones merged."""
    kind = "array<struct<names:array<string>,n:bigint,bad:bigint>>"

    def step(done: F.Column, kid: F.Column) -> F.Column:
        last = F.get(done, F.size(done) - 1)
        n, bad = last["n"] + kid["n"], last["bad"] + kid["bad"]
        spread = F.sqrt(bad / n * (1 - bad / n) * (1 / last["n"] + 1 / kid["n"]))
        alike = F.coalesce(F.abs(last["bad"] / last["n"] - kid["share"]) <= SIMILAR * spread, F.lit(False))
        more = F.struct(F.concat(last["names"], F.array(kid["segment"])).alias("names"), n.alias("n"), bad.alias("bad"))
        alone = F.struct(F.array(kid["segment"]).alias("names"), kid["n"].alias("n"), kid["bad"].alias("bad"))
        return F.when(alike, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(more))).otherwise(F.concat(done, F.array(alone)))

    labelled = F.array_sort(F.filter(kids, lambda k: k["n"] > 0))
    others = F.transform(F.filter(kids, lambda k: k["n"] == 0), lambda k: F.struct(F.array(k["segment"]).alias("names"), k["n"].alias("n"), k["bad"].alias("bad")))
    return F.concat(F.aggregate(labelled, F.array().cast(kind), step), others.cast(kind))


def _branches(rows: DataFrame, level: int) -> DataFrame:
    """The next level: ``host``, ``parent``, ``template`` and ``names`` of all children of the templates of ``rows`` that grow."""
    at = rows.withColumn("segment", F.get("segments", F.lit(level))).where("segment is not null")
    sums = [F.count("*").alias("urls"), F.count("fit").alias("n"), F.count_if(F.col("fit.action") == "block").alias("bad")]
    totals = at.groupBy("host", "template").agg(*sums).where(F.col("urls") >= MIN_URLS)
    counts = at.groupBy("host", "template", "segment").agg(*sums).where(F.col("urls") >= MIN_URLS)
    share = lambda bad, n: F.coalesce(F.try_divide(bad, n), F.lit(0.0)).alias("share")
    kid = F.struct(share(F.col("bad"), F.col("n")), "segment", "n", "bad")
    literal = counts.join(totals.select("host", "template", F.col("urls").alias("all")), ["host", "template"]).where(F.col("urls") >= F.col("all") * MIN_SHARE)
    literal = literal.groupBy("host", "template").agg(F.collect_list(kid).alias("kids"), *(F.sum(c).alias(f"own_{c}") for c in ("urls", "n", "bad")))
    rest = totals.join(literal, ["host", "template"], "left")
    urls, n, bad = (F.col(c) - F.coalesce(f"own_{c}", F.lit(0)) for c in ("urls", "n", "bad"))
    wild = F.struct(share(bad, n), F.lit("*").alias("segment"), n.alias("n"), bad.alias("bad"))
    kids = F.coalesce("kids", F.array().cast("array<struct<share:double,segment:string,n:bigint,bad:bigint>>"))
    grown = rest.select("host", "template", F.inline(_merged(F.when(urls > 0, F.concat(kids, F.array(wild))).otherwise(kids))))
    name = F.when(F.array_contains("names", "*"), "*").otherwise(F.array_join(F.array_sort("names"), "|"))
    return grown.select("host", F.col("template").alias("parent"), F.concat("template", F.lit("/"), name).alias("template"), "names")


def _purities(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``host``, ``template``, ``n`` and ``purity`` of all templates: labels of the urls that end there, smoothed from the root on."""
    bad, labels = rows.agg(F.count_if(F.col("fit.action") == "block"), F.count("fit")).first()
    own = stored(rows.groupBy("host", "template").agg(F.count("fit").alias("n"), F.count_if(F.col("fit.action") == "block").alias("bad")), "labels")
    nodes = None
    above = rows.select("host").distinct().select("host", F.lit("").alias("template"), F.lit(bad / labels if labels else 0.0).alias("above"))
    for level in [None, *levels]:
        if level is not None:
            known = above.select("host", F.col("template").alias("parent"), F.col("purity").alias("above"))
            above = level.select("host", "parent", "template").join(known, ["host", "parent"]).drop("parent")
        n, blocked = (F.coalesce(c, F.lit(0)) for c in ("n", "bad"))
        above = above.join(own, ["host", "template"], "left").select("host", "template", n.alias("n"), ((blocked + PRIOR * F.col("above")) / (n + PRIOR)).alias("purity"))
        above = stored(above, "purities")
        nodes = above if nodes is None else nodes.unionByName(above)
    return nodes


def tree(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (``host``, ``segments``, ``fit`` and others) with their ``template``, and ``host``, ``template``, ``n`` and ``purity`` of all templates."""
    rows = rows.withColumn("template", F.lit(""))
    ended, levels = None, []
    while True:
        branches = stored(_branches(rows, len(levels)), "branches")  # small
        literal = branches.select("host", F.col("parent").alias("template"), F.explode("names").alias("segment"), F.col("template").alias("grown")).where("segment <> '*'")
        wild = branches.where(F.array_contains("names", "*")).select("host", F.col("parent").alias("template"), F.col("template").alias("wild"))
        at = rows.withColumn("segment", F.get("segments", F.lit(len(levels)))).join(literal, ["host", "template", "segment"], "left").join(wild, ["host", "template"], "left")
        next_ = F.when(F.col("segment").isNotNull(), F.coalesce("grown", "wild"))
        moved = stored(at.withColumn("next", next_).drop("segment", "grown", "wild"), "level")
        here = moved.where("next is null").drop("next")
        ended = here if ended is None else ended.unionByName(here)
        rows = moved.where("next is not null").drop("template").withColumnRenamed("next", "template")
        if not branches.take(1):
            break
        levels.append(branches)
    return ended, _purities(ended, levels)


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``n_labels`` (of the template's own) and ``purity`` of every row."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = stored(rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)), "urls")
    plain = F.replace(F.replace("path", F.lit("*"), F.lit("%2A")), F.lit("|"), F.lit("%7C"))
    rows, nodes = tree(rows.withColumn("segments", F.filter(F.split(plain, "/"), lambda s: s != "")))
    verdict = F.coalesce("fit.action", F.when((F.col("n") > 0) & (F.col("purity") >= REJECT), "block").otherwise("allow"))
    joined = rows.join(nodes, ["host", "template"])
    return joined.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "template", F.col("n").alias("n_labels"), "purity")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
