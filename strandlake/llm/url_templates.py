"""URL filters: exact rules, and for all other URLs a tree of path templates for each host, in DataFrame operations only.

A path's segments that are variable by their form (numbers, hex, dates, file names of numbers) become wildcards row by
row; host and generalised path are then counted, which leaves a small table whatever the number of pages. The tree is
walked from the hosts down on that table, as deep as paths go. Where all paths of a node agree on their next segments,
these are one step. Under a node with many children of few URLs each, all children become one wildcard. Among other
children, those whose distribution of what follows does not differ from that of their siblings (chi-square) and whose
labels agree are merged into one.

Purity is the share of bad URLs among the labelled ones, always smoothed by SMOOTHING URLs of what is known otherwise.
A host's is smoothed towards that of its domain suffixes, the longer towards the shorter, and these towards the whole
table. A template's is smoothed towards the middle of its parent's and of that which its paths have on all hosts (the
whole path, smoothed towards its first segment, smoothed towards the whole table). So a template without any labelled
URL is judged by its surroundings. Templates at or above the threshold are rejected.

Labels come with the URLs; where rules are given, a URL that a rule judges is labelled by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import common

#: A parent with at least this many children, and fewer than FEW URLs a child, has variable children.
MANY_CHILDREN = 12
FEW = 3.0
SMOOTHING = 4.0
REJECT = 0.5
#: Labels of a host that are looked at for its suffixes, from the right: as many as the domain name system allows.
HOST_LABELS = 127

# The rules of the query, as (host and path, verdict).
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return common.ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls. A rule fits its host and all subdomains, and paths that start with its own."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: len(r[0])):
        of, _, rest = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def generalised(path: Column) -> Column:
    """The path's segments as an array, variable ones as wildcards by their form."""
    out = path
    # by form, each with a file ending that stays: number, date, long hex, mixed letters and digits
    for form, sign in (
        (r"[0-9]{4}-[0-9]{2}(-[0-9]{2})?", "{date}"),
        (r"[0-9]+", "{n}"),
        (r"[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}", "{uuid}"),
        (r"(?=[^/.]*[0-9])[0-9a-fA-F]{8,}", "{hex}"),
        (r"(?=[^/.]*[0-9])[A-Za-z0-9_~-]{16,}", "{id}"),
    ):
        out = F.regexp_replace(out, rf"(?<=/){form}(?=/|\.[A-Za-z]{{1,5}}(?:/|$)|$)", sign)
    parts = F.split(out, "/")  # the first is empty, as a path begins with /
    return F.filter(parts, lambda x, k: (k > 0))


def _pure(bad, good, towards, smoothing: float) -> Column:
    bad, good, towards = (F.col(c) if isinstance(c, str) else c for c in (bad, good, towards))
    return (bad + smoothing * towards) / (bad + good + smoothing)


def _sums() -> list[Column]:
    return [F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("m")]


def _elsewhere(counted: DataFrame, total: int, prior: float, smoothing: float) -> DataFrame:
    """counted with `other`: the purity of the row's path on all hosts."""
    rows = counted.withColumns({"first": F.get("segments", F.lit(0)), "whole": F.array_join("segments", "/")})
    first = common.written(rows.groupBy("first").agg(*_sums()).withColumn("by_first", _pure("bad", "good", F.lit(prior), smoothing)).select("first", "by_first", "m"), "first")
    whole = common.written(rows.groupBy("first", "whole").agg(*_sums()).withColumnsRenamed({"bad": "wbad", "good": "wgood"}), "whole")
    rows = common.lookup(rows, first, ["first"], "m", total).drop("m")
    rows = common.lookup(rows, whole, ["first", "whole"], "m", total)
    return rows.withColumn("other", _pure("wbad", "wgood", "by_first", smoothing)).select(*counted.columns, "other")


def _hosts(counted: DataFrame, prior: float, smoothing: float) -> DataFrame:
    """(host, purity, m): purity by the host's own URLs and those of its suffixes, from the shortest one on."""
    hosts = common.written(counted.groupBy("host").agg(*_sums()), "hosts")
    names = F.slice(F.split("host", r"\."), F.greatest(F.size(F.split("host", r"\.")) - (HOST_LABELS - 1), F.lit(1)), HOST_LABELS)
    parts = hosts.withColumn("names", names).select("host", "bad", "good", F.explode(F.sequence(F.lit(1), F.size("names"))).alias("level"), "names")
    parts = parts.withColumn("suffix", F.array_join(F.slice("names", F.size("names") - F.col("level") + 1, HOST_LABELS), ".")).drop("names")
    suffixes = common.written(parts.groupBy("level", "suffix").agg(F.sum("bad").alias("sbad"), F.sum("good").alias("sgood"), F.count("*").alias("w")), "suffixes")
    known = common.lookup(parts, suffixes, ["level", "suffix"], "w", parts.count())
    chain = F.array_sort(F.collect_list(F.struct("level", "sbad", "sgood")))  # as many as a host has labels
    fold = F.aggregate(chain, F.lit(prior), lambda p, x: _pure(x["sbad"], x["sgood"], p, smoothing))
    purity = known.groupBy("host").agg(fold.alias("above"))
    both = hosts.join(purity, "host")  # one row a host
    # a host of more labels than looked at is itself one step more
    return both.select("host", F.when(F.size(F.split("host", r"\.")) <= HOST_LABELS, F.col("above")).otherwise(_pure("bad", "good", "above", smoothing)).alias("purity"), "m")


def _step(live: DataFrame, total: int, smoothing: float, many: int, few: float) -> DataFrame:
    """live (host, template, rest, other, purity, ...) a step further down. Joins by a node tell hot nodes apart."""
    node = ["host", "template"]
    kept = live.columns
    live = live.withColumn("seg", F.get("rest", F.lit(0)))
    branch = live.groupBy(*node, "seg").agg(F.sum("n").alias("bn"), F.sum("bad").alias("bbad"), F.sum("good").alias("bgood"), (F.sum(F.col("n") * F.col("other")) / F.sum("n")).alias("bother"), F.count("*").alias("rows"), F.min("rest").alias("lo"), F.max("rest").alias("hi"))
    branch = common.written(branch, "branches")
    nodes = branch.groupBy(*node).agg(F.count("*").alias("k"), F.sum("bn").alias("pn"), F.sum("rows").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    apart = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    agree = F.when(apart == 0, F.size("lo")).otherwise(apart - 1).cast("int")
    variable = (F.col("k") >= many) & (F.col("pn") < few * F.col("k"))
    nodes = common.written(nodes.select(*node, "k", "m", variable.alias("variable"), agree.alias("agree")), "nodes")
    live = common.lookup(live, nodes, node, "m", total).drop("m")

    # what follows the children of a node, against what follows all of the same labels
    several = (F.col("k") > 1) & ~F.col("variable")
    pure = _pure("bbad", "bgood", "bother", smoothing)
    band = F.when(pure >= 0.6, F.lit("b")).when(pure <= 0.4, F.lit("a")).otherwise(F.lit("m"))
    child = common.lookup(branch.select(*node, "seg", "bn", "rows", band.alias("band")), nodes, node, "k", total).where(several).select(*node, "seg", "bn", "rows", "band")
    child = common.written(child, "children")
    follows = live.where(several).withColumn("tail", F.array_join(F.slice("rest", F.lit(2), F.size("rest")), "/")).groupBy(*node, "seg", "tail").agg(F.sum("n").alias("o"))
    follows = common.written(common.lookup(follows, child, [*node, "seg"], "rows", total).drop("rows"), "follows")
    pooled = common.written(follows.groupBy(*node, "band", "tail").agg(F.sum("o").alias("all_o"), F.count("*").alias("w")), "pooled")
    pool = pooled.groupBy(*node, "band").agg(F.sum("all_o").alias("all_n"), F.count("*").alias("kinds"), F.sum("w").alias("w"))
    gap = common.lookup(follows, pooled, [*node, "band", "tail"], "w", total).drop("w")
    gap = common.lookup(gap, common.written(pool, "pool"), [*node, "band"], "w", total)
    expected = F.col("bn") * F.col("all_o") / F.col("all_n")
    gap = gap.groupBy(*node, "band", "seg").agg((F.sum(F.col("o") * F.col("o") / expected) - F.max("bn")).alias("chi"), F.max("kinds").alias("kinds"))
    freedom = F.col("kinds") - 1
    gap = common.written(gap.withColumn("similar", F.col("chi") <= freedom + 3 * F.sqrt(2.0 * F.greatest(freedom, F.lit(1)))), "gaps")
    mates = common.written(gap.groupBy(*node, "band").agg(F.count_if("similar").alias("mates"), F.count("*").alias("w")), "mates")
    named = common.lookup(gap, mates, [*node, "band"], "w", total).where(F.col("similar") & (F.col("mates") >= 2))
    named = named.select(*node, "seg", F.concat(F.lit("~"), F.col("band")).alias("merged"))
    named = common.written(named.join(child.select(*node, "seg", "rows"), [*node, "seg"]), "named")
    live = common.lookup(live, named, [*node, "seg"], "rows", total).drop("rows")

    name = F.when(F.col("variable"), F.lit("*")).otherwise(F.coalesce("merged", "seg"))
    added = F.when(F.col("agree") > 0, F.array_join(F.slice("rest", F.lit(1), F.col("agree")), "/")).otherwise(name)
    rest = F.slice("rest", F.greatest("agree", F.lit(1)) + 1, F.size("rest") + 1)
    live = common.written(live.withColumns({"template": F.concat("template", F.lit("/"), added), "rest": rest}).select(*kept), "moved")
    below = live.groupBy(*node).agg(*_sums(), (F.sum(F.col("n") * F.col("other")) / F.sum("n")).alias("tp"), F.max("purity").alias("above"))
    below = common.written(below.select(*node, _pure("bad", "good", (F.col("above") + F.col("tp")) / 2, smoothing).alias("purity"), "m"), "purities")
    return common.lookup(live.drop("purity"), below, node, "m", total).select(*kept)


def templates(counted: DataFrame, smoothing: float = SMOOTHING, many: int = MANY_CHILDREN, few: float = FEW) -> DataFrame:
    """(host, segments, n, bad, good), a row each -> host, segments, n, template, purity of the template."""
    sums = counted.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("rows")).first()
    bad, good, total = sums.bad or 0, sums.good or 0, sums.rows
    prior = bad / (bad + good + smoothing)  # without any labels, nothing is bad
    rows = _elsewhere(counted, total, prior, smoothing).withColumns({"template": F.lit(""), "rest": F.col("segments")})
    live = common.written(common.lookup(rows, common.written(_hosts(counted, prior, smoothing), "host_purity"), ["host"], "m", total).drop("m"), "live")
    out = None
    while True:  # as deep as paths branch
        done = live.where(F.size("rest") == 0).select("host", "segments", "n", "template", "purity")
        out = done if out is None else out.unionByName(done)
        live = live.where(F.size("rest") > 0)
        if not live.limit(1).count():
            return out
        live = common.written(_step(live, total, smoothing, many, few), "live")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None, rules: list[tuple[str, str]] | None = None, reject: float = REJECT, **settings) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, template, purity.

    label_col: 1 (bad), 0 (good) or null. The verdict is that of the longest rule that fits, else block where the
    template's purity is at least reject. A null URL, or one without ://, has an empty host and path and is judged like
    any other. Repeated rows are judged alike, and each counts. Empty input gives no rows. Other columns are not read.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), (F.col(label_col).cast("int") if label_col else F.lit(None).cast("int")).alias("label"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules or [])
    rows = rows.withColumn("rule", rule).withColumn("said", said)
    label = F.coalesce(F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0), F.col("label"))
    rows = rows.withColumn("label", label).withColumn("segments", generalised(F.col("path")))
    counted = rows.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") == 0).alias("good"))
    counted = common.written(counted, "paths")
    total = counted.agg(F.sum("n")).first()[0] or 0
    found = common.lookup(rows, templates(counted, **settings), ["host", "segments"], "n", total)
    verdict = F.coalesce("said", F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow")))
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.concat("host", "template").alias("template"), "purity")


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url"), rules=RULES)
