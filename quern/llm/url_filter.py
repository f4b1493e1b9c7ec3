"""URL verdicts by rules and, where no rule fits, by a path-template tree.

Pages that a rule fits are the labelled ones. Urls are first counted by (host, path), so a hot host
is as many rows as it has paths, not pages. The tree grows one path segment at a time, the last of
``LEVELS`` steps taking all segments that are left: per host and template so far, a segment is generalised
to a wildcard if it looks variable (numbers, hex, dates, long slugs) or is rare among its siblings, so
that at most 1 / ``RARE`` literal branches are left. A parent's branches, the wildcard's among them, are
put in order of their shares of blocked pages, and each is merged with the ones before it unless
their shares differ by a two-proportion test. A template's purity is its share of blocked pages, smoothed
towards its host's, which is smoothed towards the share among all labelled pages; templates with
labelled pages of their own and a purity of ``PURITY`` or more are rejected.

Everything is joins and sums of DataFrames. Where a key (a url, a branch) has more than 1 / ``HOT`` of all rows
and more than ``HOT_ROWS``, its rows are dealt over ``SALTS`` parts; the list of these keys, fewer than ``HOT``, and that of
the rules are all that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.spread import written

#: Host and path of each rule, and its verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

LEVELS = 6  # the last takes all segments left
RARE = 0.02  # a literal branch holds at least this share of its parent's pages
LEAST = 5  # and at least so many pages
Z = 1.96
WEIGHT = 4.0  # pages that the prior counts as
PURITY = 0.8
HOT = 1000
HOT_ROWS = 1000  # rows of a key up to which they stay together
SALTS = 32

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VARIABLE = r"^(?:\d+(?:[._-]\d+)*|[0-9a-fA-F-]{8,}|(?=.*\d).{12,}|.{40,})$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without '://'."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOW)
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits a host or one of its parents and begins the path, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the last, longest, is asked first
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _segment(path: Column, level: int) -> Column:
    """The template symbol of a path's segment at a level, of all from it on at the last: a typed wildcard for each that looks variable, null past the end."""

    def symbol(part: Column) -> Column:
        return F.when(F.regexp_replace(part, r"\.[A-Za-z]{1,5}$", "").rlike(VARIABLE), F.lit("*")).otherwise(part)

    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    if level < LEVELS - 1:
        return symbol(F.get(parts, F.lit(level)))
    rest = F.transform(F.slice(parts, LEVELS, F.greatest(F.size(parts), F.lit(1))), symbol)
    return F.when(F.size(rest) > 0, F.array_join(rest, "/"))


def _joined(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows with the facts of their keys (one row a key, without its weight, the number of its rows): shuffled by key, hot keys in parts."""
    facts = written(facts)
    total, most = (x or 0 for x in facts.agg(F.sum(weight), F.max(weight)).first())
    hot = facts.where((F.col(weight) * HOT > total) & (F.col(weight) > HOT_ROWS)).select(*keys, F.lit(True).alias("__hot"))
    if most * HOT <= total or most <= HOT_ROWS:
        return rows.join(facts.drop(weight).hint("merge"), keys, "left")
    hot = F.broadcast(hot)  # fewer than HOT rows
    parts = F.sequence(F.lit(0), F.when(F.col("__hot"), F.lit(SALTS - 1)).otherwise(F.lit(0)))
    facts = facts.drop(weight).join(hot, keys, "left").withColumn("__salt", F.explode(parts)).drop("__hot")
    rows = rows.join(hot, keys, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("__hot")
    return rows.join(facts.hint("merge"), [*keys, "__salt"], "left").drop("__salt")


def _merged(branches: Column) -> Column:
    """seg and symbol of each branch (rate, seg, bad, good; in order of rates): alike neighbours become one, '*' if the wildcard is among them."""
    none = F.struct(F.lit(0).cast("bigint").alias("bad"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<string>").alias("segs"))
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), none.alias("open"))

    def step(state: Column, x: Column) -> Column:
        old, n = state["open"], x["bad"] + x["good"]
        p = (old["bad"] + x["bad"]) / (old["n"] + n)
        gap = x["bad"] / n - F.try_divide(old["bad"], old["n"])
        alike = (gap * gap < Z * Z * p * (1 - p) * (F.try_divide(F.lit(1), old["n"]) + 1 / n)) | (gap == 0)
        both = F.struct((old["bad"] + x["bad"]).alias("bad"), (old["n"] + n).alias("n"), F.concat(old["segs"], F.array(x["seg"])).alias("segs"))
        fresh = F.struct(x["bad"].alias("bad"), n.alias("n"), F.array(x["seg"]).alias("segs"))
        closed = F.struct(F.concat(state["done"], F.array(old["segs"])).alias("done"), fresh.alias("open"))
        return F.when((F.size(old["segs"]) == 0) | F.coalesce(alike, F.lit(False)), F.struct(state["done"].alias("done"), both.alias("open"))).otherwise(closed)

    groups = F.aggregate(branches, start, step, lambda s: F.concat(s["done"], F.array(s["open"]["segs"])))

    def named(segs: Column) -> Column:
        name = F.when(F.array_contains(segs, "*"), F.lit("*")).when(F.size(segs) > 1, F.concat(F.lit("{"), F.array_join(F.sort_array(segs), "|"), F.lit("}"))).otherwise(segs[0])
        return F.transform(segs, lambda seg: F.struct(seg.alias("kind"), name.alias("symbol")))

    return F.flatten(F.transform(groups, named))


def templates(paths: DataFrame) -> DataFrame:
    """host, path, n, bad, good of distinct paths, with each path's template."""
    rows = paths.withColumn("template", F.lit(""))
    for level in range(LEVELS):
        rows = written(rows.drop("seg"))  # each level reads the one before several times
        rows = rows.withColumn("seg", _segment(F.col("path"), level))
        branch = rows.where("seg is not null").groupBy("host", "template", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "good")), F.count("*").alias("paths"))
        branch = written(branch)
        if branch.isEmpty():  # no path has a further segment
            break
        parent = branch.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("paths").alias("weight"))
        known = _joined(branch, parent, ["host", "template"], "weight")
        wild = (F.col("seg") == "*") | (F.col("n") < LEAST) | (F.col("n") < RARE * F.col("all_n"))
        known = written(known.withColumn("kind", F.when(wild, F.lit("*")).otherwise(F.col("seg"))))
        # at most 1 / RARE literal branches a parent, and the wildcard
        pooled = known.groupBy("host", "template", "kind").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad + good > 0")
        rate = F.col("bad") / (F.col("bad") + F.col("good"))
        few = pooled.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct(rate.alias("rate"), F.col("kind").alias("seg"), "bad", "good"))).alias("branches"))
        symbols = few.select("host", "template", F.explode(_merged(F.col("branches"))).alias("x")).select("host", "template", "x.kind", "x.symbol")
        symbols = symbols.join(known.groupBy("host", "template", "kind").agg(F.sum("paths").alias("weight")), ["host", "template", "kind"])
        known = _joined(known.select("host", "template", "seg", "kind", "paths"), symbols, ["host", "template", "kind"], "weight")
        known = known.select("host", "template", "seg", F.coalesce("symbol", "kind").alias("symbol"), "paths")
        rows = _joined(rows, known, ["host", "template", "seg"], "paths")
        rows = rows.select("host", "path", "n", "bad", "good", F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "symbol")).alias("template"))
    return rows.drop("seg")


def judged(pages: DataFrame, rules: dict[str, str] | None = None, purity: float = PURITY) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row.

    A null url, and one without '://', has an empty host and path and the empty template; it is
    judged like any other. Repeated rows stay, each with its verdict. Very long paths are whole templates.
    Branches of equal shares are merged, in order of their names. Other columns are not looked at.
    Without any labelled page nothing is rejected. An empty table gives none.
    """
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocked = [r for r, v in rules.items() if v == "block"]
    is_bad = F.coalesce(F.col("rule").isin(blocked), F.lit(False)).cast("bigint") if blocked else F.lit(0).cast("bigint")
    is_good = F.col("rule").isNotNull().cast("bigint") - is_bad
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(is_bad).alias("bad"), F.sum(is_good).alias("good"))
    tree = written(templates(paths))
    leaf = written(tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("weight")))
    site = leaf.groupBy("host").agg(F.sum("bad").alias("h_bad"), F.sum("good").alias("h_good"), F.count("*").alias("templates"))
    whole = site.agg(F.coalesce(F.sum("h_bad") / F.nullif(F.sum("h_bad") + F.sum("h_good"), F.lit(0)), F.lit(0.0)).alias("prior"))
    site = site.crossJoin(F.broadcast(whole)).select("host", ((F.col("h_bad") + WEIGHT * F.col("prior")) / (F.col("h_bad") + F.col("h_good") + WEIGHT)).alias("h_rate"), "templates")  # one row
    labelled = F.col("bad") + F.col("good")
    share = F.when(labelled > 0, (F.col("bad") + WEIGHT * F.col("h_rate")) / (labelled + WEIGHT))
    leaf = _joined(leaf, site, ["host"], "templates").select("host", "template", share.alias("purity"), "weight")
    known = _joined(tree.select("host", "path", "template", "n"), leaf, ["host", "template"], "weight")
    verdict = F.when(F.col("rule").isNotNull(), F.when(F.col("rule").isin(blocked), F.lit("block")).otherwise(F.lit("allow"))).when(F.col("purity") >= purity, F.lit("block")).otherwise(F.lit("allow"))
    return _joined(rows, known, ["host", "path"], "n").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
