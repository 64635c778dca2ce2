"""URL filtering by host rules, and by association rules mined from labelled URLs.

Host rules fit a host and its subdomains where the path starts with the rule's; the
longest wins. URLs that a rule decides are the labelled ones: FP-growth over their
tokens finds the combinations that imply blocking, pruned by support and confidence,
and then by rules with fewer tokens that are as sure. Tokens that host rules are made
of are left out where these rules give the labels: each such label is as the rule says,
which tells nothing of the URLs that it does not fit. A rule also needs ``LEAST`` blocked
labels, and more of them than the share of blocked labels explains, by ``FAR`` standard
deviations, as thousands of combinations are tried. Labels count by distinct URL;
tokens that stand in the same URLs are mined as one (any of them will do in a URL that
is judged). Where a URL has more than ``ITEMS`` of them, FP-growth would list every combination; there they are
built up one token at a time instead, without those that pruning would drop anyway (``grown``), for the same rules.
The kept rules match other URLs
through an inverted index: each rule waits under its rarest token, and only URLs with
that token are asked for the rest.

Labels of documents (``labels``) can be given instead of host rules' verdicts.

Defined results: a null URL or one without ``://`` has an empty host and path and no
tokens, and is allowed; repeated rows are judged alike and are one label; with
no labelled URL nothing is mined and all others are allowed; an empty table gives an
empty table; further columns pass through but for those it adds.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The host rules, allow and block.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
SUPPORT, CONFIDENCE, LEAST, FAR = 0.005, 0.9, 5, 4
#: Tokens of a labelled URL up to which FP-growth lists all combinations, which grow as powers of two of them.
ITEMS = 12
BLOCK = "=block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest_of(url: Column) -> Column:
    return F.coalesce(F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), "^[^/?#]*([^?#]*)", 1)


def rule_text(host: str, path: str) -> str:
    return f"{host}{path}"


def host_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of its text and action; null if none does."""
    out = None
    for action, h, p in sorted(rules, key=lambda r: -len(rule_text(*r[1:]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.struct(F.lit(rule_text(h, p)).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def tokens_of(url: Column) -> Column:
    """Distinct tokens: host labels by name, path parts, query names, numbers as one kind."""
    rest = rest_of(url)
    plain = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    labels = F.transform(F.split(host_of(url), "[.]"), lambda x: F.concat(F.lit("h:"), plain(x)))
    parts = F.transform(F.split(path_of(url), "/"), lambda x: F.concat(F.lit("p:"), plain(x)))
    names = F.transform(F.split(F.regexp_extract(rest, r"\?([^#]*)", 1), "&"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^[^=]*", 0)))
    every = F.array_distinct(F.concat(labels, parts, names))
    return F.filter(every, lambda x: F.length(x) > 2)


def rule_tokens(rules=RULES) -> list[str]:
    """The tokens that host rules are made of, as ``tokens_of`` writes them."""
    parts = {f"h:{x}" for _, h, _ in rules for x in h.split(".")} | {f"p:{x}" for _, _, p in rules for x in p.split("/")}
    return sorted({re.sub("[0-9]+", "0", x) for x in parts if len(x) > 2})


def classes(flat: DataFrame, least: float) -> DataFrame:
    """(id, blocked, t) -> (t, c): frequent tokens, and the one that stands for all that are in the same URLs."""
    # Tokens of the same URLs have the same count and the same hash of their ids.
    stats = flat.groupBy("t").agg(F.count("*").alias("n"), F.count_if("blocked").alias("k"), F.bit_xor(F.xxhash64("id")).alias("same")).where(F.col("n") >= least)
    heads = stats.groupBy("n", "k", "same").agg(F.min("t").alias("c"))
    return stats.join(heads, ["n", "k", "same"]).select("t", "c")


def transactions(flat: DataFrame, members: DataFrame) -> DataFrame:
    """(id, blocked, items) of each URL: all its classes of tokens."""
    return flat.join(members.where("t = c"), "t").groupBy("id").agg(F.first("blocked").alias("blocked"), F.sort_array(F.collect_list("t")).alias("items"))


def listed(rows: DataFrame, least: int, n_rows: int, confidence: float) -> DataFrame:
    """(tokens, confidence, support): what implies blocking, in at least ``least`` blocked rows, by FP-growth."""
    items = rows.select(F.when(F.col("blocked"), F.array_append("items", F.lit(BLOCK))).otherwise(F.col("items")).alias("items"))
    # Half a row less, so that rounding leaves the least count as it is.
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n_rows, minConfidence=confidence).fit(items).associationRules
    return found.where(F.array_contains("consequent", BLOCK)).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")


def grown(rows: DataFrame, least: int, n_rows: int, confidence: float) -> DataFrame:
    """As ``listed``, but for combinations that a rule with one token less makes needless.

    A combination is not built on if all rows with it are blocked, or if one token less stands in
    the same rows: with any more tokens, one less is as sure there, and as frequent.
    """
    at = materialize(rows.select("id", "blocked", F.explode("items").alias("t")).select("id", "blocked", F.array("t").alias("s")))
    found, before = None, None
    while True:
        sets = at.groupBy("s").agg(F.count("*").alias("n"), F.count_if("blocked").alias("k")).where(F.col("k") >= least)
        if before is not None:
            parts = sets.select("s", "n", "k", F.explode("s").alias("t")).select("s", "n", "k", F.filter("s", lambda x: x != F.col("t")).alias("part"))
            own = parts.join(before.select(F.col("s").alias("part"), F.col("n").alias("m")), "part").where("n < m")
            sets = own.groupBy("s", "n", "k").agg(F.count("*").alias("parts")).where(F.col("parts") == F.size("s")).drop("parts")
        sets = materialize(sets)
        found = sets if found is None else found.union(sets)
        before = sets.where("k < n")
        live = at.join(before.select("s"), "s", "left_semi").select("id", "blocked", F.slice("s", 1, F.size("s") - 1).alias("head"), F.element_at("s", -1).alias("t"))
        other = live.select("id", "head", F.col("t").alias("u"))
        at = materialize(live.join(other, ["id", "head"]).where("t < u").select("id", "blocked", F.concat("head", F.array("t", "u")).alias("s")))
        if at.isEmpty():
            break
    rules = found.select(F.col("s").alias("tokens"), (F.col("k") / F.col("n")).alias("confidence"), (F.col("k") / F.lit(n_rows)).alias("support"))
    return rules.where(F.col("confidence") >= confidence)


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(id, tokens, blocked) -> rules (rule, tokens, confidence, support) over classes of tokens, and the classes (t, c).

    The rules say what implies blocking, without those that a shorter one makes needless.

    Rows of one id count once, blocked if most of them are.
    """
    spark = labelled.sparkSession
    one = materialize(labelled.groupBy("id").agg(F.first("tokens").alias("tokens"), (F.avg(F.col("blocked").cast("double")) > 0.5).alias("blocked")))
    schema = "rule string, tokens array<string>, confidence double, support double"
    base, n = one.agg(F.avg(F.col("blocked").cast("double")), F.count("*")).first()
    least = max(support * n, LEAST)
    flat = one.select("id", "blocked", F.explode("tokens").alias("t"))
    members = materialize(classes(flat, least))
    rows = materialize(transactions(flat, members))
    n_rows, most = rows.agg(F.count("*"), F.max(F.size("items"))).first()
    if n_rows < LEAST:
        return spark.createDataFrame([], schema), members
    least = math.ceil(least)
    if least > n_rows:
        return spark.createDataFrame([], schema), members
    found = (listed if most <= ITEMS else grown)(rows, least, n_rows, confidence)
    n = n_rows
    more, fitting = F.col("confidence") - base, F.col("support") * n / F.col("confidence")
    found = found.where((more > 0) & (more * more * fitting >= FAR**2 * base * (1 - base)))
    found = materialize(found.select(F.array_join("tokens", " ").alias("rule"), "tokens", "confidence", "support"))
    # A rule is needless if leaving out one of its tokens is as sure.
    less = found.where(F.size("tokens") > 1).select("rule", "confidence", F.explode("tokens").alias("t"), "tokens")
    less = less.select("rule", "confidence", F.array_join(F.array_except("tokens", F.array("t")), " ").alias("shorter"))
    by = found.select(F.col("rule").alias("shorter"), F.col("confidence").alias("sure"))
    needless = less.join(by, "shorter").where("sure >= confidence").select("rule")
    return found.join(needless, "rule", "left_anti"), members


def match(urls: DataFrame, rules: DataFrame, members: DataFrame) -> DataFrame:
    """(id, tokens) rows and rules over classes -> (id, mined): the tokens that the surest fitting rule found, through the inverted index."""
    found = urls.select("id", F.explode("tokens").alias("t")).join(members, "t").groupBy("id", "c").agg(F.min("t").alias("t"))
    own = found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("c", "t"))).alias("own"))
    flat = own.select("id", "own", F.explode(F.map_keys("own")).alias("c"))
    often = flat.groupBy("c").agg(F.count("*").alias("n"))
    spread = rules.select("rule", "confidence", "tokens", F.explode("tokens").alias("c")).join(often, "c", "left")
    index = spread.groupBy("rule", "confidence", "tokens").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "c"))["c"].alias("c"))
    index = index.select("c", "rule", "confidence", F.col("tokens").alias("all"))
    hits = flat.join(index, "c").where(F.size(F.array_except("all", F.map_keys("own"))) == 0)
    hits = hits.withColumn("by", F.array_join(F.array_sort(F.transform("all", lambda c: F.col("own")[c])), " "))
    return hits.groupBy("id").agg(F.max(F.struct("confidence", "rule", "by"))["by"].alias("mined"))


def judge(pages: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule``, ``verdict`` and ``mined``, the association rule that blocked.

    Equal URLs are judged once: mining weighs them by label rows, matching by distinct URL.
    """
    p = pages.drop("host", "path", "rule", "verdict", "mined")
    p = p.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("__r", host_rule(F.col("host"), F.col("path")))
    p = p.withColumns({"__t": tokens_of(F.col("url")), "__id": F.xxhash64("url")})
    if labels is None:
        own = F.array_except("__t", F.array(*map(F.lit, rule_tokens())))
        labelled = p.where("__r is not null").select(F.col("__id").alias("id"), own.alias("tokens"), (F.col("__r.action") == "block").alias("blocked"))
    else:
        labelled = p.join(labels.select(F.col("page_id"), F.col("blocked")), "page_id").select(F.col("__id").alias("id"), F.col("__t").alias("tokens"), "blocked")
    rules, members = mine(labelled)
    open_ = p.where("__r is null").groupBy(F.col("__id").alias("id")).agg(F.first("__t").alias("tokens"))
    mined = match(open_, rules, members).withColumnRenamed("id", "__id")
    out = p.join(mined, "__id", "left")
    verdict = F.when(F.col("__r").isNotNull(), F.col("__r.action")).when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return out.withColumns({"rule": F.col("__r.rule"), "verdict": verdict, "mined": F.when(F.col("__r").isNull(), F.col("mined"))}).drop("__r", "__t", "__id")
