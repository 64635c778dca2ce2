"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document into one failure bit next to the
measurements it used. A policy is a versioned set of rules; applying one, and
asking what each rule alone decides, are bit operations on the stored ledger.

Defined results: a null or empty text has no words and fails ``few_words``;
repeated rows each get their own equal ledger row; an empty table gives an empty
ledger; other columns of the input are carried by ``apply_policy`` untouched, and
the ledger's own columns replace any of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, words_of

#: Rule name -> bit. Bits are never reused, so stored ledgers stay readable.
RULES = {
    "few_words": 0,
    "repeated_trigrams": 1,
    "symbols_per_word": 2,
    "duplicate_lines": 3,
    "upper_case": 4,
    "word_length": 5,
    "exclamation": 6,
}
#: Policies by version: the rules whose failure rejects a document.
BASE = ("few_words", "repeated_trigrams")
POLICIES = {1: BASE, 2: tuple(RULES)}
CURRENT = 2

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs")


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES[r] for r in rules)


def once(value: Column) -> Column:
    """The same value, from an expression that the optimizer neither copies into its users nor pushes filters through."""
    return F.when(F.spark_partition_id() >= 0, value)


def _kept_chars(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, "")).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """Adds the measurements, all JVM-side and inside one row: no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("__words", once(words_of(F.col("text"))))
    d = d.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK}]")))
    n = F.size("__words")
    at = lambda i: F.get("__words", i)
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("i"))))
    d = d.withColumn("__grams", once(F.array_sort(F.coalesce(grams, F.array().cast("array<struct<h:bigint,i:int>>")))))
    # Sorted by hash, a repeated window has an equal neighbour.
    near = lambda x, i: (F.get("__grams", i - 1)["h"] == x["h"]) | (F.get("__grams", i + 1)["h"] == x["h"])
    again = F.filter("__grams", lambda x, i: F.coalesce(near(x, i), F.lit(False)))
    starts = F.array_sort(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"].cast("long"),
    )
    return d.withColumns({
        "n_words": once(n.cast("long")),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": _kept_chars(text, r"[^#*$%&|<>]+"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": covered,
        "n_upper": _kept_chars(text, r"[^\p{Lu}]+"),
        "n_letters": _kept_chars(text, r"\P{L}+"),
        "n_bangs": _kept_chars(text, r"[^!]+"),
    }).drop("__words", "__lines", "__grams")


def failures() -> dict[str, Column]:
    """Each rule as a condition on the measurements, in whole numbers only."""
    c = F.col
    return {
        "few_words": c("n_words") < 50,
        "repeated_trigrams": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols_per_word": 100 * c("n_symbols") > 10 * c("n_words"),
        "duplicate_lines": 100 * c("n_dup_lines") > 50 * c("n_lines"),
        "upper_case": 100 * c("n_upper") > 50 * c("n_letters"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")),
        "exclamation": 100 * c("n_bangs") > 10 * c("n_words"),
    }


def ledger(docs: DataFrame) -> DataFrame:
    """The documents with measurements and ``fail_bits``; each rule is evaluated once."""
    bits = F.lit(0).cast("long")
    for rule, failed in failures().items():
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << RULES[rule])).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("fail_bits", once(bits))


def apply_policy(led: DataFrame, version: int = CURRENT, into: str = "kept") -> DataFrame:
    return led.withColumn(into, F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablation(led: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects.

    One pass: bit tests summed map-side, one row per rule shuffled.
    """
    chosen = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])))
    sums = []
    for r in POLICIES[version]:
        bit = F.lit(1 << RULES[r])
        sums += [F.count_if(chosen.bitwiseAND(bit) != 0).alias(f"f_{r}"), F.count_if(chosen == bit).alias(f"o_{r}")]
    one = led.agg(*sums)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only")) for r in POLICIES[version]])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def judge(docs: DataFrame) -> DataFrame:
    """Ledger rows with ``base_failed`` (policy 1) and ``kept`` (current policy; base failures are never kept)."""
    led = ledger(docs)
    return apply_policy(led).withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(mask(BASE))) != 0)
