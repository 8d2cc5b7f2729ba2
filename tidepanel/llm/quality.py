"""Quality rules of documents and of the hosts they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.llm.common import BLANK_CLASS, BLANKS, free_name, words_of
from tidepanel.session import staged

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 50
MAX_DUP_LINE_PERCENT = 50
#: A host fails a rule when its shrunk rate lies so many standard deviations of the prior above the prior's mean, and above the least limit: most of its documents fail.
HOST_DEVIATIONS = 2.0
HOST_LIMIT = 0.5

RULES = ("short", "repeats", "symbols", "dup_lines")


def _covered(words: Column) -> Column:
    """Sorted ``(hash, place)`` of the three-word windows."""
    places = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.transform(places, lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")))
    return F.when(F.size(words) >= 3, F.sort_array(windows)).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))


def document_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and rule outcomes of each document; no row moves.

    A window that occurs twice is found by sorting the windows of its own document,
    with a 64-bit hash for the three words. A null text counts as one without words.
    """
    t, w, s, l, q = (free_name(c, docs) for c in ("t", "w", "s", "l", "q"))
    df = docs.withColumns({t: F.coalesce(F.col(text), F.lit("")), w: words_of(F.col(text))})
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.withColumns({s: _covered(F.col(w)), l: lines})
    sorted_ = F.col(s)
    again = F.filter(sorted_, lambda x, i: F.coalesce(x["h"] == F.get(sorted_, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(sorted_, i + 1)["h"], F.lit(False)))
    df = df.withColumn(q, F.sort_array(F.transform(again, lambda x: x["p"])))
    places = F.col(q)
    steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
    df = df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": (F.length(t) - F.regexp_count(t, F.lit(BLANK_CLASS))).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
            "n_lines": F.size(l).cast("long"),
            "n_dup_lines": (F.size(l) - F.size(F.array_distinct(l))).cast("long"),
            "n_repeat_words": F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long"),
        }
    ).drop(t, w, s, l, q)
    return df.withColumns(
        {
            "short": F.col("n_words") < MIN_WORDS,
            "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
            "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"),
            "dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"),
        }
    ).withColumn("base_failed", F.col("short") | F.col("repeats"))


def host_rates(ruled: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT, deviations: float = HOST_DEVIATIONS) -> DataFrame:
    """One row per host: for each rule the share of failing documents, shrunk to the other hosts, and ``host_failed``.

    The shares are taken as draws from a beta distribution whose mean is the share over all documents and whose
    strength comes from the spread between hosts beyond what counting alone gives (method of moments).
    A host of few documents is drawn to the mean, one of many keeps its own share. A host fails if the shrunk share of a rule is above ``host_limit`` and
    above the prior's mean by more than ``deviations`` of its standard deviations; so one host alone, or hosts that are all alike, never fail.
    Documents without a host belong to none.
    """
    counts = ruled.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.col(r).cast("long")).alias(f"f_{r}") for r in RULES)
    )
    counts = staged(counts, "hosts")
    total = counts.agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("hosts"), *(F.sum(f"f_{r}").alias(f"all_{r}") for r in RULES))
    rates = counts.withColumn("of", total.select(F.struct("*")).scalar()).select(*counts.columns, "of.*")
    for r in RULES:
        rates = rates.withColumn(f"m_{r}", F.col(f"all_{r}") / F.col("all_n")).withColumn(
            f"d_{r}", F.col("n") * F.pow(F.col(f"f_{r}") / F.col("n") - F.col(f"m_{r}"), 2)
        )
    spread = rates.agg(*(F.sum(f"d_{r}").alias(f"sum_{r}") for r in RULES))
    rates = rates.withColumn("of", spread.select(F.struct("*")).scalar()).select(*rates.columns, "of.*")
    for r in RULES:
        chance = F.col(f"m_{r}") * (1 - F.col(f"m_{r}"))
        between = (F.col(f"sum_{r}") - F.col("hosts") * chance) / F.col("all_n")
        strength = F.when(between > 0, F.greatest(F.lit(1.0), F.least(F.col("all_n").cast("double"), chance / between - 1))).otherwise(F.col("all_n").cast("double"))
        rates = rates.withColumn(f"rate_{r}", (F.col(f"f_{r}") + F.col(f"m_{r}") * strength) / (F.col("n") + strength))
        limit = F.greatest(F.lit(host_limit), F.col(f"m_{r}") + deviations * F.sqrt(chance / (strength + 1)))
        rates = rates.withColumn(f"over_{r}", F.col(f"rate_{r}") > limit)
    worst = F.greatest(*(F.col(f"rate_{r}") for r in RULES))
    return rates.select(host, F.col("n").alias("host_documents"), *(f"rate_{r}" for r in RULES), worst.alias("host_rate"), F.greatest(*(F.col(f"over_{r}") for r in RULES)).alias("host_failed"))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT, deviations: float = HOST_DEVIATIONS) -> DataFrame:
    """Judge every document by its own rules and by its host: one row per row, texts left out.

    A document is kept when it passes the base rules and its host fails none (``host_rates``). Null text: no words, so it fails. Null host: own rules only. Repeated rows are
    judged and counted one by one. An empty table gives an empty result. Other columns stay, but for those that the result names.
    """
    names = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", *RULES, "base_failed", "host_documents", "host_rate", "host_failed", "kept", *(f"rate_{r}" for r in RULES)}
    own = docs.drop(*(names - {text, host}))
    ruled = staged(document_rules(own, text).drop(text), "ruled")
    hosts = host_rates(ruled, host, host_limit, deviations)
    joined = ruled.join(hosts, host, "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False)))
