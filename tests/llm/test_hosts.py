"""The host verdict of the quality rules, with expectations worked out by hand."""

import math

import pytest

from tidepanel.llm.quality import RULES, quality_rules

CLEAN = " ".join(f"word{i}" for i in range(80))
NOISY = " ".join(f"#$%|<>*&#$%|<>*&a{i}" for i in range(80))
SCHEMA = "doc_id long, text string, source string"


def rows_of(shares, n=100):
    """``n`` documents of each host, of which so many are full of symbols."""
    return [(100_000 * h + i, NOISY if i < bad else CLEAN, f"host{h}") for h, bad in enumerate(shares) for i in range(n)]


def by_hand(shares, n=100):
    m = sum(shares) / (n * len(shares))
    chance = m * (1 - m)
    between = (sum(n * (f / n - m) ** 2 for f in shares) - len(shares) * chance) / (n * len(shares))
    strength = max(1.0, min(float(n * len(shares)), chance / between - 1)) if between > 0 else float(n * len(shares))
    limit = max(0.5, m + 2 * math.sqrt(chance / (strength + 1)))
    return {f"host{h}": (f + m * strength) / (n + strength) > limit for h, f in enumerate(shares)}


@pytest.mark.parametrize("shares", [(3, 5, 4, 6, 2, 5, 4, 3, 90), (3, 5, 4, 6, 2, 5, 4, 3, 40), (90, 90, 90), (60,), (0, 0), (5, 4, 6, 3, 85, 7, 2, 88, 4, 5, 3, 4)])
def test_hosts_as_worked_out(spark, shares):
    out = quality_rules(spark.createDataFrame(rows_of(shares), SCHEMA))
    got = {r["source"]: r["host_failed"] for r in out.select("source", "host_failed").distinct().collect()}
    assert got == by_hand(shares)


def test_one_bad_host_loses_its_clean_documents_too(spark):
    rows = rows_of((3, 5, 4, 6, 2, 5, 4, 3, 90)) + [(7, CLEAN, None)]
    out = quality_rules(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "source", "kept", *RULES).collect()
    assert {r["source"] for r in out if not r["kept"]} == {"host8"}
    assert not any(r["kept"] for r in out if r["source"] == "host8")
    assert any(not r["symbols"] for r in out if r["source"] == "host8")
    assert [r["kept"] for r in out if r["source"] is None] == [True]


def test_a_host_of_few_documents_is_drawn_to_the_mean(spark):
    rows = rows_of((3, 5, 4, 6, 2, 5, 4, 3)) + [(900_000, NOISY, "tiny"), (900_001, CLEAN, "tiny")]
    out = quality_rules(spark.createDataFrame(rows, SCHEMA)).where("source = 'tiny'").collect()
    assert [r["host_failed"] for r in out] == [False, False]
