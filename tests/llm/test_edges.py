"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as CP
from tidepanel.llm.fingerprints import fingerprints
from tidepanel.llm.licenses import license_scan
from tidepanel.llm.lines import drop_lines, line_report
from tidepanel.llm.ngram import ngram_join
from tidepanel.llm.packing import pack
from tidepanel.llm.passages import drop_passages
from tidepanel.llm.pii import pii_report
from tidepanel.llm.quality import quality_rules
from tidepanel.llm.sentencepieces import piece_report
from tidepanel.llm.transducer import token_counts

OPERATORS = {
    "quality": quality_rules, "pieces": piece_report, "fingerprints": fingerprints, "ngram": ngram_join, "pack": pack, "pii": pii_report,
    "lines": line_report, "tokens": token_counts, "licenses": license_scan, "passages": drop_passages,
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}." for i in range(20_000))
TEXTS = [None, "", "   \n\t ", "one", "Same line here.\nSame line here.", "Same line here.\nSame line here.", LONG, LONG, "é" * 3 + "\x1c\x85 ünï", "a\x00b |"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "src", None) for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[3], (None, "no id", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    # columns whose names the operators use themselves
    own = ("key", "n", "h1", "kept", "piece", "spans", "component_id", "a", "b", "id", "dropped", "_doc", "_t", "_w", "_s", "_l", "_q", "t", "w", "version", "v_doc", "f_doc", "f_version", "no_id", "gone", "digest")
    return df.withColumns({c: F.lit("x") for c in own})


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_every_row(odd, name):
    out = OPERATORS[name](odd).collect()
    ids = [r["doc_id"] for r in out if name != "pack" or r["piece"] == 0]
    assert sorted(-1 if i is None else i for i in ids) == sorted([-1, *range(10), 6, 3])


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_repeated_rows_agree(odd, name):
    if name in ("pack", "fingerprints"):
        return  # places and neighbours differ by nature
    rows = [r for r in OPERATORS[name](odd).collect() if r["doc_id"] in (3, 6)]
    for i in (3, 6):
        own = [r for r in rows if r["doc_id"] == i]
        assert len(own) == 2 and own[0] == own[1]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name,stage", CP.STAGES)
def test_stages(spark, odd, name, stage):
    empty = spark.createDataFrame([], SCHEMA)
    assert stage(spark, empty, "").collect() == []
    out = stage(spark, odd, "")
    if name != "packing":
        assert out.columns == odd.columns
    kept = {r["doc_id"] for r in out.collect()}
    if name in ("pii", "packing"):
        assert kept == {None, *range(10)}
    if name in ("line_dedup", "ngram_join"):
        assert kept == {None, *range(10)} - {5, 7}
    if name == "quality_rules":
        assert kept == {6, 7}


def test_a_hot_group_of_one_line_and_one_text(spark):
    rows = [(i, "hot line of many\nown line number " + str(i) if i % 3 else "the very same text of all of these", None, "s", None) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["doc_id"]: r["dropped"] for r in line_report(df).collect()}
    assert found[0] == [] and found[3] == [0] and found[1] == [] and found[4][0] == 0
    groups = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join(df, n=3, percent=90).collect()}
    assert all(groups[i] == (0, 199) for i in range(0, 600, 3))


SENTENCE = "only copy of this sentence in the world"


def test_one_id_with_two_texts(spark):
    """Different texts of one id are different documents: what one repeats is not cut from the other."""
    line = "a line that stands in several documents of this table"
    rows = [(1, f"{line}\nunique one"), (2, f"{line}\nx y"), (2, f"{SENTENCE}\nz"), (2, f"{SENTENCE}\nz"), (3, None), (2, None), (None, line), (4, f"{SENTENCE}\nz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["n_lines"], r["dropped"]) for r in line_report(df).collect())
    assert found == [(0, 0, []), (1, 2, []), (2, 0, []), (2, 2, []), (2, 2, []), (2, 2, [0]), (3, 0, []), (4, 2, [0, 1])]
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in drop_lines(df).collect())
    assert left == [(0, line), (1, f"{line}\nunique one"), (2, ""), (2, f"{SENTENCE}\nz"), (2, f"{SENTENCE}\nz"), (2, "x y"), (3, ""), (4, "")]
    assert sorted(r["doc_id"] or 0 for r in drop_lines(df, emptied=False).collect()) == [0, 1, 2, 2, 2, 2, 3]


def test_one_id_with_two_texts_keeps_its_passages(spark):
    words = [f"w{i}" for i in range(200)]
    own, other = " ".join(words[:80]) + ".", " ".join(words[80:160]) + "."
    df = spark.createDataFrame([(1, own), (2, own), (2, other), (2, None), (3, other)], "doc_id long, text string")
    left = [(r["doc_id"], r["text"]) for r in drop_passages(df).collect()]
    # the first document that holds a text keeps all of it, the later ones lose its repeated spans
    assert (1, own) in left and (2, other) in left and (2, None) in left
    assert all(len(t) < 80 for d, t in left if t not in (own, other, None)) and len([t for _, t in left if t in (own, other)]) == 2


def test_large_ids_beside_null_are_packed_to_the_last_bit(spark):
    big = (1 << 53) + 1
    df = spark.createDataFrame([(big, "a b c"), (None, "d e"), (-big, "f"), (0, "g")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in pack(df).collect()) == sorted(map(str, (big, None, -big, 0)))


def test_near_stage_judges_texts_of_one_id_each_for_itself(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b), (8, "c"), (None, a)], "doc_id long, text string")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in CP.near_stage(spark, df, "").collect())
    assert len(kept) == 4 and [k for k in kept if k[1] == a] == [(0, a), (1, a)] and sum(k[1] == b for k in kept) == 1


def test_quality_keeps_own_columns(odd):
    out = quality_rules(odd)
    assert {"_t", "_w", "_s", "_l", "_q", "t", "w"} <= set(out.columns)
    assert {r["_t"] for r in out.collect()} == {"x"}


def test_no_blank_document_is_packed(spark):
    text = "\n".join(" ".join(f"word{i}of{j * 7 + i}" for j in range(15)) for i in range(6))
    rows = [(i, text, "en", "s", len(text)) for i in range(5)] + [(9, text + "\nmore", "en", "s", len(text) + 5)]
    left = CP.line_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in left) == [(0, text, len(text)), (9, "more", 4)]
