"""License labels against expectations written by hand, and the spans behind them."""

import pytest

from tidepanel.llm import licenses as LI

CC = "This work is licensed under a Creative Commons"
EXPECTED = [
    (f"{CC} Attribution 4.0 International License.", "cc-by"),
    (f"{CC} Attribution 3.0 Unported License.", "cc-by"),
    (f"{CC} Attribution-ShareAlike License.", "cc-by-sa"),
    (f"{CC} Attribution-ShareAlike 2.5 Generic License", "cc-by-sa"),
    (f"{CC} Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    (f"{CC} Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa"),
    (f"{CC} Attribution-NonCommercial-NoDerivatives License", "cc-by-nc-nd"),
    (f"{CC} Zero license", "cc0-1"),
    (f"{CC} zero something else entirely", "cc0-1"),
    ("This work is licensed under the GNU General Public License, version 2", "gpl-2"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3"),
    ("This work is licensed under the GNU Lesser General Public License version 3", "lgpl-3"),
    ("This work is licensed under the GNU General Public License, version 4", ""),
    (LI._GPL, "gpl"),
    (f"{LI._GPL}; either version 3 of the License, or (at your option) any later version.", "gpl-3"),
    (f"{LI._GPL}; either version 2 of the License, or (at your option) any later version.", "gpl-2"),
    (LI._MIT, "mit"),
    (" ".join(LI._MIT.split()[:44]), "mit"),
    (LI._ISC, "isc"),
    (LI._BSD_TERMS + LI._BSD_END, "bsd-2"),
    (LI._BSD_TERMS + LI._BSD_NAMES + LI._BSD_END, "bsd-3"),
    (" ".join(LI._BSD_TERMS.split()[:21]), "bsd"),
    (LI._ZLIB, "zlib"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache-2"),
    ("Released under the MIT license.", "mit"),
    ("cc by nc", "cc-by-nc"),
    (f"{CC} Attribution-ShareAlike License. {'word ' * 40} {LI._MIT}", "cc-by-sa,mit"),
    (f"{CC} Attribution 4.0 International License; cc by nc", "cc-by,cc-by-nc"),
    ("no license at all is granted for this work, under a creative mood", ""),
    ("", ""),
    (None, ""),
]


def test_labels_written_by_hand(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(EXPECTED)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in LI.license_scan(df).collect()}
    assert [(EXPECTED[i][0], got[i]) for i in got if got[i] != EXPECTED[i][1]] == []


def test_every_notice_gets_its_own_label(spark):
    rows = [(i, text, label) for i, label, _, text, _ in LI.templates()]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    want = {i: label for i, _, label in rows}
    assert {r["doc_id"]: r["labels"] for r in LI.license_scan(df).collect()} == want


def test_distinguishing_words_stand_in_every_notice():
    for _, label, phrase, text, needed in LI.templates():
        assert phrase or needed and all(needed), (label, text)


@pytest.mark.parametrize("times", [300])
def test_a_long_text_of_many_notices(spark, times):
    text = " ".join(f"{CC} Attribution-ShareAlike License. filler{i}" for i in range(times))
    row = LI.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"] == "cc-by-sa" and row["score"] == 1.0 and row["n_base"] == 0
