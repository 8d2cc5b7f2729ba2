"""License notices by diagonal voting, in DataFrame operations only.

1. Every rolling word trigram of every text meets the trigrams of the templates by its 64-bit hash.
2. A match votes for a diagonal: the place of the text's word minus the place of the template's word.
3. Neighbouring diagonals of one template are merged (a word too many or too few shifts the diagonal by one), which gives a span.
4. A span is verified by the share of the template's trigrams that it holds, and by the words that tell the license from its like, which must stand in it.
   Of overlapping spans of different labels the best one stays. A phrase, the shortest kind of template, must be there whole, on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidepanel.session import staged

GRAM = 3
SHIFT = 2
COVER = 0.6
MIN_GRAMS = 6
CELL = 64

#: Fixed: characters that are no part of a word.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"

#: Fixed: phrases whose presence alone gives the label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_MIT = """
permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other
liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software
"""
_BSD_TERMS = """
redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
materials provided with the distribution
"""
_BSD_NAMES = """
neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission
"""
_BSD_END = """
this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to
the implied warranties of merchantability and fitness for a particular purpose are disclaimed
"""
_ISC = """
permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software
"""
_ZLIB = """
this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
"""
_UNLICENSE = """
this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software
either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means
"""
_APACHE = """
licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
you may obtain a copy of the license at
"""
_MPL = """
this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at
"""
_GPL = """
this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
as published by the free software foundation
"""
_WAIVER = """
to the extent possible under law the author has waived all copyright and related or neighboring rights to this work
"""
_COMMONS = {
    "cc-by": "attribution", "cc-by-sa": "attribution sharealike", "cc-by-nc": "attribution noncommercial", "cc-by-nd": "attribution noderivatives",
    "cc-by-nc-sa": "attribution noncommercial sharealike", "cc-by-nc-nd": "attribution noncommercial noderivatives",
}


def _notices() -> list[tuple[str, str, tuple[str, ...]]]:
    """Label, text, and the phrases of up to three words that tell it from its like and must stand in a span."""
    out = [
        ("mit", _MIT, ("obtaining a copy",)), ("mit", " ".join(_MIT.split()[:42]), ("obtaining a copy",)),
        ("bsd", " ".join(_BSD_TERMS.split()[:21]), ("source and binary",)),
        ("bsd-2", _BSD_TERMS + _BSD_END, ("in binary form",)), ("bsd-3", _BSD_TERMS + _BSD_NAMES + _BSD_END, ("neither the name",)),
        ("isc", _ISC, ("without fee is",)), ("zlib", _ZLIB, ("alter it and",)), ("unlicense", _UNLICENSE, ("free and unencumbered",)),
        ("apache-2", _APACHE, ("the apache license", "version 2")), ("mpl-2", _MPL, ("the mozilla public",)),
        ("gpl", _GPL, ("gnu general public",)), ("cc0-1", _WAIVER, ("has waived all",)), ("cc0-1", "this work is licensed under a creative commons zero license", ("commons zero",)),
    ]
    for n in "23":
        out.append((f"gpl-{n}", f"this work is licensed under the gnu general public license version {n}", ("gnu general public", f"version {n}")))
        out.append((f"gpl-{n}", f"{_GPL} either version {n} of the license or at your option any later version", ("gnu general public", f"version {n}")))
    out.append(("lgpl-3", "this work is licensed under the gnu lesser general public license version 3", ("gnu lesser general", "version 3")))
    for label, name in _COMMONS.items():
        for tail in ("license", "4 0 international license", "3 0 unported license"):
            words = name.split()
            # attribution alone must be followed by the end of the name
            keys = tuple(" ".join(x) for x in zip(words, words[1:])) or (f"commons attribution {tail.split()[0]}",)
            out.append((label, f"this work is licensed under a creative commons {name} {tail}", keys))
    return out


def templates() -> list[tuple[int, str, bool, str, list[list[int]]]]:
    """Number, label, whether a phrase, words, and for each distinguishing phrase the trigrams one of which a span must hold. Phrases come first."""
    rows = [(label, True, text.split(), ()) for text, label in PHRASES.items()] + [(label, False, text.split(), keys) for label, text, keys in _notices()]
    out = []
    for i, (label, phrase, words, keys) in enumerate(rows):
        needed = []
        for key in keys:
            k = key.split()
            places = [p for p in range(len(words) - len(k) + 1) if words[p : p + len(k)] == k]
            last = len(words) - GRAM
            needed.append(sorted({t for p in places for t in range(max(0, p + len(k) - GRAM), min(p, last) + 1)}))
        out.append((i, label, phrase, " ".join(words), needed))
    return out


def _template_table(spark: SparkSession) -> DataFrame:
    """``template``, ``label``, ``phrase``, ``t_words``, ``t_grams`` and ``needed`` of every template, a constant."""
    none = F.array().cast("array<array<int>>")
    entries = [
        F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(phrase).alias("phrase"), F.split(F.lit(text), " ").alias("t_words"), F.array(*(F.array(*map(F.lit, x)) for x in needed)).alias("needed") if needed else none.alias("needed"))
        for i, label, phrase, text, needed in templates()
    ]
    return spark.range(1).select(F.inline(F.array(*entries))).withColumn("t_grams", F.size("t_words") - GRAM + 1)


def _template_grams(spark: SparkSession) -> DataFrame:
    w = F.col("t_words")
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(GRAM))))
    return _template_table(spark).select("template", F.posexplode(grams).alias("t_at", "gram"))


def lowered(text: Column) -> Column:
    """A-Z lower-cased. ``lower`` does it, but for texts with one of the two other letters that it turns into ASCII ones."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike("[Kİ]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def _best_of_overlapping(spans: DataFrame) -> DataFrame:
    """Spans but for notices that overlap a better one of another label: of a greater share of its template, then of more trigrams, then of an earlier template.

    Overlapping spans meet in a cell of ``CELL`` words of their text, so a long text with many notices is not compared as a whole.
    """
    notices = spans.where(~F.col("phrase"))
    cells = F.explode(F.sequence(F.floor(F.col("first") / CELL), F.floor((F.col("stop") - 1) / CELL))).alias("cell")
    rank = F.struct("share", "n_held", -F.col("template"))
    mine = notices.select("doc_id", "digest", "template", "span", "label", "first", "stop", rank.alias("rank"), cells)
    other = mine.select(*(F.col(c).alias(f"o_{c}") for c in mine.columns))
    here = F.col("doc_id").eqNullSafe(F.col("o_doc_id")) & (F.col("digest") == F.col("o_digest")) & (F.col("cell") == F.col("o_cell"))
    over = (F.col("first") < F.col("o_stop")) & (F.col("o_first") < F.col("stop")) & (F.col("label") != F.col("o_label")) & (F.col("o_rank") > F.col("rank"))
    beaten = mine.join(other, here & over, "left_semi").select(F.col("doc_id").alias("b_doc"), F.col("digest").alias("b_digest"), F.col("template").alias("b_template"), F.col("span").alias("b_span"))
    same = F.col("doc_id").eqNullSafe(F.col("b_doc")) & (F.col("digest") == F.col("b_digest")) & (F.col("template") == F.col("b_template")) & (F.col("span") == F.col("b_span"))
    return spans.join(beaten, same, "left_anti")


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row: ``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels`` and ``score``.

    ``n_base`` counts the places of whole phrases; ``score`` is the largest share of a template that a span holds, 1 for a phrase and 0 without any
    accepted span. Null counts as empty. Rows with one id and one text are found once and give the same row each; ids may be null. Other columns are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), F.split(lowered(text), NO_WORD + "+").alias("w"))
    lead = (F.get("w", F.lit(0)) == "").cast("int")
    trail = F.when(F.size("w") > 1, (F.get("w", F.size("w") - 1) == "").cast("int")).otherwise(0)
    rows = rows.withColumns({"skip": lead, "n_words": (F.size("w") - lead - trail).cast("long")})
    w = F.col("w")
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(GRAM))))
    every = rows.where(F.size(w) >= GRAM).select("doc_id", "digest", "skip", F.posexplode(grams).alias("at", "gram"))
    # the templates are a constant
    hits = every.join(F.broadcast(_template_grams(docs.sparkSession)), "gram")
    hits = hits.select("doc_id", "digest", "template", "t_at", (F.col("at") - F.col("skip") - F.col("t_at")).alias("diagonal")).distinct()
    votes = hits.groupBy("doc_id", "digest", "template", "diagonal").agg(F.collect_set("t_at").alias("held"))
    run = Window.partitionBy("doc_id", "digest", "template").orderBy("diagonal")
    apart = (F.col("template") < len(PHRASES)) | (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 30)).over(run) > SHIFT)
    votes = votes.withColumn("span", F.sum(apart.cast("int")).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = votes.groupBy("doc_id", "digest", "template", "span").agg(
        F.min("diagonal").alias("start"),
        F.min(F.col("diagonal") + F.array_min("held")).alias("first"),
        (F.max(F.col("diagonal") + F.array_max("held")) + GRAM).alias("stop"),
        F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"),
    )
    spans = spans.join(F.broadcast(_template_table(docs.sparkSession).drop("t_words")), "template")
    share = F.size("held") / F.col("t_grams")
    told = F.forall("needed", lambda x: F.arrays_overlap(x, F.col("held")))
    whole = F.when(F.col("phrase"), F.size("held") == F.col("t_grams")).otherwise((share >= COVER) & (F.size("held") >= MIN_GRAMS) & told)
    good = spans.where(whole).select("doc_id", "digest", "template", "span", "label", "phrase", "start", "first", "stop", share.alias("share"), F.size("held").alias("n_held"))
    good = _best_of_overlapping(staged(good, "spans"))
    base = F.when(F.col("phrase"), F.col("start"))
    found = good.groupBy("doc_id", "digest").agg(
        F.count(base).alias("n_base"),
        F.min(base).cast("long").alias("first_word"),
        F.max(base).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    found = found.withColumnsRenamed({"doc_id": "f_doc", "digest": "f_digest"})
    out = rows.select("doc_id", "digest", "n_words").join(found, F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("digest") == F.col("f_digest")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
