"""Benchmark passages in documents by a prefix-filtered set join, in DataFrame operations only.

An item is cut into windows of ``WINDOW`` words (a shorter item is one window). A window is a set of word shingles, each at its place, and a
document holds the window when it holds all of them at those places. So one necessary shingle is enough to find every holder.

1. Shingles that stand in any item are looked up in all documents, with their places.
2. Shingles are ordered by rarity, which is their number of occurrences in the documents. The prefix that containment of the whole set leaves
   necessary is the rarest shingle of a window; only prefixes probe. A window with a shingle that no document holds probes for nothing.
3. A prefix found at a place fixes where the window would begin. Length and positional bounds drop what would begin before or end after the text.
4. Each place left is verified: the words of the document there, as many as the window has, must be the words of a window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.llm.common import BROADCAST_ROWS, small_side
from tidepanel.llm.licenses import NO_WORD, lowered
from tidepanel.session import staged

WINDOW = 10
GRAM = 3
#: Parts that a shingle's occurrences are dealt over where the shingles of the items are too many to broadcast.
SALTS = 16


def _split(text: Column) -> Column:
    """Words, with an empty string before the first and after the last where the text begins or ends with other characters."""
    return F.split(lowered(F.coalesce(text, F.lit(""))), NO_WORD + "+")


def _worded(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), _split(F.col("text")).alias("w"))
    lead = (F.get("w", F.lit(0)) == "").cast("int")
    trail = F.when(F.size("w") > 1, (F.get("w", F.size("w") - 1) == "").cast("int")).otherwise(0)
    return rows.withColumns({"skip": lead, "n_words": F.size("w") - lead - trail})


def _shingles(words: Column, k: int) -> Column:
    """Hashes of all ``k`` neighbouring words; what reaches beyond the end hashes the words there are."""
    last = F.greatest(F.size(words) - k, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct ``(item, window)``, the window as its words with blanks between. A null id is the empty one; items without words have none."""
    worded = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.filter(_split(F.col("text")), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    cut = F.transform(F.sequence(F.lit(0), F.size("w") - length), lambda i: F.array_join(F.slice("w", i + 1, length), " "))
    return worded.select("item", F.explode(cut).alias("window")).distinct()


def _meet(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Rows of ``many`` with those of ``few`` by ``key``. ``few`` (numbers) is broadcast up to ``BROADCAST_ROWS`` rows; beyond, a frequent key is dealt over ``SALTS`` parts."""
    few = staged(few, "few")
    if few.count() <= BROADCAST_ROWS:
        return many.join(F.broadcast(few), key)
    dealt = many.withColumn("salt", F.pmod(F.xxhash64("digest", "at"), F.lit(SALTS)).cast("int"))
    return dealt.join(few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "salt"]).drop("salt")


def _probes(grams: DataFrame, hits: DataFrame) -> DataFrame:
    """The rarest shingle of each window that every shingle's count allows: distinct ``(gram, offset, length)``."""
    counts = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "offset")
    first = grams.join(counts, "gram", "left").groupBy("window", "length").agg(F.min(rarity).alias("first"))
    return first.where("first.n > 0").select("first.gram", "first.offset", "length").distinct()


def occurrences(docs: DataFrame, windows: DataFrame, gram: int = GRAM) -> DataFrame:
    """Where documents hold windows: distinct ``(doc_id, digest, start, length, window)``, ``start`` in words from 0, ``digest`` of the text."""
    words = F.split("window", " ")
    texts = staged(windows.select("window").distinct(), "windows")
    held = texts.select("window", F.size(words).alias("length"), F.posexplode(_shingles(words, gram)).alias("offset", "gram"))
    grams = staged(held, "grams")
    sizes = [r["k"] for r in grams.select(F.least("length", F.lit(gram)).alias("k")).distinct().collect()]  # at most ``gram`` numbers
    rows = _worded(docs)
    every = [rows.where(F.size("w") >= k).select("doc_id", "digest", "skip", "n_words", F.posexplode(_shingles(F.col("w"), k)).alias("at", "gram")) for k in sizes]
    if not every:
        every = [rows.select("doc_id", "digest", "skip", "n_words", F.lit(0).alias("at"), F.lit(0).cast("long").alias("gram")).limit(0)]
    met = _meet(reduce(DataFrame.union, every), grams.select("gram").distinct(), "gram")
    hits = staged(met.select("doc_id", "digest", "n_words", (F.col("at") - F.col("skip")).alias("at"), "gram"), "hits")

    found = _meet(hits, _probes(grams, hits), "gram").withColumn("start", F.col("at") - F.col("offset"))
    found = found.where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
    places = found.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "length")).alias("places")).withColumnsRenamed({"doc_id": "p_doc", "digest": "p_digest"})
    places = small_side(places, F.size("places") + 1)
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    mine = mine.join(places, F.col("doc_id").eqNullSafe(F.col("p_doc")) & (F.col("digest") == F.col("p_digest")))
    mine = mine.select("doc_id", "digest", "places", _split(F.col("text")).alias("w")).withColumn("skip", (F.get("w", F.lit(0)) == "").cast("int"))
    here = F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"), F.array_join(F.slice("w", p["start"] + F.col("skip") + 1, p["length"]), " ").alias("window")))
    return mine.select("doc_id", "digest", F.inline(here)).join(texts, "window", "left_semi").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit`` (words inside windows of items), ``places`` (sorted ``start``, ``stop`` of the windows held, in words) and ``items`` (sorted ids, as strings).

    Null and empty texts have no words, in documents and items. Rows with one id and one text are found once and give the same row each; ids may be
    null. Items of one id are one item, those of a null id are the item with the empty id. Other columns are left out; without documents the result is empty.
    """
    windows = staged(item_windows(items, window), "items")
    found = staged(occurrences(docs, windows, gram), "occurrences")
    span = F.struct("start", (F.col("start") + F.col("length")).alias("stop"))
    per = found.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(span)).alias("places"), F.sort_array(F.collect_set("window")).alias("held"))
    per = staged(per.withColumn("set", F.sha2(F.array_join("held", ","), 256)), "per")
    # documents that hold the same windows hold the same items, which are looked up once
    sets = per.groupBy("set").agg(F.any_value("held").alias("held")).select("set", F.explode("held").alias("window"))
    sets = staged(sets.join(windows, "window").groupBy("set").agg(F.sort_array(F.collect_set("item")).alias("items")), "sets")
    start = F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n"))
    covered = F.aggregate(
        "places", start,
        lambda a, x: F.struct(F.greatest(a["stop"], x["stop"]).alias("stop"), (a["n"] + F.greatest(x["stop"] - F.greatest(a["stop"], x["start"]), F.lit(0))).alias("n")),
        lambda a: a["n"],
    )
    result = per.join(sets, "set").select(F.col("doc_id").alias("f_doc"), F.col("digest").alias("f_digest"), covered.cast("long").alias("n_hit"), "places", "items")
    rows = _worded(docs).select("doc_id", "digest", F.col("n_words").cast("long").alias("n_words"))
    out = rows.join(result, F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("digest") == F.col("f_digest")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("places", F.array().cast("array<struct<start:int,stop:int>>")).alias("places"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``contamination`` in digest columns."""
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
