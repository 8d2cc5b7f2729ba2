"""Removal of repeated and nearly repeated lines by a segment-partition edit join.

A line is dropped when an earlier line, in the order of ``(doc_id, line number)``, is equal to it or differs by at most
``MAX_EDITS`` edits. Edits are single UTF-8 bytes inserted, deleted or replaced. Lines under ``MIN_BYTES`` only go when they are equal.

1. Equal lines meet by two 64-bit hashes of the line.
2. A line of ``n`` bytes is cut into ``MAX_EDITS + 1`` segments; if another line is near, one of them stands in it unchanged, at a place
   that the two lengths bound. So each line indexes its segments by (length, segment number, content) and probes with the few substrings
   that can match a segment of a line as long or up to ``MAX_EDITS`` bytes shorter.
3. A candidate must also agree in most bits of a signature: the parity of hashed byte pairs. An edit changes at most four of them.
4. What is left is verified by edit distance, bit-parallel in a band around the diagonal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.common import _IS_BLANK, BLANKS, free_name, map_batches, mix64, signed, slices, shared_ids, small_side, text_buffer, versioned, with_found
from tidepanel.session import staged

MAX_EDITS = 2
MIN_BYTES = 24
#: Hashes of lines that a task keeps to tell equal lines.
SEEN = 1 << 18

_PAIR_BIT = np.uint64(1) << (mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(77)) >> np.uint64(58))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segments(n: int, parts: int) -> list[tuple[int, int]]:
    """Start and length of ``parts`` segments of a line of ``n`` bytes; the last ones take what does not divide."""
    base, rest = divmod(n, parts)
    out, at = [], 0
    for i in range(parts):
        size = base + (i >= parts - rest)
        out.append((at, size))
        at += size
    return out


def probe_windows(n: int, shorter: int, edits: int) -> list[tuple[int, int, int, int]]:
    """Where segment ``i`` of a line ``shorter`` bytes shorter can stand in one of ``n`` bytes: (i, first, last, length)."""
    out = []
    for i, (p, size) in enumerate(segments(n - shorter, edits + 1)):
        right = edits - i
        out.append((i, max(0, p - i, p + shorter - right), min(n - size, p + i, p + shorter + right), size))
    return out


def edit_distance_within(a: bytes, b: bytes, k: int) -> int:
    """Edit distance of two byte strings, or ``k + 1`` if it is larger; one machine word a column covers the band."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > k:
        return k + 1
    if a == b:
        return 0
    start = 0
    while start < len(b) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    while b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    m, n = len(a), len(b)
    if m <= k or not n:
        # the band covers the whole table
        row = list(range(m + 1))
        for j in range(n):
            last, row[0] = row[0], j + 1
            for i in range(m):
                last, row[i + 1] = row[i + 1], min(row[i + 1] + 1, row[i] + 1, last + (a[i] != b[j]))
        return min(row[m], k + 1)
    where: dict[int, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    width = 2 * k + 1
    mask = (1 << width) - 1
    top = width - 1
    vp, vn, score = mask ^ ((1 << (width - k - 1)) - 1), 0, k
    level = 1 << (top - 1)
    for j in range(n):
        at = j + k - top  # pattern index of bit 0
        bits = where.get(b[j], 0)
        x = (bits >> at if at >= 0 else bits << -at) & mask
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        if j < m - k:
            score += not d0 >> top
        else:
            score += bool(hp & level) - bool(hn & level)
            level >>= 1
        vp = (hn | ~((d0 >> 1) | hp)) & mask
        vn = (d0 >> 1) & hp
    return min(score, k + 1)


def _line_bounds(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes, and document index, line number, start and end of each line that has a word."""
    data, offsets = text_buffer(texts)
    breaks = np.flatnonzero(data == 10)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    starts = np.concatenate([offsets[filled], breaks + 1])
    owner = np.concatenate([filled, np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    first = np.searchsorted(owner, owner, "left")
    number = np.arange(len(owner)) - first
    ends = np.append(starts[1:] - 1, 0)
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    ends[last] = offsets[owner[last] + 1]
    words = np.concatenate([[0], np.cumsum(~_IS_BLANK[data])])
    keep = words[ends] > words[starts]
    return data, owner[keep], number[keep], starts[keep], ends[keep]


def _signatures(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 parities of the byte pairs of each line."""
    if len(data) < 2:
        return np.zeros(len(starts), np.uint64)
    pairs = _PAIR_BIT[data[:-1].astype(np.int64) * 256 + data[1:]]
    running = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(pairs)])
    return running[np.maximum(ends - 1, starts)] ^ running[starts]


def _occurrences(docs: DataFrame) -> DataFrame:
    def work(batch):
        for part in slices(batch, "text", 1 << 20):
            data, owner, number, starts, ends = _line_bounds(part.column("text"))
            raw = data.tobytes()
            both = [xxhash.xxh3_128_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(owner)),
                    part.column("version").take(pa.array(owner)),
                    pa.array(number, pa.int32()),
                    pa.array([_signed(x & 0xFFFFFFFFFFFFFFFF) for x in both], pa.int64()),
                    pa.array([_signed(x >> 64) for x in both], pa.int64()),
                ],
                ["doc_id", "version", "line", "h1", "h2"],
            )

    return map_batches(docs, work, "doc_id long, version long, line int, h1 long, h2 long")


def _segment_keys(docs: DataFrame, edits: int, min_bytes: int) -> DataFrame:
    """For each line that is long enough: hash, signature, index keys and probe keys; of equal lines a task gives one row, or one for every ``SEEN`` lines."""
    digest = xxhash.xxh3_64_intdigest

    def run(batches):
        places: dict[int, tuple] = {}
        seen: set[int] = set()
        for part in (part for batch in batches for part in slices(batch, "text", 1 << 20)):
            if len(seen) > SEEN:
                seen.clear()
            data, _, _, starts, ends = _line_bounds(part.column("text"))
            long = ends - starts >= min_bytes
            starts, ends = starts[long], ends[long]
            signs = signed(_signatures(data, starts, ends)).tolist()
            raw = data.tobytes()
            hashes, kept, index, probe = [], [], [], []
            for a, b, sign in zip(starts.tolist(), ends.tolist(), signs):
                line = raw[a:b]
                h = xxhash.xxh3_128_intdigest(line) & 0xFFFFFFFFFFFFFFFF
                if h in seen:
                    continue
                seen.add(h)
                n = b - a
                if n not in places:
                    own = [(n * 64 + i, p, p + size) for i, (p, size) in enumerate(segments(n, edits + 1))]
                    there = [
                        ((n - less) * 64 + i, p, p + size)
                        for less in range(edits + 1) if n - less >= min_bytes
                        for i, lo, hi, size in probe_windows(n, less, edits)
                        for p in range(lo, hi + 1)
                    ]
                    places[n] = own, there
                own, there = places[n]
                hashes.append(_signed(h))
                kept.append(sign)
                index += [digest(line[p:q], s) for s, p, q in own]
                own_n = len(there)
                probe += [digest(line[p:q], s) for s, p, q in there]
                kept[-1] = (sign, own_n)
            m = edits + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes, pa.int64()),
                    pa.array([k[0] for k in kept], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, m * len(hashes) + 1, m), pa.int32()), pa.array(signed(np.array(index, np.uint64)))),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [k[1] for k in kept]), pa.int32()), pa.array(signed(np.array(probe, np.uint64)))),
                ],
                ["h", "sign", "own", "there"],
            )

    return docs.mapInArrow(run, "h long, sign long, own array<long>, there array<long>")


def near_lines(docs: DataFrame, first: DataFrame, edits: int = MAX_EDITS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Pairs ``(a, b)`` of line hashes of different lines within ``edits`` edits.

    ``docs`` is as ``versioned`` gives it; ``first`` holds ``h1`` and the place ``(doc_id, version, line)`` of one occurrence of every line.
    """
    keys = staged(_segment_keys(docs.select("text"), edits, min_bytes), "segments")
    own = keys.select(F.explode("own").alias("key"), F.col("h").alias("a"), F.col("sign").alias("sign_a")).distinct()
    there = keys.select(F.explode("there").alias("key"), F.col("h").alias("b"), F.col("sign").alias("sign_b"))
    close = F.bit_count(F.col("sign_a").bitwiseXOR(F.col("sign_b"))) <= 4 * edits
    met = own.join(there, (own["key"] == there["key"]) & (F.col("a") != F.col("b")) & close)
    pairs = staged(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("h1")).union(pairs.select(F.col("b").alias("h1"))).distinct()
    places = first.join(wanted, "h1").groupBy("doc_id", "version").agg(F.collect_list(F.struct("line", "h1")).alias("want"))

    def texts(batch):
        for part in slices(batch, "text", 1 << 20):
            lines = [(x or "").split("\n") for x in part.column("text").to_pylist()]
            want = part.column("want").to_pylist()
            found = [(w["h1"], own[w["line"]].encode()) for own, ws in zip(lines, want) for w in ws if w["line"] < len(own)]
            found = [(h, x) for h, x in found if _signed(xxhash.xxh3_128_intdigest(x) & 0xFFFFFFFFFFFFFFFF) == h]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], ["h", "line"])

    held = staged(map_batches(docs.join(small_side(places, F.size("want") + 1), ["doc_id", "version"]).select("text", "want"), texts, "h long, line binary").distinct(), "texts")
    left = held.select(F.col("h").alias("a"), F.col("line").alias("x"))
    right = held.select(F.col("h").alias("b"), F.col("line").alias("y"))

    def verify(batch):
        a, b = batch.column("a"), batch.column("b")
        ok = [edit_distance_within(x, y, edits) <= edits for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), verify, "a long, b long").distinct()


def dropped_lines(docs: DataFrame, shared: DataFrame, edits: int = MAX_EDITS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``doc_id`` and ``version``, ``n_lines`` (lines with a word), ``n_near`` (its lines' links to different lines) and the sorted ``dropped`` line numbers.

    Documents are rows with a ``doc_id`` and a ``text`` that has a word; line numbers count every line from 0. Different texts of one of the ``shared`` ids
    are documents of their own, in the order of their versions.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    docs = versioned(rows, shared).select("doc_id", "version", "text")
    lines = staged(_occurrences(docs), "lines")
    first = staged(lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "version", "line")).alias("at")).select("h1", "h2", "at.*"), "first")
    near = staged(near_lines(docs, first, edits, min_bytes), "near")
    place = first.select("h1", F.struct("doc_id", "version", "line").alias("at")).groupBy("h1").agg(F.min("at").alias("at"))
    ends = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = ends.join(place.withColumnRenamed("h1", "a").withColumnRenamed("at", "at_a"), "a").join(place.withColumnRenamed("h1", "b").withColumnRenamed("at", "at_b"), "b")
    late = ends.groupBy(F.col("a").alias("h1")).agg(F.max(F.col("at_b") < F.col("at_a")).alias("late"), F.count(F.lit(1)).alias("links"))
    marked = first.join(late, "h1", "left").select(
        "h1", "h2", F.col("doc_id").alias("first_doc"), F.col("version").alias("first_version"), F.col("line").alias("first_line"),
        F.coalesce("late", F.lit(False)).alias("late"), F.coalesce("links", F.lit(0)).alias("links"),
    )
    copy = (F.col("doc_id") != F.col("first_doc")) | (F.col("version") != F.col("first_version")) | (F.col("line") != F.col("first_line"))
    rows = lines.join(marked, ["h1", "h2"]).select("doc_id", "version", "line", "links", (copy | F.col("late")).alias("drop"))
    rows = rows.groupBy("doc_id", "version", "line").agg(F.max("drop").alias("drop"), F.max("links").alias("links"))
    return rows.groupBy("doc_id", "version").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("links").cast("long").alias("n_near"),
        F.sort_array(F.collect_list(F.when(F.col("drop"), F.col("line")))).alias("dropped"),
    )


def line_report(docs: DataFrame, edits: int = MAX_EDITS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_lines``, ``n_dropped``, ``n_near`` and ``dropped``.

    Null and blank texts have no lines. A row with a null id is not compared and keeps its lines.
    Rows with one id and one text are one document; rows with one id and different texts are different documents, in a fixed order.
    Other columns are left out; empty tables give empty results.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = shared_ids(rows)
    found = dropped_lines(rows, shared, edits, min_bytes).withColumnsRenamed({"doc_id": "f_doc", "version": "f_version"})
    # texts stay behind: a row without one has no version and finds nothing
    named = versioned(rows, shared).select("doc_id", F.when(F.col("text").isNotNull(), F.col("version")).alias("version"))
    zero = F.lit(0).cast("long")
    return named.join(found, (F.col("doc_id") == F.col("f_doc")) & (F.col("version") == F.col("f_version")), "left").select(
        "doc_id", F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce(F.size("dropped").cast("long"), zero).alias("n_dropped"),
        F.coalesce("n_near", zero).alias("n_near"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )


def drop_lines(docs: DataFrame, edits: int = MAX_EDITS, min_bytes: int = MIN_BYTES, emptied: bool = True) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; all columns stay, whatever their names, and a null text stays null.

    All rows stay, but without ``emptied`` those go that had a word and have none left. Ids and texts are told apart as in ``line_report``.
    """
    shared = shared_ids(docs)
    found = dropped_lines(docs, shared, edits, min_bytes).where(F.size("dropped") > 0)
    gone = free_name("dropped", docs)
    joined = with_found(docs, shared, small_side(found, F.size("dropped") + 1), {"dropped": gone})
    lines = F.split("text", "\n")
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n"))
    out = joined.withColumn("text", text)
    if not emptied:
        out = out.where(F.col(gone).isNull() | F.col("text").isNull() | (F.btrim("text", F.lit(BLANKS)) != ""))
    return out.select(*docs.columns)
