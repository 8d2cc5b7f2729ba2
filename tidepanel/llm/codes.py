"""Vectors as four bytes: one codebook per quarter, refined in rounds with norm-of-sum bounds.

A vector's components become integers and are cut into ``PARTS`` equal parts; a part's code is the index of its nearest codebook entry. Each round
assigns all parts and moves every entry to the mean of its parts. Most parts keep their entry, and bounds tell which:

1. The entries of a part position form ``GROUPS`` groups. A part keeps, for each group, a lower bound of its distance to the group's entries (its own
   entry left out) and the round in which that bound was exact, its stamp.
2. All codebooks of earlier rounds are retained. In round r, a bound of round t is lowered by the largest net displacement of the group, that is the
   norm of the sum of its moves, ``|entry(r) - entry(t)|``. That is never more than the sum of the norms of the moves, which an accumulated drift would take.
3. Only groups whose lowered bound does not exceed the exact distance to the own entry are scanned again, exactly, and get a bound of this round.

Distances are exact integers; bounds are rounded outwards, so codes are those of a full scan, ties to the lower index included.
The state of a vector is one row, rewritten each round without a shuffle. Sums travel combined by entry; the driver holds codebooks only,
whose size is set by ``ENTRIES``, the dimension and the rounds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.common import small_side
from tidepanel.session import staged

PARTS = 4
ENTRIES = 256
GROUPS = 8
ROUNDS = 4
SCALE = 1024
#: Components (as integers) beyond this size could overflow a 64-bit sum of squares.
LARGEST = 1 << 28
BATCH = 4096
SALTS = 16


class Book:
    """The codebooks of all rounds so far: arrays of (part, entry, position)."""

    def __init__(self, history: list[np.ndarray], exact_floats: bool):
        self.history = history
        self.kind = np.float64 if exact_floats else np.int64
        now = history[-1].astype(self.kind)
        self.now, self.squares = now, (now * now).sum(axis=2)
        n = now.shape[1]
        self.groups = [np.arange(g * n // GROUPS, (g + 1) * n // GROUPS) for g in range(GROUPS)]
        self.groups = [g for g in self.groups if len(g)]
        self.group_of = np.concatenate([np.full(len(g), i) for i, g in enumerate(self.groups)])
        # net displacement since each round, the largest and the second largest of each group and which entry has the largest
        self.moved = []
        for old in history:
            gap = (history[-1] - old).astype(np.float64)
            self.moved.append(_up(np.sqrt((gap * gap).sum(axis=2))))

    def squared(self, part: int, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Exact squared distances of the rows of ``x`` to some entries."""
        near = self.now[part, entries]
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ near.T) + self.squares[part, entries]

    def own(self, part: int, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        gap = x - self.now[part, codes]
        return (gap * gap).sum(axis=1)


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + 1e-9) + 1e-9


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(x * (1 - 1e-9) - 1e-9, 0.0)


def assign(book: Book, part: int, x: np.ndarray, codes: np.ndarray | None, bounds: np.ndarray, stamps: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entries of the rows of ``x`` and their squared distances; ``bounds`` and ``stamps`` (row, group) are brought up to date in place.

    Without ``codes`` every group is scanned. Also returns how many distances the scans took.
    """
    n, now = len(x), len(book.history) - 1
    x = x.astype(book.kind)
    fresh = codes is None
    codes = np.zeros(n, np.int64) if fresh else codes.astype(np.int64)
    own = book.own(part, x, codes)
    here = _up(np.sqrt(own.astype(np.float64)))
    best, least = codes.copy(), own.copy()
    before_group = book.group_of[codes]
    scanned = np.zeros((n, len(book.groups)), bool)
    second = np.full((n, len(book.groups)), np.inf)
    first = np.full((n, len(book.groups)), np.inf)
    work = 0
    for g, entries in enumerate(book.groups):
        if fresh:
            rows = np.arange(n)
        else:
            shift = np.array([m[part, entries].max() for m in book.moved])
            rows = np.flatnonzero(bounds[:, g] - shift[stamps[:, g]] <= here)
        if not len(rows):
            continue
        d = book.squared(part, x[rows], entries)
        work += d.size
        scanned[rows, g] = True
        place = d.argmin(axis=1)  # the lowest index of equal ones
        nearest = d[np.arange(len(rows)), place]
        first[rows, g] = nearest
        if len(entries) > 1:
            rest = d.copy()
            rest[np.arange(len(rows)), place] = np.iinfo(np.int64).max if book.kind is np.int64 else np.inf
            second[rows, g] = rest.min(axis=1)
        index = entries[place]
        better = (nearest < least[rows]) | ((nearest == least[rows]) & (index < best[rows]))
        best[rows[better]], least[rows[better]] = index[better], nearest[better]
    after_group = book.group_of[best]
    at = np.arange(n)
    # an exact bound leaves out the own entry, which is the nearest of its group
    exact = first.copy()
    exact[at, after_group] = np.where(scanned[at, after_group], second[at, after_group], exact[at, after_group])
    bounds[scanned] = _down(np.sqrt(exact[scanned]))
    stamps[scanned] = now
    # an entry that was left counts again in its group's bound, should that group not have been scanned
    left = np.flatnonzero((best != codes) & ~scanned[at, before_group])
    if len(left):
        g = before_group[left]
        shift = np.stack([[m[part, e].max() for e in book.groups] for m in book.moved])
        lowered = np.maximum(bounds[left, g] - shift[stamps[left, g], g], 0.0)
        bounds[left, g] = np.minimum(lowered, _down(np.sqrt(own[left].astype(np.float64))))
        stamps[left, g] = now
    return best, least, work


_STATE = "ints binary, codes binary, bounds binary, stamps binary, error long, part int, entry int, n long, sums array<long>"


def _kept(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    x = F.col(vector).cast("array<double>")
    good = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("ints")).where(good)


def _first_book(rows: DataFrame, width: int) -> np.ndarray:
    """Parts of the vectors of the smallest ids; of rows with one id the least vector, a null id last."""
    first = rows.groupBy("key").agg(F.min("ints").alias("ints")).orderBy(F.col("key").asc_nulls_last()).limit(ENTRIES).collect()
    out = np.zeros((len(first), width * PARTS), np.int64)
    for row, r in zip(out, first):
        row[: len(r["ints"])] = r["ints"]
    return out.reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()


def _pass(df: DataFrame, book: Book, width: int, head: str, last: bool) -> DataFrame:
    """One round over all rows: rows with a new state and, unless it is the last, a row per part and used entry with the sums of a task."""
    schema = f"{head}, {_STATE}"
    n_entries, n_groups = book.history[0].shape[1], len(book.groups)

    def run(batches):
        sums = np.zeros((PARTS, n_entries, width), np.int64)
        counts = np.zeros((PARTS, n_entries), np.int64)
        kinds = None
        for whole in batches:
            kinds = whole.schema
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                n = batch.num_rows
                old = batch.column("codes").null_count < n
                x = _matrix(batch.column("ints"), width)
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, PARTS) if old else None
                if old:
                    bounds = np.frombuffer(b"".join(batch.column("bounds").to_pylist()), np.float64).reshape(n, PARTS, n_groups).copy()
                    stamps = np.frombuffer(b"".join(batch.column("stamps").to_pylist()), np.uint8).reshape(n, PARTS, n_groups).astype(np.int64)
                else:
                    bounds, stamps = np.zeros((n, PARTS, n_groups)), np.zeros((n, PARTS, n_groups), np.int64)
                new, error = np.empty((n, PARTS), np.int64), np.zeros(n, np.int64)
                for p in range(PARTS):
                    b, s = bounds[:, p].copy(), stamps[:, p].copy()
                    new[:, p], d, _ = assign(book, p, x[:, p], codes[:, p] if old else None, b, s)
                    bounds[:, p], stamps[:, p] = b, s
                    error += d.astype(np.int64)
                    if not last:
                        counts[p] += np.bincount(new[:, p], minlength=n_entries)
                        np.add.at(sums[p], new[:, p], x[:, p])
                nothing = [pa.nulls(n, kind) for kind in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
                state = [
                    pa.array([r.tobytes() for r in x.astype(np.int32).reshape(n, -1)], pa.binary()) if not last else pa.nulls(n, pa.binary()),
                    pa.array([r.tobytes() for r in new.astype(np.uint8)], pa.binary()),
                    pa.array([r.tobytes() for r in bounds.reshape(n, -1)], pa.binary()) if not last else pa.nulls(n, pa.binary()),
                    pa.array([r.tobytes() for r in stamps.astype(np.uint8).reshape(n, -1)], pa.binary()) if not last else pa.nulls(n, pa.binary()),
                    pa.array(error),
                ]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), *state, *nothing], names)
        part, entry = np.nonzero(counts)
        if len(part) and not last:
            m = len(part)
            ends = pa.array(np.arange(0, m * width + 1, width), pa.int32())
            blank = [pa.nulls(m, kinds.field(c).type) for c in ("key", "label")] + [pa.nulls(m, pa.binary())] * 4 + [pa.nulls(m, pa.int64())]
            total = pa.ListArray.from_arrays(ends, pa.array(sums[part, entry].ravel()))
            yield pa.RecordBatch.from_arrays([*blank, pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), total], names)

    names = ["key", "label", "ints", "codes", "bounds", "stamps", "error", "part", "entry", "n", "sums"]
    return df.mapInArrow(run, schema)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """(row, part, position) integers of lists (shorter ones end in zeros) or of their bytes."""
    n = len(column)
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(n, PARTS, width).astype(np.int64)
    out = np.zeros((n, PARTS * width), np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(n), lengths), at] = flat
    return out.reshape(n, PARTS, width)


def vector_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``key``, ``label``, ``code`` (bytes, one per part) and ``error`` of every row that is kept, and the last codebooks.

    Rows whose vector is null or holds a null or non-finite component are dropped. Components become ``floor(SCALE * x)``. Vectors of other lengths
    than the longest end in zeros, and so does the longest if four does not divide its length. The first entries are the vectors of the smallest ids: of rows of one id
    the least vector, a null id last; so there can be fewer than ``ENTRIES``. Repeated rows are coded one by one, keys and labels may be null. Without
    rows the result is empty. Integers of ``LARGEST`` or more stop it with an error.
    """
    spark = df.sparkSession
    rows = staged(_kept(df, key, vector, label), "ints")
    sizes = rows.agg(F.max(F.size("ints")).alias("length"), F.max(F.array_max(F.transform("ints", F.abs))).alias("largest")).first()
    names = {"key": key, "label": label}
    if sizes["length"] is None:
        empty = rows.select("key", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")).where(F.lit(False))
        return empty.withColumnsRenamed(names), np.zeros((PARTS, 0, 0), np.int64)
    width, largest = max(1, -(-sizes["length"] // PARTS)), sizes["largest"] or 0
    if largest >= LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} cannot be coded exactly")
    exact_floats = 4 * width * (largest + 1) ** 2 < 1 << 53
    head = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("key", "label"))
    history = [_first_book(rows, width)]
    state = rows.select("key", "label", "ints", *(F.lit(None).cast("binary").alias(c) for c in ("codes", "bounds", "stamps")))
    for _ in range(rounds):
        both = staged(_pass(state, Book(history, exact_floats), width, head, False), "round")
        moved = both.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums"))
        book = history[-1].copy()
        for r in moved.collect():  # one row per entry
            book[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
        history.append(book)
        state = both.where("part is null").select("key", "label", "ints", "codes", "bounds", "stamps")
    done = _pass(state, Book(history, exact_floats), width, head, True)
    return done.select("key", "label", F.col("codes").alias("code"), "error").withColumnsRenamed(names), history[-1]


def code_report(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vector_codes`` in digest columns, the errors summed by label besides."""
    coded, book = vector_codes(df, key, vector, label)
    coded = staged(coded.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.lower(F.hex("code")).alias("code"), "error"), "codes")
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    per = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS))
    # a label may stand on a third of all rows: it is dealt over parts should the labels be too many to broadcast
    per = small_side(per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))))
    out = coded.withColumn("s", salt).join(per, F.col("label").eqNullSafe(F.col("l")) & (F.col("s") == F.col("salt")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
