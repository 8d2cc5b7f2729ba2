"""Packing documents into sequences of at most ``CAPACITY`` tokens by a grouping genetic algorithm on islands.

1. Texts become token pieces, written once; only the piece lengths go on.
2. Pieces are dealt at random to subsets of about ``SUBSET``; each subset is solved by ``ISLANDS`` islands.
   A genome says which sequence each piece is in. A population starts from best-fit decreasing and best fit in shuffled orders.
3. Crossover injects whole well-filled sequences of one parent into another, takes out the sequences that hold one of
   their pieces again, and best-fits the displaced pieces.
4. Between epochs each island sends its elite to the next island of its subset. The best genome of a subset gives the sequences.

An island stops when it uses as few sequences as the token count allows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.common import map_batches, slices
from tidepanel.llm.tokens import tokenizer_path, word_ids
from tidepanel.session import staged

CAPACITY = 4096
END = 1
SUBSET = 8000
ISLANDS = 2
POPULATION = 5
CROSSINGS = 12
ELITE = 2
EPOCHS = 2


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every row: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and a random ``deal``."""
    path = path or tokenizer_path()
    end = END.to_bytes(4, "little")

    def work(batch):
        encode = word_ids(path).encode
        seed = 0
        for part in slices(batch, "text", 1 << 22):
            rows = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text"))):
                ids += end
                for k in range(0, len(ids), 4 * capacity):
                    cut = ids[k : k + 4 * capacity]
                    rows.append((doc, k // (4 * capacity), k // 4, len(cut) // 4, zlib.crc32(cut)))
            doc, piece, start, length, crc = zip(*rows)
            rng = np.random.default_rng([TaskContext.get().partitionId(), crc[0], seed])
            seed += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(rng.integers(0, 1 << 62, len(rows)))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "deal"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, work, "doc_id long, piece int, start long, length long, ids_crc32 long, deal long")


class Bins:
    """Open sequences by free room; the smallest room that is enough is one bit operation away."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.mask = capacity, {}, 0

    def add(self, number: int, room: int) -> None:
        if room:
            self.rooms.setdefault(room, []).append(number)
            self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        fit = self.mask >> size
        if not fit:
            return None
        room = size + (fit & -fit).bit_length() - 1
        stack = self.rooms[room]
        number = stack.pop()
        if not stack:
            del self.rooms[room]
            self.mask ^= 1 << room
        return number, room


def best_fit(sizes: np.ndarray, order: np.ndarray, genome: np.ndarray, bins: Bins, fresh: int) -> int:
    """Put the pieces of ``order`` where they fit best; new sequences are numbered from ``fresh``. Returns the next number."""
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        got = bins.take(size)
        if got is None:
            got = fresh, bins.capacity
            fresh += 1
        genome[i] = got[0]
        bins.add(got[0], got[1] - size)
    return fresh


def renumbered(genome: np.ndarray) -> np.ndarray:
    return np.unique(genome, return_inverse=True)[1].astype(np.int32)


def fitness(genome: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Fewer sequences first, then uneven fill: the mean square of the fill, below 1, from minus the count."""
    fill = np.bincount(genome, sizes) / capacity
    return float(np.mean(fill * fill)) - len(fill)


def cross(into: np.ndarray, donor: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of ``into`` that holds a random half of the donor's well-filled sequences."""
    fill = np.bincount(donor, sizes)
    good = np.flatnonzero((fill >= np.quantile(fill, 0.25)) & (rng.random(len(fill)) < 0.5))
    moved = np.isin(donor, good)
    hit = np.zeros(into.max() + 1, bool)
    hit[into[moved]] = True
    displaced = np.flatnonzero(hit[into] & ~moved)
    child = into.astype(np.int64)
    base = int(into.max()) + 1
    child[moved] = donor[moved] + base
    fresh = base + int(donor.max()) + 1
    stay = ~hit[into] | moved
    rooms = capacity - np.bincount(child[stay], sizes[stay], fresh).astype(np.int64)
    bins = Bins(capacity)
    for number in np.unique(child[stay]).tolist():
        bins.add(number, int(rooms[number]))
    best_fit(sizes, displaced[np.argsort(-sizes[displaced], kind="stable")], child, bins, fresh)
    return renumbered(child)


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, rng: np.random.Generator, crossings: int = CROSSINGS) -> list[np.ndarray]:
    """The population after some crossings, best first."""
    least = -(-int(sizes.sum()) // capacity)
    scored = sorted(((fitness(g, sizes, capacity), i, g) for i, g in enumerate(population)), key=lambda x: (-x[0], x[1]))
    for k in range(crossings):
        if len(scored) < 2 or scored[0][2].max() + 1 <= least:
            break
        a, b = sorted(rng.choice(len(scored), 2, replace=False))
        child = cross(scored[a][2], scored[b][2], sizes, capacity, rng)
        scored = sorted([*scored, (fitness(child, sizes, capacity), len(population) + k, child)], key=lambda x: (-x[0], x[1]))[: len(population)]
    return [g for _, _, g in scored]


def founders(sizes: np.ndarray, capacity: int, rng: np.random.Generator, count: int = POPULATION) -> list[np.ndarray]:
    """Best-fit decreasing, then best fit in orders that are decreasing up to noise."""
    out = []
    least = -(-int(sizes.sum()) // capacity)
    for k in range(count):
        noise = 1 + 0.4 * k / max(1, count - 1) * (rng.random(len(sizes)) - 0.5) if k else 1
        genome = np.zeros(len(sizes), np.int64)
        best_fit(sizes, np.argsort(-sizes * noise, kind="stable"), genome, Bins(capacity), 0)
        out.append(renumbered(genome))
        if out[-1].max() + 1 <= least:
            break
    return out


_STATE = "subset long, island int, lengths binary, genomes binary, ranks array<double>"


def _state(subset: int, island: int, sizes: np.ndarray, genomes: list[np.ndarray], capacity: int) -> pd.DataFrame:
    genomes = genomes[:ELITE + 1]
    return pd.DataFrame(
        {"subset": [subset], "island": [island], "lengths": [sizes.astype(np.int32).tobytes()], "genomes": [b"".join(g.tobytes() for g in genomes)], "ranks": [[fitness(g, sizes, capacity) for g in genomes]]}
    )


def _ordered(group: pd.DataFrame) -> pd.DataFrame:
    return group.sort_values(["length", "deal", "no_id", "doc_id", "piece"], ascending=[False, True, True, True, True], kind="stable")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, subset: int = SUBSET, epochs: int = EPOCHS) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``.

    A document is its ids and then id 1, so a null or empty text has one token. A longer one than ``capacity`` is cut there.
    Every row is packed, so repeated rows are packed as often as they come; ids may be null and are kept to the last bit. An empty table gives an empty result.
    """
    # pandas would turn ids beside a null into doubles, so a null travels as 0 and a flag
    plain = {"doc_id": F.coalesce("doc_id", F.lit(0).cast("long")), "no_id": F.col("doc_id").isNull()}
    held = staged(pieces(docs, path, capacity).withColumns(plain), "pieces")
    subsets = max(1, -(-held.count() // subset))
    dealt = held.withColumn("subset", F.pmod("deal", F.lit(subsets)).cast("long"))

    def found(key, group):
        sizes = _ordered(group)["length"].to_numpy()
        rng = np.random.default_rng([int(key[0]), int(key[1]), 0])
        return _state(key[0], key[1], sizes, evolve(sizes, founders(sizes, capacity, rng), capacity, rng), capacity)

    def settle(epoch):
        def run(key, group):
            sizes = np.frombuffer(group["lengths"].iloc[0], np.int32).astype(np.int64)
            genomes = [g for own, raw in zip(group["island"] == key[1], group["genomes"]) for g in np.frombuffer(raw, np.int32).reshape(-1, len(sizes))]
            rng = np.random.default_rng([int(key[0]), int(key[1]), epoch])
            return _state(key[0], key[1], sizes, evolve(sizes, genomes, capacity, rng), capacity)

        return run

    islands = dealt.select("subset", "doc_id", "no_id", "piece", "length", "deal").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    state = islands.groupBy("subset", "island").applyInPandas(found, _STATE)
    for epoch in range(1, epochs):
        state = staged(state, "islands")
        guests = state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int"))
        state = state.union(guests).groupBy("subset", "island").applyInPandas(settle(epoch), _STATE)
    best = state.groupBy("subset").agg(F.max_by(F.struct("lengths", "genomes"), F.struct(F.element_at("ranks", 1), -F.col("island"))).alias("best")).select("subset", "best.*")
    best = staged(best, "best")

    def place(items, genome):
        if not len(items):
            return pd.DataFrame(columns=["doc_id", "no_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
        items = _ordered(items)
        bins = np.frombuffer(genome["genomes"].iloc[0], np.int32, len(items)).astype(np.int64)
        order = np.argsort(bins, kind="stable")
        items, bins = items.iloc[order], bins[order]
        total = np.cumsum(items["length"].to_numpy()) - items["length"].to_numpy()
        first = np.searchsorted(bins, bins, "left")
        return items[["doc_id", "no_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=bins + (int(genome["subset"].iloc[0]) << 24), offset=total - total[first])

    schema = "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    placed = dealt.groupBy("subset").cogroup(best.groupBy("subset")).applyInPandas(place, schema)
    return placed.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
