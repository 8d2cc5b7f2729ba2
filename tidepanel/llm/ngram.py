"""Exact Jaccard join of documents on word n-grams, by vertical partitioning.

The n-grams have one global order: those with an even hash first, by the number of distinct sets that hold them, then the rest; equal ones by hash.
1. Documents with equal sets are one, by two sums of hashes.
2. The even n-grams of each set, a first fragment of the order, are counted across sets. A set can differ from a similar one in so many members
   (``allowed``). One with more members that no other set holds has no partner and goes. Frequent n-grams are counted by chunks of texts.
3. Two similar sets share one of their first ``allowed + 1`` members in the order. The sets with a member among those in common form a
   star around the smallest id. No pairs are made.
4. The components of the stars are families: no similar pair lies across two families. A family of more sets than a block is taken apart: on the first fragment of the
   order the partial overlaps of its sets are counted by n-gram and summed per pair, and only pairs whose sum lets them be similar stay together. An n-gram of more
   than ``few`` of its sets makes a star instead of pairs.
5. A family's sets are dealt into blocks, and every two blocks meet in one task. There overlaps are counted on one fragment of the order after another,
   rare n-grams by the pairs of sets that hold them, frequent ones by a matrix product, and summed per pair. The task emits links, not pairs: a spanning
   forest of its similar pairs and the number of links of each document. Two blocks with more than ``GRAMS`` members meet in several tasks, each with
   the n-grams of one range of hashes; these emit a row of partial overlaps for each set, and the rows of a set are summed before links are found.
6. The components of the links are the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.llm.common import components, map_batches, mix64, powers, signed, slices, small_side, word_hashes
from tidepanel.session import staged

BLOCK = 1024
GRAMS = 1 << 21
COLUMNS = 2048
FEW = 8
#: Sets up to which a key of a large family is counted pair by pair.
RARE = 32
#: Frequent n-grams are told by the top bits of their hashes: a bucket of so many times the average, and of so many rows at least.
HOT = 8
HOT_ROWS = 1000
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS

_U = np.uint64
_C = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def ngram_sets(texts: pa.Array, n: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words is one n-gram, one without words has none."""
    hashes, _, _, first = word_hashes(texts, lower)
    grams = np.zeros(max(0, len(hashes) - n + 1), _U)
    for i in range(n):
        grams += hashes[i : i + len(grams)] * powers(n)[i]
    grams = mix64(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            short = np.append(hashes[a:b], _U(b - a)) * np.arange(3, 2 * (b - a) + 4, 2, dtype=_U)
            out.append(mix64(mix64(short).cumsum()[-1:]))
        else:
            out.append(np.zeros(0, _U))
    return out


def _signatures(docs: DataFrame, n: int) -> DataFrame:
    """Size, number of even hashes and two sums of every document's set; equal sets have equal ones."""
    def work(batch):
        for part in slices(batch, "text", 1 << 20):
            sets = ngram_sets(part.column("text"), n)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int((s & _U(1) == 0).sum()) for s in sets], pa.int64()),
                    pa.array(signed(np.array([s.sum(dtype=_U) for s in sets], _U))),
                    pa.array(signed(np.array([mix64(s ^ _C[0]).sum(dtype=_U) for s in sets], _U))),
                ],
                ["doc_id", "n", "even", "sig1", "sig2"],
            )

    return map_batches(docs, work, "doc_id long, n long, even long, sig1 long, sig2 long")


def _hot_buckets(docs: DataFrame, n: int, rows: int) -> list[int]:
    """Buckets of even n-grams (their top bits) with more than ``rows`` places and ``HOT`` times the average; at most one bucket in ``HOT``.

    Only the way in which n-grams are counted depends on it, not the counts. A task leaves out the buckets below half of that.
    """
    def run(batches):
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                grams = np.concatenate([np.zeros(0, _U), *ngram_sets(part.column("text"), n)])
                held += np.bincount((grams[grams & _U(1) == 0] >> _U(64 - BUCKET_BITS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(held * BUCKETS * 2 > HOT * held.sum())
        total = pa.array([-1, *at], pa.int32()), pa.array([held.sum(), *held[at]], pa.int64())
        yield pa.RecordBatch.from_arrays(list(total), ["bucket", "held"])

    counts = staged(docs.select("text").mapInArrow(run, "bucket int, held long").groupBy("bucket").agg(F.sum("held").alias("held")), "buckets")
    total = counts.where("bucket < 0").agg(F.sum("held")).first()[0] or 0
    bound = max(rows, HOT * total / BUCKETS)
    return [r["bucket"] for r in counts.where((F.col("bucket") >= 0) & (F.col("held") > bound)).select("bucket").collect()]


def _members(part: pa.RecordBatch, n: int, parity: int, marked: np.ndarray | None = None, inside: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """N-grams whose hash has that last bit and the ids of their sets; of those in the ``marked`` buckets or outside them, where given."""
    sets = [s[s & _U(1) == _U(parity)] for s in ngram_sets(part.column("text"), n)]
    if marked is not None:
        sets = [s[marked[(s >> _U(64 - BUCKET_BITS)).astype(np.int64)] == inside] for s in sets]
    ids = np.repeat(part.column("doc_id").to_numpy(zero_copy_only=False), [len(s) for s in sets])
    return signed(np.concatenate(sets)), ids.astype(np.int64)


def _marked(buckets: list[int]) -> np.ndarray:
    marked = np.zeros(BUCKETS, bool)
    marked[buckets] = True
    return marked


def _grams(docs: DataFrame, n: int, parity: int, buckets: list[int] | None = None) -> DataFrame:
    """``(gram, id)`` of the n-grams whose hash has that last bit; only those outside the hot ``buckets``, where given."""
    marked = None if buckets is None else _marked(buckets)

    def work(batch):
        for part in slices(batch, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _members(part, n, parity, marked)], ["gram", "id"])

    return map_batches(docs, work, "gram long, id long")


#: Members of a set that others hold too, with the number of sets.
_SHARED = "array<struct<held:int,gram:bigint>>"


def _chunks(docs: DataFrame, n: int, buckets: list[int]) -> DataFrame:
    """The even n-grams in ``buckets``, one row for a few megabytes of text: ``own`` n-grams and their ``counts``, ``ids`` of the sets, their ``sizes``, and ``members`` as places in ``own``."""
    marked = _marked(buckets)

    def work(batch):
        for part in slices(batch, "text", 1 << 22):
            gram, ids = _members(part, n, 0, marked, True)
            if len(gram):
                own, members, counts = np.unique(gram, return_inverse=True, return_counts=True)
                heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                sizes = np.diff(np.append(heads, len(ids)))
                columns = [(own, pa.int64()), (counts, pa.int32()), (ids[heads], pa.int64()), (sizes, pa.int32()), (members, pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(kind)) for x, kind in columns], ["own", "counts", "ids", "sizes", "members"])

    return map_batches(docs, work, "own array<long>, counts array<int>, ids array<long>, sizes array<int>, members array<int>")


def _hot(docs: DataFrame, n: int, buckets: list[int]) -> DataFrame:
    """``(id, many)``: of each set the n-grams in ``buckets`` that two sets or more hold.

    The counts of a chunk's n-grams are added up over the chunks and come back to the chunk, whose sets then look them up. No join has a row per n-gram and set.
    """
    def work(batch):
        for row in range(batch.num_rows):
            own, ids, sizes, members = (batch.column(c)[row].values.to_numpy() for c in ("own", "ids", "sizes", "members"))
            known = batch.column("known")[row].values
            held = np.zeros(len(own), np.int32)
            held[known.field("place").to_numpy()] = known.field("held").to_numpy()
            keep = held[members] > 1
            first = np.append(0, keep.cumsum())[np.append(0, sizes.cumsum())]
            shared = pa.StructArray.from_arrays([pa.array(held[members][keep]), pa.array(own[members][keep])], ["held", "gram"])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(first, pa.int32()), shared)], ["id", "many"])

    chunks = staged(_chunks(docs, n, buckets).withColumn("chunk", F.monotonically_increasing_id()), "hot")
    own = chunks.select("chunk", F.posexplode(F.arrays_zip("own", "counts")).alias("place", "one")).select("chunk", "place", F.col("one.own").alias("gram"), "one.counts")
    held = small_side(own.groupBy("gram").agg(F.sum("counts").alias("held")).where("held > 1"))
    known = own.join(held, "gram").groupBy("chunk").agg(F.collect_list(F.struct("place", "held")).alias("known"))
    return map_batches(chunks.join(known, "chunk").select("own", "ids", "sizes", "members", "known"), work, f"id long, many {_SHARED}")


def _counted(docs: DataFrame, n: int, rows: int) -> DataFrame:
    """``(id, shared)``: of each set the even n-grams that two sets or more hold, with the number of sets.

    A window counts most of them, in one exchange. The n-grams of a hot bucket are counted by chunks of texts, so no task reads all rows of a frequent n-gram.
    """
    buckets = _hot_buckets(docs, n, rows)
    counted = _grams(docs, n, 0, buckets).withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("gram"))).where("held > 1")
    counted = counted.select("id", F.struct(F.col("held").cast("int").alias("held"), "gram").alias("one"))
    if not buckets:
        return counted.groupBy("id").agg(F.collect_list("one").alias("shared"))
    both = counted.withColumn("many", F.lit(None).cast(_SHARED)).unionByName(_hot(docs, n, buckets), allowMissingColumns=True)
    return both.groupBy("id").agg(F.concat(F.collect_list("one"), F.flatten(F.collect_list("many"))).alias("shared"))


def _prefixes(docs: DataFrame, reps: DataFrame, several: DataFrame, n: int, percent: int, few: int, hot: int) -> DataFrame:
    """``(gram, held, id, n, wide, near)``: the shared ones among the first members of each set; ``reps`` has one ``(rep, n, even)`` per distinct set.

    Similar sets share one of their first ``allowed + 1`` members, which are ``near``. The keys go on for half as many again, for the sums of partial
    overlaps; the first ``wide`` members are those of them that at most ``few`` sets hold. A set with too few even members takes all of them and
    the odd ones, with ``wide`` 0, which lets all pairs pass. So do ids of ``several`` rows, whose members are counted together.
    """
    per = _counted(docs, n, hot)
    first = reps.withColumn("allowed", F.floor(F.col("n") * (100 - percent) / 100)).join(per, reps["rep"] == per["id"], "left")
    first = first.join(several, reps["rep"] == several["mixed"], "left").withColumn("shared", F.sort_array(F.coalesce("shared", F.array()))).withColumns(
        {"alone": F.col("even") - F.size("shared"), "short": F.col("even") <= F.col("allowed")}
    ).where("short or alone <= allowed")
    reach = F.when(F.col("short"), F.col("even")).otherwise(F.least(F.col("even"), F.col("allowed") + 1 + F.floor(F.col("allowed") / 2)))
    first = first.withColumn("shared", F.slice("shared", F.lit(1), F.greatest(reach - F.col("alone"), F.lit(0)).cast("int")))
    rare = F.size(F.filter("shared", lambda x: x["held"] <= few))
    first = staged(
        first.select(
            "rep", "n", "short", (F.col("allowed") + 1 - F.col("alone")).alias("most"), "shared",
            F.when(F.col("short") | F.col("mixed").isNotNull(), F.lit(0)).otherwise(F.col("alone") + rare).cast("long").alias("wide"),
        ), "first",
    )
    even = first.select("rep", "n", "wide", "short", "most", F.posexplode("shared").alias("place", "one")).select(
        "one.gram", F.col("one.held").cast("long").alias("held"), F.col("rep").alias("id"), "n", "wide", (F.col("short") | (F.col("place") < F.col("most"))).alias("near")
    )
    # a set with too few even members has odd ones among its first; all of them will do
    short = small_side(first.where("short").select("rep", F.col("n").alias("size")))
    odd = staged(_grams(docs.join(short, docs["doc_id"] == short["rep"], "left_semi"), n, 1), "odd")
    held = odd.groupBy("gram").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    odd = odd.join(held, "gram").join(short, F.col("id") == F.col("rep"))
    return even.union(odd.select("gram", "held", "id", F.col("size").alias("n"), F.lit(0).cast("long").alias("wide"), F.lit(True).alias("near")))


def _stars(keys: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` from each set to the smallest id that shares a key; counted before the exchange, so a key of very many sets has no task of its own."""
    least = keys.groupBy("gram").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("held")).where("held > 1").select("gram", "a")
    return keys.join(least, "gram").where("a <> id").select("a", F.col("id").alias("b")).distinct()


def _pairs(keys: DataFrame, percent: int, few: int) -> DataFrame:
    """Edges between sets whose partial overlap on the first fragment of the order, the n-grams of at most ``few`` sets, lets them be similar.

    What two sets share and is not counted lies behind the wide members of one of them, so a pair whose sum and the longer rest fall short of the overlap
    it needs is not similar. A near key of more sets makes a star, whatever the sums.
    """
    sets = keys.where(F.col("held") <= few).groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("id", "n", "wide"))).alias("sets"))
    met = sets.select("sets", F.posexplode("sets").alias("place", "x"))
    met = met.select("x", F.explode(F.slice("sets", F.col("place") + 2, F.size("sets"))).alias("y"))
    met = met.where(100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
    summed = met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("part"))
    rest = F.greatest(F.col("x.n") - F.col("x.wide"), F.col("y.n") - F.col("y.wide"))
    enough = (100 + percent) * (F.col("part") + rest) >= percent * (F.col("x.n") + F.col("y.n"))
    strong = summed.where(enough).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return strong.union(_stars(keys.where((F.col("held") > few) & F.col("near"))))


def _families(keys: DataFrame, percent: int, block: int, few: int) -> DataFrame:
    """``(rep, family)``: no similar pair lies across two families.

    First sets that share a near key are one family. On unrelated texts of few words such families grow together; one of more than ``block`` sets is
    taken apart by the sums of partial overlaps.
    """
    family = components(_stars(keys.where("near").select("gram", "id"))).withColumnsRenamed({"id": "rep", "component": "family"})
    family = staged(family, "families")
    large = family.groupBy("family").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block).select("family")
    large = small_side(large)
    if not large.limit(1).count():
        return family
    inside = staged(family.join(large, "family", "left_semi").select("rep"), "inside")
    own = staged(keys.join(inside, keys["id"] == inside["rep"], "left_semi"), "keys")
    apart = components(_pairs(own, percent, few)).withColumnsRenamed({"id": "rep", "component": "family"})
    return family.join(large, "family", "left_anti").select("rep", "family").union(apart.select("rep", "family"))


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix."""
    n, seen, out = len(links), np.zeros(len(links), bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        todo = [root]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(links[at] & ~seen)
            seen[new] = True
            out += [(at, int(x)) for x in new]
            todo += new.tolist()
    return out


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Overlap of every two sets: counted on one fragment of the order after another, then summed."""
    size = len(sets)
    total = np.zeros(size * size, np.float32)
    member = np.repeat(np.arange(size), [len(s) for s in sets])
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((member, place, counts[place]))  # by the number of sets that hold it
    member, held, place = member[order], counts[place][order], place[order]
    for k in range(2, FEW + 1):
        a, b = np.searchsorted(held, [k, k + 1])
        rows = member[a:b].reshape(-1, k)
        for i in range(k):
            for j in range(i):
                total += np.bincount(rows[:, i] * size + rows[:, j], minlength=size * size).astype(np.float32) if len(rows) else 0
    total = total.reshape(size, size)
    total += total.T
    a = np.searchsorted(held, FEW + 1)
    member, place = member[a:], np.cumsum(np.append(False, place[a + 1 :] != place[a:-1])) if a < len(place) else place[a:]
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(place, [lo, lo + COLUMNS])
        rows, at = np.unique(member[a:b], return_inverse=True)
        fragment = np.zeros((len(rows), COLUMNS), np.float32)
        fragment[at, place[a:b] - lo] = 1
        total[np.ix_(rows, rows)] += fragment @ fragment.T
    return total


def _found(group: pd.DataFrame, overlap: np.ndarray, percent: int) -> pd.DataFrame:
    """A forest of the links of two blocks, and each document's number of links."""
    ids, copies, block, sizes = (group[c].to_numpy() for c in ("doc_id", "copies", "block", "n"))
    sizes = sizes.astype(np.float64)
    links = 100 * overlap >= percent * (sizes[:, None] + sizes[None, :] - overlap)
    np.fill_diagonal(links, False)
    if group["low"].iloc[0] != group["high"].iloc[0]:
        links &= block[:, None] != block[None, :]
    degree = links @ copies
    edges = _forest(links)
    return pd.DataFrame(
        {
            "a": np.concatenate([ids[[e[0] for e in edges]] if edges else ids[:0], ids]),
            "b": np.concatenate([ids[[e[1] for e in edges]] if edges else ids[:0], ids]),
            "links": np.concatenate([np.zeros(len(edges), np.int64), degree.astype(np.int64)]),
        }
    )


def _verify(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("doc_id").sort_values("doc_id")
        return _found(group, _overlaps([np.frombuffer(x, _U) for x in group["grams"]]).astype(np.float64), percent)

    return run


_ROW = ["family", "low", "high", "doc_id", "n", "copies", "block"]


def _partial(group: pd.DataFrame) -> pd.DataFrame:
    """A row of overlaps of each set on one fragment, in the order of the ids."""
    group = group.drop_duplicates("doc_id").sort_values("doc_id")
    overlap = _overlaps([np.frombuffer(x, _U) for x in group["grams"]]).astype(np.int32)
    return group[_ROW].assign(overlap=[x.tobytes() for x in overlap])


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    """The sum of a set's rows."""
    total = np.zeros(len(group["overlap"].iloc[0]) // 4, np.int64)
    for x in group["overlap"]:
        total += np.frombuffer(x, np.int32)
    return group[_ROW].head(1).assign(overlap=[total.tobytes()])


def _verify_summed(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        return _found(group, np.stack([np.frombuffer(x, np.int64) for x in group["overlap"]]).astype(np.float64), percent)

    return run


def _dealt(sets: DataFrame, block: int, grams: int) -> DataFrame:
    """``sets`` of families with their block, the number of blocks, and of the fragments that keep what two blocks hold of one at about ``grams`` members.

    Only families of more than one block or fragment are looked up, so that no exchange brings a family together.
    """
    sizes = sets.groupBy("family").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block)
    sizes = small_side(sizes.select("family", F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    todo = sets.join(sizes, "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    todo = todo.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    held = todo.groupBy("family", "blocks", "block").agg(F.sum("n").alias("held")).groupBy("family", "blocks").agg(F.max("held").alias("most"))
    held = held.select("family", F.ceil(F.least(F.lit(2), "blocks") * F.col("most") / grams).cast("int").alias("fragments")).where("fragments > 1")
    todo = todo.join(small_side(held), "family", "left").withColumn("fragments", F.coalesce("fragments", F.lit(1)))
    return todo.select("family", "n", "sig1", F.col("rep").alias("doc_id"), "copies", "blocks", "block", "fragments")


def ngram_join(
    docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id",
    block: int = BLOCK, grams: int = GRAMS, few: int = RARE, hot: int = HOT_ROWS,
) -> DataFrame:
    """Documents with ``n_shingles``, ``component_id`` and ``n_links``; one row per row.

    Two documents link when the n-gram sets' Jaccard similarity is ``percent`` / 100 or more; ``component_id``
    is the smallest id reachable by links, ``n_links`` the number of documents that the document links with, its copies among them.
    Words are lower-cased in A-Z. A null or blank text has no n-grams and links with nothing. Rows with one id and one
    text are one document and give the same row each; a row with a null id links with nothing and gets a null component. Empty tables give empty results;
    other columns are left out.

    Nothing is left out by size: n-grams are compared by 64-bit hashes of three or more words, whose chance of a wrong match
    within a pair is below 1e-12.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    small = staged(_signatures(rows, n), "signatures")
    named = small.where("doc_id is not null and n > 0").distinct()
    reps = staged(named.groupBy("n", "even", "sig1", "sig2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "sets")
    copies = small_side(named.join(reps.select("n", "sig1", "sig2", "rep"), ["n", "sig1", "sig2"]).where("doc_id <> rep").select(F.col("doc_id").alias("copy")))
    alone = rows.where("doc_id is not null").join(copies, F.col("doc_id") == F.col("copy"), "left_anti")
    several = small_side(small.where("doc_id is not null").groupBy(F.col("doc_id").alias("mixed")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("mixed"))
    family = _families(_prefixes(alone, reps.select("rep", "n", "even"), several, n, percent, few, hot), percent, block, few)
    sets = reps.join(family, "rep")
    todo = staged(_dealt(sets, block, grams), "dealt")
    columns = ["family", "n", "sig1", "doc_id", "copies", "blocks", "block", "fragments"]

    def load(batch):
        for part in slices(batch, "text", 1 << 20):
            every = ngram_sets(part.column("text"), n)
            own = signed(np.array([s.sum(dtype=_U) for s in every], _U))
            row, fragment, held = [], [], []
            for i, (s, k) in enumerate(zip(every, part.column("fragments").to_pylist())):
                edges = np.searchsorted(s, np.array([(f << 64) // k for f in range(1, k)], _U))  # ranges of hashes
                row += [i] * k
                fragment += range(k)
                held += [x.tobytes() for x in np.split(s, edges)]
            own = pa.array(own).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(pa.array(row, pa.int64())) for c in columns), own, pa.array(fragment, pa.int32()), pa.array(held, pa.binary())],
                [*columns, "own", "fragment", "grams"],
            )

    def met(todo):
        """Rows of every two blocks: a set goes to as many pairs as there are blocks."""
        loaded = map_batches(
            rows.join(small_side(todo), "doc_id").select(*columns, "text"), load,
            "family long, n long, sig1 long, doc_id long, copies long, blocks int, block int, fragments int, own long, fragment int, grams binary",
        ).where("own = sig1")
        pairs = loaded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return pairs.select("family", "doc_id", "n", "copies", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "fragment", "grams")

    links = "a long, b long, links long"
    found = staged(met(todo.where("fragments = 1")).groupBy("family", "low", "high").applyInPandas(_verify(percent), links), "found")
    large = todo.where("fragments > 1")
    if large.limit(1).count():
        row = "family long, low int, high int, doc_id long, n long, copies long, block int, overlap binary"
        partial = met(large).groupBy("family", "low", "high", "fragment").applyInPandas(_partial, row)
        summed = partial.groupBy("family", "low", "high", "doc_id").applyInPandas(_summed, row)
        found = found.union(staged(summed.groupBy("family", "low", "high").applyInPandas(_verify_summed(percent), links), "found"))
    joined = components(found.where("a <> b").select("a", "b"))
    degrees = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("near"))
    reps = reps.join(joined.withColumnRenamed("id", "rep"), "rep", "left").join(degrees, "rep", "left")
    reps = reps.select("n", "sig1", "sig2", "copies", F.coalesce("component", "rep").alias("component_id"), F.coalesce("near", F.lit(0)).alias("near"))
    out = small.join(reps, ["n", "sig1", "sig2"], "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce(F.col("copies") - 1 + F.col("near"), F.lit(0))).cast("long").alias("n_links"),
    )
