"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel.session import staged

#: The six ASCII white-space characters; a word is a run of anything else.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"

_U64 = np.uint64


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def words_of(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_CLASS + "+"))


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores behind it until no column of ``frames`` has it, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_ids(docs: DataFrame) -> DataFrame:
    """The ids (``v_doc``) that stand on different texts."""
    digest = F.xxhash64("text")
    rows = docs.where("doc_id is not null and text is not null").groupBy(F.col("doc_id").cast("long").alias("v_doc"))
    return small_side(rows.agg(F.min(digest).alias("low"), F.max(digest).alias("high")).where("low <> high").select("v_doc"))


def versioned(docs: DataFrame, shared: DataFrame, name: str = "version") -> DataFrame:
    """``docs`` with a version: a hash of the text where an id stands on different texts, else 0, which costs next to nothing wherever it travels.

    Rows of one id and one text are one document, rows of one id and different texts are several; id and version tell them apart.
    """
    v = free_name("v_doc", docs)
    shared = shared.withColumnRenamed("v_doc", v)
    version = F.when(F.col(v).isNotNull(), F.coalesce(F.xxhash64("text"), F.lit(0))).otherwise(F.lit(0)).cast("long")
    return docs.join(shared, docs["doc_id"].cast("long") == F.col(v), "left").withColumn(name, version).drop(v)


def with_found(docs: DataFrame, shared: DataFrame, found: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``docs`` with ``columns`` (name in ``found``: name in the result) of the document each row is; null where ``found`` has none or the text is null.

    ``found`` has one row per ``doc_id`` and ``version``.
    """
    doc, version, mine = (free_name(c, docs) for c in ("f_doc", "f_version", "version"))
    found = found.select(F.col("doc_id").alias(doc), F.col("version").alias(version), *(F.col(a).alias(b) for a, b in columns.items()))
    rows = versioned(docs, shared, mine)
    same = (F.col("doc_id").cast("long") == F.col(doc)) & (F.col(version) == F.col(mine))
    out = rows.join(found, same, "left").drop(doc, version, mine)
    return out.withColumns({b: F.when(F.col("text").isNotNull(), F.col(b)) for b in columns.values()})


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a well-mixed 64-bit hash, element by element."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _byte_values(lower: bool) -> np.ndarray:
    values = mix64(np.arange(1, 257, dtype=_U64) * _U64(0x9E3779B97F4A7C15))
    values[[ord(c) for c in BLANKS]] = 0
    if lower:
        values[65:91] = values[97:123]
    return values


_VALUES = {lower: _byte_values(lower) for lower in (False, True)}
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[ord(c) for c in BLANKS]] = True
_IS_STOP = np.zeros(256, bool)
_IS_STOP[[ord(c) for c in ".,"]] = True
_IS_ALNUM = np.zeros(256, bool)
_IS_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_POWERS = np.cumprod(np.full(4096, 0xD6E8FEB86659FD93, _U64))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, 0xD6E8FEB86659FD93, _U64))
    return _POWERS[:n]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an array of texts and the offset of each text; null counts as empty."""
    filled = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array, lower: bool = True, stops: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start byte and end byte of every word of a batch, and the first word of each text (one more at the end).

    With ``stops`` a full stop or comma that ends a word after an ASCII letter or digit is a word of its own.
    """
    data, offsets = text_buffer(texts)
    inside = ~_IS_BLANK[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    if stops and len(data) > 1:
        closes = np.append(~inside[1:], True)
        closes[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
        begins[1:] |= _IS_STOP[data[1:]] & closes[1:] & inside[:-1] & _IS_ALNUM[data[:-1]] & ~begins[1:]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, _U64), starts, starts, first
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    parts = _VALUES[lower][data[starts[0] :]] * powers(int(lengths.max()))[place]
    hashes = mix64(np.add.reduceat(parts, starts - starts[0]))
    ends = starts + np.add.reduceat(inside[starts[0] :].astype(np.int64), starts - starts[0])
    return hashes, starts, ends, first


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a part have about ``limit`` bytes; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


#: Bytes of an Arrow batch, where the session sets no limit of its own. Spark's default is 10,000 rows, however long their texts are.
BATCH_BYTES = 1 << 22


def bounded_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of this session grow much beyond ``BATCH_BYTES``, on either side of the Python workers; a limit that is set already stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def map_batches(df: DataFrame, work, schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch that yields batches."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(run, schema)


#: Rows up to which a written table is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, size: Column | None = None) -> DataFrame:
    """Write a table of a few numbers a row; broadcast it if it has at most ``BROADCAST_ROWS`` rows. ``size`` counts a row with arrays as more."""
    df = staged(df, "side")
    rows = df.count() if size is None else df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _thinned(batches: Iterator[pa.RecordBatch], limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Edges of a task replaced by stars with the same components, ``limit`` edges at a time."""
    def stars(held):
        ends = np.concatenate([np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in held], axis=1)
        ids, place = np.unique(ends, return_inverse=True)
        a, b = place.reshape(2, -1)
        label = np.arange(len(ids))
        while True:
            new = label.copy()
            least = np.minimum(label[a], label[b])
            np.minimum.at(new, a, least)
            np.minimum.at(new, b, least)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = label != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[label[moved]]), pa.array(ids[moved])], ["a", "b"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= limit:
            yield stars(held)
            held, rows = [], 0
    if held:
        yield stars(held)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``(a, b)`` edges: ``(id, component)``, the component being its smallest id.

    Each task first turns its edges into stars. Labels then move to neighbours and then to the label's own label, so a path of n
    links takes about log n rounds. Each round is written to the shared folder. The driver
    reads only the number of labels that changed.
    """
    edges = staged(edges.where("a <> b").select("a", "b"), "edges").mapInArrow(_thinned, "a long, b long")
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("other")).select("id", F.least("id", "other").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("least"))
        hooked = labels.join(near, "id").select("id", F.col("component").alias("before"), F.least("component", "least").alias("component"))
        hooked = staged(hooked, "labels")
        above = hooked.select(F.col("id").alias("component"), F.col("component").alias("top"))
        jumped = staged(hooked.join(above, "component").select("id", "before", F.col("top").alias("component")), "labels")
        if not jumped.where("component <> before").limit(1).count():
            return jumped.select("id", "component")
        labels = jumped.select("id", "component")
