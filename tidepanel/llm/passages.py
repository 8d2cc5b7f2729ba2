"""Removal of repeated passages by sliding spans of sentences.

A text is cut into sentences at ``.``, ``!``, ``?`` and line ends. A sentence of more than ``LONG`` words is cut again after words whose hash says so, so that
two copies are cut alike wherever they begin. From each sentence the shortest run of at least ``RUN`` sentences and ``MIN_WORDS`` words is hashed over
its words. So are spans of ``SPAN`` words: of every ``NEAR`` that begin at neighbouring words the one of the least hash, so that any two copies of
``SPAN + NEAR - 1`` words share one, wherever they begin and whatever their punctuation. Within a text later equal runs or spans are repeats, across
texts all but those of the smallest ``doc_id`` are. Words that a repeat covers go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.common import map_batches, mix64, powers, shared_ids, signed, slices, text_buffer, versioned, with_found, word_hashes
from tidepanel.session import staged

RUN = 2
MIN_WORDS = 16
LONG = 24
#: 47 words hold a span: a passage of 50 does, though its first and last words be joined to others.
SPAN = 32
NEAR = 16

_U = np.uint64
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_BASE = 0xD6E8FEB86659FD93
_INVERSE = np.cumprod(np.full(4096, pow(_BASE, -1, 1 << 64), _U))


def _inverses(n: int) -> np.ndarray:
    global _INVERSE
    if n > len(_INVERSE):
        _INVERSE = np.cumprod(np.full(2 * n, pow(_BASE, -1, 1 << 64), _U))
    return _INVERSE[:n]


class Cut:
    """Sentences and runs of the texts of a slice. ``owner`` and ``number`` tell a sentence's text and its place there."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = text_buffer(texts)
        self.hashes, starts, ends, first = word_hashes(texts, lower=True)
        n = len(starts)
        stop = np.zeros(n, bool)
        if n:
            stop[:] = _STOP[self.data[ends - 1]]
            lines = np.concatenate([[0], np.cumsum(self.data == 10)])
            stop[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
            stop[first[1:][first[1:] > first[:-1]] - 1] = True
            sentence = np.cumsum(stop) - stop
            size = np.bincount(sentence)[sentence]
            stop |= (size > LONG) & (mix64(self.hashes ^ _U(0x5851F42D4C957F2D)) & _U(7) == _U(0))
        self.last = np.flatnonzero(stop)
        self.first = np.append(0, self.last[:-1] + 1)[: len(self.last)]
        self.owner = np.searchsorted(first, self.first, "right") - 1
        self.bounds = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        self.number = np.arange(len(self.last)) - self.bounds[self.owner] if n else self.last
        self.starts, self.ends = starts, ends
        self.words = first
        self.total = np.concatenate([np.zeros(1, _U), np.cumsum(self.hashes * powers(n))])

    def _hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.total[b] - self.total[a]) * _inverses(len(self.hashes) + 1)[a] + (b - a).astype(_U))

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of the spans that have the least hash of ``NEAR`` neighbours."""
        n = len(self.hashes) - SPAN + 1
        if n < NEAR:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        at = np.arange(n)
        keys = self._hash(at, at + SPAN) ^ _U(0x2545F4914F6CDD1D)
        least, width = keys, 1
        while width < NEAR:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        # windows that reach into the next text count for nothing
        inside = at[: len(least)] + SPAN + NEAR - 1 <= np.repeat(self.words[1:], np.diff(self.words))[: len(least)]
        rest = np.zeros(NEAR - 1, _U)
        most, width = np.concatenate([rest, np.where(inside, least, _U(0)), rest]), 1
        while width < NEAR:
            most, width = np.maximum(most[:-width], most[width:]), 2 * width
        begin = np.flatnonzero((most == keys) & (most > _U(0)))
        return begin, keys[begin]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First sentence, sentence after the last, and hash of every run."""
        n = len(self.last)
        words = np.append(self.first, len(self.hashes))
        stop = np.maximum(np.searchsorted(words, self.first + MIN_WORDS), np.arange(n) + RUN)
        begin = np.flatnonzero(stop <= self.bounds[self.owner + 1]) if n else np.zeros(0, np.int64)
        stop = stop[begin]
        return begin, stop, self._hash(words[begin], words[stop])


def _spans(docs: DataFrame) -> DataFrame:
    """First sentence of each run, or -1 minus the first word of a span, with its key, one row per text and key, and whether it is a later repeat within the text."""
    def once(owner, begin, keys, apart):
        order = np.lexsort((begin, keys, owner))
        owner, begin, keys = owner[order], begin[order], keys[order]
        new = np.ones(len(begin), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        # a repeat that overlaps the first is none
        keep = new | (begin >= begin[np.flatnonzero(new)[np.cumsum(new) - 1]] + apart)
        return owner[keep], begin[keep], keys[keep], ~new[keep]

    def work(batch):
        for part in slices(batch, "text"):
            cut = Cut(part.column("text"))
            begin, _, keys = cut.runs()
            owner, begin, keys, again = once(cut.owner[begin], begin, keys, 0)
            at, span_keys = cut.spans()
            span_owner, at, span_keys, span_again = once(np.searchsorted(cut.words, at, "right") - 1, at, span_keys, SPAN)
            number = np.concatenate([cut.number[begin], cut.words[span_owner] - at - 1])
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(pa.array(np.concatenate([owner, span_owner]))) for c in ("doc_id", "version")), pa.array(number, pa.int32()), pa.array(signed(np.concatenate([keys, span_keys]))), pa.array(np.concatenate([again, span_again]))],
                ["doc_id", "version", "sentence", "key", "again"],
            )

    return map_batches(docs, work, "doc_id long, version long, sentence int, key long, again boolean")


def repeated_runs(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """``doc_id`` and ``version`` (as in ``versioned``) and the places of the document's repeated runs and spans, as in ``_spans``."""
    rows = versioned(docs.where("doc_id is not null and text is not null"), shared).select("doc_id", "version", "text")
    spans = staged(_spans(rows), "spans")
    once = spans.where("not again")
    place = F.struct("doc_id", "version")
    keys = once.groupBy("key").agg(F.min(place).alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    late = once.join(keys, "key").where(place > F.col("keeper")).select("doc_id", "version", "sentence")
    every = late.union(spans.where("again").select("doc_id", "version", "sentence"))
    return every.groupBy("doc_id", "version").agg(F.collect_set("sentence").alias("begins"))


def drop_passages(docs: DataFrame) -> DataFrame:
    """One row per row: ``doc_id``, ``n_sentences``, ``n_removed`` (sentences that lose words), ``removed`` (``start:end`` of the parts that go, code points) and the ``text`` that is left.

    Null texts stay null and have no sentences. Rows with one id and one text are one document; rows with one id and different texts are different documents, in a fixed order.
    A row with a null id keeps its text. Other columns are left out; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = shared_ids(rows)
    marks = staged(repeated_runs(rows, shared), "marks")

    def work(batch):
        for part in slices(batch, "text"):
            texts = part.column("text")
            cut = Cut(texts)
            begin, stop, _ = cut.runs()
            words = np.append(cut.first, len(cut.hashes))
            ends = dict(zip(begin.tolist(), stop.tolist()))
            spans = set(cut.spans()[0].tolist())
            chars = np.concatenate([[0], np.cumsum((cut.data & 0xC0) != 0x80)])
            raw = cut.data.tobytes()
            out = []
            for i, (text, begins) in enumerate(zip(texts.to_pylist(), part.column("begins").to_pylist())):
                lo, hi = int(cut.bounds[i]), int(cut.bounds[i + 1])
                if not begins:
                    out.append((hi - lo, 0, "", text))
                    continue
                low, high = int(cut.words[i]), int(cut.words[i + 1])
                gone = np.zeros(high - low, bool)
                for b in begins:
                    if b >= 0 and lo + b in ends:
                        gone[words[lo + b] - low : words[ends[lo + b]] - low] = True
                    elif b < 0 and low - b - 1 in spans:
                        gone[-b - 1 : -b - 1 + SPAN] = True
                at, end = int(cut.offsets[i]), int(cut.offsets[i + 1])
                place = np.append(cut.starts[low:high], end)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                kept, removed = [], []
                for a, b in edge.reshape(-1, 2).tolist():
                    a, b = int(place[a]), int(place[b])
                    kept.append(raw[at:a])
                    removed.append(f"{chars[a] - chars[cut.offsets[i]]}:{chars[b] - chars[cut.offsets[i]]}")
                    at = b
                kept.append(raw[at:end])
                out.append((hi - lo, len(np.unique(np.searchsorted(cut.last[lo:hi], low + np.flatnonzero(gone)))), ",".join(removed), b"".join(kept).decode()))
            n, gone, removed, left = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, pa.string()), pa.array(left, pa.string())],
                ["doc_id", "n_sentences", "n_removed", "removed", "text"],
            )

    joined = with_found(rows, shared, marks, {"begins": "begins"}).select("doc_id", "text", "begins")
    return map_batches(joined, work, "doc_id long, n_sentences long, n_removed long, removed string, text string")
