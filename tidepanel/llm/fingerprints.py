"""Document fingerprints by consistent weighted sampling.

A text's terms are its words, lower-cased in A-Z, each weighted by its count. For sample ``k`` every term draws
``r`` and ``c`` from Gamma(2, 1) and ``b`` from [0, 1) out of hashes of the term, quantises its weight to ``t = floor(ln w / r + b)`` and scores
``ln c - r (t - b) - r``. The term of the lowest score, with its ``t``, is the sample. Two texts agree in a sample with the probability of their
generalised Jaccard similarity, the sum of the smaller counts over the sum of the larger ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.llm.common import mix64, slices, word_hashes
from tidepanel.session import staged

SAMPLES = 64
_U = np.uint64


def _gamma_quantiles() -> np.ndarray:
    """Gamma(2, 1) at the middles of 65,536 equal steps of probability: where 1 - (1 + x) exp(-x) reaches them, by Newton's method."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.full(len(p), 1.7)
    for _ in range(60):
        x = np.maximum(x - ((1 - (1 + x) * np.exp(-x)) - p) / (x * np.exp(-x) + 1e-300), x / 8)
    return x


_R = _gamma_quantiles().astype(np.float32)
_LN_C = np.log(_gamma_quantiles()).astype(np.float32)


def _seeds(samples: int) -> np.ndarray:
    return mix64(np.arange(1, samples + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


def sample_texts(texts: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """16 bits of each sample of each text, one text a row; a text without words has zeros."""
    hashes, _, _, first = word_hashes(texts, lower=True)
    out = np.zeros((len(texts), samples), np.uint16)
    counted = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    sizes = np.array([len(t) for t, _ in counted])
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    terms, place = np.unique(np.concatenate([t for t, _ in counted]), return_inverse=True)
    logs = np.log(np.concatenate([c for _, c in counted])).astype(np.float32)
    begins = (np.cumsum(sizes) - sizes)[filled]
    for k, seed in enumerate(_seeds(samples)):
        draw = mix64(terms ^ seed)
        r = _R[(draw & _U(0xFFFF)).astype(np.int64)]
        c = _LN_C[((draw >> _U(16)) & _U(0xFFFF)).astype(np.int64)]
        b = ((draw >> _U(32)) & _U(0xFFFF)).astype(np.float32) / np.float32(65536)
        r_at, b_at = r[place], b[place]
        t = np.floor(logs / r_at + b_at)
        score = c[place] - r_at * (t - b_at) - r_at
        lowest = np.minimum.reduceat(score, begins)
        ties = np.flatnonzero(score == np.repeat(lowest, sizes[filled]))
        best = ties[np.searchsorted(ties, begins)]
        out[filled, k] = (mix64(terms[place[best]] ^ (t[best].astype(np.int64).view(_U) * _U(0xC2B2AE3D27D4EB4F))) & _U(0xFFFF)).astype(np.uint16)
    return out


def as_text(row: np.ndarray) -> str:
    return row.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def edited_text(text: str, following: str) -> str:
    """The last third of a text, in code points, replaced by as much of the beginning of another."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m] if m else text


def _row(doc, text: str, following: str, own: np.ndarray, after: np.ndarray, edited: np.ndarray, changed: str) -> tuple:
    return doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), as_text(own), as_text(edited), likeness(own, edited), likeness(own, after)


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGES = ", part int, first_text string, last_text string, last_doc long"


def _rows(docs: list, texts: list[str], following: list[str], samples: int) -> list[tuple]:
    changed = [edited_text(a, b) for a, b in zip(texts, following)]
    drawn = sample_texts(pa.array([*texts, *following[-1:], *changed], pa.string()), samples)
    n = len(texts)
    return [_row(docs[i], texts[i], following[i], drawn[i], drawn[i + 1], drawn[n + 1 + i], changed[i]) for i in range(n)]


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per row: fingerprints of the text and of its edited text, and their likeness.

    The next document is the one that follows in descending ``doc_id``; the last is followed by the first. Rows of one id follow each other in descending text,
    and null ids come last. Null counts as empty; a text without words has a fingerprint of zeros. Other columns are left out.

    The table is cut into ranges of ``doc_id``; a task walks its range in order. Only the first and the last text of each range cross to another task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    walked = rows.repartitionByRange(order[0]).sortWithinPartitions(*order)  # by the id alone, as range bounds are sampled keys

    def walk(batches):
        first = last = None
        names = [c.split()[0] for c in (_RESULT + _EDGES).split(", ")]
        for batch in batches:
            for part in slices(batch, "text"):
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                if last is None:
                    first = texts[0]
                else:
                    ids, texts = [last[0], *ids], [last[1], *texts]
                last = ids[-1], texts[-1]
                done = _rows(ids[:-1], texts[:-1], texts[1:], samples) if len(ids) > 1 else []
                yield _batch([(*r, None, None, None, None) for r in done], names)
        if last is not None:
            part = TaskContext.get().partitionId()
            yield _batch([(None,) * 7 + (part, first, last[1], last[0])], names)

    held = staged(walked.mapInArrow(walk, _RESULT + _EDGES), "fingerprints")
    edges = held.where("part is not null").select("part", "first_text", "last_text", "last_doc")
    w = Window.orderBy("part")  # one row a task
    top = edges.orderBy("part").limit(1).select(F.col("first_text").alias("start"))
    ends = edges.withColumn("after", F.lead("first_text").over(w)).join(top, F.lit(True), "left").select("last_doc", "last_text", F.coalesce("after", "start").alias("after"))

    def close(batches):
        names = [c.split()[0] for c in _RESULT.split(", ")]
        for batch in batches:
            for doc, text, after in zip(*(batch.column(c).to_pylist() for c in ("last_doc", "last_text", "after"))):
                yield _batch(_rows([doc], [text], [after], samples), names, _RESULT)

    return held.where("part is null").drop("part", "first_text", "last_text", "last_doc").unionByName(ends.mapInArrow(close, _RESULT))


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def _batch(rows: list[tuple], names: list[str], schema: str = _RESULT + _EDGES) -> pa.RecordBatch:
    kinds = [_KINDS[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
