"""SentencePiece ids of whole texts and back, by a Viterbi recursion over a trie of words.

Blanks become the mark U+2581, with one before the text. No piece holds a mark after another sign, and none a line end, so the marked words of a text are encoded apart.
The new words of a slice are sorted: neighbours share prefixes, and a depth-first walk of the trie they form keeps the forward scores of the prefix
that a word shares with the one before. A prefix's score is the greatest sum of piece scores over the admissible paths to it; of equal sums the path of the longer last
piece stays. In a unigram model every path is admissible. In a model of merges a piece must agree with the piece before it (see ``bpe``), which leaves one path.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.bpe import Pairs
from tidepanel.llm.common import map_batches, slices, text_buffer, word_hashes
from tidepanel.llm.tokens import Remembered, tokenizer_path

MARK = "▁"
WORDS = 500_000
_WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Fixed values of the model format: the trainer's settings, the model's type in them, and the type of a unigram model.
TRAINER_FIELD = 2
TYPE_FIELD = 3
UNIGRAM = 1
#: Fixed: what an unknown sign scores below the worst piece.
UNKNOWN_PENALTY = 10.0


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if raw[at - 1] < 0x80:
            return value, at


def _fields(raw: bytes, at: int, end: int):
    """Number, first byte and end of each field's value in a protocol buffer message."""
    while at < end:
        tag, at = _varint(raw, at)
        kind, start = tag & 7, at
        if kind == 0:
            at = _varint(raw, at)[1]
        elif kind == 2:
            size, start = _varint(raw, at)
            at = start + size
        else:
            at += 8 if kind == 1 else 4
        yield tag >> 3, start, at


def type_place(raw: bytes) -> int | None:
    """Where a model's bytes hold its type; None if they leave it out, which means a unigram model."""
    for field, start, end in _fields(raw, 0, len(raw)):
        if field == TRAINER_FIELD:
            for inner, place, _ in _fields(raw, start, end):
                if inner == TYPE_FIELD:
                    return place
    return None


class Pieces:
    """Vocabulary, the walk over sorted words, and a bounded memory of words. Models that know no bytes are not meant: unknown signs become their bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            raw = f.read()
        place = type_place(raw)
        self.merges = place is not None and raw[place] != UNIGRAM
        self.ids: dict[str, int] = {}
        scores: dict[str, float] = {}
        self.bytes = [0] * 256
        self.texts: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.texts.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.texts.append(b"")
            else:
                self.ids[piece], scores[piece] = i, -model.get_score(i)
                self.texts.append(piece.replace(MARK, " ").encode())
        self.costs = scores
        self.unknown = max(scores.values(), default=0.0) + UNKNOWN_PENALTY
        self.pairs = Pairs(lambda a, b: scores.get(a + b))
        self.grow = frozenset(p[:k] for p in self.ids for k in range(1, len(p) + 1))
        self.raw = Remembered(self._raw, WORDS)
        self.sizes = np.array([len(t) for t in self.texts])
        self.places = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(self.texts), np.uint8)
        self.known = Remembered(lambda word: self.walk([word])[0], WORDS)  # also of words that ``turn`` forgot

    def _raw(self, token: str) -> bytes:
        got = self.ids.get(token)
        return array("I", [self.bytes[b] for b in token.encode()] if got is None else [got]).tobytes()

    def walk(self, words: list[str]) -> list[bytes]:
        """Ids of sorted words; the forward scores of a shared prefix are kept from one word to the next."""
        ids, grow, known, agree, tokens_of = self.ids, self.grow, self.pairs.known, self.pairs.agree, self.raw
        merges, costs, unknown = self.merges, self.costs, self.unknown
        out, before = [], ""
        # for each prefix: the start of its last token, that token, its forward score, and where tokens begin that can still end later
        start, token, score, live = [0], [None], [0.0], [[0]]
        for word in words:
            shared = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            for column in (start, token, score, live):
                del column[shared + 1 :]
            for k in range(shared, len(word)):
                last, best, later = -1, 0.0, []
                for j in live[k]:
                    t = word[j : k + 1]
                    if (last < 0 or not merges) and (j == k or t in ids):
                        if merges:
                            fits = known.get((token[j], t))
                            if fits is None:
                                fits = agree(token[j], t)
                        else:
                            fits = True
                        if fits:
                            sum_ = score[j] - costs.get(t, unknown)
                            if last < 0 or sum_ > best:
                                last, best = j, sum_
                    if t in grow:
                        later.append(j)
                later.append(k + 1)
                start.append(last)
                token.append(word[last : k + 1])
                score.append(best)
                live.append(later)
            at, parts = len(word), []
            while at:
                parts.append(tokens_of[token[at]])
                at = start[at]
            out.append(b"".join(reversed(parts)))
            before = word
        return out

    def split(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of any kind, word by word."""
        parts = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn({w for words in parts for w in words})
        return [b"".join(map(self.known.__getitem__, words)) for words in parts]

    def learn(self, words) -> None:
        new = sorted(w for w in words if w not in self.known and w not in self.known.old)
        for word, ids in zip(new, self.walk(new)):
            self.known[word] = ids

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a slice; null counts as empty.

        Where only single blanks and line ends part the words, each distinct word of the slice is looked up once.
        """
        self.known.turn()
        self.raw.turn()
        data, offsets = text_buffer(texts)
        raw = data.tobytes()
        hashes, starts, ends, first = word_hashes(texts, lower=False)
        before = np.where(starts > 0, data[np.maximum(starts - 1, 0)], 32) if len(starts) else starts
        before[first[:-1][first[:-1] < first[1:]]] = 32
        bare = before == 10
        _, sample, which = np.unique(hashes ^ (bare.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
        words = [("" if b else MARK) + raw[i:j].decode() for b, i, j in zip(bare[sample].tolist(), starts[sample].tolist(), ends[sample].tolist())]
        self.learn(words)
        known = [self.known[w] for w in words] + [self.known["\n"]]
        breaks = np.flatnonzero(data == 10)
        place = np.concatenate([starts, breaks])
        order = np.argsort(place, kind="stable")
        which = np.concatenate([which, np.full(len(breaks), len(words))])[order]
        out, bounds = gathered(known, which, np.searchsorted(place[order], offsets))
        # a blank beside a blank, at an end of a text or after a line end, and blanks and marks of other kinds
        odd = np.zeros(len(texts), bool)
        blank = data == 32
        beside = np.append(False, blank[1:] & (blank[:-1] | (data[:-1] == 10))) | np.append((data[1:] == 10) & blank[:-1], False)[: len(data)] if len(data) else blank
        odd[np.searchsorted(offsets, np.flatnonzero(beside | ((data >= 9) & (data <= 13) & (data != 10))), "right") - 1] = True
        filled = np.flatnonzero(offsets[1:] > offsets[:-1])
        odd[filled[blank[offsets[:-1][filled]] | (data[offsets[:-1][filled]] == 10) | blank[offsets[1:][filled] - 1]]] = True
        got = [out[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        if MARK.encode() in raw:
            odd |= np.array([MARK in (t or "") for t in texts.to_pylist()])
        for i in np.flatnonzero(odd).tolist():
            got[i] = self.split([texts[i].as_py()])[0]
        return got

    def decode(self, found: list[bytes]) -> list[str]:
        """The texts of ids: pieces with blanks for marks, bytes put together, the mark before a text taken off."""
        ids = np.frombuffer(b"".join(found), np.uint32)
        sizes = self.sizes[ids]
        after = np.cumsum(sizes)
        raw = self.pool[np.repeat(self.places[ids] - after + sizes, sizes) + np.arange(after[-1] if len(after) else 0)].tobytes()
        bounds = np.concatenate([[0], after])[np.cumsum([0] + [len(x) // 4 for x in found])].tolist()
        return [raw[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]


def gathered(known: list[bytes], which: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit ids of the items ``which`` one after the other, and where the ids of each text begin, given its first item."""
    sizes = np.array([len(k) // 4 for k in known], np.int64)
    pool = np.frombuffer(b"".join(known), np.uint32)
    counts = sizes[which]
    after = np.cumsum(counts)
    out = pool[np.repeat((np.cumsum(sizes) - sizes)[which] - after + counts, counts) + np.arange(after[-1] if len(after) else 0)]
    return out, np.concatenate([[0], after])[first]


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def piece_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row: ``doc_id`` and ``ids``, the ids as an array; null and empty texts have none."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def work(batch):
        for part in slices(batch, "text"):
            found = pieces_of(path).encode(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([memoryview(x).cast("I").tolist() for x in found], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, ids array<int>")


def piece_texts(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``ids``; null ids give an empty text."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def work(batch):
        texts = pieces_of(path).decode([array("I", x or []).tobytes() for x in batch.column("ids").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), work, "doc_id long, text string")


def piece_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row: ``doc_id``, ``n_tokens``, ``ids_crc32`` (little-endian 32-bit ids), ``decoded_sha256`` and ``round_trip``.

    Null counts as empty. ``round_trip`` is false for a text that holds the mark itself, which decodes to a blank. Rows are encoded one by one, so ids may
    repeat or be null; other columns are left out.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")

    def work(batch):
        for part in slices(batch, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            model = pieces_of(path)
            found = model.encode(part.column("text"))
            back = model.decode(found)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(x) // 4 for x in found], pa.int64()),
                    pa.array([zlib.crc32(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                    pa.array([a == b for a, b in zip(texts, back)], pa.bool_()),
                ],
                ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, work, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
