"""Token ids of whole texts by the public word tokenizer, with a bounded memory of words."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tidepanel.llm.common import text_buffer, word_hashes

#: Words remembered by a worker; beyond, its memory starts anew.
MEMORY = 250_000

#: Words that are encoded together.
GROUP = 500

_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")


def byte_signs() -> list[str]:
    """The sign that stands for each byte in the vocabulary: itself where printable, else the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Remembered(dict):
    """Results of a function by argument. When the memory is full it becomes the old one, from which what is asked for again moves over."""

    def __init__(self, work: Callable, size: int):
        super().__init__()
        self.work, self.size, self.old = work, size, {}

    def __missing__(self, key):
        got = self.old.get(key)
        self[key] = got = self.work(key) if got is None else got
        return got

    def turn(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


class WordIds:
    """Ids of texts as little-endian 32-bit integers.

    No token spans white space, so each distinct word of a slice is looked up once, and what is new is encoded together.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = load(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Tokenizer(self.tokenizer.model)  # of pieces that are split and normalised already
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        ends = [i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[ends] = True
        self.signs = dict(enumerate(byte_signs()))
        self.known = Remembered(self.whole, MEMORY)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def simple(self, word: str) -> str | None:
        """A word of letters of a plain alphabet, perhaps with signs after it, as its pieces; None for any other."""
        body = word.rstrip(".,!?;:*$%&#|")
        if not _LATIN.fullmatch(body):
            return None
        tail = word[len(body) :]
        body = body.lower()
        if not body.isascii():
            body = body.encode().decode("latin-1").translate(self.signs)
        return f"{body} {tail}" if tail else body

    def learn(self, words: list[str]) -> None:
        plain, texts, counts = [], [], []
        for w in words:
            t = self.simple(w)
            if t is None:
                self.known[w] = self.whole(w)
            else:
                plain.append(w)
                texts.append(t)
                counts.append(1 + (" " in t))
        groups = [" ".join(texts[k : k + GROUP]) for k in range(0, len(texts), GROUP)]
        found = self.pieces.encode_batch_fast(groups, add_special_tokens=False)
        ids = np.array([i for e in found for i in e.ids], np.uint32)
        cuts = ((np.flatnonzero(self.ends[ids]) + 1)[np.cumsum(counts, dtype=np.int64) - 1] * 4).tolist()
        raw, at = ids.tobytes(), 0
        for word, cut in zip(plain, cuts):
            self.known[word] = raw[at:cut]
            at = cut

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a slice; null counts as empty."""
        self.known.turn()
        data = text_buffer(texts)[0].tobytes()
        marked = any(s.encode() in data for s in self.special)
        hashes, starts, ends, first = word_hashes(texts, lower=not marked, stops=not marked)  # the tokenizer lower-cases all but the special tokens
        _, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        words = [data[a:b].decode() for a, b in zip(starts[sample].tolist(), ends[sample].tolist())]
        new = [w for w in words if w not in self.known and w not in self.known.old]
        if new:
            self.learn(new)
        known = [self.known[w] for w in words]
        sizes = np.array([len(k) // 4 for k in known], np.int64)
        places = np.cumsum(sizes) - sizes
        pool = np.frombuffer(b"".join(known), np.uint32)
        counts = sizes[which]
        after = np.cumsum(counts)
        out = pool[np.repeat(places[which] - after + counts, counts) + np.arange(after[-1] if len(after) else 0)]
        bounds = np.concatenate([[0], after])[first].tolist()
        got = [out[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        if marked:
            got = [self.whole(t) if t and any(s in t for s in self.special) else g for t, g in zip(texts.to_pylist(), got)]
        return got


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
