"""Token counts by a tokenizer compiled to a finite-state transducer.

States are compiled when a text first needs them. A state holds what the rest of a text depends on: the kind of the piece that is open (letters, other signs, an apostrophe that may
start a contraction), the longest end of it that can still grow into a token, and for each place in that end the last token before it and how
many tokens it took more than the cheapest. A transition carries the number of tokens that become certain.

A text is cut into chunks. White space sends every state to the start state, so a chunk's map from entry state to exit state and
count is its head up to the first blank, a constant, and the exit state of its tail. Maps compose, and a scan of pairs composes
those of a text; words between blanks are arcs from the start state to itself.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.bpe import Pairs
from tidepanel.llm.common import map_batches, slices
from tidepanel.llm.tokens import Remembered, byte_signs, load, tokenizer_path

CHUNK = 4096
STATES = 200_000
WORDS = 300_000
LIMIT = 2048
FEW = 12
_END = "</w>"
_CLOSING = frozenset(".,")
_CONTROL = re.compile("[\x1c-\x1f]")
#: Fixed: the contractions of the tokenizer's split pattern.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


class Machine:
    """The transducer; ``step`` and ``close`` compile what they meet for the first time."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ranks = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.pairs = Pairs(lambda a, b: ranks.get((a, b)), self._symbols)
        self.tokens = frozenset(model["vocab"])
        self.grow: dict[str, list[str]] = {}  # the tokens that a piece's end can grow into
        for t in self.tokens:
            body = t.removesuffix(_END)
            for k in range(1, len(body)):
                self.grow.setdefault(body[:k], []).append(t)
        self.rest: dict = {}
        self.signs = byte_signs()
        self.words = Remembered(lambda word: self.run(self.start, word + " ")[1], WORDS)
        self.reset()

    @staticmethod
    def _symbols(token: str) -> list[str]:
        if token.endswith(_END):
            body = token.removesuffix(_END)
            return [*body[:-1], body[-1] + _END]
        return list(token)

    def reset(self) -> None:
        self.ids: dict = {}
        self.keys: list = []
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.rest.clear()
        self.start = self._state(("", None))

    def turn(self) -> None:
        """Keep the tables bounded; arcs of words outlive the states."""
        self.words.turn()
        if len(self.keys) > STATES:
            self.reset()

    def _state(self, key: tuple) -> int:
        got = self.ids.get(key)
        if got is None:
            got = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        return got

    # The open piece: (end that can grow, ((offset, context, tokens more than the cheapest), ...), waiting sign).
    # A context is the token before the offset, or, once they are few, the tokens that may still follow it.

    def _fits(self, context, token: str) -> bool:
        return token in context if type(context) is tuple else self.pairs.agree(context or None, token)

    def _rest(self, context, end: str):
        """The context when the piece's end has grown to ``end``; None if no token fits any more."""
        got = self.rest.get((context, end), 0)
        if got == 0:
            may = self.grow.get(end, ())
            if type(context) is tuple:
                got = tuple(t for t in may if t in context) or None
            elif len(may) > FEW:
                got = context
            else:
                got = tuple(t for t in may if self.pairs.agree(context or None, t)) or None
            self.rest[context, end] = got
        return got

    def _feed(self, body: tuple, sign: str) -> tuple[tuple, int]:
        """One sign more that is not the last of its piece; the tokens that become certain."""
        end, tails, _ = body
        last = None
        kept = []
        for at, context, extra in tails:
            t = end[at:] + sign
            if last is None and t in self.tokens and self._fits(context, t):
                last, cost = t, extra + 1
            context = self._rest(context, t)
            if context is not None:
                kept.append((at, context, extra))
        end += sign
        kept.append((len(end), last, cost))
        cut, least = kept[0][0], min(k[2] for k in kept)
        return (end[cut:], tuple((at - cut, context, extra - least) for at, context, extra in kept), ""), least

    def _push(self, body: tuple | None, ch: str) -> tuple[tuple, int]:
        signs = [self.signs[b] for b in ch.encode()]
        if body is None:
            body, total = ("", ((0, "", 0),), ""), 0
        else:
            body, total = self._feed(body, body[2])
        for s in signs[:-1]:
            body, more = self._feed(body, s)
            total += more
        return (body[0], body[1], signs[-1]), total

    def _finish(self, body: tuple) -> int:
        end, tails, sign = body
        for at, context, extra in tails:
            t = end[at:] + sign + _END
            if t in self.tokens and self._fits(context, t):
                return extra + 1
        raise ValueError("no encoding")

    def _whole(self, piece: str) -> int:
        body, total = None, 0
        for ch in piece:
            body, more = self._push(body, ch)
            total += more
        return total + self._finish(body)

    def _compile(self, state: int, ch: str) -> tuple[int, int]:
        kind, body = self.keys[state]
        sort = "" if ch.isspace() and ch not in "\x1c\x1d\x1e\x1f" else {"L": "L", "N": "N"}.get(unicodedata.category(ch)[0], "O")
        if kind.startswith("'"):
            run = kind + ch
            if run in CONTRACTIONS:
                return self.start, self._whole(run)
            if any(c.startswith(run) for c in CONTRACTIONS):
                return self._state((run, None)), 0
            if len(kind) == 1 and sort == "O":
                body, total = self._push(self._push(None, kind)[0], ch)
                return self._state(("O", body)), total
            total, at = self._whole("'"), self.start
            for c in [*kind[1:], ch]:
                at, more = self.step(at, c)
                total += more
            return at, total
        if sort and sort == kind:
            body, total = self._push(body, ch)
            return self._state((kind, body)), total
        total = self._finish(body) if body else 0
        if not sort:
            return self.start, total
        if ch == "'":
            return self._state(("'", None)), total
        body, more = self._push(None, ch)
        total += more
        if sort == "N":
            return self.start, total + self._finish(body)
        return self._state((sort, body)), total

    def step(self, state: int, ch: str) -> tuple[int, int]:
        got = self.moves[state].get(ch)
        if got is None:
            got = self.moves[state][ch] = self._compile(state, ch)
        return got

    def run(self, state: int, text: str) -> tuple[int, int]:
        total = 0
        for ch in text:
            state, more = self.step(state, ch)
            total += more
        return state, total

    def learn(self, words: set[str]) -> None:
        """Arcs of new words. They are run in order, so that a word goes on where it leaves the word before; a full stop or
        comma after a letter closes the piece before it and is an arc of its own."""
        known, old = self.words, self.words.old
        new = [w for w in words if w not in known and w not in old]
        bodies = [w[:-1] if w[-1:] in _CLOSING and w[-2:-1].isalpha() else w for w in new]
        path, last = [(self.start, 0)], ""
        for body in sorted({b for b in bodies if b not in known and b not in old}):
            shared = 0
            for a, b in zip(body, last):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            state, total = path[-1]
            for ch in body[shared:]:
                state, more = self.step(state, ch)
                total += more
                path.append((state, total))
            known[body] = total + self.step(state, " ")[1]
            last = body
        for word, body in zip(new, bodies):
            if word != body:
                known[word] = known[body] + known[word[-1]]

    # Maps of chunks: (head, count, exit state); a chunk without a blank has no exit and is all head.

    def chunk_map(self, chunk: str) -> tuple[str, int, int | None]:
        head, blank, rest = chunk.partition(" ")
        if not blank:
            return chunk, 0, None
        middle, _, tail = rest.rpartition(" ")
        state, more = self.run(self.start, tail)
        return head, sum(map(self.words.__getitem__, middle.split(" "))) + more, state

    def compose(self, a: tuple, b: tuple) -> tuple[str, int, int | None]:
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        state, more = self.run(a[2], b[0])
        if b[2] is None:
            return a[0], a[1] + more, state
        return a[0], a[1] + more + self.run(state, " ")[1] + b[1], b[2]

    def count(self, text: str) -> int:
        """Tokens of a normalised text, whose only white space is the blank."""
        maps = [self.chunk_map(text[k : k + CHUNK]) for k in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        if not maps:
            return 0
        head, total, state = self.compose(("", 0, self.start), maps[0])
        return total + self.run(state, " ")[1]


@lru_cache(maxsize=2)
def machine(path: str) -> tuple[Machine, object, re.Pattern]:
    tokenizer = load(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    gc.set_threshold(200_000, 20, 100)  # the tables are many small objects that live on
    return Machine(path), tokenizer.normalizer.normalize_str, re.compile("|".join(map(re.escape, special)))


def normalised(text: str, normal) -> str:
    """The text as the tokenizer's normaliser leaves it. Texts of 8-bit letters are composed already and only need lower case and single blanks."""
    if not _CONTROL.search(text):
        try:
            text.encode("latin-1")
            return " ".join(text.lower().split())
        except UnicodeEncodeError:
            pass
    return normal(text)


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text; a special token's string counts as one and parts the text."""
    m, normal, special = machine(path)
    m.turn()
    parts = [[normalised(p, normal) for p in special.split(t) if p] for t in texts]
    m.learn({w for own in parts for p in own for w in p.split(" ")})
    return [sum(1 for _ in special.finditer(t)) + sum(map(m.count, own)) for t, own in zip(texts, parts)]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row: ``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    Null and empty texts have no tokens. Rows are counted one by one, so ids may repeat or be null; other columns are left out.
    """
    path = path or tokenizer_path()

    def work(batch):
        for part in slices(batch, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            counts = count_tokens(texts, path)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
