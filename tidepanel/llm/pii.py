"""Personal data: fixed patterns, and a semi-Markov conditional random field over candidate spans.

The patterns give the base spans. The field adds what they miss: numbers that stand side by side, telephone numbers without
a plus sign (national forms, bare digits behind a word such as "tel"), shorter card numbers, written-out addresses, also with bracketed at and dot. It scores whole segments (bounded in tokens) by features of the span, and a dynamic
programme over the tokens picks boundaries and kinds together; base spans are arcs of the same lattice. A segment that cannot be personal data (no
digit, no ``@``, no written-out address) is no candidate, so the lattice is only built where a text has one.

The weights are trained here, by the gradient of the conditional likelihood, on sentences made from a grammar with a fixed seed.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.common import map_batches, slices

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 16

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TRIGGER = re.compile(r"[0-9@]|(?<![A-Za-z])[Dd][Oo][Tt](?![A-Za-z])")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
_CUE = re.compile(r"(?i)(?<![a-z])(?:tel|telephone|phone|call|mobile|cell|fax|dial|ring|text)[.:]? (?:me |us )?(?:at |on )?\Z")
_SPOKEN = re.compile(r"(?i) ?[ \[(]at[ \])].* ?[ \[(]dot[ \])]")
_MORE = re.compile(r"(?i) ?[ \[(]dot[ \])]")
_WHOLE = re.compile(r"(?i)[A-Z0-9._%+-]+ ?[ \[(]at[ \])] ?[A-Z0-9-]+(?: ?[ \[(]dot[ \])] ?[A-Z0-9-]+)+")
_JOINED = re.compile(r"[A-Za-z0-9][._-]\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _is_number(s: str) -> bool:
    """ASCII digits only: ``isdigit`` also takes superscript and circled ones, which ``int`` refuses."""
    return s.isascii() and s.isdigit()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches, leftmost and not overlapping within a kind, in the order of kind and start."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if 16 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_only_digits(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


def _features(text: str, start: int, end: int, base: str | None) -> list[str]:
    """Features of a whole candidate span."""
    span = text[start:end]
    digits = _only_digits(span)
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", span))
    groups = "-".join(str(min(len(g), 7)) for g in re.findall("[0-9]+", span)[:6])
    before, after = text[start - 1 : start], text[end : end + 1]
    out = [
        "bias", f"digits={min(len(digits), 20)}", f"shape={shape}" if len(shape) < 16 else "shape=long", f"groups={groups}",
        f"luhn={len(digits) > 12 and luhn(digits)}", f"plus={span[0] == '+'}", f"paren={'(' in span and ')' in span}",
        f"at={'@' in span}", f"spoken={bool(_SPOKEN.search(span))}&{bool(_WHOLE.fullmatch(span))}",
        f"glued={bool(before and before in '0123456789@+') or bool(after and after in '0123456789@')}",
        f"dots={span.count('.')}", f"more={bool(_MORE.match(text, end))}",
        f"cue={bool(_CUE.search(text[max(0, start - 24) : start]))}&{len(digits) > 6}", f"zero={digits[:1] == '0'}&{groups}", f"joined={bool(_JOINED.search(text[max(0, start - 2) : start]))}",
    ]
    if base:
        out.append(f"base={base}")
    if span.count(".") == 3 and all(_is_number(p) and len(p) < 4 and int(p) < 256 for p in span.split(".")):
        out.append("octets")
    return out


def candidates(text: str, tokens: list[tuple[int, int]], known: dict[tuple[int, int], str]) -> list[tuple[int, int, list[str]]]:
    """Arcs ``(first token, token after the last, features)`` of one zone of tokens."""
    words = [text[a:b] for a, b in tokens]
    out = []
    for i, first in enumerate(words):
        if not (first[0].isalnum() or first in "+("):
            continue
        digits, numeric, spoken, at, dot = 0, True, False, False, False
        for j in range(i, min(len(words), i + MAX_TOKENS)):
            w = words[j]
            if j > i and "\n" in text[tokens[j - 1][1] : tokens[j][0]]:
                break
            if _is_number(w):
                digits += len(w)
            elif w not in "+().-/":
                numeric = False
            if not w.isalnum() and w not in "+().-/@_%[]":
                break
            at |= w == "@"
            spoken |= w.lower() == "at" and j > i
            dot |= w.lower() == "dot" and spoken
            if not w.isalnum():
                continue
            a, b = tokens[i][0], tokens[j][1]
            kind = known.get((a, b))
            tight = " " not in text[a:b]
            if kind or (numeric and digits >= 7 and _is_number(w)) or (at and tight) or (dot and w.lower() != "dot" and j - i <= 15 and first[0].isalnum()):
                out.append((i, j + 1, _features(text, a, b, kind)))
    return out


def _score(weights: dict, features: list[str]) -> list[float]:
    out = [0.0] * len(KINDS)
    for f in features:
        w = weights.get(f)
        if w:
            out = [x + y for x, y in zip(out, w)]
    return out


def decode(weights: dict, text: str, tokens: list[tuple[int, int]], known: dict[tuple[int, int], str]) -> list[tuple[str, int, int]]:
    """Best segmentation of a zone: kinds and places of its entity segments."""
    arcs: dict[int, list] = {}
    for i, j, features in candidates(text, tokens, known):
        s = _score(weights, features)
        k = max(range(len(KINDS)), key=s.__getitem__)
        arcs.setdefault(j, []).append((i, s[k], k))
    best, back = [0.0], [None]
    for j in range(1, len(tokens) + 1):
        top, how = best[j - 1], None
        for i, s, k in arcs.get(j, ()):
            if best[i] + s > top:
                top, how = best[i] + s, (i, k)
        best.append(top)
        back.append(how)
    out, j = [], len(tokens)
    while j:
        if back[j]:
            i, k = back[j]
            out.append((KINDS[k], tokens[i][0], tokens[j - 1][1]))
            j = i
        else:
            j -= 1
    return out[::-1]


def _sentence(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A made sentence and its true spans."""
    def word():
        return "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8)))

    def number(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card(n):
        body = rng.choice("3456") + number(n - 2)
        full = body + next(c for c in "0123456789" if luhn(body + c))
        return rng.choice([full, full, " ".join(full[i : i + 4] for i in range(0, n, 4)), "-".join(full[i : i + 4] for i in range(0, n, 4))])

    def not_card(n):
        while luhn(full := rng.choice("123456789") + number(n - 1)):
            pass
        return full

    def spoken(at, dot):
        return rng.choice([word, lambda: f"{word()}.{word()}"])() + at + dot.join([*(word() for _ in range(rng.randint(1, 2))), rng.choice(("com", "org", "net", word()))])

    area, mid, end = number(3), number(3), number(4)
    makers = [
        ("email", lambda: f"{word()}.{word()}@{word()}.com"), ("email", lambda: f"{word()}{number(2)}@{word()}.{word()}.org"),
        ("email", lambda: f"{word()} at {word()} dot com"), ("email", lambda: f"{word()} at {word()} dot {word()} dot org"),
        ("ip", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))), ("ip", lambda: ".".join(str(rng.randint(10, 255)) for _ in range(4))),
        ("card", lambda: card(16)), ("card", lambda: card(16)), ("card", lambda: card(15)), ("card", lambda: card(19)),
        ("phone", lambda: f"+1 ({area}) {mid}-{end}"), ("phone", lambda: f"({area}) {mid}-{end}"), ("phone", lambda: f"+{number(2)} {number(3)} {number(7)}"),
        ("phone", lambda: f"+1-{area}-{mid}-{end}"), ("phone", lambda: f"{area}-{mid}-{end}"), ("phone", lambda: f"{area}.{mid}.{end}"),
        ("phone", lambda: f"0{number(2)} {number(4)} {number(4)}"), ("phone", lambda: f"0{number(4)} {number(6)}"), ("phone", lambda: f"0{number(3)}-{number(6)}"),
        ("phone", lambda: f"0{number(3)} {number(3)} {number(4)}"), ("phone", lambda: " ".join([f"0{number(1)}", *(number(2) for _ in range(4))])),
        ("email", lambda: spoken(" [at] ", " [dot] ")), ("email", lambda: spoken(" (at) ", " (dot) ")), ("email", lambda: spoken("[at]", "[dot]")),
        ("phone", None), ("phone", None),
    ]
    decoys = [
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{number(1)}.{number(1)}.{number(2)}",
        lambda: f"{number(3)}-{number(3)}", lambda: not_card(16), lambda: not_card(13), lambda: number(8), lambda: number(10), lambda: f"{word()} at {word()}",
        lambda: f"{number(3)} {number(3)} {number(3)}", lambda: not_card(20), lambda: f"{rng.randint(300, 999)}.{number(3)}.{number(3)}.{number(3)}", lambda: f"{number(4)} {number(4)}",
        lambda: f"{word()}@{word()}", lambda: f"{word()} dot {word()}", lambda: f"{number(2)}/{number(2)}/{number(4)}", lambda: number(7), lambda: not_card(18), lambda: number(12), lambda: number(9),
        lambda: f"0{number(9)}", lambda: f"97{rng.choice('89')}-{number(1)}-{number(2)}-{number(6)}-{number(1)}", lambda: f"{rng.randint(1, 9)} {number(3)} {number(3)} {number(3)}",
        lambda: f"{word()} [at] {word()}", lambda: f"{word()} (dot) {word()}", lambda: f"{rng.randint(1900, 2030)} {rng.randint(10, 12)} {rng.randint(10, 28)} {number(4)}",
        lambda: f"{number(1)}.{number(9)}", lambda: " ".join(str(rng.randint(1900, 2030)) for _ in range(rng.randint(2, 4))), lambda: f"0{number(3)} {number(4)}",
    ]
    parts, spans, at = [], [], 0
    for _ in range(rng.randint(3, 6)):
        pick = rng.random()
        for _ in range(rng.choice((0, 0, 1, 2)) if pick < 0.6 and parts else rng.randint(1, 3)):
            parts.append(word())
            at += len(parts[-1]) + 1
        if pick < 0.55:
            kind, make = rng.choice(makers)
            if make is None or kind == "phone" and rng.random() < 0.3:
                parts.append(rng.choice(("tel", "phone", "call", "mobile", "cell:", "fax", "tel:", "dial")))
                at += len(parts[-1]) + 1
            parts.append(make() if make else rng.choice((lambda: number(10), lambda: f"0{number(9)}", lambda: f"0{number(10)}", lambda: f"{number(5)} {number(5)}"))())
            spans.append((kind, at, at + len(parts[-1])))
        elif pick < 0.85:
            if spans and spans[-1][2] + 1 == at:
                parts.append(word())
                at += len(parts[-1]) + 1
            parts.append(rng.choice(decoys)())
        else:
            parts.append(word())
        at += len(parts[-1]) + 1
        if pick >= 0.55:
            parts.append(word())
            at += len(parts[-1]) + 1
    return " ".join(parts) + ".", spans


def made_sentences(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    rng = random.Random(seed)
    return [_sentence(rng) for _ in range(n)]


@lru_cache(maxsize=1)
def trained_weights(sentences: int = 1000, epochs: int = 8, seed: int = 7) -> dict[str, list[float]]:
    """Weights by stochastic gradient ascent on the conditional likelihood, summed over all segmentations forwards and backwards."""
    data = []
    for text, spans in made_sentences(sentences, seed):
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        truth = {(a, b): KINDS.index(k) for k, a, b in spans}
        arcs = [(i, j, f, truth.get((tokens[i][0], tokens[j - 1][1]))) for i, j, f in candidates(text, tokens, {(a, b): k for k, a, b in base_spans(text)})]
        data.append((len(tokens), arcs))
    weights: dict[str, list[float]] = {}
    rng = random.Random(seed)
    for epoch in range(epochs):
        rng.shuffle(data)
        rate = 0.3 / (1 + epoch)
        for n, arcs in data:
            scored = [(i, j, f, y, _score(weights, f)) for i, j, f, y in arcs]
            ahead = [0.0] + [-math.inf] * n
            at: dict[int, list] = {}
            for arc in scored:
                at.setdefault(arc[1], []).append(arc)
            for j in range(1, n + 1):
                terms = [ahead[j - 1]] + [ahead[i] + s for i, _, _, _, ss in at.get(j, ()) for s in ss]
                m = max(terms)
                ahead[j] = m + math.log(sum(math.exp(t - m) for t in terms))
            behind = [-math.inf] * n + [0.0]
            of: dict[int, list] = {}
            for arc in scored:
                of.setdefault(arc[0], []).append(arc)
            for i in range(n - 1, -1, -1):
                terms = [behind[i + 1]] + [behind[j] + s for _, j, _, _, ss in of.get(i, ()) for s in ss]
                m = max(terms)
                behind[i] = m + math.log(sum(math.exp(t - m) for t in terms))
            for i, j, f, y, ss in scored:
                step = [rate * ((y == k) - math.exp(ahead[i] + s + behind[j] - ahead[n])) for k, s in enumerate(ss)]
                for name in f:
                    w = weights.setdefault(name, [0.0] * len(KINDS))
                    for k, d in enumerate(step):
                        w[k] += d - 0.001 * rate * w[k]
    return weights


def find_spans(text: str, weights: dict) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans of a text, each in the order of kind and start; code points, end exclusive."""
    if not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    added = []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    hot = [i for i, (a, b) in enumerate(tokens) if _TRIGGER.search(text, a, b)]
    zones: list[list[int]] = []
    for i in hot:
        lo, hi = max(0, i - MAX_TOKENS), min(len(tokens), i + MAX_TOKENS + 1)
        if zones and lo <= zones[-1][1]:
            zones[-1][1] = hi
        else:
            zones.append([lo, hi])
    known = {(a, b): k for k, a, b in base}
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for lo, hi in zones:
        for kind, a, b in decode(weights, text, tokens[lo:hi], known):
            before = bisect_left(starts, b)
            if not before or reach[before - 1] <= a:
                added.append((kind, a, b))
    rank = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda s: (rank[s[0]], s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii_report(docs: DataFrame) -> DataFrame:
    """One row per row: ``doc_id``, base counts by kind, the digest of the base spans, and ``spans``, all as ``kind:start:end``.

    Null counts as empty. Rows are judged one by one, so ids may repeat or be null; other columns are left out.
    """
    weights = trained_weights()

    def work(batch):
        for part in slices(batch, "text"):
            found = [find_spans(t or "", weights) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    *(pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS),
                    pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([joined(every) for _, every in found], pa.string()),
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, work, "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; spans that overlap are replaced once, by the kind of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; all rows and columns stay, a null text stays null."""
    weights = trained_weights()
    at = docs.columns.index("text")

    def work(batch):
        for part in slices(batch, "text"):
            texts = [t if t is None else redacted(t, find_spans(t, weights)[1]) for t in part.column("text").to_pylist()]
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(lambda batches: (x for b in batches if b.num_rows for x in work(b)), docs.schema)
