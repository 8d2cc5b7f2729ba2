"""The Viterbi walk on a unigram model: the given vocabulary with the model's type changed, against the library and against all splits.

On this altered vocabulary the library's ``encode`` takes lesser paths for some words ("the" as one piece of -13, not as two of -2 and -6; why is not
known), so its ids are no oracle. Its sums are a bound from below, and the search over all splits of each word is the proof.
"""

import functools
import random
from array import array

import pytest

from tidepanel.llm.sentencepieces import MARK, UNIGRAM, Pieces, piece_ids, type_place
from tidepanel.llm.tokens import tokenizer_path


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        raw = bytearray(f.read())
    place = type_place(bytes(raw))
    assert raw[place] != UNIGRAM
    raw[place] = UNIGRAM
    out = tmp_path_factory.mktemp("models") / "unigram.model"
    out.write_bytes(raw)
    return str(out)


def made(seed, n):
    rng = random.Random(seed)
    words = ["the", "international", "unbelievable", "don't", "x", "é", "naïve", "日本語", "🙂", "antidisestablishment", "123", "...", "aaaaaaaaaaaa", "", "\n", "the\nend"]
    return [" ".join(rng.choice(words) + rng.choice(("", "s", "ing", "é")) for _ in range(rng.randint(0, 12))) for _ in range(n)] + ["", " ", "  a  b ", "\n\n", "ab" * 40]


def test_the_type_decides(path):
    assert Pieces(tokenizer_path("piece_bpe_32k.model")).merges
    assert not Pieces(path).merges
    assert type_place(b"") is None


def test_a_unigram_model_gives_no_lesser_path_than_the_library(spark, path):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=path)
    texts = made(3, 300)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: list(r["ids"]) for r in piece_ids(rows, path).collect()}
    def total(ids):
        return sum(library.get_score(i) for i in ids)

    theirs = {i: library.encode(t) for i, t in enumerate(texts)}
    assert {i: library.decode(x) for i, x in got.items()} == {i: library.decode(x) for i, x in theirs.items()}
    assert all(total(got[i]) >= total(ids) for i, ids in theirs.items())
    assert sum(got[i] == ids for i, ids in theirs.items()) >= 30
    merges = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    assert any(merges.encode(t) != got[i] for i, t in enumerate(texts))


def test_forward_scores_are_the_greatest_sums(path):
    pieces = Pieces(path)

    def best(word):
        @functools.lru_cache(None)
        def to(end):
            return 0.0 if not end else max(
                to(k) - pieces.costs.get(word[k:end], pieces.unknown) for k in range(end) if word[k:end] in pieces.ids or k == end - 1
            )

        return to(len(word))

    back = {i: p for p, i in pieces.ids.items()}
    words = sorted({MARK + w for w in " ".join(made(5, 60)).split() if w.isascii()})
    for word, ids in zip(words, pieces.walk(words)):
        found = [back[i] for i in array("I", ids)]
        assert "".join(found) == word
        assert -sum(pieces.costs[p] for p in found) == best(word)
