"""Vector codes against a plain version that scans every entry in every round."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import codes as CO
from tidepanel.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """``{vec_id: (code, error)}`` rows, label sums and the digest, in loops over Python integers."""
    kept = [(k, [math.floor(1024 * x) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    width = max(1, -(-max(len(v) for _, v, _ in kept) // 4))
    kept = [(k, v + [0] * (4 * width - len(v)), label) for k, v, label in kept]
    firsts = {}
    for k, v, _ in kept:
        firsts[k] = min(firsts.get(k, v), v)
    order = sorted(firsts, key=lambda k: (k is None, k or 0))[:256]
    book = [[firsts[k][p * width : (p + 1) * width] for k in order] for p in range(4)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry)), i) for i, entry in enumerate(book[p]))

    for _ in range(4):
        for p in range(4):
            groups = {}
            for _, v, _ in kept:
                x = v[p * width : (p + 1) * width]
                groups.setdefault(nearest(p, x)[1], []).append(x)
            for i, own in groups.items():
                book[p][i] = [sum(c) // len(own) for c in zip(*own)]
    out, sums = [], {}
    for k, v, label in kept:
        best = [nearest(p, v[p * width : (p + 1) * width]) for p in range(4)]
        error = sum(d for d, _ in best)
        out.append((k, "".join(f"{i:02x}" for _, i in best), error, label))
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for part in book for entry in part for x in entry).encode()).hexdigest()
    return sorted(((k, c, e, sums[label], digest) for k, c, e, label in out), key=str), digest


def check(spark, rows):
    got = CO.code_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)[0]


def single(x):
    return float(np.float32(x))


@pytest.mark.parametrize("seed", range(3))
def test_codes_equal_full_scans(spark, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(8)] for _ in range(12)]
    rows = [(i, [single(c + rng.gauss(0, 0.1)) for c in rng.choice(centres)], rng.choice((None, 1, 2, 3))) for i in range(600)]
    rng.shuffle(rows)
    check(spark, rows)


def test_ties_and_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [i % 3 / 4, i % 2 / 4, 0.0, -0.25], i % 2) for i in range(400)]
    rows += [(500, None, 1), (501, [0.5, None, 0.5, 0.5], 1), (502, [inf, 0.0, 0.0, 0.0], 1), (503, [nan, 0.0, 0.0, 0.0], None)]
    rows += [(None, [0.125, 0.5, 1.0, 2.0], None), (3, [9.0, 0.0, 0.0, 0.0], 5), rows[7], (504, [], 2), (505, [1.5, 2.0, 0.25, 0.5, 0.75], 2)]
    check(spark, rows)


def test_fewer_rows_than_entries_large_numbers_and_no_rows(spark):
    check(spark, [(2, [100000.0, -200000.0, 0.5, 1.0] * 3, None), (1, [3.0] * 12, 1), (9, [-100000.0] * 12, 1)])
    check(spark, [])
    check(spark, [(1, None, 1)])
    with pytest.raises(ValueError):
        CO.code_report(spark.createDataFrame([(1, [1e9], 1)], SCHEMA))


def test_bounds_save_scans_and_net_displacement_is_used():
    rng = np.random.default_rng(1)
    centres = rng.integers(-300, 300, (64, 16))
    x = centres[rng.integers(0, 64, 3000)] + rng.integers(-20, 20, (3000, 16))
    first = x[:256]
    history, codes = [np.stack([first] * 4)], None
    bounds, stamps, spent = np.zeros((3000, 8)), np.zeros((3000, 8), np.int64), []
    for _ in range(5):
        book = CO.Book(history, True)
        codes, least, work = CO.assign(book, 0, x, codes, bounds, stamps)
        full = ((x[:, None, :] - history[-1][0][None]) ** 2).sum(axis=2)
        assert (codes == full.argmin(axis=1)).all() and (least == full.min(axis=1)).all()
        spent.append(work)
        # every bound, lowered by net displacement, is below the true distance to the group's other entries
        others = np.sqrt(full)
        others[np.arange(3000), codes] = np.inf
        for g, entries in enumerate(book.groups):
            shift = np.array([m[0, entries].max() for m in book.moved])
            assert (bounds[:, g] - shift[stamps[:, g]] <= others[:, entries].min(axis=1)).all()
        new = history[-1].copy()
        for i in np.unique(codes):
            new[0, i] = x[codes == i].sum(axis=0) // (codes == i).sum()
        history.append(new)
    assert spent[0] == 3000 * 256 and max(spent[1:]) < spent[0] and spent[-1] < spent[0] // 2


def test_a_move_back_and_forth_costs_no_bound():
    """An entry that returns has moved by nothing, whatever way it went."""
    here = np.zeros((4, 8, 2), np.int64)
    here[:, :, 0] = np.arange(8) * 100
    away = here + 40
    assert CO.Book([here, away, here], True).moved[0].max() < 1e-6


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_vector_codes"](spark, sf).collect()), key=str)
    assert got == plain(rows)[0] and len(got) == len(rows)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], 7)], SCHEMA)
    odd = df.withColumns({c: F.lit("x") for c in ("key", "ints", "codes", "code", "error", "part", "entry", "n", "sums", "l", "s", "salt")})
    assert [r["code"] for r in CO.code_report(odd).collect()] == ["00000000"]
