"""Vector codes against a dense search over all entries."""
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, parts, entries, rounds, scale=256):
    """[(vec_id, label, code, error)] and codebooks of rows that take part, in loops over integers."""
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    dim = -(-max((len(r[1]) for r in fine), default=0) // parts) * parts
    step = dim // parts
    vecs = [([math.floor(scale * float(np.float32(x))) for x in r[1]] + [0] * dim)[:dim] for r in fine]
    first = sorted(range(len(fine)), key=lambda i: (fine[i][0] is None, fine[i][0] or 0, vecs[i]))[:entries]
    books = [[vecs[i][p * step:(p + 1) * step] for i in first] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [v[p * step:(p + 1) * step] for v in vecs]
            place = [near(p, x)[1] for x in own]
            books[p] = [[sum(c) // len(c) for c in zip(*g)] if (g := [x for x, k in zip(own, place) if k == e]) else old for e, old in enumerate(books[p])]
    out = []
    for r, v in zip(fine, vecs):
        found = [near(p, v[p * step:(p + 1) * step]) for p in range(parts)]
        out.append((r[0], r[2], [k for _, k in found], sum(d for d, _ in found)))
    return out, books


def key(t):
    return tuple((x is None, x or 0) if not isinstance(x, list) else (False, tuple(x)) for x in t)


def check(spark, rows, parts, entries, rounds):
    df = spark.createDataFrame(rows, SCHEMA)
    coded, books = vector_codes.compress(df, parts=parts, entries=entries, rounds=rounds)
    want, want_books = slow(rows, parts, entries, rounds)
    assert books.tolist() == want_books
    got = [(r.vec_id, r.label, list(r["__vc_code"]), r["__vc_error"]) for r in coded.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    return coded, books


def sample(n, dim, seed=0, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (5, dim))
    return [(i, (centres[i % 5] + rng.normal(0, spread / 3, dim)).astype(np.float32).tolist(), i % 3) for i in range(n)]


@pytest.mark.parametrize("parts,entries,rounds,dim", [(4, 8, 2, 16), (16, 64, 2, 64), (1, 3, 0, 5), (2, 5, 3, 2)])
def test_against_loops(spark, parts, entries, rounds, dim):
    check(spark, sample(150, dim, seed=dim), parts, entries, rounds)


def test_awkward_rows(spark):
    rows = sample(20, 8) + [(3, sample(20, 8)[3][1], None), (3, sample(20, 8)[3][1], None), (100, None, 1), (101, [0.1, None] + [0.0] * 6, 1), (102, [float("nan")] * 8, 2),
                            (103, [float("inf")] + [0.0] * 7, 0), (104, [0.5, -0.25], None), (105, [], 7), (None, [0.1] * 8, None), (107, [0.0] * 8, 1), (108, [-0.0] * 8, 1), (109, [-0.001] * 8, 1)]
    coded, books = check(spark, rows, 4, 6, 2)
    sums = {}
    for r in coded.collect():
        sums[r.label] = sums.get(r.label, 0) + r["__vc_error"]
    for r in vector_codes.with_label_error(coded).collect():
        assert r["__vc_label_error"] == sums[r.label]
    names = ["__vector", "id", "code", "error", "part", "entry", "sum", "vec"]
    extra, _ = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in names}), parts=4, entries=6)
    assert extra.columns == ["vec_id", "embedding", "label", *names, "__vc_code", "__vc_error"]
    assert extra.count() == coded.count()


def test_ties_go_to_the_lower_place(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 1.0], 0), (4, [0.0, 0.0], 0)]
    coded, _ = check(spark, rows, 1, 4, 0)
    assert {r.vec_id: r["__vc_code"][0] for r in coded.collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 0}


def test_empty_and_short(spark):
    coded, books = vector_codes.compress(spark.createDataFrame([], SCHEMA))
    assert coded.count() == 0 and books.size == 0
    check(spark, [(7, [], 1), (8, None, 1)], 16, 64, 2)
    check(spark, sample(3, 16), 16, 64, 2)


def test_too_large(spark):
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(0, [1e30] * 16, 0)], SCHEMA))


@pytest.mark.parametrize("width", [1, 3, 40, 10_000])
def test_cells_keep_every_nearest_entry(width):
    rng = np.random.default_rng(width)
    entries, x = rng.integers(-60, 60, (64, 4)), rng.integers(-90, 90, (5000, 4))
    entries[10] = entries[3]
    d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    table = vector_codes.CellTable(entries, width, cells=300)
    for _ in range(2):
        for lo in range(0, len(x), 250):  # the table starts again now and then
            place, error = table.nearest(x[lo:lo + 250])
            assert (place == d[lo:lo + 250].argmin(axis=1)).all() and (error == d[lo:lo + 250].min(axis=1)).all()
    assert table.evaluated <= 2 * d.size


def test_few_entries_are_evaluated():
    """On clustered parts the cells leave a small share of the entries."""
    rng = np.random.default_rng(5)
    x = (rng.normal(0, 90, (40, 4))[rng.integers(0, 40, 20_000)] + rng.normal(0, 12, (20_000, 4))).astype(np.int64)
    table = vector_codes.CellTable(x[:64], vector_codes.cell_width(x[:64]) // 4)
    table.nearest(x)
    assert table.evaluated < 0.35 * len(x) * 64


def test_decode_and_digest():
    books = np.arange(12).reshape(2, 3, 2)
    assert vector_codes.decode([2, 0], books) == [4, 5, 6, 7]
    assert vector_codes.digest(books) == hashlib.sha256(b"0,1,2,3,4,5,6,7,8,9,10,11").hexdigest()
