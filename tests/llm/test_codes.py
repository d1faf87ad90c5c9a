from __future__ import annotations

import numpy as np
import pytest

from bidloom.llm import codes, common


def plain(ints, parts, entries, rounds):
    """All distances with plain integers: codes, errors, codebooks; ``ints`` in the order of ids."""
    width = ints.shape[1] // parts
    cut = ints.reshape(len(ints), parts, width).astype(object)
    books = [[cut[i, p] for i in range(min(entries, len(ints)))] for p in range(parts)]
    for k in range(rounds + 1):
        dist = [[[int(((x[p] - e) ** 2).sum()) for e in books[p]] for p in range(parts)] for x in cut]
        near = [[d.index(min(d)) for d in row] for row in dist]
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [x[p] for x, n in zip(cut, near, strict=True) if n[p] == e]
                    if own:
                        books[p][e] = np.array([sum(c) // len(own) for c in zip(*own, strict=True)], dtype=object)
    return ["".join(f"{e:02x}" for e in row) for row in near], [sum(min(d) for d in row) for row in dist], books


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, error int, id int")


@pytest.mark.parametrize("seed,spread,rounds", [(1, 0.3, 2), (2, 2.0, 4), (3, 0.01, 3)])
def test_against_all_distances(spark, seed, spread, rounds):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(220, 8)) * spread).astype(np.float32)
    x[50:90] = x[3]  # one vector many times: ties everywhere
    rows = [(i, [float(v) for v in r], i % 3, "c", 1, 1) for i, r in enumerate(x)]
    got, books = codes.compress(frame(spark, rows).repartition(5), parts=4, entries=16, rounds=rounds)
    want = plain(np.floor(x.astype(float) * 256).astype(int), 4, 16, rounds)
    found = sorted(got.collect(), key=lambda r: r.vec_id)
    assert [r.code.hex() for r in found] == want[0] and [r.error for r in found] == want[1]
    assert books.tolist() == [[e.tolist() for e in b] for b in want[2]]


def test_bounds_hold_and_spare_searches():
    rng = np.random.default_rng(5)
    x, books = rng.integers(-300, 300, (4000, 4)), rng.integers(-300, 300, (64, 4))
    part = codes.Part.searched(x, books, 8)
    for step in (25, 6, 2):
        new = books + rng.integers(-step, step + 1, books.shape)
        part.moved(np.sqrt(codes.own_square(new, books).astype(float)))
        books = new
        d2 = codes.squares(x, books)
        dist = np.sqrt(d2.astype(float))
        assert (part.up >= dist[np.arange(len(x)), part.code]).all() and (np.diff(part.low, axis=1) >= 0).all()
        assert (part.low[:, :-1] <= np.take_along_axis(dist, part.near, 1)).all()
        rest = dist.copy()
        np.put_along_axis(rest, np.concatenate([part.code[:, None], part.near], axis=1), np.inf, 1)
        assert (part.low[:, -1] <= rest.min(axis=1)).all()
        searched = (part.depth() > 8).mean()
        part.settle(x, books)
        assert (part.code == d2.argmin(axis=1)).all()
        part = part.shortened(6)
        part = codes.Part(part.code, codes.bound(codes.upper(part.up)), part.near, codes.bound(codes.lower(part.low)))
        part = codes.Part.searched(x, books, 8) if step > 6 else part
    assert searched < 0.05


def test_two_byte_bounds():
    x = np.concatenate([[0.0, 1.0, 2.0**40, np.inf], np.random.default_rng(1).random(2000) * 10.0 ** np.arange(2000).__mod__(9)])
    fine = x[np.isfinite(x)]
    assert (codes.bound(codes.lower(x)) <= x).all() and (codes.bound(codes.upper(fine)) >= fine).all()
    assert (codes.bound(codes.lower(fine)) >= 0.985 * fine - 1e-9).all() and (codes.bound(codes.upper(fine)) <= 1.01 * fine + 1e-9).all()


def test_large_components_are_exact():
    x = np.array([[2**26 - 1, -(2**26), 5, 7], [0, 0, 0, 1]])
    assert codes.squares(x, x).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for s in x] for r in x]


def test_adapted_lengths():
    counts = np.array([[100, 90, 6, 3, 1, 500], [10, 0, 0, 0, 0, 7], [0, 1, 1, 1, 97, 0]])
    assert codes.adapted(counts, [4, 4, 4]) == [2, 1, 4]


def test_edge_rows(spark):
    v = lambda *x: [float(a) if a is not None else None for a in x]
    rows = [
        (5, v(0, 1, 2, 3), None, "c", 1, 1),
        (5, v(0, 1, 2, 3), None, "c", 1, 1),
        (None, v(9, 9, 9, 9), 1, None, None, None),
        (1, None, 1, "c", 1, 1),
        (2, [], 1, "c", 1, 1),
        (3, v(1, None, 2, 3), 1, "c", 1, 1),
        (4, v(1, float("nan"), 2, 3), 1, "c", 1, 1),
        (6, v(1, float("-inf"), 2, 3), 1, "c", 1, 1),
        (7, v(1, 2, 3), 1, "c", 1, 1),
        (8, v(*range(8)), 1, "c", 1, 1),
        (9, v(-0.001, 0.001, 0, 0), 7, "c", 1, 1),
    ]
    got, books = codes.compress(frame(spark, rows), carry=("label",), parts=4, entries=64)
    got = codes.by_label(common.cut(got, "t"), "label", "label_error")
    assert books.shape == (4, 4, 1)  # 5, 5, 9 and the row without an id
    assert sorted((r.vec_id or -1, r.code.hex(), r.error, r.label_error) for r in got.collect()) == [(-1, "03030303", 0, 0), (5, "00000000", 0, 0), (5, "00000000", 0, 0), (9, "02020202", 0, 0)]
    back = {r.vec_id: r.vector for r in codes.reconstruct(got, books).collect()}
    assert back[5] == [0, 1, 2, 3] and back[9] == [-1 / 256, 0, 0, 0]
    none, books = codes.compress(frame(spark, rows[3:8]), carry=("label",))
    assert none.count() == 0 and none.columns == ["vec_id", "label", "code", "error"] and books.shape == (16, 0, 0)
    assert codes.by_label(none, "label", "label_error").count() == 0
    with pytest.raises(ValueError, match="too large"):
        codes.compress(frame(spark, [(1, v(3e5, 0, 0, 0), 1, "c", 1, 1)]), parts=4)


def test_labels_without_a_value_are_summed_together(spark):
    df = spark.createDataFrame([(1, None, 3), (2, None, 4), (3, 0, 5), (4, 1, 6), (5, 1, 7)], "vec_id long, label int, error long")
    assert {r.vec_id: r.label_error for r in codes.by_label(df, "label", "label_error").collect()} == {1: 7, 2: 7, 3: 5, 4: 13, 5: 13}
