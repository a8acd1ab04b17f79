import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from ironquill.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, _id string, _code int"


def plain(rows, entries=V.ENTRIES, rounds=V.ROUNDS):
    """(vec_id, label, code, error) of every kept row and the digest, with Python's whole numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [[math.floor(1024 * Fraction(float(x))) for x in r[1]] for r in kept]
    dims = len(ints[0]) // 4
    parts = [[v[p * dims : (p + 1) * dims] for v in ints] for p in range(4)]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[parts[p][i] for i in first] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p: [min((far(v, e), k) for k, e in enumerate(books[p])) for v in parts[p]]
    for _ in range(rounds):
        for p in range(4):
            members = {}
            for v, (_, k) in zip(parts[p], near(p), strict=True):
                members.setdefault(k, []).append(v)
            for k, vs in members.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    found = list(zip(*(near(p) for p in range(4)), strict=True))
    rows = [(r[0], r[2], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for r, f in zip(kept, found, strict=True)]
    return rows, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def compare(spark, rows, **how):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = V.vector_codes(table, **how).collect()
    want, digest = plain([(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()], **how)
    total = {}
    for _, label, _, error in want:
        total[label] = total.get(label, 0) + error
    key = lambda r: str(r)
    assert sorted([(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got], key=key) == sorted(
        [(i, c, e, total[label]) for i, label, c, e in want], key=key)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_against_whole_numbers(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(rng.choice([-1, 0, 2]), 0.2) for _ in range(8)], rng.choice([0, 1, None])) for i in range(300)]
    rows += [(i, rows[5][1], 1) for i in (5, 400, 400)] + [(None, rows[7][1], None), (None, [0.0] * 8, 2)]  # repeated ids and vectors, null ids
    rows += [(500, None, 1), (501, [1.0] * 7 + [None], 1), (502, [math.nan] * 8, 1), (503, [math.inf] * 8, 1), (504, [90_000.0, -90_000.0] * 4, 3)]
    compare(spark, rows)


def test_few_vectors_and_ties(spark):
    grid = [(i, [float(i % 3), float(i % 2), 0.0, 1.0] * 2, i % 2) for i in range(12)]
    compare(spark, grid)
    compare(spark, grid, entries=2, rounds=1)
    compare(spark, [(1, [0.5, -0.5, 0.25, -0.0001], None)])


def test_empty_and_odd_lengths(spark):
    assert V.vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert V.vector_codes(spark.createDataFrame([(1, None, 1, "", 1)], SCHEMA)).count() == 0
    got = V.vector_codes(spark.createDataFrame([(1, [1.0] * 4, 1, "", 1), (2, [1.0] * 8, 1, "", 1)], SCHEMA)).collect()
    assert [r["vec_id"] for r in got] == [1]
    with pytest.raises(ValueError):
        V.vector_codes(spark.createDataFrame([(1, [1.0] * 5, 1, "", 1)], SCHEMA))


@pytest.mark.parametrize("spread", [3, 40, 100_000, V.LARGEST - 1])
def test_slices_find_the_nearest_entry(spread):
    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread + 1, (200, 6))
    entries[50:60] = entries[0]
    parts = np.concatenate([rng.integers(-spread, spread + 1, (300, 6)), entries[:70]])
    index, distance = V.Slices(entries).nearest(parts)
    for part, k, d in zip(parts.tolist(), index.tolist(), distance.tolist(), strict=True):
        assert (d, k) == min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(entries.tolist()))


def test_masks_hold_the_cube():
    rng = np.random.default_rng(1)
    entries, parts = rng.integers(-50, 50, (130, 3)), rng.integers(-50, 50, (40, 3))
    s = V.Slices(entries)
    radius = rng.integers(0, 60, 40)
    inside = np.unpackbits(s.within(parts, radius).view(np.uint8), axis=1, bitorder="little")[:, :130].astype(bool)
    assert (inside == (np.abs(parts[:, None] - entries[None]).max(axis=2) <= radius[:, None])).all()
