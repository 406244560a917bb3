import random
from collections import defaultdict

import numpy as np
import pytest

from arborlake.llm import mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by repeated resharing, from the definition."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, capped = {}, {}
    rest = share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        goal = {s: (rest - sum(capped.values())) * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if goal[s] > most * sizes[s] + 1e-9]
        if not over:
            return goal | capped
        capped |= {s: most * sizes[s] for s in over}


def docs(n, seed=1):
    rnd = random.Random(seed)
    out = [(i, rnd.choice(["b", "a", "é", None, "z", "src9"]) if rnd.random() < 0.5 else "hot", " \t".join(["wörd"] * rnd.choice([0, 1, 5, 30, 400]))) for i in range(n)]
    return [(d, s, " x\x1c" if d % 50 == 3 else None if d % 50 == 4 else t) for d, s, t in out]


@pytest.mark.parametrize("leaf,fan", [(4096, 256), (8, 2)])
def test_mix(spark, leaf, fan, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", leaf)
    monkeypatch.setattr(mixing, "FAN_IN", fan)
    rows = docs(900)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sorted(map(tuple, mixing.mix_documents(df).collect()))
    assert got == sorted(map(tuple, mixing.mix_documents(df.repartition(13)).collect()))
    assert [r[0] for r in got] == list(range(900))
    source = {d: s for d, s, _ in rows}
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for d, size, _, _, t in got:
        sizes[source[d]] += size
        taken[source[d]] += t
        longest[source[d]] = max(longest[source[d]], size)
        assert t <= 2 * size and (not size or t % size == 0)
    want = targets(dict(sizes))
    for d, _, total, target, _ in got:
        assert total == sizes[source[d]] and target == pytest.approx(want[source[d]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] + 1e-6
    assert {r[1] for r in got if r[0] % 50 == 3} == {1} and {r[1] for r in got if r[0] % 50 == 4} == {0}


def test_expectations_are_kept():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 50, 12).astype(float), rng.random(12)
    got = np.mean([mixing.round_fractions(size, p, np.arange(12), 0, seed, True) for seed in range(4000)], axis=0)
    assert np.abs(got - p).max() < 0.04
    one = mixing.round_fractions(size, p, np.arange(12), 0, 1, False)
    assert (one * size).sum() == pytest.approx((p * size).sum()) and ((one > 0) & (one < 1)).sum() <= 1


def test_repeated_rows_and_null_keys(spark):
    rows = [(5, "s", "a b c")] * 7 + [(None, None, "a b")] * 3 + [(6, "s", "d e f"), (6, "s", "d e g"), (7, "t", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, size string")
    out = mixing.mix_documents(df).collect()
    assert len(out) == len(rows) and sum(r.taken for r in out if r.doc_id is not None and r.size) <= 2 * 27
    taken = sorted((r.doc_id, r.taken // r.size) for r in out if r.doc_id and r.size)
    again = mixing.repeat_documents(df)
    assert again.columns == df.columns
    n = defaultdict(int)
    for r in again.collect():
        n[r.doc_id] += 1
    assert n[5] == sum(k for d, k in taken if d == 5) and n[6] == sum(k for d, k in taken if d == 6)
    assert n[None] == sum(r.taken // r.size for r in out if r.doc_id is None)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix_documents(none).count() == 0 and mixing.repeat_documents(none).count() == 0
    blank = spark.createDataFrame([(1, "a", ""), (2, None, None)], none.schema)
    assert sorted((r.doc_id, r.taken, r.target) for r in mixing.mix_documents(blank).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]


def test_columns_of_any_name_are_kept(spark):
    names = ["source", "a.b", "__mix_doc", "__mix_size", "__mix_i", "size", "h", "t_c", "c1", "text", "doc_id"]
    rows = [("s", *range(8), "a b c", i) for i in range(30)] + [("s", *range(1, 9), "a b c", 7)] * 3
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if n in ('source', 'text') else 'int'}" for n in names))
    out = mixing.repeat_documents(df)
    assert out.columns == names and {tuple(r) for r in out.collect()} <= set(rows) and 40 <= out.count() <= 60
