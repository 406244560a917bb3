import numpy as np
import pytest

from arborlake.llm import ann


def brute(ids, m, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        others = np.flatnonzero(ids != ids[i])
        score = m[others] @ m[i] / (np.linalg.norm(m[others], axis=1) * np.linalg.norm(m[i]))
        near = sorted(zip((-np.round(score, 12)).tolist(), ids[others].tolist(), strict=True))[:k]
        out[int(ids[i])] = [x for _, x in near]
    return out


def found(spark, rows, schema="vec_id long, embedding array<float>, score string", **how):
    out = {}
    for r in sorted(ann.nearest(spark.createDataFrame(rows, schema), **how).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(out[r.query_id])
    return out


def data(n, dims, seed, clusters):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, dims))
    return (m + 4 * rng.standard_normal((clusters, dims))[rng.integers(0, clusters, n)] if clusters else m).astype(np.float32)


@pytest.mark.parametrize("clusters", [0, 8])
def test_recall_beyond_the_sample(spark, clusters, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 600)
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "BATCH", 16)
    m, ids = data(4000, 32, 1, clusters), np.arange(4000)
    m[100:400] = m[100]  # a very common vector
    got = found(spark, [(int(i), v.tolist(), "x") for i, v in zip(ids, m, strict=True)])
    want = brute(ids, m.astype(float), 50, 5)
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (5 * len(want)) >= 0.9
    assert got[100] == want[100] == [101, 102, 103, 104, 105]


def test_small_tables_go_through_the_lists(spark):
    m, ids = data(90, 7, 2, 0), np.arange(90) * 5
    rows, want = [(int(i), v.tolist(), "x") for i, v in zip(ids, m, strict=True)], brute(ids, m.astype(float), 50, 5)
    assert found(spark, rows, recall=1.0, epsilon=50.0) == want
    got = found(spark, rows)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_odd_vectors_take_no_part(spark):
    bad = [(10, None), (20, [0.0, 0.0]), (30, [1.0, None]), (40, [float("nan"), 1.0]), (70, [float("inf"), 1.0]), (80, []), (90, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1e30, 1e30]), (50, [0.0, 3.0]), (100, [0.0, -1.0]), (1, [2.0, 0.0]), (0, [1.0, 0.0])]
    got = found(spark, [(i, v, "x") for i, v in bad + rows])
    assert got == {0: [1, 2, 50, 100], 50: [2, 0, 1, 100], 100: [0, 1, 2, 50]}
    assert found(spark, []) == {} and found(spark, [(0, [1.0], "x")]) == {} and found(spark, [(0, [1.0], "x"), (3, [1.0], "y")]) == {0: [3]}


def test_abandoning_only_drops_the_far():
    rng = np.random.default_rng(3)
    m = ann._unit(rng.standard_normal((2000, 64)))
    q = ann._unit(m[:20] + 0.05 * rng.standard_normal((20, 64)))
    far = ((q[:, None] - m[None]) ** 2).sum(2)
    bound = np.sort(far, axis=1)[:, 5]
    a, b, _ = ann.scan_block(q, bound, np.ascontiguousarray(m.T), 2.5, 8)
    kept = set(zip(a.tolist(), b.tolist(), strict=True))
    near = [(i, int(j)) for i in range(20) for j in np.argsort(far[i])[:5]]
    assert sum(x in kept for x in near) >= 0.97 * len(near) and len(kept) < 0.2 * far.size


def test_recall_with_a_small_sample(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute(ids, m, 50, 5)
    for size in (20, 250, 10_000):
        got = {}
        for r in ann.nearest(df, sample_rows=size).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert all(len(x) == 5 for x in got.values())
        assert sum(len(got[q] & set(want[q])) for q in want) / (5 * len(want)) >= 0.9, size


def test_scaled_copies_tie(spark):
    m, ids = data(400, 16, 6, 3), np.arange(400)
    for i in range(1, 40):
        m[i] = m[0] * 2.0 ** (i % 9)  # the same direction exactly, so the same cosine
    rows = [(int(i), v.tolist(), "x") for i, v in zip(ids, m, strict=True)]
    got = found(spark, rows)
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == brute(ids, m.astype(float), 50, 5)[50]


def test_unanswered_queries_are_asked_in_all_lists(spark, monkeypatch):
    m, ids = data(600, 16, 7, 6), np.arange(600)
    rows = [(int(i), v.tolist(), "x") for i, v in zip(ids, m, strict=True)]
    got, want = found(spark, rows, epsilon=-7.9), brute(ids, m.astype(float), 50, 5)  # a test that abandons nearly all
    assert all(len(x) == 5 for x in got.values()) and sum(got[q] == want[q] for q in want) >= 9
