import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from arborlake.llm import simhash
from brute import components, shingles
from brute import simhash as simhash_of
from arborlake.llm.components import connected_components


def brute(rows, k, radius):
    """Fingerprints and components from the definition, on (doc_id, text)."""

    def fp(text):
        w = [x for x in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        s = [] if not w else [" ".join(w)] if len(w) < k else [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps = [fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def texts(n, seed=7):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "NÊ", "Ab"]
    base = [" ".join(rnd.choices(vocab, k=rnd.choice([1, 2, 3, 8, 40, 300]))) for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        out.append((i, rnd.choice([" ", "\n", "\t "]).join(w)))
    return out + [(n, ""), (n + 1, None), (None, out[0][1]), (3, out[3][1]), (n + 2, " \n ")]


@pytest.mark.parametrize("k,radius", [(3, 2), (5, 5)])
def test_components_match_brute_force(spark, k, radius, monkeypatch):
    rows = texts(240)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for pairwise in (48, 2):
        monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
        assert sorted(map(tuple, simhash.simhash_components(df, k, radius).collect()), key=str) == brute(rows, k, radius)


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_masks_cover(radius):
    masks = simhash.covering_masks(radius)
    rnd = random.Random(radius)
    for _ in range(300):
        diff = sum(1 << i for i in rnd.sample(range(64), radius))
        assert any(not m & diff for m in masks)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, fp string, component_id int")
    assert simhash.simhash_components(df).count() == 0
    df = spark.createDataFrame([(5, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2), (2, "a b c d e f", "y", 2), (None, "a b c d e f", "z", 3), (9, None, "", 4)], "doc_id long, text string, fp string, n int")
    assert sorted(map(tuple, simhash.drop_near_duplicates(df).select("doc_id", "fp", "n").collect()), key=str) == [(2, "y", 2), (9, "", 4), (None, "z", 3)]


def test_long_chain_of_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)] + [(1000, 1000 + i) for i in range(50)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500 and all(got[1000 + i] == 1000 for i in range(50)) and len(got) == 253


@pytest.mark.parametrize("pairwise,most", [(48, 4), (3, 0)])
def test_block_masks_link_all_within_the_radius(spark, pairwise, most, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    monkeypatch.setattr(simhash, "MOST_PAIRS", most)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rnd = random.Random(11)
    base = [rnd.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randrange(9))) for b in base for _ in range(12)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 7, 10, 3).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 7 for r in got)

    def parts(edges):
        root = {f: f for f in signed}

        def find(f):
            while root[f] != f:
                f = root[f]
            return f

        for a, b in edges:
            root[find(a)] = find(b)
        out = {}
        for f in signed:
            out.setdefault(find(f), set()).add(f)
        return sorted(map(sorted, out.values()))

    want = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 7]
    assert parts([(r.a, r.b) for r in got]) == parts(want)


def test_near_copies_are_dropped(spark):
    rnd = random.Random(1)
    base = [[f"t{rnd.randrange(3000)}" for _ in range(n)] for n in [60, 120, 400, 900] * 10]
    rows = []
    for i, w in enumerate(base):
        one, many = list(w), list(w)
        one[rnd.randrange(len(w))] = "changed"
        for k in range(0, len(w), 12):
            many[k] = f"other{k}"
        rows += [(i, " ".join(w)), (100 + i, " ".join(w)), (200 + i, " ".join(one)), (300 + i, " ".join(many)), (400 + i, " ".join(w[: len(w) // 2]))]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= set(range(40)) | set(range(300, 340)) | set(range(400, 440)) and not kept & set(range(100, 140))
    assert len(kept & set(range(200, 240))) <= 6


def test_similarity_of_sketches(spark):
    rnd = random.Random(2)
    sets = [(sorted(rnd.sample(range(500), rnd.randrange(1, 60))), sorted(rnd.sample(range(70), rnd.randrange(1, 60)))) for _ in range(50)] + [([1], [1]), ([], [1])]
    df = spark.createDataFrame(sets, "x array<int>, y array<int>")
    got = [r.s for r in df.select(simhash.similar(df.x, df.y, 200).alias("s")).collect()]
    assert got == pytest.approx([len(set(x) & set(y)) / len(set(x) | set(y)) for x, y in sets])


def kept_by_definition(rows, bits=14, k=5, similarity=0.8):
    """Ids kept if documents within ``bits`` and of the similarity are linked, on (doc_id, text)."""
    prints, sets = [simhash_of(t, k) for _, t in rows], [set(shingles(t, k)) for _, t in rows]
    edges = []
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                edges.append((i, j))
    least = {}
    for i, part in components(range(len(rows)), edges).items():
        least[part] = min(rows[i][0], least.get(part, rows[i][0]))
    return set(least.values())


def kept_ids(spark, rows):
    return {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_partners_in_crowded_buckets_are_found(spark):
    rnd = random.Random(4)
    base, rows = [f"t{rnd.randrange(3000)}" for _ in range(250)], []
    for i in range(60):
        one = list(base)
        at = rnd.randrange(220)
        one[at : at + 30] = [f"own{i}_{k}" for k in range(30)]
        two = list(one)
        two[(at + 100) % 250] = "changed"
        rows += [(i, " ".join(one)), (100 + i, " ".join(two))]
    want = kept_by_definition(rows)
    assert len(want) > 40 and kept_ids(spark, rows) == want


def test_similarity_of_long_texts_is_exact(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(60):
        w = [f"t{i}_{rnd.randrange(3000)}" for _ in range(600)]
        run = rnd.randrange(56, 76)  # of 596 shingles, so a similarity from 0.77 to 0.82
        rows += [(i, " ".join(w)), (100 + i, " ".join(w[: 300 - run] + [f"own{i}_{k}" for k in range(run)] + w[300:]))]
    want, close = kept_by_definition(rows), kept_ids(spark, rows)
    prints = {d: simhash_of(t, 5) for d, t in rows}
    near = {d for d in prints if (prints[d % 100] ^ prints[100 + d % 100]).bit_count() <= 7}
    assert close >= want and {d for d in close ^ want} & near == set() and 5 < len(near) / 2


def test_equal_fingerprints_are_verified(spark):
    rows = [(i, "- " * 400 + " ".join(f"own{i}_{k}" for k in range(150))) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(f"own{i}_70 ", "changed ")) for i in range(60)]
    assert len({simhash.fingerprint(t.encode(), 5) for _, t in rows}) == 1
    want = kept_by_definition(rows)
    assert want == set(range(60)) and kept_ids(spark, rows) == want


def test_a_repeated_word_does_not_drop_other_texts(spark):
    rows = [(1, "spam " * 100), (2, "spam " * 100 + " ".join(f"other{i}" for i in range(80)))]
    assert kept_ids(spark, rows) == {1, 2}


def test_chains_of_variants_in_one_bucket(spark):
    """Each variant is near the one before, not near the first."""
    rnd, rows = random.Random(12), []
    for c in range(12):
        w = [f"c{c}_{rnd.randrange(4000)}" for _ in range(600)]
        for i in range(14):
            rows.append((100 * c + i, " ".join(w)))
            for at in rnd.sample(range(600), 7):
                w[at] = f"new{c}_{i}_{at}"
    want = kept_by_definition(rows)
    assert kept_ids(spark, rows) == want and len(want) < 40


def test_long_texts_are_hashed_in_pieces(spark, monkeypatch):
    text = "\t Some WORDS\n" + "".join(f"w{i}{' ' * (1 + i % 3)}" for i in range(5000))
    want = [simhash.fingerprint(text.encode(), k) for k in (1, 3, 5)]
    for piece in (1, 7, 1000):
        monkeypatch.setattr(simhash, "_PIECE", piece)
        assert [simhash.fingerprint(text.encode(), k) for k in (1, 3, 5)] == want
    monkeypatch.undo()
    assert [w & (1 << 64) - 1 for w in want] == [simhash_of(text, k) for k in (1, 3, 5)]
    long = "word another thing " * 500_000
    got = {r.doc_id: r.fingerprint for r in simhash.simhash_components(spark.createDataFrame([(1, long), (2, "a")], "doc_id long, text string"), 3).collect()}
    assert got[2] == f"{simhash_of('a', 3):016x}" and got[1] == f"{simhash_of('word another thing ' * 50_001, 3):016x}"


def test_near_duplicates_keep_columns_of_any_name(spark):
    names = ["doc_id", "text", "_copy", "_twice", "copy", "copy_h", "node", "a.b", "c0", "n"]
    rows = [(5, "a b c d e f", *range(8)), (2, "a b c d e f", *range(8)), (2, "a b c d e f", *range(8)), (None, None, *range(8)), (7, "", *range(8))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names[2:]))
    out = simhash.drop_near_duplicates(df)
    assert out.columns == names and sorted((tuple(r) for r in out.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_hot_fingerprints_and_components(spark):
    rnd = random.Random(3)
    rows = [(i, "same words in every copy of it") for i in range(900)]
    rows += [(1000 + i, " ".join(f"t{rnd.randrange(9000)}" for _ in range(30))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.component_id for r in simhash.simhash_components(df, 3).collect()}
    prints = {d: simhash_of(t, 3) for d, t in rows}
    edges = [(a, b) for a in prints for b in prints if 1000 <= a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert len(got) == len(rows) and all(got[i] == 0 for i in range(900)) and all(got[a] == got[b] for a, b in edges)


@pytest.mark.parametrize("pairwise,block", [(48, 1024), (2, 8)])
def test_pairs_with_distant_fingerprints_are_found(spark, pairwise, block, monkeypatch):
    """The similarity alone decides in the pipeline, so pairs of any fingerprints count, and texts that share a passage do not."""
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    monkeypatch.setattr(simhash, "BLOCK", block)
    if block == 8:  # any order of the shingles gives the same; in this one passages come as early as other words
        monkeypatch.setattr(simhash, "_levels", lambda counts: np.zeros(simhash.CLASSES, np.uint8))
    rnd, rows = random.Random(5), []
    passage = [f"p{k}" for k in range(30)]
    for i in range(600):
        n = rnd.choice([60, 120, 300])
        w = [f"t{i}_{rnd.randrange(3000)}" for _ in range(n)] + passage * (i % 3 == 0)
        at, run = rnd.randrange(n), round(len(w) * rnd.uniform(0.2, 0.24))
        two = [" ".join(w), " ".join(w[:at] + [f"own{i}_{k}" for k in range(run)] + w[at:])]
        if i < 20 or (simhash_of(two[0], 5) ^ simhash_of(two[1], 5)).bit_count() > 13:
            rows += [(i, two[0]), (1000 + i, two[1])]
    rows += [(2000 + i, " ".join(passage * 4 + [f"o{i}_{k}" for k in range(6 + i % 3)])) for i in range(24)]
    want = kept_by_definition(rows, bits=64)
    distant = kept_by_definition(rows) - want
    df = spark.createDataFrame([(*r, "en", "src", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert len(distant) > 2 and {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == want
