import math
import random
import re
from hashlib import sha256

import pytest

from arborlake.llm import decontaminate, license, passages

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for i, t in items:
            q = words(t)
            n = min(window, len(q))
            wins = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found |= set() if i is None else {str(i)}
        out.append((d, len(w), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed=5, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["É", "the", "THE", "日本"]
    say = lambda k: "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "\n", "-"]) for _ in range(k))
    items = [(i, say(rnd.choice([1, 3, 7, 10, 11, 25]))) for i in range(25)] + [(3, "again w1 w2"), (None, "w1"), (90, ""), (91, None), (92, "w3 " * 14), (100, "--")]
    docs = [(i, say(rnd.choice([0, 2, 30, 200])) + rnd.choice(items)[1].__str__().upper() * rnd.choice([0, 1, 2]) + " " + say(20)) for i in range(n)]
    return docs + [(7, docs[7][1]), (None, docs[3][1]), (n, None), (n + 1, ""), (n + 2, "w3 " * 500)], items


@pytest.mark.parametrize("block", [10**9, 400])
def test_decontamination_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK_BYTES", block)
    docs, items = corpus()
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, n_words string")
    got = decontaminate.contamination_digest(decontaminate.benchmark_matches(d, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.contamination_digest(decontaminate.benchmark_matches(d, none, ["doc_id"])).first().n_hit == 0
    assert decontaminate.benchmark_matches(d.limit(0), none, ["doc_id"]).count() == 0
    assert decontaminate.drop_contaminated(d, none).count() == 1 and license.license_report(d.limit(0)).count() == 0


@pytest.mark.parametrize("block", [10**9, 900])
def test_near_passages_are_dropped_and_others_kept(spark, block, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK_BYTES", block)
    rnd = random.Random(2)
    word = lambda: f"u{rnd.randrange(10**6)}"
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)]
    near = [t.split() for _, t in items]
    for w in near:
        w[15] = "other"
    docs = [(i, " ".join([word() for _ in range(50)] + w + [word() for _ in range(50)])) for i, w in enumerate(near)] + [(100 + i, " ".join(word() for _ in range(100))) for i in range(20)] + [(200, None)]
    got = decontaminate.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), windows=((None, 0.7),))
    assert sorted(r.doc_id for r in got.collect()) == [*range(100, 120), 200]


@pytest.mark.parametrize("threshold,shingle", [(0.8, 5), (0.5, 2), (0.34, 1), (1.0, 3)])
def test_containment_matches_brute_force(spark, threshold, shingle):
    rnd = random.Random(9)
    say = lambda k: " ".join(rnd.choice("abcdefg") for _ in range(k))
    templates = tuple((f"l{i}", say(rnd.choice([1, 2, 4, 9]))) for i in range(8))
    docs = [(i, say(rnd.choice([0, 1, 3, 12, 40]))) for i in range(60)]
    got = {r.doc_id: (r.found, r.containment) for r in license.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), {}, templates, threshold, shingle).collect()}
    for d, text in docs:
        w, found, best = words(text), set(), 0.0
        for label, t in templates:
            q = words(t)
            k = min(shingle, len(q))
            sh = lambda x: {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}  # noqa: B023, E731
            most = math.ceil(len(q) / threshold) if threshold < 1 else len(q)
            for s in range(max(1, len(w))):
                run = w[s : s + most]
                held = len(sh(q) & sh(run)) / len(sh(q)) if threshold < 1 else float(run == q)
                if held * len(sh(q)) >= math.ceil(threshold * len(sh(q)) - 1e-9) and held:
                    found.add(label)
                    best = max(best, held)
        assert (got[d][0], pytest.approx(got[d][1])) == (sorted(found), best), (d, text)


def test_license_phrases(spark):
    docs = [
        (1, "Released under the MIT License. x Under-the mit\nlicense"),
        (2, "Licensed under the Apache License, Version 2.0."),
        (3, "cc by nc, CC BY-NC 4.0; cc by by nc"),
        (4, "This work is licensed under the GNU General Public License, version 3."),
        (5, None), (6, ""), (7, "the mit licenses under the mit"),
        (8, "a permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without limit"),
        (None, "cc by nc"), (2, "Licensed under the Apache License, Version 2.0."),
    ]
    got = sorted((tuple(r) for r in license.license_report(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, base string")).collect()), key=str)
    by = {r[0]: r for r in got}
    assert by[1][:6] == (1, 10, 2, 1, 6, "mit") and by[1][6:] == ("mit", 1.0)
    assert by[2][1:] == (8, 1, 3, 3, "apache-2", "apache-2", 1.0) and len([r for r in got if r[0] == 2]) == 2
    assert by[3][1:6] == (12, 2, 0, 3, "cc-by-nc") and by[4][2:] == (0, None, None, "", "gpl-3", 1.0)
    assert by[5][1:] == by[6][1:] == (0, 0, None, None, "", "", 0.0) and by[7][2] == 0 and by[7][6:] == ("", 0.0)
    assert by[8][6] == "mit" and 0.8 <= by[8][7] < 1 and by[None][2] == 1


def test_words_put_into_a_template(spark):
    mit = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction".split()
    docs = [(k, "before " * 9 + " ".join(mit[:14] + [f"put{i}" for i in range(k)] + mit[14:]) + " after" * 9) for k in (0, 1, 2, 3, 30)]
    got = {r.doc_id: r for r in license.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k in got:
        assert got[k].found == (["mit"] if k < 30 else []), k
    assert min(got[2].starts) == 9 and max(got[2].ends) == 9 + len(mit) + 2


def test_a_block_of_items_stays_small():
    """What a worker unpickles for a full block of distinct windows."""
    import pickle
    import resource
    import subprocess
    import sys

    rnd = random.Random(1)
    text = [tuple(str(rnd.randrange(40_000)).encode() for _ in range(700)) for _ in range(1000)]
    queries = passages.Queries([passages.Passage(t, 1.0, str(i), 10) for i, t in enumerate(text)], 5)
    matcher = passages.Matcher(queries, rnd_array(queries.finder.size))
    data = pickle.dumps((queries.finder, matcher))
    code = "import sys, pickle, resource; import numpy, arborlake.llm.passages; d = sys.stdin.buffer.read(); a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; x = pickle.loads(d); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a)"
    used = subprocess.run([sys.executable, "-c", code], input=data, capture_output=True, check=True).stdout
    assert int(used) < 200_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss  # kilobytes


def rnd_array(n):
    import numpy as np

    return np.random.default_rng(2).integers(1, 50, n)


def test_columns_of_any_name_are_kept(spark):
    names = ["a.b", "text", "__text", "__n", "c0", "doc_id"]
    df = spark.createDataFrame([(1, "the quick brown fox", 2, 3, 4, 5), (1, None, 2, 3, 4, 6)], ", ".join(f"`{n}` {'string' if n == 'text' else 'int'}" for n in names))
    items = spark.createDataFrame([(1, "quick brown")], "item_id long, text string")
    out = decontaminate.drop_contaminated(df, items)
    assert out.columns == names and [tuple(r) for r in out.collect()] == [(1, None, 2, 3, 4, 6)]
