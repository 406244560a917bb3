import random
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_mixing import targets
from test_passages import words
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents of the test data with planted copies, passages and blanks."""
    folder = tmp_path_factory.mktemp("sf")
    rows = duckdb.sql("SELECT doc_id, text, lang, source, n_chars FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    items = duckdb.sql("SELECT item_id, text FROM '/root/testdata/sf0.001/benchmark.parquet'").fetchall()
    rnd = random.Random(6)
    long = [r for r in rows if len(r[1].split()) > 150][:20]
    for i, r in enumerate(long):
        w = r[1].split(" ")
        w[rnd.randrange(len(w))] = "replaced"
        rows += [(10_000 + i, r[1], *r[2:]), (20_000 + i, " ".join(w), *r[2:])]
    rows += [(30_000 + i, " ".join(r[1].split()[::-1]) + " " + " ".join(items[i][1].split()[2:14]).upper(), *r[2:]) for i, r in enumerate(long[:10])]
    rows += [(40_000, None, "en", "src1", 0), (40_001, "", None, None, 0), (40_002, " \n", "fr", "src2", 2), (None, "The and of that with this are is " * 3, "en", None, 9)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def test_stages_against_brute_force(spark, corpus, tmp_path):
    folder, rows, items = corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [tuple(r) for r in docs.collect()]
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
    by_id = {r[0]: r for r in rows}

    kept = {r[0] for r in seen["language"]}
    assert not kept & {40_000, 40_001, 40_002} and len(kept) >= 0.98 * (len(rows) - 3)

    ids = sorted(kept, key=lambda d: (d is None, d))
    prints = {d: brute.simhash(by_id[d][1], 5) for d in ids}
    sets = {d: set(brute.shingles(by_id[d][1], 5)) for d in ids}
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if None not in (a, b)]
    similar = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    sure = [(a, b) for a, b in similar if (prints[a] ^ prints[b]).bit_count() <= 9]  # the masks cover nine bits

    def survivors(edges):
        least = {}
        for d, part in brute.components(ids, edges).items():
            if d is not None:
                least[part] = min(d, least.get(part, d))
        return set(least.values()) | {None}

    found = {r[0] for r in seen["near_dedup"]}
    assert survivors(similar) <= found <= survivors(sure) and len(survivors(sure)) - len(survivors(similar)) <= 2
    assert not found & set(range(10_000, 10_020))
    want = found

    windows = {tuple(w[i : i + 10]) for _, t in items for w in [words(t)] for i in range(max(1, len(w) - 9))}
    dirty = {r[0] for r in seen["near_dedup"] if any(tuple(w[i : i + 10]) in windows for w in [words(r[1])] for i in range(len(w)))}
    left = {r[0] for r in seen["decontaminate"]}
    assert not left & dirty and left >= want - dirty - set(range(30_000, 30_010)) and dirty & set(range(30_000, 30_010))

    size = lambda r: len(r[1].split())
    times, sizes, taken, longest = Counter(r[0] for r in seen["mix"]), Counter(), Counter(), Counter()
    for r in seen["decontaminate"]:
        sizes[r[3]] += size(r)
        taken[r[3]] += size(r) * times[r[0]]
        longest[r[3]] = max(longest[r[3]], size(r))
    goal = targets(dict(sizes))
    assert max(times.values()) <= 2 and all(abs(taken[s] - goal[s]) <= longest[s] + 1e-6 for s in sizes)

    tok, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    text = {r[0]: r[1] for r in seen["mix"]}
    for d, start, n, crc in sorted(seen["tokens"], key=lambda r: r[1]):
        ids_ = [*tok.encode(text[d], add_special_tokens=False).ids, 0]
        assert (start, n, crc) == (at, len(ids_), zlib.crc32(np.array(ids_, "<u4").tobytes()))
        at += n
    assert Counter(r[0] for r in seen["tokens"]) == times


def test_run_is_its_stages(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 100
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "mix", "tokens"] and corpus_pipeline.ORACLE_SQL is None
