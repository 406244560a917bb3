import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from arborlake.llm import rans, tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")


def awkward(n, seed=3):
    rnd = random.Random(seed)
    bits = [" ", "  ", "\n", "\n\n", " \n", "\t", "a", "The", "it's", "'ll", "ß", "É", "日本", "12", "3.5", "!?", "-", " ", " ", "\x1c", "\x00", "<|endoftext|>", "🎉", " the", " 'tis", "x" * 30, ",", ".", "a,b", "it's,", "Ω.", "½.", "日,", "\n\n\n"]
    return ["".join(rnd.choices(bits, k=rnd.randrange(40))) for _ in range(n)] + ["", " ", "a ", " a", "\n a", "<|endoftext|> b"]


def test_units_equal_the_tokenizer(monkeypatch):
    tok = Tokenizer.from_file(PATH)
    units = tokenfile.Units(PATH)
    monkeypatch.setattr(tokenfile, "REMEMBERED", 300)
    texts = awkward(3000) + [" ".join(x.split()) for x in awkward(2000, 4)]
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        for t, ids in zip(some, units.encode_all(pa.array(some)), strict=True):
            assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_units_on_documents():
    import duckdb

    tok, units = Tokenizer.from_file(PATH), tokenfile.Units(PATH)
    texts = [x for (x,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' UNION ALL SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()]
    assert all(a.tolist() == e.ids for a, e in zip(units.encode_all(pa.array(texts)), tok.encode_batch(texts, add_special_tokens=False), strict=True))


@pytest.mark.parametrize("n,kinds", [(1, 1), (5, 2), (70, 3), (40_000, 40), (60_000, 9000), (40_000, 40_000), (50_000, 50_000), (65_536, 65_536), (90_000, 90_000)])
def test_rans_round_trip_and_checkpoints(n, kinds):
    rng = np.random.default_rng(n)
    lengths = []
    while sum(lengths) < n:
        lengths.append(min(int(rng.integers(1, max(2, n // 3))), n - sum(lengths)))
    ids = np.minimum(rng.zipf(1.3, n), kinds) if kinds < n else rng.permutation(n)
    cuts = sorted({len(lengths), *range(2, len(lengths), 3)})
    data = rans.pack(list(range(len(lengths))), np.array(lengths), ids.astype(np.int32), cuts)
    group = rans.Group(data)
    assert group.end == len(data) and (group.ids() == ids).all() and group.lengths.tolist() == lengths
    ends = np.cumsum(lengths)
    for i in {0, len(lengths) // 2, len(lengths) - 1}:
        assert (group.document(i) == ids[ends[i] - lengths[i] : ends[i]]).all()
    assert group.split == (kinds > 65_536)
    for k in {len(data) - 1, len(data) // 2}:
        broken = bytearray(data)
        broken[k] ^= 1
        with pytest.raises(ValueError):
            rans.Group(bytes(broken)).ids()


def test_corpus_round_trip(spark, monkeypatch):
    tok = Tokenizer.from_file(PATH)
    texts = awkward(300) + ["long text " * 30_000, None]
    rows = [(i * 3 % 997, t) for i, t in enumerate(texts)] + [(None, "null key"), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, start string").repartition(7)
    got = tokenfile.encode_corpus(df, PATH, shards=5).collect()
    want, at = [], 0
    key = {d: [] for d, _ in rows}
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        key[d].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in key[r.doc_id]
        at += r.n_tokens
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((d is None, d or 0, *x) for d, xs in key.items() for x in xs)
    assert not want


def test_empty_table(spark):
    assert tokenfile.encode_corpus(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_other_tokenizers_encode_whole_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, texts = Tokenizer.from_file(path), awkward(200)
    assert not tokenfile.Units(path).cut and tokenfile.Units(PATH).cut
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokenfile.read_token_files(spark, tokenfile.write_token_files(df, path), ids=True).collect()}
    assert all(got[i] == [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts))


def test_many_groups_in_bounded_files(spark, monkeypatch, tmp_path):
    words = "the of and to in that is was for it with as on be at by this had not are but from or have an they which one you were all"
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choices(words.split(), k=70_000))) for i in range(40)]
    folder = tokenfile.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), PATH, f"{tmp_path}/out", shards=1)
    assert len(list((tmp_path / "out").glob("part-*"))) == 3
    got = tokenfile.read_token_files(spark, folder).collect()
    ids = Tokenizer.from_file(PATH).encode(rows[7][1]).ids
    assert len(got) == 40 and next(r.ids_crc32 for r in got if r.doc_id == 7) == zlib.crc32(np.array([*ids, 0], "<u4").tobytes())
