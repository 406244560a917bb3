"""Token ids of a corpus in binary files: tokenized where texts are read, coded by :mod:`rans`, read back in parallel.

Documents are dealt to range partitions by their key and sorted within. Each partition is a shard and writes groups of
about a million ids (at least one document); a group knows its shard and how many of the shard's ids come before
it, so files can be read in any order. Files are written and read by Spark's own committers and
readers, on any file system: each group is a row of a text sink, ended by one byte 0x0A.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlake.llm import rans
from arborlake.llm.text import arrow_columns, kept, slices, utf8
from arborlake.runtime import durable, shared_path, small_side

#: Ids in a block and in a group, and units of text whose ids a worker remembers.
BLOCK_IDS, GROUP_IDS, REMEMBERED = 16_384, 1_048_576, 800_000
#: Groups in a file, which is read as one row.
FILE_GROUPS = 16
END_ID = 0
_SHARD = "<IQ"
#: White space other than space and line end, by code point.
_OTHER_SPACE = (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Stands between texts that are cut together; texts with it are odd.
_MARK = b"\x01"
#: What keeps a text from being cut by plain replacement: other white space than single spaces and one or two line ends
#: within it.
_ODD = r"  | \n|\n |\n\n\n|\x00|\x01|^[ \n]|[ \n]\z|[" + "".join(rf"\x{{{c:x}}}" for c in _OTHER_SPACE) + "]"
_ID = attrgetter("id")
#: Bytes that an Arrow column of the shorter kind holds.
_SHORT = 1 << 31
#: Characters from here on are not judged here but left to the tokenizer, whose character tables may be of another age.
_JUDGED = "\u0530"


def _byte_letters() -> dict[int, str]:
    """The letters that a byte-level vocabulary has for bytes: printable ones stand for themselves, others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _cuts_hold(tokenizer) -> bool:
    """Whether this is a tokenizer that :class:`Units` may cut texts for: byte-level BPE with the usual pattern, no normalizer,
    no dropout, and added tokens that no cut or word touches."""
    from tokenizers import models, pre_tokenizers

    pre, model = tokenizer.pre_tokenizer, tokenizer.model
    if not isinstance(pre, pre_tokenizers.ByteLevel) or not isinstance(model, models.BPE) or tokenizer.normalizer is not None:
        return False
    if pre.add_prefix_space or not pre.use_regex or model.dropout or model.unk_token or model.continuing_subword_prefix or model.end_of_word_suffix:
        return False
    added = tokenizer.get_added_tokens_decoder().values()
    odd = lambda t: t.single_word or t.lstrip or t.rstrip or t.content.isalpha() or any(c in " \n\x00,." for c in t.content)
    return not any(map(odd, added))


class Units(dict):
    """Ids of units of text, each looked up in the tokenizer once; a tokenizer of another kind encodes whole texts.

    Texts are cut into units where the byte-level tokenizer always starts a new piece, so that a text's ids are its units'
    ids in a row: before a single space between characters that are no white space, around one or two line ends
    between such, and before a comma or full stop after a letter or digit.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.letters, self.new = Tokenizer.from_file(path), _byte_letters(), []
        self.cut = _cuts_hold(self.tokenizer)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.point, self.word_end, self.seen = np.zeros(1 << 14, bool), np.zeros(1 << 14, bool), np.zeros(1 << 14, np.int32)

    def _forget(self) -> None:
        """Keep the half of the units that was used most."""
        n = len(self)
        stay = np.sort(np.argpartition(-self.seen[:n], n // 2)[: n // 2])
        names = list(self)
        self.clear()
        self.update((names[i], k) for k, i in enumerate(stay.tolist()))
        self.flat, _ = self._ids(stay)
        self.used, n = len(self.flat), self.length[stay]
        for a in (self.length, self.point, self.word_end, self.seen):
            a[: len(stay)] = a[stay]
        self.start[: len(stay)] = np.cumsum(n) - n
        self.seen[: len(stay)] //= 2

    def __missing__(self, unit: bytes) -> int:
        self[unit] = n = len(self)
        self.new.append(unit)
        return n

    def _learn(self) -> None:
        """Look up the new units: single words by the tokenizer's model, whose one piece they are, all else by encoding."""
        if not self.new:
            return
        units, self.new = self.new, []
        tokenize, ids, space = self.tokenizer.model.tokenize, [None] * len(units), self.letters[32]
        coded = pa.array(units, pa.large_binary()).view(pa.large_string())
        plain = pc.ascii_is_alpha(pc.replace_substring_regex(coded, "^ ", "")).to_numpy(zero_copy_only=False)
        # the letters of such words stand for themselves, their space for another letter
        words = pc.replace_substring(coded.filter(pa.array(plain)), " ", space).to_pylist()
        for i, w in zip(np.flatnonzero(plain).tolist(), words, strict=True):
            ids[i] = list(map(_ID, tokenize(w)))
        point, word_end, rest = np.zeros(len(units), bool), plain.copy(), []
        for i in np.flatnonzero(~plain).tolist():
            u = units[i].decode()
            point[i], word_end[i] = u[:1] in (",", "."), u[-1:].isalnum() and u[-1] < _JUDGED
            if u.removeprefix(" ").isalpha() and max(u) < _JUDGED:
                ids[i] = list(map(_ID, tokenize(units[i].decode("latin-1").translate(self.letters))))
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch([units[i].decode() for i in rest], add_special_tokens=False), strict=True):
            ids[i] = e.ids
        first, lengths = len(self) - len(units), np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat) + (1 << 16), np.int32)))
        while len(self) > len(self.start):
            grown = (self.start, self.length, self.point, self.word_end, self.seen)
            self.start, self.length, self.point, self.word_end, self.seen = (np.concatenate((a, np.zeros_like(a))) for a in grown)
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
        self.start[first : len(self)] = self.used + np.cumsum(lengths) - lengths
        self.length[first : len(self)] = lengths
        self.point[first : len(self)], self.word_end[first : len(self)] = point, word_end
        self.seen[first : len(self)] = 0
        self.used += total

    def _numbers(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(number of each distinct unit, place of each unit among those, the distinct units)."""
        if len(self) > REMEMBERED:
            self._forget()
        coded = units.dictionary_encode()
        at, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        unit = np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))
        self._learn()
        self.seen[unit] += np.bincount(at, minlength=len(distinct))
        return unit, at, distinct

    def _units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(units of all texts in a row, how many there are up to the end of each). The texts are cut by plain replacement."""
        cut = _MARK.join(texts).replace(b" ", b"\x00 ").replace(b",", b"\x00,").replace(b".", b"\x00.").replace(b"\n", b"\x00\n\x00")
        cut = cut.replace(_MARK, b"\x00" + _MARK + b"\x00")
        cut = pa.array([cut], pa.binary() if len(cut) < _SHORT else pa.large_binary())
        unit, at, distinct = self._numbers(pc.split_pattern(cut, b"\x00").values)
        marks = np.flatnonzero(at == distinct.index(_MARK)) if len(texts) > 1 else np.zeros(0, np.int64)
        return np.delete(unit[at], marks), np.append(marks - np.arange(len(marks)), len(at) - len(marks))

    def _slowly(self, text: bytes) -> np.ndarray:
        """The ids of a text that has other white space or points elsewhere than after words."""
        if not text:
            return np.zeros(0, np.int32)
        unit, at, _ = self._numbers(pa.array([x.encode() for x in _cut(text.decode())], pa.large_binary()))
        return self._ids(unit[at])[0]

    def _ids(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each unit)."""
        n = self.length[unit]
        ends = np.cumsum(n, dtype=np.int64)
        at = np.repeat(self.start[unit] - (ends - n), n)
        at += np.arange(len(at))
        return self.flat[at], n

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each whole text, given in UTF-8."""
        texts = texts.cast(pa.large_binary())
        if not self.cut:
            found = self.tokenizer.encode_batch(texts.view(pa.large_string()).to_pylist(), add_special_tokens=False)
            return [np.array(e.ids, np.int32) for e in found]
        odd = pc.match_substring_regex(texts.view(pa.large_string()), _ODD).to_numpy(zero_copy_only=False)
        texts = texts.to_pylist()
        plain = [i for i in np.flatnonzero(~odd).tolist() if texts[i]]
        out: list[np.ndarray | None] = [None] * len(texts)
        if plain:
            unit, ends = self._units([texts[i] for i in plain])
            ids, n = self._ids(unit)
            # a comma or full stop is a unit's start only after a letter or digit
            wrong = np.flatnonzero(self.point[unit[1:]] & ~self.word_end[unit[:-1]]) + 1
            spoilt = set(np.searchsorted(ends, wrong, side="right").tolist())
            at = np.concatenate(([0], np.cumsum(n)))[np.append(0, ends)]
            for k, i in enumerate(plain):
                if k not in spoilt:
                    out[i] = ids[at[k] : at[k + 1]]
        return [self._slowly(t) if x is None else x for x, t in zip(out, texts, strict=True)]


def _cut(text: str) -> list[str]:
    """Cuts before single spaces that stand between two characters that are no white space."""
    parts, out = text.split(" "), []
    for p in parts:
        if out and p and not p[0].isspace() and out[-1] and not out[-1][-1].isspace():
            out.append(" " + p)
        elif out:
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, shards: int | None = None) -> str:
    """Write the ids of every text, each followed by END_ID, in ascending doc_id order; returns the folder.

    docs: doc_id, text; further columns are ignored. Null doc_ids come first; rows of one doc_id stand in the order of their
    texts' hashes and are spread over shards like any others; null and empty texts are the END_ID
    alone. An empty table writes no group. tokenizer: the path of a tokenizers file, readable on every executor.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "__hash", "__nth"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("__hash"), F.monotonically_increasing_id().alias("__nth"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    owner = f"units of {tokenizer}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before, units = TaskContext.get().partitionId(), 0, kept(owner, lambda: Units(tokenizer))
        keys, lengths, parts, cuts, held, block = [], [], [], [], 0, 0

        def group() -> pa.RecordBatch:
            nonlocal before, keys, lengths, parts, cuts, held, block
            if not cuts or cuts[-1] != len(keys):
                cuts.append(len(keys))
            data = struct.pack(_SHARD, shard, before) + rans.pack(keys, np.array(lengths), np.concatenate(parts), cuts)
            before += held
            keys, lengths, parts, cuts, held, block = [], [], [], [], 0, 0
            return pa.RecordBatch.from_pydict({"data": pa.array([data], pa.binary())})

        for b in slices(batches, 8192, 8 << 20, owner):
            for key, ids in zip(b.column(0).to_pylist(), units.encode_all(b.column(1)), strict=True):
                ids = np.append(ids, np.int32(END_ID))
                if len(ids) > 4 * BLOCK_IDS and keys:  # a very long text is a group of its own
                    yield group()
                keys.append(key)
                lengths.append(len(ids))
                parts.append(ids)
                held, block = held + len(ids), block + len(ids)
                if block >= BLOCK_IDS:
                    cuts.append(len(keys))
                    block = 0
                if held >= GROUP_IDS or len(ids) > 4 * BLOCK_IDS:
                    yield group()
        if keys:
            yield group()

    rows.mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_GROUPS).text(folder)
    return folder


def read_token_files(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked, the ids.

    start counts the ids of all documents before it. Groups are decoded independently of each other, the parts of their
    blocks between checkpoints side by side.
    """
    schema = "shard long, start long, doc_id long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            for file in b.column(0):
                data, at = memoryview(file.as_buffer()), 0
                while at < len(data):
                    shard, start = struct.unpack_from(_SHARD, data, at)
                    group = rans.Group(data, at + struct.calcsize(_SHARD))
                    at = group.end + 1
                    all_ids = group.ids().astype("<u4")
                    ends = np.cumsum(group.lengths)
                    parts = np.split(all_ids, ends[:-1])
                    out = []
                    for key, end, p in zip(group.keys, ends.tolist(), parts, strict=True):
                        out.append((shard, start + end - len(p), key, len(p), zlib.crc32(p.tobytes()), *([p.tolist()] if ids else [])))
                    yield pa.RecordBatch.from_pydict(arrow_columns(schema, out))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    rows = durable(files.mapInArrow(run, schema), "directory")
    shards = rows.groupBy("shard").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = durable(shards.select(F.col("shard").alias("__shard"), ahead.alias("ahead")), "offsets")
    out = rows.join(small_side(offsets), F.col("shard") == F.col("__shard"))
    return out.select("doc_id", (F.col("start") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def encode_corpus(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Write the files and read them back: doc_id, start, n_tokens, ids_crc32."""
    return read_token_files(docs.sparkSession, write_token_files(docs, tokenizer, **how))
