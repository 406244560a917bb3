"""Static range asymmetric numeral systems over groups of independent, interleaved blocks.

A group is self-contained: one frequency table shared by its blocks, a directory of documents, and blocks of whole
documents. Each block interleaves LANES states over its ids (lane i takes ids i, i + LANES, ...) that share
one stream of 16-bit words, and has checkpoints (all states and the stream's offset) from which decoding
can start, and checksums of its words and of its ids. Blocks are cut at their checkpoints for decoding, and
coding runs over all lanes of all blocks, decoding over those of all their parts, at once.

Layout, little-endian: header (magic, version, blocks, documents, ids, symbols, CRC-32 of all that follows),
symbols u32, frequencies - 1 u16, document keys i64, null flags u8, lengths u32, then per block its
header (ids, documents, words, checkpoints, CRC-32 of words, CRC-32 of ids), states u32, checkpoints, words u16.
The table has room for 65536 symbols. A group of more distinct ids codes each id as two symbols, its upper and its lower
16 bits, by a table of those (the header's flag); its checkpoints count symbols.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC, VERSION, LANES, SCALE, CHECKPOINT = b"ARNS", 2, 64, 16, 128
_HEAD, _BLOCK = struct.Struct("<4sHHIIQII"), struct.Struct("<QIIIII")
_LOW = np.uint64(1 << 16)


@dataclass(frozen=True)
class Block:
    ids: int
    docs: int
    words: np.ndarray
    states: np.ndarray
    offsets: np.ndarray
    saved: np.ndarray
    crc_ids: int


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies in proportion to the counts, each 1 at least, that sum to 2^16. There are as many counts at most."""
    total = 1 << SCALE
    freq = np.maximum(1, counts * total // max(1, counts.sum())).astype(np.int64)
    over = int(freq.sum()) - total
    order = np.argsort(-freq, kind="stable")
    if over < 0:
        freq[order[0]] -= over
    while over > 0:
        take = np.minimum(freq[order] - 1, -(-over // len(order)) if over > len(order) else 1)
        take = np.where(np.cumsum(take) <= over, take, np.maximum(0, over - (np.cumsum(take) - take)))
        freq[order] -= take
        over -= int(take.sum())
    return freq


#: Ids up to which they are numbered and counted by a table.
_DENSE = 1 << 22


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, how often each is there)."""
    if not len(ids) or ids.max() >= _DENSE:
        return np.unique(ids, return_counts=True)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    return symbols, counts[symbols]


def _numbering(symbols: np.ndarray):
    """From ids to their places among the symbols."""
    if not len(symbols) or symbols[-1] >= _DENSE:
        return lambda ids: np.searchsorted(symbols, ids)
    table = np.zeros(int(symbols[-1]) + 1, np.int32)
    table[symbols] = np.arange(len(symbols))
    return lambda ids: table[ids]


def encode_blocks(parts: list[np.ndarray], symbols: np.ndarray, freq: np.ndarray) -> list[tuple]:
    """(words, states, offsets, saved states) of each block of ids."""
    n = np.array([len(p) for p in parts])
    steps = int(-(-n.max() // LANES)) if len(n) and n.max() else 0
    # lanes beyond a block's end have a symbol of their own that leaves the state as it is
    flat = np.full((len(parts), steps * LANES), len(symbols), np.int32)
    number = _numbering(symbols)
    for row, p in zip(flat, parts, strict=True):
        row[: len(p)] = number(p)
    sym = np.ascontiguousarray(flat.reshape(len(parts), steps, LANES).transpose(1, 0, 2))
    # states are below 2^32 and their quotients exact in double precision, which divides faster than whole numbers
    total = float(1 << SCALE)
    base = np.append(np.cumsum(freq) - freq, 0).astype(np.float64)
    freq = np.append(freq, total).astype(np.float64)
    rest, limit = total - freq, freq * total
    x = np.full((len(parts), LANES), float(_LOW))
    out, put, saved = np.zeros((steps, len(parts), LANES), np.uint16), np.zeros((steps, len(parts), LANES), bool), {}
    for t in range(steps - 1, -1, -1):
        s = sym[t]
        full = x >= limit[s]
        high = np.floor(x / total)
        out[t], put[t] = x - high * total, full
        y = np.where(full, high, x)
        x = y + np.floor(y / freq[s]) * rest[s] + base[s]
        if t % CHECKPOINT == 0 and t:
            saved[t] = x.astype(np.uint32)
    done = []
    for b in range(len(parts)):
        own = put[:, b]
        at = [t for t in sorted(saved) if t * LANES < n[b]]
        ends = np.concatenate(([0], np.cumsum(own.sum(axis=1))))
        done.append((out[:, b][own], x[b].astype(np.uint32), ends[at].astype(np.uint32) if at else np.zeros(0, np.uint32), np.stack([saved[t][b] for t in at]) if at else np.zeros((0, LANES), np.uint32)))
    return done


def decode_blocks(blocks: list[tuple[int, np.ndarray, np.ndarray]], symbols: np.ndarray, freq: np.ndarray) -> list[np.ndarray]:
    """The symbols of each (number of symbols, words, states), where states and words are those of any part of a block."""
    n = np.array([k for k, _, _ in blocks])
    steps = int(-(-n.max() // LANES)) if len(n) and n.max() else 0
    starts = np.concatenate(([0], np.cumsum([len(w) for _, w, _ in blocks])[:-1])).astype(np.int64)
    words = np.concatenate([*(w for _, w, _ in blocks), np.zeros(1, np.uint16)]).astype(np.uint64)
    slot = np.repeat(np.arange(len(freq)), freq)
    freq, base = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    gain, shift = freq[slot], np.arange(1 << SCALE, dtype=np.uint64) - base[slot]
    x = np.stack([s for _, _, s in blocks]).astype(np.uint64)
    got = np.zeros((steps, len(blocks), LANES), np.int32)
    live = (np.arange(steps * LANES).reshape(1, steps, LANES) < n[:, None, None]).transpose(1, 0, 2)
    sixteen, at = np.uint64(16), starts
    for t in range(steps):
        low, on = (x & np.uint64(0xFFFF)).astype(np.int64), live[t]
        got[t] = slot[low]
        x = np.where(on, gain[low] * (x >> sixteen) + shift[low], x)
        need = on & (x < _LOW)
        k = np.cumsum(need, axis=1)
        where = np.minimum(at[:, None] + k - 1, len(words) - 1)
        x = np.where(need, (x << sixteen) | words[where], x)
        at = at + k[:, -1]
    if any(int(a) - int(s) != len(w) for a, s, (_, w, _) in zip(at, starts, blocks, strict=True)):
        raise ValueError("a block's words do not end with its ids")
    ids = symbols[got].transpose(1, 0, 2).reshape(len(blocks), -1)
    return [row[:k] for row, k in zip(ids, n.tolist(), strict=True)]


def _halves(ids: np.ndarray) -> np.ndarray:
    """The upper and lower 16 bits of each id in turn."""
    return np.stack([ids >> 16, ids & 0xFFFF], axis=1).reshape(-1)


def pack(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray, cuts: list[int]) -> bytes:
    """A group of documents (key, number of ids; all ids in a row) whose blocks end before the documents ``cuts``."""
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    ids = ids.astype(np.int64)
    symbols, counts = _counted(ids)
    split = len(symbols) > 1 << SCALE
    if split:
        symbols, counts = _counted(_halves(ids))
    symbols, freq = symbols.astype(np.uint32), frequencies(counts)
    first = [0, *cuts[:-1]]
    parts = [ids[ends[a] : ends[b]] for a, b in zip(first, cuts, strict=True)]
    body = [symbols.astype("<u4").tobytes(), (freq - 1).astype("<u2").tobytes()]
    body.append(np.array([0 if k is None else k for k in keys], "<i8").tobytes())
    body.append(np.array([k is None for k in keys], np.uint8).tobytes())
    body.append(lengths.astype("<u4").tobytes())
    coded = encode_blocks([_halves(p) for p in parts] if split else parts, symbols, freq)
    for p, (words, states, offsets, saved), a, b in zip(parts, coded, first, cuts, strict=True):
        w = words.astype("<u2").tobytes()
        body.append(_BLOCK.pack(len(p), b - a, len(words), len(offsets), zlib.crc32(w), zlib.crc32(p.astype("<u4").tobytes())))
        body += [states.astype("<u4").tobytes(), offsets.astype("<u4").tobytes(), saved.astype("<u4").tobytes(), w]
    body = b"".join(body)
    head = _HEAD.pack(MAGIC, VERSION, int(split), len(parts), len(keys), len(ids), len(symbols), zlib.crc32(body))
    return head + len(body).to_bytes(8, "little") + body


class Group:
    """A packed group, read at ``at`` of ``data``; ``end`` is the place after it."""

    def __init__(self, data: bytes, at: int = 0):
        magic, version, self.split, n_blocks, n_docs, self.n_ids, n_symbols, crc = _HEAD.unpack_from(data, at)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a group of token ids")
        size = int.from_bytes(data[at + _HEAD.size : at + _HEAD.size + 8], "little")
        at += _HEAD.size + 8
        self.end = at + size
        if zlib.crc32(memoryview(data)[at : self.end]) != crc:
            raise ValueError("a group of token ids is damaged")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(data, kind, n, at)
            at += a.nbytes
            return a

        self.symbols, self.freq = take("<u4", n_symbols), take("<u2", n_symbols).astype(np.int64) + 1
        keys = take("<i8", n_docs).tolist()
        self.keys = [None if null else k for k, null in zip(keys, take("u1", n_docs).tolist(), strict=True)]
        self.lengths = take("<u4", n_docs).astype(np.int64)
        self.blocks = []
        for _ in range(n_blocks):
            ids, docs, n_words, n_saved, crc_words, crc_ids = _BLOCK.unpack_from(data, at)
            at += _BLOCK.size
            states, offsets, saved = take("<u4", LANES), take("<u4", n_saved), take("<u4", n_saved * LANES).reshape(-1, LANES)
            words = take("<u2", n_words)
            if zlib.crc32(words.tobytes()) != crc_words:
                raise ValueError("a block's words are damaged")
            self.blocks.append(Block(ids, docs, words, states, offsets, saved, crc_ids))

    def _segments(self, b: Block, first: int, last: int | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(symbols, words, states) of the block's parts between checkpoints, from part ``first`` up to ``last``."""
        n, step = b.ids << self.split, CHECKPOINT * LANES
        states, at = [b.states, *b.saved], [0, *b.offsets.tolist(), len(b.words)]
        sizes = [min(step, n - i * step) for i in range(len(states))]
        return [(sizes[i], b.words[at[i] : at[i + 1]], states[i]) for i in range(len(states))][first:last]

    def _whole(self, symbols: list[np.ndarray]) -> np.ndarray:
        flat = np.concatenate([np.zeros(0, np.uint32), *symbols])
        return flat[::2] << np.uint32(16) | flat[1::2] if self.split else flat

    def ids(self) -> np.ndarray:
        """All ids of the group, checked; all parts of all blocks are decoded side by side."""
        parts = [self._segments(b, 0) for b in self.blocks]
        got = decode_blocks([x for p in parts for x in p], self.symbols, self.freq) if parts else []
        out, at = [], 0
        for b, p in zip(self.blocks, parts, strict=True):
            out.append(self._whole(got[at : at + len(p)]))
            at += len(p)
            if zlib.crc32(out[-1].astype("<u4").tobytes()) != b.crc_ids:
                raise ValueError("a block's ids are damaged")
        return np.concatenate([np.zeros(0, np.uint32), *out])

    def document(self, i: int) -> np.ndarray:
        """The ids of one document, from the checkpoint before its first id to that after its last."""
        block, first = 0, 0
        while i >= first + self.blocks[block].docs:
            first += self.blocks[block].docs
            block += 1
        start = int(self.lengths[first:i].sum())
        end, step = start + int(self.lengths[i]), CHECKPOINT * LANES >> self.split
        parts = self._segments(self.blocks[block], start // step, -(-end // step))
        ids = self._whole(decode_blocks(parts, self.symbols, self.freq))
        return ids[start - start // step * step :][: end - start]
