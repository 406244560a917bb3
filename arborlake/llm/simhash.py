"""SimHash near-duplicates: 64-bit fingerprints linked by covering locality-sensitive hashing.

Covering: each bit gets one of the 2^(r+1) - 1 non-zero vectors of r+1 bits, and each non-zero vector v
makes a table whose mask keeps the bits with an odd inner product with v. The vectors of r or fewer
differing bits span a space of at most r dimensions, so some v is orthogonal to all of them, and its table
masks every difference out: each pair within the radius collides in some table, always. Block masks give the same
guarantee by another structure (each choice of some blocks of bits) with shorter keys, under which most
pairs beyond the radius collide too; similarity search by word shingles uses them and then verifies.

Buckets of many distinct fingerprints are not compared pair by pair. Within radius 2 they are joined by
balls: two fingerprints differ in 2 bits or fewer exactly if the sets of values one bit or less away from
each meet; so each member sends one row per masked-out bit, and the members that meet at a value are all
linked to the smallest of them. For larger radii a dense bucket is dealt in blocks to many tasks, each of
which returns only a spanning star forest of its real links.

Fingerprints alone miss pairs of a given Jaccard similarity: their bits differ by chance. So near-duplicate removal adds an
exact search to them. All shingles have one order, rare ones first. Of two sets with a similarity of t, each has one of the
shared shingles among its first n - ceil(t n) + 1; so sets that share none of those are left out, and of the others only those
whose sizes or parities (of how many shingles fall into each of some classes) differ more than the similarity allows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.components import connected_components
from arborlake.llm.text import forget, positional, release, slices, space_words, utf8
from arborlake.runtime import durable, small_side, spread_join

BITS = 64
#: Buckets of up to this many distinct fingerprints are compared pair by pair.
PAIRWISE = 48
#: Pairs per member from which a bucket of the sweep gives a star forest.
MOST_PAIRS = 1
#: One table in so many is among those whose links make parts first.
EARLY = 10
#: Fingerprints in a block of a dense bucket (radius over 2).
BLOCK = 1024
#: Groups of four bits, of 16, that the second signatures of candidates share: at a Jaccard similarity of 0.8 about 13, of unrelated texts one.
LEAST_ALIKE = 7
#: Bottom-sketch similarity under which a pair is clearly distant (a pair of 0.8 comes that low once in 10^12) and is not read again.
DISTANT = 0.5
#: Distinct shingles of all members of a candidate component that are held at once (a block; two blocks meet in a task).
SETS = 1 << 18
#: Fingerprint bits up to which candidates are looked for if the similarity alone decides.
CLOSE = 14
#: Classes of shingles that are counted to order them (a power of two), and rows that these counts are dealt in.
CLASSES, PARTS = 1 << 20, 16
#: Hashes summed at once and bytes of text cut into words at once, which bounds memory for very long texts.
_CHUNK, _PIECE = 1 << 16, 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _shingles(words: list[bytes], k: int) -> Iterator[bytes]:
    """All k-word shingles of ``k`` words or more, in order, repeats included."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-k])).tolist()
    return (joined[s:e] for s, e in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True))


def hashes(text: bytes, k: int) -> Iterator[np.ndarray]:
    """The hashes of all k-word shingles in order, repeats included; fewer words: of the whole sequence; none: nothing.

    The text is cut into pieces at white space, so only one piece's words are held at once.
    """
    digest, carry, at, short = xxhash.xxh64_intdigest, [], 0, True
    while at < len(text):
        cut = _SPACE.search(text, at + _PIECE)
        end = cut.start() if cut else len(text)
        words = carry + space_words(text[at:end])
        at = end
        if len(words) >= k:
            yield np.array([digest(s, 42) for s in _shingles(words, k)], dtype="<u8")
            short, words = False, words[len(words) - k + 1 :]
        carry = words
    if short and carry:
        yield np.array([digest(b" ".join(carry), 42)], dtype="<u8")


class Majority:
    """Counts, for each bit, the hashes that have it."""

    def __init__(self):
        self.ones, self.n = np.zeros(BITS, np.int64), 0

    def add(self, h: np.ndarray) -> np.ndarray:
        for at in range(0, len(h), _CHUNK):
            part = h[at : at + _CHUNK]
            self.ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        self.n += len(h)
        return h

    def bits(self) -> int:
        """The bits set in over half of the hashes, as a signed integer; zero for none."""
        return int(np.packbits(self.ones * 2 > self.n, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, k: int) -> int:
    """The fingerprint as a signed 64-bit integer."""
    votes = Majority()
    for h in hashes(text, k):
        votes.add(h)
    return votes.bits()


def _distinct(text: bytes, k: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *hashes(text, k)]))


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 masks, as signed 64-bit integers."""
    n = (1 << radius + 1) - 1
    vectors = [1 + i % n for i in range(BITS)]
    masks = [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, n + 1)]
    return [m - (1 << BITS) if m >> BITS - 1 else m for m in masks]


def _near(x, y, radius: int):
    return F.bit_count(x.bitwiseXOR(y)) <= radius


def _pairs(members: DataFrame, radius: int) -> DataFrame:
    """Links within small buckets."""

    def partners(all_):
        return F.flatten(F.transform(all_, lambda x: F.transform(F.filter(all_, lambda y: (y > x) & _near(x, y, radius)), lambda y: F.struct(x.alias("a"), y.alias("b")))))

    groups = members.groupBy("t", "key").agg(F.collect_list("fp").alias("all"))
    return groups.select(F.explode(partners(F.col("all"))).alias("p")).select("p.a", "p.b")


def _balls(members: DataFrame, masks: list[int]) -> DataFrame:
    """Links within dense buckets for radius 2, by shared values one bit or less away."""
    flips = [[1 << i if i < BITS - 1 else -(1 << i) for i in range(BITS) if not m >> i & 1] for m in masks]
    table = F.array(*[F.array(*map(F.lit, [0, *x])) for x in flips])
    dealt = members.select("t", "fp", F.explode(F.transform(F.get(table, F.col("t")), lambda x: x.bitwiseXOR(F.col("fp")))).alias("c"))
    meet = dealt.groupBy("t", "c").agg(F.min("fp").alias("lo"), F.count("*").alias("n")).where("n > 1").drop("n")
    return dealt.join(meet, ["t", "c"]).where("fp <> lo").select(F.col("fp").alias("a"), F.col("lo").alias("b"))


def _spanning(n: int, first: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (two arrays of positions) that connect whatever ``near`` connects among ``n`` members: at most one per member.

    near: from a member and an array of others to which of them it is linked to.
    """
    waiting, a, b = np.ones(n, bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in [first, *range(n)] if n else []:
        if not waiting[start]:
            continue
        waiting[start] = False
        todo = [start]
        while todo:
            at = todo.pop()
            rest = np.flatnonzero(waiting)
            if not len(rest):
                break
            found = rest[near(at, rest)]
            waiting[found] = False
            todo.extend(found.tolist())
            a.append(np.full(len(found), at))
            b.append(found)
    return np.concatenate(a), np.concatenate(b)


def _hub(x: np.ndarray) -> int:
    """The member nearest to the majority of each bit: variants of one text lie around it, so most links are to that text."""
    votes = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    centre = np.packbits(votes * 2 > len(x), bitorder="little").view("<u8")[0]
    return int(np.argmin(np.bitwise_count(x ^ centre)))


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether at least LEAST_ALIKE of the 16 groups of four bits are equal."""
    d = x ^ y
    d = d | d >> np.uint64(1)
    d = (d | d >> np.uint64(2)) & np.uint64(0x1111111111111111)
    return np.bitwise_count(d) <= 16 - LEAST_ALIKE


def _star_forest(x: np.ndarray, sig: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of candidate links that connect whatever candidates connect among ``x``: at most one per member.

    They start from the smallest node, so that the buckets of one group in many tables give much the same links.
    """
    return _spanning(len(x), int(np.argmin(node)) if len(x) else 0, lambda at, rest: (np.bitwise_count(x[rest] ^ x[at]) <= radius) & _alike(sig[rest], sig[at]))


def _between_parts(part: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of different parts that the links (positions) join, the smaller part first."""
    x, y = part[a], part[b]
    pairs = np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)[x != y]
    pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
    return pairs[:, 0], pairs[:, 1]


def _blocks(members: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between the parts of nodes of dense buckets (t, key, fp, sig, node, part, n) for any radius, by pairs of
    bounded blocks."""

    def run(table: pa.Table) -> pa.Table:
        fp, sig = (table.column(c).to_numpy().astype("<u8") for c in ("fp", "sig"))
        node, part = table.column("node").to_numpy(), table.column("part").to_numpy()
        a, b = _between_parts(part, *_star_forest(fp, sig, node, radius))
        release(table)
        return pa.table({"a": a, "b": b})

    n, keep = F.ceil(F.col("n") / BLOCK).cast("long"), ["t", "key", "fp", "sig", "node", "part"]
    own = members.select(*keep, n.alias("n"), F.pmod(F.xxhash64("node"), n).alias("i"))
    dealt = own.select(*keep, "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    dealt = dealt.select(*keep, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return dealt.groupBy("t", "key", "i", "j").applyInArrow(run, "a long, b long")


def links(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within the radius that connect all such pairs.

    ``fps`` has one row per distinct value in column fp.
    """
    masks = covering_masks(radius)
    dealt = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    buckets = dealt.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    buckets = durable(buckets.where("n > 1"), "buckets")
    twos = buckets.where("n = 2").where(_near(F.col("a"), F.col("b"), radius)).select("a", "b")
    members = durable(dealt.join(small_side(buckets.where("n > 2").select("t", "key", "n")), ["t", "key"]), "members")
    dense = members.where(F.col("n") > PAIRWISE)
    dense = _balls(dense, masks) if radius == 2 else _blocks(dense.withColumns({"sig": F.lit(0).cast("long"), "node": F.col("fp"), "part": F.col("fp")}), radius)
    return twos.unionAll(_pairs(members.where(F.col("n") <= PAIRWISE), radius)).unionAll(dense).distinct()


def named_components(nodes: DataFrame, links_: DataFrame) -> DataFrame:
    """(node, component_id) for every row of ``nodes`` (node, first; a row per node, a durable table).

    component_id is the smallest non-null ``first`` of all nodes reachable over ``links_`` (a, b); null if none has one.
    The nodes of a component, however many, meet its name by :func:`spread_join`.
    """
    roots = durable(connected_components(links_), "roots")
    linked = nodes.join(roots, "node").select("node", "root", "first")
    parts = durable(linked.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n")), "parts")
    named = spread_join(linked.select("node", "root"), parts.select("root", "least"), "root", parts.select("root", "n"), F.col("node"))
    named = named.select("node", F.col("least").alias("component_id"))
    alone = nodes.join(roots, "node", "left_anti").select("node", F.col("first").alias("component_id"))
    return named.unionAll(alone)


def simhash_components(docs: DataFrame, shingle: int = 5, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Texts that are null or have no words have fingerprint zero and are linked like any other. Rows with a
    null doc_id get a row and join groups, but never name one. Repeated rows give repeated rows, an
    empty table an empty one; other columns are ignored.
    """
    prints = durable(fingerprints(docs, shingle), "simhash")
    nodes = durable(prints.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "prints")
    named = named_components(nodes, links(nodes.select(F.col("node").alias("fp")), radius))
    rows = prints.withColumnRenamed("fp", "node")
    out = spread_join(rows, named, "node", nodes.select("node", "n"), F.col("doc_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


def block_masks(blocks: int, kept: int) -> list[int]:
    """A mask for each choice of ``kept`` of the blocks that the bits are divided into, as signed 64-bit integers.

    ``blocks - kept`` differing bits touch as many blocks at most, so a pair within that radius always agrees under some mask.
    """
    bounds = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, kept)]
    return [m - (1 << BITS) if m >> BITS - 1 else m for m in masks]


def _sweep(radius: int):
    """Compares neighbours in partitions sorted by table and key: (kind, a, b) rows.

    Only links between different parts are given. Those within buckets of up to PAIRWISE members have kind 0, or 2 where they
    stand for more (a star forest; a and b are parts then, not nodes); a larger bucket gives one row (1, table, key).
    """

    def emit(t: np.ndarray, key: np.ndarray, fp: np.ndarray, sig: np.ndarray, node: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])))) if len(t) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(t)))
        big = start[size > PAIRWISE]
        at = np.arange(len(t))
        left = np.repeat(start + size, size) - at - 1  # members after this one
        at = at[np.repeat(size <= PAIRWISE, size) & (left > 0)]
        a, b, shift = [at[:0]], [at[:0]], 1
        x, s = fp.astype("<u8"), sig.astype("<u8")
        while len(at):
            near = at[(np.bitwise_count(x[at] ^ x[at + shift]) <= radius) & _alike(s[at], s[at + shift])]
            a.append(near)
            b.append(near + shift)
            shift += 1
            at = at[left[at] >= shift]
        a, b = np.concatenate(a), np.concatenate(b)
        # buckets in which nearly all are near all others give a star forest instead of pairs
        bucket = np.searchsorted(start, a, side="right") - 1
        many = np.flatnonzero(np.bincount(bucket, minlength=len(start)) > MOST_PAIRS * size)
        stars = []
        for i in many:
            own = slice(start[i], start[i] + size[i])
            stars.append(_between_parts(part[own], *_star_forest(x[own], s[own], node[own], radius)))
        few = ~np.isin(bucket, many) & (part[a] != part[b])
        kind = np.repeat([0, 2, 1], [few.sum(), sum(len(p) for p, _ in stars), len(big)])
        a = np.concatenate([node[a[few]], *(p for p, _ in stars), t[big].astype(np.int64)])
        b = np.concatenate([node[b[few]], *(q for _, q in stars), key[big]])
        return pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int32), *[np.zeros(0, np.int64)] * 5]
        for batch in batches:
            cols = [np.concatenate((old, batch.column(i).to_numpy())) for i, old in enumerate(rest)]
            if not len(cols[0]):
                continue
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = int(np.argmax(last))
            yield emit(*(c[:cut] for c in cols))
            rest = [c[cut:][: PAIRWISE + 1].copy() for c in cols]  # one more than are compared shows that a bucket is dense
        yield emit(*rest)
        forget()

    return run


def _candidates(fps: DataFrame, radius: int, masks: list[int]) -> DataFrame:
    """(a, b, star): pairs of nodes whose fingerprints agree under a mask, differ in up to ``radius`` bits and have second
    signatures that are alike, but for those of one part. Buckets with many such pairs give a star forest (star) that
    connects the same parts; a and b are parts then.

    fps: node (default fp), fp, sig (default 0), part (default node), a row per node. One shuffle deals every node to its
    tables. Buckets of more than PAIRWISE members are named, not compared, and then dealt in blocks to many tasks.
    """
    masks = F.array(*map(F.lit, masks))
    node = F.col("node" if "node" in fps.columns else "fp")
    sig = F.col("sig") if "sig" in fps.columns else F.lit(0).cast("long")
    part = F.col("part") if "part" in fps.columns else node
    key = F.col("fp").bitwiseAND(F.get(masks, F.col("t")))
    tables = F.explode(F.sequence(F.lit(0), F.size(masks) - 1)).alias("t")
    dealt = fps.select(node.alias("node"), "fp", sig.alias("sig"), part.alias("part"), tables)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = ["t", key.alias("key"), "fp", "sig", "node", "part"]
    near = dealt.repartition(n, F.col("t"), key).select(*cols).sortWithinPartitions("t", "key")
    swept = durable(near.mapInArrow(_sweep(radius), "kind int, a long, b long"), "swept")
    named = swept.where("kind = 1").select(F.col("a").cast("int").alias("dt"), F.col("b").alias("dk")).distinct()
    dense = (F.col("t") == F.col("dt")) & (F.col("key") == F.col("dk"))
    members = dealt.select(*cols).join(small_side(durable(named, "dense")), dense).drop("dt", "dk")
    members = durable(members, "members")
    sizes = durable(members.groupBy("t", "key").agg(F.count("*").alias("n")), "sizes")
    stars = _blocks(members.join(small_side(sizes), ["t", "key"]), radius).withColumn("star", F.lit(True))
    found = swept.where("kind <> 1").select("a", "b", (F.col("kind") == 2).alias("star")).unionAll(stars)
    return found.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("star").alias("star"))


def near_links(fps: DataFrame, radius: int, blocks: int, kept: int) -> DataFrame:
    """(a, b): links of up to ``radius`` bits that agree under a block mask and connect all of those within ``blocks - kept`` bits."""
    return _candidates(fps, radius, block_masks(blocks, kept)).select("a", "b")


def _signature(u: np.ndarray) -> int:
    """Four bits of the smallest hash of each of 16 classes of hashes (``u``: distinct, ascending), as a signed integer."""
    first = u[:1024]
    classes, at = np.unique(first & np.uint64(15), return_index=True)
    code = (first[at] >> np.uint64(4) & np.uint64(15)) << (classes * np.uint64(4))
    return int(np.bitwise_or.reduce(code, initial=np.uint64(0)).view("<i8"))


def _node(u: np.ndarray) -> int:
    """A digest of a set of hashes, as a signed integer."""
    return int(np.uint64(xxhash.xxh64_intdigest(u.tobytes(), 7)).view("<i8"))


def _sketches(rows: DataFrame, shingle: int, size: int) -> DataFrame:
    """(doc_id, h, fp, node, n, sig, sketch, counts) of each (doc_id, h, text): fingerprint, digest and size of the set of
    shingles, second signature, and the smallest distinct shingle hashes, ``size`` at most.

    Rows with counts are no documents but a task's numbers of shingles by class, in PARTS rows (n: which)."""
    fields = {"doc_id": pa.int64(), "h": pa.int64(), "fp": pa.int64(), "node": pa.int64(), "n": pa.int64(), "sig": pa.int64(), "sketch": pa.list_(pa.int32()), "counts": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES, np.uint32)
        for b in slices(batches):
            out = []
            for text in b.column(2):
                votes = Majority()
                u = np.unique(np.concatenate([np.zeros(0, "<u8"), *map(votes.add, hashes(text.as_py(), shingle))]))
                least = np.unique((u[: 2 * size] >> np.uint64(33)).astype(np.int32))[:size]
                out.append((votes.bits(), _node(u), len(u), _signature(u), least, None))
                counts[u & np.uint64(CLASSES - 1)] += 1
            made = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(list(fields.values())[2:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], list(fields))
        for i, part in enumerate(counts.reshape(PARTS, -1)):
            if part.any():
                kind = "<u1" if part.max() < 1 << 8 else "<u2" if part.max() < 1 << 16 else "<u4"
                row = {"n": i, "counts": part.astype(kind).tobytes()}
                yield pa.RecordBatch.from_arrays([pa.array([row.get(c)], k) for c, k in fields.items()], list(fields))

    return rows.mapInArrow(run, "doc_id long, h long, fp long, node long, n long, sig long, sketch array<int>, counts binary")


def _levels(counts: DataFrame) -> np.ndarray:
    """How frequent the shingles of each class are (8 levels an octave), from the tasks' (n, counts)."""

    def run(table: pa.Table) -> pa.Table:
        each, total = CLASSES // PARTS, np.zeros(CLASSES // PARTS, np.int64)
        for c in table.column("counts"):
            raw = c.as_buffer()
            total += np.frombuffer(raw, f"<u{raw.size // each}")
        level = np.minimum(np.round(8 * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)
        return pa.table({"n": table.column("n")[:1], "level": pa.array([level.tobytes()], pa.binary())})

    out = np.zeros((PARTS, CLASSES // PARTS), np.uint8)
    for row in counts.groupBy("n").applyInArrow(run, "n long, level binary").collect():
        out[row.n] = np.frombuffer(row.level, np.uint8)
    return out.reshape(-1)


def _parity(u: np.ndarray) -> np.ndarray:
    """Whether an odd number of the hashes falls into each class, in 64-bit words: 512 classes, or as many as hashes if there are
    more. Each hash that only one of two sets has changes one of their bits."""
    classes = min(max(512, 1 << max(0, len(u) - 1).bit_length()), 1 << 16)
    odd = np.bincount((u & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _folded(parity: np.ndarray, words: int) -> np.ndarray:
    """The parities of fewer classes."""
    while len(parity) > words:
        parity = parity[: len(parity) // 2] ^ parity[len(parity) // 2 :]
    return parity


class Sizes:
    """Sizes and parities of sets, which show most pairs to lack the similarity; never one that has it."""

    def __init__(self, n: np.ndarray, parities: list[np.ndarray], similarity: float):
        self.n, self.full, self.similarity = n, parities, similarity
        self.flat = np.stack([_folded(p, 8) for p in parities]) if parities else np.zeros((0, 8), "<u8")

    def may(self, at: int, rest: np.ndarray) -> np.ndarray:
        """Which of the sets ``rest`` may have the similarity with the set ``at``."""
        own, other = self.n[at], self.n[rest]
        hit = np.minimum(other, own) >= self.similarity * np.maximum(other, own)
        room = (other + own) * (1 - self.similarity) / (1 + self.similarity) + 1e-6  # hashes that only one of the two may have
        some = np.flatnonzero(hit)
        hit[some] = np.bitwise_count(self.flat[rest[some]] ^ self.flat[at]).sum(axis=1, dtype=np.int64) <= room[some]
        if len(self.full[at]) > 8:
            for i in np.flatnonzero(hit):
                x, y = self.full[at], self.full[rest[i]]
                words = min(len(x), len(y))
                hit[i] = np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum(dtype=np.int64) <= room[i]
        return hit


def _prefixes(rows: DataFrame, shingle: int, similarity: float, levels: np.ndarray) -> DataFrame:
    """(doc_id, node, n, parity, prefix) of each (doc_id, text) with words: digest, size and parities of the set of shingles, and its
    first shingles in the order of their level and hash, of which two sets with the similarity share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [_distinct(t.as_py(), shingle) for t in b.column(1)]
            some = [i for i, u in enumerate(sets) if len(u)]
            sets, first = [sets[i] for i in some], []
            for u in sets:
                order = np.argsort(levels[u & np.uint64(CLASSES - 1)], kind="stable")
                first.append(u[order[: len(u) - int(np.ceil(similarity * len(u) - 1e-9 * len(u))) + 1]].view("<i8"))
            cols = [
                b.column(0).take(pa.array(some, pa.int64())),
                pa.array([_node(u) for u in sets], pa.int64()),
                pa.array([len(u) for u in sets], pa.int64()),
                pa.array([_parity(u).tobytes() for u in sets], pa.binary()),
                pa.array(first, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "node", "n", "parity", "prefix"])

    return rows.mapInArrow(run, "doc_id long, node long, n long, parity binary, prefix array<long>")


def _share(similarity: float):
    """Compares neighbours in partitions sorted by token: (kind, a, b) rows.

    Nodes of different parts that share a token and whose sizes allow the similarity have kind 0; a token of more than PAIRWISE
    nodes, not all of one part, gives one row (1, token, token).
    """

    def emit(token: np.ndarray, node: np.ndarray, part: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(token)))
        mixed = np.minimum.reduceat(part, start) != np.maximum.reduceat(part, start) if len(start) else np.zeros(0, bool)
        big = start[mixed & (size > PAIRWISE)]
        at = np.arange(len(token))
        left = np.repeat(start + size, size) - at - 1  # members after this one
        at, pairs, shift = at[np.repeat(mixed & (size <= PAIRWISE), size) & (left > 0)], [np.zeros((0, 2), np.int64)], 1
        while len(at):
            x, y = at, at + shift
            near = (part[x] != part[y]) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]))
            x, y = node[x[near]], node[y[near]]
            pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            shift += 1
            at = at[left[at] >= shift]
        pairs = np.concatenate(pairs)
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
        kind = np.repeat([0, 1], [len(pairs), len(big)])
        a, b = (np.concatenate([pairs[:, i], token[big]]) for i in (0, 1))
        return pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            cols = [np.concatenate((old, batch.column(i).to_numpy())) for i, old in enumerate(rest)]
            if not len(cols[0]):
                continue
            cut = int(np.argmax(cols[0] == cols[0][-1]))
            yield emit(*(c[:cut] for c in cols))
            rest = [c[cut:] for c in cols]
            # one more than are compared shows that a token is dense, one of another part that it is mixed
            few = np.arange(min(len(rest[0]), PAIRWISE + 1))
            few = np.unique(np.append(few, np.argmax(rest[2] != rest[2][0])))
            rest = [c[few] for c in rest]
        yield emit(*rest)
        forget()

    return run


def _sharing(parted: DataFrame, rows: DataFrame, shingle: int, similarity: float, levels: np.ndarray) -> DataFrame:
    """(a, b): nodes, or parts, that connect the parts of all nodes with the similarity.

    parted: first (a doc_id with that text), node, part. One shuffle deals the nodes' first shingles; tokens of many nodes in
    several parts are named, not compared, and then dealt in pairs of blocks to many tasks.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n = np.stack([b.column(i).to_numpy() for i in (2, 4)], axis=1).reshape(-1)
            held = [np.frombuffer(p.as_buffer(), "<u8") for x, y in zip(b.column(3), b.column(5), strict=True) for p in (x, y)]
            sets = Sizes(n, held, similarity)
            hit = [bool(sets.may(2 * i, np.array([2 * i + 1]))[0]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    def run(table: pa.Table) -> pa.Table:
        part, n = (table.column(c).to_numpy() for c in ("part", "n"))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        parts, own, size = np.unique(part, return_inverse=True, return_counts=True)
        if len(parts) > 1:
            held = [np.frombuffer(p.as_buffer(), "<u8") for p in table.column("parity")]
            sets = Sizes(n, held, similarity)
            for i in np.flatnonzero(own != np.argmax(size)):  # of two parts one at least is not the largest
                rest = np.flatnonzero(own != own[i])
                found = np.unique(part[rest[sets.may(i, rest)]])
                a.append(np.full(len(found), part[i]))
                b.append(found)
        release(table)
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    made = _prefixes(rows.where("doc_id IS NOT NULL").select("doc_id", "text"), shingle, similarity, levels)
    made = made.withColumnRenamed("doc_id", "first").join(parted.select("first", "node", "part"), ["first", "node"])
    made = durable(made.select("node", "part", "n", "parity", "prefix"), "prefixes")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = made.select(F.explode("prefix").alias("token"), "node", "part", "n").repartition(parts, "token").sortWithinPartitions("token")
    shared = durable(dealt.mapInArrow(_share(similarity), "kind int, a long, b long"), "shared")

    few = durable(shared.where("kind = 0").select("a", "b").distinct(), "pairs")
    ends = durable(few.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    one = made.join(small_side(ends), "node").groupBy("node").agg(F.min("n").alias("n"), F.min("parity").alias("parity"))
    one = durable(one, "parities")
    both = few.join(one.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("parity").alias("x")), "a")
    both = both.join(one.select(F.col("node").alias("b"), "n", F.col("parity").alias("y")), "b").select("a", "b", "m", "x", "n", "y")
    near = both.mapInArrow(pairs, "a long, b long")

    dense = small_side(durable(shared.where("kind = 1").select(F.col("a").alias("token")).distinct(), "dense"))
    members = made.select(F.explode("prefix").alias("token"), "node", "part", "n", "parity").join(dense, "token")
    members = durable(members, "members")
    sizes = durable(members.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("k")), "sizes")
    own = members.join(small_side(sizes), "token").withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")))
    own = own.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    own = own.select("token", "part", "n", "parity", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return near.unionAll(own.groupBy("token", "i", "j").applyInArrow(run, "a long, b long"))


def similar(x, y, size: int):
    """Jaccard similarity by bottom sketches: of the ``size`` smallest hashes of both, the part that both have. Exact for small sets."""
    both = F.slice(F.array_sort(F.array_union(x, y)), 1, size)
    return F.size(F.array_intersect(both, F.array_intersect(x, y))) / F.greatest(F.size(both), F.lit(1))


def _verified(rows: DataFrame, members: DataFrame, shingle: int, similarity: float, radius: int) -> DataFrame:
    """(a, b): nodes of one component that are within ``radius`` bits (64: any) and whose sets of shingles have the Jaccard similarity.

    members: first (a doc_id with that text), node, fp, root, k (blocks of the component). The links of a component, or of each
    pair of its blocks, connect all that such pairs connect. Only the texts of members are read again.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [_distinct(t.as_py(), shingle) for t in b.column(4)]
            same = pa.array([_node(u) == n for u, n in zip(found, b.column(0).to_pylist(), strict=True)], pa.bool_())
            cols = [*(b.column(i) for i in range(4)), pa.array([u.tobytes() for u in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["node", "fp", "root", "k", "shingles"]).filter(same)

    def run(table: pa.Table) -> pa.Table:
        node, at = np.unique(table.column("node").to_numpy(), return_index=True)
        x = table.column("fp").to_numpy().astype("<u8")[at]
        held = table.column("shingles")
        held = [np.frombuffer(held[i].as_buffer(), "<u8") for i in at.tolist()]
        n = np.array([len(u) for u in held])
        sizes = Sizes(n, [_parity(u) for u in held], similarity)

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            hit = np.bitwise_count(x[rest] ^ x[i]) <= radius
            hit[hit] = sizes.may(i, rest[hit])
            some = rest[hit]
            if len(some):
                every = np.concatenate([held[j] for j in some])
                both = held[i][np.minimum(np.searchsorted(held[i], every), n[i] - 1)] == every
                both = np.add.reduceat(both, np.concatenate(([0], np.cumsum(n[some])[:-1])), dtype=np.int64)
                hit[hit] = both >= similarity * (n[some] + n[i] - both)
            return hit

        a, b = _spanning(len(x), _hub(x), near)
        release(table)
        return pa.table({"a": node[a], "b": node[b]})

    text = rows.select(F.col("doc_id").alias("first"), "text").join(small_side(members), "first").select("node", "fp", "root", "k", "text")
    own = text.mapInArrow(sets, "node long, fp long, root long, k long, shingles binary").withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")))
    dealt = own.select("root", "node", "fp", "shingles", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j"))
    dealt = dealt.select("root", "node", "fp", "shingles", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return dealt.groupBy("root", "i", "j").applyInArrow(run, "a long, b long")


def _likely_links(prints: DataFrame, nodes: DataFrame, similarity: float, radius: int, masks: list[int], sketch: int) -> DataFrame:
    """(a, b): candidates of nodes or parts, without pairs that sketches show to be clearly distant."""
    found = durable(_candidates(nodes, radius, masks), "links")
    pairs = found.where("NOT star")
    ends = durable(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    one = prints.join(small_side(ends), "node").groupBy("node").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    one = durable(one, "sketches")
    both = pairs.join(one.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("x")), "a")
    both = both.join(one.select(F.col("node").alias("b"), "n", F.col("sketch").alias("y")), "b")
    like_sizes = F.least("m", "n") >= F.lit(similarity) * F.greatest("m", "n")
    near = both.where(like_sizes & (similar(F.col("x"), F.col("y"), sketch) >= min(DISTANT, similarity)))
    return near.select("a", "b").unionAll(found.where("star").select("a", "b"))


def _near_links(
    prints: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int, similarity: float, radius: int | None, masks: list[int], sketch: int, levels: np.ndarray
) -> DataFrame:
    """(a, b): verified links between nodes, which connect all that pairs with the similarity (and within the radius) connect.

    The first tables' links make parts of nodes; of the others only links between different parts are needed, so a large
    group does not give its links once a table. What fingerprints leave in different parts is searched by shared shingles.
    """
    most, radius = (BITS, CLOSE) if radius is None else (radius, radius)
    rest = [m for i, m in enumerate(masks) if i % EARLY]
    early = _likely_links(prints, nodes.select("node", "fp", "sig"), similarity, radius, masks[::EARLY], sketch)
    roots = durable(connected_components(early), "early")
    parted = nodes.join(roots.withColumnRenamed("root", "part"), "node", "left")
    parted = durable(parted.select("node", "fp", "sig", F.coalesce("part", "node").alias("part")), "parted")
    late = _likely_links(prints, parted, similarity, radius, rest, sketch)
    near = durable(connected_components(late.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "near")
    parted = nodes.join(near.withColumnRenamed("root", "part"), "node", "left")
    parted = durable(parted.select("first", "node", F.coalesce("part", "node").alias("part")), "parted")
    shared = _sharing(parted, rows, shingle, similarity, levels)
    parts = connected_components(shared.unionAll(near.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    members = durable(nodes.join(durable(parts, "parts"), "node").select("first", "node", "fp", "n", "root"), "candidates")
    many = durable(members.groupBy("root").agg(F.ceil(F.sum("n") / SETS).cast("long").alias("k"), F.count("*").alias("m")), "components")
    members = spread_join(members.drop("n"), many.select("root", "k"), "root", many.select("root", F.col("m").alias("n")), F.col("node"))
    return _verified(rows, durable(members.select("first", "node", "fp", "root", "k"), "members"), shingle, similarity, most)


def drop_near_duplicates(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int | None = 14, blocks: int = 12, kept: int = 3, sketch: int = 128
) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest doc_id.

    Two documents are linked if the Jaccard similarity of their distinct shingles is ``similarity`` (over 0) or more and, unless
    ``radius`` is None, their fingerprints differ in ``radius`` bits at most. No such link is left out.

    Fingerprints that agree under one of the block masks (certain within ``blocks - kept`` bits, likely beyond) and differ
    in ``radius`` bits (None: CLOSE) at most are candidates: a similarity of 0.8 moves about ten bits of 64. Bottom sketches of
    ``sketch`` hashes discard pairs that are clearly distant. What that leaves in different parts is searched by the
    shingles that similar sets must share, exactly. Whatever candidates connect is then compared by all distinct shingles. Equal sets of shingles are one document. Of rows that repeat both doc_id and text one
    stays. Documents without words and those with a null doc_id are kept. Null texts have no words. An empty table gives an
    empty one. All columns are kept, whatever their names (doc_id and text must be there).
    """
    key, body = docs.columns.index("doc_id"), docs.columns.index("text")
    plain, names = positional(docs)
    doc_id, text = F.col(names[key]).cast("long"), F.col(names[body])
    rows = plain.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("h"), utf8(text).alias("text"))
    prints = durable(_sketches(rows, shingle, sketch), "simhash")
    levels = _levels(prints.where("counts IS NOT NULL").select("n", "counts"))
    prints = prints.where("counts IS NULL").drop("counts")
    with_words = prints.where("doc_id IS NOT NULL AND n > 0")
    # equal sets of shingles have equal fingerprints but for repeats; the least of each stands for the set
    least = [F.min(c).alias(c) for c in ("fp", "sig", "n")]
    nodes = durable(with_words.groupBy("node").agg(F.min("doc_id").alias("first"), *least, F.count("*").alias("rows")), "nodes")
    links_ = durable(_near_links(prints, nodes, rows, shingle, similarity, radius, block_masks(blocks, kept), sketch, levels), "links")
    named = named_components(nodes.select("node", "first"), links_)
    every = spread_join(with_words.select("node", "doc_id", "h"), named, "node", nodes.select("node", F.col("rows").alias("n")), F.col("doc_id"))
    copies = durable(every.where("doc_id <> component_id").select(F.col("doc_id").alias("copy"), F.col("h").alias("copy_h")).distinct(), "copies")
    same = (doc_id == F.col("copy")) & (F.xxhash64(text) == F.col("copy_h"))
    left = plain.join(small_side(copies), same, "left_anti")
    twice = prints.where("doc_id IS NOT NULL").groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1")
    twice = durable(twice.select(F.col("doc_id").alias("copy"), F.col("h").alias("copy_h")), "repeats")
    if not twice.isEmpty():
        again = left.join(small_side(twice), same, "left_semi").dropDuplicates([names[key], names[body]])
        left = left.join(small_side(twice), same, "left_anti").unionByName(again)
    return left.toDF(*docs.columns)
