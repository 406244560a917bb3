"""Nearest neighbours by cosine: inverted lists, rotated vectors in column blocks, early abandoning.

Unit vectors are turned by a fixed random rotation, so that any first d of D coordinates estimate a squared
distance as D / d times their part of it. Vectors lie in blocks of their list, dimension by
dimension. A search adds up the distances of a block from one group of dimensions to the next, and after
each abandons the candidates whose estimate exceeds the query's bound by more than the test allows:
``part * D / d > bound * (1 + epsilon / sqrt(d)) ** 2``. The bound starts as the distance of the k-th nearest vector of the
fitted sample within the lists that the query probes, and tightens as nearer ones are found. Survivors get
their exact cosine from the original vectors in double precision.

Lists lie in partitions, by blocks. A query is sent once to each partition with a block of a list that it probes, with
the numbers of those lists. How many lists that are is measured on the fitted sample against brute force, for a wanted
recall: few where vectors lie in clusters, many where they have no structure.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.text import arrow_columns, forget
from arborlake.runtime import durable

#: Vectors that the lists are fitted to, about, and floats of them.
SAMPLE, SAMPLE_FLOATS = 10_000, 2_000_000
#: Vectors in a block and queries in a batch.
BLOCK, BATCH = 512, 256
#: Batches whose tightened bounds a task remembers.
REMEMBERED = 512


def _takes_part(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``a`` with that of ``b``; every score comes from here."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return np.clip(dot(a, b) / np.sqrt(dot(a, a) * dot(b, b)), -1.0, 1.0)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _nearest_list(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(_squares(vectors[i : i + 4096], centres).argmin(1) for i in range(0, len(vectors), 4096))])


def _fit(sample: np.ndarray, lists: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k-means centres of the sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        own = _nearest_list(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=lists)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, seed: int, queries: int = 256) -> int:
    """Lists to probe so that the wanted part of the k nearest within the sample is found, by brute force."""
    some = np.random.default_rng(seed).choice(len(sample), min(queries, len(sample)), replace=False)
    far = _squares(sample[some], sample)
    far[np.arange(len(some)), some] = np.inf
    near = np.argsort(far, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    own = _nearest_list(sample, centres)
    place = _squares(sample[some], centres).argsort(axis=1).argsort(axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1), axis=None)
    return int(needed[min(len(needed) - 1, int(np.ceil(len(needed) * recall)))]) + 1 if len(needed) else 1


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def scan_block(q: np.ndarray, bound: np.ndarray, columns: np.ndarray, epsilon: float, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, squared distance) of the pairs that no test abandoned. q: m x D, columns: D x n, bound: squares."""
    dims = len(columns)
    d = min(step, dims)
    room = lambda d: bound * (1 + (epsilon / np.sqrt(d) if d < dims else 0)) ** 2 * d / dims + 1e-5
    part = _squares(q[:, :d], columns[:d].T)
    a, b = np.nonzero(part <= room(d)[:, None])
    part = part[a, b]
    while d < dims and len(a):
        to = min(d + step, dims)
        part = part + ((q[a, d:to] - columns[d:to, b].T) ** 2).sum(1)
        d = to
        stay = part <= room(d)[a]
        a, b, part = a[stay], b[stay], part[stay]
    return a, b, part


@dataclass(frozen=True)
class Index:
    """What is fitted: the rotation, the lists' centres, the partitions of each list's blocks, and the sample in its lists."""

    turn: np.ndarray
    centres: np.ndarray
    salts: np.ndarray
    entries: np.ndarray
    partitions: int
    sample: np.ndarray
    sample_list: np.ndarray

    def place(self, of: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The partition of a block."""
        return (of * 7919 + salt) % self.partitions

    def probed(self, units: np.ndarray, probes: int, least: int) -> np.ndarray:
        """queries x lists: whether a list is among the ``probes`` nearest, or needed for ``least`` entries in all."""
        order = np.argsort(_squares(units, self.centres), axis=1, kind="stable")
        before = np.cumsum(self.entries[order], axis=1) - self.entries[order]
        chosen = (np.arange(order.shape[1])[None, :] < probes) | (before < least)
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, chosen, axis=1)
        return out


def nearest(
    vectors: DataFrame, every: int = 50, k: int = 5, lists: int | None = None, recall: float = 0.97, epsilon: float = 2.5, seed: int = 5, sample_rows: int = SAMPLE
) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose vec_id is divisible by ``every`` its k nearest found.

    vectors: vec_id, embedding; further columns are ignored. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor those with a null vec_id or of another dimension than
    most have (of equally frequent ones the smallest). The query's own vec_id is no candidate; rows that
    repeat vec_id and vector count once. Score is the cosine of the original vectors in double precision,
    ties go to the smaller vec_id; fewer candidates than k give fewer rows, none give none.

    The lists, the number of probes for ``recall`` and the starting bounds are fitted to about ``sample_rows`` vectors (drawn by
    hash, about that many however large the input, and no more than SAMPLE_FLOATS floats of them), but every vector is indexed, and
    results come from the probed lists alone. Should fewer than k of those survive the tests, the query is asked again
    in all lists without tests. Equal vectors share one entry with their k + 1 smallest vec_ids, which are all that can be
    among k nearest, so a very common vector costs no more than another. lists defaults to 2 * sqrt(vectors), a quarter of the
    sample at most.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    rows = vectors.select("vec_id", F.transform(v, lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    rows = rows.where(_takes_part(F.col("v")) & F.col("vec_id").isNotNull())
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = size.d
    rows = rows.where(F.size("v") == dims)
    at = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.distinct().withColumn("at", at).where(F.col("at") <= k + 1)
    entries = durable(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    n = entries.count()

    limit = max(2, min(sample_rows, SAMPLE_FLOATS // dims))
    part = int(min(1.0, limit / n) * (1 << 30))
    drawn = entries.select("v", F.pmod(F.xxhash64("v"), F.lit(1 << 30)).alias("h")).where(F.col("h") < max(part, 1) if n > limit else F.lit(True))
    drawn = drawn.orderBy("h", "v").limit(2 * limit).select("v").toArrow().column("v").combine_chunks()
    if not len(drawn):  # so few vectors and so small a part that none was drawn
        drawn = entries.orderBy(F.xxhash64("v"), "v").limit(limit).select("v").toArrow().column("v").combine_chunks()
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))[0]
    sample = _unit(_matrix(drawn, dims)) @ turn
    lists = max(1, min(lists or int(2 * n**0.5), len(sample) // 4))
    centres = _fit(sample, lists, seed)
    probes = min(lists, _probes(sample, centres, k, recall, seed))
    sample_list = _nearest_list(sample, centres)
    step = max(8, -(-dims // 8))
    shared = spark.sparkContext.broadcast((turn, centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        turn, centres = shared.value
        for b in batches:
            own = _nearest_list(_unit(_matrix(b.column(0), dims)) @ turn, centres)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32())], ["v", "ids", "list"])

    placed = durable(entries.mapInArrow(assign, "v array<double>, ids array<long>, list int"), "placed")
    counted = placed.groupBy("list").count().toArrow()  # a row per list
    of_list = np.zeros(lists, np.int64)
    of_list[counted.column("list").to_numpy()] = counted.column("count").to_numpy()
    # tasks = list partitions x copies of the index; that many copies make the index and the queries sent about equally large
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = max(1, round((tasks / every) ** 0.5))
    index = Index(turn, centres, np.maximum(1, -(-of_list // BLOCK)), of_list, -(-tasks // copies), sample, sample_list)
    fitted = spark.sparkContext.broadcast(index)

    salts = F.array(*map(F.lit, index.salts.tolist()))
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("v"), F.get(salts, F.col("list"))))
    block_schema = "p int, list int, columns binary, vectors binary, lengths array<int>, ids array<long>"

    def block(table: pa.Table) -> pa.Table:
        of, salt = table.column("list")[0].as_py(), table.column("salt")[0].as_py()
        m = _matrix(table.column("v").combine_chunks(), dims)
        columns = np.ascontiguousarray((_unit(m) @ fitted.value.turn).astype(np.float32).T)
        ids = table.column("ids").combine_chunks()
        p = int(fitted.value.place(np.array(of), np.array(salt)))
        out = (p, of, columns.tobytes(), m.tobytes(), np.diff(ids.offsets.to_numpy()).tolist(), ids.flatten().to_pylist())
        return pa.table(arrow_columns(block_schema, [out]))

    blocks = durable(salted.groupBy("list", "salt").applyInArrow(block, block_schema), "blocks")
    ask_schema = "p int, g int, batch long, ids array<long>, bounds array<double>, vectors binary, lists array<int>, ends array<int>"

    def ask(probes: int, least: int, bounded: bool):
        """Each batch of queries to each partition with a block of a list that one of them probes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            ix, number = fitted.value, TaskContext.get().partitionId() << 32
            of = np.repeat(np.arange(lists), ix.salts)
            where = np.zeros((lists, ix.partitions), bool)
            where[of, ix.place(of, np.concatenate([np.arange(s) for s in ix.salts]))] = True
            near_to = where.astype(np.float32)
            for b in batches:
                for start in range(0, b.num_rows, BATCH):
                    part = b.slice(start, BATCH)
                    ids, m = part.column(0).to_numpy(), _matrix(part.column(1), dims)
                    units = _unit(m) @ ix.turn
                    chosen = ix.probed(units, probes, least)
                    bound = np.full(len(ids), np.inf)
                    if bounded and len(ix.sample) > k + 1:
                        # the query itself may be in the sample, so one more than k; only what lies in probed lists is a bound
                        far = np.where(chosen[:, ix.sample_list], _squares(units, ix.sample), np.inf)
                        bound = np.partition(far, k, axis=1)[:, k]
                    reached = chosen.astype(np.float32) @ near_to > 0
                    number, out = number + 1, []
                    for p in np.flatnonzero(reached.any(axis=0)).tolist():
                        own = np.flatnonzero(reached[:, p])
                        here = chosen[own] & where[:, p]
                        named = [np.flatnonzero(x) for x in here]
                        ends = np.cumsum([len(x) for x in named]).tolist()
                        lists_, flat = np.concatenate(named).tolist(), m[own].tobytes()
                        out.append((p, number % copies, number, ids[own].tolist(), bound[own].tolist(), flat, lists_, ends))
                    yield pa.RecordBatch.from_pydict(arrow_columns(ask_schema, out))

        return run

    found_schema = "query_id long, vec_id long, score double"

    def search(epsilon: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            turn = fitted.value.turn
            tight: OrderedDict[tuple, np.ndarray] = OrderedDict()
            for b in batches:
                out = []
                for r in range(b.num_rows):
                    row = {c: b.column(c)[r] for c in b.schema.names}
                    ends = np.asarray(row["ends"].values)
                    asks = np.searchsorted(ends, np.flatnonzero(np.asarray(row["asked"].values) == row["list"].as_py()), side="right")
                    if not len(asks):
                        continue
                    key = (row["p"].as_py(), row["batch"].as_py())
                    bounds = tight.pop(key, None)
                    if bounds is None:  # the k best squared distances of each query so far, in no order
                        first = np.asarray(row["bounds"].values)
                        bounds = np.repeat(first[:, None], k + 1, axis=1)
                        if len(tight) >= REMEMBERED:
                            tight.popitem(last=False)
                    tight[key] = bounds
                    out += _search(row, asks, bounds, turn)
                yield pa.RecordBatch.from_pydict(arrow_columns(found_schema, out))

        def _search(row: dict, asks: np.ndarray, best: np.ndarray, turn: np.ndarray) -> list[tuple[int, int, float]]:
            columns = np.frombuffer(row["columns"].as_buffer(), np.float32).reshape(dims, -1)
            m = np.frombuffer(row["vectors"].as_buffer(), np.float64).reshape(-1, dims)
            ends = np.concatenate(([0], np.cumsum(np.asarray(row["lengths"].values))))
            ids, mine = np.asarray(row["ids"].values), np.asarray(row["query_ids"].values)[asks]
            qs = np.frombuffer(row["queries"].as_buffer(), np.float64).reshape(-1, dims)[asks]
            a, c, far = scan_block(_unit(qs) @ turn, best[asks].max(axis=1), columns, epsilon, step)
            score, out = cosine(qs[a], m[c]), []
            order = np.lexsort((ids[ends[c]], -score, a))
            a, c, far, score = a[order], c[order], far[order], score[order]
            firsts = np.flatnonzero(np.diff(a, prepend=-1))
            for start, stop in zip(firsts, np.append(firsts[1:], len(a))[: len(firsts)], strict=True):
                i = int(a[start])
                stop = min(stop, start + k + 1)
                near = zip(score[start:stop].tolist(), c[start:stop].tolist(), strict=True)
                own = sorted((-s, x) for s, j in near for x in ids[ends[j] : ends[j + 1]].tolist() if x != mine[i])
                out += [(int(mine[i]), x, -s) for s, x in own[:k]]
                # k + 1 distances, one of which may be the query's own
                best[asks[i]] = np.sort(np.concatenate((best[asks[i]], far[start:stop])))[: k + 1]
            return out

        return run

    def asked(queries: DataFrame, probes: int, least: int, epsilon: float, bounded: bool) -> DataFrame:
        sent = queries.mapInArrow(ask(probes, least, bounded), ask_schema)
        sent = sent.select("p", "g", "batch", F.col("ids").alias("query_ids"), "bounds", F.col("vectors").alias("queries"), F.col("lists").alias("asked"), "ends")
        met = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).join(sent.hint("merge"), ["p", "g"])
        return met.mapInArrow(search(epsilon), found_schema)

    queries = durable(rows.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).distinct().repartition(tasks, "vec_id").select("vec_id", "v"), "queries")
    found = durable(asked(queries, probes, k + 1, epsilon, True), "found")
    # every query has k candidates, or all there are
    total = entries.select(F.explode("ids").alias("id")).distinct().limit(k + 1).count()
    enough = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= min(k, total - 1)).select(F.col("query_id").alias("done"))
    rest = durable(queries.join(enough, F.col("vec_id") == F.col("done"), "left_anti"), "rest")
    if total > 1 and not rest.isEmpty():
        found = found.unionAll(asked(rest, lists, k + 1, float("inf"), False))
    near = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
