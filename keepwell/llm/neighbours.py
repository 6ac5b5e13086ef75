"""Nearest neighbours by p-stable hashing with several probes a table.

A table's hash functions project a vector on Gaussian directions and cut each projection into
slots of equal width; the slots together are a cell.  A neighbour at a known distance falls,
on each function, into a slot near the query's with a probability that the normal law gives
(projections of a difference of length r are normal with deviation r).  A query visits cells
in the order of these probabilities, its own first, then perturbed ones, until they add up to
`FOUND` over all tables.  What the tables bring is merged, and nearness is measured on the
original vectors.

One table is worked on after the other: what one has written is removed before the next begins, so the disk
holds the vectors, one table's cells and its visits, not four of each.  Vectors travel in the width they came in.

The largest inner product is a nearest neighbour after one more coordinate: vectors, divided
by the greatest norm of their length, are lifted onto the unit sphere; queries get zero there.

What the index knows of the data is bounded: number of vectors and greatest norm of each vector
length, and `SAMPLE` vectors of least id hash, which tell how far neighbours are.  Every vector
is indexed, whatever the sample.  Cells hold some `CELL` vectors, so their number follows the
table's; members of a cell leave tasks as blocks of at most `BLOCK`, queries that visit it, too;
blocks of one cell are multiplied as matrices where they meet, and leave a task as one list of the nearest a query.
Only where a cell has more than `PAIRS` pairs of blocks, its pairs are copied and dealt out.
Queries that found fewer than `k` (neighbours far out) visit again until `SURE`.

Recall depends on how near neighbours are: the share of cells to visit is small where they are
much nearer than chance, and most of the table where vectors are random (the README has figures).
A cell of very many near copies is compared block by block, which is quadratic in such a cell.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part, and rows without an id; vectors of other lengths are no candidates; rows of one id are one
item, which counts by the row that is nearest, and no candidate of its own; ties go to the smaller
id; an empty table, or one without queries, gives an empty table; other columns are not read.
"""

from __future__ import annotations

import gc
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import discard, quoted, saved, text_batches, worker_state

#: Hash tables, and the slot's width in standard deviations of a projection.
TABLES, WIDTH = 4, 1.5
#: Vectors of a cell, about; vectors or queries of a block, at most.
CELL, BLOCK = 1024, 1024
#: Pairs of blocks of a cell that a task compares at most where it meets them.
PAIRS = 64
#: Share of neighbours that the visits of all tables should find, and of those whose queries found too few.
FOUND, SURE = 0.97, 0.999999
#: Vectors that tell how far neighbours are, and how many of them are asked.
SAMPLE, ASKED = 8192, 256
#: Tables with fewer vectors of a length are one cell.
LEAST = 64
SEED = 20_260_113


@dataclass(frozen=True)
class Index:
    """The tables of one vector length."""

    length: int
    vectors: int
    norm: float
    functions: int
    distance: float

    def directions(self, table: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([SEED, self.length, table])
        return rng.normal(size=(self.length + 1, self.functions)), rng.uniform(size=self.functions)

    def places(self, x: np.ndarray, query: bool, table: int) -> np.ndarray:
        """(rows, functions) of a table: projections in slots, with fractions."""
        unit, norms = units(x)
        if query:
            lifted = np.c_[unit, np.zeros(len(x))]
        else:
            share = np.minimum(norms / self.norm, 1.0)
            lifted = np.c_[unit * share[:, None], np.sqrt(1 - share * share)]
        # A unit vector's projection has deviation 1.
        a, b = self.directions(table)
        return lifted @ a / WIDTH + b


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 and the norms, for finite values of any size."""
    most = np.abs(x).max(axis=1, keepdims=True)
    scaled = x / most
    norms = np.linalg.norm(scaled, axis=1, keepdims=True)
    with np.errstate(over="ignore"):
        return scaled / norms, (norms * most)[:, 0]


def cell_keys(slots: np.ndarray, table: int, length: int) -> np.ndarray:
    """A 64-bit key of each row of slots; vectors whose keys meet by chance are compared in vain only."""
    key = np.full(len(slots), np.uint64(table * 0x9E3779B1 + length * 0x85EBCA77 + 1))
    for column in slots.T:
        key = (key ^ column.astype(np.int64).view(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def visited(place: np.ndarray, distance: float, wanted: float) -> Iterator[tuple[int, ...]]:
    """Cells in the order of the probability that they hold a neighbour at `distance`, until `wanted` is reached."""
    reach = max(1, math.ceil(6 * distance / WIDTH))
    choices = []
    for at in place.tolist():
        low = math.floor(at)
        edges = [0.5 * (1 + math.erf((low + d - at) * WIDTH / (distance * math.sqrt(2)))) for d in range(-reach, reach + 2)]
        choices.append(sorted(((b - a, low - reach + i) for i, (a, b) in enumerate(zip(edges, edges[1:]))), reverse=True))
    start = (0,) * len(choices)
    queue, found = [(-math.prod(c[0][0] for c in choices), start)], 0.0
    while queue and found < wanted:
        p, at = heapq.heappop(queue)
        if p == 0:
            return
        yield tuple(choices[j][i][1] for j, i in enumerate(at))
        found -= p
        # Each combination has one parent: the one with a step less in its last function that isn't at its best.
        last = max((j for j, i in enumerate(at) if i), default=0)
        for j in range(last, len(at)):
            if at[j] + 1 < len(choices[j]):
                heapq.heappush(queue, (p / choices[j][at[j]][0] * choices[j][at[j] + 1][0], at[:j] + (at[j] + 1,) + at[j + 1:]))


def width_of(df: DataFrame, vector: str) -> str:
    """Of a packed component: floats stay floats, which doubles hold exactly; all else is doubles."""
    return "<f4" if dict(df.dtypes)[vector] == "array<float>" else "<f8"


def usable(df: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """(id, length, vec) of vectors that take part, as little-endian numbers of a kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("neighbours")
        for batch in batches:
            lists = batch.column("v")
            offsets, values = lists.offsets.to_numpy(), lists.values
            null = values.is_null().to_numpy(zero_copy_only=False)
            flat = np.ascontiguousarray(values.fill_null(np.nan).to_numpy(zero_copy_only=False), kind) if len(values) else np.zeros(0)
            rows, vecs, lengths = [], [], []
            for i, there in enumerate(lists.is_valid().to_pylist()):
                a, b = offsets[i], offsets[i + 1]
                own = flat[a:b]
                if there and a < b and not null[a:b].any() and np.isfinite(own).all() and own.any():
                    rows.append(i)
                    vecs.append((own + own.dtype.type(0)).tobytes())
                    lengths.append(b - a)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int32()), pa.array(vecs, pa.binary())], ["id", "length", "vec"])

    rows = df.select(F.col(quoted(key)).cast("long").alias("id"), F.col(quoted(vector)).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    return rows.where("id IS NOT NULL AND v IS NOT NULL").mapInArrow(run, "id long, length int, vec binary")


def _stack(vecs: list[bytes], kind: str) -> np.ndarray:
    """Packed vectors as rows of doubles."""
    return np.frombuffer(b"".join(vecs), kind).astype("<f8").reshape(len(vecs), -1)


def _norms(rows: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, vecs, out = batch.column("length").to_numpy(), batch.column("vec").to_pylist(), np.zeros(batch.num_rows)
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                out[at] = units(_stack([vecs[i] for i in at], kind))[1]
            yield pa.RecordBatch.from_arrays([batch.column("length"), pa.array(out)], ["length", "norm"])

    return rows.select("length", "vec").mapInArrow(run, "length int, norm double")


def fitted(rows: DataFrame, k: int, kind: str) -> dict[int, Index]:
    """An index for every vector length, of which a table has a handful."""
    sizes = {r.length: (r.n, r.norm) for r in _norms(rows, kind).groupBy("length").agg(
        F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm")).collect()}
    total = sum(n for n, _ in sizes.values())
    # Of the rows in hash order some SAMPLE, the whole table if it is as small as that.
    share = min(1.0, SAMPLE / max(1, total))
    picked = rows.where(F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE).collect()
    out = {}
    for length, (n, norm) in sizes.items():
        own = [r.vec for r in picked if r.length == length]
        functions = 0 if n <= LEAST else max(1, round(math.log2(n / CELL) / _bits()))
        out[length] = Index(length, n, norm, functions, _distance(own, n, norm, k, kind))
    return out


def _bits() -> float:
    """Bits that one function tells: entropy of a standard normal variable in slots of the width, about."""
    edges = [0.5 * (1 + math.erf((i + 0.5) * WIDTH / math.sqrt(2))) for i in range(-9, 9)]
    return -sum(p * math.log2(p) for p in (b - a for a, b in zip(edges, edges[1:])) if p > 0)


def _distance(sample: list[bytes], vectors: int, norm: float, k: int, kind: str) -> float:
    """Distance of the lifted vectors within which most queries have k neighbours, as the sample has it."""
    if len(sample) < 2:
        return math.sqrt(2)
    x = _stack(sample, kind)
    unit, norms = units(x)
    asked = np.arange(min(ASKED, len(x)))
    near = (unit[asked] @ unit.T) * (norms / norm)
    near[asked, asked] = -np.inf
    rank = min(len(x) - 1, max(1, round(k * len(x) / vectors)))
    kth = -np.partition(-near, rank - 1, axis=1)[:, rank - 1]
    return float(math.sqrt(max(1e-6, 2 - 2 * np.quantile(kth, 0.25))))


def _rows_by_length(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    lengths, vecs = batch.column("length").to_numpy(), batch.column("vec").to_pylist()
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        for first in range(0, len(at), 4096):
            part = at[first:first + 4096]
            yield n, part, _stack([vecs[i] for i in part], kind)


def members(rows: DataFrame, index: dict[int, Index], table: int, kind: str) -> DataFrame:
    """(cell, id, vec) of each vector in a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, part, x in _rows_by_length(batch, kind):
                own, place = pa.array(part), index[n].places(x, False, table)
                yield pa.RecordBatch.from_arrays([pa.array(cell_keys(np.floor(place), table, n)), batch.column("id").take(own), batch.column("vec").take(own)],
                                                 ["cell", "id", "vec"])

    return rows.mapInArrow(run, "cell long, id long, vec binary")


def visits(queries: DataFrame, index: dict[int, Index], table: int, wanted: float, kind: str) -> DataFrame:
    """(cell, id, vec) of each cell of a table that a query visits."""
    each = 1 - (1 - wanted) ** (1 / TABLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, part, x in _rows_by_length(batch, kind):
                cells = [list(visited(p, index[n].distance, each)) for p in index[n].places(x, True, table)]
                which = np.repeat(part, [len(c) for c in cells])
                slots = np.array([c for own in cells for c in own], np.float64).reshape(len(which), index[n].functions)
                for first in range(0, len(which), 4096):
                    own = pa.array(which[first:first + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(cell_keys(slots[first:first + 4096], table, n)), batch.column("id").take(own), batch.column("vec").take(own)],
                                                     ["cell", "id", "vec"])

    return queries.mapInArrow(run, "cell long, id long, vec binary")


def blocks(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(cell, n, ids, vecs): rows of a cell in blocks of at most BLOCK; cells of many blocks are dealt out by the id's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of cell and id: those of one id follow each other, and go to blocks of their own."""
        now, ids, vecs = None, [], []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"cell": pa.array([now], pa.int64()), "ids": pa.array([np.array(ids, "<i8").tobytes()]), "vecs": pa.array([b"".join(vecs)])})

        for batch in batches:
            for cell, i, v in zip(*[batch.column(c).to_pylist() for c in ("cell", "id", "vec")]):
                if now is not None and (cell != now or len(ids) == BLOCK or ids[-1] == i):
                    yield packed()
                    ids, vecs = [], []
                now = cell
                ids.append(i)
                vecs.append(v)
        if now is not None:
            yield packed()

    dealt = rows.join(parts, "cell", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))))
    ordered = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "id")
    return ordered.select("cell", "id", "vec").mapInArrow(run, "cell long, ids binary, vecs binary")


def many_blocks(rows: DataFrame) -> DataFrame:
    """(cell, parts) of the cells with more than BLOCK rows."""
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return sizes.where(F.col("n") > BLOCK).select("cell", F.ceil(F.col("n") / BLOCK).alias("parts"))


def nearest(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def compared(pairs: DataFrame, k: int, kind: str) -> DataFrame:
    """(query_id, found) of blocks that meet: a list of the k nearest of a query for each task or so."""

    size = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def send() -> Iterator[pa.RecordBatch]:
            some = list(held.items())
            for first in range(0, len(some), 2000):
                part = some[first:first + 2000]
                sizes = np.cumsum([0, *[len(a) for _, (a, _) in part]])
                found = pa.StructArray.from_arrays([pa.array(np.concatenate([s for _, (_, s) in part])), pa.array(np.concatenate([a for _, (a, _) in part]))], ["score", "id"])
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in part], pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), found)], ["query_id", "found"])
            held.clear()

        for batch in batches:
            for a, x, b, y in zip(*[batch.column(c).to_pylist() for c in ("ids", "vecs", "q_ids", "q_vecs")]):
                own, asked = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")
                length = len(x) // size // len(own)
                if len(y) // size // len(asked) != length:
                    continue
                x, y = (np.frombuffer(v, kind).astype("<f8").reshape(-1, length) for v in (x, y))
                with np.errstate(all="ignore"):
                    rough = y @ x.T
                    # Products of a matrix differ from row to row in their last bits: what may be among the k goes on.
                    slack = 1e-12 * np.abs(y).max() * np.abs(x).max() * length
                    rough[np.isnan(rough)] = -np.inf
                    least = -np.partition(-rough, k, axis=1)[:, k] - slack if len(own) > k + 1 and slack < np.inf else np.full(len(asked), -np.inf)
                for i, q in enumerate(asked.tolist()):
                    bound = max(least[i], held[q][1][-1] - slack) if q in held and len(held[q][0]) == k and slack < np.inf else least[i]
                    some = np.flatnonzero(rough[i] >= bound)
                    some = some[own[some] != q]
                    with np.errstate(all="ignore"):
                        exact = (x[some] * y[i]).sum(axis=1)
                    ids = own[some]
                    if q in held:
                        ids, exact = np.r_[held[q][0], ids], np.r_[held[q][1], exact]
                        order = np.lexsort((-exact, ids))
                        ids, exact = ids[order], exact[order]
                        first = np.r_[True, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)
                        ids, exact = ids[first], exact[first]
                    best = nearest(ids, exact, k)
                    held[q] = (ids[best], exact[best])
            if len(held) * k > 1 << 20:
                yield from send()
        yield from send()

    return pairs.select("ids", "vecs", "q_ids", "q_vecs").mapInArrow(run, "query_id long, found array<struct<score:double,id:long>>")


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, best): at most k of a query's candidates, each once, best first."""
    lists = found.groupBy("query_id").agg(F.flatten(F.collect_list("found")).alias("all"))
    order = F.array_sort(F.transform(F.array_distinct("all"), lambda x: F.struct((-x["score"]).alias("down"), x["id"].alias("id"))))
    # An id of several rows may come with several scores; its best comes first.
    once = F.filter("sorted", lambda x, i: (i == 0) | ~F.array_contains(F.slice(F.col("ids"), 1, F.greatest(i, F.lit(1))), x["id"]))
    ranked = lists.select("query_id", order.alias("sorted")).withColumn("ids", F.col("sorted")["id"])
    several = F.size("ids") != F.size(F.array_distinct("ids"))
    return ranked.select("query_id", F.slice(F.when(several, once).otherwise(F.col("sorted")), 1, k).alias("best"))


def release(df: DataFrame, *paths: str) -> None:
    """Remove saved frames, and the shuffle files of frames that are gone: Spark removes those when the driver collects its garbage."""
    for path in paths:
        discard(df.sparkSession, path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def found_in(rows: DataFrame, queries: DataFrame, index: dict[int, Index], table: int, wanted: float, k: int, kind: str) -> tuple[DataFrame, tuple[str, ...]]:
    """(query_id, found) of one table, a list of the nearest of each query, and the paths of what was written for it."""
    placed, seen = members(rows, index, table, kind), visits(queries, index, table, wanted, kind)
    held, held_at = saved(blocks(placed, many_blocks(placed)), "ann-index")
    asking, asking_at = saved(blocks(seen, many_blocks(seen)).select("cell", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs")), "ann-visits")
    sizes = [x.groupBy("cell").agg(F.count(F.lit(1)).alias(n)) for x, n in ((held, "n"), (asking, "m"))]
    hot, hot_at = saved(sizes[0].join(sizes[1], "cell").where(F.col("n") * F.col("m") > PAIRS).select("cell"), "ann-hot")
    met = held.join(asking.join(hot, "cell", "left_anti"), "cell")
    found = compared(met, k, kind)
    if not hot.isEmpty():
        # Pairs of blocks are the unit of work; they are dealt out, however few cells have them.
        dealt = held.join(hot, "cell").join(asking, "cell").repartition(F.xxhash64("ids", "q_ids"))
        found = found.unionByName(compared(dealt, k, kind))
    # The best of the table is all that goes on.
    best = merged(found, k).select("query_id", F.transform("best", lambda x: F.struct((-x["down"]).alias("score"), x["id"].alias("id"))).alias("found"))
    out, _ = saved(best, "ann-found-table")
    return out, (held_at, asking_at, hot_at)


def search(df: DataFrame, asked: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each row that fulfils `asked`, a condition on `id`."""
    # Blocks are long rows: few of them make a batch.
    text_batches(df.sparkSession)
    kind = width_of(df, vector)
    rows, _ = saved(usable(df, key, vector, kind), "ann-vectors")
    index = fitted(rows, k, kind)
    if not index:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))

    def found_by(queries: DataFrame, wanted: float) -> DataFrame:
        found = None
        for table in range(TABLES):
            own, paths = found_in(rows, queries, index, table, wanted, k, kind)
            release(df, *paths)
            found = own if found is None else found.unionByName(own)
        return saved(merged(found, k), "ann-found")[0]

    queries = rows.where(asked)
    found = found_by(queries, FOUND)
    sizes = rows.groupBy("length").agg(F.count_distinct("id").alias("n"))
    enough = F.least(F.lit(k), F.col("n") - 1)
    short = queries.join(sizes, "length").join(found.select(F.col("query_id").alias("id"), F.size("best").alias("got")), "id", "left") \
        .where(F.coalesce("got", F.lit(0)) < enough).select("id", "length", "vec")
    short, _ = saved(short, "ann-short")
    if not short.isEmpty():
        again = found_by(short, SURE)
        found = found.join(again, "query_id", "left_anti").unionByName(again)
    # What makes a list longer than nothing is a row of the result.
    return found.select("query_id", F.posexplode("best").alias("at", "one")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one")["id"].alias("vec_id"), (-F.col("one")["down"]).alias("score"))
