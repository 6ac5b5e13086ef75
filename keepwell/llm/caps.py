"""Embedding near-duplicates through spherical-cap filters.

Filter directions are the words of random product codes: after a random rotation the
coordinates fall into blocks, every block has a code of random unit directions, and a
filter is one direction from each block.  A vector passes the filters whose caps it
lies in, which list decoding finds block by block without visiting the others.  A cap's
height is the vector's own: it is as high as lets `PER_TABLE` filters pass, so that no
vector is without filters, however its coordinates are spread.  Vectors that share a
filter are compared by cosine in double precision.  Of pairs at cosine 0.95, the least
that links, about one in a thousand share no filter of a rotation with two blocks, about
one in eight with three; so two rotations are used, and twice as many for each block
beyond two.  The tests measure what is missed.

The number of filters follows the number of vectors, so that unrelated vectors seldom
meet.  First only filter numbers are shuffled; vectors follow where a filter has more
than one.  Equal vectors are one class with a weight.  A filter with more than `BLOCK`
vectors is cut into blocks, and pairs of blocks are dealt out.  Only sums of links and a
spanning forest leave a task: a pair counts under the least filter that both pass.

Defined cases: null, zero-length and zero vectors, and those that hold null or
non-finite values, link with nothing; vectors of different lengths don't link; rows of
one id are vectors of their own; rows without an id count for nothing and have no
component; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import quoted, saved
from keepwell.llm.components import components
from keepwell.llm.simhash import _stars

LEAST_COSINE = 0.95
#: Filters that a vector passes in each rotation.
PER_TABLE = 16
#: Filters of a rotation for each vector of the table, about.
FILTERS_A_VECTOR = 64
#: Degrees from a cap's middle to its edge, at least: in few dimensions more filters would part what links.
LEAST_CAP = 40
#: Directions of a block's code, at most; more filters take more blocks.
MOST_DIRECTIONS = 4096
#: Vectors of a filter that one task compares at once.
BLOCK = 1024
SEED = 20_260_101


@dataclass
class Codes:
    """A rotation and its blocks' codes, the same in every task."""

    rotation: np.ndarray
    blocks: list[np.ndarray]

    @classmethod
    def make(cls, table: int, length: int, blocks: int, directions: int) -> "Codes":
        rng = np.random.default_rng([SEED, table, length])
        rotation = np.linalg.qr(rng.normal(size=(length, length)))[0]
        parts = [rng.normal(size=(directions, len(p))) for p in np.array_split(np.arange(length), blocks)]
        return cls(rotation, [p / np.linalg.norm(p, axis=1, keepdims=True) for p in parts])

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """(n, PER_TABLE) numbers of the filters that each unit vector passes.

        The best filters consist of directions that are among the best of their blocks, so
        a block's best PER_TABLE are all that can occur in them.
        """
        turned, numbers, scores, at = unit @ self.rotation, None, None, 0
        for code in self.blocks:
            own = turned[:, at:at + code.shape[1]] @ code.T
            at += code.shape[1]
            best = _best(own, min(PER_TABLE, len(code)))
            own = np.take_along_axis(own, best, axis=1)
            if numbers is None:
                numbers, scores = best.astype(np.int64), own
                continue
            sums = (scores[:, :, None] + own[:, None, :]).reshape(len(unit), -1)
            both = (numbers[:, :, None] * len(code) + best[:, None, :]).reshape(len(unit), -1)
            pick = _best(sums, min(PER_TABLE, sums.shape[1]))
            numbers, scores = np.take_along_axis(both, pick, axis=1), np.take_along_axis(sums, pick, axis=1)
        return numbers


def _best(scores: np.ndarray, n: int) -> np.ndarray:
    return np.argpartition(-scores, n - 1, axis=1)[:, :n]


def code_size(vectors: int, length: int) -> tuple[int, int]:
    """(blocks, directions of each) for so many vectors; not so many that caps get narrower than LEAST_CAP."""
    angle = (np.arange(20_000) + 0.5) * np.pi / 20_000
    density = np.sin(angle) ** max(0, length - 2)
    share = density[angle <= np.radians(LEAST_CAP)].sum() / density.sum()
    filters = max(2 * PER_TABLE, min(vectors * FILTERS_A_VECTOR, PER_TABLE / max(share, 1e-300)))
    blocks = 1
    while blocks < length and (blocks < 2 or filters ** (1 / blocks) > MOST_DIRECTIONS):
        blocks += 1
    return blocks, 1 << int(np.ceil(np.log2(filters) / blocks))


def rotations(blocks: int) -> int:
    return 2 ** max(1, blocks - 1)


def prepared(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, digest, length, vec): vec holds little-endian doubles; digest is null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, lengths, vecs = [], [], []
            for v in batch.column("v"):
                values = v.values.to_numpy(zero_copy_only=False).astype("<f8") if v.is_valid and len(v.values) else np.zeros(0)
                ok = len(values) > 0 and v.values.null_count == 0 and np.isfinite(values).all()
                norm = np.linalg.norm(values) if ok else 0.0
                ok = ok and 0 < norm < np.inf
                raw = (values + 0.0).tobytes()
                digests.append(hashlib.sha256(raw).digest()[:16] if ok else None)
                lengths.append(len(values))
                vecs.append(raw if ok else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(digests, pa.binary()), pa.array(lengths, pa.int32()), pa.array(vecs, pa.binary())],
                ["id", "digest", "length", "vec"])

    return df.select(F.col(quoted(key)).cast("long").alias("id"), F.col(quoted(vector)).cast("array<double>").alias("v")) \
        .mapInArrow(run, "id long, digest binary, length int, vec binary")


def _units(vecs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), "<f8").reshape(len(vecs), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def passed_filters(classes: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """(filter, digest) of every class; a filter's number tells length and rotation, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[int, int], Codes] = {}
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            digests, vecs = batch.column("digest").to_pylist(), batch.column("vec").to_pylist()
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length).tolist()
                blocks, directions = sizes[length]
                for first in range(0, len(at), 1000):
                    part = at[first:first + 1000]
                    unit = _units([vecs[i] for i in part])
                    for t in range(rotations(blocks)):
                        if (length, t) not in codes:
                            codes[length, t] = Codes.make(t, length, blocks, directions)
                        numbers = codes[length, t].decode(unit)
                        # Rotations and lengths are told apart by the number's residue and by a hash of the length.
                        ids = (numbers * rotations(blocks) + t).ravel() ^ np.int64(length * 0x9E3779B97F4A7 & (1 << 62) - 1)
                        yield pa.RecordBatch.from_pydict({
                            "filter": pa.array(ids), "digest": pa.array([digests[i] for i in part for _ in range(numbers.shape[1])], pa.binary())})

    return classes.select("digest", "length", "vec").mapInArrow(run, "filter long, digest binary")


def shared_filters(passed: DataFrame) -> DataFrame:
    """(filter, digest) where at least two classes pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of filters: a row leaves if its neighbour has the same filter."""
        last, left = None, True
        for batch in batches:
            filters = batch.column("filter").to_numpy()
            if not len(filters):
                continue
            same = np.r_[False, filters[1:] == filters[:-1]]
            if last is not None and filters[0] == last.column("filter")[0].as_py():
                same[0] = True
                if not left:
                    yield last
            go = same | np.r_[same[1:], False]
            if go.any():
                yield batch.filter(pa.array(go))
            last, left = batch.slice(len(filters) - 1), bool(go[-1])

    return passed.repartition("filter").sortWithinPartitions("filter").mapInArrow(run, "filter long, digest binary")


@dataclass
class Members:
    """Classes that pass one filter."""

    digests: list[bytes]
    weights: np.ndarray
    lengths: np.ndarray
    vecs: list[bytes]
    filters: list[np.ndarray]

    def __len__(self) -> int:
        return len(self.digests)

    def packed(self) -> bytes:
        return pickle.dumps((self.digests, self.weights, self.lengths, self.vecs, self.filters))

    def slice(self, a: int, b: int | None = None) -> "Members":
        return Members(self.digests[a:b], self.weights[a:b], self.lengths[a:b], self.vecs[a:b], self.filters[a:b])

    def joined(self, other: "Members") -> "Members":
        return Members(self.digests + other.digests, np.r_[self.weights, other.weights], np.r_[self.lengths, other.lengths],
                       self.vecs + other.vecs, self.filters + other.filters)


def linked_pairs(x: Members, y: Members) -> np.ndarray:
    """(len(x), len(y)): whether the vectors link."""
    out = np.zeros((len(x), len(y)), bool)
    for length in np.intersect1d(x.lengths, y.lengths).tolist():
        i, j = np.flatnonzero(x.lengths == length), np.flatnonzero(y.lengths == length)
        a, b = _units([x.vecs[k] for k in i]), _units([y.vecs[k] for k in j])
        out[np.ix_(i, j)] = a @ b.T >= LEAST_COSINE
    return out


def met_before(x: Members, y: Members, now: int) -> np.ndarray:
    """(len(x), len(y)): whether the vectors share a filter of lower number than `now`."""
    of_x = {f for own in x.filters for f in own.tolist() if f < now}
    common = {f: i for i, f in enumerate(sorted(of_x & {f for own in y.filters for f in own.tolist()}))}

    def marks(m: Members) -> np.ndarray:
        out = np.zeros((len(m), len(common)), np.float32)
        for i, own in enumerate(m.filters):
            out[i, [common[f] for f in own.tolist() if f in common]] = 1
        return out

    return marks(x) @ marks(y).T > 0.5 if common else np.zeros((len(x), len(y)), bool)


SCHEMA = "a binary, b binary, n long, filter long, block int, members binary"


def _row(a: list, b: list, n: list, f: int | None = None, block: int | None = None, members: bytes | None = None) -> pa.RecordBatch:
    k = len(a)
    return pa.RecordBatch.from_pydict({
        "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "n": pa.array(n, pa.int64()),
        "filter": pa.array([f] * k, pa.int64()), "block": pa.array([block] * k, pa.int32()), "members": pa.array([members] * k, pa.binary())})


def compared(x: Members, y: Members | None, now: int) -> Iterator[pa.RecordBatch]:
    """Links within x, or between x and y: a spanning forest, and each class's sum of linked weights."""
    other = x if y is None else y
    linked = linked_pairs(x, other)
    if y is None:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return
    counted = linked & ~met_before(x, other, now)
    all_digests = x.digests if y is None else x.digests + y.digests
    sums = counted @ other.weights
    if y is not None:
        sums = np.r_[sums, counted.T @ x.weights]
        n = len(x)
        whole = np.zeros((len(all_digests),) * 2, bool)
        whole[:n, n:], whole[n:, :n] = linked, linked.T
        linked = whole
    np.fill_diagonal(linked, True)
    child, parent = _stars(np.arange(len(all_digests)), linked)
    if len(child):
        yield _row([all_digests[i] for i in child], [all_digests[i] for i in parent], [None] * len(child))
    some = np.flatnonzero(sums)
    if len(some):
        yield _row([all_digests[i] for i in some], [None] * len(some), sums[some].tolist())


def links(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, n): rows with b connect classes; rows with n add n links to a."""
    own = shared.groupBy("digest").agg(F.sort_array(F.collect_set("filter")).alias("filters"))
    rows = own.join(classes.select("digest", "weight", "length", "vec"), "digest") \
        .select(F.explode("filters").alias("filter"), "digest", "weight", "length", "vec", "filters")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of filters; a filter with more than a block of classes leaves as blocks."""
        now, held, sent = None, None, 0

        def close() -> Iterator[pa.RecordBatch]:
            if sent:
                yield _row([None], [None], [None], now, sent, held.packed())
            elif held is not None and len(held) > 1:
                yield from compared(held, None, now)

        for batch in batches:
            filters = batch.column("filter").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(filters)) + 1).tolist(), len(filters)]
            weights, lengths = batch.column("weight").to_numpy(), batch.column("length").to_numpy()
            digests, vecs = batch.column("digest").to_pylist(), batch.column("vec").to_pylist()
            lists = batch.column("filters")
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = Members(digests[a:b], weights[a:b], lengths[a:b], vecs[a:b],
                               [flat[offsets[i]:offsets[i + 1]] for i in range(a, b)])
                if filters[a] != now:
                    yield from close()
                    now, held, sent = int(filters[a]), part, 0
                else:
                    held = held.joined(part)
                while len(held) > BLOCK:
                    yield _row([None], [None], [None], now, sent, held.slice(0, BLOCK).packed())
                    held, sent = held.slice(BLOCK), sent + 1
        yield from close()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, i, j, x, y in zip(*[c.to_pylist() for c in batch.columns]):
                for out in compared(Members(*pickle.loads(x)), None if i == j else Members(*pickle.loads(y)), f):
                    yield out.select(["a", "b", "n"])

    met, _ = saved(rows.repartition("filter").sortWithinPartitions("filter", "digest").mapInArrow(meet, SCHEMA), "cap-links")
    blocks = met.where("members IS NOT NULL").select("filter", "block", "members")
    others = blocks.select("filter", F.col("block").alias("other"), F.col("members").alias("others"))
    # Each pair of blocks is a task's unit of work; they are dealt out anew, however few filters have them.
    apart = blocks.join(others, "filter").where("block <= other") \
        .select("filter", "block", "other", "members", "others").repartition("filter", "block", "other")
    return met.where("members IS NULL").select("a", "b", "n").unionByName(apart.mapInArrow(pairs, "a binary, b binary, n long"))


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links to other rows, least id reachable, whether that is the row's own."""
    rows, _ = saved(prepared(df, key, vector), "cap-vectors")
    classes, _ = saved(rows.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(
        F.min("id").alias("least_id"), F.count(F.lit(1)).alias("weight"), F.max("length").alias("length"), F.max("vec").alias("vec")),
        "cap-classes")
    # A handful of lengths, whatever the number of vectors.
    sizes = {r.length: code_size(r.n, r.length) for r in classes.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared, _ = saved(shared_filters(passed_filters(classes, sizes)), "cap-filters")
    found, _ = saved(links(shared, classes), "cap-found")
    sums = found.where("n IS NOT NULL").groupBy(F.col("a").alias("digest")).agg(F.sum("n").alias("others"))
    parts = components(found.where("b IS NOT NULL")).withColumnRenamed("node", "digest")
    named = classes.select("digest", "least_id", "weight").join(parts, "digest", "left").join(sums, "digest", "left") \
        .withColumn("component", F.coalesce("component", "digest"))
    # Written, so that the joins deal both sides out and can split a component or vector of very many rows.
    least, _ = saved(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "cap-components")
    resolved, _ = saved(named.join(least, "component").select(
        "digest", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"), "cap-resolved")
    counts = rows.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(resolved, "digest", "left")
    component = F.coalesce("component_id", "id")
    return counts.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                         component.eqNullSafe(F.col("id")).alias("kept"))
