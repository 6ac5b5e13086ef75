"""How far the sources of a language are from each other, term by term.

Every (language, source) group is a smoothed distribution over its language's kept terms,
in whole billionths; two groups differ by the sum of |p - q| over those terms.  The work is a
cube: group blocks by group blocks by term blocks.  A slice holds what one block of groups
counts of one block of terms, and goes to every cell that needs it; a cell fills two small
matrices from its two slices (from one on the diagonal), a term that a group lacks with the
group's share for count zero, and emits the sums over its own terms.  What the cells of one
pair of groups emit is added along the term axis.  No task ever holds a whole group or a
whole vocabulary: a cell holds 2 x `GROUPS_A_BLOCK` x `TERMS_A_BLOCK` numbers, about.

Texts are cut into terms once, and counted per group and batch before anything is shuffled.
All sums and shares are whole numbers, so results don't depend on the blocks.

Defined cases: null text, language or source is an empty one; each row is a document, whatever
its id; a group without terms, or a language without kept terms, still has its pairs; a source
alone in its language has none; very long texts are cut at separators, piece by piece; other
columns, whatever their names, are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell.llm.common import saved, text_batches, worker_state

#: Documents of a language that a kept term is in, at least.
LEAST_DOCUMENTS = 30
#: Terms of a group that are listed.
TOP_TERMS = 50
#: Added to every count, and the whole in which shares are counted.
SMOOTHING, WHOLE = 5, 1_000_000_000
#: Groups and terms of a block, about: blocks are dealt out by hash.
GROUPS_A_BLOCK, TERMS_A_BLOCK = 64, 4096
#: Terms that a task counts before it sends them off, and bytes of a text that it cuts at once.
TERMS_HELD, PIECE = 400_000, 1 << 20

#: Bytes of a term stay, A-Z in lower case; `\x00-\x40\x5B-\x60\x7B-\x7F` are blanks. Bytes above are parts of other letters.
_LETTERS = bytes((b | 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b > 0x7F else 32) for b in range(256))


def pieces(raw: bytes, table: bytes, most: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; `table` turns what parts words into blanks."""
    first = 0
    while first < len(raw):
        last = first + most
        part = raw[first:last].translate(table)
        if last < len(raw):
            cut = part.rfind(b" ")
            while cut < 0 and last < len(raw):
                more = raw[last:last + most].translate(table)
                end = more.find(b" ")
                part += more if end < 0 else more[:end + 1]
                last += len(more) if end < 0 else end + 1
                cut = -1 if end < 0 else len(part) - 1
            if cut >= 0:
                part, last = part[:cut], first + cut + 1
        first = last
        if words := part.split():
            yield words


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each group's terms, added up per batch only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("divergence")
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for (a, b), (n, d) in held.items():
                terms = list(n)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([a] * len(terms), pa.string()), "source": pa.array([b] * len(terms), pa.string()),
                    "term": pa.array(terms, pa.binary()), "n": pa.array([n[t] for t in terms], pa.int64()),
                    "docs": pa.array([d[t] for t in terms], pa.int64())})
            held.clear()

        for batch in batches:
            for a, b, t in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                n, d = held.setdefault((a, b), (Counter(), Counter()))
                own: set[bytes] = set()
                for words in pieces(t.as_buffer().to_pybytes(), _LETTERS):
                    n.update(words)
                    own.update(words)
                d.update(own)
            if sum(len(n) for n, _ in held.values()) > TERMS_HELD:
                yield from send()
        yield from send()

    text_batches(docs.sparkSession)
    rows = docs.select(_known(lang).alias("lang"), _known(source).alias("source"), _known(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long") \
        .withColumn("term", F.col("term").cast("string"))


def _known(name: str) -> Column:
    return F.coalesce(F.col("`" + name.replace("`", "``") + "`").cast("string"), F.lit(""))


def _share(n: str, total: str, terms: str = "v") -> Column:
    """1 + floor(WHOLE * (n + SMOOTHING) / (total + SMOOTHING * terms)), in whole numbers; null without terms."""
    return F.expr(f"1 + ({WHOLE} * (cast({n} as decimal(20, 0)) + {SMOOTHING})) div nullif({total} + {SMOOTHING} * {terms}, 0)")


def _matrix(shares: np.ndarray, terms: int, entries: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.repeat(shares[:, None], terms, axis=1)
    out[entries[0], entries[1]] = entries[2]
    return out


def cell_sums(cells: DataFrame) -> DataFrame:
    """(lang, source, item, part): partial divergences of each cell's pairs of groups, both ways round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of cells: one or two slices each, that of the lower block first."""
        before: tuple | None = None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("lang", "x", "y", "term_block")]))
            terms, groups, entries = batch.column("terms").to_pylist(), batch.column("groups"), batch.column("entries")
            g_at, e_at = groups.offsets.to_numpy(), entries.offsets.to_numpy()
            names = groups.values.field("source")
            shares = groups.values.field("p0").to_numpy(zero_copy_only=False)
            fields = [entries.values.field(c).to_numpy(zero_copy_only=False) for c in ("g", "slot", "p")]
            for i, key in enumerate(keys):
                a, b = g_at[i], g_at[i + 1]
                now = _matrix(shares[a:b], terms[i], tuple(f[e_at[i]:e_at[i + 1]] for f in fields))
                own = names.slice(a, b - a).to_pylist()
                if key[1] == key[2]:
                    yield _pairs(key[0], own, own, now, now, True)
                elif before is not None and before[0] == key:
                    yield _pairs(key[0], before[1], own, before[2], now, False)
                    before = None
                else:
                    before = (key, own, now)

    ordered = cells.repartition("lang", "x", "y", "term_block").sortWithinPartitions("lang", "x", "y", "term_block", "block")
    return ordered.mapInArrow(run, "lang string, source string, item string, part long")


def _pairs(lang: str, a: list[str], b: list[str], p: np.ndarray, q: np.ndarray, same: bool) -> pa.RecordBatch:
    sums = np.array([np.abs(row - q).sum(axis=1) for row in p], dtype=np.int64).reshape(len(a), len(b))
    i, j = np.nonzero(~np.eye(len(a), dtype=bool)) if same else map(np.ravel, np.indices(sums.shape))
    left, right, part = [a[k] for k in i], [b[k] for k in j], sums[i, j]
    if not same:
        left, right, part = left + right, right + left, np.r_[part, part]
    return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(left), pa.string()), "source": pa.array(left, pa.string()),
                                       "item": pa.array(right, pa.string()), "part": pa.array(part, pa.int64())})


def _blocks(size: str, per_block: int) -> Column:
    return F.greatest(F.ceil(F.col(size) / F.lit(per_block)), F.lit(1)).cast("long")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", *, least_documents: int = LEAST_DOCUMENTS,
          top_terms: int = TOP_TERMS, groups_a_block: int = GROUPS_A_BLOCK, terms_a_block: int = TERMS_A_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` for every two sources of a language, part `term` for a group's foremost terms."""
    counts, _ = saved(term_counts(docs, text, lang, source).groupBy("lang", "source", "term")
                      .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    found = docs.select(_known(lang).alias("lang"), _known(source).alias("source")).distinct()
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")) \
        .where(F.col("docs") >= least_documents).drop("docs")
    kept, _ = saved(kept, "divergence-terms")
    groups, _ = saved(found, "divergence-groups")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s")).join(sizes, "lang", "left").fillna(0, ["v", "lang_n"]) \
        .withColumns({"group_blocks": _blocks("s", groups_a_block), "term_blocks": _blocks("v", terms_a_block)})
    langs, _ = saved(langs, "divergence-langs")

    # Numbers inside the blocks: a window holds one block.
    placed = kept.join(langs, "lang").withColumn("term_block", F.pmod(F.xxhash64("term"), "term_blocks")).withColumn(
        "slot", (F.row_number().over(Window.partitionBy("lang", "term_block").orderBy("term")) - 1).cast("int"))
    placed, _ = saved(placed.select("lang", "term", "term_block", "slot", "total"), "divergence-placed")
    own, _ = saved(counts.select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "divergence-own")
    named = groups.join(own.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left") \
        .fillna(0, ["group_n"]).join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "group_blocks")).withColumn(
        "g", (F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1).cast("int"))
    named, _ = saved(named.withColumn("p0", _share("0", "group_n")), "divergence-named")

    shared = own.join(named.select("lang", "source", "block", "g", "group_n", "lang_n", "v"), ["lang", "source"]) \
        .withColumn("p", _share("n", "group_n"))
    entries = shared.groupBy("lang", "block", "term_block").agg(F.collect_list(F.struct("g", "slot", "p")).alias("entries"))
    rows = named.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("g", "source", F.coalesce("p0", F.lit(0)).alias("p0")))).alias("groups"))
    columns = langs.select("lang", "group_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1)).alias("term_block")) \
        .join(placed.groupBy("lang", "term_block").agg(F.count(F.lit(1)).alias("terms")), ["lang", "term_block"], "left").fillna(0, ["terms"])
    slices = rows.join(columns, "lang").join(entries, ["lang", "block", "term_block"], "left").withColumn(
        "entries", F.coalesce("entries", F.array().cast("array<struct<g:int,slot:int,p:bigint>>")))
    # Each slice goes to the cells of its block with every other block.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("group_blocks") - 1))
    cells = slices.withColumn("other", other).select(
        "lang", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "term_block", "block", "terms", "groups", "entries")
    pairs = cell_sums(cells).groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))

    foremost = shared.withColumn("q", _share("total", "lang_n")).where("p > q") \
        .select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = foremost.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    both = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair")) \
        .unionByName(terms.withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
