"""Benchmark decontamination by template canonicalisation.

Benchmark items and documents become token sequences in which numbers, names and
units after numbers are typed placeholders, so that a question whose values were
changed keeps its template.  Windows of `WINDOW` tokens are hashed and joined.  Hits
of one document and item on one diagonal (document position less item position) are
one occurrence.  Its slots must be consistent: each of the item's values stands for
the same value of the document wherever it occurs.  A document is contaminated by
an item when consistent occurrences cover at least `COVERAGE` of its windows.

Texts are read in two ways, as a sentence's first word may be a name or not: in one,
capitalized words are names inside a sentence only, in the other also where they open
one.  Either reading of an item is compared with the same reading of the documents.
Items that have no window to index are compared by their exact tokens, values and
signs included: only verbatim copies of the whole item contaminate.

A bit field of the benchmark's hashes, of fixed size, travels to the tasks, so that
only windows that can match leave them; the join itself is on the whole hash.

Defined cases: null, empty and blank texts match nothing; items of fewer tokens than
a window count as one window; those compared by exact tokens that have fewer than
`LEAST_WORDS` tokens or no letter can't be told from other text, and match documents
that consist of nothing else; scripts without spaces are cut by character; equal items
are reported each; rows of equal id and text get equal verdicts, also where the id is
null; an empty table gives an empty table, an empty benchmark flags nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import quoted, ragged, text_batches, tidy, worker_state

WINDOW = 5
COVERAGE = 0.5
#: Words besides placeholders that an indexed window has at least.
LEAST_WORDS = 3
#: Share of an occurrence's item values that must stand for one value each.
CONSISTENT = 0.75
#: log2 of the bits of the field that prunes windows.
FIELD_BITS = 24

#: Words for numbers, and units that count as such behind a number.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "billion".split())
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz "
    "ounce ounces lb lbs pound pounds ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons pint pints "
    "cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros $ € £ % percent kmh mph hz khz mhz w kw v a j kj cal kcal c f k °c °f".split())

#: Scripts without spaces between words: Thai, Lao, Burmese, Khmer, Chinese, Japanese.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f"
LETTERS = rf"[^\W\d_{UNSPACED}]+(?:['’-][^\W\d_{UNSPACED}]+)*"
PART = re.compile(rf"\d+(?:[.,:/]\d+)*|[$€£%°]+|[{UNSPACED}]|{LETTERS}|_+")
#: Exact tokens: numbers, words and signs, without the punctuation that texts are quoted with.
EXACT = re.compile(rf"\d+(?:[.,:/]\d+)*|[{UNSPACED}]|{LETTERS}|[^\w\s.,:;!?'\"’()\[\]]")
ENDS = re.compile(r"[.!?:;]['\")\]]*$")
WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
#: Readings of a text: first words of sentences as words, as names; exact tokens.  Windows meet those of their reading only.
WORDS_OPEN, NAMES_OPEN, VERBATIM = 0, 1, 2
READING = np.array([0, *(xxhash.xxh64_intdigest(r, 7) for r in ("names open", "verbatim"))], dtype=np.uint64)
#: What a placeholder of each kind hashes to.
PLACEHOLDER = np.array([0] + [xxhash.xxh64_intdigest(f"<{k}>", 7) for k in ("number", "unit", "name")], dtype=np.uint64)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _raw_words(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words between blanks; of all texts' words, in order, which; and how many each text has."""
    seen: dict[str, int] = {}
    order, counts = [], []
    for t in texts:
        raw = (t or "").split()
        order.extend([seen.setdefault(w, len(seen)) for w in raw])
        counts.append(len(raw))
    return list(seen), np.array(order, dtype=np.int64), np.array(counts, dtype=np.int64)


def _spread(sizes: list[int], sequence: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all tokens among those of the distinct words, and where each text's tokens end."""
    sizes_of = np.array(sizes, dtype=np.int64)
    if not len(sequence):
        return np.zeros(0, np.int64), np.zeros(len(counts), np.int64)
    at = ragged(np.cumsum(sizes_of) - sizes_of, sizes_of, sequence)
    return at, np.concatenate([[0], np.cumsum(sizes_of[sequence])])[np.cumsum(counts)]


def verbatim(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As a reading of `canonical`, of the exact tokens, of which none is a placeholder."""
    seen, sequence, counts = _raw_words(texts)
    value, sizes = [], []
    for raw in seen:
        parts = EXACT.findall(raw.lower())
        sizes.append(len(parts))
        value.extend([xxhash.xxh64_intdigest(p, 7) for p in parts])
    at, text_ends = _spread(sizes, sequence, counts)
    value = np.array(value, dtype=np.uint64)[at]
    return value, np.zeros(len(at), np.int8), value, text_ends


def canonical(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of all texts' tokens, in order: template hash, kind, value hash; and where each text's tokens end.  For both readings.

    A name is a capitalized word inside a sentence, in the second reading also one that opens
    it; names in a row are one.  Words all in capitals are words, so that a text set in
    capitals keeps its template.
    """
    seen, sequence, counts = _raw_words(texts)
    value, kind, capital, ends, sizes = [], [], [], [], []
    for raw in seen:
        parts = PART.findall(raw)
        sizes.append(len(parts))
        for p in parts:
            low = p.lower()
            value.append(xxhash.xxh64_intdigest(low, 7))
            kind.append(NUMBER if p[0].isdigit() or low in NUMBER_WORDS else UNIT if low in UNITS else WORD)
            capital.append(p[0].isupper() and not p.isupper())
            ends.append(False)
        if parts:
            ends[-1] = bool(ENDS.search(raw))
    at, text_ends = _spread(sizes, sequence, counts)
    value, kind = np.array(value, dtype=np.uint64)[at], np.array(kind, dtype=np.int8)[at]
    capital, ends = np.array(capital, dtype=bool)[at], np.array(ends, dtype=bool)[at]
    opens = np.zeros(len(at) + 1, dtype=bool)
    opens[np.concatenate([[0], text_ends])] = True
    opens = opens[:-1]
    after_number = np.r_[False, kind[:-1] == NUMBER] & ~opens if len(at) else opens
    kind = np.where((kind == UNIT) & ~after_number, WORD, kind)
    begins = opens | np.r_[True, ends[:-1]][:len(at)]

    def reading(may_name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own = np.where((kind == WORD) & capital & may_name, NAME, kind)
        # A run of names is one slot; its value is made of all its words.
        name = own == NAME
        goes_on = name & np.r_[False, name[:-1]][:len(at)] & ~begins
        first = np.flatnonzero(~goes_on)
        values = value
        if len(first):
            totals = np.cumsum(value, dtype=np.uint64)
            before = np.r_[np.uint64(0), totals][first]
            after = totals[np.r_[first[1:], len(at)] - 1]
            values = after - before
        own = own[first]
        return np.where(own == WORD, values, PLACEHOLDER[own]), own, values, np.searchsorted(first, text_ends, side="left")

    return [reading(~begins), reading(np.ones(len(at), bool))]


def window_hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    """Hash of the window that starts at each token; windows that run past a text's end are the caller's to leave out."""
    n = len(tokens) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(length):
        out = (out ^ tokens[j:j + n]) * FACTOR
        out ^= out >> np.uint64(29)
    return out + np.uint64(length)


def _starts(text_ends: np.ndarray, length: int) -> np.ndarray:
    """First tokens of all windows that lie within a text."""
    begins = np.concatenate([[0], text_ends[:-1]]).astype(np.int64)
    counts = np.maximum(text_ends - begins - length + 1, 0)
    return ragged(begins, counts, np.arange(len(text_ends)))


def _slots(kind: np.ndarray, value: np.ndarray, at: np.ndarray, length: int) -> pa.Array:
    """Values of each window's placeholders, as lists."""
    square = at[:, None] + np.arange(length)
    filled = kind[square] != WORD
    ends = np.concatenate([[0], np.cumsum(filled.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(value[square][filled].view(np.int64)))


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(h, item, reading, place, windows, length, whole, item_slots): all indexed windows of the items.

    Of an item with `whole`, only a text of just so many tokens is a copy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            readings = [*canonical(texts), verbatim(texts)]
            begins = [np.concatenate([[0], r[3][:-1]]).astype(np.int64) if len(r[3]) else r[3] for r in readings]
            for nth, i in enumerate(batch.column("item").to_pylist()):
                spans = [slice(int(b[nth]), int(r[3][nth])) for b, r in zip(begins, readings)]
                words_open = readings[WORDS_OPEN][1][spans[WORDS_OPEN]]
                indexed = False
                for which, (tokens, kind, value, _) in enumerate(readings):
                    own = spans[which]
                    n, kinds = own.stop - own.start, kind[own]
                    length = min(WINDOW, n)
                    if which == VERBATIM:
                        if indexed or not n:
                            continue
                        at = np.arange(n - length + 1)
                    else:
                        if length < LEAST_WORDS or which == NAMES_OPEN and np.array_equal(kinds, words_open):
                            continue
                        words = np.lib.stride_tricks.sliding_window_view(kinds == WORD, length).sum(axis=1)
                        at = np.flatnonzero(words >= LEAST_WORDS)
                        indexed |= which == WORDS_OPEN and len(at) > 0
                    if len(at):
                        h = window_hashes(tokens[own], length) ^ READING[which]
                        vague = which == VERBATIM and (n < LEAST_WORDS or not any(c.isalpha() for c in texts[nth]))
                        yield pa.RecordBatch.from_pydict({
                            "h": pa.array(h[at].view(np.int64)), "item": pa.array([i] * len(at), pa.int64()),
                            "reading": pa.array([which] * len(at), pa.int32()), "place": pa.array(at, pa.int64()),
                            "windows": pa.array([len(at)] * len(at), pa.int64()), "length": pa.array([length] * len(at), pa.int32()),
                            "whole": pa.array([n if vague else None] * len(at), pa.int64()),
                            "item_slots": _slots(kinds, value[own], at, length)})

    return benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")) \
        .where("item IS NOT NULL AND text IS NOT NULL") \
        .mapInArrow(tidy(run), "h long, item long, reading int, place long, windows long, length int, whole long, item_slots array<long>")


def _field_of(windows: DataFrame) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """A field of 2^FIELD_BITS bits, as bytes, with the windows' hashes set; and the windows' readings and lengths.

    Each task sends its set bits in chunks of bounded size; what meets here is the field, whatever the benchmark's size.
    """
    chunks = 1 << max(0, FIELD_BITS - 19)
    field = np.zeros((chunks, (1 << FIELD_BITS) // 8 // chunks), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << FIELD_BITS, bool)
        for batch in batches:
            own[batch.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - FIELD_BITS)] = True
        for chunk, bits in enumerate(np.split(np.packbits(own), chunks)):
            if bits.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    for r in windows.select("h").coalesce(8).mapInArrow(tidy(run), "chunk int, bits binary").toLocalIterator():
        field[r.chunk] |= np.frombuffer(r.bits, np.uint8)
    lengths = sorted(map(tuple, windows.select("reading", "length").distinct().collect()))
    return np.unpackbits(field.ravel()), lengths


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, mark, h, at, size, doc_slots): the windows of `docs` (id, mark, text) that may be an item's, and the text's tokens in that reading."""
    spark = docs.sparkSession
    field, lengths = _field_of(windows)
    sent = spark.sparkContext.broadcast((np.packbits(field).tobytes(), lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("templates")
        packed, own_lengths = sent.value
        marked = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            readings = canonical(texts)
            if any(reading == VERBATIM for reading, _ in own_lengths):
                readings.append(verbatim(texts))
            for reading, length in own_lengths:
                tokens, kind, value, ends = readings[reading]
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
                h = window_hashes(tokens, length) ^ READING[reading]
                at = _starts(ends, length) if len(ends) else ends
                at = at[marked[h[at] >> np.uint64(64 - FIELD_BITS)]] if len(at) else at
                if not len(at):
                    continue
                row = np.searchsorted(ends, at, side="right")
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pick), batch.column("mark").take(pick), pa.array(h[at].view(np.int64)),
                     pa.array(at - begins[row], pa.int64()), pa.array((ends - begins)[row], pa.int64()), _slots(kind, value, at, length)],
                    ["id", "mark", "h", "at", "size", "doc_slots"])

    return docs.mapInArrow(tidy(run), "id long, mark long, h long, at long, size long, doc_slots array<long>")


def contaminations(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mark, item, coverage, changed_slots) for each document and item that contaminates it.

    `mark` is the hash of the text, which tells rows of one id apart.
    """
    text_batches(df.sparkSession)
    docs = df.select(F.col(quoted(key)).cast("long").alias("id"), F.xxhash64(quoted(text)).alias("mark"),
                     F.col(quoted(text)).alias("text"))
    windows = item_windows(benchmark)
    pairs = F.transform(F.arrays_zip("item_slots", "doc_slots"), lambda s: F.struct(s.item_slots.alias("own"), s.doc_slots.alias("found")))
    met = hits(docs, windows).join(windows, "h").where("whole IS NULL OR whole = size") \
        .select("id", "mark", "item", "reading", "windows", (F.col("at") - F.col("place")).alias("diagonal"), "place", pairs.alias("pairs"))
    # One occurrence is at most the item long, so its sets are small.
    occurrences = met.groupBy("id", "mark", "item", "reading", "windows", "diagonal") \
        .agg(F.collect_set("place").alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")) \
        .where((F.col("reading") != VERBATIM) | (F.size("places") == F.col("windows")))
    values = F.array_distinct(F.col("pairs.own"))
    single = F.filter(values, lambda v: F.size(F.filter("pairs", lambda p: p.own == v)) == 1)
    consistent = occurrences.where(F.size(single) >= F.size(values) * CONSISTENT) \
        .withColumn("changed", F.size(F.filter("pairs", lambda p: p.own != p.found)))
    covered = consistent.withColumn("place", F.explode("places")).groupBy("id", "mark", "item", "reading", "windows") \
        .agg(F.count_distinct("place").alias("n"), F.max("changed").alias("changed_slots"))
    # The first reading that contaminates says how.
    found = F.min(F.struct("reading", (F.col("n") / F.col("windows")).alias("coverage"), "changed_slots")).alias("found")
    return covered.where(F.col("n") >= F.col("windows") * COVERAGE).groupBy("id", "mark", "item").agg(found) \
        .select("id", "mark", "item", "found.coverage", "found.changed_slots")


def _named(df: DataFrame, found: DataFrame, key: str, text: str, how: str, *, keep: list) -> DataFrame:
    left = df.withColumns({"_id": F.col(quoted(key)).cast("long"), "_mark": F.xxhash64(quoted(text))})
    right = found.withColumnsRenamed({"id": "_their_id", "mark": "_their_mark"})
    on = F.col("_id").eqNullSafe(F.col("_their_id")) & (F.col("_mark") == F.col("_their_mark"))
    return left.join(right, on, how).select(*keep)


def judge_documents(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, contaminated, items, coverage, changed_slots) of every row: items in ascending order, the highest coverage."""
    found = contaminations(df, benchmark, key, text).groupBy("id", "mark") \
        .agg(F.sort_array(F.collect_set("item")).alias("items"), F.max("coverage").alias("coverage"),
             F.max("changed_slots").alias("changed_slots"))
    rows = df.select(F.col(quoted(key)).alias(key), F.col(quoted(text)).alias(text))
    return _named(rows, found, key, text, "left", keep=[
        F.col(quoted(key)), F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("changed_slots", F.lit(0)).alias("changed_slots")])


def drop_contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df`, all columns, that no item contaminates."""
    found = contaminations(df, benchmark, key, text).select("id", "mark").distinct()
    packed = df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"), F.col(quoted(key)).alias("key"),
                       F.col(quoted(text)).alias("text"))
    kept = _named(packed, found, "key", "text", "left_anti", keep=[F.col("row")])
    return kept.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in df.columns])
