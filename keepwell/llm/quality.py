"""Quality classifier by co-training of a text-content view and a page-metadata view.

The text view sees what the text says and looks like (case, symbols, repetition,
words that mark rejected documents).  The page view sees language, source, length
and line layout.  Each view is a ridge logistic regression, fitted on a bounded
sample of labelled documents.  In each round every view scores all unlabelled
documents, and those it is surest of become pseudo-labelled rows of the other view.
The views are then calibrated on labelled documents held out from fitting, and
their calibrated logits are combined into one score for every document.

A document counts as good if its label says quality 1 and not toxic.

Defined cases: a null or empty text is scored by its counts of zero; null metadata
is a value of its own, and a null n_chars is the text's length; labels without a
quality are left out, and of several labels of a document the worst holds; without
labels of both classes every document scores 1; repeated rows are scored row by row, and
fitted as one, the least; an empty table gives an empty table; new columns replace
columns of their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwell.llm.common import quoted, rows_back, saved, text_batches, tidy, worker_state

#: Labelled documents that the views are fitted and calibrated on, at most.
LABELLED_ROWS = 20_000
#: Pseudo-labelled documents that a view passes on in a round, for each class at most.
PSEUDO_ROWS = 1_000
ROUNDS = 3
#: A view is sure of a class from the score on that is right for this share of the held-out labels.
SURE = 0.99
#: Words and beginnings of words that mark a class: so many of the sample at most, in so many documents
#: at least, with a class share that is so many standard deviations off.
MARK_WORDS, MARK_DOCS, MARK_SIGMA = 500, 15, 6.0
#: A document is kept from this score on.
KEEP_FROM = 0.5
#: Buckets that sources and languages are hashed to.
SOURCE_BUCKETS, LANG_BUCKETS = 64, 16

WORD = re.compile(r"\w+")
UPPER, DIGITS = bytes(range(65, 91)), b"0123456789"
LETTERS = UPPER + UPPER.lower()
#: Characters that text is made of besides words.
PLAIN, BARS, BANGS, SYMBOLS = b".,;:'\"()-?", b"|\t", b"!", b"%#&*$@~^_=+<>[]{}\\/`"


def traits(word: str) -> tuple[str, ...]:
    """The word and the beginnings that it may share with words of its stem."""
    return (word, word[:4] + "-", word[:6] + "-") if len(word) > 4 else (word,)


def text_view(text: str, marks_bad: frozenset[str], marks_good: frozenset[str]) -> list[float]:
    """Numbers of the text's content, over the whole text."""
    raw = text.encode()
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    words = text.split()
    n, size = max(1, len(words)), max(1, len(raw))
    own = set(WORD.findall(text.lower()))
    bad = sum(not marks_bad.isdisjoint(traits(w)) for w in own)
    good = sum(not marks_good.isdisjoint(traits(w)) for w in own)
    return [
        np.log1p(len(words)), size / n / 10, count(UPPER) / max(1, count(LETTERS)), count(PLAIN) / size,
        count(BARS) / n, count(BANGS) / n, count(SYMBOLS) / n, count(DIGITS) / size,
        len(set(words)) / n ** 0.7, sum(map(eq, words, words[1:])) / n,
        np.log1p(bad), bad / max(1, len(own)) ** 0.5, np.log1p(good), good / max(1, len(own)), float(bad > 0),
        float(not own.isdisjoint(marks_bad)), np.log1p(len(own & marks_bad)),
    ]


def page_view(text: str, n_chars: int | None) -> list[float]:
    """Numbers of the page's length and line layout."""
    lines = text.split("\n")
    sizes = [len(x) for x in lines]
    size = len(text) if n_chars is None else max(0, n_chars)
    return [np.log1p(size), np.log1p(len(lines)), np.log1p(size / len(lines)), np.log1p(max(sizes)),
            sum(x < 20 for x in sizes) / len(lines), sum(x > 400 for x in sizes) / len(lines)]


def _bucket(value: str | None, buckets: int) -> int:
    return 0 if value is None else 1 + xxhash.xxh64_intdigest(value.encode()) % (buckets - 1)


def page_matrix(numbers: np.ndarray, langs: list, sources: list) -> np.ndarray:
    """The page view's columns: numbers, their squares, and indicators of language and source buckets."""
    n = len(numbers)
    flags = np.zeros((n, LANG_BUCKETS + SOURCE_BUCKETS))
    at = np.arange(n)
    flags[at, [_bucket(x, LANG_BUCKETS) for x in langs]] = 1
    flags[at, [LANG_BUCKETS + _bucket(x, SOURCE_BUCKETS) for x in sources]] = 1
    return np.concatenate([numbers, numbers ** 2, flags], axis=1)


@dataclass
class Logistic:
    """Ridge logistic regression on standardized columns, by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> "Logistic":
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1
        z = np.concatenate([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))], axis=1)
        w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            pull = z.T @ (p - y) + penalty * w
            bend = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(bend, pull)
            w -= step
            if np.abs(step).max() < 1e-7:
                break
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Model:
    """Words that mark a class, both views, their calibration, and how they combine."""

    marks_bad: frozenset[str] = frozenset()
    marks_good: frozenset[str] = frozenset()
    text: Logistic | None = None
    page: Logistic | None = None
    text_scale: Logistic | None = None
    page_scale: Logistic | None = None
    both: Logistic | None = None
    #: Pseudo-labels that each round exchanged, for the record.
    exchanged: list[int] = field(default_factory=list)

    def scores(self, content: np.ndarray, layout: np.ndarray, langs: list, sources: list) -> np.ndarray:
        """(n, 3): calibrated probability of a good document by text, by page, and by both."""
        if self.text is None or not len(content):
            return np.ones((len(content), 3))
        a = self.text.logit(content)
        b = self.page.logit(page_matrix(layout, langs, sources))
        if self.both is None:
            return _sigmoid(np.stack([a, b, a], axis=1))
        a, b = self.text_scale.logit(a[:, None]), self.page_scale.logit(b[:, None])
        return _sigmoid(np.stack([a, b, self.both.logit(np.stack([a, b], axis=1))], axis=1))


def _views(batch: pa.RecordBatch, model: Model) -> tuple[np.ndarray, np.ndarray, list, list]:
    texts = [t or "" for t in batch.column("text").to_pylist()]
    content = np.array([text_view(t, model.marks_bad, model.marks_good) for t in texts]).reshape(len(texts), -1)
    layout = np.array([page_view(t, n) for t, n in zip(texts, batch.column("n_chars").to_pylist())]).reshape(len(texts), -1)
    return content, layout, batch.column("lang").to_pylist(), batch.column("source").to_pylist()


def _inputs(df: DataFrame, key: str, text: str) -> dict:
    """The columns that the views read; metadata that the table lacks is null."""
    have = {c.lower(): quoted(c) for c in df.columns}
    get = lambda n, kind: F.col(have[n]).cast(kind) if n in have else F.lit(None).cast(kind)
    return {"id": F.col(quoted(key)).cast("long"), "text": F.col(quoted(text)), "lang": get("lang", "string"),
            "source": get("source", "string"), "n_chars": get("n_chars", "long")}


def labelled_sample(labels: DataFrame, rows: int) -> DataFrame:
    """(id, good) of at most `rows` labelled documents, in the order of their ids' hashes."""
    worst = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")) \
        .agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1.0).otherwise(0.0)).alias("good"))
    return worst.orderBy(F.xxhash64("id"), "id").limit(rows)


def mark_words(texts: DataFrame, bad_share: float) -> tuple[frozenset[str], frozenset[str]]:
    """Words of the sample (id, good, text) that far more, or far fewer, rejected documents have than the share of all."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, good in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist()):
                own = sorted({x for w in set(WORD.findall((t or "").lower())) for x in traits(w)})
                if own:
                    yield pa.RecordBatch.from_pydict({"word": pa.array(own), "bad": pa.array([1.0 - good] * len(own))})

    spread = (F.col("docs") * bad_share * (1 - bad_share)) ** 0.5
    counted = texts.select("text", "good").mapInArrow(words, "word string, bad double").groupBy("word") \
        .agg(F.count(F.lit(1)).alias("docs"), F.sum("bad").alias("bad")).where(F.col("docs") >= MARK_DOCS) \
        .withColumn("sigma", (F.col("bad") - F.col("docs") * bad_share) / spread)
    out = []
    for sign in (1, -1):
        rows = counted.where(F.col("sigma") * sign >= MARK_SIGMA).orderBy(F.col("sigma") * -sign, "word").limit(MARK_WORDS)
        out.append(frozenset(r.word for r in rows.collect()))
    return out[0], out[1]


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Co-train both views on the labelled sample and all unlabelled documents."""
    return _fit(df, labels, key, text)[0]


def _fit(df: DataFrame, labels: DataFrame, key: str, text: str) -> tuple[Model, DataFrame]:
    """The model, and (id, content, layout, lang, source) of every row, written once for the rounds."""
    spark = df.sparkSession
    text_batches(spark)
    docs = df.select(*[c.alias(n) for n, c in _inputs(df, key, text).items()])
    # At most LABELLED_ROWS short rows, so they can be sent to every task.
    sample, _ = saved(labelled_sample(labels, LABELLED_ROWS), "quality-labels")
    classes = {r.good: r.n for r in sample.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model()
    if len(classes) == 2:
        # One row of each id, however often it is repeated.
        texts = docs.select("id", "text").join(F.broadcast(sample), "id").groupBy("id", "good").agg(F.min("text").alias("text"))
        model.marks_bad, model.marks_good = mark_words(texts, classes[0.0] / sum(classes.values()))

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("quality")
        for batch in batches:
            content, layout, _, _ = _views(batch, model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(content.tolist(), pa.list_(pa.float64())),
                 pa.array(layout.tolist(), pa.list_(pa.float64())), batch.column("lang"), batch.column("source")],
                ["id", "content", "layout", "lang", "source"])

    seen, _ = saved(docs.mapInArrow(
        view, "id long, content array<double>, layout array<double>, lang string, source string"), "quality-views")
    if len(classes) < 2:
        return model, seen
    least = F.min(F.struct("content", "layout", "lang", "source")).alias("least")
    rows = seen.join(F.broadcast(sample), "id").groupBy("id", "good").agg(least).select("id", "good", "least.*").orderBy("id").collect()
    # A fifth of the labelled rows is held out for calibration.
    held_out = np.array([(r.id * 2654435761 >> 7) % 5 == 0 for r in rows], dtype=bool)
    train, hold = [r for r, h in zip(rows, held_out) if not h], [r for r, h in zip(rows, held_out) if h]
    if len({r.good for r in train}) < 2 or len({r.good for r in hold}) < 2:
        train = hold = rows
    if len({r.good for r in train}) < 2:
        return model, seen
    sets = {"text": [(r, r.good) for r in train], "page": [(r, r.good) for r in train]}
    _fit_views(model, sets)
    used = spark.createDataFrame([], "id long")
    known = labels.select(F.col("doc_id").cast("long").alias("id")).where("id IS NOT NULL").distinct()
    fresh = seen.join(known, "id", "left_anti")
    for _ in range(ROUNDS):
        sure = {v: _sure(model.scores(_content(hold), _layout(hold), [r.lang for r in hold], [r.source for r in hold])[:, i],
                         np.array([r.good for r in hold])) for i, v in enumerate(("text", "page"))}
        found = _confident(fresh.join(F.broadcast(used), "id", "left_anti"), model, sure)
        picked = found.collect() if found is not None else []
        for r in picked:
            sets["page" if r.view == "text" else "text"].append((r, r.good))
        model.exchanged.append(len(picked))
        if not picked:
            break
        used = used.unionByName(spark.createDataFrame([(r.id,) for r in picked], "id long"))
        _fit_views(model, sets)
    a, b, y = model.text.logit(_content(hold)), model.page.logit(_page(hold)), np.array([r.good for r in hold])
    model.text_scale = Logistic.fit(a[:, None], y)
    model.page_scale = Logistic.fit(b[:, None], y)
    a, b = model.text_scale.logit(a[:, None]), model.page_scale.logit(b[:, None])
    model.both = Logistic.fit(np.stack([a, b], axis=1), y)
    return model, seen


def _content(rows: list) -> np.ndarray:
    return np.array([r.content for r in rows])


def _layout(rows: list) -> np.ndarray:
    return np.array([r.layout for r in rows])


def _sure(scores: np.ndarray, good: np.ndarray) -> dict[float, float]:
    """{class: score}: at and beyond that score, SURE of at least 30 held-out rows belong to the class."""
    out = {}
    for label, s in ((1.0, scores), (0.0, -scores)):
        order = np.argsort(-s, kind="stable")
        right = np.cumsum(good[order] == label) / np.arange(1, len(s) + 1)
        last = np.r_[np.diff(s[order]) != 0, True]
        ok = np.flatnonzero((right >= SURE) & last & (np.arange(len(s)) >= 29))
        if len(ok):
            out[label] = float(scores[order[ok[-1]]])
    return out


def _page(rows: list) -> np.ndarray:
    return page_matrix(_layout(rows), [r.lang for r in rows], [r.source for r in rows])


def _fit_views(model: Model, sets: dict) -> None:
    for name, matrix in (("text", _content), ("page", _page)):
        rows, y = zip(*sets[name])
        setattr(model, name, Logistic.fit(matrix(rows), np.array(y)))


def _score(seen: DataFrame, model: Model) -> DataFrame:
    """`seen` with the scores of both views and of their combination."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = model.scores(np.array(batch.column("content").to_pylist()), np.array(batch.column("layout").to_pylist()),
                             batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, s.T)],
                                             [*batch.schema.names, "text_score", "page_score", "score"])

    extra = [T.StructField(n, T.DoubleType()) for n in ("text_score", "page_score", "score")]
    return seen.mapInArrow(tidy(run), T.StructType([*seen.schema, *extra]))


def _confident(fresh: DataFrame, model: Model, sure: dict) -> DataFrame | None:
    """For each view and class, the PSEUDO_ROWS unlabelled documents that the view is surest of."""
    scored = _score(fresh.where("id IS NOT NULL"), model)
    out = None
    for view, bounds in sure.items():
        p = F.col(f"{view}_score")
        for good, bound in bounds.items():
            rows = scored.where(p >= bound if good else p <= bound).orderBy(-p if good else p, F.xxhash64("id")) \
                .limit(PSEUDO_ROWS).withColumns({"view": F.lit(view), "good": F.lit(good)})
            out = rows if out is None else out.unionByName(rows)
    return out


def score_documents(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_score, page_score, score, kept) of every row of `df`."""
    model, seen = _fit(df, labels, key, text)
    return _score(seen, model).select(F.col("id").alias(key), "text_score", "page_score", "score",
                                      (F.col("score") >= KEEP_FROM).alias("kept"))


def keep_good(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df`, all columns, whose score is at least KEEP_FROM."""
    model = fit(df, labels, key, text)
    rows = df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"),
                     *[c.alias(n) for n, c in _inputs(df, key, text).items()]).drop("id")
    slim = rows.withColumn("row", F.col("row").withField(quoted(text), F.lit(None).cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("quality")
        for batch in batches:
            if batch.num_rows:
                good = pa.array(model.scores(*_views(batch, model))[:, 2] >= KEEP_FROM)
                yield pa.RecordBatch.from_arrays([batch.column("row").filter(good), batch.column("text").filter(good)], ["row", "text"])

    kept = slim.mapInArrow(tidy(run), T.StructType([slim.schema["row"], T.StructField("text", T.StringType())]))
    return rows_back(kept, df, **{text: F.col("text")})
