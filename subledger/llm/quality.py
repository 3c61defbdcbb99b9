"""Document quality by co-training of two views.

The text view sees a document's words and their endings, hashed, and what the text looks like:
lines, shares of capitals, digits, signs and white space, how often words recur. The page view
sees only the metadata that came with it: language, source and length as given. Both are linear
classifiers. They start from labelled rows; in each round either one labels the unlabelled rows
it is surest of, for the other. Held-out labels calibrate both, and every document gets the sum
of both calibrated log odds, less the prior that they share. A view that tells nothing is
calibrated to the prior and leaves the decision to the other.

Only the fit works on a sample, of at most ``LABELLED`` labelled and ``POOL`` unlabelled keys,
those with the least hash, one row of each: that of the least hash of its text. All documents
are scored.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subledger.llm.batches import added, with_column
from subledger.llm.text import NON_SPACE, Words, byte_table, documents, mixed, slices, span_hashes, words_of

LABELLED, POOL = 3000, 3000
ROUNDS, PER_ROUND, SURE = 4, 200, 0.95
BUCKETS = 1 << 15
LANGS, SOURCES = 8, 32
SCALE = 10.0  # feature sums of a document's words
KINDS = [
    byte_table(lambda b: 0x41 <= b <= 0x5A),
    byte_table(lambda b: 0x30 <= b <= 0x39),
    byte_table(lambda b: 0x21 <= b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7E),
    byte_table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D),
    byte_table(lambda b: b >= 0x80),
]


def content(texts, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two feature numbers for each word: of the word, and of its last three bytes."""
    data, ends = texts.data.astype(np.uint64), words.ends
    length = ends - words.starts
    ending = data[ends - 1] if len(ends) else np.empty(0, np.uint64)
    for back in (2, 3):
        ending = ending * np.uint64(257) + np.where(length >= back, data[np.maximum(ends - back, 0)] + np.uint64(1), np.uint64(0))
    low = np.uint64(BUCKETS // 2 - 1)
    return (hashes & low).astype(np.int64), (mixed(ending) & low).astype(np.int64) + BUCKETS // 2


def _bucket(values: pa.Array, n: int) -> np.ndarray:
    """A hash bucket of each text of a column; null counts as empty."""
    out = np.zeros(len(values), dtype=np.int64)
    for part in slices(values.cast(pa.string())):
        out[part.first : part.last] = span_hashes(part.data, part.bounds[:-1], part.bounds[1:]) % np.uint64(n)
    return out


def looks(texts, words: Words, hashes) -> np.ndarray:
    """What each text looks like, as a row of numbers."""
    sizes = np.diff(texts.bounds)
    safe = np.maximum(sizes, 1)
    counts = np.diff(words.rows)
    row = np.repeat(np.arange(len(counts)), counts)

    def per_row(flags):
        total = np.append(0, np.cumsum(flags))
        return total[texts.bounds[1:]] - total[texts.bounds[:-1]]

    shares = [per_row(kind[texts.data]) / safe for kind in KINDS]
    lines = per_row(texts.data == 0x0A) + 1
    order = np.lexsort((hashes, row))
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    distinct = np.bincount(row[order][new], minlength=len(counts)) / np.maximum(counts, 1)
    letters = np.append(0, np.cumsum(words.ends - words.starts))
    mean_word = (letters[words.rows[1:]] - letters[words.rows[:-1]]) / np.maximum(counts, 1)
    return np.column_stack([*shares, np.log1p(sizes), np.log1p(lines), np.log1p(sizes / lines), distinct, np.log1p(mean_word)])


def page(langs: np.ndarray, sources: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """The metadata of each row as numbers."""
    rows = np.arange(len(langs))
    marks = np.zeros((len(langs), LANGS + SOURCES))
    marks[rows, langs] = 1
    marks[rows, LANGS + sources] = 1
    return np.column_stack([np.log1p(n_chars), marks])


LOOK_COLUMNS = len(KINDS) + 5
PAGE_COLUMNS = 1 + LANGS + SOURCES


def views(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array):
    """For slices of a batch: the texts, their words, word features, looks and page features."""
    langs, sources = _bucket(lang, LANGS), _bucket(source, SOURCES)
    chars = np.nan_to_num(n_chars.cast(pa.float64()).to_numpy(zero_copy_only=False))
    pages = page(langs, sources, np.maximum(chars, 0))
    for texts in slices(text):
        words = words_of(texts, texts.data, NON_SPACE)
        hashes = span_hashes(texts.data, words.starts, words.ends)
        yield texts, words, content(texts, words, hashes), looks(texts, words, hashes), pages[texts.first : texts.last]


class Sparse(NamedTuple):
    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    n: int

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * weights[self.columns], minlength=self.n)

    def back(self, errors: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * errors[self.rows], minlength=BUCKETS)


class Dense(NamedTuple):
    matrix: np.ndarray

    def times(self, weights: np.ndarray) -> np.ndarray:
        return self.matrix @ weights

    def back(self, errors: np.ndarray) -> np.ndarray:
        return errors @ self.matrix


class Both(NamedTuple):
    """The words of a text beside its looks."""

    words: Sparse
    looks: Dense

    def times(self, weights: np.ndarray) -> np.ndarray:
        return self.words.times(weights[:BUCKETS]) + self.looks.times(weights[BUCKETS:])

    def back(self, errors: np.ndarray) -> np.ndarray:
        return np.append(self.words.back(errors), self.looks.back(errors))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fitted(features, n_columns: int, labels: np.ndarray, weights: np.ndarray, steps: int = 60, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression by Adam; the last weight is the constant."""
    w, m, v = (np.zeros(n_columns + 1) for _ in range(3))
    weights = weights / weights.sum()
    for step in range(1, steps + 1):
        error = (sigmoid(features.times(w[:-1]) + w[-1]) - labels) * weights
        gradient = np.append(features.back(error) + l2 * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    return w


class Scaling(NamedTuple):
    means: np.ndarray
    spreads: np.ndarray

    def of(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.means) / self.spreads


def scaling(rows: np.ndarray) -> Scaling:
    return Scaling(rows.mean(axis=0), rows.std(axis=0) + 1e-3)


class Model(NamedTuple):
    text: np.ndarray
    page: np.ndarray
    looks_scaling: Scaling
    page_scaling: Scaling
    scales: tuple[tuple[float, float], tuple[float, float]]  # of text and page log odds
    prior: float  # log odds

    def scores(self, word_sums: np.ndarray, looks_rows: np.ndarray, page_rows: np.ndarray) -> np.ndarray:
        """Text, page and joint probability of good quality, one row each."""
        raw = (
            word_sums + self.looks_scaling.of(looks_rows) @ self.text[BUCKETS:-1] + self.text[-1],
            self.page_scaling.of(page_rows) @ self.page[:-1] + self.page[-1],
        )
        odds = [np.clip(a * x + b, -20, 20) for x, (a, b) in zip(raw, self.scales, strict=True)]
        return np.column_stack([sigmoid(odds[0]), sigmoid(odds[1]), sigmoid(odds[0] + odds[1] - self.prior)])


def calibrated(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Scale and shift that turn scores into log odds; the scale is never negative."""
    spread = scores.std() or 1.0
    w = fitted(Dense((scores / spread)[:, None]), 1, labels, weights, steps=400, l2=1e-3)
    return max(0.0, float(w[0] / spread)), float(w[1])


def co_trained(
    text: Sparse, looks_rows: np.ndarray, pages: np.ndarray, labels: np.ndarray, share_good: float, rounds: int = ROUNDS
) -> Model:
    """``labels``: 1, 0, or -1 for unlabelled rows; every fourth labelled row calibrates."""
    known = np.flatnonzero(labels >= 0)
    held = np.zeros(len(labels), dtype=bool)
    for value in (0, 1):
        held[known[labels[known] == value][::4]] = True
    of_looks, of_pages = scaling(looks_rows), scaling(pages)
    features = [Both(text, Dense(of_looks.of(looks_rows))), Dense(of_pages.of(pages))]
    columns = [BUCKETS + looks_rows.shape[1], pages.shape[1]]
    given = [np.where(held, -1, labels).astype(float) for _ in features]

    def one(view: int) -> np.ndarray:
        use = given[view] >= 0
        target = np.where(use, given[view], 0)
        good = (target * use).sum()
        balance = np.where(target > 0, 1 / max(good, 1), 1 / max(use.sum() - good, 1))
        return fitted(features[view], columns[view], target, balance * use)

    weights = [one(0), one(1)]
    for _ in range(rounds):
        for view in (0, 1):
            other = 1 - view
            chance = sigmoid(features[view].times(weights[view][:-1]) + weights[view][-1])
            free = np.flatnonzero((labels < 0) & (given[other] < 0))
            for value, sure in ((1.0, chance), (0.0, 1 - chance)):
                best = free[np.argsort(-sure[free], kind="stable")][:PER_ROUND]
                given[other][best[sure[best] >= SURE]] = value
        weights = [one(0), one(1)]
    on = np.flatnonzero(held)
    truth = labels[on].astype(float)
    weigh = np.where(truth > 0, share_good / max(truth.sum(), 1), (1 - share_good) / max((1 - truth).sum(), 1))
    scales = []
    for view in (0, 1):
        scores = features[view].times(weights[view][:-1]) + weights[view][-1]
        scales.append(calibrated(scores[on], truth, weigh))
    prior = float(np.log(share_good / (1 - share_good)))
    return Model(weights[0], weights[1], of_looks, of_pages, (scales[0], scales[1]), prior)


INPUTS = ["text", "lang", "source", "n_chars"]


def _sample(docs: DataFrame, keys: DataFrame) -> list:
    """Features of the documents named in ``keys`` (key, label): bounded by the sample."""

    def run(batches):
        for batch in batches:
            out = []
            for texts, words, (one, two), seen, rows in views(*(batch.column(i) for i in range(2, 6))):
                for k in range(texts.last - texts.first):
                    span = slice(words.rows[k], words.rows[k + 1])
                    both = np.concatenate([one[span], two[span]])
                    columns, counts = np.unique(both, return_counts=True)
                    out.append((columns, counts * (SCALE / max(1, span.stop - span.start)), np.append(seen[k], rows[k])))
            if out:
                columns, values, rows = zip(*out, strict=True)
                lists = [pa.array(columns, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), pa.array(rows, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["key", "label", "columns", "counts", "others"])

    own = docs.select(docs["doc_id"].alias("own_key"), *(docs[c] for c in INPUTS))
    # at most LABELLED + POOL keys; one row of each, however often a key comes up
    chosen = own.join(F.broadcast(keys), F.col("own_key") == F.col("key"))
    one = F.min(F.struct(F.xxhash64("text").alias("order"), *INPUTS)).alias("row")
    chosen = chosen.groupBy("key", "label").agg(one).select("key", "label", *(f"row.{c}" for c in INPUTS))
    schema = "key long, label int, columns array<int>, counts array<float>, others array<double>"
    return chosen.mapInArrow(run, schema).toArrow().sort_by([("key", "ascending"), ("label", "ascending")])


def trained(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model, or none without labels of both kinds."""
    valid = labels.where(labels["doc_id"].isNotNull() & labels["quality"].isin(0, 1))
    valid = valid.groupBy(valid["doc_id"].alias("key")).agg(F.min("quality").alias("label"))
    counts = {r["label"]: r["count"] for r in valid.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    share_good = counts[1] / (counts[0] + counts[1])
    order = F.xxhash64("key", F.lit(17))
    parts = [valid.where(F.col("label") == v).orderBy(order, "key").limit(LABELLED // 2) for v in (0, 1)]
    free = docs.select(docs["doc_id"].alias("key")).where("key is not null").distinct()
    free = free.join(valid.select("key"), "key", "left_anti").orderBy(order, "key").limit(POOL)
    parts.append(free.select("key", F.lit(-1).alias("label")))
    keys = parts[0].union(parts[1]).union(parts[2])
    rows = _sample(docs, keys.select("key", F.col("label").cast("int").alias("label")))
    label = rows["label"].to_numpy()
    if not {0, 1} <= set(label.tolist()) or min((label == 0).sum(), (label == 1).sum()) < 2:
        return None
    columns, counts = rows["columns"].combine_chunks(), rows["counts"].combine_chunks()
    sizes = columns.value_lengths().to_numpy()
    text = Sparse(
        np.repeat(np.arange(len(sizes)), sizes), columns.flatten().to_numpy().astype(np.int64),
        counts.flatten().to_numpy().astype(np.float64), len(sizes),
    )
    others = rows["others"].combine_chunks().flatten().to_numpy().reshape(len(sizes), LOOK_COLUMNS + PAGE_COLUMNS)
    return co_trained(text, others[:, :LOOK_COLUMNS], others[:, LOOK_COLUMNS:], label, share_good)


def with_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` and a struct of text, page and joint scores (0 to 1).

    Null texts have no words, null metadata counts as empty or 0. Without labels of both kinds
    (or with fewer than two sampled rows of either) all scores are 1.
    """
    model = trained(docs, labels)

    def make(columns: list[pa.Array]) -> pa.Array:
        n = len(columns[0])
        out = np.ones((n, 3))
        if model is not None:
            for texts, words, (one, two), seen, rows in views(*columns):
                sums = np.append(0, np.cumsum(model.text[one] + model.text[two]))
                sums = (sums[words.rows[1:]] - sums[words.rows[:-1]]) * SCALE / np.maximum(1, np.diff(words.rows))
                out[texts.first : texts.last] = model.scores(sums, seen, rows)
        return pa.StructArray.from_arrays([pa.array(out[:, i]) for i in range(3)], ["text", "page", "joint"])

    return with_column(docs, INPUTS, make, "quality_scores", "struct<text:double,page:double,joint:double>")


ACCEPT = 0.5


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose joint score is at least ``ACCEPT``, with their own columns."""
    scored = with_scores(docs, labels)
    name = added(docs, scored)
    return scored.where(F.col(f"`{name}`.joint") >= ACCEPT).drop(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", *INPUTS)
    scores = with_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = F.col("quality_scores")
    return scores.select(
        "doc_id", score.text.alias("text_score"), score.page.alias("page_score"), score.joint.alias("quality_score"),
        (score.joint >= ACCEPT).cast("int").alias("quality"),
    )
