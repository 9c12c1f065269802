"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with FTRL-proximal (L1 and L2 penalties), calibrated with one temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poi_analytics.llm.shared import row_key, saved

UNDETERMINED = "und"
LETTER = r"\p{L}"  # Unicode letters; number signs such as U+00B2, U+00BD, U+2460 or U+2167 are none
_LETTER = regex.compile(LETTER)


@dataclass(frozen=True)
class Settings:
    """``sample_per_label`` bounds the labelled rows that the weights are fitted on;
    document frequencies are counted over all training rows."""

    bits: int = 15
    orders: tuple[int, ...] = (1, 2, 3)
    sample_per_label: int = 800
    calibration_share: int = 5  # one sampled row in so many sets the temperature only
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def ngram_counts(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of the whole lower-cased text: (buckets, counts)."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(1 << s.bits, np.int64)
    rolled = np.zeros(len(cp), np.uint32)
    for n in range(1, max(s.orders) + 1):
        if len(cp) < n:
            break
        rolled = rolled[:len(cp) - n + 1] * np.uint32(0x01000193) + cp[n - 1:]
        if n in s.orders:
            slots = (rolled + np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(32 - s.bits)
            total += np.bincount(slots, minlength=1 << s.bits)
    buckets = np.flatnonzero(total)
    return buckets, total[buckets]


def tfidf(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear term weights times idf, scaled to length one."""
    x = np.log1p(counts) * idf[buckets]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_labels: int, s: Settings) -> np.ndarray:
    """Weights (features x labels) from (buckets, values, label) rows, in the given order."""
    z = np.zeros((1 << s.bits, n_labels))
    n = np.zeros_like(z)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * s.l1 - z
        return np.where(np.abs(z) <= s.l1, 0.0, shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for buckets, values, label in rows:
            zi, ni = z[buckets], n[buckets]
            w = weights(zi, ni)
            error = softmax(values @ w)
            error[label] -= 1.0
            g = values[:, None] * error
            grown = ni + g * g
            z[buckets] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / s.alpha * w
            n[buckets] = grown
    return weights(z, n)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm.

    Targets are smoothed as in Platt scaling, (n + 1) / (n + 2) for the label, so that a sample
    without errors does not ask for certainty.
    """
    n, n_labels = scores.shape if len(labels) else (0, 0)
    if not n or n_labels < 2:
        return 1.0
    target = np.full(scores.shape, 1 / (n + 2) / (n_labels - 1))
    target[np.arange(n), labels] = (n + 1) / (n + 2)

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))
        return -(target * np.log(np.maximum(p, 1e-300))).sum(1).mean()

    low, high, ratio = -5.0, 3.0, (5 ** 0.5 - 1) / 2
    while high - low > 1e-3:
        left, right = high - ratio * (high - low), low + ratio * (high - low)
        if loss(left) <= loss(right):
            high = right
        else:
            low = left
    return float(np.exp((low + high) / 2))


def _document_frequencies(train: DataFrame, s: Settings) -> tuple[int, np.ndarray]:
    """Training rows and, per bucket, how many of them hold it.  At most 2^bits rows return."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << s.bits, np.int64)
        rows = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[ngram_counts(text, s)[0]] += 1
                rows += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(held, -1)), pa.array(np.append(df[held], rows))], ["bucket", "n"])

    got = (train.select("text").mapInArrow(count, "bucket long, n long")
           .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    buckets, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(1 << s.bits, np.int64)
    df[buckets[buckets >= 0]] = n[buckets >= 0]
    return int(n[buckets < 0].sum()), df


@dataclass(frozen=True)
class Model:
    labels: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float
    settings: Settings

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not has_letter(text):
            return UNDETERMINED, 0.0
        buckets, counts = ngram_counts(text, self.settings)
        p = softmax(tfidf(buckets, counts, self.idf) @ self.weights[buckets] / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def train(rows: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit a model on labelled rows (``text``, ``lang``).

    Rows without a label or without any letter are left out.  Document frequencies
    come from every row.  The weights are fitted in one task on a bounded sample: per label
    the ``sample_per_label`` distinct texts with the smallest hashes, so that a hot label does
    not displace a rare one nor a text with thousands of copies the other texts of its label.  What returns to the driver is the weight matrix
    (2^bits x labels).  No usable rows give a model that answers ``und``.
    """
    s = settings
    rows = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    n_rows, df = _document_frequencies(rows, s)
    idf = np.log((1.0 + n_rows) / (1.0 + df)) + 1.0
    if not n_rows:
        return Model([], np.zeros((1 << s.bits, 0)), idf, 1.0, s)
    # texts with small hashes, about twice as many per label as wanted, then exactly the smallest
    keyed = rows.withColumn("k", F.xxhash64(row_key(), "lang"))
    sizes = saved(keyed.groupBy("lang", "k").agg(F.lit(1).alias("one")).groupBy(F.col("lang").alias("label"))
                  .agg(F.count("*").alias("n")), "labels")
    share = F.least(F.lit(1.0), (2.0 * s.sample_per_label + 100) / F.col("n"))
    sample = (keyed.join(sizes, F.col("lang") == F.col("label"))
              .where(F.pmod(F.col("k"), F.lit(1 << 30)) < share * (1 << 30))
              .groupBy("lang", "k").agg(F.min("text").alias("text"))
              .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("k", "text")))
              .where(F.col("rank") <= s.sample_per_label).select("k", "text", "lang"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in b.to_pylist()]
        held.sort(key=lambda r: (r["k"], r["text"], r["lang"]))
        labels = sorted({r["lang"] for r in held})
        data = []
        for r in held:
            buckets, counts = ngram_counts(r["text"], s)
            data.append((buckets, tfidf(buckets, counts, idf), labels.index(r["lang"])))
        spare = data[::s.calibration_share] if len(data) >= 20 * s.calibration_share else []
        fitted = [d for i, d in enumerate(data) if not spare or i % s.calibration_share]
        w = fit_ftrl(fitted, len(labels), s)
        t = fit_temperature(np.array([v @ w[b] for b, v, _ in spare]), np.array([y for _, _, y in spare], int))
        yield pa.RecordBatch.from_arrays(
            [pa.array([labels]), pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([t])],
            ["labels", "w", "t"])

    got = sample.repartition(1).mapInArrow(fit, "labels array<string>, w binary, t double").first()
    w = np.frombuffer(got["w"], np.float32).reshape(1 << s.bits, -1).astype(np.float64)
    return Model(list(got["labels"]), w, idf, got["t"], s)


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (calibrated probability of that label).

    The whole text is read.  A null text or one without a letter is ``und`` with
    score 0.  Existing columns of those names are replaced.  The model is bounded by
    2^bits x labels and travels as a broadcast.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            got = [m.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64())],
                [*batch.schema.names, "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep).mapInArrow(run, schema)


def held_out(share: int = 5) -> Column:
    """True for rows whose crc32(doc_id as text) is divisible by ``share``; null ids are held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % share == 0, F.lit(True))


def with_language(docs: DataFrame, settings: Settings = Settings(), above_chance: float = 0.1) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known.

    Learned from the rows not held out.  A row is rejected if it has no letter, or if its best
    label's calibrated probability is less than ``above_chance`` above that of a guess.  When no
    label could be learned, only rows without a letter are rejected.
    """
    model = train(docs.where(~held_out()), settings)
    if not model.labels:
        return docs.where(F.col("text").cast("string").rlike(LETTER))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = predictions(docs.select(row, F.col("text").cast("string").alias("text")), model)
    least = min(1 / max(len(model.labels), 1) + above_chance, 1.0 - 1e-9) if len(model.labels) > 1 else 0.0
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("row.*")


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs``, learned from the rows not held out.

    Neither lang, source nor doc_id enters a prediction.  Repeated rows give repeated
    results; a row with a null doc_id is held out; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    model = train(rows.where(~held_out()), settings)
    return predictions(rows.select("doc_id", held_out().alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score")
