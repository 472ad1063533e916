"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a row of transformed statistics (``NAMES``). Per class, the mean and a covariance
shrunk twice are fitted: towards the classes' pooled covariance by ``lam``, then towards a multiple of
the identity by ``gamma`` (Friedman, "Regularized Discriminant Analysis", 1989); both are chosen by cross-validated log
loss. A text's raw score is the difference of the classes' log densities: Mahalanobis terms by the cached Cholesky factors,
and log determinants. A logistic line fitted on the held-out folds' raw scores makes it a probability.

The fit uses at most ``SAMPLE`` labelled ids, those with the least hash, and one row for each (of several documents with one id the one whose
statistics come first), so the driver holds a bounded matrix however many labels and copies there are; the model is a few kilobytes.

Cases: a null text is empty, and an empty text has a score like any other; a label that is neither 0 nor 1,
has a null id, or contradicts another of its document isn't used; with fewer than two usable labels of a class every text gets the
share of label 1 (0.5 without labels); repeated rows and null ids each get a result; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.llm.repetition import measure
from veilgraph.plans.workspace import bounded_batches, freeing

SAMPLE, FOLDS, SEED = 20_000, 5, 11
LAMBDAS, GAMMAS = (0.0, 0.1, 0.3, 0.6, 1.0), (0.001, 0.01, 0.05, 0.2)
NAMES = ("words", "word_length", "word_spread", "distinct", "symbols", "upper", "digits", "marks", "other", "shouts", "lines", "repeats", "long_repeats", "line_repeats", "entropy")
_CLASS = np.zeros((5, 256), np.int64)
for _row, _bytes in enumerate((b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b".,;:'\"()-", bytes(range(128, 256)))):
    _CLASS[_row, list(_bytes)] = 1


def statistics(text: bytes) -> np.ndarray:
    """The transformed statistics of one text, all finite."""
    found = measure(text)
    n, size = found["n_words"], max(1, len(text))
    raw = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    symbols, upper, digits, marks, other = _CLASS @ raw
    words = text.split()
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    share = raw[raw > 0] / size
    return np.array(
        [
            np.log1p(n),
            np.log1p(lengths.mean()),
            np.log1p(lengths.std()),
            np.log1p(len(set(words))) / np.log1p(max(1, n)),
            np.sqrt(symbols / size),
            np.sqrt(upper / size),
            np.sqrt(digits / size),
            np.sqrt(marks / size),
            np.sqrt(other / size),
            np.sqrt(raw[33] / size),
            np.log1p(100 * raw[10] / size),
            np.sqrt(found["n_repeat_words"] / max(1, n)),
            np.sqrt(found["shares"][1]),
            np.sqrt(found["line_share"]),
            -(share * np.log(share)).sum() if n else 0.0,
        ]
    )


class Discriminant:
    """Two Gaussian classes over standardised rows, with cached Cholesky factors."""

    def __init__(self, x: np.ndarray, y: np.ndarray, lam: float, gamma: float):
        self.centre, spread = x.mean(0), x.std(0)
        self.spread = np.where(spread > 1e-9, spread, 1.0)
        z = (x - self.centre) / self.spread
        groups = [z[y == c] for c in (0, 1)]
        self.means = [g.mean(0) for g in groups]
        own = [(g - m).T @ (g - m) for g, m in zip(groups, self.means, strict=True)]
        pooled = sum(own) / len(z)
        self.factors, self.logs = [], []
        for g, s in zip(groups, own, strict=True):
            cov = (1 - lam) * s / len(g) + lam * pooled
            cov = (1 - gamma) * cov + gamma * max(np.trace(cov) / len(cov), 1e-6) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            # the inverse of the factor turns the Mahalanobis term into one product and a sum of squares
            self.factors.append(np.linalg.inv(factor))
            self.logs.append(2 * np.log(np.diag(factor)).sum())

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, pressed into a bounded range."""
        z = (x - self.centre) / self.spread
        terms = [(((z - m) @ f.T) ** 2).sum(1) + log for m, f, log in zip(self.means, self.factors, self.logs, strict=True)]
        return np.arcsinh((terms[0] - terms[1]) / 2)


def _logistic(raw: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, offset) by Newton's method with a small ridge; the slope is not negative."""
    a = np.stack([raw, np.ones_like(raw)], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def _loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


class Model:
    """A discriminant with its logistic line; without both classes, a constant."""

    def __init__(self, x: np.ndarray, y: np.ndarray, folds: int = FOLDS):
        self.fitted, self.constant = None, float(y.mean()) if len(y) else 0.5
        count = np.bincount(y, minlength=2)
        if count.min() < 2:
            return
        fold = np.random.default_rng(SEED).permutation(len(y)) % min(folds, len(y))
        best = None
        for lam in LAMBDAS:
            for gamma in GAMMAS:
                raw = np.zeros(len(y))
                for k in range(fold.max() + 1):
                    inside, outside = fold != k, fold == k
                    if np.bincount(y[inside], minlength=2).min() < 1:
                        inside = np.ones(len(y), bool)
                    raw[outside] = Discriminant(x[inside], y[inside], lam, gamma).raw(x[outside])
                line = _logistic(raw, y)
                loss = _loss(1 / (1 + np.exp(-np.clip(line[0] * raw + line[1], -30, 30))), y)
                if best is None or loss < best[0]:
                    best = (loss, lam, gamma, line)
        self.loss, self.lam, self.gamma, self.line = best
        self.fitted = Discriminant(x, y, self.lam, self.gamma)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fitted is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.line[0] * self.fitted.raw(x) + self.line[1], -30, 30)))


def _statistics(batches):
    for batch in batches:
        rows = [statistics(t or b"") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


def _score(model: Model):
    def score(batches):
        for batch in batches:
            x = np.stack([statistics(t or b"") for t in batch.column(1).to_pylist()]) if batch.num_rows else np.empty((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    return score


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from the fit: CRC-32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from the labelled rows that aren't held out."""
    bounded_batches(docs.sparkSession)
    usable = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    usable = usable.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "label")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    measured = texts.join(F.broadcast(chosen.select("doc_id")), "doc_id").mapInArrow(freeing(_statistics), "doc_id long, x array<double>")
    # one row per chosen id, whatever the number of documents with it
    rows = measured.groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(chosen), "doc_id").select("label", "x").toArrow()
    y = np.asarray(rows.column("label").combine_chunks(), dtype=np.int64) if rows.num_rows else np.empty(0, np.int64)
    x = np.asarray(rows.column("x").combine_chunks().flatten()).reshape(len(y), -1) if len(y) else np.empty((0, len(NAMES)))
    order = np.lexsort((*x.T, y)) if len(y) else np.empty(0, np.int64)  # rows come in any order
    return Model(x[order], y[order])


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    bounded_batches(docs.sparkSession)
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(freeing(_score(model)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keep(model: Model):
    def keep(batches):
        for batch in batches:
            x = np.stack([statistics(t or b"") for t in batch.column(0).to_pylist()]) if batch.num_rows else np.empty((0, len(NAMES)))
            good = batch.filter(pa.array(model.score(x) >= 0.5))
            yield pa.RecordBatch.from_arrays(good.columns[1:], names=good.schema.names[1:])

    return keep


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model predicts to be of label 1, unchanged."""
    bounded_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    judged = plain.select(F.col(names[docs.columns.index(text_col)]).cast("binary").alias("judged"), "*")
    return judged.mapInArrow(freeing(_keep(model)), plain.schema).toDF(*docs.columns)
