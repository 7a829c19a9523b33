"""Document quality by regularised quadratic discriminant analysis (operator 7).

A document becomes a vector of transformed statistics: logarithms of lengths, smoothed log-odds of
shares. Each class is a normal density whose covariance is shrunk towards the pooled one and towards
its own diagonal. The score is the logistic of

    log prior(1) - log prior(0) + log density(x | 1) - log density(x | 0)

whose densities are Mahalanobis distances and determinants from Cholesky factors. The factors are made
once from class moments, which Spark sums over the labelled rows, and are sent along with the task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardlog.llm.common import query, table

SAMPLE_ROWS = 20_000      # bound of the labelled rows that are fitted on
THRESHOLD = 0.7
SHRINK_POOLED = 0.7       # share of the pooled covariance in each class covariance
SHRINK_DIAGONAL = 0.2     # share of its own diagonal in it
SMOOTH = 1.0              # added to both counts of a share before its log-odds

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = bytes(range(48, 58))
MARKS = b".,;:'\"-()"
SHOUTS = b"!?"
SYMBOLS = bytes(c for c in range(33, 127) if c not in LETTERS + DIGITS + MARKS + SHOUTS)
FEATURES = ("words", "word_length", "upper", "digits", "symbols", "shouts", "marks", "marked_words",
            "distinct_words", "repeated_triples", "repeated_lines", "line_words", "short_words")


def _share(part: float, whole: float) -> float:
    return float(np.log((part + SMOOTH) / (max(whole - part, 0) + SMOOTH)))


def statistics(text: str | None) -> list[float]:
    """The vector of one whole text; a null text is an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    body = raw.translate(None, b" \t\n\r\x0b\x0c")
    size = len(body)
    without = lambda drop: size - len(body.translate(None, drop))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    triples = max(n - 2, 0)
    marked = sum(1 for w in words if w[-1] in SYMBOLS or w[-1] in SHOUTS)
    return [
        float(np.log1p(n)), float(np.log1p(size / max(n, 1))), _share(without(UPPER), without(LETTERS)),
        _share(without(DIGITS), size), _share(without(SYMBOLS), size), _share(without(SHOUTS), size),
        _share(without(MARKS), size), _share(marked, n), _share(len(set(words)), n),
        _share(triples - len(set(zip(words, words[1:], words[2:]))), triples),
        _share(len(lines) - len(set(lines)), len(lines)), float(np.log1p(n / max(len(lines), 1))),
        _share(sum(len(w) <= 3 for w in words), n)]


@dataclass(frozen=True)
class Model:
    """Per class: mean, inverse Cholesky factor of the covariance, constant of the log density."""
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = [c - 0.5 * np.sum(((x - m) @ f.T) ** 2, axis=1)
                for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def model_of(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Model:
    """From class counts, sums and sums of outer products; a class without rows gets the pooled shape."""
    n = np.maximum(counts, 1)[:, None]
    means = sums / n
    spread = np.stack([s - c * np.outer(m, m) for s, c, m in zip(squares, counts, means)])
    size = sums.shape[1]
    pooled = spread.sum(axis=0) / max(counts.sum() - 2, 1) + 1e-3 * np.eye(size)
    means[counts == 0] = sums.sum(axis=0) / max(counts.sum(), 1)
    factors, constants = [], []
    for scatter, count in zip(spread, counts):
        own = scatter / max(count - 1, 1) if count > 1 else pooled
        mixed = (1 - SHRINK_POOLED) * own + SHRINK_POOLED * pooled
        mixed = (1 - SHRINK_DIAGONAL) * mixed + SHRINK_DIAGONAL * np.diag(np.diag(mixed))
        lower = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log((count + 1) / (counts.sum() + 2)) - np.log(np.diag(lower)).sum())
    return Model(means, np.stack(factors), np.array(constants))


def _bucket():
    """The remainder that decides about folds: rows with 2 are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Class moments over the labelled, not held-out rows of `docs`.

    At most about `sample_rows` labelled rows are used: if there are more, those whose hashed id falls
    under the share that keeps that many. Rows of a null label, id or text are left out; an id with two
    labels counts with each. Without labelled rows every score is 0.5.
    """
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label"))
             .where("doc_id is not null and label in (0, 1)").where(_bucket() != 2))
    share = min(1.0, sample_rows / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .where("text is not null").join(F.broadcast(chosen), "doc_id"))
    size = len(FEATURES)

    def moments(batches):
        counts, sums, squares = np.zeros(2), np.zeros((2, size)), np.zeros((2, size, size))
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(1)]).reshape(-1, size)
            y = batch.column(0).to_numpy()
            for k in (0, 1):
                part = x[y == k]
                counts[k] += len(part)
                sums[k] += part.sum(axis=0)
                squares[k] += part.T @ part
        flat = np.concatenate([counts, sums.ravel(), squares.ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["at", "value"])

    rows = (texts.select("label", "text").mapInArrow(moments, "at int, value double")
            .groupBy("at").agg(F.sum("value").alias("value")).collect())   # as many rows as moments
    flat = np.zeros(2 * (1 + size + size * size))
    for row in rows:
        flat[row.at] = row.value
    return model_of(flat[:2], flat[2:2 + 2 * size].reshape(2, size), flat[2 + 2 * size:].reshape(2, size, size))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with a column `score`, from the text alone."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(at)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(x), pa.float64())],
                                             names=[*batch.schema.names, "score"])
    return docs.mapInArrow(run, f"{_columns_of(schema)}, score double")


def _columns_of(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def classify(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """Rows of `docs` to (doc_id, held_out, score, predicted), one per row.

    Labels are learnt from `training` (default: `docs`) where crc32 of the id's text mod 4 is not 2; labels,
    ids, languages and sources are no inputs of a score. Null and empty texts are scored as a text
    without words. A null doc_id is not held out. Other columns are ignored; an empty table gives an
    empty result.
    """
    model = fit(docs if training is None else training, labels)
    scored = score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                               F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", F.coalesce(_bucket() == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_predicted(docs: DataFrame, labels: DataFrame, training: DataFrame) -> DataFrame:
    """The rows of `docs` whose score reaches the threshold, with their own columns."""
    columns = docs.columns
    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct(*columns).alias("row"))
    return score(rows, fit(training, labels)).where(F.col("score") >= THRESHOLD).select("row.*")


@query("op7_discriminant_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
