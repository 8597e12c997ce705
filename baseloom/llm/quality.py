"""A quality classifier learnt from positive and unlabelled texts.

Trusted positives are labelled 1; the other side is unlabelled web text.  The model is
additive over binned statistics of a text and minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with logistic loss, where the class prior is estimated from the training labels.  The
unlabelled side is all training rows: bins are cut at their quantiles, and they are dealt
in groups of about ``GROUP_ROWS``; for each group a model minimises the risk, and the mean of the
models is the model.  The output is then scaled to a probability on the training labels.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baseloom.llm import _vector as V
from baseloom.llm._rowwise import beside
from baseloom.llm._scratch import Scratch

#: Bound of the labelled rows that are used.
MAX_LABELLED = 30_000
#: Unlabelled rows that one model is fitted on, at most.
GROUP_ROWS = 30_000
BINS = 24
STEPS, RATE, DECAY = 400, 0.05, 1e-4
SEED = 11
FEATURES = ("words", "word_length", "letters", "upper", "digits", "stops", "symbols", "beyond_ascii", "blanks", "lines", "distinct", "repeats", "marked", "bare", "capital", "line_repeats")

_KIND = np.zeros(256, np.uint8)  # 0 others: control characters
_KIND[[*range(97, 123)]] = 1
_KIND[[*range(65, 91)]] = 2
_KIND[[*range(48, 58)]] = 3
_KIND[[ord(c) for c in ".,;:'\"?-()"]] = 4
_KIND[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_KIND[128:] = 6
_KIND[[32, *range(9, 14)]] = 7


def features(block: V.Block) -> np.ndarray:
    """A row of statistics for each text, none of them dependent on its length alone but the first."""
    n = len(block)
    size = np.diff(block.offs).astype(float)
    kind = _KIND[block.data]
    count = np.stack([np.diff(np.concatenate([[0], np.cumsum(kind == k)])[block.offs]) for k in range(8)], 1).astype(float)
    starts, ends, first = V.split_words(block)
    words = np.diff(first).astype(float)
    doc = np.repeat(np.arange(n), np.diff(first))
    h = V.spans(block.data, starts, ends)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=n) / np.maximum(words, 1)

    keys = V.mix(h ^ V.mix(doc.astype(np.uint64) + np.uint64(1)))
    _, one = np.unique(keys, return_index=True)
    distinct = np.bincount(doc[one], minlength=n) / np.maximum(words, 1)
    repeats = np.zeros(len(h), bool)
    repeats[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    odd = np.concatenate([[0], np.cumsum(kind == 5)])
    plain = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 2) | (kind == 6))])
    upper = np.concatenate([[0], np.cumsum(kind == 2)])
    symbols, letters, capitals = (x[ends] - x[starts] for x in (odd, plain, upper))
    newline = block.data == 10
    lines = np.diff(np.concatenate([[0], np.cumsum(newline)])[block.offs]) + 1.0
    line_head = np.zeros(len(h), bool)
    if len(h):
        gap = np.concatenate([[0], np.cumsum(newline)])
        line_head[1:] = gap[starts[1:]] > gap[starts[:-1]]
        line_head[first[:-1][words > 0]] = True  # whatever text stands before
    heads = V.mix(h ^ V.mix(doc.astype(np.uint64) + np.uint64(1)))[line_head]
    _, one = np.unique(heads, return_index=True)
    head_doc = doc[line_head]
    n_heads = np.bincount(head_doc, minlength=n)
    line_repeats = 1 - np.bincount(head_doc[one], minlength=n) / np.maximum(n_heads, 1)
    whole = np.maximum(size, 1)
    return np.stack(
        [
            np.log1p(words), (size - count[:, 7]) / np.maximum(words, 1), count[:, 1] / whole, count[:, 2] / whole, count[:, 3] / whole, count[:, 4] / whole, count[:, 5] / whole, count[:, 6] / whole,
            count[:, 7] / whole, lines / (words + 1), distinct * np.log1p(words), per_doc(repeats), per_doc(symbols > 0), per_doc(letters == 0), per_doc((capitals == letters) & (letters > 1)), line_repeats,
        ],
        1,
    )


@dataclass
class Model:
    edges: np.ndarray
    weight: np.ndarray
    bias: float
    scale: float
    shift: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for j in range(x.shape[1]):
            out += self.weight[j][np.searchsorted(self.edges[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(x) + self.shift, -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


#: Bins are cut at quantiles, and more finely at the tails, where rejects are.
QUANTILES = sorted([*np.linspace(0, 1, BINS - 7)[1:-1].tolist(), 0.005, 0.01, 0.02, 0.98, 0.99, 0.995])


def untrained(edges: np.ndarray, prior: float) -> Model:
    """Scores everything by the prior."""
    return Model(edges, np.zeros((len(edges), edges.shape[1] + 1)), 0.0, 1.0, float(np.log(prior / (1 - prior))), prior)


def cells(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each row the cell of each feature, numbered through."""
    wide = edges.shape[1] + 1
    return np.stack([np.searchsorted(edges[j], x[:, j], "right") + j * wide for j in range(len(edges))], 1)


def fit(positive: np.ndarray, unlabelled: np.ndarray, size: int, prior: float) -> np.ndarray:
    """Weights of all cells, and the bias, that minimise the risk; both sides are rows of cells."""
    width = positive.shape[1]
    w, b = np.zeros(size), 0.0
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, STEPS + 1):
        gp, gu = w[positive].sum(1) + b, w[unlabelled].sum(1) + b
        risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        dp = -prior * _sigmoid(-gp) / len(gp)
        up, un = -prior * _sigmoid(gp) / len(gp), _sigmoid(gu) / len(gu)
        if risk >= 0:
            dp, du = dp + up, un
        else:  # the negative part has gone below zero: step back along it alone
            dp, du = -up, -un
        grad = np.bincount(positive.ravel(), np.repeat(dp, width), size) + np.bincount(unlabelled.ravel(), np.repeat(du, width), size)
        grad = np.append(grad + DECAY * w, dp.sum() + du.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        step = RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return np.append(w, b)


def fit_all(table: DataFrame, model: Model, positive: np.ndarray, group_rows: int) -> None:
    """Sets the model's weights: the mean, by rows, of models of groups that all rows of table are dealt to evenly."""
    groups = max(1, -(-table.count() // group_rows))
    shared = table.sparkSession.sparkContext.broadcast((model, positive))

    def run(batches):
        known, trusted = shared.value
        rows = [m for m in (_matrix(b.column(0)) for b in batches) if len(m)]
        if rows:
            x = np.concatenate(rows)
            x = x[np.lexsort(x.T)]  # sums don't depend on the order in which rows come
            got = fit(trusted, cells(known.edges, x), known.weight.size, known.prior)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(len(got))), "sum": pa.array(got * len(x)), "n": pa.array(np.full(len(got), len(x)))})

    told = table.select("x").repartition(groups).mapInArrow(run, "cell bigint, sum double, n bigint")
    got = told.groupBy("cell").agg((F.sum("sum") / F.sum("n")).alias("w")).orderBy("cell").toPandas()["w"].to_numpy()
    shared.destroy()
    if len(got):
        model.weight, model.bias = np.round(got[:-1], 9).reshape(model.weight.shape), round(float(got[-1]), 9)


def _calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Newton steps for a logistic curve over the margin."""
    m = model.margin(x)
    spread = m.std() or 1.0
    z, a, c = m / spread, 1.0, model.shift
    for _ in range(50):
        p = _sigmoid(a * z + c)
        r, v = p - y, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * z).mean() + 1e-3 * a, r.mean()])
        h = np.array([[(v * z * z).mean() + 1e-3, (v * z).mean()], [(v * z).mean(), v.mean() + 1e-9]])
        a, c = np.array([a, c]) - np.clip(np.linalg.solve(h, g), -2, 2)
    model.scale, model.shift = float(a / spread), float(c)


def held_out(ident) -> F.Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    rows = np.concatenate([features(b) for b in V.blocks(batch)]) if batch.num_rows else np.zeros((0, len(FEATURES)))
    return {"x": pa.array(list(rows), pa.list_(pa.float64()))}


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED, group_rows: int = GROUP_ROWS) -> Model:
    """Fits on the rows whose ids aren't held out: all of them unlabelled, and a bounded number of labelled ones, chosen by a hash of the id.

    Labels other than 0 and 1 and null ids are left out; of several labels of an id the
    largest counts, and of several texts one.  Ids must be whole numbers.  Without
    labels, or without texts, the score is the prior.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").filter(~held_out(F.col("id")))
    known = _sampled(known.groupBy("id").agg(F.max("y").alias("y")), max_labelled)
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("body")).filter(~held_out(F.col("id")))
    table = Scratch(docs.sparkSession).write(beside(texts, "body", _compute, "x array<double>").select("id", "x"))
    taken = table.join(F.broadcast(known), "id").groupBy("id").agg(F.min("x").alias("x"), F.max("y").alias("y")).orderBy("id").select("y", "x").toPandas()
    x, y = _matrix(taken["x"]), taken["y"].to_numpy(float)
    prior = float((y.sum() + 1) / (len(y) + 2))
    cuts = table.agg(*(F.percentile_approx(F.get("x", F.lit(j)), QUANTILES).alias(f"q{j}") for j in range(len(FEATURES)))).first()
    edges = np.array([c or [0.0] * len(QUANTILES) for c in cuts], float)
    model = untrained(edges, prior)
    if not (y == 1).any() or cuts[0] is None:
        return model
    fit_all(table, model, cells(edges, x[y == 1]), group_rows)
    if (y == 0).any():
        _calibrate(model, x, y)
    return model


def _sampled(rows: DataFrame, most: int) -> DataFrame:
    """About nine tenths of most rows, or all if there are fewer; which depends on the id alone."""
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 20)) < int((1 << 20) * 0.9 * most / n))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.Array):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return np.array(column.tolist(), float).reshape(-1, len(FEATURES))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns, with the probability of a good text.

    Null texts score as empty ones; empty texts get a score like any other.  A column
    named as the score is replaced.  Equal texts have equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        got = [shared.value.score(features(b)) for b in V.blocks(batch)]
        return {score_col: pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())}

    return beside(docs, text_col, compute, f"`{score_col}` double")


THRESHOLD = 0.3


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that aren't rejected, with the columns of the input."""
    name = f"score_{uuid4().hex}"
    return score(docs, train(docs, labels), score_col=name).filter(F.col(name) >= threshold).drop(name)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
