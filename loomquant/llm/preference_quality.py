"""Quality scores from preference pairs (Bradley-Terry).

A labelled document of quality 1 is preferred to one of quality 0. Scores are linear in features of the text alone
and are fitted by the logistic loss on feature differences of preference pairs, so only the order of documents
matters. A quantile of the fitted scores, the share of quality 0 among the fitted rows, is the threshold; the score
is mapped to (0, 1) so that the threshold stands at `cut`.

The fit takes all labelled rows and all pairs of one good and one poor row. The features of the labelled rows are
stored; each Newton step reads them twice: the loss of a pair depends on its two scores only, so the first pass counts
good and poor rows by score, on a grid of 1/32 with linear weights (which moves the mean loss of pairs by less than
10^-4), and the second sums each row's share of the gradient and the curvature. The driver holds the grid and matrices
over the features; the threshold is the exact quantile. Scoring is one narrow pass over all whole texts. Labels, lang,
source and doc_id are never features.

Defined results: null and empty texts get the score of an empty text; documents without a label are scored alike;
labels that are null are ignored, a doc_id with several labels counts once for each; without both classes every
score is `cut`; ties (equal texts) get equal scores; repeated rows are scored one by one; texts of any length are read whole;
an empty table gives no rows; other columns pass through, and where one is named like the score, the score's name ends
in an underscore.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .host_quality import _duplicate_lines, repeated_words
from .storage import stored
from .words import as_bytes, bounded, column, lean, split_words

FOLDS = 5


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of features for each text: rates of ASCII characters, lengths and repetition."""
    n_rows = len(off) - 1
    words = split_words(raw, off)
    n_bytes, n_words = np.diff(off), np.diff(words.rows)
    bytes_or_1, words_or_1 = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    counts = np.zeros((n_rows, 97))
    lines = np.zeros((n_rows, 2))
    for r in range(n_rows):
        part = raw[off[r] : off[r + 1]]
        by_byte = np.bincount(part, minlength=256)
        counts[r, :96] = by_byte[32:128]
        counts[r, 96] = by_byte[10]
        lines[r] = _duplicate_lines(part.tobytes())
    upper, lower, digits = counts[:, 33:59].sum(axis=1), counts[:, 65:91].sum(axis=1), counts[:, 16:26].sum(axis=1)
    in_words = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    np.cumsum(words.ends - words.starts, out=in_words[1:])
    return np.column_stack(
        [
            np.log1p(1000 * counts / bytes_or_1[:, None]),
            np.log1p(n_bytes),
            np.log1p(n_words),
            (n_bytes - counts.sum(axis=1)) / bytes_or_1,
            upper / np.maximum(upper + lower, 1),
            digits / bytes_or_1,
            (in_words[words.rows[1:]] - in_words[words.rows[:-1]]) / words_or_1,
            lines[:, 1] / np.maximum(lines[:, 0], 1),
            *(repeated_words(words.hashes, words.rows, k) / words_or_1 for k in (2, 3, 8)),
        ]
    )


@dataclass
class Ranker:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float
    cut: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        raw = ((rows - self.center) / self.scale * self.weights).sum(axis=1)  # a row alike whatever rows are beside it
        shift = np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip((raw - self.threshold) / self.spread + shift, -500, 500)))


def fit(rows: np.ndarray, quality: np.ndarray, *, cut: float, max_pairs: int, ridge: float = 10.0) -> Ranker:
    """Newton steps on the logistic loss of `max_pairs` pairs of a table in memory, drawn with a fixed seed; `fit_ranker`
    takes all of them."""
    width = rows.shape[1]
    good, poor = np.flatnonzero(quality == 1), np.flatnonzero(quality == 0)
    if not len(good) or not len(poor):
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0, cut)
    center, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-6
    z = (rows - center) / scale
    rng = np.random.default_rng(20)
    n = min(max_pairs, len(good) * len(poor))
    weights = np.zeros(width)
    gram_ridge = ridge * np.eye(width)
    differences = z[rng.choice(good, n)] - z[rng.choice(poor, n)]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(differences @ weights, -500, 500)))
        gradient = differences.T @ (1 - p) - ridge * weights
        step = np.linalg.solve((differences * (p * (1 - p))[:, None]).T @ differences + gram_ridge, gradient)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    scores = z @ weights
    threshold = float(np.quantile(scores, len(poor) / len(quality)))
    return Ranker(center, scale, weights, threshold, float(scores.std() or 1.0), cut)


@lean
def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        rows = features(*as_bytes(column(batch, "text")))
        values = pa.ListArray.from_arrays(
            pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1))
        )
        yield pa.RecordBatch.from_arrays([column(batch, "quality"), values], ["quality", "features"])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of fitting."""
    return F.coalesce((F.crc32(doc_id.cast("string").cast("binary")) % FOLDS) == 0, F.lit(False))


STEP = 1 / 32
FINE = 1024
NODES = 128
PARTS = 8
GRID_ERROR = 1e-5


def _labelled(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    values = column(batch, "features").flatten().to_numpy()
    return values.reshape(batch.num_rows, -1) if batch.num_rows else values.reshape(0, 0), column(batch, "quality").to_numpy()


def _sums(table: DataFrame, width: int, own: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what `own` gives for pieces of them, a vector of `width`; sums of tasks meet in a few
    tasks before the driver gets them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += own(*_labelled(batch))
        part = [TaskContext.get().partitionId() % PARTS]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([total.tobytes()])], ["part", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for one in column(batch, "total").to_pylist():
                total += np.frombuffer(one)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["total"])

    each = table.mapInArrow(run, "part int, total binary").repartition(PARTS, "part")
    got = each.mapInArrow(add, "total binary").toArrow()["total"].to_pylist()
    return np.sum([np.frombuffer(x) for x in got], axis=0) if got else np.zeros(width)


def _counts(table: DataFrame, score: Callable[[np.ndarray], np.ndarray], step: float, spread: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the grid of scores that have rows, in order, with their weight of poor and of good rows: a row counts in
    its cell or, with `spread`, in its cell and the next by its distance to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], float] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, quality = _labelled(batch)
            at = score(rows) / step
            cell = np.floor(at)
            part = at - cell if spread else np.zeros(len(at))
            for cells, weights in ((cell, 1 - part), (cell + 1, part)):
                keys, of = np.unique(np.column_stack([cells, quality]).astype(np.int64), axis=0, return_inverse=True)
                for key, weight in zip(map(tuple, keys.tolist()), np.bincount(of.reshape(-1), weights).tolist(), strict=True):
                    held[key] = held.get(key, 0.0) + weight
        columns = [[k[0] for k in held], [k[1] for k in held], list(held.values())]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["cell", "quality", "weight"])

    each = table.mapInArrow(run, "cell long, quality long, weight double").groupBy("cell")
    poor, good = (F.sum(F.when(F.col("quality") == q, F.col("weight")).otherwise(0.0)).alias(f"q{q}") for q in (0, 1))
    got = each.agg(poor, good).toArrow().sort_by("cell")
    return tuple(got[c].to_numpy() for c in ("cell", "q0", "q1"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _pulls(at: np.ndarray, cells: np.ndarray, poor: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For scores `at`: sums over all poor and over all good rows of the slope and of the curvature of the pair's loss."""
    out = np.empty((4, len(at)))
    for a in range(0, len(at), 256):
        p = _sigmoid(cells[None, :] - at[a : a + 256, None])  # of the other row being preferred
        c = p * (1 - p)
        out[:, a : a + 256] = p @ poor, (1 - p) @ good, c @ poor, c @ good
    return tuple(out)


def _mean_loss(cells: np.ndarray, poor: np.ndarray, good: np.ndarray) -> float:
    """Of all pairs, from the grid of scores."""
    at, total = cells * STEP, 0.0
    for a in range(0, len(at), 256):
        total += good[a : a + 256] @ (np.logaddexp(0, at[None, :] - at[a : a + 256, None]) @ poor)
    return total / (poor.sum() * good.sum())


def _newton_sums(table: DataFrame, center: np.ndarray, scale: np.ndarray, weights: np.ndarray, grid: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the mean loss of all pairs."""
    d = len(weights)
    cells, poor, good = grid
    nodes = cells * STEP
    slopes = np.column_stack(_pulls(nodes, nodes, poor, good))
    low, high = nodes[0], nodes[-1] + STEP
    coarse = np.linspace(low, high, NODES)

    def own(x: np.ndarray, quality: np.ndarray) -> np.ndarray:
        z = (x - center) / scale
        s = z @ weights
        best = quality == 1
        by_poor, by_good, bent_poor, bent_good = (np.interp(s, nodes, slopes[:, i]) for i in range(4))
        gradient = z.T @ np.where(best, -by_poor, by_good)
        curve = (z * np.where(best, bent_poor, bent_good)[:, None]).T @ z
        at = np.clip((s - low) / (high - low) * (NODES - 1), 0, NODES - 1)
        cell = np.minimum(at.astype(int), NODES - 2)
        hats = np.zeros((len(s), 2, NODES))
        hats[np.arange(len(s)), best.astype(int), cell] = 1 - (at - cell)
        hats[np.arange(len(s)), best.astype(int), cell + 1] = at - cell
        sides = hats.reshape(len(s), -1).T @ z
        return np.concatenate([gradient, curve.reshape(-1), sides.reshape(-1)])

    got = _sums(table, d + d * d + 2 * NODES * d, own)
    below, above = got[d + d * d :].reshape(2, NODES, d)
    p = _sigmoid(coarse[:, None] - coarse[None, :])
    cross = above.T @ (p * (1 - p)) @ below  # steps only: the gradient alone decides where they end
    pairs = poor.sum() * good.sum()
    values, vectors = np.linalg.eigh((got[d : d + d * d].reshape(d, d) - cross - cross.T) / pairs)
    return got[:d] / pairs, (vectors * np.maximum(values, 0.0)) @ vectors.T


def _threshold(table: DataFrame, score: Callable[[np.ndarray], np.ndarray]) -> float:
    """The quantile of the scores at the share of poor rows, between its two neighbours as `np.quantile` has it."""
    cells, poor, good = _counts(table, score, 1 / FINE, False)
    filled = poor + good > 0
    cells, n = cells[filled], np.cumsum((poor + good)[filled])
    place = poor.sum() / n[-1] * (n[-1] - 1)
    ranks = np.array([math.floor(place), min(math.floor(place) + 1, n[-1] - 1)])
    first, last = np.searchsorted(n, ranks, side="right")
    wanted = set(cells[first : last + 1].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = score(_labelled(batch)[0])
                inside = np.isin(np.floor(s * FINE), list(wanted))
                yield pa.RecordBatch.from_arrays([pa.array(s[inside])], ["s"])

    got = table.mapInArrow(run, "s double").groupBy("s").count().toArrow().sort_by("s")
    values, upto = got["s"].to_numpy(), np.cumsum(got["count"].to_numpy())
    below = n[first - 1] if first else 0.0
    low, high = values[np.minimum(np.searchsorted(upto, ranks - below, side="right"), len(values) - 1)]
    return float(low + (place - ranks[0]) * (high - low))


def fit_ranker(docs: DataFrame, labels: DataFrame, *, cut: float = 0.3, ridge: float = 1 / 6000) -> Ranker:
    """Newton steps, halved where they overshoot, on the mean logistic loss of all pairs with `ridge` on the weights."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col("quality").cast("int").alias("quality"))
    # the same join whatever the number of labels, so that nothing grows with them on the driver
    found = docs.select("doc_id", "text").join(known.hint("merge"), "doc_id").select("quality", "text")
    table = stored(found.mapInArrow(_featurize, "quality int, features array<double>"))
    width = features(np.empty(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    first = _sums(table, 2 + width, lambda x, q: np.concatenate([[(q == 0).sum(), (q == 1).sum()], x.sum(axis=0)]))
    n = first[0] + first[1]
    if not first[0] or not first[1]:
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0, cut)
    center = first[2:] / n
    scale = np.sqrt(_sums(table, width, lambda x, q: ((x - center) ** 2).sum(axis=0)) / n) + 1e-6
    def told(weights: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]:
        grid = _counts(table, lambda x: ((x - center) / scale) @ weights, STEP, True)
        return grid, _mean_loss(*grid) + ridge / 2 * weights @ weights

    weights = np.zeros(width)
    grid, loss = told(weights)
    for _ in range(40):
        gradient, curve = _newton_sums(table, center, scale, weights, grid)
        gradient = gradient + ridge * weights
        if np.abs(gradient).max() < 1e-6:
            break
        step = -np.linalg.solve(curve + ridge * np.eye(width), gradient)
        grid, after = told(weights + step)
        while after > loss + GRID_ERROR and np.abs(step).max() > 1e-9:
            step = step / 2
            grid, after = told(weights + step)
        weights, loss = weights + step, after

    def score(x: np.ndarray) -> np.ndarray:
        return ((x - center) / scale) @ weights

    spread = math.sqrt(max(0.0, _sums(table, 1, lambda x, q: np.array([np.square(score(x)).sum()]))[0] / n))
    return Ranker(center, scale, weights, _threshold(table, score), spread or 1.0, cut)


def score_documents(docs: DataFrame, ranker: Ranker, *, keep: list[str], name: str = "score") -> DataFrame:
    """`keep` columns with the score of each text."""
    while name in keep:
        name += "_"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            scores = ranker.score(features(*as_bytes(column(batch, "text"))))
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in keep] + [pa.array(scores)], [*keep, name])

    source = [*keep, *(["text"] if "text" not in keep else [])]
    fields = [docs.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())]
    return docs.select(*source).mapInArrow(run, T.StructType(fields))
