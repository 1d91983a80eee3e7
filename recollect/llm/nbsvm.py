"""Operator 12: a quality classifier by naive Bayes support vectors.

A text is the set of its n-grams: words and pairs of words (runs of letters and digits, and runs of other signs), and runs of one to four bytes,
hashed to `BUCKETS`.  The indicator of an n-gram is scaled by its log-count ratio, log (p/|p|) / (q/|q|), where p and q are one more than
the numbers of texts of either class that have it; a text's vector has length 1.  On these vectors a linear model with hinge loss is fitted by
dual coordinate descent: one text after the other moves its multiplier to where the dual is least, within 0 and `COST`, until no multiplier would
move by more than `ENOUGH`, or for `EPOCHS` rounds.  Margins become probabilities by a logistic curve that is fitted on texts held back from all else.

Counts cover all labelled rows to learn from.  The support vectors come from a bounded sample of them: about `SAMPLE` rows of each class and `BYTES` of
text (drawn by a hash of key and text), in one task; the curve from as many of those held back, weighted by what they stand for.
What comes to the driver and goes to the tasks are arrays of `BUCKETS` numbers.

Results for odd input: null and empty texts have no n-grams and are scored by the bias; without labelled rows of both classes every score is the share of
class 1 (one half without any); a null key is learned from if labels have one (they are not joined, so it is not); labels that are null don't count, and of a
key's several labels the majority does (none in a tie); repeated rows get equal scores; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Filter, documents, written

BUCKETS = 1 << 20
#: Rows of each class, and bytes of text of each class, that the linear model is fitted on.
SAMPLE, BYTES = 6000, 24 << 20
COST, ENOUGH, EPOCHS = 1.0, 0.02, 40
#: From this score on a text is good.
GOOD = 0.3
PORTION = 1 << 20
LONGEST = 4

_SPACE, _WORD, _SIGN = range(3)
_KINDS = np.full(256, _SIGN, np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KINDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _WORD
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(h: np.ndarray, kind: int) -> np.ndarray:
    """The bucket of each hash of a kind of n-gram."""
    h = (h ^ np.uint64(kind * 0xA0761D6478BD642F & 2**64 - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int32)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


class Ngrams:
    """Finds the distinct buckets of texts."""

    def __init__(self):
        self.last = np.zeros(BUCKETS, np.int32)
        self.up, self.down = _powers(_BASE, PORTION), _powers(_INVERSE, PORTION)

    def of(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The distinct buckets of each text, in order."""
        held, size = [], 0
        for text in texts:
            if size and size + len(text) > PORTION:
                yield from self._of(held, size)
                held, size = [], 0
            held.append(text)
            size += len(text)
        if held:
            yield from self._of(held, size)

    def _of(self, texts: list[bytes], size: int) -> Iterator[np.ndarray]:
        if size > len(self.up):
            self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)
        ends = np.cumsum([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        # Where n bytes don't cross into the next text: runs of n bytes begin at the places before the last n - 1 of a text.
        runs, gram = [], np.zeros(len(data), np.uint64)
        for n in range(1, LONGEST + 1):
            if len(data) < n:
                break
            gram = (gram[: len(data) - n + 1] << np.uint64(8)) | data[n - 1 :]
            runs.append(_mixed(gram, n))
        kind = _KINDS[data]
        edge = np.ones(len(data) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        edge[ends] = True
        places = np.flatnonzero(edge)
        begin, end = places[:-1], places[1:]
        some = kind[begin] != _SPACE if len(data) else np.zeros(0, bool)
        begin, end = begin[some], end[some]
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], dtype=np.uint64)])
        word = (prefix[end] - prefix[begin]) * self.down[begin]
        words = _mixed(word, 8)
        pairs = _mixed(word[:-1] * np.uint64(0xD6E8FEB86659FD93) + word[1:], 9)
        firsts = np.searchsorted(begin, np.concatenate([[0], ends]))
        at = 0
        for k, stop in enumerate(ends.tolist()):
            i, j = firsts[k], firsts[k + 1]
            found = np.concatenate([*(r[at : max(at, stop - n)] for n, r in enumerate(runs)), words[i:j], pairs[i : max(i, j - 1)]])
            number = np.arange(len(found), dtype=np.int32)
            self.last[found] = number
            yield found[self.last[found] == number]
            at = stop


@dataclass
class Model:
    """For each bucket the scaled weight and the square of its ratio; margin to probability by 1 / (1 + exp(-(slope * margin + shift)))."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, texts: list[bytes], ngrams: Ngrams) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for k, found in enumerate(ngrams.of(texts)):
            norm = float(self.squares[found].sum(dtype=np.float64)) ** 0.5
            if norm:
                out[k] += float(self.weights[found].sum(dtype=np.float64)) / norm
        return out

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -50, 50)))


def descend(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: float = COST, enough: float = ENOUGH, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model with hinge loss on rows of (buckets, values), each of length 1 (or empty), by dual coordinate descent."""
    weights, bias = np.zeros(BUCKETS, np.float32), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1 for _, v in rows])  # the bias is one more value, of 1
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            at, values = rows[i]
            slope = signs[i] * (float(weights[at] @ values) + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            if step := new - alpha[i]:
                most = max(most, abs(step))
                alpha[i] = new
                weights[at] += np.float32(step * signs[i]) * values
                bias += step * signs[i]
        if most < enough:
            break
    return weights, bias


def logistic(margins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve with the greatest weighted likelihood; labels are drawn in a little, so that it exists."""
    up, down = weight[labels == 1].sum(), weight[labels == 0].sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    theta = np.array([1.0, 0.0])
    loss = lambda t: float(weight @ (np.logaddexp(0, x @ t) - target * (x @ t)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -50, 50)))
        gradient = x.T @ (weight * (p - target))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), gradient)
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if abs(size * step).max() < 1e-7:
            break
    return float(theta[0]), float(theta[1])


def _share(of: Column, key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(key), of), F.lit(parts))


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, learn: Column) -> DataFrame:
    """The rows to learn from: label, held (1 if held back for the curve), size, draw and text."""
    votes = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.avg(F.when(F.col(label) >= 1, 1).otherwise(0)).alias("_mean"))
    votes = votes.filter(F.col("_mean") != 0.5).select(F.col(key).alias("_key"), (F.col("_mean") > 0.5).cast("int").alias("label"))
    votes = written(votes, "nbsvm-labels")
    known = Filter.of(votes.select(F.xxhash64("_key")))

    @F.arrow_udf("boolean")
    def has(keys: pa.Array) -> pa.Array:
        return pa.array(known.has(keys.to_numpy()))

    # Only texts that (almost surely) have a label are moved.
    rows = docs.filter(learn).select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    rows = rows.filter(has(F.xxhash64("_key"))).join(votes.hint("merge"), "_key")
    draw = _share(F.struct("_key", F.xxhash64("text")), "draw", 1_000_000) / 1_000_000
    return rows.select("label", (_share(F.col("_key"), "held back", 5) == 0).cast("int").alias("held"), F.octet_length("text").alias("size"), draw.alias("draw"), "text")


def _counts(batches):
    ngrams, counts = Ngrams(), np.zeros((2, BUCKETS), np.int32)
    for batch in batches:
        for label, found in zip(batch.column(0).to_pylist(), ngrams.of([t.as_py() for t in batch.column(1)]), strict=True):
            counts[label, found] += 1
    at = np.flatnonzero(counts.any(axis=0))
    for k in range(0, len(at), 100_000):
        part = at[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(counts[c, part], pa.int64()) for c in (0, 1))], ["bucket", "n0", "n1"])


def ratios(rows: DataFrame) -> np.ndarray:
    """The log-count ratio of each bucket, 0 where no text has it.  `BUCKETS` rows at most come to the driver."""
    table = rows.select("label", "text").mapInArrow(_counts, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    counts = np.zeros((2, BUCKETS))
    for c in (0, 1):
        counts[c, table.column("bucket").to_numpy()] = table.column(f"n{c}").to_numpy()
    seen = counts.any(axis=0)
    q, p = counts + 1
    return np.where(seen, np.log(p / p[seen].sum()) - np.log(q / q[seen].sum()), 0).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, size: int = BYTES) -> Model:
    """The model, from the rows of `docs` that have a label and for which `learn` holds."""
    rows = written(labelled(docs, labels, key, text, label, F.lit(True) if learn is None else learn), "nbsvm-rows")
    found = {(r["label"], r["held"]): (r["n"], r["bytes"]) for r in rows.groupBy("label", "held").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
    ones, zeros = (sum(n for (c, _), (n, _) in found.items() if c == k) for k in (1, 0))
    if not (found.get((0, 0)) and found.get((1, 0))):
        share = (ones + 1) / (ones + zeros + 2)
        none = np.zeros(BUCKETS, np.float32)
        return Model(none, none, 0.0, 1.0, float(np.log(share / (1 - share))))
    ratio = ratios(rows.filter("held = 0"))
    shares = {k: min(1.0, sample / n, size / max(b, 1)) for k, (n, b) in found.items()}
    drawn = F.lit(False)
    for (c, h), share in shares.items():
        drawn |= (F.col("label") == c) & (F.col("held") == h) & (F.col("draw") < share)
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def train(batches):
        scale, ngrams = sent.value, Ngrams()
        mine, signs, rest = [], [], []
        for batch in batches:
            for c, h, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ngrams.of([t.as_py() for t in batch.column(2)]), strict=True):
                values = scale[found]
                at = np.flatnonzero(values)
                norm = float(np.square(values, dtype=np.float64).sum()) ** 0.5
                row = (found[at], values[at] / np.float32(norm or 1))
                if h:
                    rest.append((c, row))
                else:
                    mine.append(row)
                    signs.append(2 * c - 1)
        weights, bias = descend(mine, np.array(signs, float))
        slope, shift = 2.0, 0.0
        kinds = np.array([c for c, _ in rest])
        if 0 < kinds.sum() < len(kinds):
            margins = np.array([float(weights[at] @ values) + bias for _, (at, values) in rest])
            slope, shift = logistic(margins, kinds, np.array([1 / shares[c, 1] for c in kinds.tolist()]))
        at = np.flatnonzero(weights)
        values = (weights * scale)[at]
        yield pa.RecordBatch.from_arrays([pa.array([*range(-3, 0), *at.tolist()], pa.int32()), pa.array([bias, slope, shift, *values.tolist()], pa.float64())], ["bucket", "value"])

    # The sample is bounded, and one task fits it; its order is by the draw, so the fit is the same in every run.
    few = rows.filter(drawn).select("label", "held", "text", "draw").repartition(1).sortWithinPartitions("draw", F.xxhash64("text"), "label").select("label", "held", "text")
    table = few.mapInArrow(train, "bucket int, value double").toArrow()
    sent.unpersist()
    bucket, value = table.column("bucket").to_numpy(), table.column("value").to_numpy()
    bias, slope, shift = (float(value[bucket == k][0]) for k in (-3, -2, -1))
    weights = np.zeros(BUCKETS, np.float32)
    weights[bucket[bucket >= 0]] = value[bucket >= 0]
    return Model(weights, np.square(ratio), bias, slope, shift)


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep` of `docs` with score (0 to 1) and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        model, ngrams = sent.value, Ngrams()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                scores = model.scores(model.margins([t.as_py() for t in part.column(1)], ngrams))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], ["row", "score"])

    found = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return found.select("row.*", "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op12_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, ~held_out())
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
