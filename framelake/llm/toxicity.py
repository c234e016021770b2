"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words and word beginnings is fitted with numpy from
confirmed toxic texts and a sample of all texts. The risk of the unlabelled
sample is corrected by the class prior, and its negative part is held at zero
or above, so that the toxic texts hidden in the sample don't count as clean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

#: Hashed features, and how many of them a model keeps.
BITS, KEPT = 20, 4_096
#: Bounds on the sample that a model is fitted on: confirmed texts and unlabelled ones.
MAX_POSITIVE, MAX_UNLABELLED = 3_000, 9_000
#: Bound on the distinct features of a text in that sample: of a text with more, those whose hash is lowest.
MAX_FEATURES = 8_192
#: Bytes of a word's beginning that make a feature of their own.
HEADS = (5, 7)
#: Bytes of text that a task works on at a time.
BATCH_BYTES = 1 << 20
#: Numbers of times from which a repeated feature makes another.
TIMES = (2, 4)

_LETTERS = np.ones(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature and row of every word and word beginning, repeats included."""
    data, at = K.buffer(K.lowered(texts))
    start, end, row = K.words(data, at, _LETTERS)
    out, rows = [K.hashes(data, start, end) >> np.uint64(64 - BITS)], [row]
    for k in HEADS:
        long = end - start > k
        out.append(K.mix(K.hashes(data, start[long], start[long] + k) + np.uint64(k)) >> np.uint64(64 - BITS))
        rows.append(row[long])
    return np.concatenate(out).astype(np.int32), np.concatenate(rows)


def _distinct(feature: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, row), with a further feature for what a row has twice or more, and four times or more. Sorted by row."""
    both, times = np.unique((row.astype(np.int64) << BITS) | feature, return_counts=True)
    out = [both]
    for k in TIMES:
        often = both[times >= k]
        f = K.mix((often & ((1 << BITS) - 1)).astype(np.uint64) + np.uint64(k << 40)) >> np.uint64(64 - BITS)
        out.append((often >> BITS << BITS) | f.astype(np.int64))
    both = np.unique(np.concatenate(out))
    return (both & ((1 << BITS) - 1)).astype(np.int32), both >> BITS


@dataclass(frozen=True)
class Model:
    """`weights[i]` belongs to the hashed feature `index[i]`; a text's score is the logistic of their sum over its distinct features."""

    index: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, texts: pa.Array) -> np.ndarray:
        table = np.zeros(1 << BITS, dtype=np.float32)
        table[self.index] = self.weights
        feature, row = _distinct(*features(texts))
        total = np.bincount(row, weights=table[feature], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _without_copies(rows: list[np.ndarray]) -> list[np.ndarray]:
    """One text of each group that shares three minimal feature hashes: near copies would make their own rare words look telling."""
    seen, out = set(), []
    for x in rows:
        h = x.astype(np.uint64)
        key = tuple(int(K.mix(h + np.uint64(s << 32)).min()) if len(h) else 0 for s in (1, 2, 3))
        if key not in seen:
            seen.add(key)
            out.append(x)
    return out


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, kept: int = KEPT, steps: int = 400, rate: float = 0.05, decay: float = 2e-4) -> Model:
    """Non-negative PU risk with the logistic loss, minimised by Adam on all rows at each step.

    `positive` and `unlabelled` hold each text's distinct features. Without
    positive texts the model gives every text the score 0.
    """
    if not positive or not unlabelled:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), -30.0, 0.0)
    positive, unlabelled = _without_copies(positive), _without_copies(unlabelled)
    n_p, n_u, size = len(positive), len(unlabelled), 1 << BITS
    count = lambda rows: np.bincount(np.concatenate(rows), minlength=size)
    in_p, in_u = count(positive), count(unlabelled)
    # a feature as usual in all texts as q times its share of confirmed ones bounds the prior by q: labels that aren't a fair sample can't raise it beyond that
    usual = in_p >= max(20, 0.05 * n_p)
    if usual.any():
        most = (in_u[usual] + 2 * np.sqrt(in_u[usual]) + 3) / n_u / (in_p[usual] / n_p)
        prior = min(prior, max(1e-3, float(most.min())))
    # features far more usual in confirmed texts than in all texts: at least three times, and by three standard errors
    share = (in_u + 0.5) / (n_u + 1)
    lift = (in_p / n_p - share) / np.sqrt(share * (1 - share) / n_p + 1e-12)
    lift[(in_p < max(3, 0.004 * n_p)) | (in_p / n_p < 3 * share)] = 0
    index = np.sort(np.argsort(-lift, kind="stable")[:kept])
    index = index[lift[index] > 3]
    place = np.full(size, -1, dtype=np.int64)
    place[index] = np.arange(len(index))

    def rows(of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row, col = np.repeat(np.arange(len(of)), [len(x) for x in of]), place[np.concatenate(of)]
        return row[col >= 0], col[col >= 0]

    (rp, cp), (ru, cu) = rows(positive), rows(unlabelled)
    w, b = np.zeros(len(index)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for t in range(1, steps + 1):
        fp = np.bincount(rp, weights=w[cp], minlength=n_p) + b
        fu = np.bincount(ru, weights=w[cu], minlength=n_u) + b
        # l(f) = log(1 + exp(-f)); its slope for a positive is -sig(-f), for a negative sig(f)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gp = -prior * sig(-fp) / n_p
        gu = np.zeros(n_u)
        if negative >= 0:
            gp, gu = gp - prior * sig(fp) / n_p, sig(fu) / n_u
        else:  # step back out of the region where the estimate of a risk is negative
            gp, gu = prior * sig(fp) / n_p, -sig(fu) / n_u
        g = np.bincount(cp, weights=gp[rp], minlength=len(w)) + np.bincount(cu, weights=gu[ru], minlength=len(w)) + decay * w
        gb = gp.sum() + gu.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return Model(index, w.astype(np.float32), float(b), prior)


def _feature_rows(batches):
    for whole in batches:
        for part in K.batches([whole], size=BATCH_BYTES):
            feature, row = _distinct(*features(part.column("text")))
            ends = np.searchsorted(row, np.arange(part.num_rows + 1))
            cells = [(feature[a:b] if b - a <= MAX_FEATURES else np.sort(feature[a:b])[:MAX_FEATURES]).tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.record_batch([part.column("positive").cast(pa.int32()), pa.array(cells, pa.binary())], names=["positive", "features"])


def train(docs: DataFrame, labels: DataFrame, *, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """A model from `labels` (doc_id, toxic) and the texts of `docs`.

    Fitted on a bounded sample: the `max_positive` confirmed texts and the
    `max_unlabelled` texts whose doc_id hashes lowest, one text of each id, with
    MAX_FEATURES features of each at most. The class prior is the
    share of toxic rows among all labels, unless the texts bound it lower. Null labels and ids are passed over.
    """
    spark = docs.sparkSession
    labels = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
    stats = labels.agg(F.avg((F.col("toxic") == 1).cast("int"))).first()[0]
    prior = min(0.9, max(1e-3, float(stats or 0)))

    def low(df: DataFrame, n: int) -> list[int]:
        """The n ids whose hash is lowest; where rows repeat ids among them, the repeats go first."""
        first = lambda d: [r[0] for r in d.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
        out = first(df)
        return out if len(set(out)) == len(out) else first(df.distinct())

    ids = [(i, 1) for i in low(labels.filter("toxic = 1").select("doc_id"), max_positive)]
    ids += [(i, 0) for i in low(docs.filter("doc_id IS NOT NULL").select("doc_id"), max_unlabelled)]
    if not ids:
        return fit([], [], prior)
    sample = docs.select("doc_id", "text").join(F.broadcast(spark.createDataFrame(ids, "doc_id long, positive int")), "doc_id")
    # of rows that share an id, one text: no more rows come to the driver than the two limits say
    sample = sample.groupBy("doc_id", "positive").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = sample.select("text", "positive").mapInArrow(_feature_rows, "positive int, features binary").collect()
    take = lambda y: [np.frombuffer(r["features"], dtype=np.int32) for r in rows if r["positive"] == y]
    return fit(take(1), take(0), prior)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` plus `toxicity` (0 to 1) of each whole text; null counts as empty. Rows and their other columns stay as they are."""
    docs = docs.drop("toxicity")
    cell = docs.sparkSession.sparkContext.broadcast(model)  # at most KEPT weights
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())])

    def run(batches):
        for whole in batches:
            for part in K.batches([whole], size=BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.value.score(part.column(text)), pa.float64())], [*part.schema.names, "toxicity"])

    return docs.mapInArrow(run, schema)


def op8_nnpu(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels are learned only from rows outside the held-out fifth, and so are the texts that the model is fitted on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = train(docs.filter(~held_out), labels.filter(~held_out))
    out = score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
