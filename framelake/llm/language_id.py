"""Language of each word, and of each text, by a linear-chain conditional random field.

A word's score for a language is the sum of learned weights of its affixes, its
byte n-grams and the word itself (the lexicon); learned transitions tie
neighbouring words. Forward-backward gives each word's marginal probabilities;
their mean over a text names its language. Texts that switch language are what
the chain is trained on: its sequences join pieces of different documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

#: Hashed features.
BITS = 17
#: Bounds on the sample that a model is fitted on: documents of each language, pieces of each document, words of each piece, bytes of each word.
DOCS_PER_LANG, PIECES, PIECE_WORDS, WORD_BYTES = 500, 32, 24, 64
#: Words of a chain that are worked on side by side with other stretches; what goes from one stretch to the next is exact.
STRETCH = 128

_LETTERS = np.ones(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _spans(texts: pa.Array):
    data, at = K.buffer(K.lowered(texts))
    return data, *K.words(data, at, _LETTERS)


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) of each affix, n-gram and whole word; spans are in ascending order."""
    n, size = np.arange(len(start)), end - start
    out, owner = [K.hashes(data, start, end)], [n]
    for k in (2, 3):
        long = size >= k
        for which, (a, b) in enumerate(((start[long], start[long] + k), (end[long] - k, end[long]))):
            out.append(K.mix(K.hashes(data, a, b) + np.uint64(8 * k + which)))
            owner.append(n[long])
    folded = K.FOLD[data].astype(np.uint64)
    for k in (2, 3):
        m = np.maximum(size - k + 1, 0)
        place = np.repeat(start - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        gram = folded[place]
        for i in range(1, k):
            gram = (gram << np.uint64(8)) | folded[place + i]
        out.append(K.mix(gram + np.uint64(k << 56)))
        owner.append(np.repeat(n, m))
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owner)


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, weights=values[:, k], minlength=n) for k in range(values.shape[1])], axis=1)


def forward_backward(emit: np.ndarray, real: np.ndarray, trans: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None, *, learn: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (B, T, K), pair marginals summed over all steps (K, K) and log partition (B) of B chains; `real` marks their words, which come first.

    `before` (B, K) weighs the first word's labels by the words before it, and
    `after` the last word's by those after it, where a chain is part of a longer one.
    Without `learn` the pair marginals stay 0.
    """
    B, steps, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    m = np.exp(trans)
    alpha, scale = np.empty_like(e), np.ones((B, steps))
    alpha[:, 0] = e[:, 0] if before is None else e[:, 0] * before
    for t in range(steps):
        if t:
            alpha[:, t] = np.where(real[:, t, None], (alpha[:, t - 1] @ m) * e[:, t], alpha[:, t - 1])
        scale[:, t] = alpha[:, t].sum(axis=1)
        alpha[:, t] /= scale[:, t, None]
    beta = np.ones((B, k)) if after is None else after
    marginal, pairs = np.empty_like(e), np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        marginal[:, t] = alpha[:, t] * beta
        marginal[:, t] /= marginal[:, t].sum(axis=1, keepdims=True)
        if t:
            right = e[:, t] * beta
            if learn:
                joint = (alpha[:, t - 1, :, None] * right[:, None, :]) * m
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                pairs += (joint * real[:, t, None, None]).sum(axis=0)
            back = right @ m.T
            beta = np.where(real[:, t, None], back / back.sum(axis=1, keepdims=True), beta)
    log_z = (np.log(scale) * real).sum(axis=1) + (emit.max(axis=2) * real).sum(axis=1)
    return marginal, pairs, log_z


def _stretch_products(emit: np.ndarray, real: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Of each stretch, the product (K, K) of its steps but for the transition into it, up to a factor."""
    e, m = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(trans)
    out = np.eye(emit.shape[2]) * e[:, 0, None, :]
    for t in range(1, emit.shape[1]):
        step = (out @ m) * e[:, t, None, :]
        out = np.where(real[:, t, None, None], step / step.sum(axis=(1, 2), keepdims=True), out)
    return out


def _messages(emit, real, trans: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the words before and after each stretch say of its first and last word. Stretches of one `chain` follow each other; `emit` and `real` give the scores and words of those asked for."""
    n, k = len(chain), len(trans)
    before, after = np.ones((n, k)), np.ones((n, k))
    joined = np.flatnonzero(chain[1:] == chain[:-1])
    if not len(joined):
        return before, after
    many = np.unique(np.concatenate([joined, joined + 1]))
    products, m = np.empty((n, k, k)), np.exp(trans)
    for a in range(0, len(many), 4_096):
        x = many[a : a + 4_096]
        products[x] = _stretch_products(emit(x), real(x), trans)
    # the k-th stretches of all chains go together
    place = np.arange(n) - np.searchsorted(chain, chain)
    order = np.argsort(place[joined], kind="stable")
    for x in np.split(joined[order], np.flatnonzero(np.diff(place[joined][order])) + 1):
        v = (before[x, None, :] @ products[x])[:, 0] @ m
        before[x + 1] = v / v.sum(axis=1, keepdims=True)
    for x in reversed(np.split(joined[order], np.flatnonzero(np.diff(place[joined][order])) + 1)):
        v = (products[x + 1] @ after[x + 1, :, None])[:, :, 0] @ m.T
        after[x] = v / v.sum(axis=1, keepdims=True)
    return before, after


@dataclass(frozen=True)
class Model:
    langs: list[str]
    weights: np.ndarray  # (features, languages)
    trans: np.ndarray

    def emissions(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Score of each word for each language; equal words are scored once."""
        h = K.hashes(data, start, end)
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        by = np.argsort(first)
        place = np.empty(len(by), dtype=np.int64)
        place[by] = np.arange(len(by))
        feature, owner = word_features(data, start[first[by]], end[first[by]])
        return _sums(owner, self.weights[feature], len(first)).astype(np.float32)[place[inverse]]

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row, and marginal probability of each language, of every word of whole texts."""
        data, start, end, row = _spans(texts)
        k = len(self.langs)
        if not len(start):
            return row, np.zeros((0, k), dtype=np.float32)
        emit = self.emissions(data, start, end)
        # stretches of STRETCH words of one row
        first = np.searchsorted(row, np.arange(len(texts) + 1))
        lo, hi = first[:-1], first[1:]
        n = -(-(hi - lo) // STRETCH)
        own = np.repeat(np.arange(len(texts)), n)
        begin = np.repeat(lo - (np.cumsum(n) - n) * STRETCH, n) + np.arange(int(n.sum())) * STRETCH
        stop = np.minimum(begin + STRETCH, hi[own])
        steps = np.arange(STRETCH)
        real = lambda x: begin[x, None] + steps < stop[x, None]
        scores = lambda x: np.where(real(x)[:, :, None], emit[np.minimum(begin[x, None] + steps, len(start) - 1)], 0)
        before, after = _messages(scores, real, self.trans, own)
        out = np.empty((len(start), k), dtype=np.float32)
        by = np.argsort(stop - begin, kind="stable")  # stretches of like length together
        for a in range(0, len(by), 1_024):
            x = by[a : a + 1_024]
            longest = int((stop - begin)[x].max())
            mine = real(x)[:, :longest]
            marginal, _, _ = forward_backward(scores(x)[:, :longest], mine, self.trans, before[x], after[x], learn=False)
            out[(begin[x, None] + steps[:longest])[mine]] = marginal[mine]
        return row, out

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language with the highest mean marginal, and that mean; -1 and 0 for texts without letters."""
        row, marginal = self.words(texts)
        n = np.bincount(row, minlength=len(texts))
        mean = _sums(row, marginal, len(texts)) / np.maximum(n, 1)[:, None]
        best = np.where(n > 0, mean.argmax(axis=1), -1)
        return best, np.where(n > 0, np.clip(mean.max(axis=1), 0, 1), 0.0)


def fit(pieces: list[tuple[str, str]], *, epochs: int = 3, rate: float = 0.3, decay: float = 1e-6, seed: int = 3, per_chain: int = 3, stay: float = 0.6, batch: int = 128) -> Model | None:
    """Maximum conditional likelihood by AdaGrad. `pieces`: (language, words joined by spaces).

    A chain is `per_chain` pieces; after each piece the chain stays with its
    language with probability `stay`, and otherwise goes on with a random
    piece, so that transitions are learned from real switches.
    """
    langs = sorted({x for x, _ in pieces})
    if not langs:
        return None
    k, rng = len(langs), np.random.default_rng(seed)
    label = np.array([langs.index(x) for x, _ in pieces])
    data, start, end, row = _spans(pa.array([t for _, t in pieces], pa.string()))
    h = K.hashes(data, start, end)
    _, first, word = np.unique(h, return_index=True, return_inverse=True)
    by = np.argsort(first)
    place = np.empty(len(by), dtype=np.int64)
    place[by] = np.arange(len(by))
    word = place[word]
    feature, owner = word_features(data, start[first[by]], end[first[by]])
    ends = np.searchsorted(owner := owner[o := np.argsort(owner, kind="stable")], np.arange(len(first) + 1))
    feature = feature[o]
    lo, hi = np.searchsorted(row, np.arange(len(pieces))), np.searchsorted(row, np.arange(len(pieces)), side="right")
    of_lang = [np.flatnonzero(label == c) for c in range(k)]
    w, gw = np.zeros((1 << BITS, k)), np.full((1 << BITS, k), 1e-6)
    trans, gt = np.zeros((k, k)), np.full((k, k), 1e-6)
    steps = np.arange(per_chain * PIECE_WORDS)
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        for x in range(0, len(order), batch):
            chain = [order[x : x + batch]]
            while len(chain) < per_chain:
                same = np.array([rng.choice(of_lang[c]) for c in label[chain[-1]]])
                chain.append(np.where(rng.random(len(same)) < stay, same, rng.integers(0, len(pieces), len(same))))
            idx = np.zeros((len(chain[0]), len(steps)), dtype=np.int64)
            gold, real = np.zeros_like(idx), np.zeros(idx.shape, dtype=bool)
            filled = np.zeros(len(chain[0]), dtype=np.int64)
            for p in chain:
                n = np.minimum(hi[p] - lo[p], PIECE_WORDS)
                for r in range(len(p)):
                    s = slice(filled[r], filled[r] + n[r])
                    idx[r, s], gold[r, s], real[r, s] = word[lo[p[r]] : lo[p[r]] + n[r]], label[p[r]], True
                filled += n
            used, inv = np.unique(idx[real], return_inverse=True)
            m = ends[used + 1] - ends[used]
            f = feature[np.repeat(ends[used] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
            mine = np.repeat(np.arange(len(used)), m)
            score = _sums(mine, w[f], len(used))
            emit = np.zeros((*idx.shape, k))
            emit[real] = score[inv]
            marginal, pairs, _ = forward_backward(emit, real, trans)
            grad = np.eye(k)[gold[real]] - marginal[real]
            g = _sums(inv, grad, len(used)) / len(idx)
            uf, fi = np.unique(f, return_inverse=True)
            g = _sums(fi, g[mine], len(uf)) - decay * w[uf]
            gw[uf] += g * g
            w[uf] += rate * g / np.sqrt(gw[uf])
            both = real[:, 1:] & real[:, :-1]
            seen = np.bincount(gold[:, :-1][both] * k + gold[:, 1:][both], minlength=k * k).reshape(k, k)
            g = (seen - pairs) / len(idx) - decay * trans
            gt += g * g
            trans += rate * g / np.sqrt(gt)
    return Model(langs, w.astype(np.float32), trans)


def _cut(batches):
    """Pieces of PIECE_WORDS words spread evenly over each whole text, PIECES at most."""
    for whole in batches:
        for part in K.batches([whole]):
            data, start, end, row = _spans(part.column("text"))
            first = np.searchsorted(row, np.arange(part.num_rows + 1)).tolist()
            langs, out = [], []
            for lang, a, b in zip(part.column("lang").to_pylist(), first[:-1], first[1:]):
                spots = range(a, b, PIECE_WORDS)
                step = max(1.0, len(spots) / PIECES)
                for i in range(min(PIECES, len(spots))):
                    s = spots[int(i * step)]
                    e = min(s + PIECE_WORDS, b)
                    langs.append(lang)
                    out.append(b" ".join(data[p:q].tobytes() for p, q in zip(start[s:e].tolist(), end[s:e].tolist()) if q - p <= WORD_BYTES))
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array([x.decode("utf-8") for x in out], pa.string())], names=["lang", "piece"])


def train(docs: DataFrame, *, docs_per_lang: int = DOCS_PER_LANG) -> Model | None:
    """A model from `text` and non-null `lang` of `docs`; None where there are none.

    Fitted on a bounded sample of distinct texts, chosen by their hash: about
    `docs_per_lang` of each language and never more than twice that on average,
    PIECES pieces of each, without words of more than WORD_BYTES bytes.
    """
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for kv in counts.items() for x in (kv[0], min(1.0, docs_per_lang / kv[1]))))
    chance = F.pmod(F.col("h"), F.lit(1_000_003)) / 1_000_003.0
    low = known.withColumn("h", F.xxhash64("text")).filter(chance < share[F.col("lang")])
    # copies count once, and each task drops its own before any text moves
    sample = low.groupBy("lang", "h").agg(F.first("text").alias("text")).orderBy(chance, "lang", "h").limit(2 * docs_per_lang * len(counts))
    rows = sample.select("lang", "text").mapInArrow(_cut, "lang string, piece string").collect()
    return fit(sorted((r[0], r[1]) for r in rows))


def identify(docs: DataFrame, model: Model | None, text: str = "text", *, words: bool = False) -> DataFrame:
    """`docs` plus `lang_pred` and `lang_score` of each whole text, and with `words` the language of every word in `lang_words`.

    The marginals are those of the chain over all words of the text. A null
    text, an empty one and one without letters give `und`, 0 and no
    words. So does every text if nothing was learned. Rows and other columns
    stay; columns of those names give way.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_words")
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), *([T.StructField("lang_words", T.ArrayType(T.StringType()))] if words else [])]
    cell = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights for each language

    def run(batches):
        m = cell.value
        for whole in batches:
            for part in K.batches([whole]):
                texts = part.column(text)
                if m is None:
                    best, score = np.full(len(texts), -1), np.zeros(len(texts))
                else:
                    best, score = m.predict(texts)
                names = pa.array(["und" if b < 0 else m.langs[b] for b in best], pa.string())
                more = []
                if words:
                    row, marginal = m.words(texts) if m else (np.zeros(0, dtype=np.int64), np.zeros((0, 1)))
                    of = [m.langs[i] for i in marginal.argmax(axis=1)] if m else []
                    ends = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
                    more = [pa.ListArray.from_arrays(pa.array(ends), pa.array(of, pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, names, pa.array(score, pa.float64()), *more], [*part.schema.names, *(f.name for f in fields)])

    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
    # bytes above 127 count as letters above; a text that has such signs alone has none
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return out.withColumns({"lang_pred": F.when(letters, F.col("lang_pred")).otherwise("und"), "lang_score": F.when(letters, F.col("lang_score")).otherwise(0.0)})


def op4_crf(spark, sf_dir: str) -> DataFrame:
    """All documents: the language of the whole text, by a model of the documents that aren't held out. A null text, and one without letters, is `und` with score 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs.filter(~held_out))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
