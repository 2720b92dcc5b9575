"""Toxicity by a convolutional text classifier, trained and applied in numpy.

A word is the sum of hashed embeddings of itself and of two of its prefixes; filters of several widths
slide over the words of a text; the greatest response of each filter anywhere in the text feeds one
logistic unit. The scale of the score is set on labelled rows kept out of the training, so that 0.3 is
the cut with the best F1; further cuts are calibrated by language for `flagged`, outside the score.

Scale: every labelled row is learned from; only texts that a Bloom filter of the labelled ids lets through shuffle. Up to `sample` rows a class train in one task; beyond, that model is
where a round over all rows starts: each part of them trains its own copy, and what the parts changed is summed by
a grouping and averaged. Cuts come from counts of all calibration rows by logit. The model is a few megabytes,
comes to the driver and is broadcast. Scoring is one narrow pass over whole texts, with no shuffle.
"""

from __future__ import annotations

import math
import pickle
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, frugal, read
from .sketches import bloom

WIDTHS = (1, 2, 3)
PREFIXES = (4, 5)
CUT = 0.3
#: Rows and characters of one part of a training round.
PART_ROWS, PART_CHARS = 4_000, 1 << 24
#: Logits are counted in bins of this width, between -LOGITS and LOGITS.
BIN, LOGITS = 1e-3, 50.0
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def features(word: str, buckets: int) -> tuple[int, ...]:
    """Buckets of a word and of its prefixes; bucket 0 stays empty."""
    w = word.strip(_STRIP) or word
    return tuple(1 + xxhash.xxh3_64_intdigest(x) % (buckets - 1) for x in (w, *(f"{p}<{w[:p]}" for p in PREFIXES)))


class Words:
    """Texts of a batch as indices into its distinct words, two empty words (index 0) after each text."""

    def __init__(self, texts: list[list[str]], buckets: int):
        known: dict[str, int] = {}
        flat: list[int] = []
        self.start = np.zeros(len(texts), np.int64)
        pad = [0] * max(WIDTHS)
        for k, ws in enumerate(texts):
            self.start[k] = len(flat)
            flat += [known.setdefault(w, len(known) + 1) for w in ws]
            flat += pad
        self.index = np.array(flat, np.int64)
        self.end = np.append(self.start[1:], len(flat))
        self.buckets = np.zeros((len(known) + 1, 1 + len(PREFIXES)), np.int64)
        for w, k in known.items():
            self.buckets[k] = features(w, buckets)


class Model:
    def __init__(self, buckets: int, dim: int, filters: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
        self.emb[0] = 0
        self.w = {n: rng.normal(0, 1 / math.sqrt(n * dim), (n, dim, filters)).astype(np.float32) for n in WIDTHS}
        self.b = {n: np.zeros(filters, np.float32) for n in WIDTHS}
        self.out = rng.normal(0, 0.1, len(WIDTHS) * filters).astype(np.float32)
        self.bias = np.float32(-1.0)
        self.scale, self.shift = 1.0, 0.0
        self.cuts: dict[str, float] = {}

    def responses(self, words: Words) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """(texts, filters) greatest responses after ReLU, and the responses at every place."""
        vec = self.emb[words.buckets].sum(axis=1)
        maps, pooled = {}, []
        for n, w in self.w.items():
            m = len(words.index) - n + 1
            r = np.repeat(self.b[n][None], m, axis=0)
            for k in range(n):
                r += (vec @ w[k])[words.index[k : k + m]]
            maps[n] = r
            pooled.append(np.maximum(0, np.maximum.reduceat(r, words.start, axis=0)))
        return np.concatenate(pooled, axis=1), maps

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return (self.responses(Words(texts, len(self.emb)))[0] @ self.out + self.bias).astype(float)

    def flat(self) -> np.ndarray:
        """All that is trained as one matrix of rows as wide as an embedding: first the embeddings."""
        dense = np.concatenate([*(self.w[n].transpose(0, 2, 1).ravel() for n in WIDTHS), *(self.b[n] for n in WIDTHS), self.out, [self.bias]]).astype(np.float32)
        dim = self.emb.shape[1]
        return np.concatenate([self.emb, np.resize(np.append(dense, np.zeros(-len(dense) % dim, np.float32)), (-(-len(dense) // dim), dim))])

    def load(self, flat: np.ndarray) -> None:
        self.emb = flat[: len(self.emb)].astype(np.float32)
        dense, at = flat[len(self.emb) :].astype(np.float32).ravel(), 0

        def take(shape):
            nonlocal at
            at += math.prod(shape)
            return dense[at - math.prod(shape) : at].reshape(shape).copy()

        self.w = {n: take((n, w.shape[2], w.shape[1])).transpose(0, 2, 1).copy() for n, w in self.w.items()}
        self.b = {n: take(b.shape) for n, b in self.b.items()}
        self.out = take(self.out.shape)
        self.bias = np.float32(take((1,))[0])

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(texts) + self.shift, -30, 30)))


class Adam:
    """Adam on rows: only rows with a gradient move."""

    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, value, grad, rows=slice(None)):
        self.t += 1
        self.m[rows] = 0.9 * self.m[rows] + 0.1 * grad
        self.v[rows] = 0.99 * self.v[rows] + 0.01 * grad * grad
        value[rows] -= self.rate * (self.m[rows] / (1 - 0.9**self.t)) / (np.sqrt(self.v[rows] / (1 - 0.99**self.t)) + 1e-6)


def train(texts: list[list[str]], labels: np.ndarray, *, buckets: int = 1 << 16, dim: int = 16, filters: int = 12, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 1, start: Model | None = None, positive: float | None = None) -> Model:
    """Minimise weighted log loss; max pooling passes gradients to the winning places only.

    From the weights of `start`, if given, which are copied; `positive` is the share of label 1, if not that of these labels.
    """
    model, rng = Model(buckets, dim, filters, seed), np.random.default_rng(seed)
    if start is not None:
        model.load(start.flat())
    by = {"emb": Adam(model.emb.shape, rate), "out": Adam(model.out.shape, rate), "bias": Adam((1,), rate)} | {("w", n): Adam(model.w[n].shape, rate) for n in WIDTHS} | {("b", n): Adam(model.b[n].shape, rate) for n in WIDTHS}
    positive = max(1e-6, labels.mean() if positive is None else positive)
    weight = np.where(labels == 1, 0.5 / positive, 0.5 / max(1e-6, 1 - positive)).astype(np.float32)
    bias = np.array([model.bias], np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            words = Words([texts[k] for k in pick], buckets)
            pooled, maps = model.responses(words)
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + bias[0], -30, 30)))
            dz = ((p - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            dpool = dz[:, None] * model.out[None] * (pooled > 0)
            vec = model.emb[words.buckets].sum(axis=1)
            dvec = np.zeros_like(vec)
            grads = {"out": pooled.T @ dz + 1e-5 * model.out, "bias": np.array([dz.sum()], np.float32)}
            for j, n in enumerate(WIDTHS):
                d = dpool[:, j * filters : (j + 1) * filters]
                top = np.stack([maps[n][s : max(s + 1, min(e, len(maps[n])))].argmax(axis=0) + s for s, e in zip(words.start, words.end)])
                gw = np.zeros_like(model.w[n])
                for k in range(n):
                    ids = words.index[top + k]  # (texts, filters)
                    gw[k] = np.einsum("tf,tfd->df", d, vec[ids])
                    np.add.at(dvec, ids.ravel(), (d[:, :, None] * model.w[n][k].T[None]).reshape(-1, dim))
                grads["w", n], grads["b", n] = gw, d.sum(axis=0)
            dvec[0] = 0
            moved = np.flatnonzero(np.any(dvec != 0, axis=1))
            rows, back = np.unique(words.buckets[moved], return_inverse=True)
            demb = np.zeros((len(rows), dim), np.float32)
            np.add.at(demb, back.reshape(-1), np.repeat(dvec[moved], words.buckets.shape[1], axis=0))
            if len(rows):
                by["emb"].step(model.emb, demb, rows)
            for n in WIDTHS:
                by["w", n].step(model.w[n], grads["w", n])
                by["b", n].step(model.b[n], grads["b", n])
            by["out"].step(model.out, grads["out"])
            by["bias"].step(bias, grads["bias"])
    model.bias = np.float32(bias[0])
    return model


def best_cut(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The value between two neighbouring logits at which z >= cut has the best F1; the middle of the widest such gap. n: rows at each logit, of which y have label 1."""
    order = np.argsort(-z, kind="stable")
    zs, hit = z[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.cumsum(np.ones(len(z)) if n is None else n[order]) + y.sum())
    gap = np.append(zs[:-1] - zs[1:], 1.0)
    f1[gap <= 0] = -1
    top = f1 >= f1.max() - 1e-9
    k = int(np.flatnonzero(top)[np.argmax(gap[top])])
    return float(zs[k] - min(gap[k], 2.0) / 2)


def calibrate(model: Model, z: np.ndarray, y: np.ndarray, lang: list[str | None], least: int = 20) -> Model:
    """Put the best cut at a score of CUT, and cuts by language beside it where labels allow."""
    _scaled(model, best_cut(z, y), float(np.std(z)))
    for name in sorted({x for x in lang if x is not None}):
        at = np.array([x == name for x in lang])
        if y[at].sum() >= least and (1 - y[at]).sum() >= least:
            model.cuts[name] = _score_at(model, best_cut(z[at], y[at]))
    return model


def _scaled(model: Model, cut: float, spread: float) -> None:
    model.scale = 2.0 / max(1e-3, spread)
    model.shift = math.log(CUT / (1 - CUT)) - model.scale * cut


def _score_at(model: Model, z: float) -> float:
    return float(1 / (1 + math.exp(-max(-30.0, min(30.0, model.scale * z + model.shift)))))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, lang_col: str | None, folds) -> DataFrame:
    """fold, id, text, y, lang of every labelled row from the given folds of crc32(id) % 4."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(lang_col) if lang_col else F.lit(None)).cast("string").alias("lang"))
    pool = _pool(labels, id_col, label_col, folds)
    # one plan for all sizes
    return _candidates(rows, pool, folds).join(pool.hint("merge"), "id").select("fold", "id", "text", "y", "lang")


def _candidates(rows: DataFrame, pool: DataFrame, folds) -> DataFrame:
    """The rows whose id is in the pool, and a few others: what a Bloom filter of the pool's ids lets through, so that other texts do not shuffle. Ids of two types are left to the join, unless both are integers."""
    whole = ("tinyint", "smallint", "int", "bigint")
    kinds = {x.schema["id"].dataType.simpleString() for x in (rows, pool)}
    if len(kinds) > 1 and not kinds <= set(whole):
        return rows
    key = F.xxhash64(F.col("id").cast("long") if kinds <= set(whole) else F.col("id"))
    seen = rows.sparkSession.sparkContext.broadcast(bloom(pool.select(key), pool.count()))

    @F.pandas_udf("boolean")
    def labelled_id(key: pd.Series) -> pd.Series:
        return pd.Series(seen.value.has(key.to_numpy(np.int64).view(np.uint64)))

    return rows.where((F.crc32(F.col("id").cast("string")) % 4).isin(*folds)).where(labelled_id(key))


def _pool(labels: DataFrame, id_col: str, label_col: str, folds) -> DataFrame:
    fold = F.crc32(F.col(id_col).cast("string")) % 4
    return labels.where(fold.isin(*folds)).select(F.col(id_col).alias("id"), fold.cast("int").alias("fold"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1)").dropDuplicates(["id"])


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, lang_col: str | None, sample: int, sample_chars: int, folds) -> DataFrame:
    """fold, id, text, y, lang of at most `sample` labelled rows of each class, those with the least hashes, from the given folds of crc32(id) % 4; texts of more than `sample_chars` characters are left out of the sample."""
    pool = _pool(labels, id_col, label_col, folds)
    few = [pool.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    ids = F.broadcast(few[0].unionByName(few[1]))  # 2 * sample rows of three numbers at most
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    rows = docs.where(F.length(text_col) <= sample_chars).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("lang")).join(ids, "id")
    return rows.select("fold", "id", "text", "y", "lang")


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, lang_col: str | None, sample: int, sample_chars: int, folds) -> list:
    """The rows of `sampled`, in order of id and text."""
    return sorted(map(tuple, sampled(docs, labels, id_col, text_col, label_col, lang_col, sample, sample_chars, folds).collect()), key=lambda r: (r[1], r[2]))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = "lang", sample: int = 3_000, sample_chars: int = 200_000, train_folds=(0, 3), calibration_folds=(1,)) -> Model | float:
    """A calibrated model; a constant score where the labels have one class only (0 without labels).

    One task trains on `sample` rows a class and texts of `sample_chars` characters at most. Where there are more rows or
    longer texts, it is the start of a round over all of them (`_round`), and all calibration rows set the cuts.
    """
    args = (docs, labels, id_col, text_col, label_col, lang_col)
    space = Workspace(docs.sparkSession, "toxicity")
    rows = space.table(labelled(*args, (*train_folds, *calibration_folds)))
    try:
        return _fitted(rows, args, sample, sample_chars, train_folds, calibration_folds)
    finally:
        space.drop(rows)  # the model is in the driver


def _fitted(rows: DataFrame, args, sample: int, sample_chars: int, train_folds, calibration_folds) -> Model | float:
    inner = F.col("fold").isin(*train_folds)
    found = rows.groupBy("y", inner.alias("inner")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest")).collect()
    in_class = {y: sum(r.n for r in found if r.y == y) for y in (0, 1)}
    if not in_class[0] or not in_class[1]:
        return float(in_class[1] > 0)
    whole = max(in_class.values()) <= sample and max(r.longest or 0 for r in found) <= sample_chars
    few = rows if whole else sampled(*args, sample, sample_chars, (*train_folds, *calibration_folds))
    first = few.repartition(1).mapInArrow(frugal(_trained(train_folds)), "model binary").first()
    model = pickle.loads(first.model) if first else 0.0
    if whole:
        return model
    if len({(r.y, r.inner) for r in found}) < 4:
        inner = F.lit(True)  # as in fit_rows
    parts = [r for r in found if r.inner or len(found) < 4]
    model = _round(rows.where(inner), model if isinstance(model, Model) else Model(1 << 16, 16, 12), sum(r.n for r in parts), sum(r.chars or 0 for r in parts), sum(r.n for r in parts if r.y == 1))
    return _calibrated(rows.where(~inner if len(found) == 4 else F.lit(True)), model)


def _round(rows: DataFrame, model: Model, n: int, chars: int, positives: int) -> Model:
    """The model after each part of all rows has trained a copy of it: a row of the weights moves by the mean of what the parts that used it changed."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    parts, dim = max(1, -(-n // PART_ROWS), -(-chars // PART_CHARS)), model.emb.shape[1]
    names = [f"d{k}" for k in range(dim)]
    epochs = max(1, min(20, 12_000 // n))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(text=pdf["text"].fillna("")).sort_values(["id", "text"])
        toks = [[sys.intern(w) for w in tokens(t)] for t in pdf.pop("text")]
        buckets = len(shared.value.emb)
        moved = train(toks, pdf["y"].to_numpy(np.float32), buckets=buckets, dim=dim, filters=shared.value.b[1].size, epochs=epochs, start=shared.value, positive=positives / n).flat() - shared.value.flat()
        at = np.flatnonzero(np.any(moved != 0, axis=1) | (np.arange(len(moved)) >= buckets))
        return pd.DataFrame(moved[at].astype(float), columns=names).assign(at=at)[["at", *names]]

    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), "id", "text", "y")
    moved = dealt.groupBy("part").applyInPandas(run, ", ".join(["at long", *(f"{c} double" for c in names)]))
    # as many rows as the model has, whatever the input
    means = moved.groupBy("at").agg(*[F.avg(c).alias(c) for c in names]).toPandas()
    flat = model.flat().astype(float)
    flat[means["at"].to_numpy()] += means[names].to_numpy()
    out = Model(len(model.emb), dim, model.b[1].size)
    out.load(flat)
    return out


def _calibrated(rows: DataFrame, model: Model, least: int = 20) -> Model:
    """As `calibrate`, by counts of all rows at each logit, which are BIN apart."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            z = np.concatenate([np.zeros(0), *(shared.value.logits([tokens(x.as_py()) for x in batch.column(0).slice(k, 100)]) for k in range(0, batch.num_rows, 100))])
            at = np.rint(np.clip(z, -LOGITS, LOGITS) / BIN).astype(np.int64)
            yield pa.record_batch([pa.array(at), batch.column(1), batch.column(2)], names=["at", "y", "lang"])

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "cut": [best_cut(pdf["at"].to_numpy() * BIN, pdf["y"].to_numpy(float), pdf["n"].to_numpy(float))]})

    space = Workspace(rows.sparkSession, "cuts")
    counts = space.table(rows.select("text", "y", "lang").mapInArrow(frugal(run), "at long, y int, lang string").groupBy("lang", "at").agg(F.count("*").alias("n"), F.sum("y").alias("y")))
    every = counts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).toPandas()  # 2 * LOGITS / BIN rows at most
    z, n = every["at"].to_numpy() * BIN, every["n"].to_numpy(float)
    mean = np.average(z, weights=n)
    _scaled(model, best_cut(z, every["y"].to_numpy(float), n), float(np.sqrt(np.average((z - mean) ** 2, weights=n))))
    enough = counts.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).where((F.col("y") >= least) & (F.col("n") - F.col("y") >= least)).select("lang")
    for r in counts.join(enough, "lang").groupBy("lang").applyInPandas(cut, "lang string, cut double").orderBy("lang").collect():
        model.cuts[r.lang] = _score_at(model, r.cut)
    space.drop(counts)
    return model


def _trained(train_folds):
    """mapInArrow function: all rows of the sample -> one row, the model."""

    def run(batches):
        rows = [tuple(r.values()) for batch in batches for r in batch.to_pylist()]
        yield pa.record_batch([pa.array([pickle.dumps(fit_rows(sorted(rows, key=lambda r: (r[1], r[2])), train_folds))], pa.binary())], names=["model"])

    return run


def fit_rows(rows: list, train_folds=(0, 3)) -> Model | float:
    """The model of rows (fold, id, text, y, lang): trained on some folds, calibrated on the others."""
    y = np.array([r[3] for r in rows])
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    toks = [[sys.intern(w) for w in tokens(r[2])] for r in rows]  # one object a word, not one an occurrence
    rows = [(*r[:2], None, *r[3:]) for r in rows]
    inner = np.array([r[0] in train_folds for r in rows])
    if len(np.unique(y[inner])) < 2 or len(np.unique(y[~inner])) < 2:
        inner = np.ones(len(rows), bool)
    # small samples need more passes over them
    model = train([t for t, k in zip(toks, inner) if k], y[inner].astype(np.float32), epochs=max(6, min(40, 12_000 // int(inner.sum()))))
    held = ~inner if (~inner).any() else inner
    z = np.concatenate([model.logits([t for t, k in zip(toks[i : i + 500], held[i : i + 500]) if k]) for i in range(0, len(toks), 500)])
    return calibrate(model, z, y[held].astype(float), [r[4] for r, k in zip(rows, held) if k])


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            out, part, n = [], [], 0
            for x in batch.column(1):
                part.append(tokens(x.as_py()))
                n += len(part[-1]) + 1
                if n > 100_000:
                    out.append(model if isinstance(model, float) else model.scores(part))
                    out[-1] = np.full(len(part), out[-1]) if isinstance(model, float) else out[-1]
                    part, n = [], 0
            if part:
                out.append(np.full(len(part), model) if isinstance(model, float) else model.scores(part))
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64()), *batch.columns[2:]], names=["id", "score", *batch.schema.names[2:]])

    return run


def toxicity(docs: DataFrame, model: Model | float, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per row of docs: id, score, predicted, threshold of the row's language, flagged.

    Null and empty texts are scored as texts without words. Rows of a language without its own
    threshold, or of none, take the general one. Ids may repeat; other columns are not looked at; an
    empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.cast("string").alias("lang")).mapInArrow(frugal(_score(shared)), f"id {kind}, score double, lang string")
    cuts = {} if isinstance(model, float) else model.cuts
    threshold = F.lit(CUT)
    for name, cut in cuts.items():
        threshold = F.when(F.col("lang") == name, F.lit(cut)).otherwise(threshold)
    out = out.withColumn("threshold", threshold).withColumn("flagged", F.col("score") >= F.col("threshold"))
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "threshold", "flagged")


def _clean(shared, text: int, lang: int | None):
    def run(batches):
        model = shared.value
        cuts = {} if isinstance(model, float) else model.cuts
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                texts = [tokens(x.as_py()) for x in part.column(text)]
                s = np.full(len(texts), model) if isinstance(model, float) else model.scores(texts)
                cut = [cuts.get(x.as_py(), CUT) for x in part.column(lang)] if lang is not None else CUT
                yield part.filter(pa.array(s < np.array(cut)))

    return run


def keep_clean(docs: DataFrame, model: Model | float, *, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of docs, as they are, that are not flagged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(frugal(_clean(shared, docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col else None)), docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = toxicity(docs, fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", "predicted", "threshold", "flagged")
