"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; everything else, labelled or not, is unlabelled text that holds
toxic texts too, at the class prior. The classifier is linear in numpy and minimises the non-negative
estimator of its risk,

    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-)),

with the logistic loss: the unlabelled texts' loss as negatives, less what the positives among them are
expected to add, which is kept from falling below zero (where it does, that step ascends it instead).

Features are hashed lower-cased words (letters and digits) and their stems (first bytes) in the whole text, each counted once and weighted
by the smoothed log ratio of its document shares among positives and all texts. Confirmed labels are noisy, so a
word counts only if its share of positives can't be chance given how many words are tested; a text's length
doesn't matter, so one such word in a long text isn't drowned. Margins become scores by Bayes' rule: the share
of positives at a margin, with the prior, made monotone (``calibrate``); a row's margin there comes from a fit that hasn't seen the row.

Document shares come from counts over all learning rows (``word_counts``). The fit uses a bounded sample:
``MAX_POSITIVE`` positives and ``MAX_UNLABELLED`` unlabelled rows by a hash of doc_id, as sparse rows. Every word that
counts is a feature; one that no row of the sample holds gets the mean weight of those that were fitted. Scoring is
one pass without a shuffle; the weights are a bounded array.

Defined results: null and empty texts score as a text without known words; without any positive every text
scores 0; rows that repeat a doc_id are scored each; a null doc_id never teaches; labels that
contradict one another count as toxic; an empty table gives an empty result. Other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootflow.llm.common import buffers, documents, map_batches, mix, slices, to_binary, word_hashes, written
from rootflow.llm.language import held_out

BUCKETS = 1 << 18
#: Bytes of a word that are features too.
STEMS = (5, 6, 7)
MIN_POSITIVE = 2
CHANCE = 0.02
MAX_POSITIVE = 2000
MAX_UNLABELLED = 6000
STEPS = 2500
#: Parts of the sample; each calibrates with a fit that has not seen it.
FOLDS = 4
#: The prior is kept within these, and comes from so many of the surest words.
LEAST_PRIOR, MOST_PRIOR = 0.002, 0.9
SUREST = 64
BATCH = 256
RATE = 0.05
DECAY = 1e-5
SEED = 7
THRESHOLD = 0.7

#: Letters, digits and all bytes beyond ASCII make up words; A-Z are lower-cased.
_PART = np.zeros(256, bool)
_PART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_words(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text its distinct buckets of words and stems, sorted."""
    offsets, data = buffers(column)
    for a, b in slices(offsets):
        o, d = offsets[a : b + 1] - offsets[a], _LOWER[data[offsets[a] : offsets[b]]]
        if not len(d):
            yield from (np.zeros(0, np.int32) for _ in range(b - a))
            continue
        part = _PART[d]
        first, last = np.ones(len(d), bool), np.ones(len(d), bool)
        first[1:], last[:-1] = ~part[:-1], ~part[1:]
        first[o[:-1][o[:-1] < len(d)]] = True
        last[o[1:][o[1:] > 0] - 1] = True
        starts, ends = np.flatnonzero(first & part), np.flatnonzero(last & part) + 1
        # Each word, and its first bytes: compounds share their stems.
        h = np.empty((len(starts), 1 + len(STEMS)), np.int32)
        h[:, 0] = word_hashes(d, starts, ends) % np.uint64(BUCKETS)
        for i, n in enumerate(STEMS):
            h[:, i + 1] = mix(word_hashes(d, starts, np.minimum(ends, starts + n)) + np.uint64(n)) % np.uint64(BUCKETS)
        own = np.searchsorted(starts, o)
        for x, y in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):
            yield np.unique(h[x:y])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), np.int64)
    n = np.zeros(2, np.int64)
    for b in batches:
        for toxic, at in zip(b.column(0).to_pylist(), text_words(b.column(1)), strict=True):
            total[int(toxic), at] += 1
            n[int(toxic)] += 1
    at = np.flatnonzero(total[1])  # only words of positives matter
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at]), pa.int32()), pa.array(np.concatenate([[n[1]], total[1][at]])), pa.array(np.concatenate([[n[0]], total[0][at]]))], ["bucket", "positive", "other"])


def _count_known(known: np.ndarray):
    """Counts of the known words alone: bounded rows for each task."""
    place = np.full(BUCKETS, -1, np.int32)
    place[known] = np.arange(len(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(known), np.int64), 0
        for b in batches:
            for at in text_words(b.column(0)):
                k = place[at]
                total[k[k >= 0]] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], known[at]]), pa.int32()), pa.array(np.concatenate([[n], total[at]]))], ["bucket", "n"])

    return run


def _rows(known: np.ndarray):
    place = np.full(BUCKETS, -1, np.int32)
    place[known] = np.arange(len(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k := place[at])[k >= 0].astype("<i4").tobytes() for at in text_words(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["rank", "words"])

    return run


@dataclass
class Model:
    known: np.ndarray  # buckets of the words that count, sorted
    weights: np.ndarray
    bias: float
    margins: np.ndarray
    scores: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(BUCKETS, np.float32)
        out[self.known] = self.weights
        return out


@dataclass
class Sparse:
    """Rows of features: row i has the values x[ends[i]:ends[i + 1]] in the columns at[ends[i]:ends[i + 1]]."""

    ends: np.ndarray
    at: np.ndarray
    x: np.ndarray
    width: int

    @classmethod
    def of(cls, dense: np.ndarray) -> Sparse:
        row, at = np.nonzero(dense)
        return cls(np.searchsorted(row, np.arange(len(dense) + 1)), at, dense[row, at], dense.shape[1])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def take(self, rows: np.ndarray) -> Sparse:
        n = self.ends[rows + 1] - self.ends[rows]
        ends = np.concatenate([[0], np.cumsum(n)])
        k = np.arange(ends[-1]) + np.repeat(self.ends[rows] - ends[:-1], n)
        return Sparse(ends, self.at[k], self.x[k], self.width)

    def margins(self, w: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.own(), self.x * w[self.at], minlength=len(self)) + bias

    def own(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ends))

    def weighted(self, s: np.ndarray) -> np.ndarray:
        """The sum of the rows times s; the bias is the last column."""
        return np.append(np.bincount(self.at, self.x * s[self.own()], minlength=self.width), s.sum())


def nn_pu(positive: np.ndarray | Sparse, unlabelled: np.ndarray | Sparse, prior: float, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, decay: float = DECAY, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier, from feature rows; Adam on the non-negative risk."""
    rng = np.random.default_rng(seed)
    p, u = (f if isinstance(f, Sparse) else Sparse.of(f) for f in (positive, unlabelled))
    w = np.zeros(p.width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        a, b = p.take(rng.integers(len(p), size=min(batch, len(p)))), u.take(rng.integers(len(u), size=min(4 * batch, len(u))))
        za, zb = a.margins(w, w[-1]), b.margins(w, w[-1])
        sa, sb = 1 / (1 + np.exp(-np.clip(za, -30, 30))), 1 / (1 + np.exp(-np.clip(zb, -30, 30)))
        negative = np.logaddexp(0, zb).mean() - prior * np.logaddexp(0, za).mean()
        g_negative = b.weighted(sb) / len(b) - prior * a.weighted(sa) / len(a)
        g = prior * a.weighted(sa - 1) / len(a) + g_negative if negative >= 0 else -g_negative
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0.0)  # every feature was chosen as a sign of positives
    return w[:-1], float(w[-1])


def calibrate(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Margins and the share of positives at each, rising: Bayes' rule with the prior, pooled until monotone.

    Around a margin, positives are ``prior * (share of positives) / (share of all texts)``."""
    z = np.concatenate([positive, unlabelled])
    mass_p = np.concatenate([np.full(len(positive), prior / len(positive)), np.zeros(len(unlabelled))])
    mass_u = np.concatenate([np.zeros(len(positive)), np.full(len(unlabelled), 1.0 / len(unlabelled))])
    at, which = np.unique(np.round(z, 6), return_inverse=True)
    p, u = np.bincount(which, mass_p), np.bincount(which, mass_u)
    blocks: list[list[float]] = []  # positives, all, least and greatest margin
    for m, x, y in zip(at.tolist(), p.tolist(), u.tolist(), strict=True):
        blocks.append([x, y, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            a = blocks[-1]
            a[0], a[1], a[3] = a[0] + b[0], a[1] + b[1], b[3]
    share = [min(1.0, b[0] / b[1]) if b[1] else 1.0 for b in blocks]
    return np.array([m for b in blocks for m in (b[2], b[3])]), np.array([x for x in share for _ in range(2)])


def train(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> Model | None:
    """A model from learning rows: documents (doc_id, text) and labels (doc_id, toxic)."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    stats = marked.agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n")).first()
    if not stats["p"]:
        return None
    prior = min(MOST_PRIOR, max(LEAST_PRIOR, stats["p"] / stats["n"]))
    rows = docs.where("doc_id is not null").select("doc_id", to_binary("text").alias("text"))
    # The ids of positives grow with the labels, so they are never broadcast; their texts are met once.
    positives = written(rows.join(marked.where("toxic = 1").select("doc_id").hint("merge"), "doc_id", "left_semi"), "positives")
    counted = map_batches(positives.select(F.lit(1).alias("toxic"), "text"), _count, "bucket int, positive long, other long").groupBy("bucket").agg(F.sum("positive").alias("positive")).toPandas()  # at most BUCKETS + 1 rows
    n_positive = int(counted.loc[counted["bucket"] < 0, "positive"].sum())
    if not n_positive:
        return None
    counted = counted[(counted["bucket"] >= 0) & (counted["positive"] >= MIN_POSITIVE)].sort_values("bucket")
    known = counted["bucket"].to_numpy().astype(np.int64)
    totals = map_batches(rows.select("text"), _count_known(known), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS + 1 rows
    share = dict(zip(totals["bucket"].tolist(), totals["n"].tolist(), strict=True))
    n_all = share.pop(-1, 0)
    in_all = np.array([share.get(int(k), 0) for k in known], float)
    in_positive = counted["positive"].to_numpy().astype(float)
    # A word counts if so large a share of positives among the texts that hold it is no chance: a Chernoff
    # bound on the binomial tail, at less than CHANCE wrong words expected among all that are tested.
    base = np.clip(n_positive / max(n_all, n_positive), 1e-9, 1 - 1e-9)
    in_all = np.maximum(in_all, in_positive)
    q = np.clip(in_positive / in_all, 1e-9, 1 - 1e-9)
    surprise = in_all * (q * np.log(q / base) + (1 - q) * np.log((1 - q) / (1 - base)))
    ratio = np.log((in_positive + 0.5) / (n_positive + 1.0)) - np.log((in_all + 0.5) / (n_all + 1.0))
    sure = (q > base) & (surprise > np.log(len(known) / CHANCE + 1.0))
    odds = (in_all / max(1, n_all)) / (in_positive / n_positive)
    known, ratio, surprise, odds = known[sure], ratio[sure], surprise[sure], odds[sure]
    if not len(known):
        return None

    rank = F.xxhash64(F.lit(seed), "doc_id")
    sampled = lambda f, most: map_batches(f.select(rank.alias("rank"), "text"), _rows(known), "rank long, words binary").orderBy("rank", "words").limit(most).collect()
    chosen = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, 1.2 * MAX_UNLABELLED / max(1, n_all)) * (1 << 30)))
    chosen_p = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, 1.2 * MAX_POSITIVE / max(1, n_positive)) * (1 << 30)))

    def sparse(found: list) -> Sparse:
        at = [np.frombuffer(r["words"], "<i4") for r in found]
        columns = np.concatenate([np.zeros(0, np.int64), *at]).astype(np.int64)
        return Sparse(np.concatenate([[0], np.cumsum([len(x) for x in at])]).astype(np.int64), columns, ratio[columns], len(known))

    p, u = sparse(sampled(positives.where(chosen_p), MAX_POSITIVE)), sparse(sampled(rows.where(chosen), MAX_UNLABELLED))
    if not len(p) or not len(u):
        return None
    # Labels may favour toxic texts. A word that only toxic texts hold is as frequent among all texts as among the
    # positives times the prior, so the surest words bound the prior from above.
    prior = min(prior, max(LEAST_PRIOR, float(np.median(odds[np.argsort(-surprise, kind="stable")[:SUREST]]))))

    def fit(p: Sparse, u: Sparse) -> tuple[np.ndarray, float]:
        w, bias = nn_pu(p, u, prior, seed=seed)
        seen = np.zeros(len(known), bool)
        seen[p.at] = seen[u.at] = True
        if seen.any():
            w[~seen] = w[seen].mean()
        return w, bias

    # Rows come by a hash of doc_id, so every so manieth is a random one: each part gets its margins from a fit of the
    # others. Too few rows for that are fitted and calibrate too.
    w, bias = fit(p, u)
    of_p, of_u = p.margins(w, bias), u.margins(w, bias)
    if len(p) >= FOLDS * MIN_POSITIVE and len(u) >= FOLDS:
        part_p, part_u = np.arange(len(p)) % FOLDS, np.arange(len(u)) % FOLDS
        for k in range(FOLDS):
            w_k, bias_k = fit(p.take(np.flatnonzero(part_p != k)), u.take(np.flatnonzero(part_u != k)))
            of_p[part_p == k] = p.take(np.flatnonzero(part_p == k)).margins(w_k, bias_k)
            of_u[part_u == k] = u.take(np.flatnonzero(part_u == k)).margins(w_k, bias_k)
    margins, scores = calibrate(of_p, of_u, prior)
    return Model(known, (w * ratio).astype(np.float32), bias, margins, scores)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows (doc_id, held_out, score) of (doc_id, text, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table() if model is not None else None
        for b in batches:
            out = np.zeros(b.num_rows)
            if model is not None:
                z = np.array([float(table[at].sum()) for at in text_words(b.column(1))]) + model.bias
                out = np.interp(z, model.margins, model.scores)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out)], ["doc_id", "held_out", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), to_binary("text").alias("text"), "held_out"), run, "doc_id long, held_out boolean, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", held_out(3, 1).alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(3, 1)).select("doc_id", "toxic")
    model = train(docs.where("not held_out").select("doc_id", "text"), labels)
    return score(docs, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
