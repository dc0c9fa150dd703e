"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the character n-grams (1 to ``MAX_N`` code points, lower-cased by simple case folding of the
code points, white space runs as one blank) of the whole text, hashed into ``BUCKETS`` buckets. A feature is its
share of the text's n-grams times its inverse document frequency, times a constant. Document frequencies
are counted over every learning row, not over a sample.

Weights are learned by follow-the-regularised-leader (per-coordinate learning rates) with elastic-net penalties:
the L1 part keeps most weights exactly zero, the L2 part bounds the rest. The fit uses a bounded sample of
labelled rows (``SAMPLE_PER_LANGUAGE`` rows expected for each language, chosen by a hash of doc_id; where all would
be more than ``MAX_SAMPLE`` rows or ``MAX_SAMPLE_BYTES``, the same number of each language that has as many); a quarter of
the sample is held back from the weights, and one temperature is fitted on it so that scores are
probabilities.

Scoring is one pass without a shuffle: the model (buckets x languages) is a bounded array that goes along with
the function.

Defined results: a text that is null or has no letter is ``und`` with score 0; without learning rows every text is
``und``; rows that repeat a doc_id are scored each; an empty table gives an empty result. Rows with a null doc_id
never teach. Other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootflow.llm.common import documents, free_name, map_batches, slices, written

BUCKETS = 1 << 15
MAX_N = 3
SAMPLE_PER_LANGUAGE = 600
MAX_SAMPLE = 6000
#: Bytes of the sample's features; rows beyond go, in the same turns.
MAX_SAMPLE_BYTES = 128 << 20
SCALE = 40.0
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
SEED = 2
UNKNOWN = "und"
_LETTER = r"\p{L}"


def _fold() -> np.ndarray:
    """For each code point of the basic plane its folded code point; white space is a blank."""
    table = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        if 0xD800 <= c <= 0xDFFF:
            continue
        s = chr(c)
        low = s.lower()
        table[c] = 32 if s.isspace() else ord(low) if len(low) == 1 else c
    return table


_folded: list[np.ndarray] = []


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams of all texts, and each text's share as offsets. Grams lie text by text."""
    if not _folded:
        _folded.append(_fold())
    raw = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    code = np.where(raw < (1 << 16), _folded[0][np.minimum(raw, (1 << 16) - 1)], raw)
    # Runs of blanks are one.
    blank = code == 32
    again = np.zeros(len(code), bool)
    again[1:] = blank[1:] & blank[:-1]
    starts = offsets[:-1][offsets[:-1] < len(code)]
    again[starts] = False
    keep = ~again
    offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
    code = code[keep]
    own = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    h = np.zeros(len(code), np.uint32)
    parts, docs = [], []
    for n in range(1, MAX_N + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + code[n - 1 :] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        inside = own[:m] == own[n - 1 :]
        x = h * np.uint32(0x85EBCA6B)
        parts.append(((x ^ (x >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int32)[inside])
        docs.append(own[:m][inside])
    if not parts:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    # Text by text: each text's grams of length 1, then 2, then 3.
    counts = np.stack([np.bincount(d, minlength=len(texts)) for d in docs])
    ends = np.concatenate([[0], np.cumsum(counts.sum(axis=0))])
    out = np.empty(ends[-1], np.int32)
    before = ends[:-1].copy()
    for p, d, c in zip(parts, docs, counts, strict=True):
        first = np.cumsum(c) - c
        out[np.arange(len(p)) - first[d] + before[d]] = p
        before += c
    return out, ends


def some_texts(column: pa.Array) -> Iterator[list[str]]:
    texts = column.to_pylist()
    sizes = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for a, b in slices(sizes, 1 << 19):
        yield texts[a:b]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, inverse document frequency and scale within
    bias: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Texts x languages."""
        buckets, ends = grams(texts)
        n = np.diff(ends)
        out = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(n)
        if len(some):
            out[some] = np.add.reduceat(self.weights[buckets], ends[:-1][some], axis=0, dtype=np.float64) / n[some, None]
        z = (out + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each bucket's number of texts that hold it, and in bucket -1 the number of texts."""
    total, n = np.zeros(BUCKETS, np.int64), 0
    for b in batches:
        for texts in some_texts(b.column(0)):
            buckets, ends = grams(texts)
            n += len(texts)
            for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                total[np.bincount(buckets[x:y], minlength=BUCKETS) > 0] += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at]), pa.int32()), pa.array(np.concatenate([[n], total[at]]))], ["bucket", "df"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, counts = [], []
        for texts in some_texts(b.column(2)):
            buckets, ends = grams(texts)
            for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                u, c = np.unique(buckets[x:y], return_counts=True)
                ids.append(u.astype("<i4").tobytes())
                counts.append(c.astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["rank", "lang", "ids", "counts"])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, buckets: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets x classes) and bias from rows (buckets, values, class)."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))
    order = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        zz, penalty = z[at], np.where(at == buckets, 0.0, l1)[:, None]
        return np.where(np.abs(zz) <= penalty, 0.0, -(zz - np.sign(zz) * penalty) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, buckets), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            was = n[at]
            now = was + g * g
            z[at] += g - (np.sqrt(now) - np.sqrt(was)) / alpha * w
            n[at] = now
    w = weights(np.arange(buckets + 1))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of the least log loss, by golden section on its logarithm."""
    if not len(logits):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), classes]))

    lo, hi, ratio = -0.7, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text has that remainder; a null doc_id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(True))


def train(rows: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, seed: int = SEED) -> Model | None:
    """A model from (doc_id, text, lang) with texts that have a letter and languages that aren't null."""
    by_language = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not by_language:
        return None
    languages = sorted(by_language)
    df = np.zeros(BUCKETS)
    counted = map_batches(rows.select("text"), _counts, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()  # at most BUCKETS + 1 rows
    total = int(counted.loc[counted["bucket"] < 0, "df"].sum())
    seen = counted[counted["bucket"] >= 0]
    df[seen["bucket"].to_numpy()] = seen["df"].to_numpy()
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0

    # The sample: a share of each language by a hash of doc_id, at most MAX_SAMPLE rows, language by language in turn.
    rank = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40))
    share = F.element_at(F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / by_language[lang]))]), F.col("lang"))
    chosen = rows.withColumn("rank", rank).where(F.col("rank") < share * float(1 << 40)).select("rank", "lang", "text")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "ids"))
    dealt = map_batches(chosen, _features, "rank long, lang string, ids binary, counts binary").withColumn("turn", turn)
    in_turns = ["turn", "rank", "lang", "ids"]
    dealt = written(dealt.orderBy(*in_turns).limit(MAX_SAMPLE), "language-sample")
    sizes = dealt.orderBy(*in_turns).select((2 * F.octet_length("ids")).alias("n")).collect()
    most = max(1, int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), MAX_SAMPLE_BYTES, side="right")))
    sample = dealt.orderBy(*in_turns).limit(most).collect()
    sample.sort(key=lambda r: (r["rank"], r["lang"], bytes(r["ids"])))
    data, number = [], {lang: i for i, lang in enumerate(languages)}
    for r in sample:
        ids, c = np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["counts"], "<i4")
        data.append((ids, SCALE * c / c.sum() * idf[ids], number[r["lang"]]))
    fit = [x for i, x in enumerate(data) if i % 4 or len(data) < 20]
    check = [x for i, x in enumerate(data) if not i % 4] if len(data) >= 20 else data
    w, bias = ftrl(fit, len(languages), BUCKETS, EPOCHS, ALPHA, BETA, L1, L2, seed)
    logits = np.array([x @ w[ids] + bias for ids, x, _ in check])
    return Model(languages, (w * (SCALE * idf)[:, None]).astype(np.float32), bias, temperature(logits, np.array([y for *_, y in check])))


def predict(docs: DataFrame, model: Model | None, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the language and its score to the documents; columns of those names are replaced, all others stay."""
    docs = docs.drop(language, score)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    has_letter = F.coalesce(F.col("text").rlike(_LETTER), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            named, scores = [], []
            texts = pa.array([t if ok else "" for t, ok in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)], pa.string())
            if model is not None:
                for some in some_texts(texts):
                    p = model.probabilities(some)
                    top = p.argmax(axis=1)
                    named += [model.languages[i] for i in top]
                    scores.append(p[np.arange(len(top)), top])
            sure = np.concatenate(scores) if scores else np.zeros(b.num_rows)
            ok = np.array(b.column(b.num_columns - 1).to_pylist(), bool) & (model is not None)
            named = [n if o else UNKNOWN for n, o in zip(named or [UNKNOWN] * b.num_rows, ok, strict=True)]
            columns = [b.column(i) for i in range(b.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(named, pa.string()), pa.array(np.where(ok, sure, 0.0))], [*b.schema.names[:-2], language, score])

    with_text = docs.select("*", F.coalesce("text", F.lit("")).alias(free_name("whole_text", docs)), has_letter.alias(free_name("has_letter", docs)))
    return map_batches(with_text, run, f"{fields}, `{language}` string, `{score}` double")


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(4, 2) & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(_LETTER), F.lit(False))).select("doc_id", "text", "lang")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(learning_rows(docs))
    return predict(docs.select("doc_id", "text", held_out(4, 2).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
