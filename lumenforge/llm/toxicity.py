"""Operator 8: toxicity by maximum-scoring segments.

Tokens are words and their stems. Token log-odds between toxic and clean labelled documents, with an informative Dirichlet prior
(the pooled corpus counts), become segment scores with a negative drift; a word has the best score of its tokens. A linear-time scan finds all maximal-scoring segments of a text; the
extreme-value law of such segments under the clean token distribution (E = K n exp(-lambda S)) says which passages are
significant and calibrates the document score.

The model is fitted on a bounded sample of labelled rows (`SAMPLE_DOCS`, chosen by a hash of the id; documented limit of the
fit only) and holds at most `MAX_TOKENS` tokens, so what is broadcast has a fixed size. Every token of every text is scored.

Defined results: null and empty texts have no passage and get the score of no evidence; without labels of both kinds every
text gets that score; repeated rows get equal scores; further columns pass unchanged, but an output replaces an old column of its
name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenforge.llm import flat
from lumenforge.llm.shared import cleared, dropped, kept

SAMPLE_DOCS, MAX_TOKENS = 20_000, 1 << 16
# The constants below were chosen by four-fold cross-validation inside the rows that are not held out (sf0.01 and sf0.1, some 150
# settings); no label of a held-out row took part.
#: Bytes of the stems of a word; compounds and inflected forms share them.
STEMS = (6,)
#: A token that a document holds n times counts log2(1 + n) there, in parts of this size: integers, so that sums have no order.
COUNT_UNIT = 1024
#: Mass of the prior as a share of the corpus counts; standard errors by which the log-odds of every token shrink towards 0; score of
#: any token that has nothing left.
PRIOR_SHARE, SHRINK, DRIFT = 0.05, 2.0, -0.2
#: A passage is significant below this expected number of chance passages as good in a clean text of the same length.
MAX_EXPECTED = 0.05
THRESHOLD = 0.3

#: Words end at ASCII white space, control characters and punctuation.
BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rate: float = 1.0
    scale: float = 0.1
    slope: float = 1.0
    offset: float = -3.0


def words_of(data: np.ndarray, offsets: np.ndarray) -> flat.Words:
    return flat.Words(data, offsets, BREAKS, fold=True)


def segments(position: np.ndarray, gain: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, last word, score) in one left-to-right scan.

    position, gain: words with a positive score, ascending; every other word scores drift (< 0).
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, next entry with a lower sum before
    total, at = 0.0, 0
    for p, g in zip(position.tolist(), gain.tolist(), strict=True):
        total += drift * (p - at)
        at = p + 1
        first, last, before, after = p, p, total, total + g
        total = after
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]  # what lies between starts no lower
            if j < 0 or stack[j][3] >= after:
                stack.append((first, last, before, after, j))
                break
            first, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, y - x) for a, b, x, y, _ in stack]


def karlin_rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(p exp(rate * score)) = 1 for a negative mean score."""
    p = weights / weights.sum()
    if (scores * p).sum() >= 0 or scores.max() <= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(np.minimum(high * scores, 700))).sum() < 1:
        low, high = high, 2 * high
        if high > 1e4:
            return high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * scores, 700))).sum() < 1 else (low, mid)
    return low if low > 0 else high


def evidence(found: list[tuple[int, int, float]], n_words: int, model: Model) -> tuple[float, int]:
    """(sum over significant passages of -ln of their expected number, how many): 0 if there is none."""
    total, count = 0.0, 0
    for _, _, s in found:
        log_e = np.log(model.scale * max(n_words, 1)) - model.rate * s
        if log_e < np.log(MAX_EXPECTED):
            total -= log_e
            count += 1
    return float(total), count


def pieces(words: flat.Words) -> np.ndarray:
    """The tokens of each word, a column each: the word (even hash) and its stems (odd; 0 where the word is too short)."""
    odd = np.uint64(1)
    stems = [words.stems(k) for k in STEMS]
    return np.stack([words.hashes & ~odd, *[np.where(x == 0, x, x | odd) for x in stems]], 1)


def _gains(words: flat.Words, model: Model) -> np.ndarray:
    """Score of each word, the best of its tokens; 0 where the model has no positive score."""
    hashes = pieces(words)
    if not len(model.keys) or not len(hashes):
        return np.zeros(len(hashes))
    at = np.minimum(np.searchsorted(model.keys, hashes), len(model.keys) - 1)
    return np.where(model.keys[at] == hashes, model.scores[at], 0.0).max(1)


def _scan(data: np.ndarray, offsets: np.ndarray, model: Model):
    """Per document of a part: words, segments found."""
    words = words_of(data, offsets)
    gain = _gains(words, model)
    at = np.flatnonzero(gain > 0)
    cut = np.searchsorted(at, words.first)
    for k in range(len(offsets) - 1):
        own = at[cut[k] : cut[k + 1]]
        yield k, words, int(words.count[k]), segments(own - words.first[k], gain[own], DRIFT) if len(own) else []


def _sampled(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str, sample_docs: int) -> DataFrame:
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label")).orderBy(F.xxhash64(id_col), id_col).limit(sample_docs)
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), id_col).select("_text", "_label").orderBy(F.xxhash64("_text"), "_text", "_label").limit(sample_docs)  # an id may have several rows


def distinct_sample(sample: DataFrame) -> DataFrame:
    """One document of each label and least word 5-gram hash, so that a group of copies counts about once."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in flat.text_parts(batch.column(0)):
                words = words_of(data, offsets)
                grams = flat.chained(words.hashes, 5, 5)
                ends = np.maximum(words.first[1:] - 4, words.first[:-1])
                least = [int(grams[x:y].min().view(np.int64)) if y > x else int(words.hashes[x : z].sum().view(np.int64)) for x, y, z in zip(words.first[:-1].tolist(), ends.tolist(), words.first[1:].tolist(), strict=True)]
                part = batch.slice(row, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least, pa.int64())], names=["_text", "_label", "_least"])

    return sample.mapInArrow(run, "_text string, _label int, _least long").groupBy("_label", "_least").agg(F.min("_text").alias("_text")).select("_text", "_label")


def token_counts(sample: DataFrame) -> DataFrame:
    """token hash, its damped counts in toxic and clean documents of the sample; summed in each batch before they are shuffled."""

    def run(batches):
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for row, data, offsets in flat.text_parts(batch.column(0)):
                words = words_of(data, offsets)
                every_piece = pieces(words)
                own = [np.unique(every_piece[x:y], return_counts=True) for x, y in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
                kind = np.repeat(label[row : row + len(own)], [len(x) for x, _ in own]) > 0
                keys, at = np.unique(np.concatenate([x for x, _ in own]), return_inverse=True)
                damped = np.rint(COUNT_UNIT * np.log2(1.0 + np.concatenate([n for _, n in own])))
                toxic, every = (np.bincount(at, w, len(keys)).astype(np.int64) for w in (damped * kind, damped))
                if len(keys) and keys[0] == 0:  # no stem
                    keys, toxic, every = keys[1:], toxic[1:], every[1:]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(toxic), pa.array(every - toxic)], names=["token", "toxic", "clean"])

    return sample.mapInArrow(run, "token long, toxic long, clean long").groupBy("token").agg((F.sum("toxic") / COUNT_UNIT).alias("toxic"), (F.sum("clean") / COUNT_UNIT).alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, max_tokens: int = MAX_TOKENS) -> Model:
    """Model of labelled documents; labels decide nothing but the two counts of each token and the calibration."""
    sample = kept(distinct_sample(_sampled(docs, labels, text_col, id_col, label_col, sample_docs)), "toxic-sample")
    counts = kept(token_counts(sample), "toxic-counts")
    # whole units again, because a sum of doubles depends on its order
    totals = counts.agg(*[(F.sum(F.round(F.col(c) * COUNT_UNIT).cast("long")) / COUNT_UNIT).alias(c[0]) for c in ("toxic", "clean")])
    both = F.col("toxic") + F.col("clean")
    prior, mass = PRIOR_SHARE * both, PRIOR_SHARE * (F.col("t") + F.col("c"))
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(a / (F.col("t") + mass - a)) - F.log(b / (F.col("c") + mass - b))
    error = F.sqrt(1 / a + 1 / b)
    scored = counts.crossJoin(F.broadcast(totals)).where("t > 0 AND c > 0").withColumn("z", odds / error).withColumn("gain", odds - SHRINK * error).where("gain > 0")
    top = scored.orderBy(F.desc("z"), "token").limit(max_tokens).select("token", "gain", "clean", "c").collect()
    dropped(counts)
    if not top:
        dropped(sample)
        return Model()
    keys = np.array([r.token for r in top], np.int64).view(np.uint64)
    order = np.argsort(keys)
    gains = np.array([r.gain for r in top])[order]
    clean = np.array([r.clean for r in top], float)[order]
    model = Model(keys[order], gains)
    rest = max(float(top[0].c) - clean.sum(), 1.0)
    # unseen-in-clean tokens keep half a count, so that the law has a tail
    model.rate = karlin_rate(np.append(gains, DRIFT), np.append(np.maximum(clean, 0.5), rest))
    quiet = [(n, s) for label, n, s, _ in _judged(sample, model) if not label and n > 0]
    # method of moments for E = K n exp(-rate S) over the clean documents, with half a document as the prior
    chance = sum(np.exp(min(model.rate * s, 50.0)) > 1 for _, s in quiet) + 0.5
    model.scale = float(min(max(chance / (sum(n for n, _ in quiet) + 1.0), 1e-8), 0.1))
    judged = _judged(sample, model)
    dropped(sample)
    model.slope, model.offset = logistic(np.log1p(np.array([x for *_, x in judged])), np.array([label for label, *_ in judged], float))
    return model


def _judged(sample: DataFrame, model: Model) -> list[tuple[int, int, float, float]]:
    """(label, words, best score, evidence of all passages) of each sampled document; bounded like the sample."""

    def run(batches):
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for row, data, offsets in flat.text_parts(batch.column(0)):
                rows = [(int(label[row + k]), n, max((s for *_, s in found), default=0.0), evidence(found, n, model)[0]) for k, _, n, found in _scan(data, offsets, model)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.float64(), pa.float64()))], names=["label", "n", "best", "evidence"])

    return sorted(tuple(r) for r in sample.mapInArrow(run, "label int, n long, best double, evidence double").collect())


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of P(y = 1) by Newton steps with a weak penalty; the slope is kept positive."""
    w, design = np.zeros(2), np.stack([x, np.ones_like(x)], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 0.05 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


OUT = [("score", T.DoubleType()), ("predicted", T.IntegerType()), ("n_passages", T.IntegerType()), ("passages", T.ArrayType(T.StringType()))]


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with score (0 to 1), predicted, and the significant passages as text."""
    df = cleared(df, [n for n, _ in OUT], [text_col])
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in OUT]])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        limit = np.log(MAX_EXPECTED)
        for batch in batches:
            for row, data, offsets in flat.text_parts(batch.column(batch.schema.get_field_index(text_col))):
                scores, counts, texts = [], [], []
                for k, words, n, found in _scan(data, offsets, model):
                    total, count = evidence(found, n, model)
                    scores.append(1 / (1 + np.exp(-np.clip(model.slope * np.log1p(total) + model.offset, -30, 30))))
                    counts.append(count)
                    own = []
                    for a, b, s in found:
                        if np.log(model.scale * max(n, 1)) - model.rate * s < limit:
                            lo, hi = words.starts[words.first[k] + a], words.ends[words.first[k] + b]
                            own.append(data[lo:hi].tobytes().decode("utf-8", "replace"))
                    texts.append(own)
                part = batch.slice(row, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(counts, pa.int32()), pa.array(texts, pa.list_(pa.string()))], names=schema.names)

    return df.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """True for the rows that no label may be learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def digests(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of every document; learns from rows that are not held out."""
    model = fit(docs, labels.where(~held_out()))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "n_passages")
