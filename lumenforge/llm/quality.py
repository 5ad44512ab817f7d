"""Operator 10: quality rules with line sequence labelling.

Counting rules come first (too few words, too much repetition). What passes them is judged line by line: a linear-chain
conditional random field over line features marks each line as content or boilerplate by Viterbi decoding, and the document
is kept when content lines hold at least `min_content` of its characters.

The field is fitted on a bounded sample of labelled documents (`sample_docs`: a documented limit of the fit only), on all
lines of each. Lines of documents labelled good are content; lines of documents labelled bad are boilerplate. Scoring covers every
line of every text.

Defined results: a null or empty text has no words and fails the base rules; repeated rows are judged alike; without labelled
documents of both kinds the field is neutral and keeps what the base rules keep; further columns pass unchanged, but an output replaces
an old column of its name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenforge.llm import flat
from lumenforge.llm.shared import cleared

MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CONTENT = 50, 50, 0.5
#: Limit of the fit: labelled documents.
SAMPLE_DOCS = 4000
CONTENT, BOILERPLATE = 1, 0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_BANG = np.zeros(256, bool)
_BANG[list(b"!")] = True

#: Bounds between the levels of each numeric line feature; a level is one indicator.
LEVELS = {
    "words": (1, 3, 6, 12, 25, 60),
    "symbol_share": (0.005, 0.03, 0.08, 0.15),
    "upper_share": (0.05, 0.15, 0.4, 0.7),
    "digit_share": (0.02, 0.1, 0.3),
    "bang_share": (0.01, 0.05, 0.1),
    "word_length": (3.0, 4.5, 6.0, 8.0),
    "repeat_share": (0.1, 0.3, 0.6),
}
FLAGS = ("ends_with_stop", "duplicate", "first", "last")
N_FEATURES = 1 + sum(len(x) + 1 for x in LEVELS.values()) + len(FLAGS)


@dataclass
class Field:
    """Weights of the chain: emission[label, feature], transition[label before, label], start[label]."""

    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    @staticmethod
    def neutral() -> Field:
        emission = np.zeros((2, N_FEATURES))
        emission[CONTENT, 0] = 1.0
        return Field(emission, np.zeros((2, 2)), np.zeros(2))


def _sums(flags: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[last] - total[first]


class Lines:
    """Lines of some documents, with the counts that rules and features need."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = words = flat.Words(data, offsets)
        breaks = np.flatnonzero(data == 10)
        starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        doc = np.searchsorted(offsets, starts, "right") - 1
        # the last newline of a text is followed by an empty line of that text, which lies at the next text's offset
        at_edge = np.zeros(len(starts), bool)
        if len(starts):
            own = np.sort(np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1]), kind="stable")
            at_edge = own != doc
            doc = own
        self.starts, self.doc = starts, doc
        self.ends = np.minimum(np.append(starts[1:], offsets[-1] if len(offsets) else 0), offsets[doc + 1])
        newline = (self.ends < offsets[doc + 1]) | (np.append(doc[1:], -1) == doc)
        self.ends = np.where(newline & ~at_edge, np.maximum(self.starts, np.append(starts[1:], 0) - 1), self.ends)
        self.first_line = np.searchsorted(doc, np.arange(len(offsets)))
        self.word_lo = np.searchsorted(words.starts, self.starts)
        self.word_hi = np.searchsorted(words.starts, self.ends)
        self.n_words = self.word_hi - self.word_lo
        self.data, self.offsets = data, offsets
        lead = (data & 0xC0) != 0x80
        self.word_char = lead & ~flat.SPACE[data]
        self.symbol = _SYMBOL[data]
        self.duplicate = self._duplicates()
        self.repeated = self._repeated_words()

    def _duplicates(self) -> np.ndarray:
        raw, out = self.data.tobytes(), np.zeros(len(self.starts), bool)
        bounds, docs, filled = list(zip(self.starts.tolist(), self.ends.tolist(), strict=True)), self.doc.tolist(), (self.n_words > 0).tolist()
        seen, current = set(), -1
        for k, (a, b) in enumerate(bounds):
            if docs[k] != current:
                seen, current = set(), docs[k]
            if filled[k]:
                line = raw[a:b]
                if line in seen:
                    out[k] = True
                else:
                    seen.add(line)
        return out

    def _repeated_words(self) -> np.ndarray:
        """True for words in a three-word window that the same text has twice or more."""
        words, out = self.words, np.zeros(len(self.words.starts), bool)
        windows = flat.chained(words.hashes, 3, 11)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a < 4:
                continue
            own = windows[a : b - 2]
            order = np.argsort(own, kind="stable")
            equal = own[order[1:]] == own[order[:-1]]
            if equal.any():
                at = np.unique(np.concatenate([order[1:][equal], order[:-1][equal]])) + a
                for j in range(3):
                    out[at + j] = True
        return out

    def base(self) -> dict[str, np.ndarray]:
        a, b = self.offsets[:-1], self.offsets[1:]
        n = self.words.count
        repeat = _sums(self.repeated, self.words.first[:-1], self.words.first[1:])
        found = {"n_words": n, "word_chars": _sums(self.word_char, a, b), "n_symbols": _sums(self.symbol, a, b), "n_dup_lines": _sums(self.duplicate, self.first_line[:-1], self.first_line[1:]), "n_repeat_words": repeat}
        return found | {"base_failed": (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)}

    def chars(self) -> np.ndarray:
        return _sums(self.word_char, self.starts, self.ends)

    def features(self) -> np.ndarray:
        """Indicator matrix, a row for each line."""
        a, b, data = self.starts, self.ends, self.data
        size = np.maximum(self.chars(), 1)
        letters = np.maximum(_sums(_UPPER[data] | _LOWER[data], a, b), 1)
        values = {
            "words": self.n_words,
            "symbol_share": _sums(self.symbol, a, b) / size,
            "upper_share": _sums(_UPPER[data], a, b) / letters,
            "digit_share": _sums(_DIGIT[data], a, b) / size,
            "bang_share": _sums(_BANG[data], a, b) / size,
            "word_length": self.chars() / np.maximum(self.n_words, 1),
            "repeat_share": _sums(self.repeated, self.word_lo, self.word_hi) / np.maximum(self.n_words, 1),
        }
        out = np.zeros((len(a), N_FEATURES), np.float32)
        out[:, 0] = 1
        at, rows = 1, np.arange(len(a))
        for name, bounds in LEVELS.items():
            out[rows, at + np.searchsorted(bounds, values[name], "right")] = 1
            at += len(bounds) + 1
        last_word = self.words.ends[np.maximum(self.word_hi - 1, 0)] - 1 if len(self.words.ends) else np.zeros(len(a), np.int64)
        out[:, at] = (self.n_words > 0) & _STOP[data[last_word]] if len(data) else 0
        out[:, at + 1] = self.duplicate
        out[:, at + 2] = np.append(True, self.doc[1:] != self.doc[:-1]) if len(a) else 0
        out[:, at + 3] = np.append(self.doc[1:] != self.doc[:-1], True) if len(a) else 0
        return out


def _steps(first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the positions 0, 1, ... of sequences: (sequences that reach it, their rows)."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    reach = len(length) - np.searchsorted(np.sort(length), np.arange(int(length.max(initial=0))), "right")
    return [(order[:n], first[:-1][order[:n]] + k) for k, n in enumerate(reach.tolist())]


def viterbi(scores: np.ndarray, first: np.ndarray, field: Field) -> np.ndarray:
    """Best label of each row; scores[row, label] and the first row of each sequence. Ties go to content."""
    labels = np.zeros(len(scores), np.int8)
    back = np.zeros((len(scores), 2), np.int8)
    steps = _steps(first)
    best = np.zeros((len(first) - 1, 2))
    for k, (who, rows) in enumerate(steps):
        if k == 0:
            best[who] = field.start + scores[rows]
            continue
        through = best[who][:, :, None] + field.transition
        from_content = through[:, CONTENT] >= through[:, BOILERPLATE]
        back[rows] = from_content
        best[who] = np.where(from_content, through[:, CONTENT], through[:, BOILERPLATE]) + scores[rows]
    current = np.zeros(len(first) - 1, np.int8)
    length = np.diff(first)
    for k in range(len(steps) - 1, -1, -1):
        who, rows = steps[k]
        ends = length[who] == k + 1
        current[who[ends]] = best[who[ends], CONTENT] >= best[who[ends], BOILERPLATE]
        labels[rows] = current[who]
        current[who] = back[rows, current[who]]
    return labels


def fit_field(x: np.ndarray, y: np.ndarray, first: np.ndarray, rounds: int = 120, decay: float = 1e-3) -> Field:
    """Maximum conditional likelihood with an L2 penalty: forward-backward gradients, Adam steps."""
    if len(x) == 0 or len(np.unique(y)) < 2:
        return Field.neutral()
    steps, n = _steps(first), len(first) - 1
    rows_of_start = first[:-1][np.diff(first) > 0]
    theta = [np.zeros((2, x.shape[1])), np.zeros((2, 2)), np.zeros(2)]
    gold = [np.stack([x[y == k].sum(0) for k in (0, 1)]), np.zeros((2, 2)), np.bincount(y[rows_of_start], minlength=2).astype(float)]
    inner = np.ones(len(x), bool)
    inner[rows_of_start] = False
    np.add.at(gold[1], (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    moments = [[np.zeros_like(t), np.zeros_like(t)] for t in theta]
    for step in range(1, rounds + 1):
        emission, transition, start = theta
        s = x @ emission.T
        forward, backward = np.zeros_like(s), np.zeros_like(s)
        for k, (_, rows) in enumerate(steps):
            forward[rows] = start + s[rows] if k == 0 else np.logaddexp(forward[rows - 1, 0, None] + transition[0], forward[rows - 1, 1, None] + transition[1]) + s[rows]
        for k in range(len(steps) - 1, 0, -1):
            rows = steps[k][1]
            ahead = s[rows] + backward[rows]
            backward[rows - 1] = np.logaddexp(transition[:, 0] + ahead[:, :1], transition[:, 1] + ahead[:, 1:])
        node = forward + backward
        z = np.logaddexp(node[:, 0], node[:, 1])
        p = np.exp(node - z[:, None])
        at = np.flatnonzero(inner)
        edge = forward[at - 1][:, :, None] + transition + (s[at] + backward[at])[:, None, :] - z[at][:, None, None]
        expected = [p.T @ x, np.exp(edge).sum(0), p[rows_of_start].sum(0)]
        rate = 0.1 * (1 - step / (rounds + 1))
        for t, e, g, (m, v) in zip(theta, expected, gold, moments, strict=True):
            slope = (e - g) / n + decay * t
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            t -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(*theta)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> Field:
    """Field fitted on at most sample_docs labelled documents (chosen by a hash of the id, so alike in every run)."""
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label")).orderBy(F.xxhash64(id_col), id_col).limit(sample_docs)
    sample = docs.select(id_col, F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), id_col).select("_text", "_label")
    sample = sample.orderBy(F.xxhash64("_text"), "_text", "_label").limit(sample_docs)  # an id may have several rows

    def lines(batches):
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            codes, rows, ys = [], [], []
            for row, data, offsets in flat.text_parts(batch.column(0)):
                found = Lines(data, offsets)
                x, failed = found.features(), found.base()["base_failed"]
                for k in np.flatnonzero(~failed).tolist():
                    a, b = found.first_line[k], found.first_line[k + 1]
                    codes.append(np.packbits(x[a:b].astype(bool), axis=1).tobytes())
                    rows.append(int(b - a))
                    ys.append(int(label[row + k]))
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), pa.array(rows, pa.int32()), pa.array(ys, pa.int32())], names=["codes", "n", "label"])

    got = sorted(sample.mapInArrow(lines, "codes binary, n int, label int").collect(), key=lambda r: (bytes(r.codes), r.label))
    if not got:
        return Field.neutral()
    width = -(-N_FEATURES // 8)
    x = np.unpackbits(np.frombuffer(b"".join(bytes(r.codes) for r in got), np.uint8).reshape(-1, width), axis=1)[:, :N_FEATURES].astype(np.float64)
    n = np.array([r.n for r in got])
    return fit_field(x, np.repeat([r.label for r in got], n), np.append(0, np.cumsum(n)))


COUNTS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("n_lines", T.LongType()), ("content_share", T.DoubleType()), ("kept", T.BooleanType())]


def judge(df: DataFrame, field: Field, text_col: str = "text", min_content: float = MIN_CONTENT) -> DataFrame:
    """df with the columns COUNTS: base counts, share of characters in content lines, and the verdict."""
    df = cleared(df, [n for n, _ in COUNTS], [text_col])
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in COUNTS]])
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}

    def run(batches):
        for batch in batches:
            for row, data, offsets in flat.text_parts(batch.column(batch.schema.get_field_index(text_col))):
                found = Lines(data, offsets)
                out = found.base()
                label = viterbi(found.features() @ field.emission.T, found.first_line, field)
                chars = found.chars()
                content = _sums(np.where(label == CONTENT, chars, 0), found.first_line[:-1], found.first_line[1:])
                share = content / np.maximum(out["word_chars"], 1)
                out |= {"n_lines": np.diff(found.first_line), "content_share": share, "kept": ~out["base_failed"] & (share >= min_content)}
                part = batch.slice(row, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(out[n], kinds[t.simpleString()]) for n, t in COUNTS]], names=schema.names)

    return df.mapInArrow(run, schema)


def rules(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with base counts and verdict by a field fitted on labels."""
    return judge(docs, fit(docs, labels))
