"""Token counts of a BPE tokenizer with word ends, by finite-state transducers whose transitions carry emitted-token counts.

The tokenizer file is compiled into two deterministic transducers:

* `WORD_STEP` finds the words of the split pattern. It has five states and reads one class a character (a character's class takes
  in whether an apostrophe opens a contraction, so the pattern needs no backing up). The characters of a batch are cut into chunks
  of `CHUNK`; a chunk's *state map* tells for each of the five entry states the exit state. The maps are composed by a parallel
  prefix scan (`scanned`), which gives every chunk its entry state, and all chunks are then replayed at once.
* `MergeTransducer` reads the bytes of a word and adds, with each transition, the change of the number of tokens. After a prefix of
  a word, its tokens are those of a shorter prefix and one more: the last token is the only token of the vocabulary that ends
  there and that may stand after the last token of that shorter prefix (no merge of a rank that comes before the ends of both
  would join them). So a state is the set of positions from which a token may still grow: for each, the node of the vocabulary's
  trie, the last token before it, and its count relative to the current one. The set is bounded by the longest token. Transitions
  are compiled when a text first takes them, and kept for the life of the worker; a table beyond `TABLE_ENTRIES` is started anew,
  which changes no result. All words of a batch step through it at once. A word of more than `CHUNK` bytes is cut into chunks;
  a chunk's map is evaluated for the entry state that a run over the chunk before it suggests, the maps are composed from left to
  right, and a chunk with another true entry state is evaluated for that one.

Defined results: a null or empty text has no tokens; special strings inside a text (`<|endoftext|>`) are one token each and split
it, which is the library's default; nothing is truncated. Repeated rows are counted each. Code points that Python's tables do
not know take class and case from the library's own normaliser and splitter. Merge lists that are not ordered (a token ranked
before a part of it, or made by two pairs) are refused, because counts by last tokens hold only for ordered ones.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenforge.llm.shared import cleared

#: Characters of a chunk, characters of text handled at once, entries of the transition table.
CHUNK, BATCH_CHARS, TABLE_ENTRIES = 64, 1 << 20, 1 << 24
#: The split pattern and normaliser that WORD_STEP is made for (fixed values of the tokenizer file).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = ["NFC", "Replace", "Lowercase"]
ONE_AFTER, TWO_AFTER = "stmd", ("re", "ve", "ll")
#: White space of the pattern (fixed values).
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Classes of characters; states of the word transducer: between words, in letters, in other signs, one or two letters before a contraction's end.
SPACE, LETTER, DIGIT, OTHER, SHORT, LONG, UNKNOWN = range(7)
BETWEEN, LETTERS, SIGNS, ONE_MORE, TWO_MORE = range(5)


def _word_step() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a word starts) for each state and class."""
    step, starts = np.zeros((5, 6), np.uint8), np.zeros((5, 6), bool)
    for state in range(5):
        for c, after in ((SPACE, BETWEEN), (LETTER, LETTERS), (DIGIT, BETWEEN), (OTHER, SIGNS), (SHORT, ONE_MORE), (LONG, TWO_MORE)):
            step[state, c], starts[state, c] = after, c != SPACE
    starts[LETTERS, LETTER] = starts[SIGNS, OTHER] = False
    for c in (SHORT, LONG):  # an apostrophe inside a run of other signs belongs to the run
        step[SIGNS, c], starts[SIGNS, c] = SIGNS, False
    step[ONE_MORE], starts[ONE_MORE] = BETWEEN, False
    step[TWO_MORE], starts[TWO_MORE] = ONE_MORE, False
    return step, starts


WORD_STEP, WORD_STARTS = _word_step()


def scanned(maps: np.ndarray) -> np.ndarray:
    """The state on entry to each chunk, from BETWEEN on: an inclusive parallel prefix scan over the chunks' state maps."""
    maps, span = maps.copy(), 1
    while span < len(maps):
        maps[span:] = np.take_along_axis(maps[span:], maps[:-span], 1)
        span *= 2
    return np.concatenate([[BETWEEN], maps[:-1, BETWEEN]]) if len(maps) else np.zeros(0, np.uint8)


def word_starts(classes: np.ndarray) -> np.ndarray:
    """Whether a word starts at each character."""
    n = len(classes)
    lanes = np.zeros(-(-n // CHUNK) * CHUNK, np.uint8)
    lanes[:n] = classes
    lanes = np.ascontiguousarray(lanes.reshape(-1, CHUNK).T)
    maps = np.tile(np.arange(5, dtype=np.uint8), (lanes.shape[1], 1))
    for c in lanes:
        maps = WORD_STEP[maps, c[:, None]]
    state, out = scanned(maps), np.zeros(lanes.shape, bool)
    for k, c in enumerate(lanes):
        out[k] = WORD_STARTS[state, c]
        state = WORD_STEP[state, c]
    return out.T.reshape(-1)[:n]


@functools.cache
def characters() -> tuple[np.ndarray, np.ndarray]:
    """(lower case, class) of every code point. The one lower case of two characters is replaced before."""
    lower, classes = np.arange(0x110000, dtype=np.int32), np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            classes[c] = LETTER
            small = chr(c).lower()
            lower[c] = ord(small) if len(small) == 1 else c
        elif kind[0] == "N":
            classes[c] = DIGIT
            lower[c] = ord(chr(c).lower())
        elif kind == "Cn":
            classes[c] = UNKNOWN
        elif kind == "So":
            lower[c] = ord(chr(c).lower())
    classes[SPACES] = SPACE
    return lower, classes


def byte_signs() -> dict[str, int]:
    """The printable sign of each byte in byte-level vocabularies: itself if it prints, else the next sign from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(hidden)}


class MergeTransducer:
    """Counts of tokens over the bytes of words: byte b inside a word is symbol b, as its last byte 256 + b."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, end = told["model"], told["model"].get("end_of_word_suffix")
        splits = [p.get("pattern", {}).get("Regex") for p in (told["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if model["type"] != "BPE" or not end or PATTERN not in splits or [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])] != NORMALISERS:
            raise ValueError(f"{path} is not a byte-level BPE tokenizer with word ends and the known split pattern")
        self.path, self.specials = path, [t["content"] for t in told["added_tokens"]]
        signs = byte_signs()
        number = {s: b for s, b in signs.items()} | {s + end: 256 + b for s, b in signs.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int] | None] = [None] * 512
        spelled: list[tuple[int, ...]] = [(k,) for k in range(512)]
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if a not in number or b not in number or a + b in number:
                raise ValueError("the merge list is not ordered")
            pair = number[a], number[b]
            self.pairs[pair] = number[a + b] = len(self.parts)
            self.parts.append(pair)
            spelled.append(spelled[pair[0]] + spelled[pair[1]])
        # tokens are numbered in the order of their merges, so a number is a rank too
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.grows: list[bool] = [False]
        for token, symbols in enumerate(spelled):
            node = 0
            for s in symbols:
                self.grows[node] = True
                found = self.child.get(node << 9 | s)
                if found is None:
                    found = self.child[node << 9 | s] = len(self.token_at)
                    self.token_at.append(-1)
                    self.grows.append(False)
                node = found
            self.token_at[node] = token
        self.whole, self.beside = functools.cache(self._whole), functools.cache(self._beside)
        self._reset()

    def _edge(self, token: int, side: int, end: float) -> list[tuple[int, float]]:
        """(part, rank at which it is merged away) of the parts at one side of a token while it is put together."""
        out = [(token, end)]
        while self.parts[token] is not None:
            end, token = token, self.parts[token][side]
            out.append((token, end))
        return out

    def _joins(self, left: int, right: int, end: float) -> bool:
        """Whether a merge over the border between two tokens comes before `end` and before those that take its parts away.
        Of equal merges the left one is done first."""
        for a, a_end in self._edge(left, 1, end):
            for b, b_end in self._edge(right, 0, end):
                rank = self.pairs.get((a, b))
                if rank is not None and rank < a_end and (rank < b_end or (rank == b_end and b_end != end)):
                    return True
        return False

    def _whole(self, token: int) -> bool:
        """Whether the token's own text is encoded as this token."""
        pair = self.parts[token]
        return pair is None or (self.whole(pair[0]) and self.whole(pair[1]) and not self._joins(*pair, token))

    def _beside(self, left: int, right: int) -> bool:
        """Whether the text of both is encoded as these two tokens."""
        return left < 0 or not self._joins(left, right, float("inf"))

    def _reset(self) -> None:
        self.beside.cache_clear()
        self.states: list[tuple] = [((0, -1, 0),)]
        self.known: dict[tuple, int] = {self.states[0]: 0}
        self.column = np.full(512, -1, np.int64)
        self.width = 64
        self.after, self.gain = np.full((1024, 64), -1, np.int32), np.zeros((1024, 64), np.int8)

    def _columns(self, symbols: np.ndarray) -> None:
        new = np.flatnonzero((np.bincount(symbols, minlength=512) > 0) & (self.column < 0))
        used = int((self.column >= 0).sum())
        self.column[new] = used + np.arange(len(new))
        while self.width < used + len(new):
            self.after = np.hstack([self.after, np.full_like(self.after, -1)])
            self.gain = np.hstack([self.gain, np.zeros_like(self.gain)])
            self.width *= 2

    def _compile(self, state: int, symbol: int) -> None:
        """Adds one transition."""
        places, token, count = [], -1, 0
        for node, left, n in self.states[state]:
            node = self.child.get(node << 9 | symbol)
            if node is None:
                continue
            if token < 0:
                here = self.token_at[node]
                if here >= 0 and self.whole(here) and self.beside(left, here):
                    token, count = here, n + 1
            if self.grows[node]:
                places.append((node, left, n))
        if symbol >= 256:
            to = 0
        else:
            key = (*[(node, left, n - count) for node, left, n in places], (0, token, 0))
            to = self.known.get(key)
            if to is None:
                to = self.known[key] = len(self.states)
                self.states.append(key)
                if to == len(self.after):
                    self.after = np.vstack([self.after, np.full_like(self.after, -1)])
                    self.gain = np.vstack([self.gain, np.zeros_like(self.gain)])
        self.after[state, self.column[symbol]], self.gain[state, self.column[symbol]] = to, count

    def _steps(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit state, tokens) of runs of symbols, all in step; sizes must fall."""
        state, total = state.copy(), np.zeros(len(start), np.int64)
        active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right") if len(size) else []
        for k, n in enumerate(active):
            s = symbols[start[:n] + k]
            at = state[:n] * self.width + self.column[s]
            to = self.after.reshape(-1)[at]
            missing = to < 0
            if missing.any():
                for key in np.unique(state[:n][missing] << 9 | s[missing]).tolist():
                    self._compile(key >> 9, key & 511)
                to = self.after.reshape(-1)[at]
            total[:n] += self.gain.reshape(-1)[at]
            state[:n] = to
        return state, total

    def counts(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each word (start, size) of symbols."""
        if self.after.size > TABLE_ENTRIES:
            self._reset()
        self._columns(symbols)
        out = np.zeros(len(start), np.int64)
        order = np.argsort(-size, kind="stable")
        n_long = int((size > CHUNK).sum())
        for w in order[:n_long].tolist():
            out[w] = self._long(symbols, int(start[w]), int(size[w]))
        short = order[n_long:]
        out[short] = self._steps(symbols, start[short], size[short], np.zeros(len(short), np.int64))[1]
        return out

    def _long(self, symbols: np.ndarray, start: int, size: int) -> int:
        """Tokens of one long word: the composition of its chunks' maps."""
        at = np.arange(start, start + size, CHUNK)
        sizes = np.minimum(CHUNK, start + size - at)
        alone, first = self._steps(symbols, at, sizes, np.zeros(len(at), np.int64))
        entry = np.concatenate([[0], alone[:-1]])  # what the chunk before suggests
        state, total = self._steps(symbols, at, sizes, entry)
        count, now = int(first[0]), int(alone[0])
        for k in range(1, len(at)):
            if now == entry[k]:
                now, count = int(state[k]), count + int(total[k])
                continue
            for s in symbols[at[k] : at[k] + sizes[k]].tolist():
                c = self.column[s]
                if self.after[now, c] < 0:
                    self._compile(now, s)
                now, count = int(self.after[now, c]), count + int(self.gain[now, c])
        return count


class Counter:
    """Token counts of texts."""

    def __init__(self, path: str):
        self.merges = MergeTransducer(path)
        self.special = re.compile("|".join(map(re.escape, self.merges.specials)))
        self.extra: dict[int, tuple[str, int]] = {}

    @functools.cached_property
    def library(self):
        import tokenizers

        return tokenizers.Tokenizer.from_file(self.merges.path)

    def _unknown(self, text: str) -> str:
        """A text with code points that Python's tables do not know, normalised by the library; their classes are learnt from its splitter."""
        text = self.library.normalizer.normalize_str(text)
        _, classes = characters()
        for c in {ord(x) for x in text}:
            if classes[c] == UNKNOWN:
                parts = len(self.library.pre_tokenizer.pre_tokenize_str(f"a{chr(c)}!"))
                inside = len(self.library.pre_tokenizer.pre_tokenize_str(f"a{chr(c)}"))
                classes[c] = LETTER if inside == 1 else DIGIT if parts == 3 else OTHER
        return text

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; the texts are handled as one, with line ends between them."""
        counts = np.zeros(len(texts), np.int64)
        lower, classes = characters()
        plain = []
        for k, text in enumerate(texts):
            if "<|" in text and (found := len(self.special.findall(text))):
                counts[k] = found
                text = self.special.sub("\n", text)
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            plain.append(text.replace("İ", "i̇"))
        points = np.frombuffer("\n".join([*plain, ""]).encode("utf-32-le"), np.uint32)
        kind = classes[points]
        if (kind == UNKNOWN).any():
            ends = np.cumsum([len(t) + 1 for t in plain])
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(kind == UNKNOWN), "right")).tolist():
                plain[k] = self._unknown(self.special.sub("\n", texts[k]))
            points = np.frombuffer("\n".join([*plain, ""]).encode("utf-32-le"), np.uint32)
        small = lower[points]
        kind = classes[small]
        quotes = np.flatnonzero(small == 0x27)
        if len(quotes):
            near = np.append(small, [0, 0])
            one, two = near[quotes + 1], near[quotes + 2]
            kind[quotes[np.isin(one, [ord(c) for c in ONE_AFTER])]] = SHORT
            for a, b in TWO_AFTER:
                kind[quotes[(one == ord(a)) & (two == ord(b))]] = LONG
        begins = word_starts(kind)
        inside = kind != SPACE
        where = np.flatnonzero(inside)
        if not len(where):
            return counts
        chars, begins = small[where], begins[where]
        width = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        ends = np.cumsum(width)
        symbols = np.zeros(int(ends[-1]), np.int16)
        for size in range(1, 5):
            who = np.flatnonzero(width == size) if size > 1 or ends[-1] > len(chars) else slice(None)
            c, last = chars[who], ends[who] - 1
            if not len(c):
                continue
            if size == 1:
                symbols[last] = c
                continue
            for k in range(size - 1):
                symbols[last - k] = 0x80 | (c >> 6 * k & 0x3F)
            symbols[last - size + 1] = (0xF00 >> size & 0xFF) | c >> 6 * (size - 1)
        first = np.flatnonzero(begins)
        start = ends[first] - width[first]
        stop = np.append(start[1:], len(symbols))
        symbols[stop - 1] += 256
        words = self.merges.counts(symbols, start, stop - start)
        text_ends = np.cumsum([len(t) + 1 for t in plain])
        told = np.bincount(np.searchsorted(text_ends, where[first], "right"), words, len(texts))
        return counts + told.astype(np.int64)


def counted(df: DataFrame, path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of its texts; columns of these names are replaced."""
    df = cleared(df, ["n_bytes", "n_tokens", "over_limit"], [text_col])
    schema = T.StructType([*df.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        counter = Counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            told, k = [], 0
            while k < len(texts):
                end, size = k, 0
                while end < len(texts) and (end == k or size + len(texts[end]) <= BATCH_CHARS):
                    size, end = size + len(texts[end]), end + 1
                told.append(counter(texts[k:end]))
                k = end
            n = np.concatenate(told) if told else np.zeros(0, np.int64)
            n_bytes = np.array([len(t.encode()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_bytes), pa.array(n), pa.array(n > limit)], names=schema.names)

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", limit: int = 2048) -> DataFrame:
    """Per row: id_col, n_bytes, n_tokens, over_limit."""
    return counted(df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")), path, "_text", limit).drop("_text")
