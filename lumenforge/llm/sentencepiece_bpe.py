"""Operator 2: SentencePiece BPE encoding and decoding by vectorised merge rounds.

The vocabulary comes from a public model file whose path is a parameter (the file is only read through the library for its
pieces and scores; encoding and decoding are done here). All distinct words of a batch lie behind each other in one flat
symbol array. A round finds each word's best adjacent pair (highest piece score, leftmost first), merges it in all words at
once and compacts the array; rounds end when no pair remains.

Within a word a round also merges the later copies of the same pair, as long as the queue of a sequential encoder would come
to them next: up to the first merge that creates a pair of the same or a better rank. So the ids are those of the library.

Defined results: a null text is an empty text; an empty text has no pieces (begin and end ids only); rows are independent, so
ties, repeated rows and empty tables need no rule; further columns pass unchanged, but an output replaces an old column
of its name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenforge.llm.shared import cleared

SPACE_MARK = "▁"
NO_RANK = np.int64(1 << 40)
#: Characters of text whose words are encoded at once.
CHUNK_CHARS = 1 << 20
#: Words whose ids a task remembers; the memory is cleared when it is full.
KNOWN_WORDS = 400_000


class Vocabulary:
    """Pieces, pair ranks and byte pieces of a SentencePiece BPE model with the identity normaliser."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bos, self.eos, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte_ids = np.zeros(256, np.int64)
        self.byte_of = np.full(size, -1, np.int64)
        for i in range(size):
            if model.is_byte(i):
                self.byte_ids[int(names[i][3:5], 16)] = i
                self.byte_of[i] = int(names[i][3:5], 16)
        symbols = {names[i]: i for i in plain}  # a plain piece's symbol is its id
        for i in plain:
            for c in names[i]:
                symbols.setdefault(c, size + len(symbols))
        self.limit = max(symbols.values()) + 1  # symbols beyond stand for characters in no piece
        self.size = size
        codes = sorted((ord(s), k) for s, k in symbols.items() if len(s) == 1)
        self.char_symbol = np.arange(0x110000, dtype=np.int32) + self.limit
        self.char_symbol[[c for c, _ in codes]] = [k for _, k in codes]
        self.char_of = {k: c for c, k in codes}
        scores = np.array([model.get_score(i) for i in range(size)])
        levels = np.unique(-scores[plain])
        pairs = {}
        for i in plain:
            piece = names[i]
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.limit + right] = i
        piece_of = np.fromiter(pairs.values(), np.int64, len(pairs))
        rank_of = np.searchsorted(levels, -scores[piece_of])
        self._hash_pairs(np.fromiter(pairs, np.int64, len(pairs)), rank_of, piece_of)
        inner = {c for i in plain if len(names[i]) > 1 for c in names[i]}
        if any(SPACE_MARK in names[i].lstrip(SPACE_MARK) for i in plain):
            raise ValueError("a piece of this model crosses words")
        alone = "".join(re.escape(c) for c in "\n\t\0" if c not in inner)
        if "\0" in inner:
            raise ValueError("a piece of this model holds the NUL character")
        self.word = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}{alone}]+|{SPACE_MARK}+" + (f"|[{alone}]" if alone else ""))
        text = {i: names[i].replace(SPACE_MARK, " ").encode() for i in plain}
        self.text_of = [text.get(i, b"" if not model.is_unknown(i) else b" \xe2\x81\x87 ") for i in range(size)]
        for i in np.flatnonzero(self.byte_of >= 0):
            self.text_of[i] = bytes([self.byte_of[i]])
        self.is_byte = self.byte_of >= 0

    def _hash_pairs(self, keys: np.ndarray, ranks: np.ndarray, pieces: np.ndarray) -> None:
        """Open addressing; slots holds key, rank and piece, probes how far a search goes."""
        bits = max(12, int(len(keys)).bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.full((1 << bits) + 64, -1, np.int64)
        self.slot_rank = np.full((1 << bits) + 64, NO_RANK, np.int64)
        self.slot_piece = np.full((1 << bits) + 64, -1, np.int64)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.slot_key[at[left]] == -1
            slot, lucky = np.unique(at[left[free]], return_index=True)
            placed = left[free][lucky]
            self.slot_key[slot], self.slot_rank[slot], self.slot_piece[slot] = keys[placed], ranks[placed], pieces[placed]
            left = np.setdiff1d(left, placed)
            at[left] += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of each pair; NO_RANK where it makes no piece."""
        key = np.where((left < self.limit) & (right < self.limit) & (left >= 0) & (right >= 0), left * self.limit + right, -2)
        at = self._slot(key)
        found = self.slot_key[at]
        for _ in range(1, self.probes):
            miss = np.flatnonzero((found != key) & (found != -1))
            if not len(miss):
                break
            at[miss] += 1
            found[miss] = self.slot_key[at[miss]]
        hit = found == key
        return np.where(hit, self.slot_rank[at], NO_RANK), np.where(hit, self.slot_piece[at], -1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word); the words are distinct parts of prepared text."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        symbol = self.char_symbol[codes].astype(np.int64)
        rank, piece = self._ranks(symbol, owner, np.arange(len(symbol)))
        done_symbols, done_owners = [], []
        while len(symbol):
            starts = np.flatnonzero(np.append(True, owner[:-1] != owner[1:]))
            best = np.minimum.reduceat(rank, starts)
            best = np.repeat(best, np.diff(np.append(starts, len(symbol))))
            open_ = best < NO_RANK
            if not open_.all():  # words without a pair leave
                done_symbols.append(symbol[~open_])
                done_owners.append(owner[~open_])
                symbol, owner, rank, piece, best = symbol[open_], owner[open_], rank[open_], piece[open_], best[open_]
                if not len(symbol):
                    break
            merged = self._merges(symbol, owner, rank, piece, best)
            symbol[merged] = piece[merged]
            keep = np.ones(len(symbol), bool)
            keep[merged + 1] = False
            symbol, owner, rank, piece = symbol[keep], owner[keep], rank[keep], piece[keep]
            here = merged - np.arange(len(merged))  # each earlier merge has taken one symbol away
            stale = np.concatenate([here, np.maximum(here - 1, 0)])
            rank[stale], piece[stale] = self._ranks(symbol, owner, stale)
        symbol, owner = np.concatenate([*done_symbols, symbol]), np.concatenate([*done_owners, owner])
        order = np.argsort(owner, kind="stable")
        symbol, owner = self._ids(symbol[order], owner[order])
        return symbol, np.bincount(owner, minlength=len(words))

    def _ranks(self, symbol, owner, at) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of the pairs that begin at these positions."""
        after = np.minimum(at + 1, len(symbol) - 1)
        right = np.where((after > at) & (owner[after] == owner[at]), symbol[after], -1)
        return self.lookup(symbol[at], right)

    def _merges(self, symbol, owner, rank, piece, best) -> np.ndarray:
        """Left positions merged in this round: the leftmost best pair of each word, and its copies that come next anyway."""
        at = np.flatnonzero(rank == best)
        word = owner[at]
        lead = np.append(True, word[1:] != word[:-1])
        group = np.cumsum(lead) - 1
        at_lead = at[lead]
        alike = (symbol[at] == symbol[at_lead][group]) & (symbol[at + 1] == symbol[at_lead + 1][group])
        # everything from the first different pair of equal rank on waits
        alike = _prefix_true(alike, lead)
        at, group, lead = at[alike], group[alike], lead[alike]
        chain = np.append(True, (at[1:] != at[:-1] + 1) | (group[1:] != group[:-1]))
        run_start = np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
        even = (np.arange(len(at)) - run_start) % 2 == 0  # aaa: the left pair goes first
        at, group, lead = at[even], group[even], lead[even]
        made, own = piece[at], rank[at]
        left = np.where(at > 0, symbol[at - 1], -1)
        left[(at == 0) | (owner[at - 1] != owner[at])] = -1
        previous = np.append(-9, at[:-1])
        joined = previous == at - 2  # the left neighbour has just been merged
        left = np.where(joined & (left >= 0), np.append(-1, made[:-1]), left)
        after = np.minimum(at + 2, len(symbol) - 1)
        right = np.where((at + 2 < len(symbol)) & (owner[after] == owner[at]), symbol[after], -1)
        worse = (self.lookup(left, made)[0] > own) & (self.lookup(made, right)[0] > own)
        safe = np.append(True, worse[:-1]) | lead
        return at[_prefix_true(safe, lead)]

    def _ids(self, symbol, owner) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids; characters that are no piece become the byte pieces of their UTF-8 form."""
        if (symbol < self.size).all():
            return symbol, owner
        out, whose = [], []
        for s, w in zip(symbol.tolist(), owner.tolist(), strict=True):
            if s < self.size:
                out.append(s)
                whose.append(w)
            else:
                raw = chr(s - self.limit if s >= self.limit else self.char_of[s]).encode("utf-8", "surrogatepass")
                out += self.byte_ids[list(raw)].tolist()
                whose += [w] * len(raw)
        return np.array(out, np.int64), np.array(whose, np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids as the library's decode(ids) gives it."""
        raw = b"".join(map(self.text_of.__getitem__, ids.tolist()))
        if self._starts_with_space(ids):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:  # only ids that no text encodes to: each stray byte becomes U+FFFD
            return self._decode_broken(ids)

    def _starts_with_space(self, ids: np.ndarray) -> bool:
        for i in ids.tolist():
            if self.is_byte[i]:
                return False
            if self.text_of[i]:
                return self.text_of[i][:1] == b" " and i != self.unknown
        return False

    def _decode_broken(self, ids: np.ndarray) -> str:
        out, raw = [], b""
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.is_byte[i]:
                raw += self.text_of[i]
                continue
            while raw:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[:n].decode())
                        raw = raw[n:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    raw = raw[1:]
            if i >= 0:
                out.append(self.text_of[i].decode())
        text = "".join(out)
        return text[1:] if self._starts_with_space(ids) else text


def _prefix_true(flag: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """True where flag holds from the group's first element (lead) up to here."""
    fails = np.cumsum(~flag)
    at = np.maximum.accumulate(np.where(lead, np.arange(len(flag)), 0))
    before = fails[at] - (~flag[at]).astype(np.int64)
    return fails == before


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts of one task; remembers a bounded number of words."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        ids, sizes = self.vocabulary.encode_words(words)
        n, self_n = len(self.known), len(self.known) + len(words)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (self.used + len(ids)))
        if self_n > len(self.sizes):
            self.sizes = np.resize(self.sizes, 2 * self_n)
        self.pool[self.used : self.used + len(ids)] = ids
        self.sizes[n:self_n] = sizes
        self.used += len(ids)
        self.known.update(zip(words, range(n, self_n), strict=True))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        v = self.vocabulary
        words, ends = [], []
        for text in texts:
            if text:
                words += v.word.findall(SPACE_MARK + text.replace(" ", SPACE_MARK))
            ends.append(len(words))
        if not words:
            return [np.array([v.bos, v.eos], np.uint32) for _ in texts]
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        if fresh:
            self._learn(fresh)
        codes = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        starts = np.cumsum(self.sizes[: len(self.known)]) - self.sizes[: len(self.known)]
        n = self.sizes[codes]
        ids = self.pool[np.repeat(starts[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        cuts = np.append(0, np.cumsum(n))[np.array([0, *ends])]
        begin, end = np.array([v.bos], np.uint32), np.array([v.eos], np.uint32)
        return [np.concatenate([begin, ids[a:b], end]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _by_chars(texts: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for text in texts:
        part.append(text)
        chars += len(text)
        if chars >= CHUNK_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def encode(df: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """df with out_col: array<int> of the ids of text_col, begin and end ids included."""
    df = cleared(df, [out_col], [text_col])
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        encoder = Encoder(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            found = [ids for part in _by_chars(texts) for ids in encoder(part)]
            offsets = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int32)
            flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*batch.schema.names, out_col])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with out_col: the text of ids_col (null ids: empty text)."""
    df = cleared(df, [out_col], [ids_col])
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType(), False)])

    def run(batches):
        v = vocabulary(model_path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            texts = [v.decode(np.array(x or [], np.int64)) for x in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id_col, n_tokens, ids_sha256 and decoded_sha256, encoded and decoded in one pass over the text."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        encoder = Encoder(model_path)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for part in _by_chars([t or "" for t in batch.column(1).to_pylist()]):
                for ids in encoder(part):
                    counts.append(len(ids))
                    encoded.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(encoder.vocabulary.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=schema.names)

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
