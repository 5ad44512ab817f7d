"""Entity mentions: patterns, a dictionary matched by an Aho-Corasick automaton, and capitalised phrases."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of a dictionary that are sent to the tasks at once; a larger one is matched block by block.
ENTRIES = 1 << 17
#: Kinds by pattern with their confidence, and those of the dictionary and of phrases.
PATTERNS = {"email": (r"[\w.+-]+@[\w-]+\.[\w.]+", 0.95), "url": (r"https?://[^\s<>\"]+", 0.95), "quantity": (r"\b\d+(?:\.\d+)?\s?(?:km|kg|m|cm|%|USD|EUR)\b", 0.8), "year": (r"\b(?:19|20)\d\d\b", 0.85)}
KNOWN, CONCEPT = 0.9, 0.5
PHRASE = re.compile(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b")
#: What may stand beside a short entry.
BORDER = frozenset(" \t\n\r\f\v,.;:!?()[]{}\"'-–—")
MENTION = [("kind", T.StringType()), ("mention", T.StringType()), ("entry", T.StringType()), ("start", T.LongType()), ("confidence", T.DoubleType())]


def lowered(text: str) -> str:
    """Lower case with the same positions: a character whose lower case is longer stays."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def matches(text: str, automaton) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entry) of all entries in a text in the order of their places. Entries of up to three characters need borders; of one kind, what
    lies inside a match that starts no later is dropped."""
    low, found = lowered(text), []
    for last, entries in automaton.iter(low):
        for kind, entry in entries:
            start, end = last + 1 - len(entry), last + 1
            free = (start == 0 or low[start - 1] in BORDER) and (end == len(low) or low[end] in BORDER)
            if free or len(entry) > 3:
                found.append((start, end, kind, entry))
    out, reach = [], {}
    for start, end, kind, entry in sorted(found, key=lambda m: (m[0], -m[1], m[2], m[3])):
        if end > reach.get(kind, -1):
            reach[kind] = end
            out.append((start, end, kind, entry))
    return out


def entities_of(text: str, automaton) -> list[tuple[str, str, str, int, float]]:
    """(kind, mention, entry, start, confidence) of a text: the first mention of each kind and lower-cased text, in the order of places."""
    found, seen = [], set()

    def add(kind, mention, entry, start, confidence):
        if (kind, mention.lower()) not in seen:
            seen.add((kind, mention.lower()))
            found.append((kind, mention, entry, start, confidence))

    for kind, (pattern, confidence) in PATTERNS.items():
        for m in re.finditer(pattern, text):
            add(kind, m[0], m[0], m.start(), confidence)
    if automaton is not None:
        for start, end, kind, entry in matches(text, automaton):
            add(kind, text[start:end], entry, start, KNOWN)
    known = {m.lower() for _, m, *_ in found}
    for m in PHRASE.finditer(text):
        if not any(k in m[0].lower() for k in known):
            add("concept", m[0], m[0], m.start(), CONCEPT)
    return sorted(found, key=lambda e: (e[3], -len(e[1]), e[0]))


def automaton_of(entries: list[tuple[str, str]]):
    """The automaton of (kind, entry), or None without entries; entries are lower-cased."""
    import ahocorasick

    told: dict[str, list[tuple[str, str]]] = {}
    for kind, entry in entries:
        if entry and (kind, lowered(entry)) not in told.setdefault(lowered(entry), []):
            told[lowered(entry)].append((kind, lowered(entry)))
    if not told:
        return None
    out = ahocorasick.Automaton()
    for entry, kinds in told.items():
        out.add_word(entry, sorted(kinds))
    out.make_automaton()
    return out


def mentions(df: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, kind, mention, entry, start, confidence) for a dictionary (kind, entry) that fits one block; null texts have none.

    The dictionary goes to the tasks as one automaton, so a text is read once whatever its size. More than ENTRIES entries are an error: cut the dictionary by
    kind, since matches of different kinds do not hide each other.
    """
    entries = [(r.kind, r.entry) for r in dictionary.select("kind", "entry").where("entry IS NOT NULL").distinct().orderBy("kind", "entry").limit(ENTRIES + 1).collect()]
    if len(entries) > ENTRIES:
        raise ValueError(f"more than {ENTRIES} entries")
    sent = df.sparkSession.sparkContext.broadcast(entries)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *[T.StructField(n, t) for n, t in MENTION]])

    def run(batches):
        automaton = automaton_of(sent.value)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                found = [(k, e) for k, t in enumerate(part.column(1).to_pylist()) if t for e in entities_of(t, automaton)]
                at = pa.array([k for k, _ in found], pa.int64())
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), *[pa.array([e[c] for _, e in found], t) for c, t in enumerate(kinds)]], names=schema.names)

    return df.select(key, F.col(text).cast("string")).mapInArrow(run, schema)


def summary(mentions_: DataFrame, key: str) -> DataFrame:
    """(key, entities, kinds, primary_kind, primary): how many, counts by kind as text, and the first mention of the greatest confidence."""
    by_kind = mentions_.groupBy(key, "kind").agg(F.count("*").alias("n"), F.min_by(F.struct("kind", "mention"), F.struct(-F.col("confidence"), "start")).alias("best"), F.min(F.struct(-F.col("confidence"), "start")).alias("rank"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat(x.kind, F.lit("="), x.n.cast("string"))), ",")
    return by_kind.groupBy(key).agg(F.sum("n").alias("entities"), told.alias("kinds"), F.min_by("best", "rank").alias("b")).select(key, "entities", "kinds", F.col("b.kind").alias("primary_kind"), F.col("b.mention").alias("primary"))
