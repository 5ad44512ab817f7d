"""Column functions over text, URLs and dates. All are built-in expressions; none runs Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenforge.functions.times import micros

#: Words that carry no meaning in a query or a document.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]
#: URL parameters that only track.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref|ref_src)(=|$)"
#: What lies between two words of tokens().
WORD_GAP = r"[^\p{L}\p{N}&+#]+"
CJK = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"


def tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Lower-case words of letters, digits, & + #; at least two characters, no stop words; CJK words as two-character pieces."""
    stops = F.array(*[F.lit(w) for w in (STOP_WORDS if stop is None else stop)])
    words = F.filter(F.split(F.lower(text), WORD_GAP), lambda w: (F.char_length(w) > 1) & ~F.array_contains(stops, w))

    def pieces(w: Column) -> Column:
        return F.when(w.rlike(CJK) & (F.char_length(w) > 2), F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array(w))

    return F.when(text.rlike(CJK), F.array_distinct(F.flatten(F.transform(words, pieces)))).otherwise(words)


def domain(url: Column) -> Column:
    """Host of an http(s) URL without a leading www.; '' if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://(?:[^/@]*@)?([^/?#:]+)", 1)), r"^www\.", ""), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Key of a URL: no scheme, fragment, tracking parameters or trailing slashes; lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[a-zA-Z]+://", "")
    path = F.regexp_replace(F.regexp_replace(bare, r"\?.*$", ""), r"/+$", "")
    params = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    return F.lower(F.when(F.size(params) > 0, F.concat(path, F.lit("?"), F.array_join(params, "&"))).otherwise(path))


def text_key(text: Column) -> Column:
    """A text in lower case with everything but letters and digits collapsed to single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def title_key(title: Column) -> Column:
    """First 80 characters of a title's text key."""
    return F.substring(text_key(title), 1, 80)


def suffixes(host: Column) -> Column:
    """All label suffixes of a host: a.b.c -> [a.b.c, b.c, c]."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def token_estimate(text: Column) -> Column:
    """Model tokens by script: length / 1.8 for CJK text, else length / 4, rounded up."""
    return F.ceil(F.char_length(text) / F.when(text.rlike(CJK), F.lit(1.8)).otherwise(F.lit(4.0))).cast("long")


def script_label(text: Column) -> Column:
    return F.when(text.rlike(r"[\x{AC00}-\x{D7AF}]"), "ko").when(text.rlike(r"[\x{3040}-\x{30FF}]"), "ja").when(text.rlike(r"[\x{4E00}-\x{9FFF}]"), "zh").otherwise("en")


def sentences(text: Column) -> Column:
    """Sentences: breaks after . ! ? and CJK terminators, not after common abbreviations."""
    parts = F.split(text, r"(?<=[.!?])(?<!\b(?:Mr|Mrs|Dr|St|vs|etc|e\.g|i\.e)\.)\s+|(?<=[\x{3002}\x{FF01}\x{FF1F}])|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def clean_query(text: Column) -> Column:
    """Percent-decoding (up to four times), trimmed and collapsed."""
    decoded = reduce(lambda c, _: F.coalesce(F.try_url_decode(c), c), range(4), text)
    return F.trim(F.regexp_replace(decoded, r"\s+", " "))


def keywords(text: Column, n: int = 5) -> Column:
    """Up to n distinct terms without stop words and years."""
    return F.slice(F.array_distinct(F.filter(tokens(text), lambda w: ~w.rlike(r"^(19|20)\d\d$"))), 1, n)


def parse_date(text: Column, now: Column) -> Column:
    """Timestamp of ISO dates, Y.M.D, 'Mon D, YYYY' and relative times in English and Korean; null if nothing fits."""
    t = F.trim(text)
    ymd = F.regexp_replace(F.regexp_extract(t, r"^(\d{4}[./]\s?\d{1,2}[./]\s?\d{1,2})\.?$", 1), r"[./]\s?", "-")
    number = F.regexp_extract(t, r"(\d+)", 1).try_cast("int")
    units = [(r"second|초", 1), (r"minute|min\b|분", 60), (r"hour|시간", 3600), (r"day|일", 86400), (r"week|주", 604800), (r"month|개월|달", 2592000), (r"year|년", 31536000)]
    ago = F.when(t.rlike(r"(?i)\bago\b|전$"), reduce(lambda rest, u: F.when(F.lower(t).rlike(r"\d\s*(" + u[0] + ")"), number * u[1]).otherwise(rest), reversed(units), F.lit(None).cast("int")))
    relative = F.timestamp_micros(micros(now) - ago.cast("long") * 1_000_000)
    named = F.when(F.lower(t).isin("yesterday", "어제"), F.timestamp_micros(micros(now) - 86_400_000_000)).when(F.lower(t).isin("today", "오늘", "now", "just now", "방금"), now)
    iso = F.when(t.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_timestamp(t))
    return F.coalesce(iso, F.try_to_timestamp(F.when(ymd != "", ymd), F.lit("y-M-d")), F.try_to_timestamp(F.when(t.rlike(r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"), t), F.lit("MMM d, y")), relative, named)


def entity_decode(text: Column) -> Column:
    """The character references that pages use most; & last, so nothing is decoded twice."""
    pairs = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def page_text(html: Column) -> Column:
    """Text of a page: boilerplate elements and comments out, block tags to line breaks, other tags to spaces, decoded, collapsed."""
    x = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|header|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)</?(p|div|h[1-6]|li|ul|ol|tr|table|br|section|article|blockquote)[^>]*>", "\n")
    x = entity_decode(F.regexp_replace(x, r"<[^>]+>", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\s*\n\s*", "\n"))
