"""Text tables: sections, chunks, sentences, labels, entities, claims, structured data, injection scans."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge.functions import text as X
from lumenforge.operators import clusters as C
from lumenforge.operators import sentence_cut as S
from lumenforge.operators.joins import salted_join
from lumenforge.sources.storage import dropped, kept

MAX_CHARS, MIN_CHARS, OVERLAP, SMALL_TOKENS = 1200, 200, 200, 300

#: Labelled patterns of instructions that try to take over a model.
INJECTION = [
    ("override", 3, r"(?i)\b(ignore|disregard|forget)\b.{0,30}\b(previous|above|prior|all)\b.{0,20}\b(instructions?|rules?|prompts?)\b"),
    ("role_change", 2, r"(?i)\byou are now\b|\bact as\b.{0,20}\b(admin|root|system|developer)\b"),
    ("leak", 3, r"(?i)\b(reveal|show|print|repeat)\b.{0,20}\b(system prompt|hidden instructions?)\b"),
    ("delimiter", 1, r"(?i)<\|?(system|im_start|im_end)\|?>|\[/?INST\]|</s>"),
    ("encoded", 1, r"(?i)\b(base64|rot13)\b.{0,20}\b(decode|decrypt)\b"),
]
#: Topic words in dictionary order; the first match wins.
TOPICS = [("technology", "software|computer|program|code|data"), ("business", "market|stock|company|price"), ("health", "health|doctor|medicine|disease"), ("science", "research|physics|chemistry|biology")]


def sections(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, n, level, heading, path, text): headings split the page; the path holds the open headings of the levels above."""
    marked = F.regexp_replace(F.regexp_replace(F.col(html), r"(?is)<(script|style|nav|footer|header)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " "), r"(?is)<h([1-6])[^>]*>(.*?)</h\1>", "\u0001$1$2\u0002")
    parts = pages.select(page, F.posexplode(F.split(marked, "\u0001")).alias("n", "part"))
    level = F.regexp_extract("part", "(?s)^([1-6])[^\u0002]*\u0002", 1)
    plain = lambda c: F.trim(F.regexp_replace(X.entity_decode(F.regexp_replace(c, r"<[^>]*>", " ")), r"\s+", " "))
    x = parts.select(page, "n", F.when(level != "", level.cast("int")).otherwise(0).alias("level"), plain(F.regexp_extract("part", "(?s)^[1-6]([^\u0002]*)\u0002", 1)).alias("heading"), plain(F.regexp_replace("part", "(?s)^[1-6][^\u0002]*\u0002", "")).alias("text"))
    by = Window.partitionBy(page).orderBy("n")
    for k in range(1, 7):  # the heading of level k that is open here, if no shallower one has come since
        last_k = F.max(F.when(F.col("level") == k, F.col("n"))).over(by)
        last_up = F.max(F.when((F.col("level") > 0) & (F.col("level") < k), F.col("n"))).over(by)
        name = F.last(F.when(F.col("level") == k, F.col("heading")), ignorenulls=True).over(by)
        x = x.withColumn(f"h{k}", F.when(last_k.isNotNull() & (last_up.isNull() | (last_k > last_up)) & ((F.col("level") >= k) | (F.col("level") == 0)), name))
    return x.select(page, "n", "level", "heading", F.concat_ws(" > ", *[f"h{k}" for k in range(1, 7)]).alias("path"), "text").where("level > 0 OR text <> ''")


def cut_chunks(text: str, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Windows of at most max_chars that end at the last sentence end beyond min_chars, each overlapping the one before."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + max_chars)
        if end < len(text):
            stops = [p for p in (text.rfind(s, at + min_chars, end) for s in (". ", "! ", "? ", "\n", "。")) if p >= 0]
            if stops:
                end = max(stops) + 1
        piece = text[at:end].strip()
        if piece and (len(piece) >= min_chars or not out):
            out.append(piece)
        elif piece:
            out[-1] = (out[-1] + " " + piece).strip()
        if end >= len(text):
            break
        at = max(at + 1, end - overlap)
    return out


def chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, chunk, tokens, total): short texts are one chunk, long ones sliding windows."""

    def run(batches):
        for pdf in batches:
            rows = [(k, n, c) for k, t in zip(pdf[key], pdf[text], strict=True) for n, c in enumerate([t] if t and -(-len(t) // 4) <= SMALL_TOKENS else cut_chunks(t or ""))]
            yield pd.DataFrame(rows, columns=[key, "n", "chunk"])

    cut = df.select(key, F.col(text).cast("string")).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, n long, chunk string")
    return cut.withColumn("tokens", X.token_estimate(F.col("chunk"))).withColumn("total", F.count("*").over(Window.partitionBy(key)))


def word_windows(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, n, chunk): windows of `size` words that share `overlap` words."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    step = size - overlap
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - overlap, F.lit(1)), F.lit(step))
    x = df.select(key, words.alias("_w")).where(F.size("_w") > 0)
    return x.select(key, F.posexplode(F.transform(starts(F.col("_w")), lambda i: F.array_join(F.slice("_w", i, size), " "))).alias("n", "chunk"))


def pack_paragraphs(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, n, chunk): paragraphs packed greedily up to `words` words; a longer paragraph is a chunk of its own."""
    parts = F.filter(F.transform(F.split(F.col(text), r"\n+"), lambda s: F.trim(s)), lambda p: p != "")
    count = lambda s: F.size(F.split(s, r"\s+"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, p: Column) -> Column:
        fits = (a["open"] != "") & (count(F.concat(a["open"], F.lit(" "), p)) <= words)
        return F.struct(F.when((a["open"] == "") | fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))).alias("done"), F.when(fits, F.concat(a["open"], F.lit("\n"), p)).otherwise(p).alias("open"))

    packed = F.aggregate(parts, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return df.select(key, F.posexplode(packed).alias("n", "chunk"))


def sentence_table(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(X.sentences(F.col(text))).alias("n", "sentence"))


def injection_scan(df: DataFrame, text: str) -> DataFrame:
    """df with labels (matched patterns), severity (the highest) and quarantine (severity 3)."""
    hits = [F.col(text).rlike(p) for *_, p in INJECTION]
    labels = F.array_compact(F.array(*[F.when(h, F.lit(n)) for h, (n, *_) in zip(hits, INJECTION, strict=True)]))
    severity = F.greatest(*[F.when(h, F.lit(s)).otherwise(0) for h, (_, s, _) in zip(hits, INJECTION, strict=True)])
    return df.withColumn("labels", labels).withColumn("severity", severity).withColumn("quarantine", F.col("severity") >= 3)


def topic(text: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(text).rlike(p), F.lit(n)) for n, p in TOPICS], F.lit("general"))


#: Ends of a whole word, for expressions that Java and RE2 read alike: \\b splits letters beyond ASCII in some of them.
OPEN, SHUT = r"(?:^|[^\p{L}\p{M}\p{N}_])", r"(?:$|[^\p{L}\p{M}\p{N}_])"
CONJUNCTIONS = ["and", "or", "but", "und", "et", "y", "if"]


def _holds(text: Column, words: str, opening: str = OPEN) -> Column:
    """Whether the text has one of the words (w|w) as a whole word, in either case; opening ^: as its first word."""
    return F.lower(text).rlike(f"{opening}(?:{words}){SHUT}")


def intent(text: Column) -> Column:
    """Label of a query by weighted whole words; ties go to the first label in the alphabet."""
    weighted = {
        "question": [(_holds(text, "what|who|when|where|why|how", "^"), 2.0), (F.contains(text, F.lit("?")), 1.0)],
        "compare": [(_holds(text, "vs|versus|compare|better"), 2.5)],
        "buy": [(_holds(text, "buy|price|cheap|deal"), 2.0)],
        "news": [(_holds(text, "news|latest|today"), 2.0)],
    }
    scores = [F.struct(reduce(lambda a, b: a + b, [F.when(p, F.lit(w)).otherwise(0.0) for p, w in rules]).alias("score"), F.lit(name).alias("label")) for name, rules in sorted(weighted.items(), reverse=True)]
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] > 0, best["label"]).otherwise("search")


def query_labels(text: Column) -> list[Column]:
    """intent, subtype, is_question and complexity (words, and two for each conjunction that is a whole word) of a query."""
    label = intent(text)
    words = F.size(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    wh = _holds(text, "what|who|when|where|why|how", "^")
    subtype = (
        F.when(label == "question", F.when(_holds(text, "how|why", "^"), "explanation").otherwise("fact"))
        .when(label == "compare", "versus")
        .when(label == "buy", F.when(_holds(text, "price|cheap"), "price").otherwise("purchase"))
        .when(label == "news", F.when(_holds(text, "latest|today"), "latest").otherwise("topic"))
        .otherwise(F.when(words <= 3, "short").otherwise("long"))
    )
    load = words + 2 * F.size(F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}_]+"), lambda w: w.isin(CONJUNCTIONS)))
    complexity = F.when(load < 8, "low").when(load < 30, "medium").otherwise("high")
    return [label.alias("intent"), subtype.alias("subtype"), (wh | F.contains(text, F.lit("?"))).alias("is_question"), complexity.alias("complexity")]


def structured_data(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, type, name, rating, price, items) of structured data: JSON-LD objects (single, in arrays, in @graph); for pages without
    any, microdata; for pages without both, meta tags. Ratings are capped at 5; items counts the questions of a FAQ and the steps of
    a breadcrumb list."""
    raw = F.explode(F.regexp_extract_all(F.col(html), F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), 1)).alias("raw")
    v = F.try_parse_json("raw")
    many = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array(v))
    x = pages.select(page, raw).select(page, F.explode(many).alias("o"))
    get = lambda path, kind: F.try_variant_get("o", path, kind)
    price = F.coalesce(get("$.offers.price", "double"), get("$.offers[0].price", "double"))
    listed = F.coalesce(F.size(get("$.mainEntity", "array<variant>")), F.lit(-1)), F.coalesce(F.size(get("$.itemListElement", "array<variant>")), F.lit(-1))
    rating = lambda c: F.when(c.isNotNull(), F.least(c, F.lit(5.0))).alias("rating")
    script = x.select(page, get("$['@type']", "string").alias("type"), F.coalesce(get("$.name", "string"), get("$.headline", "string")).alias("name"), rating(get("$.aggregateRating.ratingValue", "double")), price.alias("price"), F.greatest(*listed, F.lit(0)).cast("long").alias("items")).where("type IS NOT NULL")
    found = lambda p: F.nullif(F.regexp_extract(html, p, 1), F.lit(""))
    prop = lambda n: F.coalesce(found(rf'(?is)itemprop="{n}"[^>]*content="([^"]*)"'), found(rf'(?is)itemprop="{n}"[^>]*>([^<]*)<'))
    micro = pages.where(F.col(html).contains("itemscope")).select(page, found(r'(?is)itemtype="[^"]*/(\w+)"').alias("type"), prop("name").alias("name"), rating(prop("ratingValue").try_cast("double")), prop("price").try_cast("double").alias("price"), F.lit(0).cast("long").alias("items")).where("type IS NOT NULL")
    meta = lambda n: found(rf'(?is)<meta[^>]*(?:property|name)="{n}"[^>]*content="([^"]*)"')
    tags = pages.select(page, meta("og:type").alias("type"), meta("og:title").alias("name"), F.lit(None).cast("double").alias("rating"), meta("product:price:amount").try_cast("double").alias("price"), F.lit(0).cast("long").alias("items")).where("type IS NOT NULL")
    first = script.unionByName(micro.join(script.select(page).distinct(), page, "left_anti"))
    return first.unionByName(tags.join(first.select(page).distinct(), page, "left_anti"))


#: Words that negate a statement, of English, German and Spanish as whole words, of Korean, Chinese and Japanese as pieces, and units of quantities.
NEGATION_WORDS = """not, never, nobody, nothing, neither, denies, denied, refuse, refuses, refused, lack, lacks, lack of, fail to, fails to,
doesn't, don't, isn't, aren't, wasn't, weren't, hasn't, haven't, cannot, can't, won't, wouldn't, shouldn't,
nicht, kein, keine, keinem, keinen, keiner, keines, niemals, jamais, nunca, tampoco"""
NEGATION_PIECES = "아니|않|없|못|불가|부정|거부|반대|不|没有|不是|无法|不能|否认|缺乏|反对|拒绝|ない|ません|ではない|ではなかった|できません|できず|反対|拒否"
NEGATIONS = r"(?i)(?:^|[^\p{L}\p{N}_])(?:" + "|".join(w.strip().replace("'", r"['\x{2019}]?") for w in NEGATION_WORDS.split(",")) + r")(?:$|[^\p{L}\p{N}_])|" + NEGATION_PIECES
UNITS = r"(%|percent|％|pp|bp|만|억|조|원|달러|엔|유로|billion|trillion|million|thousand|개|년|월|kg|km|gb|tb|mb|hz|ghz)"
#: Phrases of page furniture.
FURNITURE = r"(?i)subscribe|newsletter|cookie|click here|sign up|log in|©|copyright|all rights reserved|javascript|menu|footer|privacy policy|terms of service|skip to content"
#: Lengths of a claim; half and one and a half of them for CJK text.
CLAIM_LENGTHS = (40, 300)


def claims(df: DataFrame, key: str, text: str, per_source: int | None = 6, more: tuple[str, ...] = (), sets: bool = False) -> DataFrame:
    """(key, more, n, claim, score, negated, quantities): the per_source most telling sentences of each row (all, if None).

    A sentence has a claim's length and a score above 0: 0.35 for 60 to 220 characters or 0.15 for another length, 0.3 with a digit, 0.2 for CJK
    or 0.15 for a capitalised word, less 0.6 for page furniture and 0.5 for a run of one character. Equal sentences of a row count
    once. quantities: distinct (unit, value) of the numbers with a unit. sets: with the columns of C.sets_of() in place of the claim.
    """
    df = df.where(F.col(text).isNotNull()).select(key, *more, F.col(text).cast("string").alias("_text"))
    repeated = not df.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()  # rows with one key count as one text
    bare = sets and not repeated and per_source is None
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]) + ", " + S.types_of(bare)
    s = df.mapInArrow(S.claim_cutter(1 + len(more), bare, CLAIM_LENGTHS, FURNITURE, NEGATIONS, UNITS), types)
    other = _claims_by_rule(df.where(~S.is_plain(F.col("_text"))), key, "_text", more)
    s = s.unionByName(C.hashed_sets(other, "claim") if bare else other)
    if repeated:
        s = _first_of_equal(s, key)
    if per_source is not None:
        s = s.withColumn("_p", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "n"))).where(F.col("_p") <= per_source)
    if sets and not bare:
        s = C.hashed_sets(s, "claim")
    return s.select(key, *more, "n", *(() if sets else ("claim",)), (F.col("score") / 100).alias("score"), "negated", "quantities", *(("s", "w") if sets else ()))


def _first_of_equal(s: DataFrame, key: str) -> DataFrame:
    s = s.withColumn("_k", F.unhex(F.sha2(X.text_key(F.col("claim")), 256)))
    return s.withColumn("_d", F.row_number().over(Window.partitionBy(key, "_k").orderBy("n"))).where("_d = 1").drop("_k", "_d")


def _claims_by_rule(df: DataFrame, key: str, text: str, more: tuple[str, ...]) -> DataFrame:
    """(key, more, n, claim, score in hundredths, negated, quantities) of texts in any script."""
    low, high = CLAIM_LENGTHS
    s = df.select(key, *more, F.posexplode(X.sentences(F.col(text))).alias("n", "claim"))
    size, cjk = F.char_length("claim"), F.col("claim").rlike(X.CJK)
    s = s.where(F.when(cjk, size.between(low // 2, high + high // 2)).otherwise(size.between(low, high)))
    # in hundredths, so that sums are exact
    score = (
        F.when(size.between(60, 220), 35).when(size >= 40, 15).otherwise(0)
        + F.when(F.col("claim").rlike(r"\d"), 30).otherwise(0)
        + F.when(cjk, 20).when(F.col("claim").rlike(r"[A-Z][a-z]+|[A-Z]{2,}"), 15).otherwise(0)
        - F.when(F.col("claim").rlike(FURNITURE), 60).otherwise(0)
        - F.when(F.col("claim").rlike(r"(?s)(.)\1{5,}"), 50).otherwise(0)
    )
    s = s.withColumn("score", score).where("score > 0")
    s = _first_of_equal(s, key)
    told = F.regexp_extract_all("claim", F.lit(r"(?i)(\d+(?:[.,]\d+)*)\s*" + UNITS), 0)
    quantity = F.transform(told, lambda m: F.struct(F.lower(F.regexp_extract(m, r"(?i)" + UNITS + "$", 1)).alias("unit"), F.regexp_replace(F.regexp_extract(m, r"^([\d.,]+)", 1), ",", "").try_cast("double").alias("value")))
    return s.select(key, *more, F.col("n").cast("long").alias("n"), "claim", F.col("score").cast("int").alias("score"), F.col("claim").rlike(NEGATIONS).alias("negated"), F.array_sort(F.array_distinct(F.filter(quantity, lambda q: q.value.isNotNull()))).alias("quantities"))


def claim_clusters(claims_: DataFrame, item: str, least: float = 0.55, with_quantity: float = 0.3) -> DataFrame:
    """claims_ without their texts, with cluster, kept: the least item of the claims that are linked with it.

    Two claims are linked if the Dice overlap of their words is `least`, or `with_quantity` if they share a quantity. A claim without
    words is a cluster of its own. A Dice overlap d is a Jaccard of d / (2 - d). Claims with the same words are one class.
    claims_ have texts, or their sets of words.
    """
    rows = kept(claims_ if "w" in claims_.columns else C.hashed_sets(claims_, "claim"), "claim-words", bare=True)
    worded = rows.where(F.size("w") > 0)
    classes = worded.groupBy("s").agg(F.min(item).alias("c"), F.count("*").alias("n"), F.first("w").alias("w"))
    classes = kept(classes.withColumn("i", F.monotonically_increasing_id()), "claim-classes", bare=True)
    links = C.linked(classes, least / (2 - least)).select("a", "b")
    counted = worded.where(F.size("quantities") > 0).groupBy("s").agg(F.array_distinct(F.flatten(F.collect_set("quantities"))).alias("q"))
    if not counted.isEmpty():
        told = kept(classes.join(counted, "s").select("i", "c", "w", "q"), "claim-quantities", bare=True)
        near = C.linked(told, with_quantity / (2 - with_quantity)).select("a", "b")
        both = near.join(told.select(F.col("c").alias("a"), F.col("q").alias("qa")), "a").join(told.select(F.col("c").alias("b"), F.col("q").alias("qb")), "b")
        links = links.unionByName(both.where(F.arrays_overlap("qa", "qb")).select("a", "b"))
    found = C.components(links, "a", "b").select(F.col("node").alias("c"), F.col("component").alias("cluster"))
    sizes = classes.select("s", "c", "n")
    named = sizes.join(found, "c", "left").select("s", F.coalesce("cluster", "c").alias("cluster"))
    rest = [c for c in rows.columns if c not in ("s", "w")]
    placed = salted_join(worded.select("s", *rest), named, ["s"], sizes.select("s", "n"), F.col(item)).select(*rest, "cluster")
    out = kept(placed.unionByName(rows.where(F.size("w") == 0).select(*rest, F.col(item).alias("cluster"))), "claim-clusters", bare=True)
    for table in (rows, classes):
        dropped(table)
    return out


def conflicts(clustered: DataFrame, item: str) -> DataFrame:
    """(cluster, kind, unit, a, b, n_a, n_b): what contradicts inside clusters of claims, without forming the pairs of a cluster.

    negation: once for a cluster with denied and stated claims; a is the least stated and b the least denied item, n_a and n_b
    their numbers. numeric: claims of a cluster with one unit and value are a class (n_a claims, a the least item); it contradicts
    every larger value of that unit that exceeds it by 1 or more and by over 15 % of the larger one. n_b counts these claims and b is the
    least item of the nearest such value. Their places are found by running counts over the sorted values, so a class is one row.
    """
    denied = F.col("negated")
    sides = clustered.groupBy("cluster").agg(F.min(F.when(~denied, F.col(item))).alias("a"), F.min(F.when(denied, F.col(item))).alias("b"), F.count_if(~denied).alias("n_a"), F.count_if(denied).alias("n_b"))
    negation = sides.where("n_a > 0 AND n_b > 0").select("cluster", F.lit("negation").alias("kind"), F.lit("").alias("unit"), "a", "b", "n_a", "n_b")
    told = clustered.select("cluster", item, F.explode("quantities").alias("q"))
    classes = told.groupBy("cluster", "q.unit", "q.value").agg(F.min(item).alias("a"), F.count("*").alias("n_a"))

    def beyond(at: Column, probe: Column, first: int, out: str) -> DataFrame:
        """For each class, the claims at or behind its probe on a sorted axis; first: whether classes or probes come first on ties."""
        on = classes.select("cluster", "unit", at.alias("x"), F.lit(first).alias("turn"), F.lit(None).cast("double").alias("own"), "n_a", F.struct("value", "a").alias("named"))
        asks = classes.select("cluster", "unit", probe.alias("x"), F.lit(1 - first).alias("turn"), F.col("value").alias("own"), F.lit(0).cast("long").alias("n_a"), F.lit(None).cast("struct<value:double,a:string>").alias("named"))
        behind = Window.partitionBy("cluster", "unit").orderBy(F.desc("x"), F.desc("turn")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = on.withColumn("named", F.col("named").cast("struct<value:double,a:string>")).unionByName(asks)
        return ranked.withColumn("n", F.sum("n_a").over(behind)).withColumn("next", F.min("named").over(behind)).where("own IS NOT NULL").select("cluster", "unit", F.col("own").alias("value"), F.struct("n", "next").alias(out))

    # both conditions hold from a place on: the later of the two places is the one with fewer claims behind it
    one = beyond(F.col("value"), F.col("value") + 1, 1, "one")
    share = beyond(F.col("value") * 0.85, F.col("value"), 0, "share")
    both = classes.join(one, ["cluster", "unit", "value"]).join(share, ["cluster", "unit", "value"]).withColumn("far", F.when(F.col("one.n") <= F.col("share.n"), F.col("one")).otherwise(F.col("share")))
    numeric = both.where("far.n > 0").select("cluster", F.lit("numeric").alias("kind"), "unit", "a", F.col("far.next.a").alias("b"), "n_a", F.col("far.n").alias("n_b"))
    return negation.unionByName(numeric)


def corroboration(clustered: DataFrame, item: str, source: str, conflicts_: DataFrame) -> DataFrame:
    """(cluster, representative, n_claims, n_sources, agreement, conflicts, verdict, confidence) of each cluster of claims.

    The representative is the claim of the greatest score. agreement: share of the other claims that come from another source than
    it. conflicting: with a conflict; corroborated: two sources or more; else single-source. confidence: 0.25, 0.4 more if corroborated or 0.05 if single-source, a
    fifth of the agreement, up to 0.1 for four sources, less 0.25 for each conflict; from 0 to 0.95.
    """
    best = F.min_by(F.struct(F.col(item).alias("item"), F.col(source).alias("source")), F.struct(-F.col("score"), F.col(item))).alias("best")
    sides = clustered.groupBy("cluster", F.col(source).alias("_source")).agg(F.count("*").alias("n"), best, F.min(F.struct(-F.col("score"), F.col(item))).alias("rank"))
    whole = sides.groupBy("cluster").agg(F.sum("n").alias("n_claims"), F.count("_source").alias("n_sources"), F.min_by("best", "rank").alias("best"), F.min_by("n", "rank").alias("own"))
    found = whole.join(conflicts_.groupBy("cluster").agg(F.count("*").alias("conflicts")), "cluster", "left").na.fill(0, ["conflicts"])
    agreement = F.when(F.col("n_claims") > 1, (F.col("n_claims") - F.col("own")) / (F.col("n_claims") - 1)).otherwise(0.0)
    verdict = F.when(F.col("conflicts") > 0, "conflicting").when(F.col("n_sources") >= 2, "corroborated").otherwise("single-source")
    found = found.withColumn("agreement", agreement).withColumn("verdict", verdict)
    raw = 0.25 + F.when(F.col("verdict") == "corroborated", 0.4).when(F.col("verdict") == "single-source", 0.05).otherwise(0.0) + 0.2 * F.col("agreement") + 0.1 * F.least(F.col("n_sources") / 4, F.lit(1.0)) - 0.25 * F.col("conflicts")
    return found.select("cluster", F.col("best.item").alias("representative"), "n_claims", "n_sources", F.round("agreement", 6).alias("agreement"), "conflicts", "verdict", F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(0.95)), 6).alias("confidence"))


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """Deterministic L2-normalised embedding of hashed words, as a vectorised function over the column."""
    import numpy as np

    @F.pandas_udf("array<double>")
    def embed(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            v = np.zeros(dims)
            words = (t or "").lower().split()
            if words:
                h = pd.util.hash_array(np.array(words, object), categorize=False)
                np.add.at(v, (h % dims).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0))
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return embed(text)
