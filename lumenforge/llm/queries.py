"""Queries of the operators, one thin function each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenforge.llm import packing

    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lumenforge.llm import sentencepiece_bpe

    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenforge.llm import html_text

    return html_text.digests(table(spark, sf_dir, "pages"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenforge.llm import jaccard_join

    return jaccard_join.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenforge.llm import licenses

    return licenses.report(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenforge.llm import chat

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return chat.digests(rows.unionByName(extra.select(*[F.col(c).cast(t) for c, t in rows.dtypes])))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenforge.llm import substring_dedup

    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenforge.llm import toxicity

    return toxicity.digests(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenforge.llm import ogg

    return ogg.digests(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenforge.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.rules(spark, docs, table(spark, sf_dir, "labels")).drop("text")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenforge.llm import ranked_search

    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lumenforge.llm import token_counts

    return token_counts.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenforge.llm import conversation_trie

    return conversation_trie.nodes(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_sentencepiece, op3_html_text, op4_jaccard_join, op5_licenses, op6_chat, op7_substring_dedup, op8_toxicity, op9_ogg, op10_quality, op11_ranked_search, op12_token_counts, op13_conversation_trie)}

ORACLE_SQL = {
    "op6_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '([<>\[\]])', '\1\\', 'g') AS x,
             regexp_replace(replace(role, '\', '\\'), '([<>\[\]])', '\1\\', 'g') AS r FROM c),
t AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             7 + sum(length(r) + length(x) + 15) AS formatted_chars,
             string_agg(CASE WHEN role IN ('system', 'user', 'assistant') THEN substr(role, 1, 1) ELSE 'x' END, '' ORDER BY turn, role, text) AS roles
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars, regexp_full_match(roles, 's?u(au)*a?') AS valid
FROM t""",
    "op11_ranked_search": r"""
WITH told AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
doc AS (SELECT row, doc_id, t, len(t) AS n FROM told WHERE len(t) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM doc),
item AS (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
posting AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(t) AS term FROM doc) WHERE term IN (SELECT term FROM item) GROUP BY ALL),
held AS (SELECT term, count(*) AS df FROM posting GROUP BY term),
gain AS (SELECT row, doc_id, p.term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms)))) AS g
         FROM posting p JOIN held USING (term) CROSS JOIN total),
ranked AS (SELECT item, item_id, doc_id, sum(g)::BIGINT AS score, row_number() OVER (PARTITION BY item ORDER BY sum(g) DESC, doc_id) AS rank
           FROM item JOIN gain USING (term) GROUP BY item, item_id, row, doc_id HAVING sum(g) > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
    # crc32 by its table; a node is told by the list of its turns, a subtree by the prefixes of its nodes
    "op13_conversation_trie": r"""
WITH RECURSIVE bits(b, k, v) AS (SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc(conv_id, i, v) AS (SELECT conv_id, 0, 4294967295 FROM own
  UNION ALL SELECT conv_id, i + 1, xor(crc.v >> 8, bits.v) FROM crc JOIN bits ON k = 8 AND b = xor(crc.v & 255, ascii(substr(conv_id::VARCHAR, i + 1, 1))) WHERE i < length(conv_id::VARCHAR)),
heads AS (SELECT conv_id, (xor(v, 4294967295) % 4)::BIGINT AS h FROM crc WHERE i = length(conv_id::VARCHAR)),
built AS (SELECT own.conv_id, list_concat(coalesce(base.turns[1:h], []), own.turns[h + 1:]) AS turns
          FROM own JOIN heads USING (conv_id) LEFT JOIN own AS base ON base.conv_id = own.conv_id - own.conv_id % 20),
prefixes AS (SELECT conv_id, turns[1:d] AS path, d, d = len(turns) AS ended FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM built)),
node AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '') AS ends FROM prefixes GROUP BY path, d),
family AS (SELECT a.*, p.conv_id AS parent_conv_id,
                  CASE WHEN a.d = 0 THEN 0 ELSE (a.n_convs - 1) * len(regexp_extract_all(a.path[a.d].text, '[^\x20\x09-\x0D]+')) END AS saves
           FROM node a LEFT JOIN node p ON p.d = a.d - 1 AND p.path = a.path[1:a.d - 1]),
kids AS (SELECT path[1:d - 1] AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
whole AS (SELECT f.*, coalesce(k.n, 0) AS n_children FROM family f LEFT JOIN kids k USING (path)),
below AS (SELECT path[1:k] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saves)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM whole) GROUP BY ALL)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256 FROM whole JOIN below USING (path)""",
}
