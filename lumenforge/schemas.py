"""Explicit schemas of the library's relations."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    fields = [part.rsplit(" ", 1) for part in text.split(", ")]
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType()), "doubles": T.ArrayType(T.DoubleType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in fields])


CATALOGUE = _struct("id string, url string, domain string, title string, language string, content_hash string, total_chunks long, importance double, priority long, status string, last_indexed timestamp, next_index_at timestamp")
SCHEDULE = _struct("url string, priority long, status string, next_index_at timestamp, completed_at timestamp")
CRAWL_QUEUE = _struct("url string, domain string, priority long, status string, source string, due_at timestamp, completed_at timestamp")
BLACKLIST = _struct("domain string, reason string, added_at timestamp, expires_at timestamp")
REPUTATION = _struct("domain string, authority double, freshness double, quality double, crawlability double")
REQUESTS = _struct("ts timestamp, backend string, outcome string, latency_s double")
CLICK = _struct("user_id long, query string, url string, position int, ts timestamp")
RESULT = T.StructType([T.StructField("url", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("features", T.ArrayType(T.DoubleType()))])
IMPRESSION = T.StructType([*_struct("impression_id long, user_id long, query string, variant string, ts timestamp").fields, T.StructField("results", T.ArrayType(RESULT))])
EVAL_RESULT = T.StructType([T.StructField("query", T.StructType([T.StructField("id", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])), T.StructField("resultCount", T.LongType()), T.StructField("responseTimeMs", T.DoubleType()), T.StructField("backends", T.ArrayType(T.StringType())), T.StructField("passed", T.BooleanType()), T.StructField("response", T.StructType([T.StructField("results", T.ArrayType(_struct("url string, domain string, title string, score double")))]))])
EVAL_REPORT = T.StructType([T.StructField("results", T.ArrayType(EVAL_RESULT))])
EVENTS = _struct("event_id long, ts timestamp, user_id long, event_type string, value double, props string")
