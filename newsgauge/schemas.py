"""Canonical table schemas. Timestamps carry no zone: all times are UTC."""

from pyspark.sql import types as T

_S, _D, _TS = T.StringType(), T.DoubleType(), T.TimestampNTZType()

SENTIMENT = T.StructType([
    T.StructField("id", _S, False),
    T.StructField("ticker", _S, False),
    T.StructField("ts", _TS, False),
    T.StructField("source", _S, False),
    T.StructField("text", _S),
    T.StructField("sentiment_score", _D),
    T.StructField("sentiment_label", _S),
    T.StructField("confidence", _D),
    T.StructField("attributes", T.MapType(_S, _D)),
    T.StructField("metadata", T.MapType(_S, _S)),
])

MARKET_EVENT = T.StructType([
    T.StructField("id", _S, False),
    T.StructField("headline", _S, False),
    T.StructField("tickers", T.ArrayType(_S), False),
    T.StructField("content", _S),
    T.StructField("published_at", _TS, False),
    T.StructField("source", _S, False),
    T.StructField("credibility_score", _D, False),
])

EVENT_FLAT = T.StructType([
    T.StructField("id", _S, False),
    T.StructField("ticker", _S, False),
    T.StructField("ts", _TS),
    T.StructField("event_type", _S, False),
    T.StructField("title", _S, False),
    T.StructField("summary", _S),
    T.StructField("url", _S),
    T.StructField("source", _S),
    T.StructField("metadata", T.MapType(_S, _S)),
])

RAW_NEWS = T.StructType([
    T.StructField("category", _S),
    T.StructField("datetime", _S),  # epoch seconds or ISO text
    T.StructField("headline", _S),
    T.StructField("id", T.LongType()),
    T.StructField("image", _S),
    T.StructField("related", _S),
    T.StructField("source", _S),
    T.StructField("summary", _S),
    T.StructField("url", _S),
])

EARNINGS_ENTRY = T.StructType([
    T.StructField("date", _S),
    T.StructField("actual", _S),
    T.StructField("estimate", _S),
    T.StructField("epsActual", _S),
    T.StructField("epsEstimate", _S),
    T.StructField("surprise", _S),
    T.StructField("surprisePercent", _S),
    T.StructField("quarter", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
])

EARNINGS_PAYLOAD = T.StructType([
    T.StructField("earningsCalendar", T.ArrayType(EARNINGS_ENTRY)),
])

VENDOR_SENTIMENT = T.StructType([
    T.StructField("buzz", T.StructType([
        T.StructField("buzz", _D),
        T.StructField("articlesInLastWeek", T.LongType()),
        T.StructField("weeklyAverage", _D),
    ])),
    T.StructField("companyNewsScore", _D),
    T.StructField("sectorAverageNewsScore", _D),
    T.StructField("sectorAverageBullishPercent", _D),
    T.StructField("sector", _S),
    T.StructField("sentiment", T.StructType([
        T.StructField("bearishPercent", _D),
        T.StructField("bullishPercent", _D),
    ])),
])

ATTACHMENT = T.StructType([
    T.StructField("id", _S),
    T.StructField("file_path", _S),
    T.StructField("file_name", _S),
    T.StructField("file_type", _S),
    T.StructField("file_size", T.LongType()),
    T.StructField("description", _S),
    T.StructField("created_at", _S),
    T.StructField("uploaded_by", _S),
])

ITEM = T.StructType([
    T.StructField("id", _S, False),
    T.StructField("title", _S),
    T.StructField("description", _S),
    T.StructField("source", _S),
    T.StructField("status", _S),
    T.StructField("priority", _S),
    T.StructField("category", _S),
    T.StructField("subcategory", _S),
    T.StructField("relevance", _S),
    T.StructField("tags", T.ArrayType(_S)),
    T.StructField("epic_id", _S),
    T.StructField("task_id", _S),
    T.StructField("project_id", _S),
    T.StructField("created_by", _S),
    T.StructField("date_collected", _TS),
    T.StructField("created_at", _TS),
    T.StructField("updated_at", _TS),
    T.StructField("related_ids", T.ArrayType(_S)),
    T.StructField("attachments", T.ArrayType(ATTACHMENT)),
])

EDGE = T.StructType([
    T.StructField("source_id", _S, False),
    T.StructField("target_id", _S, False),
    T.StructField("rel_type", _S),
    T.StructField("strength", _S),
    T.StructField("impact_score", T.IntegerType()),
    T.StructField("updated_at", _TS),
])

OP_LOG = T.StructType([
    T.StructField("ts", _TS),
    T.StructField("backend", _S),
    T.StructField("op_type", _S),
    T.StructField("query_type", _S),
    T.StructField("error_type", _S),
    T.StructField("duration_ms", _D),
    T.StructField("severity", T.IntegerType()),
    T.StructField("ok", T.BooleanType()),
])
