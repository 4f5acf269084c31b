"""Domain tables as deterministic projections of the given tables, in Spark and in SQL.

Library functions take canonical columns and know nothing of these adapters. Every view covers all rows of its
base tables; the remainders below only assign values to rows, they never choose rows (but for the changes that
``replica`` makes, so that reconciliation has something to find, and the relation records, which are purchases).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def _ticker(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit("T"), F.lpad((column % 20).cast("string"), 2, "0"))


def _t(sql: str) -> str:
    return f"('T' || lpad(CAST(({sql}) % 20 AS VARCHAR), 2, '0'))"


def _pick(number: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int") + 1)


def _p(number: str, values: list[str]) -> str:
    return "([" + ", ".join("'" + v + "'" for v in values) + f"])[CAST(({number}) % {len(values)} AS INTEGER) + 1]"


_STATUS = ["Backlog", "Ready", "In Progress", "Review", "Done", "Blocked"]
_CATEGORY = ["Requirement", "Bug", "Design", "Test", "Result", "Reference", "User Feedback", "Decision", "Other", "Misc"]
_SUB = ["Functional", "Severity", "Technical", "Unit", "", "Code", "Sentiment"]
_REL = ["supports", "contradicts", "relates_to", "depends_on", "causes", "derives_from", "supersedes", "similar_to",
        "cites", "mentioned_by", "part_of"]
_STR = ["weak", "moderate", "strong", "critical"]
_OP = ["table_query", "storage", "repository"]
_EXT = [".txt", ".pdf", ".JSON", ".md", ".html", ".zip", ""]
_EVENT_KINDS = ["click", "error", "purchase", "signup", "view"]

EPOCH = "1970-01-01 00:00:00"


_SCHEMAS: dict[str, StructType] = {}


class Tables:
    """Base tables as attributes (``t.events``) and the domain views built on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in _SCHEMAS:  # read the footer once, not once per query
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    @cached_property
    def sentiment(self) -> DataFrame:
        return sentiment_of(self.events)

    @cached_property
    def replica(self) -> DataFrame:
        """A copy of ``sentiment`` with rows dropped, changed and added."""
        s = self.sentiment
        changed = s.where(F.col("id") % 97 != 0).withColumns({
            "sentiment_score": F.when(F.col("id") % 89 == 0, F.col("sentiment_score") + 0.01).otherwise(F.col("sentiment_score")),
            "ticker": F.when(F.col("id") % 71 == 0, F.lit("T99")).otherwise(F.col("ticker")),
            "attributes": F.when(F.col("id") % 61 == 0, F.lit(None))
                           .when(F.col("id") % 59 == 0, F.create_map(F.lit("k"), F.col("attributes")["k"] + 1))
                           .when(F.col("id") % 53 == 0, F.create_map(F.lit("j"), F.col("attributes")["k"]))
                           .otherwise(F.col("attributes")),
        })
        extra = s.where(F.col("id") % 83 == 0).withColumn("id", F.col("id") + 1000000000000)
        return changed.unionByName(extra)

    @cached_property
    def market_event(self) -> DataFrame:
        d, l = self.documents, self.labels
        return (d.join(l, "doc_id", "left").select(
            F.col("doc_id").alias("id"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("headline"),
            F.array_distinct(F.array(_ticker("doc_id"), _ticker(F.col("doc_id") * 7))).alias("tickers"),
            F.col("text").alias("content"),
            F.timestamp_add("HOUR", F.col("doc_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("published_at"),
            "source",
            F.when(F.col("quality") == 1, 0.8).when(F.col("quality") == 0, 0.3).otherwise(0.5).alias("credibility_score")))

    @cached_property
    def market_event_copy(self) -> DataFrame:
        e = self.market_event
        return e.where(F.col("id") % 41 != 0).withColumns({
            "tickers": F.when(F.col("id") % 13 == 0, F.array(F.lit("T98")))
                        .when(F.col("id") % 17 == 0, F.transform("tickers", lambda x: F.concat(x, F.lit("x"))))
                        .otherwise(F.col("tickers")),
            "content": F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 19 == 0, F.lit("rewritten")).otherwise(F.col("content")),
            "headline": F.when(F.col("id") % 23 == 0, F.upper("headline")).otherwise(F.col("headline")),
            "credibility_score": F.when(F.col("id") % 29 == 0, F.col("credibility_score") + 0.1).otherwise(F.col("credibility_score")),
        })

    @cached_property
    def earnings(self) -> DataFrame:
        """Orders as earnings reports; the estimate is the discounted line value, summed as DECIMAL."""
        value = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(3,2)"))
        lines = self.lineitem.groupBy("l_orderkey").agg(F.sum(value).cast("decimal(20,4)").alias("line_value"))
        return (self.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
            F.col("o_orderkey").alias("report_id"),
            _ticker("o_custkey").alias("symbol"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("actual"),
            F.round("line_value", 2).cast("decimal(18,2)").alias("estimate"),
            F.quarter("o_orderdate").alias("quarter"),
            F.year("o_orderdate").alias("year")))

    @cached_property
    def item(self) -> DataFrame:
        """Work items and evidence: one per order, tagged with the kinds of its parts."""
        tags = (self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
                .groupBy("l_orderkey").agg(F.sort_array(F.collect_set("p_type")).alias("tags")))
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        return (self.orders.join(tags, key == F.col("l_orderkey"), "left").select(
            F.concat(F.lit("EV-"), key.cast("string")).alias("id"),
            key.alias("num"),
            F.concat(F.col("o_orderpriority"), F.lit(" order "), key.cast("string")).alias("title"),
            F.when(key % 31 == 0, F.lit("")).otherwise(F.concat(
                F.lit("Customer "), cust.cast("string"), F.lit(" ordered on "), F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("description"),
            F.concat(F.lit("Desk "), (cust % 25).cast("string")).alias("source"),
            _pick(key, _STATUS).alias("status"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "Critical").when(F.col("o_orderpriority") == "2-HIGH", "High")
             .when(F.col("o_orderpriority") == "3-MEDIUM", "Medium").when(F.col("o_orderpriority") == "5-LOW", "Low")
             .otherwise("Unset").alias("priority"),
            _pick(cust, _CATEGORY).alias("category"),
            _pick(key, _SUB).alias("subcategory"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "Critical").when(F.col("o_orderpriority") == "2-HIGH", "High")
             .when(F.col("o_orderpriority") == "3-MEDIUM", "Medium").otherwise("Low").alias("relevance"),
            F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
            F.concat(F.lit("EPIC-"), (cust % 50).cast("string")).alias("epic_id"),
            F.concat(F.lit("TASK-"), cust.cast("string")).alias("task_id"),
            F.concat(F.lit("PRJ-"), (cust % 7).cast("string")).alias("project_id"),
            F.concat(F.lit("user"), cust.cast("string")).alias("created_by"),
            F.col("o_orderdate").alias("date_collected"),
            F.col("o_orderdate").alias("created_at"),
            F.timestamp_add("HOUR", key % 24, F.col("o_orderdate")).alias("updated_at"),
            F.array(F.concat(F.lit("EV-"), (key + 1).cast("string")), F.concat(F.lit("EV-"), (key * 3).cast("string"))).alias("related_ids"),
            (F.col("o_totalprice") % 7).cast("int").alias("complexity"),
            F.col("o_totalprice").alias("amount")))

    @cached_property
    def relation_log(self) -> DataFrame:
        """Relation records: every event relates its user to the user of the event that follows it."""
        e = self.events
        nxt = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("target_id"))
        return (e.join(nxt, "event_id")
                .select(F.col("event_id"), F.col("user_id").alias("source_id"), "target_id",
                        _pick(F.col("event_id"), _REL).alias("rel_type"),
                        _pick(F.col("event_id"), _STR).alias("strength"),
                        (F.floor("value").cast("long") % 101).cast("int").alias("impact_score"),
                        F.col("ts").alias("updated_at")))

    @cached_property
    def edge(self) -> DataFrame:
        from newsgauge.operators import graph
        log = self.relation_log.where(F.col("source_id") != F.col("target_id"))
        return graph.latest_edges(log, tie="event_id").drop("event_id")

    @cached_property
    def op_log(self) -> DataFrame:
        return op_log_of(self.events)

    @cached_property
    def attachment(self) -> DataFrame:
        d = self.documents
        return d.select(
            F.col("doc_id").alias("id"), (F.col("doc_id") % 300).alias("item_id"),
            F.concat(F.lit("files/doc"), F.col("doc_id").cast("string"), _pick(F.col("doc_id"), _EXT)).alias("file_path"),
            F.col("source").alias("owner"), F.col("lang").alias("project"), F.col("text").alias("content"),
            F.octet_length("text").cast("long").alias("file_size"))

    @cached_property
    def raw_news(self) -> DataFrame:
        """News items as the vendor sends them: a JSON text with some fields missing."""
        d = self.documents.join(self.pages, F.col("doc_id") == F.col("page_id"), "left")
        i = F.col("doc_id")
        return d.select(
            i.alias("doc_id"), _ticker("doc_id").alias("ticker"),
            F.to_json(F.struct(
                _pick(i, ["company", "market", "merger"]).alias("category"),
                F.when(i % 43 != 0, F.lit(1704067200) + i * 3600).alias("datetime"),
                F.when(i % 37 == 0, F.lit(None)).when(i % 29 == 0, F.lit(" "))
                 .otherwise(F.split_part("text", F.lit("\n"), F.lit(1))).alias("headline"),
                i.alias("id"),
                F.when(i % 5 == 0, F.lit("img.png")).alias("image"),
                F.when(i % 3 != 0, F.concat(_ticker("doc_id"), F.lit(", "), _ticker(i * 7), F.lit(",,"))).alias("related"),
                F.when(i % 47 != 0, F.col("source")).alias("source"),
                F.when(i % 7 != 0, F.col("text")).alias("summary"),
                F.col("url"))).alias("payload"))

    @cached_property
    def vendor_sentiment(self) -> DataFrame:
        """Vendor sentiment payloads, nested, with parts missing."""
        c = self.customer
        i = F.col("c_custkey")
        return c.select(
            i.alias("payload_id"), _ticker("c_custkey").alias("ticker"),
            F.timestamp_add("MINUTE", i, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("ts"),
            F.to_json(F.struct(
                F.when(i % 3 != 0, F.struct(
                    F.when(i % 4 != 0, (i % 101) / 100).alias("buzz"),
                    (i % 50).alias("articlesInLastWeek"),
                    ((i % 40) / 4).alias("weeklyAverage"))).alias("buzz"),
                F.when(i % 5 != 0, (i % 21) / 20).alias("companyNewsScore"),
                F.when(i % 7 != 0, (i % 11) / 10).alias("sectorAverageNewsScore"),
                F.when(i % 2 == 0, F.col("c_mktsegment")).alias("sector"),
                F.struct((i % 9 / 8).alias("bearishPercent"), F.when(i % 6 != 0, i % 17 / 16).alias("bullishPercent"))
                 .alias("sentiment"))).alias("payload"))

    @cached_property
    def subscriber(self) -> DataFrame:
        """Webhook subscribers with the kinds of event they want."""
        s = self.supplier
        kinds = F.when(F.col("s_suppkey") % 10 == 0, F.array(F.lit("*"))).otherwise(
            F.array(_pick(F.col("s_suppkey"), _EVENT_KINDS), _pick(F.col("s_suppkey") * 3 + 1, _EVENT_KINDS)))
        return s.select(F.col("s_suppkey").alias("subscriber_id"), F.array_distinct(kinds).alias("events"),
                        (F.col("s_acctbal") > 0).alias("active"))


def sentiment_of(events: DataFrame) -> DataFrame:
    """Works on a batch and on a stream of events."""
    score = ((F.round(F.col("value") * 100).cast("long") * 37) % 2001 - 1000) / 1000
    return events.select(
        F.col("event_id").alias("id"), _ticker("user_id").alias("ticker"), "ts", F.col("event_type").alias("source"),
        score.alias("sentiment_score"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k").cast("double")).alias("attributes"))


def op_log_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("op_id"), "ts",
        F.when(F.col("user_id") % 2 == 0, "iceberg").otherwise("postgres").alias("backend"),
        _pick(F.col("event_id"), _OP).alias("op_type"), F.col("event_type").alias("query_type"),
        F.when(F.col("event_type") == "error", _pick(F.col("user_id"), ["timeout", "conflict", "io"])).alias("error_type"),
        F.col("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", F.lit(3) + (F.col("user_id") % 2).cast("int")).otherwise(1).alias("severity"),
        (F.col("event_type") != "error").alias("ok"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("client"))


_RELATION_LOG = f"""
SELECT e.event_id, e.user_id AS source_id, n.user_id AS target_id, {_p('e.event_id', _REL)} AS rel_type,
  {_p('e.event_id', _STR)} AS strength, CAST(CAST(floor(e.value) AS BIGINT) % 101 AS INTEGER) AS impact_score, e.ts AS updated_at
FROM events e JOIN events n ON n.event_id = e.event_id + 1"""

# View name: (views it needs, its SELECT).
SQL: dict[str, tuple[list[str], str]] = {
    "sentiment": ([], f"""
SELECT event_id AS id, {_t('user_id')} AS ticker, ts, event_type AS source,
  ((CAST(round(value * 100) AS BIGINT) * 37) % 2001 - 1000) / 1000.0::DOUBLE AS sentiment_score,
  MAP {{'k': CAST(json_extract_string(props, '$.k') AS DOUBLE)}} AS attributes
FROM events"""),
    "replica": (["sentiment"], """
SELECT id, CASE WHEN id % 71 = 0 THEN 'T99' ELSE ticker END AS ticker, ts, source,
  CASE WHEN id % 89 = 0 THEN sentiment_score + 0.01::DOUBLE ELSE sentiment_score END AS sentiment_score,
  CASE WHEN id % 61 = 0 THEN NULL WHEN id % 59 = 0 THEN MAP {'k': attributes['k'] + 1}
       WHEN id % 53 = 0 THEN MAP {'j': attributes['k']} ELSE attributes END AS attributes
FROM sentiment WHERE id % 97 <> 0
UNION ALL
SELECT id + 1000000000000, ticker, ts, source, sentiment_score, attributes FROM sentiment WHERE id % 83 = 0"""),
    "market_event": ([], f"""
SELECT d.doc_id AS id, split_part(text, chr(10), 1) AS headline,
  CASE WHEN {_t('d.doc_id')} = {_t('d.doc_id * 7')} THEN [{_t('d.doc_id')}] ELSE [{_t('d.doc_id')}, {_t('d.doc_id * 7')}] END AS tickers,
  text AS content, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id AS INTEGER)) AS published_at, source,
  CASE quality WHEN 1 THEN 0.8::DOUBLE WHEN 0 THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS credibility_score
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "market_event_copy": (["market_event"], """
SELECT id, CASE WHEN id % 23 = 0 THEN upper(headline) ELSE headline END AS headline,
  CASE WHEN id % 13 = 0 THEN ['T98'] WHEN id % 17 = 0 THEN list_transform(tickers, lambda x: x || 'x') ELSE tickers END AS tickers,
  CASE WHEN id % 11 = 0 THEN NULL WHEN id % 19 = 0 THEN 'rewritten' ELSE content END AS content, published_at, source,
  CASE WHEN id % 29 = 0 THEN credibility_score + 0.1::DOUBLE ELSE credibility_score END AS credibility_score
FROM market_event WHERE id % 41 <> 0"""),
    "earnings": ([], f"""
SELECT o_orderkey AS report_id, {_t('o_custkey')} AS symbol, strftime(o_orderdate, '%Y-%m-%d') AS date,
  CAST(o_totalprice AS DECIMAL(12,2)) AS actual, CAST(round(line_value, 2) AS DECIMAL(18,2)) AS estimate,
  CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(year(o_orderdate) AS INTEGER) AS year
FROM orders LEFT JOIN (
  SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(3,2)))) AS line_value
  FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""),
    "item": ([], f"""
SELECT 'EV-' || o_orderkey AS id, o_orderkey AS num, o_orderpriority || ' order ' || o_orderkey AS title,
  CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE 'Customer ' || o_custkey || ' ordered on ' || strftime(o_orderdate, '%Y-%m-%d') END AS description,
  'Desk ' || (o_custkey % 25) AS source, {_p('o_orderkey', _STATUS)} AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
    WHEN '5-LOW' THEN 'Low' ELSE 'Unset' END AS priority,
  {_p('o_custkey', _CATEGORY)} AS category, {_p('o_orderkey', _SUB)} AS subcategory,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS relevance,
  coalesce(tags, []) AS tags, 'EPIC-' || (o_custkey % 50) AS epic_id, 'TASK-' || o_custkey AS task_id,
  'PRJ-' || (o_custkey % 7) AS project_id, 'user' || o_custkey AS created_by, o_orderdate AS date_collected,
  o_orderdate AS created_at, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS updated_at,
  ['EV-' || (o_orderkey + 1), 'EV-' || (o_orderkey * 3)] AS related_ids,
  CAST(trunc(o_totalprice % 7) AS INTEGER) AS complexity, o_totalprice AS amount
FROM orders LEFT JOIN (
  SELECT l_orderkey, list_sort(list(DISTINCT p_type)) AS tags FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
ON o_orderkey = l_orderkey"""),
    "relation_log": ([], _RELATION_LOG),
    "edge": (["relation_log"], """
SELECT source_id, target_id, rel_type, strength, impact_score, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY updated_at DESC, event_id DESC) AS rn
  FROM relation_log WHERE source_id <> target_id) WHERE rn = 1"""),
    "op_log": ([], f"""
SELECT event_id AS op_id, ts, CASE WHEN user_id % 2 = 0 THEN 'iceberg' ELSE 'postgres' END AS backend,
  {_p('event_id', _OP)} AS op_type, event_type AS query_type,
  CASE WHEN event_type = 'error' THEN {_p('user_id', ['timeout', 'conflict', 'io'])} END AS error_type,
  value AS duration_ms, CAST(CASE WHEN event_type = 'error' THEN 3 + user_id % 2 ELSE 1 END AS INTEGER) AS severity,
  event_type <> 'error' AS ok, 'c' || user_id AS client
FROM events"""),
    "attachment": ([], f"""
SELECT doc_id AS id, doc_id % 300 AS item_id, 'files/doc' || doc_id || {_p('doc_id', _EXT)} AS file_path, source AS owner,
  lang AS project, text AS content, CAST(octet_length(encode(text)) AS BIGINT) AS file_size
FROM documents"""),
    "raw_news": ([], f"""
SELECT doc_id, {_t('doc_id')} AS ticker, {_p('doc_id', ['company', 'market', 'merger'])} AS category,
  CASE WHEN doc_id % 43 <> 0 THEN 1704067200 + doc_id * 3600 END AS datetime,
  CASE WHEN doc_id % 37 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN ' ' ELSE split_part(text, chr(10), 1) END AS headline,
  CASE WHEN doc_id % 5 = 0 THEN 'img.png' END AS image,
  CASE WHEN doc_id % 3 <> 0 THEN {_t('doc_id')} || ', ' || {_t('doc_id * 7')} || ',,' END AS related,
  CASE WHEN doc_id % 47 <> 0 THEN source END AS source, CASE WHEN doc_id % 7 <> 0 THEN text END AS summary, url
FROM documents LEFT JOIN pages ON doc_id = page_id"""),
    "vendor_sentiment": ([], f"""
SELECT c_custkey AS payload_id, {_t('c_custkey')} AS ticker,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey) AS ts,
  c_custkey % 3 <> 0 AS has_buzz, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 THEN (c_custkey % 101) / 100.0::DOUBLE END AS buzz,
  CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 50 END AS articles,
  CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 40) / 4.0::DOUBLE END AS weekly,
  CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 21) / 20.0::DOUBLE END AS company,
  CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 11) / 10.0::DOUBLE END AS sector_score,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS sector, (c_custkey % 9) / 8.0::DOUBLE AS bearish,
  CASE WHEN c_custkey % 6 <> 0 THEN (c_custkey % 17) / 16.0::DOUBLE END AS bullish
FROM customer"""),
    "subscriber": ([], f"""
SELECT s_suppkey AS subscriber_id, CASE WHEN s_suppkey % 10 = 0 THEN ['*'] ELSE list_distinct([{_p('s_suppkey', _EVENT_KINDS)},
  {_p('s_suppkey * 3 + 1', _EVENT_KINDS)}]) END AS events, s_acctbal > 0 AS active
FROM supplier"""),
}


def with_views(names: list[str], body: str, recursive: bool = False) -> str:
    """``body`` behind a WITH clause that defines the named views and all they need."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        needs, sql = SQL[name]
        for n in needs:
            add(n)
        done.setdefault(name, sql)

    for name in names:
        add(name)
    body = body.strip()
    recursive = recursive or body.upper().startswith("WITH RECURSIVE")
    for prefix in ("WITH RECURSIVE", "WITH"):
        if body.upper().startswith(prefix):
            body = body[len(prefix):].strip()
            tail = ", " + body
            break
    else:
        tail = " " + body
    if not done:
        return ("WITH RECURSIVE " if recursive else "WITH ") + body if tail.startswith(", ") else body
    ctes = ", ".join(f"{n} AS ({s.strip()})" for n, s in done.items())
    return ("WITH RECURSIVE " if recursive else "WITH ") + ctes + tail
