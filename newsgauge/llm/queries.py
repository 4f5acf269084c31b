"""The registered queries of the operators in this folder, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgauge.llm import cotrain, crosstoken, curriculum, divergence, langid, minhash, packing, quotes, shuffle, spelling, topk, warc, wrappers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op6_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a quarter of the documents is held out of the fit."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = langid.fit(docs.where(~F.col("held_out")))
    found = langid.identify(docs, model, into="found")
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.rejected")


@_query
def op7_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the divergence verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return divergence.judge(docs, divergence.references(docs), into="found").select("doc_id", "found.*")


@_query
def op5_fast_similarity_sketching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: two-word shingles, similarity of 0.8 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


#: Compares all documents that share a shingle.
ORACLES["op5_fast_similarity_sketching"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM common JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
two_way AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, b.v FROM reach r JOIN two_way b ON r.other = b.u)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id, min(other) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON node = d.doc_id GROUP BY d.doc_id"""


def vocabulary() -> str:
    """The tokenizer file of the packing query, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query
def op8_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their place in sequences of 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


@_query
def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; shard counts are at most one apart."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shuffle.shard(docs, ["doc_id", "text_crc32", "size"], 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@_query
def op10_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, in the order of first training positions."""
    made = curriculum.plan(table(spark, sf_dir, "documents"))
    return (made.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("positions")).alias("taken"),
                        F.round(F.array_min("positions"), 9).alias("position"))
            .orderBy(F.col("position").asc_nulls_last(), F.xxhash64("doc_id")))


ORACLES["op10_curriculum"] = """
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT source, size, w, 2.0::DOUBLE * size AS most, place FROM (
    SELECT source, size, place, [3.0, 1.0, 2.0][place + 1]::DOUBLE AS w FROM (
      SELECT source, sum(size)::BIGINT AS size, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 AS place
      FROM docs GROUP BY source))),
levels AS (  -- the level, were the sources that fill up sooner full and no others
  SELECT source, most / w AS own, (1.5::DOUBLE * sum(size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM sources WINDOW before AS (ORDER BY most / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT level FROM levels WHERE own >= level ORDER BY own, source LIMIT 1),
targets AS (SELECT source, size AS source_size, place, least(most, level * w) AS target FROM sources, goal),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.place,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0::DOUBLE AS half
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
shares AS (
  SELECT *, half / nullif(target, 0) AS x, (coalesce(half / nullif(target, 0) < 1, false)::BIGINT + coalesce((source_size + half) / nullif(target, 0) < 1, false)::BIGINT) AS copies
  FROM placed)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, size * copies AS taken,
  round(CASE WHEN copies = 0 THEN NULL
       WHEN place = 0 THEN 2 * x / (1.5 + sqrt(2.25 - 2 * x))
       WHEN place = 1 THEN x
       WHEN x < 0.25 / 0.875 THEN x * 0.875 / 0.5
       ELSE 0.5 + 2 * (x - 0.25 / 0.875) * 0.875 / (0.5 + sqrt(0.25 + 6 * (x - 0.25 / 0.875) * 0.875)) END, 9) AS position
FROM shares"""


@_query
def op2_gzip_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op2_gzip_normaliser"] = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
first AS (SELECT payload_digest, max(page_id) AS page FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN f.page <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f.page <> d.page_id THEN f.page END AS refers_to
FROM d LEFT JOIN first f USING (payload_digest)"""


ORACLES["op9_threshold_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
WHERE rank <= 20"""


@_query
def op9_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best matches of every twentieth vector among all."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0).drop("query_row")


@_query
def op1_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by text, by metadata and by both."""
    docs = table(spark, sf_dir, "documents")
    model = cotrain.fit(docs, table(spark, sf_dir, "labels"))
    return cotrain.classify(docs, model, into="found").select("doc_id", "found.*")


@_query
def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotes, linked to the message it replies to and placed in its conversation."""
    return quotes.conversations(table(spark, sf_dir, "conversations")).drop("text")


@_query
def op11_covering_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers' tokens of every document aligned by bytes. The byte-level vocabulary is read as ranks, which give the ids of
    its json file in a fifth of the time (a test holds the two against each other)."""
    import public_tokenizers

    return crosstoken.align_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                   public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


@_query
def op12_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return wrappers.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))


#: For pages of the given form: an article of headings and paragraphs with a few inline elements and character references.
ORACLES["op12_wrapper_induction"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS a FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(a, '</?(?:p|h1)>'), lambda x:
  trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'),
    '&amp;', '&'), '&amp', '&'), '[\s\p{Z}]+', ' ', 'g'))) AS b FROM a)
SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS text,
  CAST(length(array_to_string(list_filter(b, lambda x: x <> ''), chr(10))) AS BIGINT) AS n_chars FROM b"""


@_query
def op13_search_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents, grouped with their near words."""
    return spelling.variants(table(spark, sf_dir, "documents"))
