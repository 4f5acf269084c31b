"""Text scoring."""

from pyspark.sql import functions as F

from newsgauge.functions import vocab
from newsgauge.functions.text import score_text
from newsgauge.operators import scoring, summaries
from newsgauge.plans.q_ingest import news
from newsgauge.plans.q_summaries import mean
from newsgauge.plans.registry import query


# The given texts hold no finance words: stop words of their four languages stand in, so that the scorer has something to find.
POSITIVE = [*vocab.POSITIVE_WORDS, "the", "that", "les", "que", "und", "los"]
NEGATIVE = [*vocab.NEGATIVE_WORDS, "of", "with", "des", "avec", "der", "las"]


def lexicon_sql(source, key, text):
    """SELECT of key, label, score and confidence of a text column."""
    def count(words):
        return f"len(list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}]+'), lambda w: w IN ({', '.join(repr(w) for w in words)})))"
    return f"""SELECT {key}, CASE WHEN p > n THEN 'positive' WHEN p < n THEN 'negative' ELSE 'neutral' END AS sentiment_label,
  CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0.0::DOUBLE END AS sentiment_score, CASE WHEN p + n > 0 THEN abs(p - n) / (p + n) ELSE 0.0::DOUBLE END AS confidence
FROM (SELECT *, {count(POSITIVE)} AS p, {count(NEGATIVE)} AS n FROM {source})"""


@query("lexicon_sentiment", "", lexicon_sql("documents", "doc_id", "text"))
def lexicon_sentiment(t):
    return scoring.lexicon_score(t.documents, "text", POSITIVE, NEGATIVE).select("doc_id", "sentiment_label", "sentiment_score", "confidence")


@query("lexicon_conversations", "", lexicon_sql("conversations", "conv_id, turn", "text"))
def lexicon_conversations(t):
    return scoring.lexicon_score(t.conversations, "text", POSITIVE, NEGATIVE).select("conv_id", "turn", "sentiment_label", "sentiment_score", "confidence")


_CHOSEN = """WITH chosen AS (SELECT doc_id, ticker, CASE WHEN trim(headline) <> '' THEN headline WHEN trim(summary) <> '' THEN summary END AS text FROM raw_news),
scored AS (""" + lexicon_sql("chosen", "doc_id, ticker", "text") + ") "


@query("news_scored_stats", "raw_news", _CHOSEN + f"""
SELECT ticker, {mean('sentiment_score')} AS mean_score, round(stddev_samp(sentiment_score), 9) AS std_score, count(*) AS n, count(*) FILTER (sentiment_label = 'positive') AS positive_count,
  count(*) FILTER (sentiment_label = 'neutral') AS neutral_count, count(*) FILTER (sentiment_label = 'negative') AS negative_count FROM scored GROUP BY ticker""")
def news_scored_stats(t):
    """Payload to summary in one job: parse, choose the text, score, aggregate."""
    chosen = news(t).select("id", "ticker", score_text(F.col("headline"), F.col("summary")).alias("text"))
    scored = scoring.lexicon_score(chosen, "text", POSITIVE, NEGATIVE).withColumnRenamed("sentiment_label", "label")
    return summaries.ticker_stats(scored).withColumn("std_score", F.round("std_score", 9))


def word_counter():
    """A stand-in for a model: the same lexicon, as plain Python in the worker."""
    import re

    positive, negative = set(POSITIVE), set(NEGATIVE)
    letters = re.compile(r"[^\W\d_]+")

    def score(texts):
        out = []
        for text in texts:
            tokens = letters.findall(text.lower())
            p, n = sum(w in positive for w in tokens), sum(w in negative for w in tokens)
            label = "positive" if p > n else "negative" if p < n else "neutral"
            out.append((label, abs(p - n) / (p + n) if p + n else 0.0))
        return out

    return score


@query("model_sentiment", "", lexicon_sql("documents", "doc_id", "text"))
def model_sentiment(t):
    """The plug for a model, with a scorer whose results the SQL knows."""
    rows = t.documents.select("doc_id", "text")
    return scoring.model_score(rows, "text", word_counter).drop("text", "scoring_failed")
