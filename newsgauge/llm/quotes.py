"""Quotation linking: who replies to whom, from the passages that messages quote.

A line's quote level is its number of leading ``>``. Quoted passages are normalised (lower case, white space made one blank)
and hashed, run by run and line by line, and looked up among what earlier messages of the same conversation say
themselves. Each quoted unit is linked to the latest earlier message that has it; a message replies to the one from which it
quotes most at its lowest linked level. Links make threads, and a conversation is read thread by thread with the quotes
taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgauge.llm.ordering import fresh, running_sums, text_of
from newsgauge.session import drop_staged, staged

_MARKS = r"^((?:[ \t]*>)*)"
_PREFIX = r"^(?:[ \t]*>)+[ \t]?"
_QUOTE = r"(?m)^[ \t]*>"
_ATTRIBUTION = r"(?i)^.{0,200}\bwrote:\s*$"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parse(text: Column) -> Column:
    """The lines of a text as array of (level, body, own): ``own`` is false for quotes and for an attribution line ("... wrote:")
    right before a quote."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", "")).alias("level"),
        F.regexp_replace(line, _PREFIX, "").alias("body")))
    quotes_next = lambda i: F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False))
    return F.transform(lines, lambda x, i: F.struct(
        x["level"].alias("level"), x["body"].alias("body"),
        ((x["level"] == 0) & ~(x["body"].rlike(_ATTRIBUTION) & quotes_next(i))).alias("own")))


def without_quotes(text: str) -> Column:
    """The text without quoted and attribution lines; a text that quotes nothing stays as it is, null becomes empty."""
    own = F.transform(F.filter(parse(F.col(text)), lambda x: x["own"]), lambda x: x["body"])
    return F.when(F.col(text).rlike(_QUOTE), F.btrim(F.array_join(own, "\n"), F.lit(" \t\r\n"))).otherwise(text_of(text))


def _units(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, weight): every line, every run of lines of one level, and all that a message says itself."""
    lines = (messages.select("row", "conv", "turn", F.posexplode(parse(F.col("text"))).alias("line", "x"))
             .select("row", "conv", "turn", "line", "x.body",
                     F.when(F.col("x.level") > 0, F.col("x.level")).when(F.col("x.own") & (F.length(F.trim("x.body")) > 0), 0).otherwise(-1).alias("level")))
    in_message = Window.partitionBy("row").orderBy("line")  # the lines of one cell
    runs = (lines.withColumn("new", (F.col("level") != F.lag("level", 1, -2).over(in_message)).cast("int"))
            .withColumn("run", F.sum("new").over(in_message)).where("level >= 0"))

    def joined(*by: str) -> DataFrame:
        body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), " ")
        return runs.groupBy("row", "conv", "turn", "level", *by).agg(body.alias("body")).select("conv", "turn", "level", "body")

    units = runs.select("conv", "turn", "level", "body").union(joined("run")).union(joined().where("level = 0"))
    return (units.withColumn("body", _normal(F.col("body"))).where(F.length("body") > 0)
            .select("conv", "turn", "level", F.xxhash64("body").alias("hash"), F.length("body").alias("weight")).distinct())


def link(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text", chunk: int = 4096) -> DataFrame:
    """(conv, turn, quoted, linked, reply_to), staged: one row per message (conversation and turn) that quotes.

    ``quoted`` counts its quoted units, ``linked`` those found in an earlier message; ``reply_to`` is null where none is.
    Only rows with conversation and turn take part; rows that repeat both are one message. What many messages say or quote
    is looked up in turn order, ``chunk`` turns at a time, with one summary row per chunk; no pairs are made.
    """
    rows = messages.select(F.col(conversation).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.col(text).alias("text")).where(
        F.col("conv").isNotNull() & F.col("turn").isNotNull() & F.col("text").isNotNull())
    quoting = rows.where(F.col("text").rlike(_QUOTE)).select("conv").distinct()
    inside = staged(rows.join(quoting, "conv", "left_semi").withColumn("row", F.monotonically_increasing_id()))
    units = staged(_units(inside))
    drop_staged(inside)
    said = units.where("level = 0").select("conv", "hash", "turn", F.lit(1).alias("said")).distinct()
    asked = units.where("level > 0").select("conv", "hash", "turn", F.lit(0).alias("said")).distinct()
    events = said.union(asked).withColumn("chunk", F.floor(F.col("turn") / chunk)).withColumn("at", F.when(F.col("said") == 1, F.col("turn")))
    in_chunk = Window.partitionBy("conv", "hash", "chunk").orderBy("turn", "said").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv", "hash").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (events.groupBy("conv", "hash", "chunk").agg(F.max("at").alias("last"))
              .select("conv", "hash", "chunk", F.max("last").over(earlier).alias("before")))
    found = (events.withColumn("here", F.max("at").over(in_chunk)).where("said = 0").join(before, ["conv", "hash", "chunk"])
             .select("conv", "hash", "turn", F.coalesce("here", "before").alias("origin")))
    by_origin = (units.where("level > 0").join(found, ["conv", "hash", "turn"])
                 .groupBy("conv", "turn", "level", "origin").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")))
    best = F.max(F.when(F.col("origin").isNotNull(), F.struct((-F.col("level")).alias("nearness"), "weight", "origin")))
    out = staged(by_origin.groupBy("conv", "turn").agg(
        F.sum("n").alias("quoted"), F.sum(F.when(F.col("origin").isNotNull(), F.col("n")).otherwise(0)).alias("linked"),
        best["origin"].alias("reply_to")))
    drop_staged(units)
    return out


def roots(links: DataFrame) -> DataFrame:
    """(conv, turn, thread, depth) of every message with a ``reply_to``: the turn that began its thread, and the number of
    replies from there. Every round doubles the distance looked back, and the driver sees one count."""
    far = staged(links.where(F.col("reply_to").isNotNull())
                 .select("conv", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("bigint").alias("depth")))
    while True:
        up = far.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("above"), F.col("depth").alias("more"))
        step = staged(far.join(up, ["conv", "thread"], "left").select(
            "conv", "turn", F.coalesce("above", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("above").isNotNull().alias("moved")))
        moved = step.where("moved").limit(1).count()
        drop_staged(far)
        far = step
        if not moved:
            return step.drop("moved")


def conversations(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  template: str = "<|%s|>\n%s\n<|end|>") -> DataFrame:
    """Every row of ``messages`` with reply_to, thread, depth, position, quoted, linked, clean_text and formatted.

    ``position`` is the row's place in its conversation, from 0: threads by the turn that began them, in a thread by turn, so
    that a reply always follows what it replies to. A message that links to nothing begins a thread. Rows without turn come
    last; rows without conversation are numbered as one. Rows alike in conversation, turn, role and text are
    interchangeable. ``formatted`` puts role (null: user) and clean text into ``template``. Columns of the same names are
    replaced, all others stay.
    """
    made = ["reply_to", "thread", "depth", "position", "quoted", "linked", "clean_text", "formatted"]
    messages = messages.drop(*made)
    names = fresh(messages, "_conv", "_turn", "_one")
    conv, at, one = (names[x] for x in ("_conv", "_turn", "_one"))
    links = link(messages, conversation, turn, text)
    tied = links.join(roots(links), ["conv", "turn"], "left").select(F.col("conv").alias(conv), F.col("turn").alias(at), "quoted", "linked", "reply_to", "thread", "depth")
    rows = (messages.withColumns({conv: F.col(conversation), at: F.col(turn).cast("bigint"), one: F.lit(1)}).join(tied, [conv, at], "left")
            .withColumns({"thread": F.coalesce("thread", at), "depth": F.coalesce("depth", F.lit(0)), "quoted": F.coalesce("quoted", F.lit(0)),
                          "linked": F.coalesce("linked", F.lit(0)), "clean_text": without_quotes(text)})
            .withColumn("formatted", F.format_string(template, F.coalesce(F.col(role), F.lit("user")), F.col("clean_text"))))
    placed = running_sums(rows, conv, ["thread", at, role, text], one, "position")
    return placed.drop(conv, at, one)
