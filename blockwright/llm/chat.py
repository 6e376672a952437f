"""Chat formatting by quotation linking, with built-in functions only.

Each line's nested quote level is read from its leading ">" marks. Consecutive lines of one level are a passage; a
quoted passage is normalised (case, marks, punctuation and spacing dropped) and hashed, whole, by paragraph and by line,
and so are the lines, paragraphs and whole texts that messages write themselves. A part links to the latest earlier
message of its conversation that wrote it, else, unless it is short, to the first message of a conversation with a lower
id that did; the longest linked part of a passage names its original. A message answers the original of its shallowest
linked passage, the last of several. Answers stand after what they answer, in order of
writing; messages that quote nothing stand in order of their turns; a message that answers one of another conversation
joins that conversation. Text comes out without quotes and with its role marked.

Links lead to earlier turns or lower conversations only, so there are no cycles; paths to the root are found by pointer
doubling over the messages that quote, in as many rounds as the logarithm of the longest chain. Within a conversation
messages are numbered over range partitions, so a huge conversation is no single task.

Defined cases: null text counts as empty; null conversation ids are one conversation, last in order, whose messages do
not link elsewhere; null turns come last and link to nothing; repeated rows are messages of their own that stand side by
side; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwright.llm._store import release, stored, table

_MARKS = r"^((?:[ \t]*>)*)[ \t]?(.*)$"
#: Shorter passages (normalised) are too common to name an original in another conversation.
LEAST_LETTERS = 8


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    """array<struct<level, body>> of a text's lines."""
    one = lambda l: F.struct(  # noqa: E731, E741
        F.length(F.regexp_replace(F.regexp_extract(l, _MARKS, 1), r"[^>]", "")).alias("level"), F.regexp_extract(l, _MARKS, 2).alias("body")
    )
    return F.transform(F.split(text, r"\r?\n"), one)


def _passages(lines: Column) -> Column:
    """array<struct<level, text>>: consecutive lines of one level, joined."""
    start = F.array().cast("array<struct<level:int,body:array<string>>>")

    def add(acc: Column, line: Column) -> Column:
        last = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["level"] == line["level"])
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["level"].alias("level"), F.concat(last["body"], F.array(line["body"])).alias("body"))))
        return F.when(same, grown).otherwise(F.concat(acc, F.array(F.struct(line["level"].alias("level"), F.array(line["body"]).alias("body")))))

    return F.transform(F.aggregate(lines, start, add), lambda p: F.struct(p["level"].alias("level"), F.array_join(p["body"], "\n").alias("text")))


def messages(conversations: DataFrame) -> DataFrame:
    """Each message with own (its text without quotes), raw (the same with blank lines, also where quotes stood), passages (of quoting messages) and msg, a hash of the row."""
    text = F.coalesce("text", F.lit(""))
    quotes = text.rlike(r"(?m)^[ \t]*>")
    rows = conversations.select("conv_id", "turn", "role", text.alias("text")).withColumn("msg", F.xxhash64("conv_id", "turn", "role", "text"))
    lines = _lines(F.col("text"))
    own = F.array_join(F.transform(F.filter(lines, lambda l: l["level"] == 0), lambda l: l["body"]), "\n")  # noqa: E741
    raw = F.array_join(F.transform(lines, lambda l: F.when(l["level"] == 0, l["body"]).otherwise("")), "\n")  # noqa: E741
    return rows.select(
        "conv_id", "turn", "role", "msg", F.when(quotes, raw).alias("raw"), F.when(quotes, F.trim(F.regexp_replace(own, r"\n{2,}", "\n"))).otherwise(F.col("text")).alias("own"),
        F.when(quotes, F.filter(_passages(lines), lambda p: p["level"] > 0)).alias("passages"),
    )


def _parts(text: Column) -> Column:
    """The lines, paragraphs and whole of a text, normalised, without empty ones."""
    parts = F.concat(F.split(text, r"\r?\n"), F.split(text, r"\n\s*\n"), F.array(text))
    return F.array_distinct(F.filter(F.transform(parts, normalised), lambda p: F.length(p) > 0))


def _written(msgs: DataFrame) -> DataFrame:
    """(hash, conv_id, turn): what messages wrote themselves, by line, by paragraph and whole."""
    said = _parts(F.coalesce("raw", "own"))
    return msgs.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(F.array_distinct(F.transform(said, lambda p: F.xxhash64(p)))).alias("hash"))


def links(msgs: DataFrame) -> DataFrame:
    """(msg, conv_id, turn, to_conv, to_turn): each quoting message with a known original, and that original."""
    quoted = msgs.where("passages is not null and size(passages) > 0 and conv_id is not null and turn is not null").select("msg", "conv_id", "turn", F.posexplode("passages").alias("place", "p"))
    quoted = quoted.select("msg", "conv_id", "turn", "place", F.col("p.level").alias("level"), F.explode(_parts(F.col("p.text"))).alias("part"))
    quoted = quoted.select("msg", "conv_id", "turn", "place", "level", F.length("part").alias("length"), F.xxhash64("part").alias("hash"))
    quoted = stored(quoted.distinct(), "quoted-passages")
    # Only what some message quotes is looked up. In its own conversation: the latest earlier turn.
    said = _written(msgs).join(quoted.select("hash").distinct(), "hash", "left_semi")
    said = stored(said.distinct(), "quoted-originals")
    near = said.select(F.col("hash").alias("h"), F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    # The own turns of one passage, sorted, then searched: no pair of quotation and original is made.
    turns = Window.partitionBy("conv_id", "hash").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = quoted.select("conv_id", "hash", "turn").distinct().withColumn("kind", F.lit(0))
    along = asked.unionByName(said.select("conv_id", "hash", "turn", F.lit(1).alias("kind")))
    inside = along.withColumn("to_turn", F.last(F.when(F.col("kind") == 1, F.col("turn")), ignorenulls=True).over(turns)).where("kind = 0 and to_turn is not null").drop("kind")
    first = near.groupBy("h").agg(F.min(F.struct("c", "t")).alias("first"))
    found = quoted.join(inside, ["conv_id", "hash", "turn"], "left").join(first, F.col("hash") == F.col("h"), "left")
    other = F.when((F.col("first.c") < F.col("conv_id")) & (F.col("length") >= LEAST_LETTERS), F.col("first"))
    to = F.when(F.col("to_turn").isNotNull(), F.struct(F.col("conv_id").alias("c"), F.col("to_turn").alias("t"))).otherwise(other)
    found = found.withColumn("to", to).where("to is not null")
    best = found.groupBy("msg", "conv_id", "turn").agg(F.min(F.struct("level", (-F.col("place")).alias("place"), (-F.col("length")).alias("length"), "to")).alias("best"))
    return best.select("msg", "conv_id", "turn", F.col("best.to.c").alias("to_conv"), F.col("best.to.t").alias("to_turn"))


def _paths(found: DataFrame) -> DataFrame:
    """(msg, root_conv, path): the turns from the root to each linked message, by pointer doubling."""
    # A turn may hold several messages; the first by hash stands for it as an original.
    of_turn = found.groupBy("conv_id", "turn").agg(F.min("msg").alias("m"))
    at = found.join(of_turn.select(F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn"), "m"), ["to_conv", "to_turn"], "left")
    now = stored(at.select("msg", F.col("to_conv").alias("root_conv"), F.when(F.col("m").isNull(), F.array("to_turn", "turn")).otherwise(F.array("turn")).alias("path"), F.col("m").alias("up")), "reply-paths")
    while not now.where("up is not null").isEmpty():
        above = now.select(F.col("msg").alias("up"), F.col("root_conv").alias("r"), F.col("path").alias("p"), F.col("up").alias("u"))
        new = stored(now.join(above, "up", "left").select("msg", F.coalesce("r", "root_conv").alias("root_conv"), F.concat(F.coalesce("p", F.array().cast("array<bigint>")), "path").alias("path"), F.col("u").alias("up")), "reply-paths")
        release(now)
        now = new
    return now.select("msg", "root_conv", "path")


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, conversation (that it belongs to), position (from 0), depth, reply_conv, reply_turn, formatted."""
    msgs = messages(conversations.withColumn("turn", F.col("turn").cast("long")))
    msgs = stored(msgs, "messages")
    found = stored(links(msgs), "reply-links")
    paths = _paths(found)
    replies = stored(found.select("msg", F.col("to_conv").alias("reply_conv"), F.col("to_turn").alias("reply_turn")).join(paths, "msg"), "replies")
    rows = msgs.drop("passages", "raw").join(replies, "msg", "left")
    rows = rows.withColumn("conversation", F.coalesce("root_conv", "conv_id")).withColumn("path", F.coalesce("path", F.array(F.coalesce("turn", F.lit((1 << 63) - 1)))))
    order = [F.col("conversation").asc_nulls_last(), F.col("path"), F.col("msg")]
    ranged = stored(rows.repartitionByRange(*order, F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "ordered-messages")
    here = Window.partitionBy("conversation", "part").orderBy(*order)
    before = Window.partitionBy("conversation").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offset = ranged.groupBy("conversation", "part").agg(F.count("*").alias("n")).select(F.col("conversation").alias("_c"), F.col("part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    placed = ranged.withColumn("local", F.row_number().over(here) - 1)
    placed = placed.join(offset, placed["conversation"].eqNullSafe(offset["_c"]) & (placed["part"] == offset["_p"]))
    mark = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("own"), F.lit("\n"))
    return placed.select(
        "conv_id", "turn", "role", "conversation", (F.col("n0") + F.col("local")).alias("position"), (F.size("path") - 1).alias("depth"), "reply_conv", "reply_turn", mark.alias("formatted")
    )


def op8_chat_formatting(spark, sf_dir):
    return formatted(table(spark, sf_dir, "conversations"))
