"""Chat formatting by linking quotations.

1. Lines of a message are parsed to a quote level, the number of leading
   ``>``, and what follows. Lines of level 0 are the message's own words.
2. Own and quoted lines are normalised (A-Z in lower case, runs of blanks as
   one) and hashed. A quoted line of level n is a line that was of level n - 1
   in the message that is answered.
3. Quoted lines are joined to the lines of all earlier messages of the same
   conversation by hash. Of those that hold quoted lines, a message answers
   the one that shares most of them, the latest among equals. Lines that many
   messages of a conversation hold are not joined one by one: messages with
   the same set of them are one class, and classes are compared. A message
   that shares none of the rarer lines shares what its class does, and one
   that shares some of them is counted with both, so the count is exact.
4. Conversations are put in order of replies: a thread is a message that
   answers none with all that answer it, directly or not; threads follow each
   other as they begin, messages of a thread as they were sent. Quotes are
   left out.

The result has one row per message, with its place; a conversation is its
rows in order, so none is gathered however long it is. Lines are matched by
conversation and hash. The messages of one class, and those that quote from it,
are ordered in windows of bounded spans of turns, places by ranges of the order
over all conversations; where the messages of a conversation combine common
lines in very many ways, there is a row per message and class that it quotes
from.

Nulls and corner cases: a null text has no lines and gives an empty text; a
message that quotes nothing known answers none and begins a thread; messages
with a null conversation or turn belong to no conversation, answer none and
have place null; rows that share conversation and turn are one message for
links, and each is returned. Blank lines are no passages. Columns other than
those named are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelltrace.llm.common import ascii_lower, positions
from shelltrace.session import cut_lineage, write_through

# Possessive, so that a line of very many marks needs no stack.
_MARKS = r"^(?:[ \t]?+>)*+"
#: Turns of a conversation that are looked at in one window.
SPAN = 4_096
#: Holders in a conversation up to which a quoted line is joined to each.
COMMON = 32


def parsed_lines(text: Column) -> Column:
    """Array of ``(level, line)``."""
    def parsed(line: Column) -> Column:
        marks = F.regexp_extract(line, _MARKS, 0)
        return F.struct(
            F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
            F.regexp_replace(line, _MARKS + r"[ \t]?", "").alias("line"),
        )

    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r", ""), "\n")
    return F.transform(lines, parsed)


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(line), r"[ \t]+", " "))


def own_text(lines: Column) -> Column:
    """The lines of level 0, without blank ones at either end."""
    own = F.filter(lines, lambda x: x["level"] == 0)
    # A pattern would look for the end from every blank.
    return F.trim(
        F.array_join(F.transform(own, lambda x: x["line"]), "\n"), F.lit(" \t\n\x0b\x0c\r")
    )


def linked_replies(messages: DataFrame) -> DataFrame:
    """``conv turn reply_to`` of the messages that answer one.

    ``messages`` has ``conv``, ``turn`` and ``lines``.
    """
    lines = (
        messages.where("conv is not null and turn is not null")
        .select("conv", "turn", F.inline("lines"))
        .withColumn("passage", _normal(F.col("line")))
        .where("passage <> ''")
        .select(
            "conv",
            "turn",
            F.xxhash64("level", "passage").alias("held"),
            F.when(F.col("level") > 0, F.xxhash64(F.col("level") - 1, "passage")).alias("asked"),
        )
        .distinct()
    )
    lines = write_through(lines, "chat-lines")
    asked = lines.where("asked is not null").select("conv", "turn", F.col("asked").alias("h"))
    held = lines.select("conv", "turn", F.col("held").alias("h"))
    # Only lines that someone quotes count; those of them that many hold are common.
    sizes = (
        held.join(asked.select("conv", "h").distinct(), ["conv", "h"], "left_semi")
        .groupBy("conv", "h")
        .agg((F.count(F.lit(1)) > COMMON).alias("common"))
    )
    sizes = write_through(sizes, "chat-passages")
    held = write_through(held.join(sizes, ["conv", "h"]), "chat-held")
    asked = write_through(asked.join(sizes, ["conv", "h"]), "chat-asked")

    def common(rows: DataFrame, name: str) -> DataFrame:
        """Per message its common lines, sorted."""
        found = rows.where("common").groupBy("conv", "turn")
        return found.agg(F.sort_array(F.collect_set("h")).alias(name))

    holders = write_through(common(held, "hs"), "chat-holders")
    askers = write_through(common(asked, "qs"), "chat-askers")
    rare = (
        asked.where("not common")
        .select("conv", "h", "turn")
        .join(
            held.where("not common").select("conv", "h", F.col("turn").alias("reply_to")),
            ["conv", "h"],
        )
        .where("reply_to < turn")
        .groupBy("conv", "turn", "reply_to")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    both = (
        rare.join(askers, ["conv", "turn"], "left")
        .join(holders.withColumnRenamed("turn", "reply_to"), ["conv", "reply_to"], "left")
        .select(
            "conv",
            "turn",
            "reply_to",
            F.when(
                F.col("qs").isNotNull() & F.col("hs").isNotNull(),
                F.col("n") + F.size(F.array_intersect("qs", "hs")),
            )
            .otherwise(F.col("n"))
            .alias("n"),
        )
    )
    # Of a class only its latest message before the quote can be the answered one.
    quoting = askers.select("conv", "qs").distinct()
    held_by = holders.select("conv", "hs").distinct()
    classes = (
        quoting.withColumn("h", F.explode("qs"))
        .join(held_by.withColumn("h", F.explode("hs")), ["conv", "h"])
        .groupBy("conv", "qs", "hs")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    classes = write_through(classes, "chat-classes")
    marked = holders.select(
        "conv", "hs", "turn", F.lit(0).alias("asks"), F.lit(0).cast("long").alias("n")
    ).unionByName(
        askers.join(classes, ["conv", "qs"]).select(
            "conv", "hs", "turn", F.lit(1).alias("asks"), "n"
        )
    )
    latest = _latest_holders(marked).where("asks = 1 and reply_to is not null")
    shared = both.unionByName(latest.select("conv", "turn", "reply_to", "n"))
    return shared.groupBy("conv", "turn").agg(
        F.max(F.struct("n", "reply_to"))["reply_to"].alias("reply_to")
    )


def _latest_holders(marked: DataFrame) -> DataFrame:
    """``marked`` with ``reply_to``, the latest turn before a row's that holds
    its class's lines.

    Ordered within spans of turns; of earlier spans a row knows their latest.
    """
    marked = write_through(
        marked.withColumn("span", F.expr(f"cast(turn as bigint) div {SPAN}")), "chat-marked"
    )
    holder = F.when(F.col("asks") == 0, F.col("turn"))
    earlier = W.partitionBy("conv", "hs").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    spans = marked.groupBy("conv", "hs", "span").agg(F.max(holder).alias("last"))
    spans = spans.withColumn("last", F.max("last").over(earlier))
    spans = write_through(spans.where("last is not null"), "chat-spans")
    before = (
        W.partitionBy("conv", "hs", "span")
        .orderBy("turn", F.desc("asks"))
        .rowsBetween(W.unboundedPreceding, -1)
    )
    within = marked.withColumn("reply_to", F.last(holder, True).over(before))
    joined = within.where("asks = 1").join(spans, ["conv", "hs", "span"], "left")
    return joined.withColumn("reply_to", F.coalesce("reply_to", "last")).drop("last", "span")


def threads(replies: DataFrame) -> DataFrame:
    """``conv turn thread``: the turn that begins the thread of an answer.

    Each round doubles the distance that a message is followed back.
    """
    ends = cut_lineage(replies.select("conv", "turn", F.col("reply_to").alias("thread")))
    while True:
        up = ends.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("_up"))
        step = ends.join(up, ["conv", "thread"], "left")
        if step.where("_up is not null").isEmpty():
            return ends
        ends = cut_lineage(
            step.select("conv", "turn", F.coalesce("_up", "thread").alias("thread"))
        )


def format_chats(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv turn role text reply_to thread place n_quoted`` per message.

    ``place`` counts a conversation's messages in order of replies, from 0.
    """
    rows = messages.select(
        messages[conv_col].alias("conv"),
        messages[turn_col].alias("turn"),
        messages[role_col].alias("role"),
        parsed_lines(messages[text_col]).alias("lines"),
    )
    replies = write_through(linked_replies(rows), "chat-replies")
    joined = replies.join(threads(replies), ["conv", "turn"])
    done = rows.select(
        "conv",
        "turn",
        "role",
        own_text(F.col("lines")).alias("text"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"),
    )
    answers = joined.toDF("_conv", "_turn", "reply_to", "thread")
    done = done.join(
        answers, (F.col("conv") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left"
    ).drop("_conv", "_turn")
    done = done.withColumn("thread", F.coalesce("thread", "turn"))
    done = write_through(
        # Ranges are found from a sample of the order, so it holds no whole text.
        done.withColumns(
            {
                "_head": F.left("text", F.lit(32)),
                "_digest": F.xxhash64("text", "n_quoted"),
                "_row": F.monotonically_increasing_id(),
            }
        ),
        "chat-messages",
    )
    known = F.col("conv").isNotNull() & F.col("turn").isNotNull()
    # Numbered over all conversations by ranges of the order, so that neither a
    # long conversation nor a long thread nor a repeated row is one task.
    placed = positions(
        done.where(known),
        ("conv", "thread", "turn", "role", "_head", "_digest", "_row"),
        "place",
    )
    starts = placed.groupBy("conv").agg(F.min("place").alias("_start"))
    starts = write_through(starts, "chat-starts")
    placed = placed.join(starts, "conv").withColumn("place", F.col("place") - F.col("_start"))
    loose = done.where(~known).withColumn("place", F.lit(None).cast("long"))
    columns = ["conv", "turn", "role", "text", "reply_to", "thread", "place", "n_quoted"]
    return placed.select(columns).union(loose.select(columns))


def chat_text(role: Column, text: Column) -> Column:
    """A message as a line of a chat template."""
    return F.concat(
        F.lit("<|"), F.coalesce(role, F.lit("user")), F.lit("|>\n"), F.coalesce(text, F.lit("")),
        F.lit("\n"),
    )
