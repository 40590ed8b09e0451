"""Quotation linking for chat and mail conversations, with DataFrame functions only.

A line's quote level is the number of ``>`` before its body. Runs of lines of one level are passages. What a message says
itself are its passages of level 0, without an attribution line ("On ... wrote:") that a quote follows. Passages are
normalised (lower case, one blank for each run of white space) and hashed whole, by paragraph and by line; a quoted
passage is joined to the first message that says the same itself: in its own conversation if an earlier turn does, else
anywhere before it in the order of (conversation, turn), but there only if it has at least ``min_words`` words, since what
is short ("yes") is said everywhere. A message replies to the message matched at the lowest quote
level, of those to the one with most matched words, of those to the earliest. Replies form trees; a message's thread is
its root, and the order is by thread, depth, conversation and turn.

Originals are reduced to one row for each hash before the join, so a passage that many messages say or quote gives one
row for each quote. Roots are found by pointer doubling: as many rounds as the logarithm of the longest reply chain.

Defined cases: rows that repeat (conversation, turn, role, text) count once; two texts under one (conversation, turn)
are kept both, share their links, and the alphabetically first text's role is not preferred; a null text is empty; a
message without conversation or turn is kept, is no original and replies to nothing; a text that only quotes has an
empty own text; an empty table gives no rows; other columns are ignored. Long texts are parsed within their row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm._common import Scratch

MARKS = "^(?:[ \\t]*>)+"
ATTRIBUTION = "^(?:On .{1,300} wrote:|-+ ?Original Message ?-+)[ \\t]*$"


def normalise(text) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(text), "[ \\t\\r\\n]+", " "))


def _passages(body) -> F.Column:
    """A passage whole, its paragraphs and its lines: distinct, normalised, not empty."""
    parts = F.concat(F.array(body), F.split(body, "\\n[ \\t]*\\n"), F.split(body, "\\n"))
    return F.array_distinct(F.filter(F.transform(parts, normalise), lambda x: x != ""))


def parse(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) with runs: array of (level, body) in order, and own: the text without quotes."""
    def line(x):
        marks = F.regexp_extract(x, MARKS, 0)
        return F.struct(
            (F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))).alias("level"),
            F.regexp_replace(x, MARKS + " ?", "").alias("body"),
            x.rlike(ATTRIBUTION).alias("attribution"),
        )

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\\r?\\n"), line)
    # Generators keep the optimiser from computing the arrays again for each element that looks at its neighbours.
    rows = messages.withColumn("p", F.explode(F.array(lines)))
    p = F.col("p")
    said = F.filter(p, lambda x, i: ~(x["attribution"] & (x["level"] == 0) & (F.coalesce(F.get(p, i + 1)["level"], F.lit(0)) > 0)))
    rows = rows.withColumn("q", F.explode(F.array(said))).drop("p")
    q = F.col("q")
    starts = F.filter(F.transform(q, lambda x, i: F.when((i == 0) | (x["level"] != F.get(q, i - 1)["level"]), i)), lambda x: x.isNotNull())
    rows = rows.withColumn("starts", F.explode(F.array(starts)))
    runs = F.transform("starts", lambda s, k: F.struct(
        F.get(q, s)["level"].alias("level"),
        F.array_join(F.transform(F.slice(q, s + 1, F.coalesce(F.get("starts", k + 1), F.size(q)) - s), lambda x: x["body"]), "\n").alias("body"),
    ))
    rows = rows.withColumn("runs", F.explode(F.array(runs))).drop("q", "starts")
    own = F.array_join(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["body"]), "\n")
    return rows.withColumn("own", F.trim(F.regexp_replace(own, "^[ \\t\\n]+|[ \\t\\n]+$", "")))


def link(parsed: DataFrame, min_words: int = 5) -> DataFrame:
    """Every quoted passage that has an original: conv_id, turn, level, hash, words, orig_conv, orig_turn."""
    known = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    said = known.select("conv_id", "turn", F.explode(F.flatten(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: _passages(r["body"])))).alias("said"))
    whole = known.select("conv_id", "turn", normalise(F.col("own")).alias("said")).where("said <> ''")
    said = said.unionByName(whole).select("conv_id", "turn", F.md5(F.col("said").cast("binary")).alias("hash"))
    here = said.groupBy("conv_id", "hash").agg(F.min("turn").alias("here_turn"))
    first = here.groupBy("hash").agg(F.min(F.struct("conv_id", "here_turn")).alias("first"))

    quoted = known.select("conv_id", "turn", F.explode(F.filter("runs", lambda r: r["level"] > 0)).alias("r"))
    quoted = quoted.select("conv_id", "turn", F.col("r.level").alias("level"), F.explode(_passages(F.col("r.body"))).alias("said"))
    quoted = quoted.select("conv_id", "turn", "level", F.md5(F.col("said").cast("binary")).alias("hash"), F.size(F.split("said", " ")).alias("words")).distinct()

    found = quoted.join(here, ["conv_id", "hash"], "left").join(first, "hash", "left")
    inside = F.col("here_turn") < F.col("turn")
    enough = F.col("words") >= min_words
    before = F.struct(F.col("first.conv_id").alias("c"), F.col("first.here_turn").alias("t")) < F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    return found.select(
        "conv_id", "turn", "level", "hash", "words",
        F.when(inside, F.col("conv_id")).when(before & enough, F.col("first.conv_id")).alias("orig_conv"),
        F.when(inside, F.col("here_turn")).when(before & enough, F.col("first.here_turn")).alias("orig_turn"),
    ).where("orig_conv IS NOT NULL")


def replies(links: DataFrame) -> DataFrame:
    """conv_id, turn, reply_conv, reply_turn: one row for each message that replies to another."""
    votes = links.groupBy("conv_id", "turn", "level", "orig_conv", "orig_turn").agg(F.sum("words").alias("words"))
    best = votes.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("words")).alias("w"), "orig_conv", "orig_turn")).alias("b"))
    return best.select("conv_id", "turn", F.col("b.orig_conv").alias("reply_conv"), F.col("b.orig_turn").alias("reply_turn"))


def threads(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """parents with the root of each message's tree (thread_conv, thread_turn) and its depth, by pointer doubling."""
    state = scratch.write(parents.select("conv_id", "turn", F.col("reply_conv").alias("thread_conv"), F.col("reply_turn").alias("thread_turn"), F.lit(1).cast("long").alias("depth")), "pointers")
    while True:
        up = state.select(F.col("conv_id").alias("thread_conv"), F.col("turn").alias("thread_turn"), F.col("thread_conv").alias("c"), F.col("thread_turn").alias("t"), F.col("depth").alias("d"))
        moved = state.join(up, ["thread_conv", "thread_turn"], "left").select(
            "conv_id", "turn", F.coalesce("c", "thread_conv").alias("thread_conv"), F.coalesce("t", "thread_turn").alias("thread_turn"),
            (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("c").isNotNull().alias("moved"),
        )
        moved = scratch.write(moved, "pointers")
        scratch.drop(state)
        state = moved
        if state.where("moved").isEmpty():
            return state.drop("moved")


def build(messages: DataFrame, scratch: Scratch, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """Every message without its quotes, in reply order: conv_id, turn, role, text, reply_conv, reply_turn, thread_conv,
    thread_turn, depth, n_quotes (quoted passages) and formatted (role line and text)."""
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).distinct()
    parsed = scratch.write(parse(rows), "parsed")
    parents = scratch.write(replies(link(parsed, min_words)), "replies")
    placed = parents.join(threads(parents, scratch), ["conv_id", "turn"])
    out = parsed.join(placed, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.col("own").alias("text"), "reply_conv", "reply_turn",
        F.coalesce("thread_conv", "conv_id").alias("thread_conv"), F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.size(F.filter("runs", lambda r: r["level"] > 0)).cast("long").alias("n_quotes"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("own")).alias("formatted"),
    )
    return out.orderBy("thread_conv", "thread_turn", "depth", "conv_id", "turn")
