"""Quotation linking: messages without quotes, linked to what they quote, in reply order; SQL functions alone.

A line's quote level is the number of ">" that it starts with, blanks between them allowed. Runs of lines of one level
are passages, less the attribution line ("... wrote:") before a passage of a deeper level; a quoted passage that is no
more than such a line is none. Level 0 is the author's own text: what surrounds quotes is trimmed and joined by
newlines, a text without quotes stays as it is.

A quoted passage is normalised (letters in lower case, white space runs to one blank, trimmed) and hashed. Originals are
the author's own text as a whole, each of its passages, each of their paragraphs (parted by blank lines) and lines,
normalised and hashed alike. A quoted passage of several lines is also held by a message whose own lines are, in order,
the quoted ones with any others between; blank lines and marks of a cut ("...", "[...]", "[snip]") aren't compared. Such
messages are sought by the quote's rarest line alone, then compared line by line. For each quote the earliest original
is kept, within each conversation and over all, so a text that a third of all messages share is one row before anything
is joined.

Messages have one total order: by conversation, then by turn. A quote links to the earliest message of its own
conversation that comes before it and holds the passage, else to the earliest message of the first conversation that
holds it, if that comes before its own. So a link always leads back in that order and parents can't be cyclic. A
message's parent is what its first linked passage of the lowest level links to.

Conversations are built from the links: parents lead to a root, a message without a parent, and the messages of a root
are its thread, which counts to the root's conversation. A message's depth is the number of parents above it. Its place
is one more than the number of messages in that conversation that come before it by the root's turn, then by depth, then
in the total order: thread after thread, and in a thread replies after all that they answer. Without quotes, this is the
order of turns.

Defined results: a null text is an empty one; a null conversation or turn has its row and links nothing, its thread and
place null; rows that repeat a conversation and turn share parent, thread, place and the number of their different linked
quotes, whatever their texts, and are all counted in places; empty passages link nothing; ties of a quote go to the earliest message; nothing is dropped from own text, and a carriage return is
white space; very long texts and quotes of any level are read whole; an empty table gives no rows; other columns of the
table, whatever their names, aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from showloom.llm.common import cut, held, only

PREFIX = r"^[ \t]*((?:>[ \t]?)+)"
#: Lines that stand for what a quote leaves out.
CUT_OUT = r"^[\[(<]*(\.{2,}|…|snip(ped)?)[\])>]*$"
PARAGRAPHS = r"\n[ \t\r]*\n\s*"
ATTRIBUTION = r"(?i)(^|\n)[^\n]*(wrote|writes|schrieb|écrit|escribió)\s*:\s*$"
EDGE = " \t\r\n"
#: Messages of a range that are placed in one window.
RANGE = 1 << 20


def level(line: Column) -> Column:
    lead = F.regexp_extract(line, PREFIX, 1)
    return F.char_length(lead) - F.char_length(F.replace(lead, F.lit(">"), F.lit("")))


def with_passages(rows: DataFrame) -> DataFrame:
    """rows (with text) and passages, array<struct<level int, text string>>: the runs of lines of one level, in order.

    Each step is a column of its own, as what a lambda refers to is evaluated for each element otherwise.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, PREFIX, "").alias("text")))
    rows = rows.withColumn("_lines", held(F.when(F.contains(text, F.lit(">")), lines)))
    first = F.transform("_lines", lambda x, i: F.when((i == 0) | (F.get("_lines", i - 1)["level"] != x["level"]), i))
    rows = rows.withColumn("_starts", held(F.filter(first, lambda i: i.isNotNull())))
    end = lambda k: F.coalesce(F.get("_starts", k + 1), F.size("_lines"))
    run = lambda i, k: F.array_join(F.transform(F.slice("_lines", i + 1, end(k) - i), lambda x: x["text"]), "\n")
    found = F.transform("_starts", lambda i, k: F.struct(F.get("_lines", i)["level"].alias("level"), run(i, k).alias("text")))
    plain = F.array(F.struct(F.lit(0).alias("level"), text.alias("text")))
    return rows.withColumn("passages", held(F.coalesce(found, plain))).drop("_lines", "_starts")


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\u00A0]+", " "))


def line_hashes(text: Column) -> Column:
    """array<string>: hashes of the normalised lines of text, without blank ones and marks of a cut."""
    lines = F.filter(F.transform(F.split(text, "\n"), normal), lambda x: (x != "") & ~F.rlike(x, F.lit(CUT_OUT)))
    return F.transform(lines, F.md5)


def holding_lines(asked: DataFrame, messages: DataFrame) -> DataFrame:
    """key, conv_id, first: of each asked (key, lines) the first turn in each conversation of messages (conv_id, turn,
    lines) whose lines hold the asked ones in order."""
    of_quotes = cut(asked.select("key", "lines", F.explode(F.array_distinct("lines")).alias("line")))
    of_messages = messages.select("conv_id", "turn", F.explode(F.array_distinct("lines")).alias("line"))
    hits = cut(of_messages.join(cut(of_quotes.select("line").distinct()), "line", "left_semi"))
    counts = cut(hits.groupBy("line").agg(F.count("*").alias("n")))
    rarest = of_quotes.join(counts, "line").groupBy("key").agg(F.count("*").alias("known"), F.min(F.struct("n", "line", "lines")).alias("r"))
    rarest = cut(rarest.filter(F.col("known") == F.size(F.array_distinct("r.lines"))).select("key", "r.line", F.col("r.lines").alias("asked")))
    able = cut(hits.join(rarest, "line").select("key", "asked", "conv_id", "turn"))
    reached = F.aggregate("lines", F.lit(0), lambda at, x: F.when(F.get("asked", at) == x, at + 1).otherwise(at))
    found = able.join(messages, ["conv_id", "turn"]).filter(reached == F.size("asked"))
    return found.groupBy("key", "conv_id").agg(F.min("turn").alias("first"))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, passages (without attributions) of every row."""
    rows = with_passages(only(messages, "conv_id", "turn", "role", "text"))
    deeper_next = lambda p, i: F.coalesce(F.get("passages", i + 1)["level"] > p["level"], F.lit(False))
    blank = lambda x: F.btrim(x, F.lit(EDGE)) == ""
    bare = F.transform("passages", lambda p, i: F.struct(p["level"].alias("level"), F.when(deeper_next(p, i), F.regexp_replace(p["text"], ATTRIBUTION, "")).otherwise(p["text"]).alias("text"), ((p["level"] > 0) & ~blank(p["text"])).alias("said")))
    bare = F.filter(bare, lambda p: ~(p["said"] & blank(p["text"])))
    return rows.select("conv_id", "turn", "role", F.when(F.size("passages") > 1, F.transform(bare, lambda p: F.struct(p["level"].alias("level"), p["text"].alias("text")))).otherwise(F.col("passages")).alias("passages"))


def with_own(rows: DataFrame) -> DataFrame:
    """rows (with passages) and own, the trimmed texts of level 0."""
    own = F.transform("passages", lambda p: F.when(p["level"] == 0, F.btrim(p["text"], F.lit(EDGE))))
    return rows.withColumn("own", held(F.filter(own, lambda x: x.isNotNull() & (x != ""))))


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own, without quotes), n_quotes, n_linked, max_level, parent_conv_id, parent_turn,
    thread_conv_id, thread_turn, depth, place of every row of messages (conv_id, turn, role, text)."""
    rows = with_own(cut(parsed(messages)))  # texts are parsed once
    usable = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    quotes = cut(
        rows.filter(usable & F.exists("passages", lambda p: p["level"] > 0))
        .select("conv_id", "turn", F.posexplode("passages").alias("at", "p"))
        .filter("p.level > 0")
        .select("conv_id", "turn", "at", F.col("p.level").alias("level"), normal(F.col("p.text")).alias("normal"), line_hashes(F.col("p.text")).alias("lines"))
        .filter("normal <> ''")
        .withColumn("hash", F.md5("normal"))
        .withColumn("key", F.md5(F.concat_ws(" ", "hash", "lines")))
        .drop("normal")
    )
    paragraphs = F.flatten(F.transform("own", lambda x: F.split(x, PARAGRAPHS)))
    units = F.array_distinct(F.transform(F.flatten(F.array(F.array(F.array_join("own", "\n")), F.col("own"), paragraphs, F.flatten(F.transform("own", lambda x: F.split(x, "\n"))))), normal))
    # Only hashes that are quoted matter: each is one row here, and what joins it is pre-aggregated.
    asked = cut(quotes.select("key", "hash", "lines").distinct())
    said = rows.filter(usable).select("conv_id", "turn", F.explode(units).alias("unit")).filter("unit <> ''").select(F.md5("unit").alias("hash"), "conv_id", "turn")
    inside = said.groupBy("hash", "conv_id").agg(F.min("turn").alias("first")).join(asked.select("hash").distinct(), "hash", "left_semi")
    inside = cut(cut(inside).join(asked.select("key", "hash"), "hash").select("key", "conv_id", "first"))
    several = cut(asked.filter((F.size("lines") > 0) & (F.array_join("lines", " ") != F.col("hash"))).select("key", "lines"))
    if not several.isEmpty():
        own_lines = rows.filter(usable).select("conv_id", "turn", line_hashes(F.array_join("own", "\n")).alias("lines"))
        inside = cut(inside.unionByName(holding_lines(several, own_lines)).groupBy("key", "conv_id").agg(F.min("first").alias("first")))
    outside = cut(inside.groupBy("key").agg(F.min(F.struct("conv_id", "first")).alias("other")))
    found = quotes.join(inside.withColumnRenamed("first", "own_first"), ["key", "conv_id"], "left")
    same = F.when(F.col("own_first") < F.col("turn"), F.struct(F.col("conv_id"), F.col("own_first").alias("first")))
    found = cut(found.withColumn("same", same)).join(outside, "key", "left")
    target = F.coalesce("same", F.when(F.col("other.conv_id") < F.col("conv_id"), F.col("other")))
    linked = F.col("target").isNotNull()
    links = found.select("conv_id", "turn", "key", "at", "level", target.alias("target")).groupBy("conv_id", "turn").agg(F.countDistinct(F.when(linked, F.struct("at", "key"))).alias("n_linked"), F.min(F.when(linked, F.struct("level", "at", "target"))).alias("best"))
    links = cut(links.select("conv_id", "turn", "n_linked", F.col("best.target.conv_id").alias("parent_conv_id"), F.col("best.target.first").alias("parent_turn")))
    level_of = F.transform("passages", lambda p: p["level"])
    out = rows.select("conv_id", "turn", "role", F.when(F.array_max(level_of) == 0, F.col("passages")[0]["text"]).otherwise(F.array_join("own", "\n")).alias("text"), F.size(F.filter(level_of, lambda x: x > 0)).alias("n_quotes"), F.array_max(level_of).alias("max_level"))
    out = out.join(links, ["conv_id", "turn"], "left").join(places(rows, links), ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "text", "n_quotes", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "max_level", "parent_conv_id", "parent_turn", "thread_conv_id", "thread_turn", "depth", "place")


def threads(links: DataFrame) -> DataFrame:
    """node, top, depth of every message of links that has a parent: nodes are (conv_id, turn), top is its root.

    Each turn replaces what a node points to by what that points to, so the longest chain shortens by half. A root is
    no node here, so however many point to it, they join nothing.
    """
    up = F.struct(F.col("parent_conv_id").alias("conv_id"), F.col("parent_turn").alias("turn"))
    now = cut(links.filter("parent_conv_id is not null").select(F.struct("conv_id", "turn").alias("node"), up.alias("top"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("moved")))
    while now.filter("moved").take(1):
        above = now.select(F.col("node").alias("top"), F.col("top").alias("higher"), F.col("depth").alias("more"))
        now = cut(now.join(above, "top", "left").select("node", F.coalesce("higher", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0).cast("long"))).alias("depth"), F.col("higher").isNotNull().alias("moved")))
    return now.drop("moved")


def places(messages: DataFrame, links: DataFrame) -> DataFrame:
    """conv_id, turn, thread_conv_id, thread_turn, depth, place of every conversation and turn of messages.

    The places of a conversation are counted over ranges of the sorted messages, then within each range, so that no task
    has a whole conversation.
    """
    counts = messages.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    of = threads(links).select("node.*", F.col("top.conv_id").alias("thread_conv_id"), F.col("top.turn").alias("thread_turn"), "depth")
    own = [F.coalesce("thread_conv_id", "conv_id").alias("thread_conv_id"), F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth")]
    rows = cut(cut(counts).join(of, ["conv_id", "turn"], "left").select("conv_id", "turn", "n", *own))
    order = ["thread_turn", "depth", "conv_id", "turn"]
    ranges = max(int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / RANGE))
    spread = cut(rows.repartitionByRange(ranges, "thread_conv_id", *order).withColumn("range", F.spark_partition_id()))
    earlier = Window.partitionBy("thread_conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = spread.groupBy("thread_conv_id", "range").agg(F.sum("n").alias("n")).select("thread_conv_id", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("thread_conv_id", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = spread.withColumn("k", F.coalesce(F.sum("n").over(within), F.lit(0)))
    placed = ranked.join(cut(before), ["thread_conv_id", "range"]).select("conv_id", "turn", "thread_conv_id", "thread_turn", "depth", (F.col("before") + F.col("k") + 1).alias("place"))
    return cut(placed)


#: What as_mail() has a row quote, by kind: how many conversations and turns before its own.
ASKED = {"last": (0, 1, (0, 1)), "older": (0, 2, (0, 2)), "third": (0, 3, (3,)), "other": (1, 0, (4,))}


def as_mail(messages: DataFrame) -> DataFrame:
    """messages as they would be exchanged by mail: each row's text with a quote of what it may answer.

    A turn's text is the least of its rows' texts. By a hash of (conv_id, turn), a row has: below its own text, the text
    before it under an attribution line, and the text before that one, one level deeper; above its own text, the first
    line of the text before it; the last line of the text two turns before; the first and last line of the text three
    turns before, with a mark of a cut between; the text of this turn in the conversation whose id is less by one;
    nothing. Rows without what they would quote stay as they are.
    """
    rows = only(messages, "conv_id", "turn", "role", "text")
    usable = rows.filter("conv_id is not null and turn is not null")
    said = usable.filter("text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    kind = lambda conv, turn: F.pmod(F.xxhash64(conv, turn), F.lit(6))
    asks = [F.when(kind(F.col("conv_id") + c, F.col("turn") + t).isin(*kinds), F.struct((F.col("conv_id") + c).alias("conv_id"), (F.col("turn") + t).alias("turn"), F.lit(name).alias("name"))) for name, (c, t, kinds) in ASKED.items()]
    sent = said.withColumn("to", F.explode(F.filter(F.array(*asks), lambda x: x.isNotNull()))).select("to.*", "said")
    given = sent.groupBy("conv_id", "turn").agg(*[F.max(F.when(F.col("name") == name, F.col("said"))).alias(name) for name in ASKED])
    mark = lambda text, lead: F.concat(F.lit(lead), F.replace(text, F.lit("\n"), F.lit("\n" + lead)))
    line = lambda name, i: F.element_at(F.split(name, "\n"), i)
    older = F.coalesce(F.concat(F.lit("\n>\n> Before that, somebody wrote:\n"), mark(F.col("older"), "> > ")), F.lit(""))
    which = kind(F.col("conv_id"), F.col("turn"))
    below = F.when(which == 0, F.concat(F.lit("\n\nOn that day, somebody wrote:\n"), mark(F.col("last"), "> "), older))
    ends = F.concat(F.lit("> "), line("third", 1), F.lit("\n> [...]\n> "), line("third", -1))
    above = F.when(which == 1, mark(line("last", 1), "> ")).when(which == 2, mark(line("older", -1), ">")).when(which == 3, ends).when(which == 4, mark(F.col("other"), "> "))
    given = given.select("conv_id", "turn", F.concat(above, F.lit("\n\n")).alias("above"), below.alias("below"))
    mail = F.when(F.col("above").isNotNull() | F.col("below").isNotNull(), F.concat(F.coalesce("above", F.lit("")), F.coalesce("text", F.lit("")), F.coalesce("below", F.lit("")))).otherwise(F.col("text"))
    return rows.join(given, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", mail.alias("text"))
