"""Quotation linking: replies are tied to what they quote, and conversations are ordered by replies, without quotes.

A line's quote level is the number of its leading ">" marks. Neighbouring quoted lines of one level are a passage. Passages and
the messages' own texts are normalised (no marks, small letters, single spaces, line breaks as spaces) and hashed by runs of RUN
words: of a passage every run, of an own text those that start at each RUN-th word. A passage of 2 * RUN - 1 words holds such a
run wherever its lines were broken and wherever in the original it begins. Shorter passages, and shorter lines of passages,
are also hashed whole, to be found as an own line, sentence or text. A hash's original is the latest earlier message of the
conversation that has it. A passage links to the message that is the original of most of its words (of equals the latest), if
these are half of those that a whole quote would share or more. A message replies to the link of its lowest quoted level, the latest of several.

Only hashes that are quoted somewhere are looked at again. Originals are found by ordered passes over blocks of turns and then
over the blocks, never by pairs, and no pass sees all rows of a hash that every message has. Reply chains become trees, whose
order is found by doubling links along a tour of each, with one row an end of a message and no lists of ancestors.

A row per message comes out, and sorting by (conv_id, root, position) gives each conversation in reply order. Null texts are
empty. Rows with a null conversation or turn link to nothing. Repeated rows stay; a link to a turn that several rows have is a
link to the turn, and such rows share a place. A very long message is one row's work. An empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, table, unsettle
from .decontaminate import bound

MARKS = r"^[ \t]*((?:>[ \t]?)+)"
#: Words of a hashed run, and turns of a block.
RUN, BLOCK = 4, 1024


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, row, lines: array of (i, level, body), without "... wrote:" lines before quotes."""
    m = messages.select(F.monotonically_increasing_id().alias("row"), F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    level = lambda x: F.char_length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), r"[^>]", ""))
    lines = F.transform(F.split("body", "\n"), lambda x, i: F.struct(i.alias("i"), level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("body")))
    m = m.select("row", "conv_id", "turn", "role", lines.alias("lines"))
    introduces = lambda x: (x["level"] == 0) & F.regexp_like(x["body"], F.lit(r"(?i)\bwrote:\s*$")) & F.coalesce(F.get("lines", x["i"] + 1)["level"] > 0, F.lit(False))
    return m.withColumn("lines", F.filter("lines", lambda x: ~introduces(x)))


def runs(text: Column, step: int) -> Column:
    """Hashes of the runs of RUN words of a normalised text that start at each step-th word."""
    none = F.expr("cast(array() as array<string>)")
    return bound(F.split(text, " "), lambda w: F.when(F.size(w) >= RUN, F.transform(F.sequence(F.lit(1), F.size(w) - (RUN - 1), F.lit(step)), lambda i: F.md5(F.array_join(F.slice(w, i, RUN), " ")))).otherwise(none))


def own_text(lines: Column) -> Column:
    return F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n")


def passages(m: DataFrame) -> DataFrame:
    """row, conv_id, turn, passage, level, words, hashes (each with the words for which it stands)."""
    q = m.where(F.exists("lines", lambda x: x["level"] > 0)).select("row", "conv_id", "turn", F.inline(F.filter("lines", lambda x: x["level"] > 0)))
    w = Window.partitionBy("row").orderBy("i")
    opens = F.coalesce((F.lag("level").over(w) != F.col("level")) | (F.lag("i").over(w) != F.col("i") - 1), F.lit(True)).cast("int")
    q = q.withColumn("opens", opens).withColumn("passage", F.sum("opens").over(w))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("i", "body"))), lambda x: normal(x["body"]))
    q = q.groupBy("row", "conv_id", "turn", "passage", "level").agg(F.filter(lines, lambda x: x != "").alias("body")).where(F.size("body") > 0)
    q = q.withColumn("norm", F.array_join("body", " ")).withColumn("words", F.size(F.split("norm", " ")))
    short = F.filter(F.array_distinct(F.concat("body", F.array("norm"))), is_short)
    marks = F.concat(F.transform(F.array_distinct(runs(F.col("norm"), 1)), lambda h: F.struct(h.alias("h"), F.lit(RUN).alias("weight"))), F.transform(short, lambda x: F.struct(unit(x).alias("h"), F.size(F.split(x, " ")).alias("weight"))))
    return q.select("row", "conv_id", "turn", "passage", "level", "words", marks.alias("hashes"))


def is_short(x: Column) -> Column:
    return (x != "") & (F.size(F.split(x, " ")) < 2 * RUN - 1)


def unit(x: Column) -> Column:
    return F.md5(F.concat(F.lit("= "), x))


def own_hashes(lines: Column) -> Column:
    """The hashes by which a message can be quoted."""

    def of(text: Column) -> Column:
        units = F.transform(F.concat(F.split(text, "\n"), F.split(text, r"(?<=[.!?])\s+"), F.array(text)), normal)
        return F.array_distinct(F.concat(runs(normal(text), RUN), F.transform(F.filter(F.array_distinct(units), is_short), unit)))

    return bound(own_text(lines), of)


def latest_before(asked: DataFrame, own: DataFrame) -> DataFrame:
    """asked (conv_id, h, turn; distinct) with target: the greatest smaller turn of own (conv_id, h, turn; distinct) of that conversation and hash."""
    block = F.floor(F.col("turn") / BLOCK).alias("block")
    both = settle(asked.select("conv_id", "h", "turn", block, F.lit(0).alias("kind")).unionByName(own.select("conv_id", "h", "turn", block, F.lit(1).alias("kind"))))
    inside = Window.partitionBy("conv_id", "h", "block").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(F.when(F.col("kind") == 1, F.col(c)), ignorenulls=True)
    found = settle(both.withColumn("target", last("turn").over(inside)).where("kind = 0").select("conv_id", "h", "turn", "block", "target"))
    # Where the block has none, the latest earlier block that has one: a row a block.
    ends = both.where("kind = 1").groupBy("conv_id", "h", "block").agg(F.max("turn").alias("end")).withColumn("kind", F.lit(1))
    open_ = found.where("target is null").select("conv_id", "h", "block").distinct().withColumns({"end": F.lit(None).cast("long"), "kind": F.lit(0)})
    upto = Window.partitionBy("conv_id", "h").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.unionByName(open_).withColumn("target", last("end").over(upto)).where("kind = 0 and target is not null").select("conv_id", "h", "block", "target")
    none = found.where("target is null").drop("target").join(earlier, ["conv_id", "h", "block"])
    return found.where("target is not null").unionByName(none).select("conv_id", "h", "turn", "target")


def replies(m: DataFrame, q: DataFrame) -> DataFrame:
    """row, n_linked, reply_to of the messages with a passage that links."""
    each = q.where("conv_id is not null and turn is not null").select("row", "passage", "level", "conv_id", "turn", F.inline("hashes"))
    own = m.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(own_hashes(F.col("lines"))).alias("h"))
    own = own.join(each.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi").distinct()
    hits = each.join(latest_before(each.select("conv_id", "h", "turn").distinct(), own), ["conv_id", "h", "turn"])
    best = hits.groupBy("row", "passage", "level", "target").agg(F.sum("weight").alias("n")).groupBy("row", "passage", "level").agg(F.max(F.struct("n", "target")).alias("b"))
    linked = best.join(q.select("row", "passage", "words"), ["row", "passage"]).where(F.col("b.n") * 2 >= F.col("words") - (RUN - 1))
    return linked.groupBy("row").agg(F.count("*").alias("n_linked"), F.min(F.struct("level", (-F.col("b.target")).alias("t"))).alias("r")).select("row", "n_linked", (-F.col("r.t")).alias("reply_to"))


def places(links: DataFrame) -> DataFrame:
    """conv_id, turn, root, position, depth of each message in a tree. links: conv_id, turn, reply_to; a turn is there once.

    The tour of a tree enters and leaves each message; next leads along it, and doubling adds up what lies between. The sums
    to the end tell the depth, and how many messages come after."""
    up = settle(links.select("conv_id", "turn", "reply_to").unionByName(links.select("conv_id", F.col("reply_to").alias("turn")).distinct().join(links.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").withColumn("reply_to", F.lit(None).cast("long"))))
    first = up.where("reply_to is not null").groupBy("conv_id", F.col("reply_to").alias("turn")).agg(F.min("turn").alias("child"))
    after = F.lead("turn").over(Window.partitionBy("conv_id", "reply_to").orderBy("turn"))
    siblings = up.where("reply_to is not null").withColumn("sibling", after).unionByName(up.where("reply_to is null").withColumn("sibling", F.lit(None).cast("long")))
    end = lambda turn, enters: F.struct(turn.alias("turn"), F.lit(enters).alias("enters"))
    t = siblings.join(first, ["conv_id", "turn"], "left")
    enter = t.select("conv_id", end(F.col("turn"), True).alias("at"), F.when(F.col("child").isNotNull(), end(F.col("child"), True)).otherwise(end(F.col("turn"), False)).alias("next"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("open"))
    onward = F.when(F.col("sibling").isNotNull(), end(F.col("sibling"), True)).otherwise(end(F.coalesce("reply_to", "turn"), False))
    root = F.col("reply_to").isNull()
    leave = t.select("conv_id", end(F.col("turn"), False).alias("at"), onward.alias("next"), F.lit(0).cast("long").alias("n"), F.when(root, F.lit(0)).otherwise(F.lit(-1)).cast("long").alias("open"))
    e = settle(enter.unionByName(leave))
    while True:
        ahead = e.select("conv_id", F.col("at").alias("next"), F.col("next").alias("beyond"), F.col("n").alias("more"), F.col("open").alias("opened"))
        sums = e.select("conv_id", "at", "next", "n", "open").join(ahead, ["conv_id", "next"])
        e, last = settle(sums.select("conv_id", "at", F.col("beyond").alias("next"), (F.col("n") + F.col("more")).alias("n"), (F.col("open") + F.col("opened")).alias("open"), (F.col("next") != F.col("beyond")).alias("moved"))), e
        unsettle(last)
        if e.where("moved").isEmpty():
            break
    own = e.where("at.enters").select("conv_id", F.col("at.turn").alias("turn"), F.col("next.turn").alias("root"), "n", (1 - F.col("open")).alias("depth"))
    whole = own.where("turn = root").select("conv_id", "root", F.col("n").alias("all"))
    return own.join(whole, ["conv_id", "root"]).select("conv_id", "turn", "root", (F.col("all") - F.col("n")).alias("position"), "depth")


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_passages, n_linked, reply_to, depth, root (the first turn of its chain), position (in the order of root's tree)."""
    m = settle(parsed(messages, conv_col, turn_col, role_col, text_col))
    q = settle(passages(m))
    out = m.join(q.groupBy("row").agg(F.count("*").alias("n_passages")), "row", "left")
    if not q.isEmpty():
        reply = settle(replies(m, q))
        out = settle(out.join(reply, "row", "left"))
        # A turn's own reply is that of its rows' earliest.
        tree = places(settle(out.where("reply_to is not null").groupBy("conv_id", "turn").agg(F.min("reply_to").alias("reply_to"))))
        out = out.join(tree, ["conv_id", "turn"], "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("long") for c in ("n_linked", "reply_to", "root", "position", "depth")})
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", "turn", "role", F.regexp_replace(own_text(F.col("lines")), r"^\s+|\s+$", "").alias("text"), zero("n_passages"), zero("n_linked"), "reply_to", zero("depth"), F.coalesce("root", "turn").alias("root"), zero("position"))


def reply_order(linked: DataFrame) -> DataFrame:
    """Ordered by conversation, root and position, range by range, so no conversation must fit one task."""
    return linked.repartitionByRange("conv_id", "root", "position", "turn").sortWithinPartitions("conv_id", "root", "position", "turn")


def op3(spark, sf_dir: str) -> DataFrame:
    return reply_order(link(table(spark, sf_dir, "conversations")))
