"""Chat formatting by quotation linking: nested quotes are parsed, hashed and joined to the messages they quote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafweave.llm.common import numbered, persisted, scratch

#: A line's quote marks: `>` with blanks between and after them.
MARKS = r"^[ \t]*((?:>[ \t]?)+)"
#: Lines that only introduce a quote.
INTRODUCTION = r"(?i)^\s*(on\b.*\bwrote|.*\bwrote|-+ ?original message ?-+)\s*:?\s*$"


def parsed(messages: DataFrame) -> DataFrame:
    """messages (conv, turn, role, text) as conv, turn, role, own (the text without quotes and the lines that introduce
    them), passages (an array of (level, hash, parts): runs of lines of one level, without their marks, white space
    collapsed, lower-cased; parts are the hashes of the lines of a run of several) and units (an array of (hash, whole):
    what others may quote, the own text and its runs of lines between blank or quoted ones, whole, and their lines)."""
    lines = r"transform(split(t, '\r?\n'), x -> struct(length(regexp_replace(regexp_extract(x, marks, 1), '[^>]', '')) AS level, regexp_replace(x, marks, '') AS line))"
    df = messages.withColumn("t", F.coalesce("text", F.lit(""))).withColumn("marks", F.lit(MARKS)).withColumn("lines", F.expr(lines))
    df = df.withColumn("lines", F.expr("filter(lines, (x, i) -> NOT (x.level = 0 AND regexp_like(x.line, intro) AND coalesce(get(lines, i + 1).level, 0) > 0))".replace("intro", "'" + INTRODUCTION.replace("\\", "\\\\") + "'")))
    df = df.withColumn("lines", F.expr(r"transform(lines, x -> struct(x.level AS level, x.line AS line, lower(trim(regexp_replace(x.line, '\\s+', ' '))) AS body))"))
    # Runs: a line begins one if its level isn't the one before's, or it or the one before is blank.
    starts = "filter(sequence(0, size(lines) - 1), i -> i = 0 OR lines[i].level <> lines[i - 1].level OR trim(lines[i].line) = '' OR trim(lines[i - 1].line) = '')"
    df = df.withColumn("starts", F.expr(f"CASE WHEN size(lines) > 0 THEN {starts} ELSE cast(array() AS array<int>) END"))
    bodies = "filter(transform(slice(lines, s + 1, coalesce(get(starts, k + 1), size(lines)) - s), x -> x.body), b -> b <> '')"
    df = df.withColumn("runs", F.expr(f"filter(transform(starts, (s, k) -> struct(lines[s].level AS level, {bodies} AS bodies)), r -> size(r.bodies) > 0)"))
    df = df.withColumn("runs", F.expr("transform(runs, r -> struct(r.level AS level, r.bodies AS bodies, array_join(r.bodies, ' ') AS body))"))
    df = df.withColumn("quoted", F.expr("filter(runs, r -> r.level > 0)")).withColumn("said", F.expr("filter(runs, r -> r.level = 0)"))
    own = F.expr("trim(array_join(transform(filter(lines, x -> x.level = 0), x -> x.line), '\n'))")
    df = df.withColumn("own", F.regexp_replace(F.regexp_replace(own, r"^\s+|\s+$", ""), r"\n{3,}", "\n\n"))
    # A quote may hold several runs of its level: the whole of them counts too.
    several = "filter(array_distinct(transform(quoted, r -> r.level)), v -> size(filter(quoted, r -> r.level = v)) > 1)"
    whole = f"transform({several}, v -> struct(v AS level, unhex(md5(array_join(transform(filter(quoted, r -> r.level = v), r -> r.body), ' '))) AS hash, cast(array() AS array<binary>) AS parts))"
    parts = "CASE WHEN size(r.bodies) > 1 THEN array_distinct(transform(r.bodies, b -> unhex(md5(b)))) ELSE cast(array() AS array<binary>) END"
    df = df.withColumn("passages", F.expr(f"array_distinct(concat(transform(quoted, r -> struct(r.level AS level, unhex(md5(r.body)) AS hash, {parts} AS parts)), {whole}))"))
    texts = "concat(transform(said, r -> r.body), filter(array(array_join(transform(said, r -> r.body), ' ')), b -> b <> ''))"
    single = "flatten(transform(filter(said, r -> size(r.bodies) > 1), r -> r.bodies))"
    units = f"array_distinct(concat(transform({texts}, b -> struct(unhex(md5(b)) AS hash, true AS whole)), transform({single}, b -> struct(unhex(md5(b)) AS hash, false AS whole))))"
    return df.withColumn("units", F.expr(units)).select("conv", "turn", "role", "own", "passages", "units")


def linked(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_col, turn_col, role_col, content, quotes, parent_turn, linked, thread_turn and depth of each message.

    content is the text without quotes. A quoted passage is joined, by the hash of its normalised text, to the first
    message of its conversation that has it as a text or run of its own, if that came before; a passage without such a
    message to the latest of those that were the first to have one of its lines. The parent is the latest of these
    of the shallowest level that has any (linked is true); a message without such a quote answers the turn before its
    own, whatever its number, if there is one, else it begins a thread. thread_turn is the first turn of the message's
    thread and depth its distance from it; see conversations() for the order they give. Threads are followed by doubling
    the distance each round, in as many rounds as the logarithm of the longest; a message whose first turn is found
    takes part in no further round.

    Null texts count as empty; rows without a conversation or turn keep their content and have no links; of repeated
    turns each row is kept, and the least parent places the turn in its thread. Of messages with one passage the first
    turn is its original. Originals are made unique by (conversation, hash) and written before the join, so that a hot
    passage gives each quote one row and its quotes can be dealt to several tasks. Turns are numbered by range, so that
    the turn before is found however long a conversation is. Very long texts are parsed whole, in one row each. Empty
    tables give no rows; other columns are not read."""
    names = dict(zip(("conv", "turn", "role", "text"), (conv_col, turn_col, role_col, text_col), strict=True))
    df = messages.select(*(F.col(f"`{c}`").alias(k) for k, c in names.items()))
    with scratch():
        df = persisted(parsed(df).withColumn("row", F.monotonically_increasing_id()))
        known = df.where("conv IS NOT NULL AND turn IS NOT NULL")
        units = known.select("conv", "turn", F.explode("units").alias("u"))
        first = persisted(units.groupBy("conv", F.col("u.hash").alias("hash")).agg(F.min(F.when(F.col("u.whole"), F.col("turn"))).alias("whole_at"), F.min("turn").alias("line_at")))
        asks = known.select("row", "conv", "turn", F.posexplode("passages").alias("k", "p"))
        asks = asks.select("row", "conv", "turn", "k", "p.level", F.explode(F.expr("concat(array(struct(p.hash AS hash, false AS part)), transform(p.parts, h -> struct(h AS hash, true AS part)))")).alias("a"))
        asks = asks.select("row", "conv", "turn", "k", "level", "a.hash", "a.part")
        found = asks.join(first, ["conv", "hash"]).where("line_at < turn").groupBy("row", "k", "level").agg(F.coalesce(F.max(F.expr("CASE WHEN NOT part AND whole_at < turn THEN whole_at END")), F.max("line_at")).alias("source"))
        found = found.groupBy("row").agg(F.max(F.struct(-F.col("level"), "source")).alias("best")).select("row", F.col("best.source").alias("source"))
        turns = persisted(numbered(known.select("conv", "turn").distinct(), "conv", "turn"))
        after = turns.select((F.col("number") + 1).alias("number"), F.col("conv").alias("of"), F.col("turn").alias("previous"))
        before = turns.join(after, "number").where("conv = of").select("conv", "turn", "previous")
        told = df.select("conv", "turn", "role", "own", "row", F.expr("size(array_distinct(transform(passages, p -> struct(p.level, p.hash))))").cast("long").alias("quotes"))
        every = told.join(found, "row", "left").join(before, ["conv", "turn"], "left")
        every = persisted(every.withColumn("parent", F.coalesce("source", "previous")), lasting=True)
        at = every.where("conv IS NOT NULL AND turn IS NOT NULL").groupBy("conv", "turn").agg(F.min("parent").alias("up"))
        at = persisted(at.select("conv", "turn", F.coalesce("up", "turn").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("up").isNull().alias("done")))
        placed, at = at.where("done").drop("done"), at.where("NOT done").drop("done")
        while at.head(1):
            # up is of depth 0, or further on its own way up.
            tops = placed.select("conv", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"), F.lit(True).alias("done"))
            ways = at.select("conv", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"), F.lit(False).alias("done"))
            step = persisted(at.join(tops.union(ways), ["conv", "up"]).select("conv", "turn", F.col("further").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), "done"))
            placed, at = placed.union(step.where("done").drop("done")), step.where("NOT done").drop("done")
        tops = persisted(placed.select("conv", "turn", F.col("up").alias("thread_turn"), "depth"), lasting=True)
    out = every.join(tops, ["conv", "turn"], "left")
    kept = {"conv": conv_col, "turn": turn_col, "role": role_col, "own": "content", "quotes": "quotes", "parent": "parent_turn"}
    return out.select(*(F.col(k).alias(c) for k, c in kept.items()), F.col("source").isNotNull().alias("linked"), F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))


def conversations(linked_messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """The messages of linked() with thread (conversations without quotes, numbered from 0) and place (from 0 within the
    thread), in reply order: every message follows what it answers, and the threads of a conversation follow each
    other. Rows are numbered by range, so that a thread may be longer than a task can hold; repeated turns follow each
    other in the order of their content."""
    rows = linked_messages.withColumn("_none", F.col(conv_col).isNull() | F.col(turn_col).isNull())
    rows = persisted(numbered(rows, "_none", conv_col, "thread_turn", turn_col, "content", name="_at"), lasting=True)
    key = [F.col(conv_col).alias("_conv"), F.col("thread_turn").alias("_top")]
    begin = numbered(rows.groupBy(*key).agg(F.min("_at").alias("_from")), "_from", name="thread")
    same = F.col(conv_col).eqNullSafe(F.col("_conv")) & F.col("thread_turn").eqNullSafe(F.col("_top"))
    return rows.join(begin, same).select(*linked_messages.columns, "thread", (F.col("_at") - F.col("_from")).alias("place"))
