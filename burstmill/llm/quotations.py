"""Chat formatting by quotation linking.

A line's quote level is the number of `>` at its start, spaces between them allowed. Lines of level 0 are the message's own
text; a line that announces a quote (it ends in a colon and says who wrote) is left out of it. A passage is a run of
lines of one level, up to an empty line. It is normalised (lower case, single spaces also for line ends, no mark at the
ends) and hashed, and so is each of its lines of MIN_CHARS characters or more, as quotes may be partial. Own passages are
hashed in the same way. A quoted hash belongs to the earliest message of its conversation, before the quoting one, that
has it as its own. A message answers the one to which most of its level-1 hashes belong (ties: the latest turn); nested
levels link to earlier ones likewise. A message that links to nothing at level 1 answers the turn before it.

Conversations are built in reply order: a message is followed by the replies to it, the earliest turn first, each with
its own replies after it. Where nobody answers anything but the turn before, that is the order of turns. Where some
message has several replies, each message names the next one (its first reply, else the next reply of the nearest
message above it that has one), and positions follow from these links by doubling: in as many rounds of joins as the
length of the longest such conversation has binary digits. No conversation is collected: turns and the replies to
one message are numbered in stretches of STRETCH turns, and rows that share a turn have one position.

Rows with null conversation or turn are kept, link to nothing and have no position; repeated rows link alike; a null text
is empty. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstmill.llm.texts import text_of
from burstmill.shared import discard, fresh, materialize, ship_package, with_field

MIN_CHARS = 12
#: Turns of a conversation that are numbered in one window.
STRETCH = 4096
_MARKS = re.compile(r"^(?:[ \t]*>)+")
_INTRO = re.compile(r"(?:wrote|writes|schrieb|a écrit|escribió)\b.*:\s*$", re.I)


def normalise(line: str) -> str:
    return re.sub(r"\s+", " ", line.strip().strip("*_.,;:!?\"'").strip().lower())


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The own text, and (level, line) of the quoted lines without their marks."""
    own, quoted = [], []
    lines = (text or "").split("\n")
    for i, line in enumerate(lines):
        marks = _MARKS.match(line)
        if marks:
            quoted.append((marks[0].count(">"), line[marks.end() :].strip()))
        elif not (_INTRO.search(line) and i + 1 < len(lines) and _MARKS.match(lines[i + 1])):
            own.append(line)
    return "\n".join(own).strip() if quoted else text or "", quoted


def passages(text: str | None) -> list[tuple[int, list[str]]]:
    """(level, lines) of all passages, own ones at level 0, announcing lines left out."""
    out: list[tuple[int, list[str]]] = []
    open_ = False
    lines = (text or "").split("\n")
    for i, line in enumerate(lines):
        marks = _MARKS.match(line)
        level, kept = (marks[0].count(">"), line[marks.end() :]) if marks else (0, line)
        if not kept.strip() or not marks and _INTRO.search(line) and i + 1 < len(lines) and _MARKS.match(lines[i + 1]):
            open_ = False
            continue
        if not open_ or out[-1][0] != level:
            out.append((level, []))
        out[-1][1].append(kept)
        open_ = True
    return out


def hashes(lines: list[str]) -> set[int]:
    """Those of a passage, however short, and of its longer lines."""
    kept = [normalise(" ".join(lines)), *(x for line in lines if len(x := normalise(line)) >= MIN_CHARS)]
    return {xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in kept if x}


_PARSED = "struct<own:string,own_sha256:string,levels:int,quoted_lines:int,lines:array<bigint>,quotes:array<struct<level:int,line:bigint>>>"


def with_quotes(messages: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns and the parsed message, a struct, as the last column; bytes that are not UTF-8 count as U+FFFD."""
    ship_package(messages.sparkSession)
    name = fresh(messages, "parsed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct(
            [("own", pa.string()), ("own_sha256", pa.string()), ("levels", pa.int32()), ("quoted_lines", pa.int32()), ("lines", pa.list_(pa.int64())), ("quotes", pa.list_(pa.struct([("level", pa.int32()), ("line", pa.int64())])))]
        )
        for b in batches:
            rows = []
            for x in b.column(b.num_columns - 1):
                message = text_of(x)
                own, quoted = parse(message)
                found = [(level, hashes(lines)) for level, lines in passages(message)]
                rows.append(
                    {
                        "own": own,
                        "own_sha256": hashlib.sha256(own.encode("utf-8", "replace")).hexdigest(),
                        "levels": max((n for n, _ in quoted), default=0),
                        "quoted_lines": len(quoted),
                        "lines": list(set().union(*(h for level, h in found if not level))),
                        "quotes": [{"level": level, "line": h} for level, some in found if level for h in sorted(some)],
                    }
                )
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, kind)], names=[*b.schema.names[:-1], name])

    return messages.select(*keep, F.col(text).alias(fresh(messages, "text_read"))).mapInArrow(run, with_field(messages.select(*keep).schema, name, _PARSED))


def with_turn_before(turns: DataFrame) -> DataFrame:
    """turns (c, t), distinct, with `before`, the turn before in the conversation, and `number`, from 0.

    Windows hold STRETCH turns; those of whole conversations hold one row for each stretch.
    """
    stretch = F.floor(F.col("t") / STRETCH)
    sums = turns.groupBy("c", stretch.alias("s")).agg(F.count("*").alias("n"), F.max("t").alias("last"))
    whole = Window.partitionBy("c").orderBy("s")
    offsets = sums.select("c", "s", F.sum("n").over(whole).alias("upto"), "n", F.lag("last").over(whole).alias("last"))
    inside = Window.partitionBy("c", "s").orderBy("t")
    own = turns.withColumn("s", stretch).withColumns({"place": F.row_number().over(inside), "lag": F.lag("t").over(inside)})
    joined = own.join(offsets, ["c", "s"])
    return joined.select("c", "t", F.coalesce("lag", "last").alias("before"), (F.col("upto") - F.col("n") + F.col("place") - 1).alias("number"))


def with_next_sibling(tree: DataFrame) -> DataFrame:
    """tree (c, t, parent), distinct, with `sibling`, the next turn among those with the same parent (null: the roots).

    As in with_turn_before, windows hold STRETCH turns; those of all replies to a message hold one row for each stretch."""
    rows = tree.withColumns({"root": F.col("parent").isNull(), "p": F.coalesce("parent", F.lit(0)), "s": F.floor(F.col("t") / STRETCH)})
    inside = Window.partitionBy("c", "root", "p", "s").orderBy("t")
    starts = rows.groupBy("c", "root", "p", "s").agg(F.min("t").alias("start"))
    after = starts.select("c", "root", "p", "s", F.lead("start").over(Window.partitionBy("c", "root", "p").orderBy("s")).alias("after"))
    own = rows.withColumn("lead", F.lead("t").over(inside))
    return own.join(after, ["c", "root", "p", "s"]).select("c", "t", "parent", F.coalesce("lead", "after").alias("sibling"))


def reply_order(replies: DataFrame) -> DataFrame:
    """(c, t, position) of (c, t, parent, number): the order in which a message's replies follow it."""
    several = replies.filter("parent IS NOT NULL").groupBy("c", "parent").count().filter("count > 1").select("c").distinct()
    several = materialize(several, "quotes-branched")
    plain = replies.join(several, "c", "left_anti").select("c", "t", F.col("number").alias("position"))
    if several.isEmpty():
        return plain
    tree = materialize(replies.join(several, "c", "left_semi").select("c", "t", "parent"), "quotes-tree")
    first = tree.filter("parent IS NOT NULL").groupBy("c", F.col("parent").alias("t")).agg(F.min("t").alias("first"))
    ordered = with_next_sibling(tree)
    up = materialize(ordered.withColumn("stop", F.col("sibling").isNotNull() | F.col("parent").isNull()), "quotes-up")
    while True:
        # who has no next sibling looks at the message above: `parent` moves up, twice as far in each round. Only the last
        # of a message's replies climbs, so no key of the join is crowded at first; the others pass by
        above = up.select("c", F.col("t").alias("parent"), F.col("sibling").alias("s2"), F.col("parent").alias("p2"), F.col("stop").alias("stop2"))
        climbed = up.filter(~F.col("stop")).join(above, ["c", "parent"]).select("c", "t", F.col("p2").alias("parent"), F.col("s2").alias("sibling"), F.col("stop2").alias("stop"))
        before, up = up, materialize(up.filter("stop").select("c", "t", "parent", "sibling", "stop").unionByName(climbed), "quotes-up")
        discard(before)
        if up.filter(~F.col("stop")).isEmpty():
            break
    follows = up.join(first, ["c", "t"], "left").select("c", "t", F.coalesce("first", "sibling").alias("next"))
    rank = materialize(follows.withColumn("behind", F.col("next").isNotNull().cast("long")), "quotes-rank")
    while not rank.filter("next IS NOT NULL").isEmpty():
        ahead = rank.select("c", F.col("t").alias("next"), F.col("next").alias("n2"), F.col("behind").alias("b2"))
        doubled = rank.filter("next IS NOT NULL").join(ahead, ["c", "next"]).select("c", "t", F.col("n2").alias("next"), (F.col("behind") + F.col("b2")).alias("behind"))
        before, rank = rank, materialize(rank.filter("next IS NULL").select("c", "t", "next", "behind").unionByName(doubled), "quotes-rank")
        discard(before)
    sizes = tree.groupBy("c").agg(F.count("*").alias("size"))
    return plain.unionByName(rank.join(sizes, "c").select("c", "t", (F.col("size") - 1 - F.col("behind")).alias("position")))


def link(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, turn, role, own, own_sha256, levels, quoted_lines, linked_hashes, parent_turn, position, origins) of every message.

    own is the text without quotes; position is the message's place in the conversation's reply order, from 0; origins
    lists (level, turn) of the messages that its quotes come from.
    """
    parsed = with_quotes(messages, text, [conversation, turn, role])
    parsed = materialize(parsed.select(F.col(conversation).alias("c"), F.col(turn).cast("long").alias("t"), F.col(turn).alias("t_given"), F.col(role).alias("r"), f"{parsed.columns[-1]}.*"), "quotes-parsed")
    asked = parsed.select("c", "t", F.explode("quotes").alias("q")).select("c", "t", "q.level", "q.line").filter("c IS NOT NULL AND t IS NOT NULL")
    asked = materialize(asked.groupBy("c", "t", "level", "line").agg(F.count("*").alias("times")), "quotes-asked")
    # only hashes that someone quotes are looked up; the earliest message of a conversation that has one stands for it
    wanted = asked.select("c", "line").distinct()
    lines = parsed.select("c", "t", F.explode("lines").alias("line")).join(wanted, ["c", "line"], "left_semi")
    first = lines.groupBy("c", "line").agg(F.min("t").alias("origin"))
    met = asked.join(first, ["c", "line"]).filter("origin < t").groupBy("c", "t", "level", "origin").agg(F.sum("times").alias("times"))
    best = met.groupBy("c", "t", "level").agg(F.max(F.struct("times", "origin")).alias("best"), F.sum("times").alias("linked"))
    found = best.groupBy("c", "t").agg(
        F.sum("linked").alias("linked_hashes"),
        F.max(F.when(F.col("level") == 1, F.col("best.origin"))).alias("quoted"),
        F.sort_array(F.collect_list(F.struct("level", F.col("best.origin").alias("turn")))).alias("origins"),
    )
    turns = with_turn_before(parsed.filter("c IS NOT NULL AND t IS NOT NULL").select("c", "t").distinct())
    replies = turns.join(found, ["c", "t"], "left").withColumn("parent", F.coalesce("quoted", "before"))
    replies = materialize(replies.select("c", "t", "parent", "number", "linked_hashes", "origins"), "quotes-replies")
    ordered = replies.join(reply_order(replies), ["c", "t"]).drop("number")
    out = parsed.join(ordered, ["c", "t"], "left")
    columns = [F.col("c").alias(conversation), F.col("t_given").alias(turn), F.col("r").alias(role)]
    return out.select(*columns, "own", "own_sha256", "levels", "quoted_lines", F.coalesce("linked_hashes", F.lit(0)).alias("linked_hashes"), F.col("parent").alias("parent_turn"), "position", "origins")
