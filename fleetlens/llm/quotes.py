"""Conversations in reply order, linked by quotations and freed of them.

Lines that start with ``>`` marks are quoted, one level for each mark. The sentences of a message's
own text and of each quoted passage are normalised and hashed, and so is every whole passage as a run
of sentences. A passage that an earlier message of the conversation said as a run points to the
latest one that did, of another passage each sentence does. What only one earlier message said
counts first, anything else by its rarity. The message quoted most at the outermost level is the
one replied to. Reply chains are resolved by pointer doubling.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.ordered import broadcast_if_small, clamped_totals, rank_in_group
from fleetlens.llm.tables import arrow_map
from fleetlens.session import durable

_MARKS = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)(.*)", re.S)
# fixed values: lines that announce a quotation, as mail programs write them
_INTRO = re.compile(r"(?:On\b.{0,200}\bwrote|Am\b.{0,200}\bschrieb|Le\b.{0,200}\ba écrit|El\b.{0,200}\bescribió)[^\n]{0,80}:\s*", re.S)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def split_quotes(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The own text of a message, and its quoted passages with their level, in order.

    A passage is a run of lines of one level. A line that announces a quotation belongs to it.
    """
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in text.split("\n"):
        m = _MARKS.fullmatch(line)
        if m is None:
            own.append(line)
            last = 0
            continue
        level = m[1].count(">")
        if last == 0:
            while own and not own[-1].strip():
                own.pop()
            for n in (1, 2):  # the announcement may be wrapped
                if _INTRO.fullmatch("\n".join(own[-n:]).strip()) and len(own) >= n:
                    del own[-n:]
                    break
        if level != last:
            passages.append((level, []))
        passages[-1][1].append(m[2])
        last = level
    return "\n".join(own).strip(), [(level, "\n".join(lines)) for level, lines in passages]


def sentences(text: str) -> list[str]:
    """Sentences without regard to case, white space and line breaks."""
    flat = " ".join(text.split()).lower()
    return [s for s in _SENTENCE.split(flat) if s]


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def _parsed(batch: pa.RecordBatch) -> pa.RecordBatch:
    own, said, quoted, passages = [], [], [], []
    for text in batch.column("text").to_pylist():
        mine, quotes = split_quotes(text or "")
        own.append(mine if text is not None else None)
        said.append([_hash(s) for s in sentences(mine)])
        passages.append(len(quotes))
        parts = [(level, sentences(q)) for level, q in quotes]
        quoted.append([{"level": level, "hashes": [_hash(s) for s in q], "chars": [len(s) for s in q]} for level, q in parts if q])
    kind = pa.list_(pa.struct([("level", pa.int64()), ("hashes", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64()))]))
    return pa.RecordBatch.from_arrays(
        [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(own, pa.string()),
         pa.array(said, pa.list_(pa.int64())), pa.array(quoted, kind), pa.array(passages, pa.int64())],
        ["conv_id", "turn", "role", "text", "said", "quoted", "n_quotes"])


def _said(messages: DataFrame, passages: DataFrame) -> DataFrame:
    """``conv_id, key, turn`` of the sentences, and of the runs as long as some quoted passage, that are quoted and said."""
    # a run can only begin where its first sentence stands, so only these places are hashed as runs
    long = F.size("hashes") > 1
    firsts = broadcast_if_small(durable(passages.filter(long).select(
        "conv_id", F.element_at("hashes", 1).alias("key"), F.size("hashes").alias("size")).distinct()))
    starts = messages.select("conv_id", "row", F.posexplode("said").alias("at", "key")).join(firsts, ["conv_id", "key"]).groupBy(
        "row").agg(F.collect_list(F.struct("at", "size")).alias("starts"))  # places of one message
    runs = messages.join(starts, "row").select("conv_id", "turn", F.explode(F.transform(
        F.filter("starts", lambda p: p["at"] + p["size"] <= F.size("said")),
        lambda p: F.xxhash64(F.slice("said", p["at"] + 1, p["size"])))).alias("key"))
    keys = passages.select("conv_id", F.explode(F.concat("hashes", F.array("run"))).alias("key")).distinct()
    said = messages.select("conv_id", "turn", F.explode("said").alias("key")).union(runs)
    return said.join(broadcast_if_small(durable(keys)), ["conv_id", "key"], "left_semi").select("conv_id", "key", "turn").distinct()


def _speakers(messages: DataFrame, passages: DataFrame) -> DataFrame:
    """``conv_id, turn, key, speakers, speaker``: how many earlier turns said what a turn quotes, and the latest of them."""
    said = _said(messages, passages).withColumn("one", F.lit(1))
    asked = passages.select("conv_id", F.explode(F.concat("hashes", F.array("run"))).alias("key"), "turn").distinct()
    # at equal turns the question comes first, so a message does not answer its own quotation
    counted = durable(clamped_totals(said.union(asked.withColumn("one", F.lit(0))), ["conv_id", "key"],
                                     [F.col("turn").asc(), F.col("one").asc()], {"speakers": "one"}))
    latest = counted.filter("one = 1").select("conv_id", "key", "speakers", F.col("turn").alias("speaker"))
    return counted.filter("one = 0 AND speakers > 0").join(latest, ["conv_id", "key", "speakers"]).select(
        "conv_id", "turn", "key", "speakers", "speaker")


def reply_links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to, n_linked`` of messages that quote an earlier one."""
    run = F.when(F.size("hashes") > 1, F.xxhash64("hashes")).otherwise(F.element_at("hashes", 1))
    passages = durable(messages.select("conv_id", "turn", F.inline("quoted")).withColumn("run", run))
    if passages.isEmpty():
        return messages.limit(0).select("conv_id", "turn", F.col("turn").alias("reply_to"), F.col("turn").alias("n_linked"))
    found = durable(_speakers(messages, passages))
    whole = passages.join(found.withColumnRenamed("key", "run"), ["conv_id", "turn", "run"], "left")
    runs = whole.filter("speaker IS NOT NULL").select(
        "conv_id", "turn", "level", "speaker", "speakers", F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("chars"),
        F.size("hashes").cast("long").alias("n"))
    single = whole.filter("speaker IS NULL").select(
        "conv_id", "turn", "level", F.inline(F.arrays_zip(F.col("hashes").alias("key"), F.col("chars").alias("chars"))))
    votes = runs.union(single.join(found, ["conv_id", "turn", "key"]).select(
        "conv_id", "turn", "level", "speaker", "speakers", "chars", F.lit(1).cast("long").alias("n")))
    votes = votes.groupBy("conv_id", "turn", "level", "speaker").agg(
        F.sum(F.when(F.col("speakers") == 1, F.col("chars")).otherwise(0)).alias("sure"),
        F.sum(F.expr("chars * 1000000 div speakers")).alias("share"), F.sum("n").alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("level"), "sure", "share", "speaker"))
    return votes.groupBy("conv_id", "turn").agg(best.alias("b"), F.sum("n").alias("n_linked")).select(
        "conv_id", "turn", F.col("b.speaker").alias("reply_to"), "n_linked")


def resolve(links: DataFrame) -> DataFrame:
    """``conv_id, turn, thread, depth``: where the reply chain of every linked message begins, and its length."""
    at = durable(links.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = at.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"), F.col("depth").alias("more"))
        at = durable(at.join(up, ["conv_id", "thread"], "left").select(
            "conv_id", "turn", F.coalesce("further", "thread").alias("thread"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")))
        if at.filter("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def reply_order(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, reply_to, thread, depth, position, n_quotes, n_linked, text`` for every message.

    ``text`` is the message without quotations. ``reply_to`` is the turn of the message that is
    quoted most at the lowest quotation level, by the characters of what no other earlier message said,
    then of all that points to it, each divided by how many said it (of equals the later one), null without a link;
    only earlier turns of the same conversation are linked. ``thread`` is the turn at the root of
    the reply chain and ``depth`` the distance from it. ``position`` counts the messages of a
    conversation from 1 by thread, depth and turn, so a reply follows what it replies to and a
    conversation without quotations keeps the order of its turns.

    A null text stays null and says nothing, an empty one is empty. Messages without conv_id or
    turn are never linked and come in a group of their own. Rows that repeat a turn share its
    links and follow each other in the order of role and text. Other columns are not read, an
    empty table gives an empty result.
    """
    messages = durable(arrow_map(
        conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"), _parsed,
        "conv_id long, turn long, role string, text string, said array<long>, "
        "quoted array<struct<level:long,hashes:array<long>,chars:array<long>>>, n_quotes long").withColumn("row", F.monotonically_increasing_id()))
    links = durable(reply_links(messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL")))
    known = links.join(resolve(links), ["conv_id", "turn"])
    rows = messages.join(known, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "text", "row")
    order = [F.col(c).asc() for c in ("thread", "depth", "turn", "role", "text", "row")]
    return rank_in_group(rows, ["conv_id"], order, "position").drop("row")
