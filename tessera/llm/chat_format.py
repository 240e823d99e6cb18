"""Chat formatting by quotation linking.

A message's lines have quote levels (the ``>`` in front of them) and a run of
lines of one level is a quoted passage, cut at blank quoted lines. Passages are normalised (lower case, one
blank for white space, no quote marks) and hashed; so is every paragraph and the
whole of what a message says itself. A passage is linked to the message of the
same conversation that said it first, if that came earlier: an aggregation finds
the first speaker of each hash, so a phrase that thousands of messages share is
one row of the join. A passage that nobody said as a whole, a paragraph or a line is
looked for inside what messages say, by the words it starts with, and linked to
the first that holds all its words in a row. The message whose passages of the outermost level have the
most characters is the one replied to. Chains of replies are followed by
doubling, which gives each message the root of its thread and its depth; ordered
by (conversation, thread, turn), every reply follows what it answers.

Defined results: a null or empty text is an empty message without quotes; quotes
that no earlier message said are cut as well but link nothing; rows with the same
conversation and turn are separate messages with the same place; a message with
a null conversation or turn links to nothing and is its own thread. A line that
introduces a quote (ends with "wrote:" or the like, before a quoted line) goes
with it; repeated rows are repeated messages; extra columns are left out; a table
without rows gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as c

MARKS = re.compile(r"^[ \t]?((?:>[ \t]?)+)(.*)$", re.S)
INTRODUCES = re.compile(r"(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$", re.I)
PASSAGE = pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("size", pa.int32()), ("words", pa.string())])
#: Passages are looked up by so many of their first words at most.
HEAD = 64


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def parsed(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """What a message says itself, and its quoted passages with their levels."""
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    quoted = blank = False
    for line in re.split(r"\r\n|\r|\n", text or ""):
        found = MARKS.match(line)
        if not found:
            own.append(line)
            quoted = False
            continue
        level = found[1].count(">")
        if not quoted:
            while own and not own[-1].strip():
                own.pop()
            if own and INTRODUCES.search(own[-1]):
                own.pop()
        if not found[2].strip():
            blank = True
        elif quotes and quoted and not blank and quotes[-1][0] == level:
            quotes[-1][1].append(found[2])
        else:
            quotes.append((level, [found[2]]))
            blank = False
        quoted = True
    passages = [(level, normalised("\n".join(lines))) for level, lines in quotes]
    said = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip() if quotes else (text or "")
    return said, [p for p in passages if p[1]]


def said_hashes(said: str) -> list[int]:
    """The hashes under which a message can be quoted: whole, by paragraph, by line."""
    parts = [said, *re.split(r"\n\s*\n", said), *said.split("\n")]
    return list(dict.fromkeys(digest(n) for n in map(normalised, parts) if n))


def messages(chats: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Per row: conv, turn, role, said (the text without quotes), passages (level, hash, size), hashes of what it says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, _ in c.blocks(batch, "text"):
                said, passages, hashes = [], [], []
                for t in block.column("text").to_pylist():
                    own, quotes = parsed(t)
                    said.append(own)
                    passages.append([{"level": level, "hash": digest(q), "size": len(q), "words": q} for level, q in quotes])
                    hashes.append(said_hashes(own))
                yield pa.RecordBatch.from_arrays(
                    [*(block.column(x) for x in ("conv", "turn", "role")), pa.array(said), pa.array(passages, pa.list_(PASSAGE)), pa.array(hashes, pa.list_(pa.int64()))], ["conv", "turn", "role", "said", "passages", "hashes"]
                )

    rows = chats.select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).alias("text"))
    schema = "conv bigint, turn bigint, role string, said string, passages array<struct<level:int,hash:bigint,size:int,words:string>>, hashes array<bigint>"
    return c.batched(rows, run, schema)


def replies(found: DataFrame) -> DataFrame:
    """Per message with a linked quote: conv, turn, reply_to, linked (passages that were found)."""
    quotes = found.where("conv IS NOT NULL AND turn IS NOT NULL").select("conv", "turn", F.inline("passages"))
    wanted = quotes.select("conv", "hash").distinct()
    spoken = found.where("conv IS NOT NULL AND turn IS NOT NULL").select("conv", "turn", F.explode("hashes").alias("hash"))
    first = spoken.join(wanted, ["conv", "hash"], "left_semi").groupBy("conv", "hash").agg(F.min("turn").alias("source"))
    linked = quotes.join(first, ["conv", "hash"]).where("source < turn").drop("words")
    rest = c.stored(quotes.join(first, ["conv", "hash"], "left").where("source IS NULL OR source >= turn").drop("source"), "unlinked")
    linked = linked.unionByName(rest.join(held_by(found, rest), ["conv", "hash"]).where("source < turn").drop("words"))
    outer = linked.groupBy("conv", "turn", "source").agg(F.min("level").alias("level"), F.sum("size").alias("size"), F.count("*").alias("n"))
    best = outer.groupBy("conv", "turn").agg(F.max(F.struct(-F.col("level"), "size", "source")).alias("best"), F.sum("n").alias("linked"))
    return best.select("conv", "turn", F.col("best.source").alias("reply_to"), "linked")


def head_size(n: int) -> int:
    """By how many of its first words a passage of n words is looked up: a power of two, so that there are few sizes."""
    return min(HEAD, 1 << (n.bit_length() - 1))


def held_by(found: DataFrame, quotes: DataFrame) -> DataFrame:
    """Per passage (conv, hash): the first message (source) that holds its words in a row."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [q.split() for q in batch.column("words").to_pylist()]
            sizes = [head_size(len(w)) for w in parts]
            keys = [digest(" ".join(w[:n])) for w, n in zip(parts, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("conv", "hash", "words")), pa.array(sizes, pa.int32()), pa.array(keys, pa.int64())], ["conv", "hash", "words", "size", "head"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [normalised(t) for t in batch.column("said").to_pylist()]
            keys = []
            for text, sizes in zip(plain, batch.column("sizes").to_pylist(), strict=True):
                w = text.split()
                keys.append(list({digest(" ".join(w[k : k + n])) for n in sizes for k in range(len(w) - n + 1)}))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("turn"), pa.array(plain, pa.string()), pa.array(keys, pa.list_(pa.int64()))], ["conv", "turn", "plain", "heads"])

    wanted = c.stored(c.batched(quotes.select("conv", "hash", "words").distinct(), heads, "conv bigint, hash bigint, words string, size int, head bigint"), "passages")
    sizes = wanted.groupBy("conv").agg(F.collect_set("size").alias("sizes"))
    # messages that say the same are one; conversations without such a passage are left out
    said = found.where("turn IS NOT NULL").select("conv", "turn", "said").join(sizes, "conv").groupBy("conv", "said").agg(F.min("turn").alias("turn"), F.any_value("sizes").alias("sizes"))
    sources = c.stored(c.batched(said, windows, "conv bigint, turn bigint, plain string, heads array<bigint>"), "windows")
    pairs = sources.select("conv", "turn", F.explode("heads").alias("head")).join(wanted, ["conv", "head"]).join(sources.select("conv", "turn", "plain"), ["conv", "turn"])
    padded = lambda x: F.concat(F.lit(" "), F.col(x), F.lit(" "))
    return pairs.where(F.contains(padded("plain"), padded("words"))).groupBy("conv", "hash").agg(F.min("turn").alias("source"))


def threads(links: DataFrame) -> DataFrame:
    """Per linked message: conv, turn, thread (the turn of its chain's root), depth; by doubling."""
    now = c.stored(links.select("conv", "turn", F.col("reply_to").alias("up"), F.lit(1).alias("depth")), "replies")
    while True:
        above = now.select("conv", F.col("turn").alias("up"), F.col("up").alias("higher"), F.col("depth").alias("more"))
        step = now.join(above, ["conv", "up"], "left")
        step = c.stored(step.select("conv", "turn", F.coalesce("higher", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")), "replies")
        if step.where("moved").isEmpty():
            return step.select("conv", "turn", F.col("up").alias("thread"), "depth")
        now = step.drop("moved")


def formatted(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each message: conv, turn, role, reply_to, thread, depth, n_quotes, n_linked, text without quotes, formatted.

    The rows are in the order of conversations, in each in the order of its threads, in these in the order of turns, so that a
    reply follows what it answers: a range-partitioned sort, which cuts a conversation of any length into parts.
    """
    found = c.stored(messages(chats, conv, turn, role, text), "messages")
    links = c.stored(replies(found), "links")
    placed = links.join(threads(links), ["conv", "turn"])
    out = found.join(placed, ["conv", "turn"], "left").select(
        F.col("conv").alias(conv),
        F.col("turn").alias(turn),
        F.col("role").alias(role),
        "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.size("passages").alias("n_quotes"),
        F.coalesce("linked", F.lit(0)).cast("int").alias("n_linked"),
        F.col("said").alias(text),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "said", F.lit("\n<|end|>\n")).alias("formatted"),
    )
    return out.sort(conv, "thread", turn)
