"""Conversation prefix trie: every distinct sequence of first turns is a node, with what its subtree would save if stored once.

A prefix is known by its digest: the sums of four 31-bit hashes of its turns, each taken with the turn's place, so digests of
all prefixes come from running sums, which blocks of a long conversation share out. Two prefixes with one digest of 124 bits are
taken as equal.

Digests are first screened by a count-min sketch: two rows of cells, counted by aggregates that combine before their
shuffle, of which only the bits "two or more" go to the tasks. The sketch never counts too few, so an estimate of one
proves that a prefix belongs to one conversation alone: such tails are finished where they are, as all about them follows from
their own conversation. Only prefixes that may be shared are grouped, exactly, so a wrong estimate costs time alone.

Of a subtree's sums, each node counts once, with its least member; what lies below a node is the suffix of
its members' own counts. Suffixes are running sums in blocks again, and the sums of a node's members combine before their
shuffle. Hashes of members are taken over chunks of a bounded number of ids that pass a task in order.

The sketch has four cells for each prefix and row, ``MOST_CELLS`` at most: beyond some 30 million prefixes it screens fewer
and the exact grouping takes more, with the same result.

Defined cases: rows without a conversation's id are left out; null roles and texts are empty; null turns come first; rows of
one turn follow by the first 64 characters of role and text and then by their hash; repeated rows are turns of their own; an
empty table has no trie, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, placed

#: Turns of a block: what a task holds of one conversation.
BLOCK = 1024
#: Ids in a chunk of a node's members.
CHUNK = 4096
#: Cells of a row of the sketch at most; the tasks have a bit of each, 32 MB for both rows.
MOST_CELLS = 1 << 27
_MASK = (1 << 31) - 1
EMPTY = hashlib.sha256(b"").hexdigest()


def ordered(conversations: DataFrame) -> DataFrame:
    """conversations -> (conv_id, pos, turns, role_text, bytes): the turns of each conversation in order, ``pos`` from 1, with
    the hash of role and text and the bytes of the text; ``turns`` is how many the conversation has."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"), F.left(role, F.lit(64)).alias("r"), F.left(text, F.lit(64)).alias("t"),
        whole.alias("role_text"), F.octet_length(text).cast("long").alias("bytes"),
    )
    found = placed(rows, ["conv_id"], ["turn", "r", "t", "role_text"])
    return found.select("conv_id", (F.col("place") + 1).alias("pos"), F.col("members").alias("turns"), "role_text", "bytes")


def _shared_turns(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % 9


def rebuilt(turns: DataFrame, family: int = 5) -> tuple[DataFrame, DataFrame]:
    """``ordered`` -> (conversations with their lengths, turns with that length), rebuilt: the first h turns of conversation c - c % family, then
    c's own after its first h, where h is the checksum of c's number modulo 9."""
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(family))
    lengths = turns.groupBy("conv_id").agg(F.first("turns").alias("turns"))
    first = lengths.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    h, own = F.col("h"), F.greatest(F.col("turns") - F.col("h"), F.lit(0))
    plan = lengths.withColumn("base", base).withColumn("h", _shared_turns(F.col("conv_id"))).join(first, "base", "left")
    plan = plan.withColumn("taken", F.least(h, F.coalesce("base_turns", F.lit(0)))).select("conv_id", "base", "h", "taken", (F.col("taken") + own).alias("length"))
    plan = materialise(plan)
    mine = turns.join(plan.select("conv_id", "h", "taken", "length"), "conv_id").where("pos > h")
    mine = mine.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "length", "role_text", "bytes")
    theirs = turns.where("pos <= 8").where(F.pmod("conv_id", F.lit(family)) == 0).withColumnRenamed("conv_id", "base")  # h is 8 at most
    given = plan.select("conv_id", "base", "h", "length").join(theirs, "base").where("pos <= h").select("conv_id", "pos", "length", "role_text", "bytes")
    return plan.select("conv_id", "length"), mine.unionByName(given)


def _running(rows: DataFrame, values: list[str], own: bool) -> DataFrame:
    """Each of ``values`` summed over a conversation's rows up to each ``pos`` (with ``own``, else before it), block by block."""
    cut = rows.withColumn("__block", F.floor((F.col("pos") - 1) / BLOCK))
    totals = cut.groupBy("conv_id", "__block").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy("conv_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("conv_id", "__block", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__{v}") for v in values])
    inside = Window.partitionBy("conv_id", "__block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    sums = [(F.col(f"__{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"{v}_sum") for v in values]
    return cut.join(starts, ["conv_id", "__block"]).select(*rows.columns, *sums)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, length, bytes, k1, k2, p1, p2): the digest of each prefix, and that of the one before."""
    hashes = [F.xxhash64(F.lit(i), "pos", "role_text") for i in (1, 2)]
    words = {"a": hashes[0].bitwiseAND(F.lit(_MASK)), "b": F.shiftrightunsigned(hashes[0], 33), "c": hashes[1].bitwiseAND(F.lit(_MASK)), "d": F.shiftrightunsigned(hashes[1], 33)}
    rows = _running(turns.select("conv_id", "pos", "length", "bytes", *[w.alias(k) for k, w in words.items()]), list(words), own=True)

    def packed(x: Column, y: Column) -> Column:
        return F.shiftleft(x.bitwiseAND(F.lit(_MASK)), 31).bitwiseOR(y.bitwiseAND(F.lit(_MASK)))

    now = {k: F.col(f"{k}_sum") for k in words}
    last = {k: F.col(f"{k}_sum") - F.col(k) for k in words}
    return rows.select(
        "conv_id", "pos", "length", "bytes", packed(now["a"], now["b"]).alias("k1"), packed(now["c"], now["d"]).alias("k2"),
        packed(last["a"], last["b"]).alias("p1"), packed(last["c"], last["d"]).alias("p2"),
    )


def screened(rows: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """``prefixes`` with ``shared`` and ``parent_shared``: whether the sketch's estimate of the digest is above one."""
    n = rows.count()
    width = 1024
    while width < min(4 * n, most_cells):
        width *= 2
    at = [F.col("k1").bitwiseAND(F.lit(width - 1)) + 1, F.col("k2").bitwiseAND(F.lit(width - 1)) + (width + 1)]
    counted = rows.select(F.explode(F.array(*at)).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    bits = counted.groupBy(F.bitmap_bucket_number("cell").alias("run")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    sketch = np.zeros(2 * width // 8 + 4096, np.uint8)
    for run, found in bits.collect():  # a bit of each cell, bounded by MOST_CELLS
        sketch[(run - 1) * 4096 : run * 4096] = np.frombuffer(found, np.uint8)
    held = rows.sparkSession.sparkContext.broadcast(sketch)

    @F.pandas_udf("boolean")
    def crowded(a: pd.Series, b: pd.Series) -> pd.Series:
        i, j = a.to_numpy() & (width - 1), (b.to_numpy() & (width - 1)) + width
        bit = lambda x: held.value[x >> 3] >> (x & 7).astype(np.uint8) & 1
        return pd.Series((bit(i) & bit(j)).astype(bool))

    return materialise(rows.withColumns({"shared": crowded("k1", "k2"), "parent_shared": crowded("p1", "p2")}))


def _member_hashes(ends: DataFrame) -> DataFrame:
    """(k1, k2, conv_id) -> (k1, k2, ends_sha256): the members' numbers in order, joined by commas and hashed."""
    chunk = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")  # CHUNK ids at most
    chunks = ends.groupBy("k1", "k2", F.floor(F.col("conv_id") / CHUNK).alias("run")).agg(chunk.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()

        def out(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"k1": [d[0][0] for d in done], "k2": [d[0][1] for d in done], "ends_sha256": [d[1] for d in done]}, pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())]))

        for batch in batches:
            done = []
            for a, b, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == (a, b):
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield out(done)
        if key is not None:
            yield out([(key, state.hexdigest())])

    ready = chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "run").select("k1", "k2", "ids")
    return ready.mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame, turns: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """(conv_id, length) of all conversations and (conv_id, pos, length, role_text, bytes) of their turns -> the nodes: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = screened(materialise(prefixes(turns)), most_cells)
    own = F.sha2(F.col("conv_id").cast("string"), 256)
    tails, maybe = rows.where("not shared"), rows.where("shared")
    grouped = maybe.groupBy("k1", "k2").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("rep"), F.max("length").alias("longest"),
        F.first("pos").alias("depth"), F.first("bytes").alias("bytes"), F.first("p1").alias("p1"), F.first("p2").alias("p2"),
    )
    nodes = materialise(grouped)

    # each node counts with its least member, a tail with its last turn; a member has below a node what is left of its own counts
    counts = nodes.select(F.col("rep").alias("conv_id"), F.col("depth").alias("pos"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (F.col("longest") == F.col("depth")).cast("long").alias("leaves"))
    last = tails.where("pos = length").select("conv_id", "pos", F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaves"))
    totals = counts.unionByName(last).groupBy("conv_id").agg(F.sum("saved").alias("all_saved"), F.sum("leaves").alias("all_leaves"))
    both = maybe.select("conv_id", "pos", "k1", "k2").join(counts, ["conv_id", "pos"], "left").fillna(0, ["saved", "leaves"])
    # the sums before a turn, taken from those of the whole conversation, leave the ones from it on
    passed = _running(both, ["saved", "leaves"], own=False).join(totals, "conv_id", "left")
    below = passed.groupBy("k1", "k2").agg(
        F.sum(F.coalesce("all_saved", F.lit(0)) - F.col("saved_sum")).alias("saved_tokens"), F.sum(F.coalesce("all_leaves", F.lit(0)) - F.col("leaves_sum")).alias("n_leaves")
    )

    children = nodes.where("depth > 1").select("p1", "p2").unionByName(tails.where("parent_shared and pos > 1").select("p1", "p2"))
    families = children.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    ends = _member_hashes(maybe.where("pos = length").select("k1", "k2", "conv_id"))
    # written once: it is read as the first turns' nodes and as the others
    full = nodes.join(below, ["k1", "k2"]).join(families, ["k1", "k2"], "left").join(ends, ["k1", "k2"], "left").select(
        F.col("rep").alias("conv_id"), "depth", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "p1", "p2"
    )
    full = materialise(full)

    least = conversations.agg(F.min("conv_id").alias("root_conv"), F.count("*").alias("n_convs")).where("n_convs > 0")
    edge = tails.where("pos > 1 and parent_shared")
    single = lambda df: df.select(
        "conv_id", F.col("pos").alias("depth"), F.lit(1).cast("long").alias("n_convs"), (F.col("pos") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("pos") == F.col("length"), own).otherwise(EMPTY).alias("ends_sha256"), "p1", "p2",
    )
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("rep").alias("parent_rep"))
    inner = full.where("depth > 1").unionByName(single(edge)).join(parents, ["p1", "p2"], "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_rep", "conv_id"))
    # what only its own conversation shares has its parent there
    local = single(tails.where("pos > 1 and not parent_shared")).withColumn("parent_conv_id", F.col("conv_id"))
    tops = full.where("depth = 1").unionByName(single(tails.where("pos = 1"))).crossJoin(F.broadcast(least.select(F.col("root_conv").alias("parent_conv_id"))))  # one row

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    turnless = _member_hashes(conversations.where("length = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")).select("ends_sha256")
    weights = nodes.select("depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (F.col("longest") == F.col("depth")).cast("long").alias("leaves"))
    weights = weights.unionByName(tails.select(F.col("pos").alias("depth"), F.lit(0).cast("long").alias("saved"), (F.col("pos") == F.col("length")).cast("long").alias("leaves")))
    sums = weights.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    top = least.crossJoin(F.broadcast(sums)).join(turnless, F.lit(True), "left").select(  # one row each
        F.col("root_conv").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    return top.unionByName(tops.select(*columns)).unionByName(inner.select(*columns)).unionByName(local.select(*columns))


def stored_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """What a store that keeps each prefix once holds: a node's last turn, by its least member."""
    return nodes.where("depth > 0").join(turns.withColumnRenamed("pos", "depth"), ["conv_id", "depth"])


def conversation_trie(conversations: DataFrame, family: int = 5, most_cells: int = MOST_CELLS) -> DataFrame:
    """The trie of the rebuilt conversations."""
    plan, turns = rebuilt(ordered(conversations), family)
    return trie(plan, turns, most_cells)
