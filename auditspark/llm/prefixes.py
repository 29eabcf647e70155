"""Operator 12: prefix trie of conversations, with subtree totals by leaf-peeling message passing.

Conversations are rebuilt (`rebuilt`), then each walks down the trie: a node is a sequence of turns, named by
a chained hash, so equal sequences get one name without meeting.  Nodes are grouped from these walks with
map-side sums; the root, which all share, is no hot task.

Totals go up by messages.  A node holds a counter of children that have not reported; a node
whose counter is zero is complete and sends its leaves and saved tokens to its parent, until only the
root finishes.  Nodes with one child would take a round each, so chains of them are first contracted to one
edge by pointer doubling (rounds: the logarithm of the longest chain); peeling then takes as many
rounds as branchings lie above each other.  Every round leaves a reliable checkpoint.

Turns of a null conv_id are in no conversation.  Turns are ordered by turn (null first), ties by role and text;
null role and text are empty; repeated rows are turns of their own.  c - c % 100 takes the remainder's sign from
c.  Without any conversation there is no node.  A conversation is walked by one task as a stream: it
is never held in memory, but its turns are sequential.  The hash of a node's members streams too: ids are joined
to texts in sorted ranges, so that one task reads few rows of a hot node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, joined_back, read

FAMILY, HEADS = 100, 6
#: Ids of a member list that are joined to one text.
CHUNK = 4096
ROOT = b"root".ljust(16, b"\0")


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn (a hash of role and text) and chars (of the text) of every turn, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("bigint")
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text")
    return rows.withColumn("pos", order).select("conv_id", "pos", F.unhex(F.substring(F.sha2(said.cast("binary"), 256), 1, 32)).alias("turn"), F.length("text").cast("bigint").alias("chars"))


def heads(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, pos, turn, chars: of the result of numbered(), every conversation's turns rebuilt - the first h
    of its family's first conversation, then its own behind h - and a row with pos 0 for itself.  pos orders."""
    own = turns.where(F.col("pos") > heads(F.col("conv_id")))
    each = turns.where("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), heads(F.col("conv_id")).alias("h"))
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "base")
    taken = each.join(first, "base").where("pos <= h").select("conv_id", "pos", "turn", "chars")
    none = each.select("conv_id", F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("bigint").alias("chars"))
    return own.unionByName(taken).unionByName(none)


def walks(turns: DataFrame) -> DataFrame:
    """node, parent, depth, chars, conv_id, ends: a row for each node that a rebuilt conversation starts with;
    ends marks the whole conversation."""
    names = ["node", "parent", "depth", "chars", "conv_id", "ends"]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, until it is known whether its conversation goes on
        for b in batches:
            out: list[tuple] = []
            for conv, turn, chars in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if held is not None:
                    out.append((*held, turn is None))
                if turn is None:
                    held = (ROOT, None, 0, 0, conv)
                else:
                    held = (hashlib.sha256(held[0] + turn).digest()[:16], held[0], held[2] + 1, chars, conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*held, True), kinds, strict=True)], names)

    ordered = turns.select("conv_id", "pos", "turn", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return ordered.mapInArrow(run, "node binary, parent binary, depth bigint, chars bigint, conv_id bigint, ends boolean")


def member_hashes(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 of the members (conv_id) that end at each node."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for b in batches:
            out = []
            for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (n != node or len(ids) == CHUNK):
                    out.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = n
                ids.append(c)
            yield batch(out)
        if ids:
            yield batch([(node, ids[0], ",".join(map(str, ids)))])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.string()), strict=True)], ["node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for b in batches:
            nodes, hashes = [], []
            for n, ids in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if n == node:
                    state.update(b",")
                else:
                    if node is not None:
                        nodes.append(node)
                        hashes.append(state.hexdigest())
                    node, state = n, hashlib.sha256()
                state.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hashes, pa.string())], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])

    chunks = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(joined, "node binary, first bigint, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, ends_sha256 string")


def tree(members: DataFrame) -> DataFrame:
    """A row a node of the walks: node, parent, depth, conv_id, n_convs, own (its saved tokens), n_children,
    child (some child), parent_conv_id, siblings (children of its parent; null for the root)."""
    nodes = members.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("chars").alias("chars"))
    nodes = cut_lineage(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("chars")).drop("chars"))
    kids = nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("child"))
    kids = cut_lineage(kids.join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent"))
    below = joined_back(nodes.where("parent is not null"), kids.select("parent", "n", "parent_conv_id", F.col("n").alias("siblings")), "parent", "n")
    top = nodes.where("parent is null").withColumns({"parent_conv_id": F.lit(None).cast("bigint"), "siblings": F.lit(None).cast("bigint")})
    own = kids.select(F.col("parent").alias("node"), F.col("n").alias("n_children"), "child")
    rows = below.unionByName(top).join(own, "node", "left")
    return cut_lineage(rows.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint")))


def contracted(nodes: DataFrame) -> DataFrame:
    """node, parent, siblings, depth, below, gain of the nodes with one child: below is the first node under it
    that has none or several, gain what the node and those between save."""
    one = nodes.where("n_children = 1").select("node", "parent", "siblings", "depth", F.col("child").alias("below"), F.col("own").alias("gain"))
    ends = nodes.where("n_children <> 1").select(F.col("node").alias("below"), F.lit(True).alias("settled"))
    links = cut_lineage(one.join(ends, "below", "left").withColumn("settled", F.coalesce("settled", F.lit(False))))
    while not links.where("not settled").isEmpty():
        # the nodes that unsettled ones point to differ from each other, so no key is hot
        ahead = links.select(F.col("node").alias("below"), F.col("below").alias("next"), F.col("gain").alias("more"), F.col("settled").alias("done"))
        moved = links.where("not settled").join(ahead, "below").select("node", "parent", "siblings", "depth", F.col("next").alias("below"), (F.col("gain") + F.col("more")).alias("gain"), F.col("done").alias("settled"))
        links = cut_lineage(links.where("settled").unionByName(moved))
    return links.drop("settled")


def peeled(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """node, chain (nodes contracted above it), n_leaves, saved_tokens of the nodes with none or several children."""
    # the top of a chain names the node that the chain's end reports to, and all that the chain saves
    tops = chains.where("siblings is null or siblings <> 1").select(F.col("below").alias("node"), F.col("parent").alias("over"), F.col("depth").alias("from"), F.col("gain"))
    waiting = nodes.where("n_children <> 1").join(tops, "node", "left").select(
        "node", F.when(F.col("from").isNull(), F.col("parent")).otherwise(F.col("over")).alias("up"), F.coalesce("gain", F.lit(0)).cast("bigint").alias("edge"),
        F.coalesce(F.col("depth") - F.col("from"), F.lit(0)).cast("bigint").alias("chain"), F.col("n_children").alias("open"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("n_leaves"), F.col("own").alias("saved_tokens"),
    )
    waiting = cut_lineage(waiting)
    done = []
    while not waiting.isEmpty():
        complete = waiting.where("open = 0")
        done.append(complete.select("node", "chain", "n_leaves", "saved_tokens"))
        sent = complete.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("said"), F.sum("n_leaves").alias("l"), F.sum(F.col("saved_tokens") + F.col("edge")).alias("s"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
        waiting = cut_lineage(
            waiting.where("open > 0").join(sent, "node", "left").select(
                "node", "up", "edge", "chain", (F.col("open") - zero(F.col("said"))).alias("open"), (F.col("n_leaves") + zero(F.col("l"))).alias("n_leaves"), (F.col("saved_tokens") + zero(F.col("s"))).alias("saved_tokens"),
            )
        )
    out = done[0] if done else waiting.select("node", "chain", "n_leaves", "saved_tokens")
    for d in done[1:]:
        out = out.unionByName(d)
    return cut_lineage(out)


def totals(nodes: DataFrame) -> DataFrame:
    """node, n_leaves, saved_tokens of every node's subtree."""
    chains = contracted(nodes)
    ends = peeled(nodes, chains)
    said = ends.select(F.col("node").alias("below"), "chain", "n_leaves", "saved_tokens")
    inner = joined_back(chains.select("node", "below", "gain"), said, "below", "chain")
    return ends.drop("chain").unionByName(inner.select("node", "n_leaves", (F.col("saved_tokens") + F.col("gain")).alias("saved_tokens")))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns = cut_lineage(numbered(read(spark, sf_dir, "conversations")))
    members = cut_lineage(walks(rebuilt(turns)))
    nodes = tree(members)
    ends = member_hashes(members.where("ends"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    rows = nodes.join(totals(nodes), "node").join(ends, "node", "left")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
