"""The prefix trie of conversations, by smallest-member ownership.

A node is a distinct sequence of first turns; the conversations that start with it are
its members, and the smallest one owns it. Whoever owns a node owns all below it on its
own path, so a conversation's owned nodes are a suffix of its path: one number says where
it begins. Sums over a subtree are then sums over the members of its top: each member
brings the weights of its turns from there on and takes off those of the nodes that it
owns, so every node of the subtree is counted once for each member but one; the leaves
are counted by the members that own one. So one group-by of path rows by prefix gives
all of a node's figures, and no row of a trie is ever met with its subtree.

A prefix has two 64-bit numbers: over its turns, the exclusive or of hashes of depth and
turn, with seeds drawn for the run. Unlike a chain of hashes it can be summed by parts,
so a conversation of any length is dealt in pieces of PIECE turns, and prefix sums over
the pieces join them. A node that a third of all conversations share is a key that is
aggregated before it is shuffled; its owner reaches its children by a broadcast of the
nodes with the most children (at most HUBS of them, by their count), the others by a
join. The ids of the conversations that end at a node are joined into strings of
CHUNK ids by ranges of (node, id) and hashed in their order, so a node at which a third
of all conversations end has its bytes alone read in one place, as SHA-256 must.

Turns are ordered by their number (null first); turns of one number by the SHA-256 of
their contents. Null role or text is empty. Rows without a conversation id belong to no
conversation and are left out. Empty table: no nodes, not even the root. Repeated rows
are turns like any. Columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import textkit
from docloom.llm.ordering import placed
from docloom.llm.store import Workspace

#: Turns of a conversation that are worked on together, as a power of two.
PIECE = 12
#: Nodes whose owners are broadcast: those of the most children.
HUBS = 100_000
#: Ids that are joined into one string.
CHUNK = 8192
#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 200_000

KEY = ["depth", "k0", "k1"]


def ordered_turns(conversations: DataFrame, ws: Workspace, id_col: str, order_col: str, fields: tuple[str, ...], weight: Column) -> DataFrame:
    """(conv, pos, n, turn, weight): each conversation's turns by place from 0, as digests of their fields."""
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    said = F.concat(*[x for c in fields for x in (F.octet_length(value(c)).cast("string"), F.lit(":"), value(c))])
    rows = conversations.select(F.col(f"`{id_col}`").cast("long").alias("conv"), F.col(f"`{order_col}`").alias("at"), F.sha2(said, 256).alias("turn"), F.coalesce(weight, F.lit(0)).cast("long").alias("weight"))
    rows = ws.save(rows.filter("conv is not null"), "turns")
    return ws.save(placed(rows, "conv", [F.col("at").asc_nulls_first(), F.col("turn")], ws, "sorted").select("conv", "pos", "n", "turn", "weight"), "placed")


def _pieces(rows: DataFrame, of: DataFrame, length: Column, place: str) -> DataFrame:
    """``rows`` with the columns of their conversation: one row a piece of it meets them."""
    every = of.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(length, PIECE))))
    return rows.withColumn("piece", F.shiftright(place, PIECE)).join(every, ["conv", "piece"])


def with_shared_heads(turns: DataFrame, ws: Workspace, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, turn, weight) and (conv, length) of rebuilt conversations.

    Conversation ``conv`` takes the first ``head`` turns (``most`` at most) of conversation
    ``base``, both expressions over ``conv``, then its own turns after its first ``head``.
    """
    own = turns.groupBy("conv").agg(F.max("n").alias("n"))
    rebuilt = own.withColumns({"base": base.cast("long"), "h": head.cast("long")})
    lengths = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = rebuilt.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = ws.save(convs.select("conv", "base", "h", "n", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    heads = turns.filter(F.col("pos") < most).select(F.col("conv").alias("base"), "pos", "turn", "weight")
    shared = convs.join(heads, "base").filter("pos < h").select("conv", (F.col("pos") + 1).alias("depth"), "turn", "weight")
    rest = _pieces(turns.drop("n"), convs.select("conv", "h", "taken", "n"), F.col("n"), "pos").filter("pos >= h")
    rest = rest.select("conv", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "turn", "weight")
    return ws.save(shared.unionByName(rest), "rebuilt"), convs.select("conv", "length")


def _paths(turns: DataFrame, convs: DataFrame, ws: Workspace) -> DataFrame:
    """(conv, length, depth, k0, k1, weight, before) of every node on each path, the root included.

    ``before`` is the weight of the turns above; a node's weight is that of its last turn.
    """
    seeds = [F.lit(textkit.new_seed() >> 1), F.lit(textkit.new_seed() >> 1)]
    rows = turns.withColumn("piece", F.shiftright("depth", PIECE)).select("conv", "piece", "depth", "weight", *[F.xxhash64(s, "depth", "turn").alias(f"x{k}") for k, s in enumerate(seeds)])
    root = convs.select("conv", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("weight"), *[F.lit(0).cast("long").alias(f"x{k}") for k in (0, 1)])
    rows = rows.unionByName(root)
    whole = rows.groupBy("conv", "piece").agg(F.sum("weight").alias("weight"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1"))
    earlier = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = whole.select("conv", "piece", F.coalesce(F.sum("weight").over(earlier), zero).alias("w"), *[F.coalesce(F.bit_xor(f"x{k}").over(earlier), zero).alias(f"y{k}") for k in (0, 1)])
    starts = starts.join(convs, "conv")
    so_far = Window.partitionBy("conv", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("conv", "piece", "depth", "weight", F.sum("weight").over(so_far).alias("s"), *[F.bit_xor(f"x{k}").over(so_far).alias(f"z{k}") for k in (0, 1)])
    met = inside.join(starts, ["conv", "piece"])
    return ws.save(met.select("conv", "length", "depth", *[F.col(f"y{k}").bitwiseXOR(F.col(f"z{k}")).alias(f"k{k}") for k in (0, 1)], "weight", (F.col("w") + F.col("s") - F.col("weight")).alias("before")), "paths")


def _joined_ids(ends: DataFrame) -> DataFrame:
    """(depth, k0, k1, ends_sha256) of the nodes at which conversations end; ``ends``: one row (depth, k0, k1, conv) each."""
    schema = "depth long, k0 long, k1 long, first long, ids string"

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        keys = list(zip(*[batch.column(c).to_pylist() for c in KEY]))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start], batch.slice(start, i - start)
                start = i

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, run in runs(batch):
                for at in range(0, run.num_rows, CHUNK):
                    ids = run.column("conv").slice(at, CHUNK).to_pylist()
                    rows.append((*key, ids[0], ",".join(map(str, ids))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["depth", "k0", "k1", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for key, run in runs(batch):
                if key != last:
                    if state is not None:
                        done.append((*last, state.hexdigest()))
                    last, state = key, hashlib.sha256()
                    glue = b""
                for ids in run.column("ids").to_pylist():
                    state.update(glue + ids.encode())
                    glue = b","
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=[*KEY, "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, state.hexdigest())], names=[*KEY, "ends_sha256"])

    order = [*KEY, "conv"]
    strings = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, schema)
    return strings.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "depth long, k0 long, k1 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, ws: Workspace, hubs: int = HUBS) -> tuple[DataFrame, DataFrame]:
    """The nodes of (conv, depth, turn, weight), and each conversation's owned suffix.

    ``convs`` is (conv, length) of every conversation, turnless ones too. Nodes are (depth, k0,
    k1, conv, parent_conv, n_convs, n_children, n_leaves, saved, ends_sha256); ``saved`` sums
    (n_convs - 1) * weight over the subtree. The suffixes are (conv, length, owned_from, leaf,
    shared): the first depth that it owns (length + 1 for none), whether it owns a leaf, and the
    weight of its turns above, which other conversations own.
    """
    paths = _paths(turns, convs, ws)
    owners = paths.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.max("length").alias("longest"))
    owned = owners.groupBy("conv").agg(F.min("depth").alias("owned_from"), F.max(F.col("longest") == F.col("depth")).alias("leaf"))
    suffix = convs.join(owned, "conv", "left").select(
        "conv", "length", F.coalesce("owned_from", F.col("length") + 1).alias("owned_from"), F.coalesce("leaf", F.lit(False)).alias("leaf")
    )
    shared = paths.join(F.broadcast(suffix.select("conv", "owned_from")), "conv") if suffix.count() <= BROADCAST_ROWS else _pieces(paths, suffix.select("conv", "owned_from", F.col("length").alias("_l")), F.col("_l"), "depth")
    shared = shared.groupBy("conv").agg(F.sum(F.when(F.col("depth") < F.col("owned_from"), F.col("weight")).otherwise(0)).alias("shared"))
    suffix = ws.save(suffix.join(shared, "conv"), "suffix")

    few = suffix.count() <= BROADCAST_ROWS
    marked = paths.join(F.broadcast(suffix.drop("length")), "conv") if few else _pieces(paths, suffix.withColumnRenamed("length", "_l"), F.col("_l"), "depth")
    above = F.when(F.col("depth") < F.col("owned_from"), F.col("shared") - F.col("before")).otherwise(0)
    child = (F.col("owned_from") <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))
    nodes = marked.groupBy(*KEY).agg(
        F.min("conv").alias("conv"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(child.cast("long")).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum(above).alias("saved"),
    )
    nodes = ws.save(nodes, "nodes")

    # The node above each one, as its owner's path has it: one step up the first node that a conversation owns.
    step = Window.partitionBy("conv").orderBy("depth")
    tops = marked.filter(F.col("depth").between(F.col("owned_from") - 1, F.col("owned_from")))
    tops = tops.select("conv", *KEY, "owned_from", *[F.lag(c).over(step).alias(f"up_{c}") for c in ("k0", "k1")]).filter("depth = owned_from and depth > 0")
    tops = ws.save(tops.select("conv", (F.col("depth") - 1).alias("depth"), F.col("up_k0").alias("k0"), F.col("up_k1").alias("k1")), "tops")
    parents = nodes.select(*KEY, F.col("conv").alias("parent_conv"), "n_children").filter("n_children > 0")
    least = max(1, -(-nodes.count() // hubs))  # a node has one parent, so at most hubs of them have as many children
    hub = parents.filter(F.col("n_children") >= least).drop("n_children")
    near = tops.join(F.broadcast(hub), KEY, "left")
    far = near.filter("parent_conv is null").drop("parent_conv").join(parents.filter(F.col("n_children") < least).drop("n_children"), KEY)
    owner_above = ws.save(near.filter("parent_conv is not null").unionByName(far).select("conv", (F.col("depth") + 1).alias("owned_from"), "parent_conv"), "owner-above")

    ended = _joined_ids(paths.filter("depth = length").select(*KEY, "conv"))
    out = nodes.join(owner_above.withColumnRenamed("owned_from", "depth"), ["conv", "depth"], "left").join(ended, KEY, "left")
    # Below its first owned node, a conversation owns the node above as well.
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv", "conv"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(*KEY, "conv", parent.alias("parent_conv"), "n_convs", "n_children", "n_leaves", "saved", F.coalesce("ends_sha256", none).alias("ends_sha256")), suffix


def conversation_trie(
    conversations: DataFrame,
    id_col: str = "conv_id",
    order_col: str = "turn",
    fields: tuple[str, ...] = ("role", "text"),
    weight_col: str = "text",
    heads: tuple[Column, Column, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes and owned suffixes (``prefix_trie``) of a table of turns; weights are the code points of ``weight_col``.

    ``heads`` (base, head, most) rebuilds the conversations first (``with_shared_heads``).
    """
    ws = Workspace(conversations.sparkSession, "trie")
    turns = ordered_turns(conversations, ws, id_col, order_col, fields, F.char_length(F.col(f"`{weight_col}`")))
    if heads:
        turns, convs = with_shared_heads(turns, ws, *heads)
    else:
        convs = turns.groupBy("conv").agg(F.max("n").alias("length"))
        turns = turns.select("conv", (F.col("pos") + 1).alias("depth"), "turn", "weight")
    return prefix_trie(turns, convs, ws)
