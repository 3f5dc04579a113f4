"""The trie of conversations' beginnings, and what sharing them saves.

Turns leave the scan as hashes. A node is a depth with the XOR of the hashes of its first turns, each hashed with its place,
so a conversation's nodes are running XORs, worked out block by block; copies of a conversation are one path. Nodes where
nothing branches or ends (chains) are left out of the paths, which bounds a path's length by the square root of twice
the number of turns. The paths are sorted into shards of neighbours; a shard holds its part of the trie as balanced
parentheses with the minimum excess of each block in a tree. Where a node's subtree ends, findclose tells; the pairs ``()`` before both
ends give its leaves, running sums its savings. Nodes that several shards share (their spines) are added up.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Turns of a conversation that are numbered in one window.
BLOCK = 1024
#: Nodes of a shard's paths, on average.
SHARD_NODES = 200_000
#: Ids in one piece of a node's list of ended conversations.
ID_BLOCK = 4096
#: Bits of parentheses under one minimum.
EXCESS_BLOCK = 64
HEAD = 8


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, h, g, size): turns in order (null turns first, ties by their hashes), numbered from 1.

    A conversation's turns are ranked in blocks of ``turn`` and, within a turn number, of hashes, so that
    no window holds a long conversation; equal rows are counted first and given back one by one.
    """
    size = F.octet_length(F.coalesce("text", F.lit("")))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.xxhash64(role, text).alias("h"), F.xxhash64(text, role, F.lit(1)).alias("g"), size.alias("size"))
    rows = rows.groupBy("conv_id", "turn", "h", "g", "size").agg(F.count("*").alias("n"))
    turn = F.col("turn")
    unknown = F.struct(F.lit(-(1 << 62)).alias("turns"), F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 56).alias("part"))  # null turns by the first bits of their hashes
    block = F.when(turn.isNull(), unknown).otherwise(F.struct(F.floor(turn / BLOCK).alias("turns"), F.lit(0).cast("bigint").alias("part")))
    rows = rows.withColumn("block", block)
    order = [F.col("turn").asc_nulls_first(), "h", "g", "size"]
    inside = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    per = rows.groupBy("conv_id", "block").agg(F.sum("n").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranked.join(per.select("conv_id", "block", offset.alias("offset")), ["conv_id", "block"])
    start = F.col("offset") + F.col("before")
    each = F.when(F.col("n") == 1, F.array(start + 1)).otherwise(F.sequence(start + 1, start + F.col("n")))
    return placed.select("conv_id", F.explode(each).alias("place"), "h", "g", "size")


def rebuilt(numbered: DataFrame) -> DataFrame:
    """(conv_id, place, h, g, size, length) of the rebuilt conversations; place 0, without hashes, is for the root.

    A conversation takes the first turns (0 to 8, by its id's CRC) of its donor and then its own after as many. At
    most nine conversations share a donor, so nothing multiplies.
    """
    lengths = numbered.groupBy("conv_id").agg(F.max("place").alias("own"))
    heads = lengths.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % 5).alias("donor"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h_turns"))
    donors = lengths.select(F.col("conv_id").alias("donor"), F.col("own").alias("given"))
    plan = heads.join(donors, "donor", "left").select("conv_id", "donor", "h_turns", F.least("h_turns", F.coalesce("given", F.lit(0))).alias("taken"), "own")
    plan = written(plan.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h_turns"), F.lit(0))), "plan")
    first = numbered.where(F.col("place") <= HEAD).withColumnRenamed("conv_id", "donor")
    lent = first.join(plan, "donor").where(F.col("place") <= F.col("taken")).select("conv_id", "place", "h", "g", "size", "length")
    kept = numbered.join(plan, "conv_id").where(F.col("place") > F.col("h_turns"))
    kept = kept.select("conv_id", (F.col("place") - F.col("h_turns") + F.col("taken")).alias("place"), "h", "g", "size", "length")
    zero = F.lit(0).cast("bigint")
    root = plan.select("conv_id", zero.alias("place"), zero.alias("h"), zero.alias("g"), F.lit(0).alias("size"), "length")
    return lent.unionByName(kept).unionByName(root)


def _running(how, c: str, window) -> Column:
    return F.coalesce(how(c).over(window), F.lit(0).cast("bigint"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k, l, pk, pl, bytes, ends): all nodes on all conversations' paths.

    k and l name the node, pk and pl its parent; bytes are those of all texts down to it. XORs and sums run inside blocks
    of a conversation and go on from those of the blocks before.
    """
    tag = lambda c: F.when(F.col("place") > 0, F.xxhash64("place", c)).otherwise(0)  # noqa: E731  the root is zero
    rows = turns.select("conv_id", "place", "length", "size", tag("h").alias("x"), tag("g").alias("y"), F.floor(F.col("place") / BLOCK).alias("block"))
    upto = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumns({"k": F.bit_xor("x").over(upto), "l": F.bit_xor("y").over(upto), "bytes": F.sum("size").over(upto)})
    per = rows.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"), F.sum("size").alias("bs"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("conv_id", "block", _running(F.bit_xor, "bx", before).alias("bx"), _running(F.bit_xor, "by", before).alias("by"), _running(F.sum, "bs", before).alias("bs"))
    out = inside.join(per, ["conv_id", "block"])
    k, l = F.col("k").bitwiseXOR(F.col("bx")), F.col("l").bitwiseXOR(F.col("by"))
    return out.select(
        "conv_id", F.col("place").alias("depth"), k.alias("k"), l.alias("l"), k.bitwiseXOR(F.col("x")).alias("pk"), l.bitwiseXOR(F.col("y")).alias("pl"),
        (F.col("bytes") + F.col("bs")).alias("bytes"), (F.col("place") == F.col("length")).alias("ends"),
    )


def node_table(paths: DataFrame) -> DataFrame:
    """(depth, k, l, n_convs, conv_id, end_id, bytes, n_children): each node once; end_id is the smallest conversation that ends there."""
    none = F.lit(None).cast("bigint")
    own = paths.groupBy("depth", "k", "l").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.min(F.when(F.col("ends"), F.col("conv_id"))).alias("end_id"), F.max("bytes").alias("bytes"), F.max("pk").alias("pk"), F.max("pl").alias("pl"))
    own = written(own, "own")
    child = own.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("pk").alias("k"), F.col("pl").alias("l"), F.lit(0).cast("bigint").alias("n"), none.alias("first"), none.alias("end_id"), none.alias("bytes"), F.lit(1).alias("child"))
    both = own.drop("pk", "pl").withColumn("child", F.lit(0)).unionByName(child)
    return both.groupBy("depth", "k", "l").agg(
        F.sum("n").alias("n_convs"), F.max("first").alias("conv_id"), F.max("end_id").alias("end_id"), F.max("bytes").alias("bytes"), F.sum("child").alias("n_children")
    )


def ended(paths: DataFrame) -> DataFrame:
    """(depth, k, l, ends_sha256): of the conversations that end at a node, in pieces of neighbouring ids.

    A piece has at most ``ID_BLOCK`` ids. The pieces of a node are read in order as a stream, which a hash over them needs.
    """
    piece = F.floor(F.col("conv_id") / ID_BLOCK)
    lists = paths.where("ends").groupBy("depth", "k", "l", piece.alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    keys = ["depth", "k", "l"]

    def run(batches):
        import hashlib

        node, state = None, None
        done: list[tuple] = []

        def flush():
            out = pa.RecordBatch.from_pylist([dict(zip((*keys, "ends_sha256"), x)) for x in done], schema=schema)
            done.clear()
            return out

        for batch in batches:
            for *own, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if own == node:
                    state.update(b"," + ids.encode())
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = own, hashlib.sha256(ids.encode())
            yield flush()
        if node is not None:
            done.append((*node, state.hexdigest()))
            yield flush()

    schema = pa.schema([("depth", pa.int64()), ("k", pa.int64()), ("l", pa.int64()), ("ends_sha256", pa.string())])
    ordered = lists.repartition(*keys).sortWithinPartitions(*keys, "piece").select(*keys, "ids")
    return ordered.mapInArrow(run, "depth bigint, k bigint, l bigint, ends_sha256 string")


# Balanced parentheses.


class Parentheses:
    """A tree as opening (True) and closing brackets in preorder, with a tree of the minimum excess of blocks over it."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1))
        n = -(-len(opens) // EXCESS_BLOCK)
        padded = np.full(n * EXCESS_BLOCK, np.iinfo(np.int64).max)
        padded[: len(opens)] = self.excess
        self.blocks = padded.reshape(n, EXCESS_BLOCK)
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.tree = np.full(2 * self.leaves, np.iinfo(np.int64).max)
        self.tree[self.leaves : self.leaves + n] = self.blocks.min(axis=1)
        for level in range(self.leaves.bit_length() - 2, -1, -1):
            at = np.arange(1 << level, 2 << level)
            self.tree[at] = np.minimum(self.tree[2 * at], self.tree[2 * at + 1])

    def find_close(self, at: np.ndarray, rows: int = 1 << 16) -> np.ndarray:
        """The closing bracket of each opening one: the next place where the excess is one less than there."""
        out = np.empty(len(at), dtype=np.int64)
        for start in range(0, len(at), rows):
            out[start : start + rows] = self._close(at[start : start + rows])
        return out

    def _close(self, at: np.ndarray) -> np.ndarray:
        goal = self.excess[at] - 1
        block = at // EXCESS_BLOCK
        here = (self.blocks[block] <= goal[:, None]) & (np.arange(EXCESS_BLOCK)[None, :] > (at % EXCESS_BLOCK)[:, None])
        found = here.any(axis=1)
        out = block * EXCESS_BLOCK + here.argmax(axis=1)
        far = np.flatnonzero(~found)
        node, goal = block[far] + self.leaves, goal[far]
        up = np.ones(len(far), dtype=bool)
        while up.any():  # to the nearest block on the right whose minimum reaches the goal
            aside = (node & 1 == 0) & up
            hit = np.zeros(len(far), dtype=bool)
            hit[aside] = self.tree[node[aside] + 1] <= goal[aside]
            node = np.where(hit, node + 1, np.where(up, node >> 1, node))
            up &= ~hit
        while (low := node < self.leaves).any():
            left = np.where(low, 2 * node, node)
            node = np.where(low, np.where(self.tree[left] <= goal, left, left + 1), node)
        block = node - self.leaves
        out[far] = block * EXCESS_BLOCK + (self.blocks[block] <= goal[:, None]).argmax(axis=1)
        return out


def shard_sums(keys: list[np.ndarray], offsets: np.ndarray, own: np.ndarray, seen: int, shared: int) -> tuple[np.ndarray, ...]:
    """(item, leaves, below, parent, spine) of the nodes of a shard.

    keys, offsets: items of the sorted paths; own: what each node saves; the first ``seen`` nodes of the first path were
    in the shard before and save nothing here, the first ``shared`` of the last path go on in the next one,
    which decides whether they are leaves. below: savings of the strict descendants.
    """
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(row)) - offsets[:-1][row]
    before = np.where(row > 0, offsets[np.maximum(row - 1, 0)] + place, 0)
    same = (row > 0) & (place < lengths[np.maximum(row - 1, 0)])
    for k in keys:
        same &= k == k[np.where(same, before, 0)]
    common = np.minimum.reduceat(np.where(same, lengths[row], place), offsets[:-1])  # place of the first difference
    item = np.flatnonzero(place >= common[row])
    closing = np.concatenate([lengths[:-1] - common[1:], lengths[-1:]])  # after each path
    new = lengths - common
    counts = np.stack([new, closing], axis=1).ravel()
    opens = np.repeat(np.tile([True, False], len(lengths)), counts)
    tree = Parentheses(opens)
    at = np.flatnonzero(opens)
    close = tree.find_close(at)
    saved = own[item].astype(np.int64)
    saved[:seen] = 0
    spine = np.zeros(len(item), dtype=bool)
    spine[:seen] = True
    last = place[item] < shared
    goes_on = last & (close >= len(opens) - lengths[-1])  # open until after the last path
    spine |= goes_on
    leaf = np.zeros(len(opens) + 1, dtype=np.int64)
    pair = ~opens[at + 1] & ~goes_on
    leaf[at[pair] + 1] = 1
    leaf = np.cumsum(leaf)  # leaf[i]: pairs that begin before i
    rank = np.cumsum(opens)
    sums = np.concatenate([[0], np.cumsum(saved)])
    below = sums[rank[close]] - sums[rank[at]]
    parent = np.where(place[item] > 0, item - 1, -1)  # on the same path
    return item, leaf[close + 1] - leaf[at], below, parent, spine


NODE = "struct<depth:bigint,k:bigint,l:bigint,n:bigint,conv_id:bigint,bytes:bigint,children:bigint>"
FIELDS = ("depth", "k", "l", "n", "conv_id", "bytes", "children")


def path_table(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path): for each different conversation, the nodes on its path where something branches or ends, and the root."""
    keys = ["depth", "k", "l"]
    marked = nodes.where((F.col("depth") == 0) | (F.col("n_children") != 1) | F.col("end_id").isNotNull())
    marked = marked.select(*keys, F.col("n_convs").alias("n"), F.col("conv_id").alias("first"), F.col("bytes").alias("upto"), F.col("n_children").alias("children"))
    one = nodes.where(F.col("end_id").isNotNull()).select(F.col("end_id").alias("conv_id"))  # copies end at one node
    on = paths.join(one, "conv_id", "left_semi").select("conv_id", *keys).join(marked, keys)
    item = F.struct("depth", "k", "l", "n", F.col("first").alias("conv_id"), F.col("upto").alias("bytes"), "children").cast(NODE)
    return on.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("path")).select("path")


def sharded(path: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(shard, path, key, seen, shared): paths in the order of the trie, with what a shard shares with its neighbours."""
    path = written(path, "paths")
    total = path.agg(F.sum(F.size("path"))).first()[0] or 0
    key = F.transform("path", lambda x: F.struct(x["k"].alias("k"), x["l"].alias("l")))
    dealt = path.withColumn("key", key).repartitionByRange(max(1, -(-total // shard_nodes)), "key")
    dealt = written(dealt.withColumn("shard", F.spark_partition_id()), "sorted")
    ends = dealt.groupBy("shard").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    beside = Window.orderBy("shard")  # one row for each shard
    known = ends.withColumns({"prior": F.lag("high").over(beside), "after": F.lead("low").over(beside)})
    known = known.select("shard", *(F.when(F.col(b).isNull(), 0).otherwise(_common(F.col(a), F.col(b))).alias(n) for a, b, n in (("low", "prior", "seen"), ("high", "after", "shared"))))
    return dealt.join(F.broadcast(known), "shard")  # two numbers for each shard


def _common(a: Column, b: Column) -> Column:
    """Elements that two arrays of structs share at their beginning."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def subtree_sums(dealt: DataFrame) -> DataFrame:
    """(node, up, leaves, below): ``up`` is the node's parent among the path nodes (null: the root)."""
    kind = f"node {NODE}, up {NODE}, leaves bigint, below bigint, spine boolean"

    def run(key, table):
        path = table.combine_chunks().column("path").chunk(0)
        lengths = np.diff(path.offsets.to_numpy())
        flat = path.flatten()
        field = {c: flat.field(i).to_numpy(zero_copy_only=False) for i, c in enumerate(FIELDS)}
        order, offsets = _sorted(field, lengths)
        field = {c: v[order] for c, v in field.items()}
        place = np.arange(len(order)) - np.repeat(offsets[:-1], np.diff(offsets))
        above = np.where(place > 0, np.concatenate([[0], field["bytes"][:-1]]), 0)
        own = (field["n"] - 1) * (field["bytes"] - above)
        item, leaves, below, parent, spine = shard_sums([field["k"], field["l"]], offsets, own, table.column("seen")[0].as_py(), table.column("shared")[0].as_py())
        struct = lambda at, mask=None: pa.StructArray.from_arrays([pa.array(field[c][at]) for c in FIELDS], names=list(FIELDS), mask=mask)
        return pa.table({"node": struct(item), "up": struct(np.maximum(parent, 0), pa.array(parent < 0)), "leaves": pa.array(leaves), "below": pa.array(below), "spine": pa.array(spine)})

    parts = written(dealt.groupBy("shard").applyInArrow(run, kind), "sums")
    whole = parts.where("NOT spine").drop("spine")
    merged = parts.where("spine").groupBy("node", "up").agg(F.sum("leaves").alias("leaves"), F.sum("below").alias("below"))
    return whole.unionByName(merged)


def _sorted(field: dict[str, np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(items in the order of the sorted paths, offsets of the paths), the order of Spark's arrays of (k, l)."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    pairs = list(zip(field["k"].tolist(), field["l"].tolist()))
    order = sorted(range(len(lengths)), key=lambda i: pairs[starts[i] : starts[i + 1]])
    offsets = np.concatenate([[0], np.cumsum(lengths[order])])
    items = np.repeat(starts[:-1][order], lengths[order]) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths[order])
    return items, offsets


def trie(conversations: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    Null roles and texts are empty; null turns come first, turns of one number in the order of their texts' hashes; equal
    rows are turns of their own. Rows without a conversation's id belong to none. An empty table gives no
    rows, not even a root; texts count whole; other columns do not matter.
    """
    numbered = written(numbered_turns(conversations), "numbered")
    paths = written(prefixes(rebuilt(numbered)), "prefixes")
    nodes = written(node_table(paths), "nodes")
    sums = written(subtree_sums(sharded(path_table(paths, nodes), shard_nodes)), "subtrees")
    n, up = F.col("node"), F.col("up")
    top = F.coalesce(up["depth"] + 1, F.lit(0).cast("bigint"))  # the chain above a node begins here
    rows = sums.select("node", "up", "leaves", "below", F.explode(F.sequence(top, n["depth"])).alias("depth"))
    above = paths.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("bytes").alias("above"))
    near = rows.where(F.col("depth") == top).withColumn("above", F.coalesce(up["bytes"], F.lit(0)))
    deep = rows.where(F.col("depth") > top)
    deep = deep.join(above, (n["conv_id"] == F.col("c")) & (F.col("depth") - 1 == F.col("d"))).drop("c", "d")
    all_nodes = near.unionByName(deep)
    last = F.col("depth") == n["depth"]
    out = all_nodes.select(
        n["conv_id"].alias("conv_id"),
        "depth",
        F.when(F.col("depth") == top, up["conv_id"]).otherwise(n["conv_id"]).alias("parent_conv_id"),
        n["n"].alias("n_convs"),
        F.when(last, n["children"]).otherwise(1).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("below") + (n["n"] - 1) * (n["bytes"] - F.col("above"))).alias("saved_tokens"),
        F.when(last, n["k"]).alias("k"),
        F.when(last, n["l"]).alias("l"),
    )
    hashes = ended(paths).withColumnRenamed("depth", "end_depth").withColumnsRenamed({"k": "ek", "l": "el"})
    chains, tips = out.where(F.col("k").isNull()), out.where(F.col("k").isNotNull())
    tips = tips.join(hashes, (F.col("k") == F.col("ek")) & (F.col("l") == F.col("el")) & (F.col("depth") == F.col("end_depth")), "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    nobody = F.sha2(F.lit(""), 256)
    return reduce(DataFrame.unionByName, [tips.select(*columns, F.coalesce("ends_sha256", nobody).alias("ends_sha256")), chains.select(*columns, nobody.alias("ends_sha256"))])
