"""Prefix trie of conversations by union-find over sorted neighbours' common prefixes.

A conversation is a sequence of turns, a turn a 16-byte digest of role and text.  Conversations are sorted as sequences
(in blocks of ``BLOCK`` turns; only those that share a whole block with another one are sorted further), and
neighbours' common prefix lengths become edges.  Edges are joined in descending depth: every merge of two components
makes, or adds to, the branching node of that depth, and what lies deeper in both is finished.

Sorted rows are dealt in groups of bounded size.  Inside a group only nodes that cannot reach over its ends are
finished; the rest is contracted to components between edges that fall and then rise, at most two per depth.  The
contracted forests of ``FAN`` neighbouring groups are joined by the same step, until one group is left.  Aggregates of a
component need no second pass: the bytes that prefixes save are the sum over its edges of the bytes in common, less
what lies above the node.  Chains of nodes with one child are written out at the end.

Rows without a conversation id belong to no conversation.  Null role and text are empty; null turns come first; turns of
one number are ordered by role, then by digest, and equal rows are turns of their own.  An empty table has no
nodes, not even a root.  Other columns are not read.  Memory of a task: ``BLOCK`` digests a row, ``GROUP`` rows or the
contracted rows of ``FAN`` groups, ``CHUNK`` ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions.ordered import prefix_scan
from turnlake.session import settle

from .ranks import ranked

BLOCK, GROUP, FAN, CHUNK = 256, 1 << 16, 16, 4096
SPAN = 4096
NONE = -1

NODE, ITEM, ALIAS, ENDS = range(4)
#: One row of a forest: a finished node, an open component, or a renamed component.
FIELDS = "kind id rep depth parent above n low net leaves children ends lcp shared place".split()
SCHEMA = ", ".join(f"{f} long" for f in FIELDS) + ", text string"


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos from 0, digest, bytes, size): every turn with its place and its conversation's number of turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"),
        F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
    )
    return ranked(rows, ["conv"], ["turn", "role", "digest"], "trie-turns").select("conv", F.col("rank").alias("pos"), "digest", "bytes", "size")


def rebuilt(own: DataFrame, every: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their block of ids: (conv, j from 1, digest, bytes), and (conv, len) of all.

    Conversation c has the first h turns of conversation c - c % every, then its own after its first h; h is the
    unsigned crc32 of c in decimal, modulo ``heads``.
    """
    own = settle(own, "trie-own")
    h = F.crc32(F.col("conv").cast("string")) % heads
    convs = own.where("pos = 0").select("conv", "size", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    sizes = convs.select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    convs = convs.join(sizes, "base", "left").withColumn("head", F.least("h", F.coalesce("base_size", F.lit(0))))
    convs = settle(convs.select("conv", "base", "h", "head", (F.col("head") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("len")), "trie-convs")
    first = own.where(F.col("pos") < heads - 1).select(F.col("conv").alias("base"), "pos", "digest", "bytes")
    begin = convs.join(first, "base").where("pos < h").select("conv", (F.col("pos") + 1).alias("j"), "digest", "bytes")
    rest = own.where(F.col("pos") >= h).join(convs.select("conv", "head", "h"), "conv").select(
        "conv", (F.col("head") + F.col("pos") - F.col("h") + 1).alias("j"), "digest", "bytes"
    )
    return begin.unionByName(rest), convs.select("conv", "len")


def neighbours(rows: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, len, path, lcp): ``path`` sorts conversations as sequences, ``lcp`` is the prefix shared with the one before (-1: none)."""
    blocks = rows.groupBy("conv", F.expr(f"(j - 1) div {block}").alias("nth")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("j", "digest"))), lambda t: t["digest"]).alias("keys")
    )
    blocks = settle(blocks, "trie-blocks")
    empty = F.array().cast("array<binary>")
    longest = lengths.agg(F.max("len")).first()[0] or 0
    active = lengths.select("conv", "len", F.array().cast("array<long>").alias("path"), F.lit(NONE).cast("long").alias("edge"))
    done: list[DataFrame] = []
    nth = 0
    while True:
        held = active.join(blocks.where(F.col("nth") == nth).select("conv", "keys"), "conv", "left").withColumn("keys", F.coalesce("keys", empty))
        held = held.withColumn("more", F.col("len") > (nth + 1) * block)
        held = settle(ranked(held, [], ["path", "keys", "more", "conv"], "trie-sorted"), "trie-ranked").drop("size")
        before = held.select((F.col("rank") + 1).alias("rank"), F.col("path").alias("path0"), F.col("keys").alias("keys0"))
        apart = F.array_position(F.zip_with("keys", "keys0", lambda x, y: x.eqNullSafe(y)), F.lit(False))
        common = F.when(apart == 0, F.size("keys")).otherwise(apart - 1) + nth * block
        edges = held.join(before, "rank", "left").withColumn(
            "lcp", F.when(F.col("path") == F.col("path0"), common).otherwise(F.col("edge")).cast("long")
        ).drop("path0", "keys0")
        if longest <= (nth + 1) * block:
            done.append(edges.select("conv", "len", F.array_append("path", F.col("rank")).alias("path"), "lcp"))
            break
        edges = settle(edges, "trie-edges")
        shared = edges.where("more").groupBy(F.col("path").alias("path0"), F.col("keys").alias("keys0")).agg(
            F.min("rank").alias("class"), F.min_by("lcp", "rank").alias("into"), F.count(F.lit(1)).alias("members")
        ).where("members > 1")
        same = F.col("more") & (F.col("path") == F.col("path0")) & (F.col("keys") == F.col("keys0"))
        edges = settle(edges.join(shared, same, "left"), "trie-classes")
        done.append(edges.where("class is null").select("conv", "len", F.array_append("path", F.col("rank")).alias("path"), "lcp"))
        active = edges.where("class is not null").select("conv", "len", F.array_append("path", F.col("class")).alias("path"), F.col("into").alias("edge"))
        if active.isEmpty():
            break
        nth += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def forest(rows: dict[str, np.ndarray], closed: bool, fresh: Iterator[int]) -> list[tuple]:
    """Join neighbouring components by union-find, deepest edge first; rows as in ``FIELDS``.

    ``closed``: no component reaches over the ends of these rows.
    """
    ident, rep, depth, n, low, net, leaves, children, ends, lcp, shared = (
        rows[f].tolist() for f in "id rep depth n low net leaves children ends lcp shared".split()
    )
    m = len(ident)
    owner = list(range(m))
    name: dict[int, int] = {}
    open_left, open_right = [False] * m, [False] * m
    open_left[0] = open_right[-1] = not closed
    nodes: list[list[int]] = []

    def find(k: int) -> int:
        while owner[k] != k:
            owner[k] = owner[owner[k]]
            k = owner[k]
        return k

    def named(k: int) -> int:
        while k in name:
            k = name[k]
        return k

    def lift(k: int, to: int) -> None:
        """Finish what lies deeper than ``to``; the component is part of a node of that depth then."""
        if depth[k] > to:
            below = children[k] + 1 - ends[k]  # joined edges, less copies that end here
            leaves[k] = leaves[k] if below else 1
            up = next(fresh) if to >= 0 else NONE
            nodes.append([NODE, ident[k], rep[k], depth[k], up, to, n[k], low[k], net[k], leaves[k], below, ends[k], 0, 0, 0])
            ident[k], depth[k], children[k], ends[k] = up, to, 0, 0

    for e in (np.argsort(-rows["lcp"][1:], kind="stable") + 1).tolist():
        a, b, at = find(e - 1), e, lcp[e]
        if (open_left[a] and depth[a] != at) or (open_right[b] and depth[b] != at):
            if not open_left[a]:
                lift(a, at)
            if not open_right[b]:
                lift(b, at)
            open_right[a] = open_left[b] = True
            continue
        lift(a, at)
        lift(b, at)
        owner[b] = a
        name[ident[b]] = ident[a]
        n[a] += n[b]
        low[a] = min(low[a], low[b])
        net[a] += net[b] + shared[b]
        leaves[a] += leaves[b]
        children[a] += children[b] + 1
        ends[a] += ends[b]
        open_right[a] = open_right[b]
    roots = [k for k in range(m) if owner[k] == k]
    if closed:
        lift(roots[0], NONE)
        roots = []
    for row in nodes:
        row[4] = named(row[4])
        row[1] = named(row[1])
    items = [(ITEM, ident[k], rep[k], depth[k], NONE, 0, n[k], low[k], net[k], leaves[k], children[k], ends[k], lcp[k], shared[k], k) for k in roots]
    renamed = [(ALIAS, k, NONE, 0, named(k)) + (0,) * 10 for k in name]
    return [*map(tuple, nodes), *items, *renamed]


def _table(rows: list[tuple], texts: list[str | None]) -> pa.Table:
    columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(FIELDS)
    return pa.Table.from_arrays([*columns, pa.array(texts, pa.string())], [*FIELDS, "text"])


def _numbers(step: int, group: int) -> Iterator[int]:
    """Numbers for components that no other group or step gives out."""
    k = (step << 59) | (group << 27)
    while True:
        yield k
        k += 1


def _merging(step: int, last: bool) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    """Join the contracted forests of neighbouring groups."""

    def merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        place = np.asarray(rows["place"])
        out = forest({f: np.asarray(rows[f]) for f in FIELDS}, last, _numbers(step, key[0].as_py()))
        return _table([(*r[:14], int(place[r[14]])) if r[0] == ITEM else r for r in out], [None] * len(out))

    return merge


def _forests(ordered: DataFrame, count: int, group: int, fan: int) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Finished nodes, renamings of each step after the first, and chunks of the ids that end in a node."""
    groups = -(-count // group)
    alone = groups == 1

    def first(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        conv, size, lcp, shared, rank = (np.asarray(rows[c]) for c in ("conv", "len", "lcp", "shared", "rank"))
        m, numbers = len(conv), _numbers(0, key[0].as_py())
        ident = np.array([next(numbers) for _ in range(m)])
        zero, one = np.zeros(m, np.int64), np.ones(m, np.int64)
        out = forest({"id": ident, "rep": conv, "depth": size, "n": one, "low": conv, "net": zero, "leaves": zero, "children": zero, "ends": one,
                      "lcp": lcp, "shared": shared}, alone, numbers)
        alias = {r[1]: r[4] for r in out if r[0] == ALIAS}
        # Equal neighbours end in one node; their ids are already in order.
        begin = np.flatnonzero(np.concatenate(([True], (lcp[1:] != size[1:]) | (size[1:] != size[:-1]))))
        runs, texts = [], []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), m]):
            for at in range(a, b, CHUNK):
                k = int(ident[a])
                runs.append((ENDS, alias.get(k, k)) + (0,) * 12 + (int(rank[at]),))
                texts.append(",".join(map(str, conv[at : min(b, at + CHUNK)].tolist())))
        kept = [(*r[:14], int(rank[0]) + r[14]) if r[0] == ITEM else r for r in out if r[0] != ALIAS]
        return _table(kept + runs, [None] * len(kept) + texts)

    dealt = ordered.withColumn("grp", F.expr(f"rank div {group}"))
    made = settle(dealt.groupBy("grp").applyInArrow(first, SCHEMA), "trie-forest-0")
    nodes, chunks, renamed = made.where(F.col("kind") == NODE), made.where(F.col("kind") == ENDS), []
    step, width = 1, group
    while groups > 1:
        width, groups = width * fan, -(-groups // fan)
        items = made.where(F.col("kind") == ITEM).withColumn("grp", F.expr(f"place div {width}"))
        made = settle(items.groupBy("grp").applyInArrow(_merging(step, groups == 1), SCHEMA), f"trie-forest-{step}")
        nodes = nodes.unionByName(made.where(F.col("kind") == NODE))
        renamed.append(made.where(F.col("kind") == ALIAS).select(F.col("id").alias("old"), F.col("parent").alias("new")))
        step += 1
    return nodes, renamed, chunks


def _renamed(df: DataFrame, col: str, steps: list[DataFrame]) -> DataFrame:
    for step in steps:
        df = df.join(step, F.col(col) == F.col("old"), "left").withColumn(col, F.coalesce("new", col)).drop("old", "new")
    return df


def _digests(chunks: DataFrame) -> DataFrame:
    """(id, ends_sha256): the SHA-256 of each node's ids, fed chunk by chunk in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            ids, sums = [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != at:
                    if state is not None:
                        ids.append(at)
                        sums.append(state.hexdigest())
                    at, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums)], ["id", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([state.hexdigest()])], ["id", "ends_sha256"])

    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = chunks.repartition(tasks, "id").sortWithinPartitions("id", "place").select("id", "text")
    return laid.mapInArrow(run, "id long, ends_sha256 string")


def prefix_trie(rows: DataFrame, lengths: DataFrame, block: int = BLOCK, group: int | None = None, fan: int = FAN) -> DataFrame:
    """All nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows`` are turns (conv, j from 1 without gaps, digest, bytes), ``lengths`` all conversations (conv, len).  ``group``
    rows are joined at once (by default as many as give every shuffle partition one group, ``GROUP`` at most).
    """
    spark = rows.sparkSession
    placed = settle(
        prefix_scan(rows, ["conv"], ["j"], F.expr(f"(j - 1) div {block}"), sums={"before": F.col("bytes")}).select(
            "conv", "j", "digest", "bytes", F.col("before").cast("long").alias("before")), "trie-rows"
    )
    lengths = settle(lengths, "trie-lengths")
    near = settle(neighbours(placed, lengths, block), "trie-neighbours")
    common = placed.select("conv", F.col("j").alias("lcp"), (F.col("before") + F.col("bytes")).alias("shared"))
    ordered = ranked(near.select("conv", "len", "path", "lcp"), [], ["path"], "trie-order").drop("path")
    ordered = ordered.join(common, ["conv", "lcp"], "left").select(
        "conv", "len", "lcp", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), "rank")
    count = lengths.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes, steps, chunks = _forests(ordered, count, group or max(1, min(GROUP, -(-count // tasks))), fan)

    nodes = settle(_renamed(nodes, "parent", steps), "trie-nodes")
    ends = _digests(_renamed(chunks.select("id", "place", "text"), "id", steps))
    low = nodes.select(F.col("id").alias("parent"), F.col("low").alias("parent_low"))
    full = nodes.select("id", "rep", "depth", "parent", "above", "n", "low", "net", "leaves", "children").join(low, "parent", "left").join(ends, "id", "left")
    # Every node stands for itself and the chain of single children above it.
    start = F.col("above") + 1
    spans = full.withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(depth - above - 1) div {SPAN}")))).withColumn("from", start + F.col("span") * SPAN)
    each = spans.withColumn("j", F.explode(F.sequence(F.col("from"), F.least(F.col("depth"), F.col("from") + (SPAN - 1))))).drop("span", "from")
    before = placed.select(F.col("conv").alias("rep"), "j", "before")
    many = each.where("n > 1").join(before, ["rep", "j"], "left")
    single = each.where("n = 1").withColumn("before", F.lit(0).cast("long"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    here = F.col("j") == F.col("depth")
    return many.unionByName(single).select(
        F.col("low").alias("conv_id"), F.col("j").alias("depth"),
        F.when(F.col("j") == 0, F.lit(None)).when(F.col("j") == start, F.col("parent_low")).otherwise(F.col("low")).cast("long").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(here, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("net") - (F.col("n") - 1) * F.coalesce("before", F.lit(0))).alias("saved_tokens"),
        F.when(here, F.coalesce("ends_sha256", nothing)).otherwise(nothing).alias("ends_sha256"),
    )
