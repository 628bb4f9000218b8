"""Merkle manifest of a dataset: a digest per row, a tree per group, a tree over the groups' roots, and proofs.

Nodes of a level are rows (tree, index, digest).  Every level is one equijoin of the nodes with the computed indices
of their siblings: the index with its last bit flipped for two children a node, the offsets of the other slots for
more.  Slot-zero rows hold all digests of their run then, and emit the parent.  Proofs come back down the same
tables: a node's proof is its siblings followed by its parent's proof, one equijoin a level; the tables halve from
level to level, so all of it costs a few times the leaves.

H is the lowercase hex SHA-256 of its inputs, concatenated; digests go in as hex text.  A leaf is the H of the row's
fields, each ``-`` if null, else its number of UTF-8 bytes, ``:`` and the value.  Per group the leaves ascend by the
order column (null first; rows equal in it by leaf, so rows equal in all fields are interchangeable); every
``arity`` consecutive nodes (the last run may have fewer, even one) become their H while there are several.  What remains is
the group's subroot; the subroots, by group (null first, bytewise), become the root alike.

An empty table has no rows and no root.  All other columns of the leaves are carried; those of the results' names
are replaced.  Indices come from ``ranks.ranked``, so a group may hold all rows; nothing is gathered but the number of
levels and the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.session import settle

from .ranks import ranked

DIGEST = 32
#: Levels of the way down that are one job.
DOWN = 4


def digest(*parts: Column) -> Column:
    """H of the parts, as hex text."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """Digest of one row's fields."""
    texts = [f.cast("string") for f in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def _hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def _up(n: Column, arity: int) -> Column:
    return F.floor((n + (arity - 1)) / arity).cast("long") if arity & (arity - 1) else F.shiftright(n + (arity - 1), arity.bit_length() - 1)


def levels(n: int, arity: int) -> int:
    """Number of levels above the leaves of a tree with n leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // arity), out + 1
    return out


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Add ``others``: the digests of the rest of each node's run, in order, as one binary value."""
    side = nodes.select(F.col("tree").alias("tree2"), F.col("idx").alias("idx2"), F.col("digest").alias("other"))
    if arity == 2:
        pairs = nodes.join(side, (F.col("tree") == F.col("tree2")) & (F.col("idx").bitwiseXOR(F.lit(1)) == F.col("idx2")), "left")
        return pairs.withColumn("others", F.coalesce("other", F.lit(b""))).drop("tree2", "idx2", "other")
    slot = F.col("idx") % arity
    out, found = nodes, []
    for offset in range(1, arity):
        at = (slot + offset) % arity
        names = [f"tree{offset}", f"idx{offset}", f"other{offset}"]
        wanted = (F.col("tree") == F.col(names[0])) & (F.col("idx") - slot + at == F.col(names[1]))
        out = out.join(side.toDF(*names), wanted, "left")
        found.append(F.struct(at.alias("slot"), F.col(names[2]).alias("digest")))
    ordered = F.array_sort(F.filter(F.array(*found), lambda s: s["digest"].isNotNull()))
    return out.select(*nodes.columns, F.aggregate(ordered, F.lit(b""), lambda a, s: F.concat(a, s["digest"])).alias("others"))


def _climb(nodes: DataFrame, top: int, arity: int) -> list[DataFrame]:
    """Tables of all levels, 0 to ``top``: (tree, idx, n nodes on the level, digest, others, and at 0 what else the rows have).

    A tree that has one node left ends on that level.
    """
    out = []
    for level in range(top + 1):
        linked = settle(_with_siblings(nodes, arity), f"merkle-{level}")
        out.append(linked)
        nodes = linked.where((F.col("n") > 1) & (F.col("idx") % arity == 0)).select(
            "tree", F.expr(f"idx div {arity}").alias("idx"), _up(F.col("n"), arity).alias("n"),
            F.unhex(digest(_hex(F.col("digest")), _hex(F.col("others")))).alias("digest"),
        )
    return out


def _roots(tables: list[DataFrame]) -> DataFrame:
    """(tree, digest, height) of every tree."""
    ends = [t.where("n = 1").select("tree", "digest", F.lit(level).alias("height")) for level, t in enumerate(tables)]
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return out


def _descend(tables: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """The level-0 rows with ``proof``: all siblings up to their tree's root, then what ``above`` (tree, height, proof) has."""
    proofs = None
    for level in range(len(tables) - 1, -1, -1):
        ends = above.where(F.col("height") == level).select(F.col("tree").alias("t"), F.lit(0).cast("long").alias("up"), "proof")
        proofs = ends if proofs is None else proofs.select(F.col("tree").alias("t"), F.col("idx").alias("up"), "proof").unionByName(ends)
        rows = tables[level].join(proofs, (F.col("tree") == F.col("t")) & (F.expr(f"idx div {arity}") == F.col("up"))).drop("t", "up")
        proofs = rows.withColumn("proof", F.concat("others", "proof"))
        if level and level % DOWN == 0:
            proofs = settle(proofs.select("tree", "idx", "proof"), f"merkle-down-{level}")
    return proofs


def manifest(leaves: DataFrame, group_col: str = "lang", order_col: str = "doc_id", leaf_col: str = "leaf", arity: int = 2) -> DataFrame:
    """The rows of ``leaves`` with their place and proof.

    Added: ``position`` and ``group_size`` (leaves of the group), ``group_position`` and ``groups``, ``subroot`` and ``root``
    (hex text), and ``proof`` (the sibling digests from the leaf to the root, binary).
    """
    added = ("position", "group_size", "group_position", "groups", "subroot", "root", "proof")
    carried = [c for c in leaves.columns if c not in added]
    rows = leaves.select(
        F.col(group_col).alias("tree_name"), F.col(order_col).alias("place"), F.col(leaf_col).alias("hash"),
        F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carried))).alias("row"),
    )
    rows = settle(ranked(rows, ["tree_name"], ["place", "hash"], "merkle-leaves"), "merkle-ranked")
    named = ranked(rows.select("tree_name").distinct(), [], ["tree_name"], "merkle-groups")
    named = settle(named.select(F.col("tree_name").alias("name"), F.col("rank").alias("tree"), F.col("size").alias("groups")), "merkle-trees")
    most = rows.agg(F.max("size")).first()[0] or 0
    base = rows.join(named, F.col("tree_name").eqNullSafe(F.col("name"))).select(
        "tree", F.col("rank").alias("idx"), F.col("size").alias("n"), F.unhex("hash").alias("digest"), "row", F.col("size").alias("group_size"), "groups"
    )
    tables = _climb(base, levels(most, arity), arity)
    roots = settle(_roots(tables), "merkle-roots")

    groups = named.count()
    upper = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(groups).cast("long").alias("n"), "digest", "height")
    over = _climb(upper, levels(groups, arity), arity)
    root = over[-1].select("digest").first()
    start = over[-1].select("tree", F.lit(len(over) - 1).alias("height"), F.lit(b"").alias("proof"))
    above = settle(
        _descend(over, start, arity).select(F.col("idx").alias("tree"), "height", "proof", _hex(F.col("digest")).alias("subroot")), "merkle-above"
    )
    rows = _descend(tables, above.drop("subroot"), arity).join(above.select(F.col("tree").alias("t"), "subroot"), F.col("tree") == F.col("t"))
    return rows.select(
        *(F.col(f"row.c{i}").alias(c) for i, c in enumerate(carried)), F.col("idx").alias("position"), "group_size",
        F.col("tree").alias("group_position"), "groups", "subroot", F.lit(root["digest"].hex() if root else None).cast("string").alias("root"), "proof",
    )


def _fold(start: Column, proof: Column, top: int, arity: int) -> Column:
    """Fold a state (digest, bytes of the proof used, index, nodes on the level) up to its tree's root."""

    def step(s: Column, _: Column) -> Column:
        slot = (s["idx"] % arity).cast("int")
        others = (F.least(F.lit(arity).cast("long"), s["n"] - s["idx"] + slot) - 1).cast("int")
        left = proof.substr(s["used"] + 1, slot * DIGEST)
        right = proof.substr(s["used"] + 1 + slot * DIGEST, (others - slot) * DIGEST)
        up = F.floor(s["idx"] / arity).cast("long") if arity & (arity - 1) else F.shiftright(s["idx"], arity.bit_length() - 1)
        return F.when(
            s["n"] > 1,
            F.struct(digest(_hex(left), s["digest"], _hex(right)).alias("digest"), (s["used"] + others * DIGEST).alias("used"), up.alias("idx"), _up(s["n"], arity).alias("n")),
        ).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(top)), start, step) if top else start


def verify(proven: DataFrame, leaf_col: str, group_levels: int = 40, top_levels: int = 40, arity: int = 2) -> DataFrame:
    """Add ``folded_root``: the root that each row's own leaf digest and proof lead to.

    ``group_levels`` and ``top_levels`` bound the heights of the trees; the proof's own sizes decide how many are used.
    """
    start = F.struct(F.col(leaf_col).alias("digest"), F.lit(0).alias("used"), F.col("position").alias("idx"), F.col("group_size").alias("n"))
    inner = proven.withColumn("inner", _fold(start, F.col("proof"), group_levels, arity))
    outer = F.struct(F.col("inner.digest").alias("digest"), F.col("inner.used").alias("used"), F.col("group_position").alias("idx"), F.col("groups").alias("n"))
    return inner.withColumn("folded_root", _fold(outer, F.col("proof"), top_levels, arity)["digest"]).drop("inner")
