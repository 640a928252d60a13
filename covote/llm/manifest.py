"""Merkle manifest of a table: one leaf a row, a tree per language, a tree of their roots, and proofs for all rows.

Trees are built in rounds, each folding blocks of leaves by several levels. For the proofs a block is a
leaf partition: from its range of leaves alone it works out the coordinates of all nodes that its
proofs need and its own leaves do not yield, fetches each of them once, derives the interior nodes
its leaves share, and expands the proof of every leaf on the spot (an octopus multiproof).
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covote.llm.common import kept
from covote.llm.prefix import prefix_sums, ranged, totals_before, with_before

ARITY_BITS = 3  # eight consecutive nodes become one
BLOCK_LEVELS = 4  # that a block of leaves is folded by in a round
BLOCK = 1 << ARITY_BITS * BLOCK_LEVELS
HEX = 64  # characters of a digest
MAX_LEVELS = 20  # enough for 8^20 rows
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODE = "tree string, n long, level int, i long, digest string"
STEP = "array<struct<left:string,right:string>>"


def lower_ascii(text: str) -> Column:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.col(text), capitals, capitals.lower())


def leaf_digest(found: dict[str, Column] | None = None) -> Column:
    """The digest of a row: of each field its length in bytes, a colon and its value, or ``-`` where it is null.

    ``found`` replaces fields by what they hold elsewhere.
    """
    values = [(found or {}).get(c, F.col(c)).cast("string") for c in FIELDS]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _fold(level: int):
    """Nodes of the next levels over one block of the nodes of ``level``."""

    def fold(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("i")
        tree, n = block["tree"].iloc[0], int(block["n"].iloc[0])
        digests, start = block["digest"].tolist(), int(block["i"].iloc[0])
        made = []
        for up in range(level + 1, level + 1 + BLOCK_LEVELS):
            if n + (1 << ARITY_BITS * (up - 1)) - 1 >> ARITY_BITS * (up - 1) <= 1:
                break  # the level below is one node: the root
            digests = [_sha("".join(digests[k : k + 8])) for k in range(0, len(digests), 8)]
            start >>= ARITY_BITS
            made += [(tree, n, up, start + k, d) for k, d in enumerate(digests)]
        return pd.DataFrame(made, columns=["tree", "n", "level", "i", "digest"])

    return fold


def _nodes(units: DataFrame, name: str) -> DataFrame:
    """All nodes above the leaves ``tree, i, n, digest`` of each tree: ``tree, n, level, i, digest``."""
    most = units.agg(F.max("n")).first()[0] or 0
    made, current, level = [], units, 0
    while most > 1 << ARITY_BITS * level:
        blocks = current.withColumn("block", F.expr(f"i div {BLOCK}")).groupBy("tree", "block")
        made.append(kept(blocks.applyInPandas(_fold(level), NODE), name))
        level += BLOCK_LEVELS
        current = made[-1].where(F.col("level") == level)
    out = units.sparkSession.createDataFrame([], NODE)
    for nodes in made:
        out = out.unionByName(nodes)
    return out


def _roots(units: DataFrame, nodes: DataFrame) -> DataFrame:
    width = F.expr(f"shiftleft(1L, {ARITY_BITS} * level)")
    tops = nodes.where(F.col("n") <= width).select("tree", "digest")
    return tops.unionByName(units.where("n = 1").select("tree", "digest"))


def _missing(parts: DataFrame) -> DataFrame:
    """``tree, block, level, i`` of the nodes that the proofs of leaves ``a`` to ``b`` need beside these leaves.

    What is known of a level is a range, from the parent of the first leaf to that of the last. So
    the rest of the runs at its two ends is missing, if the tree has it, and nothing else.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(MAX_LEVELS - 1))).alias("level")
    at = parts.select("tree", "block", "a", "b", "n", levels).withColumn("w", F.expr(f"shiftleft(1L, {ARITY_BITS} * level)"))
    at = at.selectExpr("tree", "block", "level", "a div w AS a", "b div w AS b", "(n + w - 1) div w AS n").where("n > 1")
    ends = """concat(
        filter(transform(sequence(0L, 7L), p -> a div 8 * 8 + p), k -> k < a),
        filter(transform(sequence(0L, 7L), p -> b div 8 * 8 + p), k -> k > b AND k < n))"""
    return at.select("tree", "block", "level", F.explode(F.expr(ends)).alias("i"))


def _climbed(digests: list[str], first: int, n: int, far: dict) -> tuple[list[tuple[int, list[str]]], str]:
    """The runs of each level above the leaves from ``first`` on, as joined digests with the number of the first run; and the root."""
    levels = []
    while n > 1:
        last = first + len(digests) - 1
        start, end = first >> 3 << 3, min((last >> 3 << 3) + 8, n)
        level = len(levels)
        whole = "".join(
            [far[level, k] for k in range(start, first)] + digests + [far[level, k] for k in range(last + 1, end)]
        )
        runs = [whole[k : k + 8 * HEX] for k in range(0, len(whole), 8 * HEX)]
        levels.append((start >> 3, runs))
        digests, first, n = [_sha(run) for run in runs], start >> 3, (n + 7) >> 3
    return levels, digests[0]


def _paths(units: DataFrame, nodes: DataFrame, expand, schema: str, extra: DataFrame | None = None) -> DataFrame:
    """``expand(leaves, steps, root, row)`` for each block of leaves.

    ``steps(i)`` are the siblings left and right of leaf ``i`` and of the nodes above it, and ``row`` is that of
    ``extra``, a table with one row a tree.
    """
    blocks = units.withColumn("block", F.expr(f"i div {BLOCK}"))
    parts = blocks.groupBy("tree", "block").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.max("n").alias("n"))
    fetched = (
        _missing(parts)
        .join(nodes.select("tree", "level", "i", "digest"), ["tree", "level", "i"])
        .groupBy("tree", "block")
        .agg(F.collect_list(F.struct("level", "i", "digest")).alias("far"))  # at most 14 a level
    )
    known = parts.select("tree", "block").join(fetched, ["tree", "block"], "left")
    if extra is not None:
        known = known.join(extra, "tree")
    known = known.withColumnsRenamed({"tree": "_tree", "block": "_block"})

    def one_block(leaves: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        leaves, row = leaves.sort_values("i"), known.iloc[0]
        far = {(x["level"], x["i"]): x["digest"] for x in (row["far"] if row["far"] is not None else ())}
        levels, root = _climbed(leaves["digest"].tolist(), int(leaves["i"].iloc[0]), int(leaves["n"].iloc[0]), far)

        def step(level: int, i: int) -> tuple[str, str]:
            first, runs = levels[level]
            run, at = runs[(i >> 3 * level + 3) - first], HEX * (i >> 3 * level & 7)
            return run[:at], run[at + HEX :]

        near = range(min(BLOCK_LEVELS, len(levels)))
        above = [step(k, int(leaves["i"].iloc[0])) for k in range(len(near), len(levels))]  # shared by the block
        return expand(leaves, lambda i: [*[step(k, i) for k in near], *above], root, row)

    return blocks.groupBy("tree", "block").cogroup(known.groupBy("_tree", "_block")).applyInPandas(one_block, schema)


def _upper(leaves: pd.DataFrame, steps, root: str, row) -> pd.DataFrame:
    """The way from each subroot to the root."""
    path = [[{"left": a, "right": b} for a, b in steps(i)] for i in leaves["i"]]
    return pd.DataFrame({"tree": leaves["name"], "root": root, "path": path})


def _lower(proofs: bool):
    def expand(leaves: pd.DataFrame, steps, subroot: str, row) -> pd.DataFrame:
        up = [(x["left"], x["right"]) for x in (row["path"] if row["path"] is not None else ())]
        rest = "".join(a + b for a, b in up)
        out = []
        for doc_id, i, leaf, found in zip(leaves["doc_id"], leaves["i"], leaves["digest"], leaves["found"], strict=True):
            path = steps(i)
            sides = "".join([a + b for a, b in path])
            folded = leaf if found is None else found
            for left, right in [*path, *up]:
                folded = _sha(left + folded + right)
            one = (doc_id, leaf, subroot, row["root"], _sha(sides + rest), folded, folded == row["root"])
            out.append((*one, [{"left": a, "right": b} for a, b in [*path, *up]]) if proofs else one)
        return pd.DataFrame(out, columns=NAMES + ["proof"] * proofs).astype({"doc_id": "Int64"})

    return expand


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaves(docs: DataFrame, found: dict[str, Column] | None = None) -> DataFrame:
    """``tree, doc_id, digest, found`` with the place ``i`` in its tree and the size ``n`` of the tree for every row.

    ``tree`` names the language, so that null is before all others; ``found`` is the digest with the fields
    of that name, or null where it is the same.
    """
    other = leaf_digest(found) if found else F.lit(None).cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest().alias("digest"),
        other.alias("found"),
    )
    rows = kept(rows.withColumn("found", F.when(F.col("found") != F.col("digest"), F.col("found"))), "leaves")
    by = [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("found")]
    order = ranged(rows, [F.col("tree"), *by], "leaf-order")
    sums = {"i": F.lit(1).cast("long")}
    sizes = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    before = totals_before(order, ["tree"], sums).join(sizes, "tree")
    return kept(with_before(order, before, ["tree"], by, sums), "placed-leaves")


def verified(docs: DataFrame, found: dict[str, Column] | None = None, *, proofs: bool = False) -> DataFrame:
    """Builds the manifest of ``docs`` and checks every row against its root.

    Returns for each row ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: the root is also
    recomputed from the leaf that ``found`` gives (columns that stand for fields of the row as they
    are now) and the siblings of the manifest. With ``proofs`` also ``proof``, the siblings left and right of each
    node on the way to the root.

    A null field counts as ``-`` and an empty text as ``0:``; null languages are a tree of their own, before
    the others; null ids come first, rows of one id are in the order of their leaves, and equal rows are
    leaves of their own; a lone row is its own subroot and, if it is the whole table, root, with the proof
    of no siblings; an empty table gives none. Other columns are not looked at.
    """
    placed = leaves(docs, found)
    nodes = _nodes(placed, "nodes")
    subroots = _roots(placed.select("tree", "i", "n", "digest"), nodes)
    tops = prefix_sums(subroots, [], [F.col("tree")], {"i": F.lit(1).cast("long")}, "subroots")
    tops = kept(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "i", "digest"), "upper-leaves")
    tops = tops.withColumn("n", F.lit(tops.count()).cast("long"))
    upper = _paths(tops, _nodes(tops, "upper-nodes"), _upper, f"tree string, root string, path {STEP}")
    schema = RESULT + (f", proof {STEP}" if proofs else "")
    return _paths(placed, nodes, _lower(proofs), schema, kept(upper, "upper-paths"))
