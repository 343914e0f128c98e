"""Operator 11: a Merkle manifest of a table by exchange of subtrees.

Leaves are ranked within their source, and 729 consecutive ones, six levels of the tree,
are a superblock. A superblock is folded to one node in one task, and the nodes of a source
are again ranked leaves of superblocks, until each source has one; the sources are the
leaves of a last tree. On the way back superblocks meet the outer nodes of their path to the
root by a cogroup: one task repeats the fold of its superblock, joins inner and outer
siblings to proofs, and folds every leaf up to the root.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rank_within, written

RUN = 3
HEIGHT = 6
BLOCK = RUN**HEIGHT
#: Siblings left and right of a node, level by level up to the root.
PATH = "array<struct<before:string,after:string>>"
NODE = "g string, place long, digest string"
OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def joined_digest(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def field(value: Column) -> Column:
    """``-`` of a null, else byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    fields = [*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text]
    return F.sha2(F.concat(*map(field, fields)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """g (the source, a null one first), doc_id, leaf, changed (the leaf after tampering)."""
    text = F.col("text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("g"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest(text).alias("leaf"),
        F.when(tampered, leaf_digest(F.replace(text, F.lit("\n"), F.lit("")))).alias("changed"),
    ).withColumn("changed", F.coalesce("changed", "leaf"))


def levels_of(digests: list[str], height: int | None = None) -> list[list[str]]:
    """Levels of a tree over ``digests``: ``height`` of them, or until one node is left."""
    levels = [digests]
    while len(levels[-1]) > 1 if height is None else len(levels) <= height:
        last = levels[-1]
        levels.append([joined_digest("".join(last[i : i + RUN])) for i in range(0, len(last), RUN)])
    return levels


def inner_steps(levels: list[list[str]]) -> list[list[tuple[str, str]]]:
    """Per leaf the siblings before and after each node on its way to the top of ``levels``."""
    beside = []
    for level in levels[:-1]:
        runs = [level[i - i % RUN : i - i % RUN + RUN] for i in range(len(level))]
        beside.append([("".join(run[: i % RUN]), "".join(run[i % RUN + 1 :])) for i, run in enumerate(runs)])
    return [[steps[i // RUN**up] for up, steps in enumerate(beside)] for i in range(len(levels[0]))]


def folded(digest: str, steps: list[tuple[str, str]]) -> str:
    for before, after in steps:
        digest = joined_digest(before + digest + after)
    return digest


class Round(NamedTuple):
    """Nodes (g, place, digest), and by source the number of superblocks they make."""

    nodes: DataFrame
    blocks: DataFrame


def with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place div {BLOCK}"))


def reduce_blocks(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """The node above every superblock; the only one of its source is folded to a single node."""

    def run(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        digests = held.sort_values("place")["digest"].tolist()
        rows = [(*key, levels_of(digests)[-1][0], levels_of(digests, HEIGHT)[-1][0])]
        return pd.DataFrame(rows, columns=["g", "place", "alone", "full"])

    tops = with_block(nodes.select("g", "place", "digest")).groupBy("g", "block")
    both = tops.applyInPandas(run, "g string, place long, alone string, full string")
    digest = F.when(F.col("blocks") == 1, F.col("alone")).otherwise(F.col("full"))
    return both.join(blocks, "g").select("g", "place", digest.alias("digest"))


def climb(nodes: DataFrame) -> tuple[list[Round], DataFrame]:
    """Rounds from ``nodes`` (a written table) up, and one node per source."""
    rounds = []
    while True:
        blocks = written(nodes.groupBy("g").agg(F.expr(f"max(place) div {BLOCK} + 1").alias("blocks")), "blocks")
        rounds.append(Round(nodes, blocks))
        nodes = written(reduce_blocks(nodes, blocks), "nodes")
        if not blocks.filter("blocks > 1").limit(1).count():
            return rounds, nodes


def descend(
    nodes: DataFrame, blocks: DataFrame, outer: DataFrame, finish: Callable[[tuple, pd.DataFrame, list, pd.Series], pd.DataFrame], schema: str
) -> DataFrame:
    """Superblocks cogrouped with what lies above them (g, block, path and more columns).

    ``finish`` gets the key, the nodes in order, their inner steps and the outer row.
    """

    def run(key: tuple, held: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        held, row = held.sort_values("place"), above.iloc[0]
        levels = levels_of(held["digest"].tolist(), None if row["alone"] else HEIGHT)
        return finish(key, held, inner_steps(levels), row)

    alone = outer.join(blocks.select("g", (F.col("blocks") == 1).alias("alone")), "g")
    left, right = with_block(nodes).groupBy("g", "block"), alone.groupBy("g", "block")
    return left.cogroup(right).applyInPandas(run, schema)


def outer_steps(row: pd.Series) -> list[tuple[str, str]]:
    return [(step["before"], step["after"]) for step in row["path"]]


def paths(rounds: list[Round], outer: DataFrame) -> DataFrame:
    """(g, block, path, more) of the superblocks of the first of ``rounds``; ``outer`` has them of the tops."""
    more = [f for f in outer.schema.fields if f.name not in ("g", "block", "path")]
    names = [f.name for f in more]
    schema = ", ".join(["g string, block long", f"path {PATH}", *(f"{f.name} {f.dataType.simpleString()}" for f in more)])

    def finish(key: tuple, held: pd.DataFrame, inner: list, row: pd.Series) -> pd.DataFrame:
        beyond = outer_steps(row)
        path = [[{"before": b, "after": a} for b, a in [*steps, *beyond]] for steps in inner]
        made = pd.DataFrame({"g": key[0], "block": held["place"].tolist(), "path": path})
        return made.assign(**{n: row[n] for n in names})

    for nodes, blocks in reversed(rounds[1:]):
        outer = written(descend(nodes.select("g", "place", "digest"), blocks, outer, finish, schema), "paths")
    return outer


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    Null fields count as ``-``; a null source comes first, and a null doc_id is first in its
    source and not tampered with. Rows of one doc_id are ordered by their leaves, repeated
    rows are leaves each for itself, an empty table gives no rows, and other columns are not
    read.
    """
    keyed = leaves(docs).withColumn("_row", F.monotonically_increasing_id())
    ranked = rank_within(keyed, "g", ["doc_id", "leaf", "_row"])
    placed = written(ranked.select("g", F.col("rank").alias("place"), F.col("leaf").alias("digest"), "doc_id", "changed"), "leaves")
    rounds, subroots = climb(placed)
    # The sources are the leaves of one more tree.
    of_source = rank_within(subroots.select(F.lit("").alias("_all"), F.col("g").alias("source"), "digest"), "_all", ["source"])
    of_source = written(of_source.select(F.lit("").alias("g"), F.col("rank").alias("place"), "digest", "source"), "sources")
    source_rounds, root = climb(of_source)
    above = root.select("g", F.lit(0).cast("long").alias("block"), F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    tops = descend(of_source, source_rounds[0].blocks, paths(source_rounds, above), source_paths, f"g string, block long, path {PATH}, subroot string, root string")
    outer = paths(rounds, written(tops, "paths"))
    return descend(placed, rounds[0].blocks, outer, proofs, OUT)


def source_paths(key: tuple, held: pd.DataFrame, inner: list, row: pd.Series) -> pd.DataFrame:
    beyond = outer_steps(row)
    path = [[{"before": b, "after": a} for b, a in [*steps, *beyond]] for steps in inner]
    made = {"g": held["source"].tolist(), "block": 0, "path": path, "subroot": held["digest"].tolist(), "root": row["root"]}
    return pd.DataFrame(made)


def proofs(key: tuple, held: pd.DataFrame, inner: list, row: pd.Series) -> pd.DataFrame:
    """Proof and fold of every leaf of a superblock."""
    beyond = outer_steps(row)
    tail = "".join(before + after for before, after in beyond)
    proof = [joined_digest("".join(b + a for b, a in steps) + tail) for steps in inner]
    ends = [folded(leaf, [*steps, *beyond]) for leaf, steps in zip(held["changed"], inner, strict=True)]
    made = {
        "doc_id": held["doc_id"].astype("Int64").tolist(), "leaf": held["digest"].tolist(), "subroot": row["subroot"], "root": row["root"],
        "proof_sha256": proof, "folded_root": ends, "verified": [end == row["root"] for end in ends],
    }
    frame = pd.DataFrame(made)
    return frame.assign(doc_id=frame["doc_id"].astype("Int64"))
