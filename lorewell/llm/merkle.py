"""Merkle manifest of a dataset: persist only every few levels, regenerate the rest when a proof needs it.

Every row is a leaf, the digest of its fields. Leaves of one source, in the order of their ids, make a tree in which three
consecutive nodes become one; the roots of the sources, in the order of the sources, make a tree of the same form.

1. Leaves get their place within their source by range partitions (`placing`), so a source may hold most of the rows.
2. Only the leaves and every `every`-th level are stored. A task gets one aligned subtree (at most 3^every stored nodes), makes its
   interior levels in memory and stores its top alone; a level is 3^every times smaller than the one below.
3. Proofs go from the root down. Each aligned subtree meets the path of its own top in a co-group, regenerates its missing
   interior nodes from its stored descendants, emits the siblings of each of its stored nodes and discards the interior.
   Paths are held once per subtree; on the lowest level they end in the task, as digests of the proof and of the folded root.

A proof is a list of two strings per level, the digests to the left and to the right of the node within its run of three (either may
be empty: a last run may hold one node alone, which is still hashed).

Edge cases: NULL fields are `-`, empty ones `0:`; a NULL source is a source of its own, before all others; NULL ids come first; equal
ids are ordered by their leaf, rows repeated in all columns are leaves of their own; an empty table has no rows and
the root None; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lorewell.llm.placing import placed
from lorewell.session import materialize

FAN = 3
EVERY = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = ""  # the group of the tree over the sources' roots

NODE = "g string, idx bigint, node string, n bigint"
PATH = "g string, idx bigint, path array<string>, subroot string"
PROOF = "key bigint, leaf string, subroot string, path array<string>"
CHECKED = "key bigint, leaf string, subroot string, proof_sha256 string, folded_root string"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of the fields, each as its length in bytes and its value."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def source_key(source: Column) -> Column:
    """The source as a string without NULLs that sorts as the sources do, NULL first."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def height(n: int) -> int:
    """Levels above the leaves of a tree with n of them."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def interior(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the levels above them."""
    made = [nodes]
    for _ in range(levels):
        below = made[-1]
        made.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return made


def siblings(levels: list[list[str]], i: int) -> list[str]:
    """Left and right siblings of node i of the lowest level, level by level below the topmost."""
    path = []
    for nodes in levels[:-1]:
        run = i - i % FAN
        path += ["".join(nodes[run:i]), "".join(nodes[i + 1 : run + FAN])]
        i //= FAN
    return path


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in zip(path[::2], path[1::2]):
        leaf = digest(left + leaf + right)
    return leaf


@dataclass(frozen=True)
class Manifest:
    """The stored levels of the sources' trees and of the tree above them (lowest first), and the root."""

    sources: list[DataFrame] = field(default_factory=list)
    above: list[DataFrame] = field(default_factory=list)
    root: str | None = None
    every: int = EVERY


def _subtree(table: pa.Table, every: int) -> tuple[list[dict], list[list[str]]]:
    """The stored nodes of one aligned subtree in order, and the levels from them to its top."""
    rows = sorted(table.to_pylist(), key=lambda r: r["idx"])
    return rows, interior([r["node"] for r in rows], min(every, height(rows[0]["n"])))


def _tops(level: DataFrame, every: int) -> DataFrame:
    """The next stored level: the top of each aligned subtree."""
    span, out = FAN**every, to_arrow_schema(StructType.fromDDL(NODE))

    def top(table: pa.Table) -> pa.Table:
        rows, levels = _subtree(table, every)
        made = {"g": rows[0]["g"], "idx": rows[0]["idx"] // span, "node": levels[-1][0], "n": -(-rows[0]["n"] // span)}
        return pa.Table.from_pylist([made], schema=out)

    nodes = level.select("g", "idx", "node", "n", F.expr(f"idx div {span}").alias("subtree"))
    return nodes.groupBy("g", "subtree").applyInArrow(top, NODE)


def _stored(leaves: DataFrame, every: int, name: str) -> list[DataFrame]:
    """Every `every`-th level from the leaves up to the level on which each group has one node, at least one above the leaves."""
    levels = [materialize(leaves, f"{name}-0")]
    while True:
        levels.append(materialize(_tops(levels[-1], every), f"{name}-{len(levels)}"))
        if (levels[-1].agg(F.max("n")).first()[0] or 1) == 1:  # one number; the levels shrink 3^every fold
            return levels


def build(docs: DataFrame, key: str = "doc_id", source: str = "source", fields: tuple[str, ...] = FIELDS, claim: Callable | None = None, every: int = EVERY) -> Manifest:
    """Manifest of `docs`. `claim` maps the leaf's fields (name to column) to the fields that someone shows later;
    the digest of those is stored beside the leaf, so that `check` can fold it. Without it the leaf itself is folded.
    """
    columns = {c: F.col(f"`{c}`") for c in fields}
    leaf = leaf_digest(list(columns.values()))
    shown = leaf if claim is None else leaf_digest(list({**columns, **claim(columns)}.values()))
    rows = docs.select(source_key(F.col(f"`{source}`")).alias("g"), F.col(f"`{key}`").alias("key"), leaf.alias("node"), shown.alias("claim"))
    rows = placed(materialize(rows, "merkle-leaves"), "g", ["key", "node"], name="merkle-order")
    sources = _stored(rows.withColumnRenamed("position", "idx"), every, "merkle-source")
    roots = sources[-1].select(F.lit(TOP).alias("all"), F.col("g").alias("key"), "node")
    order = placed(roots, "all", ["key"], name="merkle-roots").select(F.col("all").alias("g"), "key", "node", "n", F.col("position").alias("idx"))
    above = _stored(order, every, "merkle-above")
    root = above[-1].select("node").first()  # one row
    return Manifest(sources, above, root and root["node"], every)


def _down(level: DataFrame, paths: DataFrame, every: int, emit: Callable[[list[dict], list[list[str]], list[str], str], list[dict]], schema: str, columns: list[str]) -> DataFrame:
    """`emit` for each aligned subtree of a stored level, with the path and the source's root of its top."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def walk(nodes: pa.Table, tops: pa.Table) -> pa.Table:
        if not nodes.num_rows or not tops.num_rows:  # a top without wanted nodes
            return out.empty_table()
        rows, levels = _subtree(nodes, every)
        top = tops.to_pylist()[0]
        return pa.Table.from_pylist(emit(rows, levels, top["path"], top["subroot"]), schema=out)

    nodes = level.select(*columns, F.expr(f"idx div {FAN**every}").alias("subtree"))
    return nodes.groupBy("g", "subtree").cogroup(paths.groupBy("g", "idx")).applyInArrow(walk, schema)


def _paths(manifest: Manifest) -> DataFrame:
    """The path of every node of the lowest stored level above the leaves, with its source's root."""

    def emit(rows, levels, path, subroot):
        return [
            {"g": r["g"], "idx": r["idx"], "path": siblings(levels, i) + path, "subroot": subroot} for i, r in enumerate(rows)
        ]

    def emit_source(rows, levels, path, subroot):  # the leaves of the upper tree are the sources' roots
        return [
            {"g": r["key"], "idx": 0, "path": siblings(levels, i) + path, "subroot": r["node"]} for i, r in enumerate(rows)
        ]

    columns = ["g", "idx", "node", "n"]
    paths = manifest.above[-1].select("g", "idx", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"))
    for level in reversed(manifest.above[1:-1]):
        paths = _down(level, paths, manifest.every, emit, PATH, columns)
    paths = _down(manifest.above[0], paths, manifest.every, emit_source, PATH, [*columns, "key"])
    for level in reversed(manifest.sources[1:-1]):
        paths = _down(level, paths, manifest.every, emit, PATH, columns)
    return paths


def proofs(manifest: Manifest, wanted: DataFrame | None = None, key: str = "key") -> DataFrame:
    """(key, leaf, subroot, path) of the wanted ids (all, if None). Only subtrees that hold a wanted leaf are regenerated."""
    leaves = manifest.sources[0].withColumn("wanted", F.lit(True))
    if wanted is not None:
        subtree = F.expr(f"idx div {FAN**manifest.every}")
        ids = wanted.select(F.col(f"`{key}`").alias("__key"), F.lit(True).alias("__hit")).distinct()
        marked = leaves.join(ids, F.col("key").eqNullSafe(F.col("__key")), "left").withColumn("wanted", F.coalesce("__hit", F.lit(False)))
        kept = marked.filter("wanted").select(F.col("g").alias("__g"), subtree.alias("__s")).distinct()
        leaves = marked.join(kept, (F.col("g") == F.col("__g")) & (subtree == F.col("__s")), "left_semi")

    def emit(rows, levels, path, subroot):
        return [
            {"key": r["key"], "leaf": r["node"], "subroot": subroot, "path": siblings(levels, i) + path}
            for i, r in enumerate(rows) if r["wanted"]
        ]

    return _down(leaves, _paths(manifest), manifest.every, emit, PROOF, ["g", "idx", "node", "n", "key", "wanted"])


def check(manifest: Manifest) -> DataFrame:
    """(key, leaf, subroot, proof_sha256, folded_root) of every leaf: its siblings' digest, and where its claim leads."""

    def emit(rows, levels, path, subroot):
        above = "".join(path)
        out = []
        for i, r in enumerate(rows):
            own = siblings(levels, i)
            folded = fold(fold(r["claim"], own), path)
            out.append({"key": r["key"], "leaf": r["node"], "subroot": subroot, "proof_sha256": digest("".join(own) + above), "folded_root": folded})
        return out

    return _down(manifest.sources[0], _paths(manifest), manifest.every, emit, CHECKED, ["g", "idx", "node", "n", "key", "claim"])
