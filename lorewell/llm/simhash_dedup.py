"""SimHash fingerprints and their near-duplicate groups, by a Gray-ordered hierarchical index.

1. A text gets a 64-bit fingerprint from its word shingles; equal fingerprints become one before anything is compared.
2. A fingerprint is cut in `distance + 2` bit blocks. Two fingerprints that differ in at most `distance` bits agree in at
   least two whole blocks, so they meet under at least one pair of blocks (15 pairs for distance 4). The pair and its
   bits are the shuffle key; nothing is compared across keys and no link can be missed.
3. Within a key the fingerprints stand in Gray order, in which neighbours share most bits. Runs of codes become nodes and
   runs of nodes upper nodes; a node keeps the bits all its codes share, as (mask, value). Two nodes are compared by
   `popcount((value_a ^ value_b) & mask_a & mask_b)`, the differences accumulated so far: above the limit the whole
   pair of groups is dropped, else its children are compared, down to the codes.
4. Keys with more than `block` fingerprints are cut into runs of their Gray order. Runs are nodes too: they meet in
   pairs, and pairs of runs whose shared bits already differ too much are never built.
5. A task emits a spanning forest of its links, never all pairs, and the components come from star contraction.

Edge cases: NULL and empty texts have fingerprint zero, which links like any other. Repeated rows share a group.
Rows without id join groups by their fingerprint; a group without any id has component NULL.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm import words
from lorewell.llm.common import per_text
from lorewell.session import materialize

SHINGLE, DISTANCE = 4, 4
SEED = 42
#: Fingerprints of one key that one task compares.
BLOCK = 2048
LEAF, FAN = 8, 8

_ONE = np.uint64(1)


def fingerprint_values(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of a slice of texts, as unsigned 64-bit integers."""
    w = words.split(texts, lower=True)
    values = w.data[w.mask]
    lengths = w.ends - w.starts
    # the words joined by single blanks, so that a shingle is one piece of it
    at = np.concatenate(([0], np.cumsum(lengths + 1)))
    joined = np.full(int(at[-1]), 32, np.uint8)
    inside = np.ones(int(at[-1]), bool)
    inside[at[1:] - 1] = False
    joined[inside] = values
    counts = np.diff(w.first)
    heads = np.concatenate((words.windows(w.first, shingle), w.first[:-1][(counts > 0) & (counts < shingle)]))
    text = np.searchsorted(w.first, heads, "right") - 1
    order = np.argsort(heads, kind="stable")
    heads, text = heads[order], text[order]
    tails = np.minimum(heads + shingle, w.first[text + 1])
    buffer, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(buffer[a:b], SEED) for a, b in zip(at[heads].tolist(), (at[tails] - 1).tolist())),
        np.uint64, len(heads),
    )
    out = np.zeros(len(counts), np.uint64)
    if len(heads):
        having, begin = np.unique(text, return_index=True)
        size = np.diff(np.concatenate((begin, [len(heads)])))
        for bit in range(64):
            ones = np.add.reduceat(((hashes >> np.uint64(bit)) & _ONE).astype(np.int64), begin)
            out[having] |= (2 * ones > size).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE):
    """The documents as struct `row` with their fingerprint `fp` (the 64 bits as a signed number)."""
    return per_text(docs, text, lambda t: [fingerprint_values(t, shingle).view(np.int64)], "fp bigint", keep)


def hex_digits(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp) if isinstance(fp, str) else fp)), 16, "0")


def bit_blocks(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of distance + 2 blocks that cover 64 bits."""
    edges = np.linspace(0, 64, distance + 3).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges, edges[1:])]


def keyed(codes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Every code under each pair of blocks: (fp, bucket, rank). `bucket` is the pair and its bits.

    `rank` is the place in the Gray order of the code without the blocks of the key, which all its codes share, as
    a signed number that sorts alike.
    """
    masks = [
        sum(((1 << width) - 1) << low for low, width in pair) for pair in combinations(bit_blocks(distance), 2)
    ]
    pairs = F.array(*[
        F.struct(F.lit(number).alias("pair"), F.lit(mask - 2**64 if mask >= 2**63 else mask).alias("mask"))
        for number, mask in enumerate(masks)
    ])
    out = codes.select("fp", F.explode(pairs).alias("e"))
    out = out.select(
        "fp", F.struct("e.pair", F.col("fp").bitwiseAND(F.col("e.mask")).alias("bits")).alias("bucket"),
        F.col("fp").bitwiseAND(F.bitwise_not("e.mask")).alias("rank"),
    )
    for shift in (1, 2, 4, 8, 16, 32):
        out = out.withColumn("rank", F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", shift)))
    return out.withColumn("rank", F.col("rank").bitwiseXOR(F.lit(-(2**63))))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class _Level:
    """Consecutive nodes over codes: the range of children and the bits that all codes below share."""

    def __init__(self, begin: np.ndarray, end: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.begin, self.end = begin, end
        # ones: bits set in every code below; zeros: bits clear in every code below
        self.ones, self.zeros = np.bitwise_and.reduceat(ones, begin), np.bitwise_and.reduceat(zeros, begin)

    def far(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Whether the accumulated differences of the shared bits exceed the limit."""
        differ = (self.ones[a] & self.zeros[b]) | (self.zeros[a] & self.ones[b])
        return _popcount(differ) > limit


def _runs(begin: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges cut into runs of `size`: (begin, end) of the runs and the number of runs by range."""
    n = -(-(end - begin) // size)
    first = np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(begin, n) + (np.arange(int(n.sum())) - first) * size
    return at, np.minimum(at + size, np.repeat(end, n)), n


def _pairs_within(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j), i <= j, among the consecutive members of each group of `count` members."""
    size = count.astype(np.int64)
    base = np.cumsum(size) - size
    member = np.arange(int(size.sum()))
    left = np.repeat(base + size, size) - member
    first = np.repeat(np.cumsum(left) - left, left)
    a = np.repeat(member, left)
    return a, a + np.arange(int(left.sum())) - first


def _children(level: _Level, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of a and a child of b."""
    na, nb = level.end[a] - level.begin[a], level.end[b] - level.begin[b]
    total = na * nb
    first = np.repeat(np.cumsum(total) - total, total)
    k = np.arange(int(total.sum())) - first
    width = np.repeat(nb, total)
    return np.repeat(level.begin[a], total) + k // width, np.repeat(level.begin[b], total) + k % width


#: Pairs compared at one time.
_STEP = 1 << 17


def links(codes: np.ndarray, count: np.ndarray, limit: int):
    """Yields index pairs (i, j), i < j, of codes at most `limit` bits apart.

    `codes` holds consecutive groups of `count` codes, each in Gray order; only codes of one group are compared.
    """
    end = np.cumsum(count)
    begin = end - count
    leaf_begin, leaf_end, leaves = _runs(begin, end, LEAF)
    top_end = np.cumsum(leaves)
    top_begin, top_stop, tops = _runs(top_end - leaves, top_end, FAN)
    leaf = _Level(leaf_begin, leaf_end, codes, ~codes)
    top = _Level(top_begin, top_stop, leaf.ones, leaf.zeros)
    a, b = _pairs_within(tops)
    close = ~top.far(a, b, limit)
    a, b = a[close], b[close]
    for k in range(0, len(a), _STEP // (FAN * FAN)):
        x, y = _children(top, a[k : k + _STEP // (FAN * FAN)], b[k : k + _STEP // (FAN * FAN)])
        close = (x <= y) & ~leaf.far(x, y, limit)
        i, j = _children(leaf, x[close], y[close])
        near = i < j
        i, j = i[near], j[near]
        near = _popcount(codes[i] ^ codes[j]) <= limit
        yield i[near], j[near]


def forest(size: int, found) -> tuple[np.ndarray, np.ndarray]:
    """(members, roots) of the groups that the links form among `size` places; members differ from their root."""
    root = np.arange(size)
    for i, j in found:
        while True:
            a, b = root[i], root[j]
            low = np.minimum(a, b)
            if (a == b).all():
                break
            np.minimum.at(root, np.maximum(a, b), low)
            while True:  # pointer jumping
                up = root[root]
                if (up == root).all():
                    break
                root = up
    members = np.flatnonzero(root != np.arange(size))
    return members, root[members]


def _link_sorted(batches, limit: int):
    """Arrow batches (key, fp) sorted by (key, rank) to edges of a spanning forest; a key may span batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def work(key: np.ndarray, fp: np.ndarray):
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.concatenate((new, [len(key)])))
        busy = np.repeat(count > 1, count)
        codes = fp[busy]
        if not len(codes):
            return None
        members, roots = forest(len(codes), links(codes.view(np.uint64), count[count > 1], limit))
        if not len(members):
            return None
        return pa.RecordBatch.from_arrays([pa.array(codes[members]), pa.array(codes[roots])], schema=schema)

    def settled(final: bool):
        """Work on all keys but the last, which may go on in the next batch."""
        nonlocal held
        key, fp = np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held])
        others = np.flatnonzero(key != key[-1])
        cut = len(key) if final else (int(others[-1]) + 1 if len(others) else 0)
        held = [(key[cut:], fp[cut:])] if cut < len(key) else []
        return work(key[:cut], fp[:cut]) if cut else None

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column("key").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False)))
        if (edges := settled(False)) is not None:
            yield edges
    if held and (edges := settled(True)) is not None:
        yield edges


def _meet(rows: DataFrame, key: list[Column], limit: int) -> DataFrame:
    """Link the rows (fp, rank, ...) that share the key columns."""
    named = rows.select(*[k.alias(f"k{i}") for i, k in enumerate(key)], "fp", "rank")
    keys = [f"k{i}" for i in range(len(key))]
    placed = named.repartition(*keys).sortWithinPartitions(*keys, "rank", "fp")
    # one number per key within a task: a change of any key column starts a new one
    number = F.xxhash64(*keys)
    return placed.select(number.alias("key"), "fp").mapInArrow(lambda b: _link_sorted(b, limit), "a bigint, b bigint")


def edges(codes: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct codes (column fp) that connect all codes within `distance` bits of each other."""
    rows = keyed(codes, distance)
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(sizes.filter(F.col("n") > block), "simhash-hot")
    n_hot = hot.agg(F.sum("n")).first()[0]
    if not n_hot:
        return _meet(rows, [F.col("bucket.pair"), F.col("bucket.bits")], distance)
    cold = rows.join(hot.select("bucket"), "bucket", "left_anti")
    found = _meet(cold, [F.col("bucket.pair"), F.col("bucket.bits")], distance)
    crowded = rows.join(hot.select("bucket"), "bucket", "left_semi")
    return found.unionByName(_hot_edges(crowded, distance, -(-2 * n_hot // block)))


def _hot_edges(rows: DataFrame, distance: int, n_runs: int) -> DataFrame:
    """The same links within crowded keys, by pairs of runs of their Gray order.

    The rows are cut into `n_runs` runs of about equal size over (key, rank). Each run is a node with the bits its
    codes share, and runs form upper nodes. Only pairs whose shared bits differ in at most `distance` places are
    built, first of upper nodes, then of runs.
    """
    placed = materialize(
        rows.repartitionByRange(n_runs, "bucket", "rank").withColumn("run", F.spark_partition_id()), "simhash-runs"
    )
    shared = [F.bit_and("ones").alias("ones"), F.bit_and("zeros").alias("zeros")]
    bits = placed.select("bucket", "run", F.col("fp").alias("ones"), F.bitwise_not("fp").alias("zeros"))
    runs = materialize(
        bits.groupBy("bucket", "run").agg(*shared).withColumn("upper", F.floor(F.col("run") / 64)), "simhash-nodes"
    )
    upper = runs.groupBy("bucket", "upper").agg(*shared)
    pairs = _close_pairs(upper, "upper", distance)
    for side in ("lo", "hi"):
        inner = runs.select("bucket", F.col("upper").alias(f"upper_{side}"),
                            F.struct("run", "ones", "zeros").alias(f"node_{side}"))
        pairs = pairs.join(inner, ["bucket", f"upper_{side}"])
    near = pairs.filter((F.col("node_lo.run") <= F.col("node_hi.run")) & _close("node_lo", "node_hi", distance))
    routes = near.select(
        "bucket", F.col("node_lo.run").alias("lo"), F.col("node_hi.run").alias("hi"),
        F.explode(F.array_distinct(F.array("node_lo.run", "node_hi.run"))).alias("run"),
    )
    met = placed.join(routes, ["bucket", "run"])
    return _meet(met, [F.col("bucket.pair"), F.col("bucket.bits"), F.col("lo"), F.col("hi")], distance)


def _close(a: str, b: str, distance: int) -> Column:
    """Whether the bits shared inside two nodes differ in at most `distance` places."""
    one_zero = F.col(f"{a}.ones").bitwiseAND(F.col(f"{b}.zeros"))
    zero_one = F.col(f"{a}.zeros").bitwiseAND(F.col(f"{b}.ones"))
    return F.bit_count(one_zero.bitwiseOR(zero_one)) <= distance


def _close_pairs(nodes: DataFrame, name: str, distance: int) -> DataFrame:
    """(bucket, name_lo, name_hi) of the node pairs of a key that may hold links."""
    sides = [
        nodes.select("bucket", F.struct(F.col(name).alias("at"), "ones", "zeros").alias(side)) for side in ("lo", "hi")
    ]
    met = sides[0].join(sides[1], "bucket").filter((F.col("lo.at") <= F.col("hi.at")) & _close("lo", "hi", distance))
    return met.select("bucket", F.col("lo.at").alias(f"{name}_lo"), F.col("hi.at").alias(f"{name}_hi"))


def components(links: DataFrame, name: str = "simhash") -> DataFrame:
    """(node, root) of every node of the links (a, b), root being the smallest node it can reach.

    Alternates large and small stars until nothing changes; each round is written, so a lost executor
    costs at most one round, and a node's neighbours are only ever aggregated, never collected.
    """
    pairs = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(),
        f"{name}-edges",
    )
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), f"{name}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                              F.col("m").alias("v"))
        pairs = materialize(small.filter("u <> v").distinct(), f"{name}-small")
        mark = tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        if mark == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark


def _classes(marked: DataFrame, distance: int, block: int) -> DataFrame:
    """(fp, first, root) of the distinct fingerprints of (doc_id, fp): smallest doc_id, and smallest linked code."""
    codes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-codes")
    roots = components(edges(codes.select("fp"), distance, block))
    return codes.join(roots, codes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    shingle: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK,
) -> DataFrame:
    """One row per document: doc_id, fp, and component_id, the smallest doc_id it can reach over links."""
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marked = materialize(
        fingerprints(narrow, "text", ["doc_id"], shingle).select("row.doc_id", "fp"), "simhash-fingerprints"
    )
    grouped = _classes(marked, distance, block)
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = grouped.join(smallest, "root").select(F.col("fp").alias("code"), "component_id")
    return marked.join(classes, marked["fp"] == classes["code"]).select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    shingle: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK,
) -> DataFrame:
    """One document of each component, with its own columns: the smallest doc_id's (rows without id come last).

    Fingerprints are computed a second time beside the kept rows, which is cheaper than storing the texts again.
    """
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marked = materialize(
        fingerprints(narrow, "text", ["doc_id"], shingle).select("row.doc_id", "fp"), "simhash-fingerprints"
    )
    grouped = _classes(marked, distance, block)
    best = F.min_by(F.struct(F.col("first").alias("id"), F.col("fp").alias("code")),
                    F.struct(F.col("first").isNull(), "first", "fp"))
    chosen = materialize(grouped.groupBy("root").agg(best.alias("b")).select("b.*"), "simhash-chosen")
    rows = fingerprints(docs, text, None, shingle)
    mine = F.col(f"row.`{doc_id}`")
    kept = rows.join(chosen, (rows["fp"] == chosen["code"]) & mine.eqNullSafe(F.col("id")), "left_semi")
    # only rows repeated under one id and fingerprint are left to tell apart
    again = materialize(
        marked.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
            F.col("doc_id").alias("again_id"), F.col("fp").alias("again_fp")
        ),
        "simhash-repeated",
    )
    if again.isEmpty():
        return kept.select("row.*")
    same = (F.col("fp") == F.col("again_fp")) & mine.eqNullSafe(F.col("again_id"))
    body = F.col(f"row.`{text}`")
    several = kept.join(again, same, "left_semi").groupBy(mine.alias("id"), "fp")
    first = several.agg(F.min_by("row", F.struct(body.isNull(), body)).alias("row"))
    return kept.join(again, same, "left_anti").select("row.*").unionByName(first.select("row.*"))
