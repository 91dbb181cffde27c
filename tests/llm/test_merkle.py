from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lorewell.llm import merkle
from lorewell.llm.placing import placed


def H(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[c] for c in merkle.FIELDS)))


def plain_tree(leaves):
    """(root, proofs): every level in full."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    proofs = []
    for i in range(len(leaves)):
        path = []
        for nodes in levels[:-1]:
            run = i // 3 * 3
            path.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
            i //= 3
        proofs.append(path)
    return levels[-1][0], proofs


def plain(rows):
    """{(key, leaf): [(subroot, path)]} and the root."""
    groups = {}
    for r in rows:
        groups.setdefault((r["source"] is not None, r["source"] or ""), []).append((r["doc_id"], plain_leaf(r)))
    names = sorted(groups, key=lambda g: (g[0], g[1].encode()))
    trees = {}
    for name in names:
        ordered = sorted(groups[name], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[name] = ordered, *plain_tree([leaf for _, leaf in ordered])
    root, above = plain_tree([trees[name][1] for name in names])
    out = []
    for name, upper in zip(names, above):
        ordered, subroot, proofs = trees[name]
        out += [(k, leaf, subroot, tuple(x for pair in path + upper for x in pair)) for (k, leaf), path in zip(ordered, proofs)]
    return out, root


def some_documents(spark, n, sources):
    rows = [(i * 7 % (n + 3), f"text {i}\nof {i % 5}\n", "en" if i % 3 else None, sources[i % len(sources)], i) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def order(found):
    return sorted(found, key=repr)


@pytest.mark.parametrize("every", [1, 2, 6])
@pytest.mark.parametrize("n, sources", [(1, ["a"]), (3, [None]), (10, ["a"]), (28, ["b", None, "", "é", "z"]), (250, ["a"] * 9 + ["b"])])
def test_proofs_equal_those_of_the_full_tree(spark, n, sources, every):
    docs = some_documents(spark, n, sources)
    manifest = merkle.build(docs, every=every)
    wanted, root = plain(docs.collect())
    assert manifest.root == root
    found = [(r["key"], r["leaf"], r["subroot"], tuple(r["path"])) for r in merkle.proofs(manifest).collect()]
    assert order(found) == order(wanted)
    assert all(merkle.fold(leaf, path) == root for _, leaf, _, path in found)


def test_only_the_wanted_proofs(spark):
    docs = some_documents(spark, 300, ["a", "a", None])
    manifest = merkle.build(docs, every=2)
    ids = spark.createDataFrame([(7,), (14,), (14,), (None,), (999_999,)], "key bigint")
    found = merkle.proofs(manifest, ids).collect()
    assert sorted(r["key"] for r in found) == [7, 14]
    assert all(merkle.fold(r["leaf"], r["path"]) == manifest.root for r in found)


def test_stored_levels_shrink(spark):
    manifest = merkle.build(some_documents(spark, 250, ["a"]), every=2)
    assert [level.count() for level in manifest.sources] == [250, 28, 4, 1]


def test_a_changed_leaf_does_not_lead_to_the_root(spark):
    docs = some_documents(spark, 60, ["a", "b"])
    manifest = merkle.build(docs, claim=lambda c: {"text": F.when(c["doc_id"] < 20, F.upper(c["text"])).otherwise(c["text"])})
    found = merkle.check(manifest).collect()
    assert len(found) == 60
    assert all((r["folded_root"] == manifest.root) == (r["key"] >= 20) for r in found)


def test_odd_documents(spark, odd_documents, empty_documents):
    wanted, root = plain(odd_documents.collect())
    manifest = merkle.build(odd_documents)
    assert manifest.root == root
    found = [(r["key"], r["leaf"], r["subroot"], tuple(r["path"])) for r in merkle.proofs(manifest).collect()]
    assert order(found) == order(wanted)
    nothing = merkle.build(empty_documents)
    assert nothing.root is None and merkle.check(nothing).count() == 0 and merkle.proofs(nothing).count() == 0


def test_one_repeated_row_is_spread(spark):
    rows = spark.range(4000).select(F.lit("g").alias("g"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the ranges themselves are looked at
    try:
        found = placed(rows, "g", ["v"], F.col("v"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["position"] for r in found.collect()) == list(range(4000))
    assert found.filter("before != position or n != 4000 or total != 4000").count() == 0
    parts = found.sparkSession.read.parquet(*{f.rsplit("/", 1)[0] for f in found.inputFiles()})
    assert parts.groupBy("__run").count().agg(F.max("count")).first()[0] < 2000
