"""Places in groups and Merkle manifests against plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tradewind.llm.merkle import folded, leaf_digest, merkle_manifest, proof_digest
from tradewind.llm.numbering import numbered


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, arity):
    """The root and, per leaf, the pairs of what is hashed left and right of its ancestors."""
    paths, nodes, owner = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(nodes) > 1:
        for i, o in enumerate(owner):
            run = o - o % arity
            paths[i].append(("".join(nodes[run:o]), "".join(nodes[o + 1 : run + arity])))
        nodes = [digest(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        owner = [o // arity for o in owner]
    return nodes[0], paths


def manifest_in_python(rows, arity):
    """(part, id, leaf, subroot, root, path) of (part, id, leaf) rows."""
    parts = {}
    for part, key, leaf in rows:
        parts.setdefault(part, []).append((key is not None, key, leaf))
    order = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {}
    for part in order:
        members = sorted(parts[part], key=lambda m: (m[0], m[1] or 0, m[2]))
        trees[part] = (members, *tree([m[2] for m in members], arity))
    root, above = tree([trees[p][1] for p in order], arity)
    return sorted(
        (str(part), str(key), leaf, trees[part][1], root, str([*path, *above[k]]))
        for k, part in enumerate(order)
        for (_, key, leaf), path in zip(trees[part][0], trees[part][2], strict=True)
    )


def plain(df):
    return sorted(
        (str(r.part), str(r.id), r.leaf, r.subroot, r.root, str([(s.left, s.right) for s in r.path])) for r in df.collect()
    )


ROWS = [("hot", i % 70) for i in range(90)] + [(None, 1), (None, None), ("", 5), ("é", 9), ("Z", 3), ("z", 3)]
ROWS += [(f"p{i % 5}", i) for i in range(23)]


@pytest.mark.parametrize(("arity", "levels"), [(2, 8), (2, 2), (3, 1), (5, 2)])
def test_manifest_is_that_of_a_plain_tree(spark, arity, levels):
    rows = [(p, k, digest(str(p), str(k))) for p, k in ROWS]
    given = spark.createDataFrame(rows, "part string, id long, leaf string").repartition(5)
    got = merkle_manifest(given, "part", "id", arity=arity, levels=levels)
    assert plain(got) == manifest_in_python(rows, arity)
    bad = got.where(folded(F.col("leaf"), F.col("path")) != F.col("root"))
    assert bad.count() == 0
    other = got.where(folded(F.sha2("leaf", 256), F.col("path")) == F.col("root"))
    assert other.count() == 0


def test_a_lone_leaf_is_the_root(spark):
    leaf = digest("x")
    given = spark.createDataFrame([("a", 1, leaf)], "part string, id long, leaf string")
    row = merkle_manifest(given, "part", "id").withColumn("proof", proof_digest(F.col("path"))).first()
    assert (row.subroot, row.root, row.path, row.proof) == (leaf, leaf, [], digest(""))


def test_leaves_tell_nulls_and_borders_apart(spark):
    rows = [(1, "a", None), (1, None, "a"), (1, "1:a", ""), (1, "1", "a"), (None, "-", "é")]
    given = spark.createDataFrame(rows, "id long, x string, y string")
    got = [r[0] for r in given.select(leaf_digest([F.col("id"), F.col("x"), F.col("y")])).collect()]
    assert got == [digest("1:1", "1:a", "-"), digest("1:1", "-", "1:a"), digest("1:1", "3:1:a", "0:"), digest("1:1", "1:1", "1:a"), digest("-", "1:-", "2:é")]


def test_places_in_groups_of_any_size(spark):
    rows = [("hot", 7)] * 300 + [("hot", i) for i in range(50)] + [(None, None), (None, 2), ("a", 1)]
    given = spark.createDataFrame(rows, "g string, v long").repartition(9)
    got = numbered(given, ["g"], ["v"]).collect()
    by_group = {}
    for r in got:
        by_group.setdefault(r.g, []).append((r.slot, r.v, r.n))
    assert len(got) == len(rows)
    for members in by_group.values():
        members.sort()
        assert [m[0] for m in members] == list(range(len(members))) and {m[2] for m in members} == {len(members)}
        values = [m[1] for m in members]
        assert values == sorted(values, key=lambda v: (v is not None, v or 0))


def test_hot_part_is_spread(spark):
    """No exchange of the plan is by part alone."""
    rows = [("hot", i, digest(str(i))) for i in range(600)]
    got = merkle_manifest(spark.createDataFrame(rows, "part string, id long, leaf string"), "part", "id", levels=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(tree" in plan and "SinglePartition" not in plan
    assert "Window" in plan and "lag(" in plan and "lead(" in plan
