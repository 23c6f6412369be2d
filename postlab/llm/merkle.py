"""A manifest of a table as a content-addressed Merkle DAG, with proofs found by descent from the root.

Every row is a leaf, the SHA-256 of its fields. The leaves of a group (a source) ascend by identifier; each run of
``FAN_OUT`` consecutive nodes is hashed to a parent until one node, the subroot, is left. The subroots of all groups, in
the order of the groups, are the leaves of one more tree, whose top is the root.

Stored are digest-to-children records. A record holds ``LEVELS`` levels of children below its digest, up to 729 nodes at the
lowest, so a tree of 10^10 leaves is four records high, and no task handles more of a tree at once. Requests for leaves
descend from the root by the digits of their rank: a step takes the nodes reached so far, looks their records up by digest,
follows the digits that some request has, and collects the children that are not followed. Requests that share a
node travel as one row until they part, so the root is looked up once, not once per leaf. At the leaf the path segments,
collected from the top, stand in reverse: lowest level first.

Numbering the leaves is a range sort; a hot group is many records and many rows, never one task. Everything is
DataFrame work: the records are arrays of digests, paths and folds are higher-order functions of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab.operators.position import with_position
from postlab.session import stored

FAN_OUT = 3
#: Levels of children in one record.
LEVELS = 6
WIDTH = FAN_OUT ** LEVELS
_POWERS = [FAN_OUT ** j for j in range(LEVELS + 1)]


def field(value: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def hashed(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the joined parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


@dataclass
class Manifest:
    """``leaves``: (tree, rank, digest and the columns that were carried along); ``groups``: (tree, rank, subroot);
    ``records``/``group_records``: one table for each step of descent, lowest first; ``root``: (root)."""

    leaves: DataFrame
    groups: DataFrame
    records: list[DataFrame]
    group_records: list[DataFrame]
    root: DataFrame


def _climb(nodes: str) -> Column:
    """The levels above an array of digests, the lowest first, up to the only node of level ``height``."""
    return F.expr(f"""
        aggregate(slice(sequence(1, {LEVELS}), 1, height), array({nodes}), (levels, j) -> concat(levels, array(
            transform(sequence(0, (size(element_at(levels, -1)) - 1) div {FAN_OUT}), i ->
                sha2(array_join(slice(element_at(levels, -1), {FAN_OUT} * i + 1, {FAN_OUT}), ''), 256)))))""")


def _grow(nodes: DataFrame) -> list[DataFrame]:
    """Records of all trees over ``nodes`` (tree, rank, digest): (tree, prefix, digest, levels, open), step by step.

    ``open`` says that the tree goes on above the record. Trees of a single node have a record without children.
    """
    steps: list[DataFrame] = []
    while True:
        runs = nodes.groupBy("tree", F.expr(f"rank div {WIDTH}").alias("prefix")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"]).alias("nodes"))
        sizes = runs.select("tree", "prefix").groupBy("tree").agg(F.max("prefix").alias("last"))
        counted = runs.join(sizes.withColumnRenamed("tree", "_tree"), F.col("tree").eqNullSafe(F.col("_tree")))
        high = sum(((F.size("nodes") > p).cast("int") for p in _POWERS[1:LEVELS]), (F.size("nodes") > 1).cast("int"))
        levels = counted.withColumn("open", F.col("last") > 0).withColumn(
            "height", F.when(F.col("open"), LEVELS).otherwise(high)).withColumn("levels", _climb("nodes"))
        step = stored(levels.select(
            "tree", "prefix", F.expr("element_at(levels, -1)[0]").alias("digest"), "levels", "open"), "merkle")
        steps.append(step)
        if step.where("open").isEmpty():
            return steps
        nodes = step.where("open").select("tree", F.col("prefix").alias("rank"), "digest")


def _tops(steps: list[DataFrame]) -> DataFrame:
    """(tree, digest, step) of the top record of every tree."""
    found = None
    for number, step in enumerate(steps):
        top = step.where(~F.col("open")).select("tree", "digest", F.lit(number).alias("step"))
        found = top if found is None else found.unionAll(top)
    return found


def build(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source",
          carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``: a leaf hashes ``columns`` in the order given.

    ``carry`` adds columns to ``leaves``, computed from ``docs``. Null groups are a group of their own, before all others;
    a null identifier stands before all others of its group; rows that repeat an identifier follow by their leaf, so equal
    rows are interchangeable. An empty table gives empty tables.
    """
    leaf = hashed(*[field(F.col(c)) for c in columns]).alias("digest")
    rows = stored(docs.select(
        F.col(group_col).alias("tree"), F.col(id_col).alias("leaf_id"), leaf,
        *[value.alias(name) for name, value in (carry or {}).items()]), "leaves")
    order = [F.col("leaf_id").asc_nulls_first(), F.col("digest")]
    leaves = with_position(rows, order, ["tree"], "rank").withColumn("rank", F.col("rank") - 1)
    records = _grow(leaves.select("tree", "rank", "digest"))
    tops = with_position(_tops(records), [F.col("tree").asc_nulls_first()], name="rank").withColumn(
        "rank", F.col("rank") - 1)
    group_records = _grow(tops.select(F.lit(0).alias("tree"), "rank", "digest"))
    root = _tops(group_records).select(F.col("digest").alias("root"))
    return Manifest(leaves, tops.select("tree", "rank", F.col("digest").alias("subroot"), "step"),
                    records, group_records, root)


def _segment(digit: str) -> Column:
    """The siblings on the way from a record's digest to its ``digit``-th lowest node, lowest level first."""
    at = f"({digit} div element_at(array({', '.join(map(str, _POWERS))}), j + 1))"
    return F.expr(f"""
        transform(slice(levels, 1, size(levels) - 1), (nodes, j) -> named_struct(
            'left', array_join(slice(nodes, {at} - {at} % {FAN_OUT} + 1, {at} % {FAN_OUT}), ''),
            'right', array_join(slice(nodes, {at} + 2, {FAN_OUT - 1} - {at} % {FAN_OUT}), '')))""")


def _descend(steps: list[DataFrame], starts: DataFrame, requests: DataFrame, payload: list[str | Column],
             keep: list[str]) -> DataFrame:
    """Paths of ``requests`` (tree, rank, payload): ``payload``, ``keep`` (columns of ``starts``) and ``path``.

    ``starts`` (tree, digest, step, path, keep) has the top of each tree and the path above it.
    """
    wanted = requests.select(F.col("tree").alias("_tree"), "rank", F.struct(*payload).alias("payload"))
    reached = None
    for number in range(len(steps) - 1, -1, -1):
        here = starts.where(F.col("step") == number).select("tree", F.lit(0).cast("bigint").alias("prefix"),
                                                            "digest", "path", *keep)
        reached = here if reached is None else reached.unionAll(here)
        scale = WIDTH ** number
        digits = wanted.select(
            "_tree", F.expr(f"rank div {scale * WIDTH}L").alias("_prefix"),
            F.expr(f"cast(rank div {scale}L % {WIDTH} as int)").alias("digit"),
            (F.col("payload") if number == 0 else F.lit(None)).alias("payload"))
        if number:
            digits = digits.distinct()
        followed = digits.groupBy("_tree", "_prefix").agg(F.collect_list(F.struct("digit", "payload")).alias("asked"))
        records = steps[number].select(F.col("digest").alias("_digest"), "levels").dropDuplicates(["_digest"])
        met = (reached
               .join(followed, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("prefix") == F.col("_prefix")))
               .join(records, F.col("digest") == F.col("_digest"))
               .select("tree", "prefix", "levels", "path", *keep, F.explode("asked").alias("ask"))
               .withColumn("path", F.concat(_segment("ask.digit"), "path")))
        reached = met.select(
            "tree", (F.col("prefix") * WIDTH + F.col("ask.digit")).alias("prefix"),
            F.expr("levels[0][ask.digit]").alias("digest"), "path", *keep,
            *([F.col("ask.payload").alias("payload")] if number == 0 else []))
    return reached.select("payload.*", *keep, "path")


def prove(manifest: Manifest, requests: DataFrame, payload: list[str | Column]) -> DataFrame:
    """For each request (tree, rank, ``payload``) the payload, ``subroot``, ``root`` and ``path``.

    The path has an entry per level from the leaf to the root: the joined digests of the siblings to the ``left`` and to
    the ``right``. Requests for ranks that the tree does not have give no row.
    """
    none = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    last = len(manifest.group_records) - 1
    top = manifest.root.select(F.lit(0).alias("tree"), F.col("root").alias("digest"), F.lit(last).alias("step"),
                               none.alias("path"), "root")
    groups = manifest.groups.select(F.lit(0).alias("tree"), "rank", F.col("tree").alias("group"), "subroot", "step")
    starts = stored(_descend(manifest.group_records, top, groups, ["group", "subroot", "step"], ["root"]).select(
        F.col("group").alias("tree"), F.col("subroot").alias("digest"), "step", "path", "subroot", "root"), "subroots")
    return _descend(manifest.records, starts, requests, payload, ["subroot", "root"])


def proof_hash(path: Column) -> Column:
    """SHA-256 of all siblings on a path, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "").cast("binary"), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, leaf, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]).cast("binary"), 256))
