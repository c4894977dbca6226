"""Merkle manifest of a data set: a digest for each row, a tree of digests for each source, one root over all sources.

A node is (tree, idx, digest, n), n being the nodes of its level. On every level the head of a run (slot zero) computes
the indices of its siblings by slot offsets, meets them in an equijoin, and emits the parent. All of it is column
expressions; each level is a written table a sixteenth as long as the one below, and only the number of levels is known
to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_PATH = "CAST(array() AS array<struct<before:string,after:string>>)"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column) -> Column:
    """sha256 of a row: its five fields, each with its length before it, `text` standing for the column text."""
    return F.sha2(F.concat(*[_field(F.col(c)) for c in FIELDS[:-1]], _field(text)), 256)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` (tree, ...) with `idx`, the 0-based rank of a row in its tree, and `n`, the rows of the tree.

    The rows are dealt by ranges of (tree, order) and written with the number of their range: a rank is the rows of the
    ranges before plus the rank within the range, so no tree is ordered in one task. Rows equal in all of `order` are
    dealt apart by where they were read.
    """
    dealt = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "at")
    dealt = written(dealt.withColumn("part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("here"))
    of_tree = Window.partitionBy("tree")
    sizes = sizes.select("tree", "part", F.sum("here").over(of_tree.orderBy("part")).alias("upto"), "here", F.sum("here").over(of_tree).alias("n"))
    rank = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order, "at"))
    ranked = dealt.withColumn("rank", rank).join(sizes, ["tree", "part"])
    return ranked.withColumn("idx", F.col("upto") - F.col("here") + F.col("rank") - 1).drop("at", "part", "rank", "upto", "here")


def _families(nodes: DataFrame) -> DataFrame:
    """(tree, idx, n, children): the parents one level up and their children's digests from left to right."""
    heads = nodes.where(F.col("idx") % ARITY == 0)
    offsets = F.sequence(F.col("idx"), F.least(F.col("idx") + ARITY - 1, F.col("n") - 1))
    asked = heads.select("tree", "n", (F.col("idx") / ARITY).cast("long").alias("parent"), F.explode(offsets).alias("idx"))
    met = asked.join(nodes.select("tree", "idx", "digest"), ["tree", "idx"])
    run = F.sort_array(F.collect_list(F.struct("idx", "digest")))["digest"]
    up = met.groupBy("tree", F.col("parent").alias("idx")).agg(F.ceil(F.max("n") / ARITY).alias("n"), run.alias("children"))
    return up.select("tree", "idx", "n", "children", F.sha2(F.array_join("children", ""), 256).alias("digest"))


def _climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The families of every level, lowest first, and the last node of every tree with the level it stands on."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    last = nodes.where("n = 1").select("tree", "digest", F.lit(0).alias("level"))
    levels: list[DataFrame] = []
    while most > 1:
        levels.append(written(_families(nodes.where("n > 1")), "families"))
        nodes = levels[-1].select("tree", "idx", "n", "digest")
        last = last.unionByName(nodes.where("n = 1").select("tree", "digest", F.lit(len(levels)).alias("level")))
        most = -(-most // ARITY)
    return levels, last


def _step(slot: Column) -> Column:
    """What stands before and after the child at `slot` (0-based) of the run `children`."""
    before = F.array_join(F.slice("children", F.lit(1), slot), "")
    after = F.array_join(F.slice("children", slot + 2, F.lit(ARITY)), "")
    return F.struct(before.alias("before"), after.alias("after"))


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, idx, path) of the nodes that `levels[0]` groups into runs, or of the parents of those for `levels[1:]`.

    `tops` (tree, level, path) says what stands above the last node of each tree. A path lists the siblings on every
    level from the node up.
    """
    at = [tops.where(F.col("level") == k).select("tree", F.lit(0).cast("long").alias("idx"), "path") for k in range(len(levels) + 1)]
    paths = at[-1]
    for k in range(len(levels) - 1, -1, -1):
        above = levels[k].join(paths, ["tree", "idx"])
        below = above.select("tree", "idx", "children", "path", F.posexplode("children").alias("slot", "child"))
        below = below.select("tree", (F.col("idx") * ARITY + F.col("slot")).alias("idx"), F.concat(F.array(_step(F.col("slot"))), F.col("path")).alias("path"))
        paths = at[k].unionByName(below)
    return paths


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of `docs`.

    `docs` has doc_id, source, lang, n_chars and text; other columns are not looked at. The rows of one source, nulls
    being a source of their own, form a tree in the order of doc_id (nulls first; rows of one id by their digest, and
    equal rows in any order, since their places can be exchanged); the trees' last nodes form the upper tree. Proofs and
    roots are of the table as given. folded_root is computed upwards from the leaf of a row as it is checked: where the
    crc32 of the id is divisible by five with the text in lower case, else as given; `verified` says that the root came
    out. A row without an id is checked as given. Empty texts are values, other than null. An empty table has no rows.
    """
    text = F.col("text").cast("string")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    leaf = leaf_digest(text)
    rows = docs.select(
        tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("digest"),
        F.when(tampered, leaf_digest(F.translate(text, _UPPER, _LOWER))).alias("tampered"),
    )
    rows = written(_numbered(rows, ["doc_id", "digest"]), "leaves")
    levels, subroots = _climbed(rows.select("tree", "idx", "n", "digest"))
    subroots = written(subroots, "subroots")
    upper = _numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), ["source"])
    upper = written(upper, "upper")
    upper_levels, roots = _climbed(upper.select("tree", "idx", "n", "digest"))
    root = (roots.first() or [None, None])[1]

    over = _paths(upper_levels, roots.select("tree", "level", F.expr(_NO_PATH).alias("path")))
    tops = upper.join(over, ["tree", "idx"]).select(F.col("source").alias("tree"), "path")
    tops = written(subroots.join(tops, "tree").select("tree", "level", F.col("digest").alias("subroot"), "path"), "tops")
    # the lowest level is not unfolded: a leaf meets the run it stands in
    lone = tops.where("level = 0").select("tree", F.lit(0).cast("long").alias("run"), F.lit(None).cast("array<string>").alias("children"), "path")
    runs = lone
    if levels:
        higher = tops.where("level > 0").select("tree", (F.col("level") - 1).alias("level"), "path")
        met = levels[0].join(_paths(levels[1:], higher), ["tree", "idx"])
        runs = met.select("tree", F.col("idx").alias("run"), "children", "path").unionByName(lone)
    slot = (F.col("idx") % ARITY).cast("int")
    path = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat(F.array(_step(slot)), F.col("path")))
    found = rows.withColumn("run", (F.col("idx") / ARITY).cast("long")).join(runs, ["tree", "run"]).withColumn("path", path)
    fold = F.aggregate("path", F.coalesce("tampered", "digest"), lambda up, s: F.sha2(F.concat(s["before"], up, s["after"]), 256))
    told = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    found = found.select("tree", "doc_id", F.col("digest").alias("leaf"), F.sha2(told, 256).alias("proof_sha256"), fold.alias("folded_root"))
    found = found.join(tops.select("tree", "subroot"), "tree").withColumn("root", F.lit(root).cast("string"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
