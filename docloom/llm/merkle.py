"""A Merkle manifest of a table: nodes labelled by the interval of leaf ranks that they cover."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import base
from docloom.llm.ordering import ranked, small_or_not, told_apart

#: Children of a node.
ARITY = 16
#: Result columns of :func:`manifest`.
RESULT = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row: each field as its UTF-8 byte count, a colon and its text, or ``-`` where it is null."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


@dataclass
class Forest:
    """The inner nodes of one tree per group.

    ``levels[i]`` holds the nodes of level i + 1: ``_g``, the covered interval ``lo`` to ``hi``, the
    group's number of leaves ``n``, ``kids`` (lo, digest) in order and ``digest``. A group of one
    leaf has a placeholder on level 1 whose only kid is its root. ``roots`` is ``(_g, subroot)``.
    """

    levels: list[DataFrame]
    roots: DataFrame
    arity: int


def forest(leaves: DataFrame, arity: int, label: str) -> Forest:
    """Trees over ``leaves(_g, _rank, digest)``, level by level while a group has more than one node.

    A node of level i covers the ranks of one bucket of ``arity ** i``: its children meet by group and bucket, ``arity``
    of them at most, so no group of rows is long however many leaves a tree has.
    """
    sizes = base.stored(leaves.groupBy("_g").agg((F.max("_rank") + 1).alias("n")), f"{label}-sizes")
    most = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    below = leaves.select("_g", F.col("_rank").alias("lo"), F.col("_rank").alias("hi"), "digest")
    levels, roots, width = [], [], arity
    while True:
        carried = [] if not levels else [F.first("n").alias("n")]
        nodes = below.groupBy("_g", F.expr(f"lo div {width}").alias("bucket")).agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), *carried, F.array_sort(F.collect_list(F.struct("lo", "digest"))).alias("kids"))
        nodes = nodes.withColumn("digest", digest(F.array_join(F.transform("kids", lambda k: k["digest"]), ""))).drop("bucket")
        if not levels:
            nodes = nodes.join(small_or_not(sizes), "_g")
        nodes = base.stored(nodes, f"{label}-level")
        levels.append(nodes)
        top = nodes.where(F.col("n") <= width)
        roots.append(top.select("_g", F.when(F.col("n") == 1, F.col("kids")[0]["digest"]).otherwise(F.col("digest")).alias("subroot")))
        if most <= width:
            break
        below, width = nodes.where(F.col("n") > width), width * arity
    all_roots = roots[0]
    for more in roots[1:]:
        all_roots = all_roots.union(more)
    return Forest(levels, base.stored(all_roots, f"{label}-roots"), arity)


def _step(lo: Column, kids: Column) -> Column:
    """The digests left and right of the child at ``lo``: the parent's interval without the child's own."""
    side = lambda test: F.array_join(F.transform(F.filter(kids, test), lambda k: k["digest"]), "")
    return F.struct(side(lambda k: k["lo"] < lo).alias("left"), side(lambda k: k["lo"] > lo).alias("right"))


def _under(children: DataFrame, parents: DataFrame, width: int, lo: str, hi: str) -> DataFrame:
    """``children`` with the path of their parent and their own step before it.

    Containment of intervals as a join on the bucket of the parents' level. A group's only leaf is
    its root and takes no step.
    """
    p = parents.select(F.col("_g").alias("_pg"), F.expr(f"lo div {width}").alias("_pb"), F.col("lo").alias("_plo"), F.col("hi").alias("_phi"),
                       F.col("n").alias("_pn"), "kids", "subroot", F.col("path").alias("above"))
    held = (F.col("_g") == F.col("_pg")) & (F.expr(f"{lo} div {width}") == F.col("_pb")) & (F.col(lo) >= F.col("_plo")) & (F.col(hi) <= F.col("_phi"))
    path = F.when(F.col("_pn") == 1, F.col("above")).otherwise(F.concat(F.array(_step(F.col(lo), F.col("kids"))), F.col("above")))
    return children.join(p, held).withColumn("path", path).drop("_pg", "_pb", "_plo", "_phi", "_pn", "above")


def paths(trees: Forest, roots: DataFrame) -> DataFrame:
    """The level-1 nodes with ``subroot`` and the ``path`` from them upwards: an array of (left, right).

    ``roots(_g, subroot, path)`` gives what follows above each group's root. From the top down every
    node takes over the path of the node that contains it, so a path is joined once per node and not
    once per leaf.
    """
    found = None
    for level in range(len(trees.levels), 0, -1):
        nodes, width = trees.levels[level - 1], trees.arity ** level
        tops = nodes.where(F.col("n") <= width).select("_g", "lo", "hi", "n", "kids").join(small_or_not(roots, 10_000), "_g")
        if found is not None:
            inner = nodes.where(F.col("n") > width).select("_g", "lo", "hi", "n", F.col("kids").alias("own"))
            inner = _under(inner, found, width * trees.arity, "lo", "hi").select("_g", "lo", "hi", "n", F.col("own").alias("kids"), "subroot", "path")
            tops = inner.unionByName(tops)
        found = tops
    return found


def manifest(df: DataFrame, fields: list[str], group: str = "source", key: str = "doc_id", altered: dict[str, Column] | None = None,
             keep: list[str] | None = None, arity: int = ARITY) -> DataFrame:
    """Every row of ``df``: ``keep`` columns (default ``key``), leaf, subroot, root, proof_sha256, folded_root, verified.

    A row is a leaf: the digest of its ``fields``. Per ``group`` the leaves ascend by ``key``, then
    by digest, nulls first; runs of ``arity`` nodes become their digest while more than one is left.
    The groups' roots, ordered by group (null first, bytewise), give the root in the same way.
    ``proof_sha256`` digests the siblings from the leaf up to the root, left to right. ``altered``
    says how fields read in the copy under test; ``folded_root`` is what that copy's leaf and the
    original siblings give, ``verified`` whether it is the root. Without ``altered`` every row is
    verified. Repeated rows are leaves of their own. An empty table gives an empty one. A kept
    column named like a result column gives way to it; other columns of ``df`` may have any name.

    Leaves of a long group are ranked by a range shuffle that splits it. The longest path has one
    step for every 16-fold of the largest group and of the number of groups.
    """
    spark = df.sparkSession
    keep = [c for c in (keep if keep is not None else [key]) if c.lower() not in RESULT]
    column = lambda c: F.col(f"`{c}`")
    leaf = leaf_digest([column(c) for c in fields])
    changed = [~column(c).eqNullSafe(v) for c, v in (altered or {}).items()]
    other = F.lit(None).cast("string")
    if changed:
        any_changed = changed[0]
        for c in changed[1:]:
            any_changed = any_changed | c
        other = F.when(any_changed, leaf_digest([(altered or {}).get(c, column(c)) for c in fields]))
    rows = df.select(told_apart(column(group)).alias("_g"), column(key).alias("_key"), F.struct(*[column(c) for c in keep] or [F.lit(0)]).alias("_row"),
                     leaf.alias("digest"), other.alias("_altered"))
    leaves = ranked(rows, ["_key", "digest"], "leaves")
    trees = forest(leaves, arity, "tree")

    # The groups' roots are the leaves of one more tree.
    subroots = ranked(trees.roots.select(F.lit("").alias("_g"), F.col("_g").alias("_of"), F.col("subroot").alias("digest")), ["_of"], "subroots")
    top = forest(subroots, arity, "top")
    root_row = top.roots.first()
    root = F.lit(root_row["subroot"] if root_row else None).cast("string")
    nowhere = spark.createDataFrame([("",)], "_g STRING").select("_g", F.lit(None).cast("string").alias("subroot"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    above = _under(subroots.select("_g", "_of", "_rank", "digest"), paths(top, nowhere), arity, "_rank", "_rank")
    above = base.stored(above.select(F.col("_of").alias("_g"), F.col("digest").alias("subroot"), "path"), "above")

    placed = _under(leaves.select("_g", "_rank", "_row", F.col("digest").alias("leaf"), "_altered"), paths(trees, above), arity, "_rank", "_rank")
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    folded = F.aggregate("path", F.col("_altered"), lambda at, s: digest(F.concat(s["left"], at, s["right"])))
    done = placed.select("_row.*", "leaf", "subroot", root.alias("root"), proof.alias("proof_sha256"),
                         F.when(F.col("_altered").isNull(), F.aggregate("path", F.col("leaf"), lambda at, s: digest(F.concat(s["left"], at, s["right"])))).otherwise(folded).alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root")).select(*keep, *RESULT)
