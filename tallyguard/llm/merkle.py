"""Merkle manifest of a table: one tree per source, one tree over the sources, a proof per row.

Sibling-shift self-joins: at every level the node in slot 0 of a run of ``ARITY`` computes the
indices of its siblings by slot offsets, an equijoin on (tree, index) fetches their digests, and
the slot-zero rows emit the parents.  Indices are unique, so no join key is hot however large a
source is; every level is a sixteenth of the one below.  Proofs are handed down from the root:
a run adds its own digests to the chain of the run above it, and each leaf reads one chain.

Defined results
---------------
Any column may be null: it is hashed as ``-``.  A null id sorts first and is never tampered with.
Repeated ids and repeated rows are leaves of their own: equal ids are ordered by leaf digest.  A null
source is a source and comes first.  A lone leaf is its own subroot, a lone subroot the root; a row
without any sibling has the hash of the empty text as proof.  An empty table gives no rows.  Columns
besides the five hashed ones are ignored, whatever their names.  Texts are hashed whole, in the JVM.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ordering import numbered

ARITY = 16
BITS = 4  # of a slot: ARITY is 2 ** BITS
DIGEST = 32
BLOCK = 1024
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _sized(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """The digest of a row as bytes, optionally with another text."""
    parts = [_sized(text if c == "text" and text is not None else F.col(c)) for c in LEAF_COLUMNS]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tampered_with(doc_id: Column) -> Column:
    """Every fifth id by checksum; a null id never."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its digest, and the digest after tampering where that happens.

    The only step that reads texts.
    """
    lower = F.translate(F.col("text"), string.ascii_uppercase, string.ascii_lowercase)
    return docs.select(
        "doc_id",
        "source",
        leaf_digest().alias("digest"),
        F.when(tampered_with(F.col("doc_id")), leaf_digest(lower)).alias("tampered"),
    )


def _runs(nodes: DataFrame) -> DataFrame:
    """The runs of one level: the digests of their members in order, and the parent's digest.

    ``nodes`` has ``tree``, ``idx``, ``digest`` and ``n``, the nodes of the tree on this level.
    """
    last = F.least(F.col("idx") + (ARITY - 1), F.col("n") - 1)
    wanted = nodes.where(F.col("idx") % ARITY == 0).select(
        "tree", "n", F.explode(F.sequence(F.col("idx"), last)).alias("idx")
    )
    members = wanted.join(nodes.select("tree", "idx", "digest"), ["tree", "idx"])
    found = members.groupBy("tree", "n", F.shiftright("idx", BITS).alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("members")
    )
    joined = F.aggregate("members", F.lit(b""), lambda acc, m: F.concat(acc, m["digest"]))
    return found.select("tree", "run", F.ceil(F.col("n") / ARITY).alias("n"), joined.alias("run_digests")).withColumn(
        "digest", F.unhex(F.sha2(F.lower(F.hex("run_digests")).cast("binary"), 256))
    )


def _climb(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The runs of all levels, lowest first; ``most`` is the size of the largest tree."""
    levels = []
    while most > 1:
        runs = cut(_runs(nodes.where("n > 1")), f"merkle-level-{len(levels)}")
        levels.append(runs)
        nodes = runs.select("tree", F.col("run").alias("idx"), "n", "digest")
        most = -(-most // ARITY)
    return levels


def _roots(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The digest that remains of each tree."""
    tops = [nodes.where("n = 1"), *[runs.where("n = 1") for runs in levels]]
    return reduce(DataFrame.unionByName, [t.select("tree", "digest") for t in tops])


def _chains(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Per run of the lowest level, the runs on the way to the root, lowest first.

    ``above`` has one row per tree: ``chain``, the runs on the way from its root, and the digests
    that hold for all of it.  ``depth`` counts the levels inside the tree.
    """
    chains = None
    for runs in reversed(levels):
        at_top = runs.where("n = 1").join(above, "tree").withColumn("depth", F.lit(0))
        if chains is not None:
            inner = runs.where("n > 1").withColumn("up", F.shiftright("run", BITS))
            inner = inner.join(chains.withColumnRenamed("run", "up"), ["tree", "up"])
            at_top = at_top.unionByName(inner.select(*at_top.columns))
        chains = cut(
            at_top.select(
                "tree", "run", "subroot", "root",
                F.concat(F.array("run_digests"), "chain").alias("chain"),
                (F.col("depth") + 1).alias("depth"),
            ),
            "merkle-chains",
        )
    return chains


def _hex(column: str) -> Column:
    return F.lower(F.hex(column))


def build(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: leaf, subroot, root, its proof, and the root folded from its leaf.

    ``folded_root`` starts from the tampered leaf where the row was tampered with, so ``verified``
    is false exactly for rows whose text the tampering changed.
    """
    placed = numbered(cut(leaves(docs), "merkle-leaves"), ["source"], ["doc_id", "digest"])
    placed = cut(placed, "merkle-placed")
    sources = cut(placed.groupBy("source").agg(F.max("n").alias("rows")), "merkle-sources")
    order = cut(
        numbered(sources, [], ["source"], "tree").select("source", "tree", F.col("n").alias("n_trees")), "merkle-order"
    )
    sizes = sources.agg(F.max("rows"), F.count("*")).first()

    # A hot source is only joined with its own number: one row per source.
    nodes = cut(_with_tree(placed, order), "merkle-nodes")
    levels = _climb(nodes, sizes[0] or 0)
    subroots = _roots(nodes, levels).join(order.select("tree", "n_trees"), "tree")
    top = cut(
        subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.col("n_trees").alias("n"), "digest"),
        "merkle-subroots",
    )
    top_levels = _climb(top, sizes[1])
    root = _roots(top, top_levels).withColumnRenamed("digest", "root")

    no_chain = F.array().cast("array<binary>")
    # The root is one row.
    by_tree = top.join(F.broadcast(root), "tree").select(
        F.col("idx").alias("tree"), F.col("digest").alias("subroot"), "root"
    )
    if top_levels:
        start = root.select("tree", F.lit(None).cast("binary").alias("subroot"), "root", no_chain.alias("chain"))
        top_chains = _chains(top_levels, start).select(F.col("run").alias("up"), "chain")
        above = by_tree.withColumn("up", F.shiftright("tree", BITS)).join(top_chains, "up").drop("up")
    else:
        above = by_tree.withColumn("chain", no_chain)
    above = cut(above.select("tree", "subroot", "root", "chain"), "merkle-above")

    lone = above.join(nodes.where("n = 1").select("tree"), "tree").select(
        "tree", F.lit(0).cast("bigint").alias("run"), "subroot", "root", "chain", F.lit(0).alias("depth")
    )
    chains = _chains(levels, above).unionByName(lone) if levels else lone
    return _proofs(nodes, chains)


def _with_tree(placed: DataFrame, order: DataFrame) -> DataFrame:
    """Leaves with the number of their source's tree, as nodes.

    Only the first leaf of each ``BLOCK`` places meets the table of sources; the others meet that
    leaf by (source, block), so a hot source is dealt over many tasks.
    """
    block = F.floor(F.col("idx") / BLOCK)
    heads = placed.where(F.col("idx") % BLOCK == 0).select(F.col("source").alias("_source"), block.alias("_block"))
    numbers = order.select(F.col("source").alias("_key"), "tree")
    heads = heads.join(numbers, F.col("_source").eqNullSafe(F.col("_key"))).drop("_key")
    same = F.col("source").eqNullSafe(F.col("_source")) & (block == F.col("_block"))
    return placed.join(heads, same).select("tree", "idx", "n", "doc_id", "digest", "tampered")


def _proofs(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """Walk each leaf's chain: the siblings on both sides of its slot, and the folded digest."""
    rows = nodes.withColumn("run", F.shiftright("idx", BITS)).join(chains, ["tree", "run"])
    # The slot on each level comes from the place in the tree, beyond its root from the tree's number.
    path = F.expr(
        f"""transform(chain, (run_digests, level) -> struct(
            lower(hex(run_digests)) as digests,
            cast(if(level < depth, shiftright(idx, least(level, 15) * {BITS}),
                shiftright(tree, greatest(least(level - depth, 15), 0) * {BITS})) % {ARITY} as int) as slot))"""
    )
    width = 2 * DIGEST
    path = F.transform(
        path,
        lambda p: F.struct(
            F.substr(p["digests"], F.lit(1), p["slot"] * width).alias("left"),
            F.substr(p["digests"], (p["slot"] + 1) * width + 1).alias("right"),
        ),
    )
    start = F.lower(F.hex(F.coalesce("tampered", "digest")))
    folded = F.aggregate("path", start, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]).cast("binary"), 256))
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    return (
        rows.withColumn("path", path)
        .select(
            "doc_id",
            _hex("digest").alias("leaf"),
            _hex("subroot").alias("subroot"),
            _hex("root").alias("root"),
            F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
            folded.alias("folded_root"),
        )
        .withColumn("verified", F.col("folded_root") == F.col("root"))
        .select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    )
