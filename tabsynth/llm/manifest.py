"""A Merkle manifest of a dataset, with a version of the tree for each changed row.

Rows are leaves of one tree for each source, and the sources' roots are leaves of a tree above them. Trees are cut into
aligned blocks of 3 ** levels nodes; a block is one task's work and its root is a node of the next table, so a source of
any size is hashed by many tasks. A changed leaf doesn't rebuild anything: within its block it makes a version of a persistent
tree that copies the leaf's ancestors and shares all other nodes, and the version goes on above the block along the path
that the block's root has to the top.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsynth.llm.common import shuffle_partitions, written

ARITY, LEVELS = 3, 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
RANGE_ROWS = 200_000
PATH = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class PathCopyTree:
    """Nodes of all versions in one arena. A version is the number of its root; nodes are never changed."""

    def __init__(self, leaves: list[str], levels: int | None = None):
        """levels: as many as are hashed even where one node is left. Without it: until one is left."""
        self.hashes, self.kids, self.depth = list(leaves), [()] * len(leaves), 0
        row = list(range(len(leaves)))
        while self.depth < levels if levels is not None else len(row) > 1:
            row = [self._node(tuple(row[k : k + ARITY])) for k in range(0, len(row), ARITY)]
            self.depth += 1
        self.root = row[0]

    def _node(self, kids: tuple[int, ...]) -> int:
        self.hashes.append(digest("".join([self.hashes[k] for k in kids])))
        self.kids.append(kids)
        return len(self.hashes) - 1

    def _ancestors(self, root: int, leaf: int) -> list[tuple[int, int]]:
        """(node, which of its children leads to the leaf), from the root down."""
        out, node = [], root
        for level in range(self.depth - 1, -1, -1):
            at = leaf // ARITY**level % ARITY
            out.append((node, at))
            node = self.kids[node][at]
        return out

    def siblings(self, root: int, leaf: int) -> list[tuple[str, str]]:
        """What stands left and right of the leaf's ancestor in its run, from the leaf's level up."""
        runs = [(self.kids[n], at) for n, at in reversed(self._ancestors(root, leaf))]
        return [("".join([self.hashes[k] for k in kids[:at]]), "".join([self.hashes[k] for k in kids[at + 1 :]])) for kids, at in runs]

    def replaced(self, root: int, leaf: int, value: str) -> int:
        """The version of root in which a leaf has another hash: its ancestors are copied, all else is shared."""
        self.hashes.append(value)
        self.kids.append(())
        node = len(self.hashes) - 1
        for old, at in reversed(self._ancestors(root, leaf)):
            kids = self.kids[old]
            node = self._node((*kids[:at], node, *kids[at + 1 :]))
        return node


def _tree(nodes: pd.DataFrame, levels: int) -> PathCopyTree:
    """The tree of one block, whose nodes are in order. A block that is all of its g ends with one node, others after `levels` levels."""
    return PathCopyTree(nodes["h"].tolist(), levels if int(nodes["n"].iloc[0]) > ARITY**levels else None)


def leaf_hash(fields: dict[str, Column]) -> Column:
    """Null is `-`; others are their UTF-8 length, a colon and the value."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields.values()]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def without_line_ends(docs: DataFrame) -> Column:
    """The tampering that the query checks: where 2 divides the CRC of doc_id, the text loses its line feeds."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with i, the place in g from 0 by order, and n, the size of g. rows is read more than once: a written table.

    Rows are dealt to ranges of all order columns and of their place in the table, so neither a large g nor rows that repeat make one task.
    """
    spark, by = rows.sparkSession, ["g", *order, "_at"]
    parts = max(1, min(2 * shuffle_partitions(spark), rows.count() // 1000 + 1), rows.count() // RANGE_ROWS)
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = written(dealt.withColumns({"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    within = Window.partitionBy("g")
    sizes = placed.groupBy("g", "_part").agg(F.min("_pos").alias("_first"), F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(within.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_c").over(within).alias("n"))
    return placed.join(starts, ["g", "_part"]).withColumn("i", F.col("_pos") + F.col("_shift")).drop("_at", "_part", "_pos", "_shift")


def _block(levels: int) -> Column:
    return F.floor(F.col("i") / ARITY**levels).cast("long").alias("b")


def _grown(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Tables of block roots (g, i, n, h), one above the other, until each g has one node, whose n is 1."""

    def root(rows: pd.DataFrame) -> pd.DataFrame:
        rows, block = rows.sort_values("i"), ARITY**levels
        tree = _tree(rows, levels)
        return pd.DataFrame({"g": [rows["g"].iloc[0]], "i": [int(rows["i"].iloc[0]) // block], "n": [-(-int(rows["n"].iloc[0]) // block)], "h": [tree.hashes[tree.root]]})

    out, level = [], nodes.select("g", "i", "n", "h")
    while True:
        out.append(written(level.groupBy("g", _block(levels)).applyInPandas(root, "g string, i long, n long, h string"), "nodes"))
        level = out[-1].where("n > 1")
        if not level.limit(1).count():
            return out


def _paths(tables: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """g, i, path, subroot, root of the lowest table's nodes: path has the siblings up to the top. top: the same of each g's last node."""

    def own(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes, up = nodes.sort_values("i"), above.iloc[0]
        tree = _tree(nodes, levels)
        rest = [(x["left"], x["right"]) for x in up["path"]]
        path = [tree.siblings(tree.root, k) + rest for k in range(len(nodes))]
        return pd.DataFrame({"g": nodes["g"], "i": nodes["i"], "path": path, "subroot": up["subroot"], "root": up["root"]})

    schema = f"g string, i long, path {PATH}, subroot string, root string"
    found = top
    for k in range(len(tables) - 1, -1, -1):
        last = tables[k].where("n = 1").select("g").join(top, "g").select("g", F.lit(0).cast("long").alias("i"), "path", "subroot", "root")
        if k == len(tables) - 1:
            found = last
            continue
        below = tables[k].where("n > 1").groupBy("g", _block(levels)).cogroup(found.groupBy("g", "i")).applyInPandas(lambda a, b: own(a, b) if len(a) else a.iloc[:0].assign(path=None, subroot=None, root=None)[["g", "i", "path", "subroot", "root"]], schema)
        found = written(last.unionByName(below), "paths")
    return found


def merkle_manifest(docs: DataFrame, changed: Column | None = None, text: str = "text", copies: bool = False, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row; with copies also the hashes that its version adds.

    docs: doc_id, source, lang, n_chars, text; other columns are left out. changed: the text as it is found now (by default as it
    was); a row whose text differs gets a version of its own, and folded_root is that version's root. Null values are fields
    like any other: a null source comes first, and so does a null doc_id within a source. Repeated rows are a leaf each; rows
    with one doc_id are ordered by their leaves. An empty table has no rows. A text of any length is hashed in one row.
    """
    fields = {c: F.col(text if c == "text" else c) for c in COLUMNS}
    leaf, now = leaf_hash(fields), leaf_hash(fields | {"text": fields["text"] if changed is None else changed})
    # a source of its own text: null sorts below all, and keys are never null
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("g"), leaf.alias("h"), now.alias("now"))
    leaves = _ranked(written(rows.withColumn("now", F.when(F.col("now") != F.col("h"), F.col("now"))), "leaves"), ["doc_id", "h"])
    leaves = written(leaves, "leaves-ranked")
    tables = _grown(leaves, levels)
    subroots = tables[0].where("n = 1").select("g", "h")
    for nodes in tables[1:]:
        subroots = subroots.unionByName(nodes.where("n = 1").select("g", "h"))
    # the sources' roots are the leaves of one more tree
    tops = _ranked(written(subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "h"), "subroots"), ["of"])
    tops = written(tops, "subroots-ranked")
    upper = _grown(tops, levels)
    root = upper[-1].where("n = 1").select("g", F.array().cast(PATH).alias("path"), F.col("h").alias("subroot"), F.col("h").alias("root"))
    above = _paths(upper, root, levels)
    top = written(_leaf_paths(tops, above, levels), "paths")
    paths = _paths(tables, top, levels)

    def prove(nodes: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        nodes, up = nodes.sort_values("i"), up.iloc[0]
        tree = _tree(nodes, levels)
        rest = [(x["left"], x["right"]) for x in up["path"]]
        after = "".join([a + b for a, b in rest]).encode()
        proofs, folded, added = [], [], []
        for k, (was, now) in enumerate(zip(nodes["h"].tolist(), nodes["now"].tolist(), strict=True)):
            proof = sha256("".join([a + b for a, b in tree.siblings(tree.root, k)]).encode())
            proof.update(after)
            first = len(tree.hashes)
            version = tree.hashes[tree.replaced(tree.root, k, now if isinstance(now, str) else was)]
            new = tree.hashes[first:]
            for left, right in rest:  # the version goes on above the block
                version = digest(left + version + right)
                new.append(version)
            # a version is read once here; the arena needn't keep it
            del tree.hashes[first:], tree.kids[first:]
            proofs.append(proof.hexdigest())
            folded.append(version)
            added.append(new)
        out = pd.DataFrame({"doc_id": nodes["doc_id"], "leaf": nodes["h"], "subroot": up["subroot"], "root": up["root"], "proof_sha256": proofs, "folded_root": folded})
        return out.assign(verified=out["folded_root"] == out["root"], **({"copies": added} if copies else {}))

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", copies array<string>" * copies
    return leaves.groupBy("g", _block(levels)).cogroup(paths.groupBy("g", "i")).applyInPandas(prove, schema)


def _leaf_paths(tops: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """g, path, subroot, root of each source: its siblings among the sources' roots."""

    def own(nodes: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        nodes, up = nodes.sort_values("i"), up.iloc[0]
        tree = _tree(nodes, levels)
        rest = [(x["left"], x["right"]) for x in up["path"]]
        path = [tree.siblings(tree.root, k) + rest for k in range(len(nodes))]
        return pd.DataFrame({"g": nodes["of"], "path": path, "subroot": nodes["h"], "root": up["root"]})

    return tops.groupBy("g", _block(levels)).cogroup(above.groupBy("g", "i")).applyInPandas(own, f"g string, path {PATH}, subroot string, root string")
