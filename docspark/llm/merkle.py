"""A Merkle manifest of the documents, with a version of the tree for every tampered leaf.

Leaves are numbered by language and doc_id; aligned blocks of 1024 leaves are trees of their own, built in one task each, and
their roots are the leaves of the next level, until a language has one node; the languages' roots make the top tree in the
same way. The way down carries, block by block, the siblings on the path to the root. In a block a tampered leaf makes a
version that copies the leaf's ancestors and shares every other node; above the block the version goes on along the block's
own path, so versions stay spread over all blocks, whatever their number.

Defined cases: null fields are `-`; a null doc_id sorts first and is never tampered; equal doc_ids stand in the order of their
leaves, and rows equal in all fields each have a place of their own; a null lang is a language, the first one; an empty table
gives no rows. Other columns of the documents, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import join_by_key, materialize, tasks
from docspark.llm.crcsql import CRC32_TABLE, crc32_sql

#: Levels of a block, which has 1024 leaves.
LEVELS = 10
#: Rows of a range partition at most, about, while leaves are numbered.
RANGE_ROWS = 1_000_000
TAMPER = 7
NODE = "key string, pos long, digest string, n long"


def _hash(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


class PathCopyTree:
    """A binary hash tree over leaves, two by two from the left (a last one alone), whose changes are versions.

    `change` never touches a node: it adds copies of the changed leaf's ancestors and a root, and all else is shared. Version 0
    is the first tree.
    """

    def __init__(self, leaves: list[str], height: int):
        self.height, self.digest, self.kids = height, [], []
        row = [self._add(x, ()) for x in leaves]
        for _ in range(height):
            row = [self._join(tuple(row[i : i + 2])) for i in range(0, len(row), 2)]
        self.roots = row

    def _add(self, digest: str, kids: tuple[int, ...]) -> int:
        self.digest.append(digest)
        self.kids.append(kids)
        return len(self.digest) - 1

    def _join(self, kids: tuple[int, ...]) -> int:
        return self._add(_hash(*(self.digest[k] for k in kids)), kids)

    def trail(self, at: int) -> list[tuple[int, int]]:
        """Nodes on the way from the root of version 0 to a leaf, with the side taken, the leaf's parent first."""
        node, out = self.roots[0], []
        for h in range(self.height - 1, -1, -1):
            side = at >> h & 1
            out.append((node, side))
            node = self.kids[node][side]
        return out[::-1]

    def path(self, at: int) -> str:
        """The siblings from the leaf up: L or R and the digest of the one on that side, `-` where a node is alone."""
        out = []
        for node, side in self.trail(at):
            kids = self.kids[node]
            out.append("-" if len(kids) == 1 else f"{'RL'[side]}{self.digest[kids[1 - side]]}")
        return "".join(out)

    def change(self, at: int, leaf: str) -> list[int]:
        """A new version with another leaf: the nodes that it adds, leaf first and its root last."""
        added = [self._add(leaf, ())]
        for node, side in self.trail(at):
            kids = self.kids[node]
            added.append(self._join((added[-1],) if len(kids) == 1 else (kids[0], added[-1]) if side else (added[-1], kids[1])))
        self.roots.append(added[-1])
        return added


def steps(path: str) -> list[str]:
    """The steps of a path: `-`, or a side and a digest."""
    out, i = [], 0
    while i < len(path):
        j = i + (1 if path[i] == "-" else 65)
        out.append(path[i:j])
        i = j
    return out


def climb(digest: str, path: list[str]) -> list[str]:
    """The digests of the ancestors of a node along its path."""
    out = []
    for step in path:
        digest = _hash(digest) if step == "-" else _hash(step[1:], digest) if step[0] == "L" else _hash(digest, step[1:])
        out.append(digest)
    return out


def height(n: int, levels: int = LEVELS) -> int:
    """Levels of a block's tree in a group of n nodes: all of them where the group has more blocks, else up to one node."""
    return levels if n > 1 << levels else (n - 1).bit_length()


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, tamper: int = TAMPER) -> DataFrame:
    """key (language: empty for null, else behind `=`), doc_id, leaf, tampered (the leaf with n_chars + 1 where the rule asks for it, else null)."""
    number = F.col("n_chars").cast("decimal(20,0)")
    of = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source"), "lang": F.col("lang"), "n_chars": number, "text": F.col("text")}
    leaf = F.sha2(F.concat(*map(_field, of.values())).cast("binary"), 256)
    other = F.sha2(F.concat(*map(_field, (of | {"n_chars": number + 1}).values())).cast("binary"), 256)
    chosen = F.crc32(of["doc_id"].cast("string").cast("binary")) % tamper == 0
    key = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select(key.alias("key"), of["doc_id"].alias("doc_id"), leaf.alias("leaf"), F.when(chosen, other).alias("tampered"))


def numbered(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Adds `place`, from 0, in a total order over all rows: numbers inside range partitions and the sizes of those before.

    Equal rows are told apart by their own numbers, so that a large group of them doesn't stay in one partition.
    """
    parts = max(tasks(rows.sparkSession), -(-n // RANGE_ROWS))
    order = [*order, F.col("_row")]
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_row")
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_inside", inside), "merkle-order")
    # a row a partition, so a window over them all and a broadcast are bounded by their number
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")).select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    return ranged.join(F.broadcast(sizes), "_part").withColumn("place", F.col("_base") + F.col("_inside")).drop("_part", "_inside", "_base")


def _with_block(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", levels))


def _tree(group: pa.Table, levels: int) -> PathCopyTree:
    return PathCopyTree(group["digest"].to_pylist(), height(group["n"][0].as_py(), levels))


def lifted(nodes: DataFrame, levels: int) -> DataFrame:
    """The roots of the blocks: nodes of the next level. Groups that have one node pass as they are."""

    def root(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        tree, n = _tree(group, levels), -(-group["n"][0].as_py() // (1 << levels))
        return pa.table({"key": group["key"].slice(0, 1), "pos": group["block"].slice(0, 1), "digest": [tree.digest[tree.roots[0]]], "n": pa.array([n], pa.int64())})

    up = _with_block(nodes.where("n > 1").select("key", "pos", "digest", "n"), levels).groupBy("key", "block").applyInArrow(root, NODE)
    return up.unionByName(nodes.where("n = 1").select("key", "pos", "digest", "n"))


def forest(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all groups' trees in blocks, the given nodes first, and the tops: one node a group."""
    rows, n = [], nodes.agg(F.max("n")).first()[0] or 1
    while n > 1:
        rows.append(nodes)
        nodes, n = materialize(lifted(nodes, levels), "merkle-level"), -(-n // (1 << levels))
    return rows, nodes


def _joined_to_block(nodes: DataFrame, above: DataFrame, make: Callable[[pa.Table, pa.Table], pa.Table], schema: str, levels: int) -> DataFrame:
    return _with_block(nodes, levels).groupBy("key", "block").cogroup(above.withColumnRenamed("pos", "block").groupBy("key", "block")).applyInArrow(make, schema)


ABOVE = "key string, pos long, path string, subroot string, root string"


def descended(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """Every node's path to the root: its own in the block, then that of the block (above: a row a block)."""

    def paths(group: pa.Table, up: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        tree, rest, n = _tree(group, levels), up["path"][0].as_py(), len(group)
        return pa.table({"key": group["key"], "pos": group["pos"], "path": [tree.path(i) + rest for i in range(n)], "subroot": [up["subroot"][0].as_py()] * n, "root": [up["root"][0].as_py()] * n})

    return _joined_to_block(nodes.select("key", "pos", "digest", "n"), above, paths, ABOVE, levels)


MANIFEST = "doc_id long, key string, pos long, leaf string, tampered string, subroot string, root string, proof string, copied string, folded_root string"


def _versions(group: pa.Table, up: pa.Table, levels: int) -> pa.Table:
    group = group.sort_by("pos")
    tree, rest = _tree(group, levels), up["path"][0].as_py()
    further, shared = steps(rest), [*climb(tree.digest[tree.roots[0]], steps(rest))]
    proofs, copies, folded = [], [], []
    for i, leaf in enumerate(group["tampered"].to_pylist()):
        proofs.append(tree.path(i) + rest)
        if leaf is None:  # its version is the first: all nodes are shared
            copies.append(None)
            folded.append(shared[-1] if shared else tree.digest[tree.roots[0]])
            continue
        own = [tree.digest[k] for k in tree.change(i, leaf)]
        own += climb(own[-1], further)
        copies.append("".join(own[1:]))
        folded.append(own[-1])
    n = len(group)
    return pa.table({
        "doc_id": group["doc_id"], "key": group["key"], "pos": group["pos"], "leaf": group["digest"], "tampered": group["tampered"], "subroot": [up["subroot"][0].as_py()] * n,
        "root": [up["root"][0].as_py()] * n, "proof": proofs, "copied": pa.array(copies, pa.string()), "folded_root": folded})


def manifest(docs: DataFrame, tamper: int = TAMPER, levels: int = LEVELS) -> DataFrame:
    """A row a document: doc_id, key, pos (place in its language), leaf, tampered, subroot, root, proof (the path: see PathCopyTree.path),
    copied (the digests of the version's own ancestors from the leaf's parent to the root; null where nothing is tampered), folded_root
    (the root of the document's version).
    """
    found = materialize(leaves(docs, tamper), "merkle-leaves")
    n = found.count()
    if not n:
        return docs.sparkSession.createDataFrame([], MANIFEST)
    order = [F.col("key"), F.asc_nulls_first("doc_id"), F.col("leaf")]
    placed = numbered(found, order, n)
    starts = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("start"))
    base = join_by_key(placed, starts, ["key"], "n").select("key", (F.col("place") - F.col("start")).alias("pos"), F.col("leaf").alias("digest"), "n", "doc_id", "tampered")
    base = materialize(base, "merkle-places")
    rows, tops = forest(base, levels)
    above = _languages(tops, levels)
    for row in reversed(rows[1:]):
        above = materialize(descended(row, above, levels), "merkle-paths")
    return _joined_to_block(base, above, lambda group, up: _versions(group, up, levels), MANIFEST, levels)


def _languages(tops: DataFrame, levels: int) -> DataFrame:
    """The top tree over the languages' subroots: each language's path in it, subroot and the root, as a row above its one node."""
    n = tops.count()
    named = numbered(tops.select("key", "digest"), [F.col("key")], n)
    nodes = named.select(F.lit("").alias("key"), F.col("place").alias("pos"), "digest", F.lit(n).cast("long").alias("n"), F.col("key").alias("name"))
    rows, top = forest(nodes, levels)
    above = top.select("key", "pos", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for row in reversed(rows):
        above = materialize(descended(row, above, levels), "merkle-paths")
    return above.join(nodes.select("pos", "name", "digest"), "pos").select(F.col("name").alias("key"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")


def report(docs: DataFrame, tamper: int = TAMPER, levels: int = LEVELS) -> DataFrame:
    """The manifest with digests in place of its long columns: proof_sha256 over the siblings alone, and whether the folded root is the root."""
    rows = manifest(docs, tamper, levels)
    proof = F.sha2(F.regexp_replace("proof", "[LR-]", "").cast("binary"), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE = f"""
WITH RECURSIVE crc AS ({CRC32_TABLE}),
f AS (SELECT doc_id, lang, n_chars, {crc32_sql("doc_id::VARCHAR")} % 7 = 0 AS chosen,
  [coalesce(octet_length(encode(v))::VARCHAR || ':' || v, '-') FOR v IN [doc_id::VARCHAR, source, lang]] AS head, coalesce(octet_length(encode(text))::VARCHAR || ':' || text, '-') AS tail,
  coalesce(len(n_chars::VARCHAR) || ':' || n_chars, '-') AS mid, coalesce(len((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS other FROM documents, crc),
l AS (SELECT doc_id, lang, sha256(array_to_string(head, '') || mid || tail) AS leaf, CASE WHEN chosen THEN sha256(array_to_string(head, '') || other || tail) END AS changed FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
t AS (SELECT lang, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM p
  UNION ALL SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 2),
s AS (SELECT lang, lvl AS depth, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, subroot AS h, (SELECT count(*) FROM s) AS n FROM s
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, pos // 2),
w AS (SELECT p.*, s.depth, s.subroot, s.pos AS place, (SELECT max(lvl) FROM u) AS top FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang),
walk AS (SELECT w.doc_id, w.lang, w.pos, k.lvl, t.h AS sib, (w.pos >> k.lvl) & 1 AS side FROM w, LATERAL (SELECT unnest(range(w.depth)) AS lvl) k
    LEFT JOIN t ON t.lang IS NOT DISTINCT FROM w.lang AND t.lvl = k.lvl AND t.pos = xor(w.pos >> k.lvl, 1)
  UNION ALL SELECT w.doc_id, w.lang, w.pos, w.depth + k.lvl, u.h, (w.place >> k.lvl) & 1 FROM w, LATERAL (SELECT unnest(range(w.top)) AS lvl) k
    LEFT JOIN u ON u.lvl = k.lvl AND u.pos = xor(w.place >> k.lvl, 1)),
g AS (SELECT lang, pos, list(struct_pack(side := side, sib := coalesce(sib, '')) ORDER BY lvl) AS way, string_agg(coalesce(sib, ''), '' ORDER BY lvl) AS proof FROM walk GROUP BY ALL)
SELECT w.doc_id, w.leaf, w.subroot, r.h AS root, sha256(coalesce(g.proof, '')) AS proof_sha256,
  list_reduce(coalesce(list_transform(g.way, lambda x: (x.side || x.sib)), []::VARCHAR[]), lambda a, x: CASE WHEN x[1] = '1' THEN sha256(x[2:] || a) ELSE sha256(a || x[2:]) END, coalesce(w.changed, w.leaf)) AS folded_root,
  folded_root = r.h AS verified
FROM w LEFT JOIN g ON g.lang IS NOT DISTINCT FROM w.lang AND g.pos = w.pos, (SELECT h FROM u WHERE n = 1) r"""
