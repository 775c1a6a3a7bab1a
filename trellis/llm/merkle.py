"""Merkle manifest of a dataset: a tree of digests for each group of rows, and one over their roots.

Leaves are numbered by a range sort: a row's place is its number inside its sorted partition
plus the rows of its tree in the partitions before. A tree of arity 8 is cut into aligned
subtrees of 4096 leaves. Each is one row: its digests as one byte string in van Emde Boas
order, where a subtree is split at half its height, the top part comes first and the parts below
follow, each laid out in the same way. Address arithmetic finds a node's place in it, for
building (children of a run) and for siblings alike. The roots of the subtrees are the leaves
of the next stage, so the work recurses over block roots until a tree has one node.

Proofs go the other way: a stage hands every block below it the siblings above that block, so a
task that holds one block and this list can prove all its leaves.

Defined cases: null values are told from empty ones; rows sharing a key are ordered by their
digest; an empty table gives no rows; other columns are ignored. Rows that are equal in all
leaf columns are sorted into one partition.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import materialize

ARITY = 8
#: Levels of hashing in a block; it has ARITY ** HEIGHT leaves.
HEIGHT = 4
LEAVES = ARITY**HEIGHT
STEP = "array<struct<before: string, after: string>>"
_BLOCK = "tree string, block long, n long, present long, nodes binary, root string"


# ---- layout ----------------------------------------------------------------------------


def nodes_in(levels: int) -> int:
    """Nodes of a full subtree with that many levels of nodes."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places, in van Emde Boas order, of the nodes `index` at `depth` (0: root) of a full subtree
    with `levels` levels of nodes: the upper half of the levels first, then each subtree below."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    width = ARITY ** (depth - top)
    return nodes_in(top) + index // width * nodes_in(levels - top) + address(levels - top, depth - top, index % width)


def rounds_of(n: int) -> int:
    """Rounds of hashing until n nodes are one."""
    r = 0
    while n > 1:
        n, r = -(-n // ARITY), r + 1
    return r


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Block:
    """An aligned subtree with `present` leaves of a tree that has n nodes at the leaves' level.
    Its nodes are 32-byte digests in van Emde Boas order; slots without a node are zero."""

    def __init__(self, n: int, present: int, nodes: bytes | None = None):
        self.rounds, self.present = min(HEIGHT, rounds_of(n)), present
        size = nodes_in(HEIGHT + 1)
        self.nodes = np.zeros((size, 32), dtype=np.uint8) if nodes is None else np.frombuffer(nodes, dtype=np.uint8).reshape(size, 32)

    def _at(self, depth: int, first: int, last: int) -> np.ndarray:
        return address(HEIGHT + 1, depth, np.arange(first, last))

    def count(self, rounds: int) -> int:
        return -(-self.present // ARITY**rounds)

    def digests(self, rounds: int) -> list[str]:
        """Digests of the level that `rounds` of hashing give, as hex text."""
        raw = self.nodes[self._at(HEIGHT - rounds, 0, self.count(rounds))].tobytes().hex()
        return [raw[i : i + 64] for i in range(0, len(raw), 64)]

    def build(self, leaves: list[str]) -> Block:
        level = leaves
        for r in range(self.rounds + 1):
            if r:
                level = [hashed("".join(level[i : i + ARITY])) for i in range(0, len(level), ARITY)]
            self.nodes[self._at(HEIGHT - r, 0, len(level))] = np.frombuffer(bytes.fromhex("".join(level)), dtype=np.uint8).reshape(-1, 32)
        return self

    def root(self) -> str:
        return self.digests(self.rounds)[0]

    def steps(self) -> list[list[tuple[str, str]]]:
        """For each round the texts before and after each node among its run's digests."""
        out = []
        for r in range(self.rounds):
            level, pairs = self.digests(r), []
            for a in range(0, len(level), ARITY):
                run = level[a : a + ARITY]
                pairs += [("".join(run[:k]), "".join(run[k + 1 :])) for k in range(len(run))]
            out.append(pairs)
        return out


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf's digest and its path, (before, after) of each level, lead to."""
    for before, after in path:
        digest = hashed(before + digest + after)
    return digest


# ---- jobs ------------------------------------------------------------------------------


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of the columns' values as text, each behind its UTF-8 length; null is `-`."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (tree, digest, ...) with pos, the place of each in its tree by `order` and digest, and
    n, the tree's leaves. leaves should be a written table: it is sampled before it is sorted."""
    by = ["tree", *order, "digest"]
    rows = materialize(leaves.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    runs = rows.groupBy("tree", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("tree", "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy("tree")).alias("n"))
    out = rows.withColumn("_part", part).join(starts, ["tree", "_part"])
    return out.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def _built(table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    block = Block(table["n"][0].as_py(), table.num_rows).build(table["digest"].to_pylist())
    row = {"tree": table["tree"][0].as_py(), "block": table["block"][0].as_py(), "n": table["n"][0].as_py(), "present": table.num_rows, "nodes": block.nodes.tobytes(), "root": block.root()}
    return pa.table({k: [v] for k, v in row.items()}, schema=pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("present", pa.int64()), ("nodes", pa.binary()), ("root", pa.string())]))


def build(leaves: DataFrame) -> list[DataFrame]:
    """Tables of blocks (tree, block, n, present, nodes, root), one for each stage, of leaves
    (tree, pos, n, digest); n is the number of the tree's nodes where the stage's leaves are."""
    cells = leaves.select("tree", "pos", "n", "digest")
    most = cells.agg(F.max("n")).first()[0] or 0
    stages = []
    while True:
        groups = cells.withColumn("block", F.floor(F.col("pos") / LEAVES).cast("long")).groupBy("tree", "block")
        stages.append(materialize(groups.applyInArrow(_built, _BLOCK)))
        if most <= LEAVES:
            return stages
        most = -(-most // LEAVES)
        cells = stages[-1].filter(F.col("n") > LEAVES).select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / LEAVES).cast("long").alias("n"), F.col("root").alias("digest"))


def tree_roots(stages: list[DataFrame]) -> DataFrame:
    """(tree, root): the root of the only block of the tree's last stage."""
    out = None
    for s in stages:
        one = s.filter(F.col("n") <= LEAVES).select("tree", "root")
        out = one if out is None else out.unionByName(one)
    return out


def _pushed(batches):
    for batch in batches:
        for row in batch.to_pylist():
            steps = Block(row["n"], row["present"], row["nodes"]).steps()
            above = [(s["before"], s["after"]) for s in row["above"]]
            paths = [[level[i // ARITY**r] for r, level in enumerate(steps)] + above for i in range(row["present"])]
            cells = [[{"before": b, "after": a} for b, a in p] for p in paths]
            place = [row["block"] * LEAVES + i for i in range(row["present"])]
            kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * len(place)), pa.array(place, pa.int64()), pa.array(cells, kind)], ["tree", "pos", "above"])


def paths_above(stages: list[DataFrame], above: DataFrame) -> DataFrame:
    """The blocks of the first stage with `above`, the siblings from the block's root upwards, when
    (tree, above) has those above each tree's root."""
    ready = None
    for s in reversed(stages):
        top = s.filter(F.col("n") <= LEAVES).join(above, "tree")
        if ready is not None:
            handed = ready.mapInArrow(_pushed, f"tree string, pos long, above {STEP}").withColumnRenamed("pos", "block")
            top = top.unionByName(s.filter(F.col("n") > LEAVES).join(handed, ["tree", "block"]))
        ready = materialize(top)
    return ready


def _proven(key: pa.DataType):
    def run(blocks: pa.Table, rows: pa.Table) -> pa.Table:
        b = blocks.to_pylist()[0]
        steps = Block(b["n"], b["present"], b["nodes"]).steps()
        above = [(s["before"], s["after"]) for s in b["above"]]
        above_text = "".join(x + y for x, y in above)
        proof, fold = [], []
        for pos, claim in zip(rows["pos"].to_pylist(), rows["claim"].to_pylist(), strict=True):
            own = [level[pos % LEAVES // ARITY**r] for r, level in enumerate(steps)]
            proof.append(hashed("".join(x + y for x, y in own) + above_text))
            fold.append(folded(claim, own + above))
        n = rows.num_rows
        return pa.table(
            [rows["id"], rows["digest"], pa.array([b["subroot"]] * n), pa.array(proof, pa.string()), pa.array(fold, pa.string())],
            schema=pa.schema([("id", key), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())]),
        )

    return run


def manifest(leaves: DataFrame, order: str) -> DataFrame:
    """A row for each row of leaves (tree, digest, claim and the column order, by which a tree's
    leaves ascend): that column, leaf, subroot, root, proof_sha256 (of all siblings), folded_root
    (to which the digest `claim` leads with the siblings) and verified. Trees ascend by name."""
    kind = leaves.schema[order].dataType
    rows = placed(materialize(leaves.select("tree", "digest", "claim", F.col(order).alias("id"))), ["id"])
    rows = materialize(rows)
    stages = build(rows)
    subroots = materialize(tree_roots(stages))
    tops = placed(materialize(subroots.select(F.lit("").alias("tree"), F.col("root").alias("digest"), F.col("tree").alias("name"))), ["name"])
    tops = materialize(tops)
    top_stages = build(tops)
    root = tree_roots(top_stages).first()
    none = leaves.sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast(STEP).alias("above"))
    above = paths_above(top_stages, none).mapInArrow(_pushed, f"tree string, pos long, above {STEP}").join(tops.select("pos", "name"), "pos")
    blocks = paths_above(stages, above.select(F.col("name").alias("tree"), "above")).join(subroots.withColumnRenamed("root", "subroot"), "tree")
    asked = rows.select("tree", F.floor(F.col("pos") / LEAVES).cast("long").alias("block"), "pos", "id", "digest", "claim")
    key = pa.int64() if kind.simpleString() == "bigint" else pa.string() if kind.simpleString() == "string" else None
    if key is None:
        raise TypeError(f"{order} must be a long or a string")
    out = blocks.groupBy("tree", "block").cogroup(asked.groupBy("tree", "block")).applyInArrow(
        _proven(key), f"id {kind.simpleString()}, leaf string, subroot string, proof_sha256 string, folded_root string"
    )
    whole = F.lit(root["root"] if root else None).cast("string")
    return out.select(
        F.col("id").alias(order), "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"),
    )


def op12_veb_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents, a tree for each lang, with every third one tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    digest = leaf_digest([*fields, F.col("text")])
    claim = F.when(tampered, leaf_digest([*fields, lowered])).otherwise(digest)
    # null languages come first: `-` is before `=`
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))
    return manifest(docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), digest.alias("digest"), claim.alias("claim")), "doc_id")


#: CRC-32 of the decimal doc_id, a byte at a time and eight shifts each.
_CRC = """xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda c, b: list_reduce([xor(c, b)] || [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), CAST(4294967295 AS BIGINT))"""
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree_sql(name: str, start: str) -> str:
    """CTEs with the nodes of all trees and what stands before and after each in its run."""
    return f"""{name} AS ({start} UNION ALL
  SELECT tree, lvl + 1, idx // 8, sha256(string_agg(d, '' ORDER BY idx)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY tree, lvl, idx // 8, n),
{name}_run AS (SELECT a.tree, a.lvl, a.idx, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY ALL)"""


_LEVEL_0 = "SELECT tree, CAST(0 AS BIGINT) AS lvl, pos AS idx, leaf AS d, CAST(count(*) OVER (PARTITION BY tree) AS BIGINT) AS n FROM leaves"
_LEVEL_1 = "SELECT '' AS tree, CAST(0 AS BIGINT) AS lvl, CAST(row_number() OVER (ORDER BY tree) - 1 AS BIGINT) AS idx, d, CAST(count(*) OVER () AS BIGINT) AS n FROM nodes WHERE n = 1"
OP12_SQL = f"""WITH RECURSIVE leaves AS (SELECT doc_id, tree, leaf, claim, CAST(row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS BIGINT) AS pos FROM (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256({_HEAD} || {_FIELD.format('text')}) AS leaf,
    sha256({_HEAD} || {_FIELD.format(f"CASE WHEN {_CRC} % 3 = 0 THEN {_LOWERED} ELSE text END")}) AS claim FROM documents)),
{_tree_sql("nodes", _LEVEL_0)},
{_tree_sql("tops", _LEVEL_1)},
walk AS (SELECT doc_id, tree, CAST(0 AS BIGINT) AS lvl, pos AS idx, leaf, claim AS d, '' AS proof FROM leaves UNION ALL
  SELECT w.doc_id, w.tree, w.lvl + 1, w.idx // 8, w.leaf, sha256(r.before || w.d || r.after), w.proof || r.before || r.after FROM walk w JOIN nodes_run r ON r.tree = w.tree AND r.lvl = w.lvl AND r.idx = w.idx),
high AS (SELECT w.doc_id, CAST(0 AS BIGINT) AS lvl, t.idx, w.leaf, n.d AS subroot, w.d, w.proof FROM walk w JOIN nodes n ON n.tree = w.tree AND n.lvl = w.lvl AND n.n = 1
    JOIN (SELECT tree AS name, row_number() OVER (ORDER BY tree) - 1 AS idx FROM nodes WHERE n = 1) t ON t.name = w.tree UNION ALL
  SELECT w.doc_id, w.lvl + 1, w.idx // 8, w.leaf, w.subroot, sha256(r.before || w.d || r.after), w.proof || r.before || r.after FROM high w JOIN tops_run r ON r.lvl = w.lvl AND r.idx = w.idx)
SELECT h.doc_id, h.leaf, h.subroot, t.d AS root, sha256(h.proof) AS proof_sha256, h.d AS folded_root, h.d = t.d AS verified FROM high h JOIN tops t ON t.lvl = h.lvl AND t.n = 1"""
