"""Merkle manifest of a dataset: a postorder append log, and proofs addressed in it.

Rows are leaves, trees are per source over its leaves by doc_id, and one tree stands over the
sources' roots. A run of ``FAN`` neighbours becomes their parent, the last run being shorter
where the number does not divide; a tree of one leaf is that leaf.

* Log. Nodes are appended in the order they are complete: a leaf, then every parent whose last
  child it is. The position of node j of a level follows from the number of leaves alone
  (``position``), so a tree's log can be written by many builders at once. An aligned builder
  takes ``FAN ** LEVELS`` neighbours and writes the nodes above them: over leaves these are one
  stretch of the log, over the roots of blocks they are short runs between such stretches. Blocks
  are built in parallel, and their roots are the leaves of the next round: a tree of n leaves
  takes log(n) / LEVELS rounds.
* Proof. The siblings of a leaf within its block are read from the block's stretch; those above
  it are the same for the whole block, and their positions are joined with the log once a block.
  A proof lists the siblings from the leaf to the root over all sources, left to right.

A hot source is cut into blocks like any other, so no task holds more than a block at a time.
Null columns are marked in the leaf; a null doc_id comes first in its source, a null source is a
source of its own and first; equal ids are ordered by the leaf's digest, and equal rows are as
many equal leaves. An empty table has no rows. Texts are hashed whole by Spark's own functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import numbered, written

FAN = 3
LEVELS = 5
BLOCK = FAN**LEVELS
SIZE = 32
OVER_ALL = -1  # the number of the tree over the sources' roots


def height(n: int) -> int:
    """Levels above the leaves of a tree of n."""
    h = 0
    while FAN**h < n:
        h += 1
    return h


def width(n: int, level: int) -> int:
    """Nodes of a level."""
    return -(-n // FAN**level)


def position(n: int, level: int, j: int) -> int:
    """Place in the log of node j of a level in a tree of n leaves: the nodes that end before
    it, and those below it."""
    last = min((j + 1) * FAN**level, n)
    below = sum(-(-last // FAN**m) for m in range(level))
    return below + j + sum((last - 1) // FAN**m for m in range(level + 1, height(n) + 1))


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: list[Column]) -> Column:
    """Digest of the columns: '-' for null, else byte count, ':' and value."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in row]
    return F.sha2(F.concat(*said).cast("binary"), 256)


class Builder:
    """Appends the nodes above neighbours of one level, in the order they are complete."""

    def __init__(self, n: int, base: int, first: int):
        self.n, self.base, self.at = n, base, first
        self.top = min(base + LEVELS, height(n))
        self.open: list[list[str]] = [[] for _ in range(self.top - base + 1)]

    def add(self, node: str) -> list[str]:
        """The parents that are complete now, lowest first."""
        made, level, j = [], self.base, self.at
        self.at += 1
        while level < self.top:
            run = self.open[level - self.base]
            run.append(node)
            if len(run) < FAN and j + 1 < width(self.n, level):
                return made
            node = digest(run)
            run.clear()
            made.append(node)
            level, j = level + 1, j // FAN
        return made


_LOG = "tree long, n long, base int, block long, at long, nodes binary, top binary"


def _build(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("idx")
    n, base, first = int(group["n"].iloc[0]), int(group["base"].iloc[0]), int(group["idx"].iloc[0])
    b = Builder(n, base, first)
    rows, stretch = [], []
    for j, node in enumerate(group["node"], first):
        made = b.add(node.hex())
        if base == 0:
            stretch += [node.hex(), *made]
        elif made:
            rows.append([position(n, base + 1, j // FAN), made])
    if base == 0:
        rows = [[position(n, 0, first), stretch]]
    out = pd.DataFrame({"at": [a for a, _ in rows], "nodes": [bytes.fromhex("".join(x)) for _, x in rows]})
    out["top"] = None
    out.loc[len(out) - 1, "top"] = bytes.fromhex(rows[-1][1][-1])
    return out.assign(tree=group["tree"].iloc[0], n=n, base=base, block=first // BLOCK)[["tree", "n", "base", "block", "at", "nodes", "top"]]


def append_log(leaves: DataFrame, most: int, what: str) -> list[DataFrame]:
    """The log of the trees of ``leaves`` (tree, n, idx, node); a frame per round, written.
    most: the leaves of the largest tree. The last row of a block has its root as ``top``."""
    rounds, nodes, base = [], leaves.withColumn("base", F.lit(0)), 0
    while not rounds or FAN**base < most:
        by = nodes.withColumn("block", F.floor(F.col("idx") / BLOCK)).select("tree", "n", "base", "idx", "block", "node")
        rounds.append(written(by.groupBy("tree", "block").applyInPandas(_build, _LOG), f"{what}-log-{base}"))
        base += LEVELS
        tops = rounds[-1].filter(F.col("top").isNotNull() & (F.col("n") > FAN**base))
        nodes = tops.select("tree", "n", F.col("block").alias("idx"), F.lit(base).alias("base"), F.col("top").alias("node"))
    return rounds


def _roots(rounds: list[DataFrame]) -> DataFrame:
    """tree, root: of each tree, the top of the round that ends it."""
    ends = [r.filter(F.col("top").isNotNull() & (F.col("n") <= FAN ** (LEVELS * (i + 1)))) for i, r in enumerate(rounds)]
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return out.select("tree", F.col("top").alias("root"))


@dataclass
class Manifest:
    """leaves: the rows with tree, n (leaves of the tree), idx; log: rounds of the sources'
    trees; over: those of the tree over the sources; roots: tree, root; trees: their number; root: hex."""

    leaves: DataFrame
    log: list[DataFrame]
    over: list[DataFrame]
    roots: DataFrame
    trees: int
    root: str | None


def manifest(rows: DataFrame) -> Manifest:
    """``rows`` have source, doc_id and leaf (binary); other columns pass."""
    placed = numbered(rows, ["source"], ["doc_id", "leaf"], "merkle-leaves")
    sizes = placed.groupBy("source").agg(F.count("*").alias("n"))
    sources = written(numbered(sizes, [], ["source"], "merkle-sizes").withColumnRenamed("idx", "tree"), "merkle-sources")
    most, trees = sources.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    named = sources.withColumnRenamed("source", "of")
    leaves = written(placed.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of"), "merkle-placed")
    log = append_log(leaves.select("tree", "n", "idx", F.col("leaf").alias("node")), most, "merkle")
    roots = _roots(log)
    tops = roots.select(F.lit(OVER_ALL).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("idx"), F.col("root").alias("node"))
    over = append_log(tops, trees, "merkle-over")
    top = _roots(over).first()
    return Manifest(leaves, log, over, roots, trees, bytes(top["root"]).hex() if top else None)


def _last() -> Column:
    """The last node's place in a row's stretch."""
    return F.floor(F.octet_length("nodes") / SIZE).cast("int") - 1


def _nodes(log: DataFrame) -> DataFrame:
    """tree, at, node: the log a node a row."""
    cut = log.select("tree", "at", "nodes", F.explode(F.sequence(F.lit(0), _last())).alias("k"))
    return cut.select("tree", (F.col("at") + F.col("k")).alias("at"), F.substring("nodes", F.col("k") * SIZE + 1, F.lit(SIZE)).alias("node"))


def siblings(n: int, level: int, j: int) -> Iterator[tuple[int, int, int]]:
    """From node j of a level to the root: step, 0 for a left or 1 for a right sibling, position."""
    for step in range(level, height(n)):
        for k in range(j // FAN * FAN, min(j // FAN * FAN + FAN, width(n, step))):
            if k != j:
                yield step, int(k > j), position(n, step, k)
        j //= FAN


def _paths(m: Manifest) -> DataFrame:
    """tree, block, path: the siblings above each block, as structs in the order of a proof."""

    trees = m.trees

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tree, n, block in b.itertuples(index=False):
                up = [(tree, s, x, at) for s, x, at in siblings(n, LEVELS, block)]
                up += [(OVER_ALL, height(n) + s, x, at) for s, x, at in siblings(trees, 0, tree)]
                rows += [(tree, block, of, step, side, at) for of, step, side, at in up]
            yield pd.DataFrame(rows, columns=["tree", "block", "of", "step", "side", "at"])

    wanted = m.log[0].select("tree", "n", "block").mapInPandas(asked, "tree long, block long, of long, step int, side int, at long")
    # Of a stretch over leaves only the last node, its block's root, stands beside another block.
    known = m.log[0].select("tree", (F.col("at") + _last()).alias("at"), F.col("top").alias("node"))
    for r in [*m.log[1:], *m.over]:
        known = known.unionByName(_nodes(r))
    found = wanted.join(known.withColumnRenamed("tree", "of"), ["of", "at"])
    # At most FAN - 1 a level.
    return found.groupBy("tree", "block").agg(F.sort_array(F.collect_list(F.struct("step", "at", "side", "node"))).alias("path"))


def _runs(path, steps: range) -> tuple[list[tuple[str, str]], str]:
    """A path's left and right siblings by step, none where a node has no sibling, and all of them joined."""
    found: dict[int, list[list[str]]] = {s: [[], []] for s in steps}
    for p in path if path is not None else ():
        found[p["step"]][p["side"]].append(p["node"].hex())
    runs = [("".join(a), "".join(b)) for a, b in found.values()]
    return runs, "".join(a + b for a, b in runs)


_PROVED = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def _prove(leaves: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    block = blocks.iloc[0]
    n, nodes, start = int(block["n"]), block["nodes"], int(block["at"])
    top = min(LEVELS, height(n))
    above, rest = _runs(block["path"], range(top, height(n) + height(int(block["trees"]))))
    # The run beside each node of the block, read from its stretch of the log.
    beside: dict[tuple[int, int], tuple[str, str]] = {}
    out = []
    for doc_id, own, shown, idx in leaves[["doc_id", "leaf", "shown", "idx"]].itertuples(index=False):
        j, said, now, level = int(idx), [], shown.hex(), 0
        while level < top:
            if (level, j) not in beside:
                first = j // FAN * FAN
                at = [SIZE * (position(n, level, k) - start) for k in range(first, min(first + FAN, width(n, level)))]
                run = [nodes[a : a + SIZE].hex() for a in at]
                beside[level, j] = "".join(run[: j - first]), "".join(run[j - first + 1 :])
            left, right = beside[level, j]
            said += [left, right]
            now = digest([left, now, right])
            level, j = level + 1, j // FAN
        for left, right in above:
            now = digest([left, now, right])
        out.append((doc_id, own.hex(), block["root"].hex(), digest([*said, rest]), now))
    result = pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])
    return result.assign(doc_id=result["doc_id"].astype("Int64"))


def prove(m: Manifest) -> DataFrame:
    """For each row of ``m.leaves``, which have the leaf as it is shown (``shown``): leaf, its
    source's root, the digest of its proof, and the root that follows from the shown leaf."""
    blocks = m.log[0].select("tree", "n", "block", "at", "nodes").join(_paths(m), ["tree", "block"], "left").join(m.roots, "tree").withColumn("trees", F.lit(m.trees))
    leaves = m.leaves.withColumn("block", F.floor(F.col("idx") / BLOCK)).select("tree", "block", "idx", "doc_id", "leaf", "shown")
    return leaves.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInPandas(_prove, _PROVED)


def tamper_check(docs: DataFrame) -> DataFrame:
    """Digest of ``docs`` (doc_id, source, lang, n_chars, text): leaf, subroot, root, proof, and
    whether each row, shown without line breaks where 2 divides its id's crc32, still leads to
    the root. A null id has no crc32 and is shown as it is."""
    d = docs.select(docs["doc_id"].cast("long"), "source", "lang", "n_chars", "text")
    row = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    own, other = leaf([*row, F.col("text")]), leaf([*row, cut])
    leaves = d.select("doc_id", "source", F.unhex(own).alias("leaf"), F.unhex(F.when(hit, other).otherwise(own)).alias("shown"))
    m = manifest(written(leaves, "merkle-rows"))
    out = prove(m).withColumn("root", F.lit(m.root).cast("string"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql() -> str:
    """The same rows in SQL: levels by recursion, siblings by joins along each leaf's path."""
    said = ", ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", "n_chars"))
    text = "coalesce(strlen({0}) || ':' || {0}, '-')"
    return f"""
with recursive crc as (
  select doc_id as id, list_reduce(list_prepend(4294967295::bigint, flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(cast(doc_id as varchar), '')])),
    lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end) % 2 = 1 as even
  from (select distinct doc_id from documents)
), leaves as (
  select d.doc_id, d.source, dense_rank() over (order by d.source nulls first) - 1 as tree,
    sha256(concat({said}, {text.format("text")})) as leaf,
    sha256(concat({said}, case when even then {text.format("replace(text, chr(10), '')")} else {text.format("text")} end)) as shown
  from documents d left join crc on crc.id is not distinct from d.doc_id
), placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by tree) as n from leaves
), nodes as (
  select tree, 0 as level, idx as j, leaf as h, n as w from placed
  union all
  select tree, level + 1, j // 3, sha256(string_agg(h, '' order by j)), any_value((w + 2) // 3) from nodes where w > 1 group by tree, level, j // 3
), subroots as (select tree, level as height, h as subroot from nodes where w = 1
), over_all as (
  select 0 as level, tree as j, subroot as h, (select count(*) from subroots) as w from subroots
  union all
  select level + 1, j // 3, sha256(string_agg(h, '' order by j)), any_value((w + 2) // 3) from over_all where w > 1 group by level, j // 3
), runs as (
  select tree, level, j // 3 as parent, list(h order by j) as hs from nodes where w > 1 group by all
), runs_over as (
  select level, j // 3 as parent, list(h order by j) as hs from over_all where w > 1 group by all
), walk as (
  select tree, idx, 0 as level, false as above, idx as j, shown as now, '' as said, height, doc_id, leaf, subroot from placed join subroots using (tree)
  union all
  select w.tree, w.idx, case when w.level < w.height or w.above then w.level + 1 else 0 end, w.above or w.level >= w.height,
    case when w.level < w.height or w.above then w.j // 3 else w.tree end,
    case when coalesce(r.hs, o.hs) is null then w.now
      else sha256(concat(list_aggregate(coalesce(r.hs, o.hs)[1 : w.j % 3], 'string_agg', ''), w.now, list_aggregate(coalesce(r.hs, o.hs)[w.j % 3 + 2 :], 'string_agg', ''))) end,
    concat(w.said, list_aggregate(coalesce(r.hs, o.hs)[1 : w.j % 3], 'string_agg', ''), list_aggregate(coalesce(r.hs, o.hs)[w.j % 3 + 2 :], 'string_agg', '')),
    w.height, w.doc_id, w.leaf, w.subroot
  from walk w
  left join runs r on not w.above and w.level < w.height and r.tree = w.tree and r.level = w.level and r.parent = w.j // 3
  left join runs_over o on w.above and o.level = w.level and o.parent = w.j // 3
  where not w.above or o.hs is not null
), ends as (
  select *, row_number() over (partition by tree, idx order by above desc, level desc) as last from walk
)
select doc_id, leaf, subroot, (select h from over_all where w = 1) as root, sha256(said) as proof_sha256, now as folded_root,
  now = (select h from over_all where w = 1) as verified
from ends where last = 1"""


ORACLE = _sql()
