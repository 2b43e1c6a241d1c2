"""Parent links to full hierarchies, for trees of unknown depth and groups of any size.

Nodes are range-sorted over all partitions by (group, position), so a large group fills many
partitions and a small one lies in one. Each partition contracts its chains of parents to where
they leave it. The nodes at which chains enter another partition form a smaller forest of the same
shape, solved by the same function; its result then expands every chain. Circles inside a
partition are seen at once, circles over several partitions as circles of the smaller forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.session import materialise, partitions_for

#: Nodes of one partition at every level; a partition is solved in memory.
PART_ROWS = 200_000
#: Levels at which chains that do not shrink are shortened by joins; each shortens them eightfold.
SHORTENED = 12

_NODES = "g string, id string, pos long, parent string, w long, low string, kind string, top string, depth long, seg array<string>, path array<string>"
_SOLVED = "pid int, edge boolean, " + _NODES + ", target string, xdepth long"


def _jump(nxt: np.ndarray, w: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Last node, summed weight and smallest code of each chain, by pointer doubling; a chain on a
    circle ends somewhere on it, having seen all of it."""
    at = np.where(nxt >= 0, nxt, np.arange(len(nxt)))
    d = np.where(nxt >= 0, w, 0)
    for _ in range(max(1, int(len(nxt)).bit_length())):
        if (at == at[at]).all() and (low == np.minimum(low, low[at])).all():
            break
        d = d + d[at]
        low = np.minimum(low, low[at])
        at = at[at]
    return at, d, low


def _on_circle(nxt: np.ndarray, at: np.ndarray) -> np.ndarray:
    on = np.zeros(len(nxt), dtype=bool)
    on[at[nxt[at] >= 0]] = True
    return on


def _contract(p: pd.DataFrame, pid: int, whole: bool, with_paths: bool, level: int) -> pd.DataFrame:
    """One partition's nodes, sorted by group. A chain's end has no parent here: its own row says
    what the end is, or, where the parent may lie in another partition, the chain leaves to it."""
    n = len(p)
    index = pd.Index(p["g"] + "\0" + p["id"])
    has = p["parent"].notna().to_numpy()
    nxt = np.full(n, -1)
    nxt[has] = index.get_indexer((p["g"] + "\0" + p["parent"])[has])
    own = np.argsort(np.argsort(p["low"].to_numpy(dtype=object)))
    edge = np.zeros(n, dtype=bool)
    if not whole:  # only the first and the last group can go on in another partition
        g = p["g"].to_numpy(dtype=object)
        edge = (g == g[0]) | (g == g[-1])
    w = p["w"].to_numpy(dtype=np.int64)
    at, d, low = _jump(nxt, w, own)
    on = _on_circle(nxt, at)
    kind, top = p["kind"].to_numpy(dtype=object).copy(), p["top"].to_numpy(dtype=object).copy()
    pay = p["depth"].to_numpy(dtype=np.int64).copy()
    names = p["low"].to_numpy(dtype=object)[np.argsort(own)]
    kind[on], top[on], pay[on] = f"C{level}", names[low[on]], 0
    if on.any():
        at, d, low = _jump(np.where(on, -1, nxt), w, own)
    paths, segs = [None] * n, [None] * n
    if with_paths:
        ends, own_seg = p["path"].tolist(), p["seg"].tolist()
        for i in np.argsort(d, kind="stable"):
            if at[i] == i:
                paths[i], segs[i] = ([p["id"].iat[i]] if on[i] else ends[i]), list(own_seg[i])
            else:
                paths[i] = [*paths[nxt[i]], *own_seg[i]]
                segs[i] = [*segs[nxt[i]], *own_seg[i]]
    leaves = has[at] & ~on[at] & edge[at] & (nxt[at] < 0)
    k = kind[at]
    k = np.array([f"B{x[1:]}" if x[0] == "C" and a != i else x for i, (a, x) in enumerate(zip(at, k))], dtype=object)
    parent = p["parent"].to_numpy(dtype=object)
    return pd.DataFrame({
        "pid": np.full(n, pid, dtype=np.int32), "edge": edge, "g": p["g"], "id": p["id"], "pos": p["pos"], "parent": np.where(edge, parent, None), "w": w, "low": np.where(leaves, names[low], None),
        "kind": k, "top": top[at], "depth": d + pay[at], "seg": segs, "path": paths, "target": np.where(leaves, parent[at], None), "xdepth": np.where(leaves, d + w[at], 0)})


def _contracted(nodes: DataFrame, n: int, with_paths: bool, level: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            out = _contract(pa.Table.from_batches(got).to_pandas(), TaskContext.get().partitionId(), n == 1, with_paths, level)
            yield from pa.Table.from_pandas(out, preserve_index=False, schema=schema).to_batches(max_chunksize=20_000)

    s = pa.string()
    schema = pa.schema([("pid", pa.int32()), ("edge", pa.bool_()), ("g", s), ("id", s), ("pos", pa.int64()), ("parent", s), ("w", pa.int64()), ("low", s), ("kind", s), ("top", s), ("depth", pa.int64()), ("seg", pa.list_(s)), ("path", pa.list_(s)), ("target", s), ("xdepth", pa.int64())])
    parts = nodes.coalesce(1).sortWithinPartitions("g", "pos") if n == 1 else nodes.repartitionByRange(n, "g", "pos", "id").sortWithinPartitions("g", "pos", "id")
    return parts.mapInArrow(run, _SOLVED)


_RESULT = ["g", "id", "kind", "top", "depth", "path"]


def _found_deeper(kind: str, level: int) -> Column:
    return F.col(kind).rlike("^[CB]") & (F.substring(kind, 2, 9).cast("int") > level)


def _shorten(nodes: DataFrame, with_paths: bool) -> DataFrame:
    """Every node linked to its parent's parent, where there is one: chains of half the length. A circle
    becomes one or two circles that have seen all its names."""
    p = nodes.select("g", F.col("id").alias("parent"), F.col("parent").alias("pp"), F.col("w").alias("pw"), F.col("low").alias("plow"), F.col("seg").alias("pseg")).filter("pp is not null")
    j = nodes.join(p, ["g", "parent"], "left")
    hop = F.col("pp").isNotNull()
    seg = F.when(hop, F.concat("pseg", "seg")).otherwise(F.col("seg")) if with_paths else F.col("seg")
    return j.select("g", "id", "pos", F.coalesce("pp", "parent").alias("parent"), F.when(hop, F.col("w") + F.col("pw")).otherwise(F.col("w")).alias("w"), F.when(hop, F.least("low", "plow")).otherwise(F.col("low")).alias("low"), "kind", "top", "depth", seg.alias("seg"), "path")


def _solve(nodes: DataFrame, n: int, with_paths: bool, level: int = 0, before: int | None = None) -> DataFrame:
    """(g, id, kind, top, depth, path) of every node. kind: R or E as the end's row says, C<level>
    on a circle found at that level of the recursion, B<level> below one."""
    rows = _contracted(nodes, n, with_paths, level)
    if n == 1:
        return rows.select(*_RESULT)
    rows = materialise(rows)
    done = rows.filter("target is null").select(*_RESULT)
    out = rows.filter("target is not null")
    targets = out.select("g", F.col("target").alias("id")).distinct()
    # Only a node of a group on a seam can be a target, and only such rows are read here.
    entered = materialise(rows.filter("edge").join(targets, ["g", "id"], "left_semi"))
    count = entered.count()
    if not count:
        return rows.select(*_RESULT)
    leaves = F.col("target").isNotNull()
    smaller = entered.select("g", "id", "pos", F.col("target").alias("parent"), F.when(leaves, F.col("xdepth")).otherwise(0).alias("w"), F.coalesce("low", "id").alias("low"), "kind", "top", "depth", "seg", "path")
    fit = max(1, -(-count // PART_ROWS))
    if before is not None and 2 * count > before and fit > 1 and level < SHORTENED:
        # Links lead everywhere, so cutting by place gains nothing: halve the chains three times instead.
        for _ in range(3):
            smaller = materialise(_shorten(smaller, with_paths))
        parts = min(n, fit)
    else:
        parts = max(1, min(n // 2, fit))  # fewer at every level, so the recursion ends
    solved = materialise(_solve(smaller, parts, with_paths, level + 1, count))
    at = solved.select("g", F.col("id").alias("target"), F.col("kind").alias("tkind"), F.col("top").alias("ttop"), F.col("depth").alias("tdepth"), F.col("path").alias("tpath"))
    joined = out.join(at, ["g", "target"], "left")
    known = F.col("tkind").isNotNull()
    path = F.when(known, F.concat("tpath", "seg")).otherwise(F.col("path")) if with_paths else F.col("path")
    expanded = joined.select("g", "id", F.coalesce(F.regexp_replace("tkind", "^C", "B"), F.col("kind")).alias("kind"), F.coalesce("ttop", "top").alias("top"), F.when(known, F.col("xdepth") + F.col("tdepth")).otherwise(F.col("depth")).alias("depth"), path.alias("path"))
    deeper = _found_deeper("tkind", level)
    if solved.filter(_found_deeper("kind", level)).isEmpty():
        return done.unionByName(expanded)
    # Circles over several partitions. Their nodes are those between an entered node on a circle and
    # the exit of its chain; with these as ends, the chains below hold no circle and are solved anew.
    circle = solved.filter(_found_deeper("kind", level)).select("g", "id", F.substring("kind", 1, 1).alias("qkind"))
    below = materialise(joined.filter(deeper).drop("tpath").join(circle, ["g", "id"], "left"))

    def mark(p: pd.DataFrame) -> pd.DataFrame:
        index = pd.Index(p["g"] + "\0" + p["id"])
        nxt = index.get_indexer((p["g"] + "\0" + p["parent"].fillna("")))
        on = np.zeros(len(p), dtype=bool)
        for i in np.flatnonzero(p["qkind"].to_numpy() == "C"):
            while i >= 0 and not on[i]:
                on[i] = True
                i = nxt[i]
        return p.assign(on=on)[["g", "id", "on"]]

    on = below.groupBy("pid").applyInPandas(mark, "g string, id string, on boolean").filter("on").select("g", "id", F.lit(True).alias("on"))  # a group is one partition of before
    mine = F.col("on").isNotNull()
    again = below.join(on, ["g", "id"], "left").select(
        "g", "id", "pos", F.when(~mine, F.col("parent")).alias("parent"), "w", F.col("id").alias("low"),
        F.when(mine, F.lit(f"C{level}")).otherwise(F.lit("E")).alias("kind"), F.when(mine, F.col("ttop")).otherwise(F.col("id")).alias("top"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("array<string>").alias("seg") if not with_paths else F.array("id").alias("seg"), F.lit(None).cast("array<string>").alias("path") if not with_paths else F.array("id").alias("path"))
    fixed = _solve(materialise(again), max(1, min(n, -(-below.count() // PART_ROWS))), with_paths, level)
    rest = expanded.filter(~_found_deeper("kind", level))
    return done.unionByName(rest).unionByName(fixed)


def resolve(df: DataFrame, group: str, node: str, parent: str, position: str | None = None, is_root: str | None = None, with_paths: bool = False, partitions: int | None = None) -> DataFrame:
    """Where each node's chain of parents ends: (group, node, kind, top, depth[, path]).

    kind: ``rooted`` (the chain ends at a node flagged by ``is_root``; without that column, at any
    end), ``detached`` (it ends elsewhere), ``cycle`` (the node lies on a circle), ``below_cycle``.
    top: the end of the chain, or the smallest node of the circle. depth: links up to the end, or to
    the first node on the circle. path: from that node down to this one.

    Rows must be unique by (group, node): take :func:`latest_by` first. A parent is sought only
    within the group; null means none; a node may be its own parent (a circle of one). Rows with a
    null group or node are left out: nothing can name them. ``position`` (say, the start time) only
    puts related nodes near each other; without it nodes are taken by name. Empty in, empty out.
    """
    root = F.coalesce(F.col(f"`{is_root}`").cast("boolean"), F.lit(False)) if is_root else F.lit(True)
    none = F.lit(None).cast("array<string>")
    nodes = df.select(
        F.col(f"`{group}`").cast("string").alias("g"), F.col(f"`{node}`").cast("string").alias("id"), (F.coalesce(F.col(f"`{position}`").cast("long"), F.lit(0)) if position else F.lit(0)).cast("long").alias("pos"),
        F.col(f"`{parent}`").cast("string").alias("parent"), root.alias("r")).filter("g is not null and id is not null")
    # Written once: the range bounds are drawn from it, and the partitions are as many as its rows need.
    nodes = materialise(nodes)
    n = partitions or partitions_for(nodes, PART_ROWS)
    nodes = nodes.select(
        "g", "id", "pos", "parent", F.lit(1).cast("long").alias("w"), F.col("id").alias("low"), F.when(F.col("r"), "R").otherwise("E").alias("kind"), F.col("id").alias("top"), F.lit(0).cast("long").alias("depth"),
        (F.array("id") if with_paths else none).alias("seg"), (F.array("id") if with_paths else none).alias("path"))
    kinds = F.create_map(*[F.lit(x) for x in ("R", "rooted", "E", "detached", "C", "cycle", "B", "below_cycle")])
    out = _solve(nodes, n, with_paths)
    return out.select(F.col("g").alias(group), F.col("id").alias(node), kinds[F.substring("kind", 1, 1)].alias("kind"), "top", "depth", *(["path"] if with_paths else []))


def descendants(resolved: DataFrame, group: str, node: str, *keep: str) -> DataFrame:
    """(group, ancestor, descendant, distance, columns of the descendant to keep), one row per pair on a path: all descendants of every
    node as a relation, so a root over millions of nodes never becomes one array in one task.
    ``resolved`` must hold paths. Nodes on circles have no descendants beyond their own row's path."""
    pairs = resolved.select(f"`{group}`", F.col(f"`{node}`").alias("descendant"), F.col("depth").alias("d"), *keep, F.posexplode("path").alias("at", "ancestor"))
    return pairs.filter("ancestor <> descendant").select(f"`{group}`", "ancestor", "descendant", (F.col("d") - F.col("at")).cast("long").alias("distance"), *keep)
