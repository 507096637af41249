"""Parent-child rows to full hierarchies: nested-set ranges, paths, depths, roots, cycles.

Method: subtree sizes are summed upward, every node then gives its children consecutive preorder ranges by prefix sums
downward, and [lft, rgt] answers all ancestor and descendant questions: paths, descendants and sums over subtrees are read
from the ranges. Both passes double their stride (a node looks 1, 2, 4, ... steps up), so a chain of any depth takes as
many rounds as its depth has binary digits. A node that never arrives at a root is caught in a cycle or below one.

Trees never cross a group (a file). Groups of at most max_rows nodes are handled whole, many at once, with arrays in
Arrow batches; larger groups, however skewed, go through the same passes as joins, with no group in one task. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.session import materialize

MAX_ROWS = 100_000
BUCKETS = 64
#: Preorder numbers a task walks at a time, and entries of paths or pairs in one batch of results.
STRETCH, ENTRIES = 50_000, 200_000

COLUMNS = "grp string, node string, parent string, root string, depth int, lft bigint, rgt bigint, descendants bigint, in_cycle boolean"


def _newest() -> F.Column:
    return F.struct(F.coalesce("ingested_at", F.timestamp_seconds(F.lit(0))), F.xxhash64("parent_id", "child_sections"))


def current_links(sections: DataFrame) -> DataFrame:
    """(grp, node, parent) of the current rows (greatest ingested_at of doc_id and section_id).

    parent is parent_id if set, else the section of the file whose current child_sections names this one (the least, if several do).
    Rows without doc_id or section_id name no node and are left out; a blank parent_id is not set; a parent absent from the file becomes null.
    """
    now = sections.filter("doc_id IS NOT NULL AND section_id IS NOT NULL").groupBy(F.col("doc_id").alias("grp"), F.col("section_id").alias("node")).agg(F.max_by(F.struct("parent_id", "child_sections"), _newest()).alias("r"))
    now = now.select("grp", "node", F.nullif(F.trim("r.parent_id"), F.lit("")).alias("named"), F.col("r.child_sections").alias("children"))
    claimed = now.select("grp", F.explode("children").alias("node"), F.col("node").alias("claimant")).filter("node IS NOT NULL").groupBy("grp", "node").agg(F.min("claimant").alias("claimant"))
    linked = now.select("grp", "node", "named").join(claimed, ["grp", "node"], "left").select("grp", "node", F.coalesce("named", "claimant").alias("parent"))
    present = now.select("grp", F.col("node").alias("parent"), F.lit(True).alias("there"))
    return linked.join(present, ["grp", "parent"], "left").select("grp", "node", F.when(F.col("there"), F.col("parent")).alias("parent"))


def _bucket(node: F.Column | str) -> F.Column:
    return F.conv(F.substring(F.md5(node), 1, 2), 16, 10).cast("int") % BUCKETS


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """All groups of pdf at once; rows are sorted by grp, bkt, node (siblings keep that order)."""
    n = len(pdf)
    group = pd.factorize(pdf["grp"])[0]
    key = pd.MultiIndex.from_arrays([group, pdf["node"]])
    parent = np.asarray(key.get_indexer(pd.MultiIndex.from_arrays([group, pdf["parent"]])))
    parent[pdf["parent"].isna().to_numpy()] = -1
    up, size, depth, root = parent.copy(), np.ones(n, np.int64), (parent >= 0).astype(np.int64), np.arange(n)
    root[parent >= 0] = parent[parent >= 0]
    stride = 1
    while (far := np.flatnonzero(up >= 0)).size and stride <= n:  # upward: size counts what lies less than stride below
        at = up[far]
        gain = np.bincount(at, size[far], minlength=n).astype(np.int64)
        depth[far] += depth[at]
        root[far] = root[at]
        next_up = up.copy()
        next_up[far] = up[at]
        size, up, stride = size + gain, next_up, stride * 2
    free = up < 0
    # Downward: every node lies one and the sizes of its earlier siblings behind its parent.
    owner = np.where(parent >= 0, parent, -1 - group)
    order = np.lexsort((np.arange(n), owner))
    ends = np.cumsum(np.where(free[order], size[order], 0))
    first = np.r_[True, owner[order][1:] != owner[order][:-1]][:n]
    before = ends - np.where(free[order], size[order], 0)
    lft = np.zeros(n, np.int64)
    lft[order] = before - np.maximum.accumulate(np.where(first, before, 0)) + 1
    up = np.where(free, parent, -1)
    while (far := np.flatnonzero(up >= 0)).size:
        at = up[far]
        next_lft, next_up = lft.copy(), up.copy()
        next_lft[far] += lft[at]
        next_up[far] = up[at]
        lft, up = next_lft, next_up
    out = pd.DataFrame({"grp": pdf["grp"], "node": pdf["node"], "parent": pdf["parent"]})
    out["root"] = pd.Series(np.where(free, pdf["node"].to_numpy(object)[root], None) if n else [], index=out.index, dtype=object)
    for name, values in (("depth", depth.astype("int32")), ("lft", lft), ("rgt", lft + size - 1), ("descendants", size - 1)):
        out[name] = pd.Series(values, index=out.index).astype("Int64" if name != "depth" else "Int32").where(free)
    out["in_cycle"] = ~free
    return out


def _link(pdf: pd.DataFrame) -> pd.DataFrame:
    """current_links of whole groups (grp, node, named, children)."""
    key = pd.MultiIndex.from_arrays([pdf["grp"], pdf["node"]])
    parent = pdf["named"].to_numpy(object).copy()
    unset = {(g, x): i for i, (g, x, p) in enumerate(zip(pdf["grp"], pdf["node"], parent, strict=True)) if p is None}
    if unset:
        for g, x, children in zip(pdf["grp"], pdf["node"], pdf["children"], strict=True):
            for c in () if children is None else children:
                i = unset.get((g, c))
                if i is not None and (parent[i] is None or x < parent[i]):
                    parent[i] = x
    there = key.get_indexer(pd.MultiIndex.from_arrays([pdf["grp"], pd.Series(parent, dtype=object)])) >= 0
    return pd.DataFrame({"grp": pdf["grp"].to_numpy(object), "node": pdf["node"].to_numpy(object), "parent": np.where(there, parent, None), "bkt": pdf["bkt"].to_numpy()}).sort_values(["grp", "bkt", "node"], ignore_index=True)


def _batches(solve):
    """A function of whole groups, for rows that come sorted by grp."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in it:
            if not len(pdf):
                continue
            last = pdf["grp"].iloc[-1]
            cut = int((pdf["grp"] != last).to_numpy().nonzero()[0][-1]) + 1 if (pdf["grp"] != last).any() else 0
            if cut:
                yield solve(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True))
                held = [pdf.iloc[cut:]]
            elif held and held[-1]["grp"].iloc[-1] != last:
                yield solve(pd.concat(held, ignore_index=True))
                held = [pdf]
            else:
                held.append(pdf)
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return run


def _siblings(state: DataFrame) -> DataFrame:
    """state with offset: 1 and the sizes of earlier siblings, in two steps, so that no task holds all children of one parent."""
    owner = F.coalesce("parent", F.lit(""))
    sized = state.withColumns({"owner": owner, "bkt": _bucket("node")})
    sums = sized.groupBy("grp", "owner", "bkt").agg(F.sum("size").alias("s"))
    bases = sums.select("grp", "owner", "bkt", (F.sum("s").over(Window.partitionBy("grp", "owner").orderBy("bkt")) - F.col("s")).alias("base"))
    within = Window.partitionBy("grp", "owner", "bkt").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sized.withColumn("w", F.sum("size").over(within) - F.col("size")).join(bases, ["grp", "owner", "bkt"]).withColumn("offset", F.col("w") + F.col("base") + 1).drop("owner", "bkt", "w", "base")


def _rounds(links: DataFrame) -> DataFrame:
    """The same passes as joins, for groups too large for one task: a round a doubling, each written to the shared folder."""
    state = links.select("grp", "node", "parent", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size"), F.col("parent").isNotNull().cast("int").alias("depth"), F.coalesce("parent", "node").alias("root"))
    state = materialize(state, "tree")
    most = (links.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) if links.take(1) else 0
    stride = 1
    while stride <= most and not state.filter("up IS NOT NULL").isEmpty():
        above = state.select("grp", F.col("node").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"), F.col("root").alias("top"))
        gain = state.filter("up IS NOT NULL").groupBy("grp", F.col("up").alias("node")).agg(F.sum("size").alias("gain"))
        moved = state.filter("up IS NOT NULL").join(above, ["grp", "up"]).select("grp", "node", "parent", F.col("further").alias("up"), "size", (F.col("depth") + F.col("more")).alias("depth"), F.col("top").alias("root"))
        now = state.filter("up IS NULL").unionByName(moved).join(gain, ["grp", "node"], "left")
        state = materialize(now.select("grp", "node", "parent", "up", (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"), "depth", "root"), "tree")
        stride *= 2
    free = _siblings(state.filter("up IS NULL").select("grp", "node", "parent", "size", "depth", "root"))
    front = materialize(free.select("grp", "node", "parent", F.col("parent").alias("up"), "size", "depth", "root", F.col("offset").alias("lft")), "tree")
    while not front.filter("up IS NOT NULL").isEmpty():
        above = front.select("grp", F.col("node").alias("up"), F.col("up").alias("further"), F.col("lft").alias("more"))
        moved = front.filter("up IS NOT NULL").join(above, ["grp", "up"]).select("grp", "node", "parent", F.col("further").alias("up"), "size", "depth", "root", (F.col("lft") + F.col("more")).alias("lft"))
        front = materialize(front.filter("up IS NULL").unionByName(moved), "tree")
    done = front.select("grp", "node", "parent", "root", F.col("depth").cast("int").alias("depth"), "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"), (F.col("size") - 1).alias("descendants"), F.lit(False).alias("in_cycle"))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    caught = state.filter("up IS NOT NULL").select("grp", "node", "parent", null("string", "root"), null("int", "depth"), null("bigint", "lft"), null("bigint", "rgt"), null("bigint", "descendants"), F.lit(True).alias("in_cycle"))
    return done.unionByName(caught)


def hierarchy(links: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row a node of links (grp, node, parent, distinct by grp and node): COLUMNS.

    lft and rgt are preorder numbers within grp from 1; descendants of a node are the nodes of grp with lft in (lft, rgt].
    Siblings come in the order of a hash of their name, then their name. In a cycle or below one, in_cycle is true and
    the other results are null. An empty table gives no rows. max_rows only chooses between two ways to the same rows.
    """
    counted = links.groupBy("grp").agg(F.count("*").alias("n"))
    large = counted.filter(F.col("n") > max_rows).select("grp")
    some = large.take(1)
    small = links.join(large, "grp", "left_anti") if some else links
    solved = small.select("grp", "node", "parent", _bucket("node").alias("bkt")).repartition("grp").sortWithinPartitions("grp", "bkt", "node").mapInPandas(_batches(_solve), COLUMNS)
    return solved.unionByName(_rounds(links.join(large, "grp", "left_semi"))) if some else solved


def sections_tree(sections: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """hierarchy(current_links(sections)) with one shuffle: rows of a file of at most max_rows go to one task, which finds current rows, links and ranges.

    Larger files, found by a count of the key alone, go by the joins.
    """
    usable = sections.filter("doc_id IS NOT NULL AND section_id IS NOT NULL")
    large = usable.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > max_rows).select("doc_id")
    some = large.take(1)
    small = usable.join(large, "doc_id", "left_anti") if some else usable
    rows = small.select(F.col("doc_id").alias("grp"), F.col("section_id").alias("node"), "parent_id", "child_sections", "ingested_at").repartition("grp")
    now = rows.groupBy("grp", "node").agg(F.max_by(F.struct("parent_id", "child_sections"), _newest()).alias("r"))
    now = now.select("grp", "node", F.nullif(F.trim("r.parent_id"), F.lit("")).alias("named"), F.col("r.child_sections").alias("children"), _bucket("node").alias("bkt"))
    solved = now.sortWithinPartitions("grp", "node").mapInPandas(_batches(lambda pdf: _solve(_link(pdf))), COLUMNS)
    return solved.unionByName(_rounds(current_links(usable.join(large, "doc_id", "left_semi")))) if some else solved


def _walked(tree: DataFrame, stretch: int, visit, schema: str) -> DataFrame:
    """visit(ancestors, row) over all nodes in preorder; ancestors is the stack of (rgt, node) above and with the node.

    A task walks stretch numbers of a group at a time. It begins with the ancestors of its first number, which are the
    nodes whose range goes over the border before it: no group is in one task.
    """
    inner = tree.filter("NOT in_cycle")
    block = lambda c: F.floor(F.col(c) / stretch)
    own = inner.select("grp", "node", "depth", "lft", "rgt", block("lft").alias("blk"), F.lit(True).alias("own"))
    over = inner.filter(block("rgt") > block("lft")).select("grp", "node", "depth", "lft", "rgt", F.explode(F.sequence(block("lft") + 1, block("rgt"))).alias("blk"), F.lit(False).alias("own"))

    def walk(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stack = None, []
        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in it:
            rows, entries = [], 0
            for grp, node, depth, lft, rgt, blk, own_ in zip(pdf["grp"], pdf["node"], pdf["depth"].tolist(), pdf["lft"].tolist(), pdf["rgt"].tolist(), pdf["blk"].tolist(), pdf["own"].tolist(), strict=True):
                if at != (grp, blk):
                    at, stack = (grp, blk), []
                while stack and stack[-1][0] < lft:
                    stack.pop()
                stack.append((rgt, node))
                if own_:
                    for row in visit(stack, grp, node, depth):
                        rows.append(row)
                        entries += len(stack) if len(row) == 3 else 1
                        if entries >= ENTRIES:
                            yield pd.DataFrame(rows, columns=names)
                            rows, entries = [], 0
            yield pd.DataFrame(rows, columns=names)

    return own.unionByName(over).repartition("grp", "blk").sortWithinPartitions("grp", "blk", "lft").mapInPandas(walk, schema)


def paths(tree: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(grp, node, path) of the nodes outside cycles, from the root to the node, read from the ranges."""
    return _walked(tree, stretch, lambda stack, grp, node, depth: [(grp, node, [x for _, x in stack])], "grp string, node string, path array<string>")


def with_paths(tree: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """tree with path; null in a cycle or below one. As large as all paths together: ask for it where trees are shallow."""
    return tree.join(paths(tree, stretch), ["grp", "node"], "left")


def descendants(tree: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(grp, ancestor, descendant, distance) for every pair on a path, read from the ranges."""
    return _walked(tree, stretch, lambda stack, grp, node, depth: ((grp, x, node, depth - i) for i, (_, x) in enumerate(stack[:-1])), "grp string, ancestor string, descendant string, distance int")


def subtree_sums(tree: DataFrame, value: str, stretch: int = STRETCH) -> DataFrame:
    """(grp, node, total): the sum of value over each node and all below it, as a difference of two prefix sums over lft. Prefix sums go by stretches, then over the stretches."""
    inner = tree.filter("NOT in_cycle").select("grp", "node", "lft", "rgt", F.coalesce(value, F.lit(0)).alias("v"), F.floor(F.col("lft") / stretch).alias("blk"))
    within = Window.partitionBy("grp", "blk").orderBy("lft").rowsBetween(Window.unboundedPreceding, 0)
    sums = inner.groupBy("grp", "blk").agg(F.sum("v").alias("s"))
    bases = sums.select("grp", "blk", (F.sum("s").over(Window.partitionBy("grp").orderBy("blk")) - F.col("s")).alias("base"))
    prefix = inner.withColumn("w", F.sum("v").over(within)).join(bases, ["grp", "blk"]).select("grp", "node", "lft", "rgt", "v", (F.col("w") + F.col("base")).alias("upto"))
    last = prefix.select("grp", F.col("lft").alias("rgt"), F.col("upto").alias("end"))
    return prefix.join(last, ["grp", "rgt"]).select("grp", "node", (F.col("end") - F.col("upto") + F.col("v")).alias("total"))
