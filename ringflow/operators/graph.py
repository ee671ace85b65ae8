"""Vertex sets, degrees, reduction, components of a directed edge table (src, dst, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import numbered, running_total
from ..functions.tables import drop_table, write_table
from . import kernels

#: Edges that one task may hold (16 to 24 bytes each as they come in); larger graphs take plans of joins.
KERNEL_EDGES = 2_000_000
#: Vertices whose ids may be broadcast.
BROADCAST_IDS = 2_000_000


def vertices(edges: DataFrame) -> DataFrame:
    """id: every src or dst once."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def source_vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).distinct()


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("deg"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, n_in, n_out of every vertex; one shuffle of partial sums."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"))


def dense_ids(edges: DataFrame) -> DataFrame:
    """id, dense: ids numbered 0, 1, ... in ascending order."""
    return running_total(write_table(vertices(edges), "vertices"), "id", F.lit(1), "dense")


def csr_offsets(edges: DataFrame) -> DataFrame:
    """id, deg, begin: where each source's edges begin in an adjacency array sorted by source."""
    return running_total(write_table(out_degree(edges), "degrees"), "id", F.col("deg"), "begin")


def adjacency(edges: DataFrame, at: str = "src", of: str = "dst") -> DataFrame:
    """id, neighbours: comma-joined successors in ascending order, parallel edges repeated.

    A vertex's list is one value, so it is as long as its degree.
    """
    return edges.groupBy(F.col(at).alias("id")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(of)), lambda x: x.cast("string"))).alias("neighbours"))


def reverse_adjacency(edges: DataFrame) -> DataFrame:
    """id, neighbours: the same for predecessors."""
    return adjacency(edges, "dst", "src")


def encode(edges: DataFrame) -> DataFrame:
    """Edges with both ends replaced by dense ids."""
    ids = dense_ids(edges)
    a, b = ids.select(F.col("id").alias("src"), F.col("dense").alias("dsrc")), ids.select(F.col("id").alias("dst"), F.col("dense").alias("ddst"))
    return edges.join(a, "src").join(b, "dst")


def with_onward_edges(edges: DataFrame) -> DataFrame:
    """Semi-join: edges whose dst is the src of some edge."""
    heads = edges.select(F.col("src").alias("head")).distinct()
    return edges.join(heads, edges["dst"] == heads["head"], "left_semi")


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def hinted(ids: DataFrame) -> DataFrame:
    """A table of ids marked for broadcast if there are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def trim(edges: DataFrame, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """Peel until every src is some edge's dst and every dst some edge's src.

    Rounds of joins take a layer off both sides each, until nothing changes or what
    is left fits one task, which finishes it.
    """
    table = write_table(edges, "trim")
    n = table.count()
    while n > kernel_edges:
        srcs, dsts = table.select(F.col("src").alias("head")).distinct(), table.select(F.col("dst").alias("tail")).distinct()
        nxt = write_table(table.join(srcs, table["dst"] == srcs["head"], "left_semi").join(dsts, table["src"] == dsts["tail"], "left_semi"), "trim")
        m = nxt.count()
        drop_table(table)
        table = nxt
        if m == n:
            return table
        n = m
    if not n:
        return table
    live = write_table(kernels.in_one_task(table.select("src", "dst"), kernels.trimmed, "id bigint"), "live")
    few = hinted(live)
    heads, tails = few.withColumnRenamed("id", "head"), few.withColumnRenamed("id", "tail")
    core = write_table(table.join(heads, table["src"] == heads["head"], "left_semi").join(tails, table["dst"] == tails["tail"], "left_semi"), "trim")
    drop_table(table, live)
    return core


def chain_peel(edges: DataFrame, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """id, parent, size of vertices removed while they have in-degree 0 and out-degree 1 (parallel edges counted).

    Peeling u -> v adds size(u) + 1 to size(v). Rounds of joins take a layer each,
    until what is left fits one task, which finishes it. Sizes are kept for vertices
    that others have been peeled into.
    """
    live = write_table(edges.select("src", "dst"), "peel")
    sizes = write_table(edges.select(F.col("src").alias("id"), F.lit(0).cast("bigint").alias("size")).limit(0), "sizes")
    out = sizes.select("id", F.col("id").alias("parent"), "size")
    while live.count() > kernel_edges:
        deg = degrees(live)
        leaf = deg.where("n_in = 0 AND n_out = 1").select("id")
        found = live.join(leaf, live["src"] == leaf["id"]).select("id", F.col("dst").alias("parent"))
        peeled = write_table(found.join(sizes, "id", "left").select("id", "parent", F.coalesce("size", F.lit(0)).alias("size")), "peeled")
        if not peeled.limit(1).count():
            return out
        out = out.unionByName(peeled)
        gain = peeled.select(F.col("parent").alias("id"), (F.col("size") + 1).alias("size"))
        gone = peeled.select(F.col("id").alias("src"))
        kept = sizes.join(peeled.select("id"), "id", "left_anti").unionByName(gain).groupBy("id").agg(F.sum("size").alias("size"))
        nxt_sizes, nxt_live = write_table(kept, "sizes"), write_table(live.join(gone, "src", "left_anti"), "peel")
        drop_table(live)
        sizes, live = nxt_sizes, nxt_live
    sized = live.join(sizes.withColumnRenamed("id", "src"), "src", "left").select("src", "dst", F.coalesce("size", F.lit(0)).alias("size"))
    return out.unionByName(kernels.in_one_task(sized, kernels.peeled, "id bigint, parent bigint, size bigint"))


def scc_labels(edges: DataFrame, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """id, scc: the smallest id of each vertex's strongly connected component.

    A graph of up to ``kernel_edges`` edges goes to one task. A larger one is
    trimmed first, which settles vertices on no cycle; if it is still too large,
    colours spread: each vertex takes the smallest id that reaches it, and the part
    of a colour that reaches back to its root is a component.
    """
    core = write_table(without_loops(edges.select("src", "dst")).distinct(), "pairs")
    if core.count() > kernel_edges:
        core = trim(core, kernel_edges)
    if core.count() <= kernel_edges:
        found = kernels.in_one_task(core, kernels.strong_components, "id bigint, scc bigint")
    else:
        found = _colour_components(core)
    return vertices(edges).join(found, "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))


def _spread(start: DataFrame, pairs: DataFrame) -> DataFrame:
    """Fixpoint of ``start`` (id, label) under the minimum along ``pairs`` (a -> b)."""
    state = write_table(start, "spread")
    while True:
        came = pairs.join(state, pairs["a"] == state["id"]).groupBy("b").agg(F.min("label").alias("came"))
        nxt = write_table(state.join(came, state["id"] == came["b"], "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("came", "label")).alias("label")), "spread")
        drop_table(state)
        done = not nxt.where("label < was").limit(1).count()
        path = nxt._ringflow_path
        state = nxt.select("id", "label")
        state._ringflow_path = path
        if done:
            return state


def _colour_components(core: DataFrame) -> DataFrame:
    out = None
    while core.limit(1).count():
        ids = vertices(core)
        colour = _spread(ids.select("id", F.col("id").alias("label")), core.select(F.col("src").alias("a"), F.col("dst").alias("b")))
        a, b = colour.select(F.col("id").alias("src"), F.col("label").alias("ca")), colour.select(F.col("id").alias("dst"), F.col("label").alias("cb"))
        inside = write_table(core.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", "ca"), "inside")
        # backwards from the root of each colour: 0 marks those that reach it
        back = _spread(colour.select("id", F.when(F.col("id") == F.col("label"), 0).otherwise(1).alias("label")), inside.select(F.col("dst").alias("a"), F.col("src").alias("b")))
        settled = write_table(back.where("label = 0").select("id").join(colour, "id").select("id", F.col("label").alias("scc")), "scc")
        out = settled if out is None else out.unionByName(settled)
        gone = settled.select("id")
        core = write_table(core.join(gone, core["src"] == gone["id"], "left_anti").join(gone, F.col("dst") == gone["id"], "left_anti"), "core")
    return out if out is not None else core.select(F.col("src").alias("id"), F.col("dst").alias("scc"))


def tree_parents(edges: DataFrame) -> DataFrame:
    """id, parent: vertices with one way out that leads into another component."""
    e = without_loops(edges)
    scc = write_table(scc_labels(e), "scc")
    single = out_degree(e).where("deg = 1").select(F.col("id").alias("src"))
    a, b = scc.select(F.col("id").alias("src"), F.col("scc").alias("sa")), scc.select(F.col("id").alias("dst"), F.col("scc").alias("sb"))
    return e.select("src", "dst").join(single, "src", "left_semi").join(a, "src").join(b, "dst").where("sa <> sb").select(F.col("src").alias("id"), F.col("dst").alias("parent"))


def tree_places(parents: DataFrame) -> DataFrame:
    """id, root, depth, size of all vertices of a forest (id, parent); size counts descendants.

    Pointers double: after k rounds each vertex points to its ancestor 2^k above, and
    size counts what lies less than 2^k below. So rounds are logarithmic in the depth.
    """
    ids = parents.select(F.explode(F.array("id", "parent")).alias("id")).distinct()
    one = F.lit(1).cast("bigint")
    state = write_table(
        ids.join(parents, "id", "left").select("id", F.col("parent").alias("jump"), F.coalesce("parent", "id").alias("root"), F.when(F.col("parent").isNotNull(), one).otherwise(F.lit(0)).alias("depth"), one.alias("size")),
        "forest",
    )
    while state.where("jump IS NOT NULL").limit(1).count():
        above = state.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("root").alias("top"), F.col("depth").alias("further"))
        below = state.where("jump IS NOT NULL").groupBy(F.col("jump").alias("id")).agg(F.sum("size").alias("more"))
        nxt = write_table(
            state.join(above, "jump", "left").join(below, "id", "left").select(
                "id", F.col("next").alias("jump"), F.coalesce("top", "root").alias("root"), (F.col("depth") + F.coalesce("further", F.lit(0))).alias("depth"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")
            ),
            "forest",
        )
        drop_table(state)
        state = nxt
    return state.select("id", "root", "depth", (F.col("size") - 1).alias("size"))


def in_tree_sizes(edges: DataFrame) -> DataFrame:
    """id, root, depth, size: place of every vertex in the forest of ``tree_parents``; size counts descendants."""
    places = tree_places(write_table(tree_parents(edges), "parents"))
    none = F.lit(0).cast("bigint")
    return vertices(edges).join(places, "id", "left").select("id", F.coalesce("root", "id").alias("root"), F.coalesce("depth", none).alias("depth"), F.coalesce("size", none).alias("size"))


def _both_ways(edges: DataFrame) -> DataFrame:
    """src, dst: every edge and its reverse once, written, without loops."""
    return write_table(without_loops(edges).select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst").distinct(), "both")


def weak_labels(edges: DataFrame, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """id, part: the smallest id of each vertex's component, directions ignored; by one task for up to ``kernel_edges`` edges, by rounds of joins for more."""
    if edges.count() <= kernel_edges:
        return kernels.in_one_task(edges.select("src", "dst"), kernels.weak_parts, "id bigint, part bigint")
    both = _both_ways(edges)
    return _spread(vertices(edges).select("id", F.col("id").alias("label")), both.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("label", "part")


def breadth_first_order(edges: DataFrame) -> DataFrame:
    """id, level, place: vertices by the number of steps, along edges or against them, from their component's smallest id.

    ``place`` numbers them 0, 1, ... by that id, level and id, so neighbours get
    near numbers.
    """
    both = _both_ways(edges)
    part = _spread(vertices(edges).select("id", F.col("id").alias("label")), both.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    seen = write_table(part.where("id = label").select("id", F.col("label").alias("root"), F.lit(0).cast("bigint").alias("level")), "seen")
    front = seen
    while front.limit(1).count():
        step = both.join(front, both["src"] == front["id"]).select(F.col("dst").alias("id"), "root", (F.col("level") + 1).alias("level")).distinct()
        front = write_table(step.join(seen.select("id"), "id", "left_anti"), "seen")
        seen = seen.unionByName(front)
    return numbered(write_table(seen, "levels"), ["root", "level", "id"], "place").select("id", "level", (F.col("place") - 1).alias("place"))
