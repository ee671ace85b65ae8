"""One query for each operator over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.ordered import numbered
from ..functions.tables import new_path, write_table
from ..operators import centrality, cycles, graph
from ..sources import edges as src
from ..sources import export


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as transfers."""
    return src.order_transfers(spark, sf_dir)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of low degree, for paths and cycles: their number grows with a power of it."""
    return src.order_transfers(spark, sf_dir, src.DENSE)


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of lower degree still, for what a dense graph has none of: tails, trees and components."""
    return src.order_transfers(spark, sf_dir, src.SPARSE)


def written(view, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as a table, for plans that read their edges many times."""
    return write_table(view(spark, sf_dir), "view")


def every_source(edges: DataFrame) -> DataFrame:
    """All vertices with a positive edge."""
    return graph.vertices(centrality.positive(edges))


def _ids(n: int) -> list[str]:
    return [f"v{i}" for i in range(1, n + 1)]


Q: dict = {}


def query(f):
    Q[f.__name__] = f
    return f


@query
def edges_scan(spark, sf_dir):
    return whole(spark, sf_dir).select("src", "dst")


@query
def edges_cents(spark, sf_dir):
    return whole(spark, sf_dir).select("src", "dst", "cents")


@query
def positive_weight_filter(spark, sf_dir):
    shifted = whole(spark, sf_dir).withColumn("weight", F.col("weight") - 5)
    return src.positive_weights(shifted).select("src", "dst", "weight")


def _through_csv(spark: SparkSession, edges: DataFrame, third, read) -> DataFrame:
    """The edges written as lines to the shared folder and read by one of the CSV sources."""
    path = new_path(spark, "csv")
    export.write_edges(edges, path, third)
    return read(spark, path)


@query
def scan_topology(spark, sf_dir):
    return _through_csv(spark, whole(spark, sf_dir), scalars.amount_text(F.col("cents")), src.read_topology)


@query
def scan_vertex_ids(spark, sf_dir):
    return graph.vertices(_through_csv(spark, whole(spark, sf_dir), F.floor(F.col("cents") / 100), src.read_topology))


@query
def scan_whole_amounts(spark, sf_dir):
    return _through_csv(spark, whole(spark, sf_dir), F.floor(F.col("cents") / 100), src.read_transfers)


@query
def scan_decimal_amounts(spark, sf_dir):
    # a third each of amounts without decimals, with one, and with two
    rounded = F.when(F.col("cents") % 3 == 0, F.floor(F.col("cents") / 100) * 100).when(F.col("cents") % 3 == 1, F.floor(F.col("cents") / 10) * 10).otherwise(F.col("cents"))
    return _through_csv(spark, whole(spark, sf_dir), scalars.amount_text(rounded), src.read_transfers)


@query
def scan_positive_weights(spark, sf_dir):
    return _through_csv(spark, whole(spark, sf_dir), F.col("weight") - 5, src.read_weighted)


@query
def max_weight(spark, sf_dir):
    return whole(spark, sf_dir).agg(F.max("weight").alias("max_weight"))


@query
def money_ratio_pairs(spark, sf_dir):
    return cycles.consecutive_pairs(whole(spark, sf_dir))


@query
def nation_trade(spark, sf_dir):
    return src.nation_trade(spark, sf_dir)


@query
def out_degree(spark, sf_dir):
    return graph.out_degree(whole(spark, sf_dir))


@query
def in_degree(spark, sf_dir):
    return graph.in_degree(whole(spark, sf_dir))


@query
def degrees(spark, sf_dir):
    return graph.degrees(whole(spark, sf_dir))


@query
def in0_out1_count(spark, sf_dir):
    return graph.degrees(sparse(spark, sf_dir)).agg(F.count_if((F.col("n_in") == 0) & (F.col("n_out") == 1)).alias("n"))


@query
def vertices_union(spark, sf_dir):
    return graph.vertices(whole(spark, sf_dir))


@query
def source_vertices(spark, sf_dir):
    return graph.source_vertices(whole(spark, sf_dir))


@query
def dense_ids(spark, sf_dir):
    return graph.dense_ids(whole(spark, sf_dir))


@query
def edges_encoded(spark, sf_dir):
    return graph.encode(written(whole, spark, sf_dir)).select("dsrc", "ddst", "weight")


@query
def csr_offsets(spark, sf_dir):
    return graph.csr_offsets(whole(spark, sf_dir))


@query
def adjacency_sorted(spark, sf_dir):
    return graph.adjacency(whole(spark, sf_dir))


@query
def reverse_adjacency_sorted(spark, sf_dir):
    return graph.reverse_adjacency(whole(spark, sf_dir))


@query
def id_digits(spark, sf_dir):
    return graph.vertices(whole(spark, sf_dir)).select("id", scalars.digits(F.col("id")).alias("digits"))


@query
def breadth_first_order(spark, sf_dir):
    return graph.breadth_first_order(written(sparse, spark, sf_dir))


@query
def edges_semi_join(spark, sf_dir):
    return graph.with_onward_edges(written(whole, spark, sf_dir)).select("src", "dst", "cents")


@query
def edges_trimmed(spark, sf_dir):
    return graph.trim(graph.without_loops(sparse(spark, sf_dir))).select("src", "dst", "cents")


@query
def packed_edges(spark, sf_dir):
    p = whole(spark, sf_dir).select(scalars.pack_id_weight(F.col("dst"), F.col("weight")).alias("packed"))
    return p.select("packed", scalars.unpack_id(F.col("packed")).alias("id"), scalars.unpack_weight(F.col("packed")).alias("weight"))


@query
def two_hop_forward(spark, sf_dir):
    return cycles.CyclePlan(dense(spark, sf_dir), True).open_paths(3).select("v1", "v2", "v3", "first", "last")


@query
def back3_paths(spark, sf_dir):
    return cycles.CyclePlan(dense(spark, sf_dir), True).ways_back(2).select("v1", "h", "b1", "b2", "first_back", "last_back")


@query
def back4_paths(spark, sf_dir):
    return cycles.CyclePlan(dense(spark, sf_dir), True).ways_back(3).select("v1", "h", "b1", "b2", "b3", "first_back", "last_back")


@query
def returning_pairs(spark, sf_dir):
    return cycles.CyclePlan(dense(spark, sf_dir), False).returning(0, 2)


def _of_length(n: int, ratio: bool):
    def run(spark, sf_dir):
        return cycles.cycles_of_length(dense(spark, sf_dir), n, ratio)

    return run


for _n in range(3, 9):
    if _n < 8:
        Q[f"cycles{_n}_plain"] = _of_length(_n, False)
    Q[f"cycles{_n}_ratio"] = _of_length(_n, True)


@query
def cycles_all_plain(spark, sf_dir):
    return numbered(cycles.written_cycles(dense(spark, sf_dir), 7, False), ["len", *_ids(7)])


@query
def cycles_all_ratio(spark, sf_dir):
    return numbered(cycles.written_cycles(dense(spark, sf_dir), 8, True), ["len", *_ids(8)])


@query
def cycle_counts_by_length(spark, sf_dir):
    return cycles.counts_by_length(cycles.all_cycles(dense(spark, sf_dir), 8, True))


@query
def cycle_lines_text(spark, sf_dir):
    return export.cycle_lines(cycles.written_cycles(dense(spark, sf_dir), 8, True))


@query
def cycle_lines_plain(spark, sf_dir):
    return export.cycle_lines(cycles.written_cycles(dense(spark, sf_dir), 7, False))


@query
def count_digits(spark, sf_dir):
    return cycles.counts_by_length(cycles.all_cycles(dense(spark, sf_dir), 8, True)).select("len", scalars.digits(F.col("n")).alias("digits"))


@query
def sssp_distances(spark, sf_dir):
    e = written(sparse, spark, sf_dir)
    return centrality.shortest_distances(e, every_source(e))


@query
def shortest_path_dag(spark, sf_dir):
    e = written(sparse, spark, sf_dir)
    return centrality.all_shortest_path_edges(e, every_source(e))


@query
def shortest_path_counts(spark, sf_dir):
    e = written(sparse, spark, sf_dir)
    return centrality.all_shortest_path_counts(e, every_source(e)).select("s", "v", F.col("sigma").cast("bigint").alias("sigma"))


@query
def betweenness_scores(spark, sf_dir):
    return centrality.betweenness(written(sparse, spark, sf_dir)).select("id", scalars.rounded_score(F.col("score")).alias("score"))


@query
def betweenness_by_joins(spark, sf_dir):
    e = written(sparse, spark, sf_dir)
    scores = centrality.betweenness_by_joins(e, every_source(e))
    return scores.select("id", scalars.rounded_score(F.col("score")).alias("score"))


@query
def betweenness_top100(spark, sf_dir):
    return centrality.top_scores(centrality.betweenness(written(sparse, spark, sf_dir)))


@query
def betweenness_lines_text(spark, sf_dir):
    return export.score_lines(centrality.top_scores(centrality.betweenness(written(sparse, spark, sf_dir))))


@query
def betweenness_compressed(spark, sf_dir):
    return centrality.top_scores(centrality.betweenness_compressed(written(sparse, spark, sf_dir)))


@query
def scc_labels(spark, sf_dir):
    return graph.scc_labels(written(sparse, spark, sf_dir))


@query
def chain_peel(spark, sf_dir):
    return graph.chain_peel(graph.without_loops(written(sparse, spark, sf_dir)))


@query
def in_tree_sizes(spark, sf_dir):
    return graph.in_tree_sizes(written(sparse, spark, sf_dir))


QUERIES = dict(Q)


# --- the same in SQL -------------------------------------------------------------


def _view(name: str, priorities: tuple[str, ...] = ()) -> str:
    listed = ", ".join(f"'{p}'" for p in priorities)
    some = f" AND pr IN ({listed})" if priorities else ""
    return f"""{name} AS (SELECT src, dst, cents, weight FROM (
      SELECT o_custkey AS src, LEAD(o_custkey) OVER (ORDER BY o_orderkey) AS dst, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents,
             CAST(1 + o_orderkey % 97 AS BIGINT) AS weight, o_orderpriority AS pr FROM orders) x WHERE dst IS NOT NULL{some})"""


WHOLE_SQL, DENSE_SQL, SPARSE_SQL = _view("t"), _view("d", src.DENSE), _view("p", src.SPARSE)
WHOLE_VERTICES = "v AS (SELECT src AS id FROM t UNION SELECT dst FROM t)"
VERTICES = "v AS (SELECT src AS id FROM p UNION SELECT dst FROM p)"


def _ratio(x: str, y: str) -> str:
    return f"{x} <= 5 * {y} AND {y} <= 3 * {x}"


def _path_sql(k: int, ratio: bool, closed: bool, forward: bool = True) -> tuple[str, list[str]]:
    """FROM ... WHERE of a k-edge chain over d without loops, and its vertices in order."""
    names = [f"e{i}" for i in range(1, k + 1)]
    text = f"d {names[0]}"
    verts = [f"{names[0]}.src"] + [f"{n}.dst" for n in names]
    if closed:
        verts = verts[:-1]
    for i, n in enumerate(names[1:], 1):
        on = [f"{names[i - 1]}.dst = {n}.src"]
        if closed and i == k - 1:
            on.append(f"{n}.dst = e1.src")
        if ratio:
            on.append(_ratio(f"{names[i - 1]}.cents", f"{n}.cents"))
        text += f" JOIN d {n} ON " + " AND ".join(on)
    root, others = (verts[0], verts[1:]) if forward else (verts[-1], verts[:-1])
    where = [f"{x} > {root}" for x in others] + [f"{a} <> {b}" for i, a in enumerate(others) for b in others[i + 1 :]]
    if closed and ratio:
        where.append(_ratio(f"{names[-1]}.cents", "e1.cents"))
    return f"{text} WHERE {' AND '.join(where)}", verts


def _cycle_sql(n: int, ratio: bool) -> str:
    body, verts = _path_sql(n, ratio, True)
    return f"SELECT {', '.join(f'{v} AS v{i}' for i, v in enumerate(verts, 1))} FROM {body}"


def _all_sql(max_len: int, ratio: bool) -> str:
    parts = []
    for n in range(3, max_len + 1):
        body, verts = _path_sql(n, ratio, True)
        cols = [f"{v} AS v{i}" for i, v in enumerate(verts, 1)] + [f"CAST(NULL AS BIGINT) AS v{i}" for i in range(n + 1, max_len + 1)]
        parts.append(f"SELECT CAST({n} AS INT) AS len, {', '.join(cols)} FROM {body}")
    return " UNION ALL ".join(parts)


def _order(n: int) -> str:
    return ", ".join(["len"] + [f"v{i} NULLS FIRST" for i in range(1, n + 1)])


_TRIMMED = """
r AS (SELECT DISTINCT src AS a, dst AS b FROM l UNION SELECT r.a, l.dst FROM r JOIN l ON r.b = l.src),
c AS (SELECT a AS id FROM r WHERE a = b),
from_c AS (SELECT id FROM c UNION SELECT b FROM r JOIN c ON r.a = c.id),
to_c AS (SELECT id FROM c UNION SELECT a FROM r JOIN c ON r.b = c.id)"""

_TRIMMED_DENSE = f"WITH RECURSIVE {DENSE_SQL}, l AS (SELECT * FROM d WHERE src <> dst), {_TRIMMED}, k AS (SELECT * FROM l WHERE src IN (SELECT id FROM from_c) AND dst IN (SELECT id FROM to_c))"


def _trim_paths(select: str) -> str:
    return _TRIMMED_DENSE.replace("WITH RECURSIVE d AS", "WITH RECURSIVE d0 AS").replace("FROM d WHERE", "FROM d0 WHERE") + f", d AS (SELECT * FROM k) {select}"


def _path_query(k: int, forward: bool) -> str:
    body, verts = _path_sql(k, True, False, forward)
    if forward:
        cols = [f"{v} AS v{i}" for i, v in enumerate(verts, 1)] + ["e1.cents AS first", f"e{k}.cents AS last"]
    else:
        cols = [f"{verts[-1]} AS v1", f"{verts[0]} AS h"] + [f"{v} AS b{i}" for i, v in enumerate(verts[1:-1], 1)] + ["e1.cents AS first_back", f"e{k}.cents AS last_back"]
    return _trim_paths(f"SELECT {', '.join(cols)} FROM {body}")


_SCC = """
r AS (SELECT DISTINCT src AS a, dst AS b FROM p UNION SELECT r.a, p.dst FROM r JOIN p ON r.b = p.src),
scc AS (SELECT v.id, LEAST(v.id, COALESCE(MIN(r.b), v.id)) AS scc FROM v LEFT JOIN (SELECT r.a, r.b FROM r JOIN r q ON r.a = q.b AND r.b = q.a) r ON v.id = r.a GROUP BY v.id)"""

_TREES = f"""
l AS (SELECT src, dst FROM p WHERE src <> dst),
par AS (SELECT l.src AS id, l.dst AS parent FROM l JOIN (SELECT src FROM l GROUP BY src HAVING COUNT(*) = 1) o ON l.src = o.src
  JOIN scc a ON l.src = a.id JOIN scc b ON l.dst = b.id WHERE a.scc <> b.scc),
up AS (SELECT id, parent AS up, CAST(1 AS BIGINT) AS depth FROM par UNION ALL SELECT up.id, par.parent, up.depth + 1 FROM up JOIN par ON up.up = par.id)"""


# lev(id, root, level): steps in either direction from the smallest id of a component
_LEVELS = """
b AS (SELECT src AS x, dst AS y FROM p WHERE src <> dst UNION SELECT dst, src FROM p WHERE src <> dst),
lab(id, root) USING KEY (id) AS (
  SELECT id, id FROM v
  UNION
  SELECT o.id, q.root FROM (SELECT b.y AS id, MIN(l.root) AS root FROM lab l JOIN b ON l.id = b.x GROUP BY b.y) q JOIN recurring.lab o ON o.id = q.id WHERE q.root < o.root),
lev(id, root, level) USING KEY (id) AS (
  SELECT id, root, CAST(0 AS BIGINT) FROM lab WHERE id = root
  UNION
  SELECT n.id, n.root, n.level FROM (SELECT b.y AS id, l.root, MIN(l.level) + 1 AS level FROM lev l JOIN b ON l.id = b.x GROUP BY b.y, l.root) n LEFT JOIN recurring.lev o ON o.id = n.id WHERE o.id IS NULL)"""

# dist(s, t, d) over positive weights without loops, from all vertices
_DISTANCES = """
w AS (SELECT src, dst, weight FROM p WHERE weight > 0 AND src <> dst),
v AS (SELECT src AS id FROM w UNION SELECT dst FROM w),
dist(s, t, d) USING KEY (s, t) AS (
  SELECT id, id, CAST(0 AS BIGINT) FROM v
  UNION
  SELECT n.s, n.t, n.d FROM (SELECT x.s, w.dst AS t, MIN(x.d + w.weight) AS d FROM dist x JOIN w ON x.t = w.src GROUP BY x.s, w.dst) n
  LEFT JOIN recurring.dist o ON n.s = o.s AND n.t = o.t WHERE o.d IS NULL OR n.d < o.d),
dag AS (SELECT a.s, w.src AS u, w.dst AS v FROM dist a JOIN w ON a.t = w.src JOIN dist b ON b.s = a.s AND b.t = w.dst AND a.d + w.weight = b.d)"""


_PATHS = """
ways AS (SELECT s, id AS t, id AS src0, 1 AS hop FROM (SELECT DISTINCT s, s AS id FROM dist) UNION ALL SELECT y.s, g.v, y.src0, y.hop + 1 FROM ways y JOIN dag g ON y.s = g.s AND y.t = g.u),
sigma AS (SELECT s, t AS v, COUNT(*) AS sigma FROM ways GROUP BY s, t)"""

_SCORES = _PATHS + """,
back AS (SELECT g.s, g.u, CAST(1 AS DOUBLE) / o.sigma AS x FROM dag g JOIN sigma o ON g.s = o.s AND g.v = o.v
  UNION ALL SELECT b.s, g.u, b.x FROM back b JOIN dag g ON b.s = g.s AND b.u = g.v),
sc AS (SELECT b.u AS id, SUM(b.x * o.sigma) AS score FROM (SELECT s, u, SUM(x) AS x FROM back GROUP BY s, u) b JOIN sigma o ON b.s = o.s AND b.u = o.v WHERE b.s <> b.u GROUP BY b.u)"""

_EVERY = f"WITH RECURSIVE {SPARSE_SQL}, {_DISTANCES}"
_TOP = """SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, score FROM (
  SELECT v.id, ROUND(COALESCE(sc.score, 0) + 1e-7, 3) AS score FROM v LEFT JOIN sc ON v.id = sc.id) ORDER BY score DESC, id LIMIT 100"""

ORACLE_SQL = {
    "edges_scan": f"WITH {WHOLE_SQL} SELECT src, dst FROM t",
    "edges_cents": f"WITH {WHOLE_SQL} SELECT src, dst, cents FROM t",
    "positive_weight_filter": f"WITH {WHOLE_SQL} SELECT src, dst, weight - 5 AS weight FROM t WHERE weight - 5 > 0",
    "scan_topology": f"WITH {WHOLE_SQL} SELECT src, dst FROM t",
    "scan_vertex_ids": f"WITH {WHOLE_SQL} SELECT src AS id FROM t UNION SELECT dst FROM t",
    "scan_whole_amounts": f"WITH {WHOLE_SQL} SELECT src, dst, cents // 100 * 100 AS cents FROM t",
    "scan_decimal_amounts": f"WITH {WHOLE_SQL} SELECT src, dst, CASE cents % 3 WHEN 0 THEN cents // 100 * 100 WHEN 1 THEN cents // 10 * 10 ELSE cents END AS cents FROM t",
    "scan_positive_weights": f"WITH {WHOLE_SQL} SELECT src, dst, weight - 5 AS weight FROM t WHERE weight - 5 > 0",
    "max_weight": f"WITH {WHOLE_SQL} SELECT MAX(weight) AS max_weight FROM t",
    "money_ratio_pairs": f"WITH {WHOLE_SQL} SELECT e.src AS a, e.dst AS b, f.dst AS c, e.cents AS x, f.cents AS y FROM t e JOIN t f ON e.dst = f.src WHERE {_ratio('e.cents', 'f.cents')}",
    "nation_trade": """SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "out_degree": f"WITH {WHOLE_SQL} SELECT src AS id, COUNT(*) AS deg FROM t GROUP BY 1",
    "in_degree": f"WITH {WHOLE_SQL} SELECT dst AS id, COUNT(*) AS deg FROM t GROUP BY 1",
    "degrees": f"WITH {WHOLE_SQL} SELECT id, CAST(SUM(i) AS BIGINT) AS n_in, CAST(SUM(o) AS BIGINT) AS n_out FROM (SELECT src AS id, 0 AS i, 1 AS o FROM t UNION ALL SELECT dst, 1, 0 FROM t) GROUP BY id",
    "in0_out1_count": f"WITH {SPARSE_SQL} SELECT COUNT(*) AS n FROM (SELECT src FROM p WHERE src NOT IN (SELECT dst FROM p) GROUP BY src HAVING COUNT(*) = 1)",
    "vertices_union": f"WITH {WHOLE_SQL} SELECT src AS id FROM t UNION SELECT dst FROM t",
    "source_vertices": f"WITH {WHOLE_SQL} SELECT DISTINCT src AS id FROM t",
    "dense_ids": f"WITH {WHOLE_SQL}, {WHOLE_VERTICES} SELECT id, dense_rank() OVER (ORDER BY id) - 1 AS dense FROM v",
    "edges_encoded": f"WITH {WHOLE_SQL}, {WHOLE_VERTICES}, n AS (SELECT id, dense_rank() OVER (ORDER BY id) - 1 AS k FROM v) SELECT a.k AS dsrc, b.k AS ddst, weight FROM t JOIN n a ON src = a.id JOIN n b ON dst = b.id",
    "csr_offsets": f"WITH {WHOLE_SQL} SELECT id, deg, CAST(COALESCE(SUM(deg) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin FROM (SELECT src AS id, COUNT(*) AS deg FROM t GROUP BY src)",
    "adjacency_sorted": f"WITH {WHOLE_SQL} SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM t GROUP BY src",
    "reverse_adjacency_sorted": f"WITH {WHOLE_SQL} SELECT dst AS id, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS neighbours FROM t GROUP BY dst",
    "id_digits": f"WITH {WHOLE_SQL}, {WHOLE_VERTICES} SELECT id, CAST(length(CAST(id AS VARCHAR)) AS INT) AS digits FROM v",
    "breadth_first_order": f"WITH RECURSIVE {SPARSE_SQL}, {VERTICES}, {_LEVELS} SELECT id, level, row_number() OVER (ORDER BY root, level, id) - 1 AS place FROM lev",
    "edges_semi_join": f"WITH {WHOLE_SQL} SELECT src, dst, cents FROM t WHERE dst IN (SELECT src FROM t)",
    "edges_trimmed": f"WITH RECURSIVE {SPARSE_SQL}, l AS (SELECT * FROM p WHERE src <> dst), {_TRIMMED} SELECT src, dst, cents FROM l WHERE src IN (SELECT id FROM from_c) AND dst IN (SELECT id FROM to_c)",
    "packed_edges": f"WITH {WHOLE_SQL} SELECT dst * 1024 + weight AS packed, dst AS id, weight FROM t",
    "two_hop_forward": _path_query(2, True),
    "back3_paths": _path_query(3, False),
    "back4_paths": _path_query(4, False),
    "returning_pairs": _trim_paths(" UNION ".join(f"SELECT {v[-1]} AS v1, {v[0]} AS h FROM {body}" for body, v in (_path_sql(k, False, False, False) for k in (1, 2, 3)))),
    "cycles_all_plain": f"WITH {DENSE_SQL} SELECT *, row_number() OVER (ORDER BY {_order(7)}) AS pos FROM ({_all_sql(7, False)})",
    "cycles_all_ratio": f"WITH {DENSE_SQL} SELECT *, row_number() OVER (ORDER BY {_order(8)}) AS pos FROM ({_all_sql(8, True)})",
    "cycle_counts_by_length": f"WITH {DENSE_SQL} SELECT len, COUNT(*) AS n FROM ({_all_sql(8, True)}) GROUP BY len",
    "cycle_lines_text": f"""WITH {DENSE_SQL}, a AS ({_all_sql(8, True)}) SELECT 0 AS line_no, CAST(COUNT(*) AS VARCHAR) AS line FROM a
      UNION ALL SELECT row_number() OVER (ORDER BY {_order(8)}), concat_ws(',', {', '.join(_ids(8))}) FROM a""",
    "cycle_lines_plain": f"""WITH {DENSE_SQL}, a AS ({_all_sql(7, False)}) SELECT 0 AS line_no, CAST(COUNT(*) AS VARCHAR) AS line FROM a
      UNION ALL SELECT row_number() OVER (ORDER BY {_order(7)}), concat_ws(',', {', '.join(_ids(7))}) FROM a""",
    "count_digits": f"WITH {DENSE_SQL} SELECT len, CAST(length(CAST(COUNT(*) AS VARCHAR)) AS INT) AS digits FROM ({_all_sql(8, True)}) GROUP BY len",
    "sssp_distances": f"{_EVERY} SELECT s, t AS v, d FROM dist",
    "shortest_path_dag": f"{_EVERY} SELECT s, u, v FROM dag",
    "shortest_path_counts": f"{_EVERY}, {_PATHS} SELECT s, v, sigma FROM sigma",
    "betweenness_scores": f"{_EVERY}, {_SCORES} SELECT v.id, ROUND(COALESCE(score, 0) + 1e-7, 3) AS score FROM (SELECT src AS id FROM p UNION SELECT dst FROM p) v LEFT JOIN sc ON v.id = sc.id",
    "betweenness_by_joins": f"{_EVERY}, {_SCORES} SELECT id, ROUND(score + 1e-7, 3) AS score FROM sc",
    "betweenness_top100": f"{_EVERY}, {_SCORES} {_TOP}",
    "betweenness_lines_text": f"{_EVERY}, {_SCORES} SELECT rank AS line_no, id || ',' || printf('%.3f', score) AS line FROM ({_TOP})",
    "betweenness_compressed": f"{_EVERY}, {_SCORES} {_TOP}",
    "scc_labels": f"WITH RECURSIVE {SPARSE_SQL}, {VERTICES}, {_SCC} SELECT id, scc FROM scc",
    "chain_peel": f"""WITH RECURSIVE {SPARSE_SQL}, l AS (SELECT src, dst FROM p WHERE src <> dst),
      r AS (SELECT DISTINCT src AS a, dst AS b FROM l UNION SELECT r.a, l.dst FROM r JOIN l ON r.b = l.src),
      o AS (SELECT src AS id, COUNT(*) AS n, MIN(dst) AS parent FROM l GROUP BY src)
      SELECT o.id, o.parent, COUNT(DISTINCT r.a) AS size FROM o LEFT JOIN r ON r.b = o.id LEFT JOIN o a ON a.id = r.a WHERE o.n = 1
      GROUP BY o.id, o.parent HAVING COALESCE(bool_and(a.n = 1 AND a.id <> o.id), TRUE)""",
    "in_tree_sizes": f"""WITH RECURSIVE {SPARSE_SQL}, {VERTICES}, {_SCC}, {_TREES}
      SELECT v.id, COALESCE(t.root, v.id) AS root, COALESCE(t.depth, 0) AS depth, COALESCE(s.size, 0) AS size FROM v
      LEFT JOIN (SELECT id, arg_max(up, depth) AS root, MAX(depth) AS depth FROM up GROUP BY id) t ON v.id = t.id
      LEFT JOIN (SELECT up AS id, COUNT(*) AS size FROM up GROUP BY up) s ON v.id = s.id""",
}
for _n in range(3, 9):
    if _n < 8:
        ORACLE_SQL[f"cycles{_n}_plain"] = f"WITH {DENSE_SQL} {_cycle_sql(_n, False)}"
    ORACLE_SQL[f"cycles{_n}_ratio"] = f"WITH {DENSE_SQL} {_cycle_sql(_n, True)}"
