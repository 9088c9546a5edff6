"""Graph queries over the edges between regions, nations, customers, suppliers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import finders, graph
from ..sources.views import view
from .registry import query


@query("SELECT target_uuid, edge_type FROM edges WHERE source_uuid = 'n:3'")
def edge_out(spark, sf_dir):
    return finders.by(view(spark, sf_dir, "edges"), source_uuid="n:3").select("target_uuid", "edge_type")


@query("SELECT source_uuid, edge_type FROM edges WHERE target_uuid = 'n:3'")
def edge_in(spark, sf_dir):
    return finders.by(view(spark, sf_dir, "edges"), target_uuid="n:3").select("source_uuid", "edge_type")


@query("SELECT source_uuid, target_uuid FROM edges WHERE edge_type = 'child_of'")
def edge_by_type(spark, sf_dir):
    return finders.by(view(spark, sf_dir, "edges"), edge_type="child_of").select("source_uuid", "target_uuid")


@query("SELECT source_uuid, target_uuid, edge_type FROM edges WHERE (source_uuid = 'r:0' AND target_uuid = 'n:0') OR (source_uuid = 'n:0' AND target_uuid = 'r:0')")
def edge_between(spark, sf_dir):
    return finders.between(view(spark, sf_dir, "edges"), "r:0", "n:0", both=True)


@query("SELECT source_uuid, target_uuid, edge_type, min(seq) AS seq FROM part_edges GROUP BY ALL")
def edge_dedupe_composite(spark, sf_dir):
    return graph.first_of_each(view(spark, sf_dir, "part_edges"), "seq")


@query("""WITH old AS (SELECT DISTINCT source_uuid, target_uuid, edge_type FROM part_edges WHERE seq % 3 = 0)
    SELECT source_uuid, target_uuid, edge_type, min(seq) AS seq FROM part_edges ANTI JOIN old USING (source_uuid, target_uuid, edge_type) GROUP BY ALL""")
def edge_add_unique(spark, sf_dir):
    edges = view(spark, sf_dir, "part_edges")
    return graph.add_unique(edges.filter("seq % 3 = 0"), edges, "seq")


@query("SELECT source_uuid, target_uuid, edge_type, seq FROM part_edges QUALIFY row_number() OVER (PARTITION BY source_uuid, target_uuid, edge_type ORDER BY seq) > 1")
def edge_duplicates(spark, sf_dir):
    return graph.duplicates(view(spark, sf_dir, "part_edges"), "seq")


def _walk(start: str, steps: int, hop: str) -> str:
    return f"""WITH RECURSIVE walk AS (SELECT '{start}' AS uuid, 0 AS depth UNION SELECT h.b, w.depth + 1 FROM walk w JOIN ({hop}) h ON h.a = w.uuid WHERE w.depth < {steps})
        SELECT uuid, min(depth) AS depth FROM walk WHERE uuid <> '{start}' GROUP BY uuid"""


_OUT = "SELECT source_uuid AS a, target_uuid AS b FROM edges"
_IN = "SELECT target_uuid AS a, source_uuid AS b FROM edges"


@query(_walk("o:1", 3, _OUT))
def edge_traverse_out3(spark, sf_dir):
    return graph.traverse(view(spark, sf_dir, "edges"), "o:1", 3, "outgoing")


@query(_walk("r:0", 3, _IN))
def edge_traverse_in3(spark, sf_dir):
    return graph.traverse(view(spark, sf_dir, "edges"), "r:0", 3, "incoming")


@query(_walk("n:5", 2, f"{_OUT} UNION ALL {_IN}"))
def edge_traverse_both2(spark, sf_dir):
    return graph.traverse(view(spark, sf_dir, "edges"), "n:5", 2, "both")


@query("SELECT DISTINCT source_uuid, target_uuid, edge_type FROM edges WHERE source_uuid LIKE 'c:1%' OR target_uuid LIKE 'c:1%'")
def edge_incident(spark, sf_dir):
    edges = view(spark, sf_dir, "edges")
    gone = edges.select(F.col("source_uuid").alias("uuid")).filter("uuid LIKE 'c:1%'")
    return graph.incident(edges, gone)


@query("SELECT source_uuid, target_uuid, edge_type FROM edges WHERE NOT (source_uuid LIKE 'c:1%' OR target_uuid LIKE 'c:1%')")
def edge_cascade_delete(spark, sf_dir):
    edges = view(spark, sf_dir, "edges")
    gone = edges.select(F.explode(F.array("source_uuid", "target_uuid")).alias("uuid")).filter("uuid LIKE 'c:1%'")
    return graph.without_nodes(edges, gone)
