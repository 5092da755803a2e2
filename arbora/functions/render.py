"""Mermaid, DOT, SVG and HTML texts from node and edge tables, and plain DOT output back into tables.

Rows are built by columns; only a finished picture, which a person looks at, is
put together in one place.
"""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def numbered(nodes: DataFrame) -> DataFrame:
    """Nodes with ``number`` from 0 by id: a picture's nodes are few enough for one window."""
    return nodes.withColumn("number", (F.row_number().over(Window.orderBy("id")) - 1).cast("long"))


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """line, text of a left-to-right flowchart: nodes by number, then edges by ends and label."""
    own = numbered(nodes).select("id", "number", F.when(F.coalesce("name", F.lit("")) == "", F.col("id")).otherwise(F.col("name")).alias("shown"))
    first = own.select(F.lit(1).alias("part"), F.col("number").alias("a"), F.lit(0).cast("long").alias("b"), F.concat(F.lit("  n"), F.col("number").cast("string"), F.lit('["'), escape(F.col("shown")), F.lit('"]')).alias("text"))
    ends = own.select("id", "number")
    both = edges.join(ends.withColumnsRenamed({"id": "from_id", "number": "a"}), "from_id").join(ends.withColumnsRenamed({"id": "to_id", "number": "b"}), "to_id")
    arrow = F.when(F.coalesce("label", F.lit("")) == "", F.lit(" --> ")).otherwise(F.concat(F.lit(" -->|"), escape(F.col("label")), F.lit("| ")))
    second = both.select(F.lit(2).alias("part"), "a", "b", F.concat(F.lit("  n"), F.col("a").cast("string"), arrow, F.lit("n"), F.col("b").cast("string")).alias("text"))
    head = nodes.sparkSession.createDataFrame([(0, 0, 0, "flowchart LR")], "part int, a bigint, b bigint, text string")
    every = head.union(first).union(second)
    return every.select((F.row_number().over(Window.orderBy("part", "a", "b", "text"))).cast("long").alias("line"), "text")


def dot(connections: DataFrame) -> DataFrame:
    """One DOT statement for each (source, target) with its labels merged in order."""
    merged = connections.groupBy("source", "target").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"))
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return merged.select("source", "target", F.concat(quote(F.col("source")), F.lit(" -> "), quote(F.col("target")), F.lit(' [label="'), "labels", F.lit('"];')).alias("text"))


def circle(nodes: DataFrame, x0: float = 480.0, y0: float = 360.0) -> DataFrame:
    """id, x, y on a circle whose radius grows with the nodes up to forty."""
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    at = numbered(nodes).withColumn("n", n)
    radius = F.lit(220.0) + F.least(F.col("n"), F.lit(40)) * 4.0
    angle = F.lit(2.0) * F.pi() * F.col("number") / F.col("n")
    return at.select("id", (F.lit(x0) + radius * F.cos(angle)).alias("x"), (F.lit(y0) + radius * F.sin(angle)).alias("y"))


def parse_plain(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """graph, nodes and edges of plain layout text; quoted words keep their blanks."""
    words = F.transform(F.regexp_extract_all(F.col(column), F.lit(r'"(?:[^"\\]|\\.)*"|\S+'), F.lit(0)), lambda w: F.when(w.startswith('"'), F.replace(F.substring(w, F.lit(2), F.length(w) - 2), F.lit('\\"'), F.lit('"'))).otherwise(w))
    rows = lines.select(words.alias("w")).withColumn("kind", F.get("w", F.lit(0)))
    number = lambda k: F.get("w", F.lit(k) if isinstance(k, int) else k).cast("double")
    graph = rows.where("kind = 'graph'").select(number(1).alias("scale"), number(2).alias("width"), number(3).alias("height"))
    nodes = rows.where("kind = 'node'").select(F.get("w", F.lit(1)).alias("id"), *[number(k).alias(c) for k, c in ((2, "x"), (3, "y"), (4, "width"), (5, "height"))], F.get("w", F.lit(6)).alias("label"))
    edges = rows.where("kind = 'edge'").withColumn("n", F.get("w", F.lit(3)).cast("int"))
    points = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.get("w", 4 + 2 * k).cast("double").alias("x"), F.get("w", 5 + 2 * k).cast("double").alias("y")))
    return graph, nodes, edges.select(F.get("w", F.lit(1)).alias("tail"), F.get("w", F.lit(2)).alias("head"), points.alias("points"), F.when(F.size("w") > 6 + 2 * F.col("n"), F.get("w", 4 + 2 * F.col("n"))).otherwise("").alias("label"))


def page(nodes: DataFrame, edges: DataFrame, title: str, width: int = 960, height: int = 720) -> str:
    """A stand-alone HTML page with the graph as SVG; for graphs that a person looks at."""
    where = {r["id"]: (r["x"], r["y"]) for r in circle(nodes).collect()}
    lines = [(where[e["from_id"]], where[e["to_id"]], e["label"]) for e in edges.select("from_id", "to_id", "label").collect() if e["from_id"] in where and e["to_id"] in where]
    parts = [f'<line x1="{a:.1f}" y1="{b:.1f}" x2="{c:.1f}" y2="{d:.1f}" stroke="gray"><title>{html.escape(label or "")}</title></line>' for (a, b), (c, d), label in lines]
    for r in nodes.select("id", "name").collect():
        x, y = where[r["id"]]
        parts.append(f'<g><circle cx="{x:.1f}" cy="{y:.1f}" r="5"/><text x="{x + 7:.1f}" y="{y:.1f}">{html.escape(r["name"] or r["id"])[:24]}</text></g>')
    return f'<!DOCTYPE html><meta charset="utf-8"><title>{html.escape(title)}</title><svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{"".join(parts)}</svg>'
