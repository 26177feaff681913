"""Text formats: region graphs, markers, label lists, shapes and GraphML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines ``n;label;count;sum`` and ``e;l1;l2;count;sum`` in a column ``value``."""
    n = nodes.select(F.concat_ws(";", F.lit("n"), "label", "n", "s").alias("value"))
    return n.unionByName(edges.select(F.concat_ws(";", F.lit("e"), "l1", "l2", "n", "s").alias("value")))


def parse_graph(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of lines; blank lines, comments (#) and unknown tags are passed over."""
    parts = lines.select(F.split(F.trim("value"), ";").alias("p"))
    nodes = parts.filter((F.get("p", F.lit(0)) == "n") & (F.size("p") == 4))
    edges = parts.filter((F.get("p", F.lit(0)) == "e") & (F.size("p") == 5))
    return (
        nodes.select(F.col("p")[1].cast("long").alias("label"), F.col("p")[2].cast("long").alias("n"), F.col("p")[3].cast("double").alias("s")),
        edges.select(F.col("p")[1].cast("long").alias("l1"), F.col("p")[2].cast("long").alias("l2"), F.col("p")[3].cast("long").alias("n"), F.col("p")[4].cast("double").alias("s")),
    )


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    graph_lines(nodes, edges).write.text(path)


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_graph(spark.read.text(path))


def marker_lines(markers: DataFrame) -> DataFrame:
    """Lines ``f label`` or ``b label``."""
    return markers.select(F.concat_ws(" ", "kind", "label").alias("value"))


def parse_markers(lines: DataFrame) -> DataFrame:
    """(kind, label) of lines ``f label`` and ``b label``; other lines are passed over."""
    rule = r"^\s*([fb])\s*(\d+)\s*$"
    hit = lines.filter(F.col("value").rlike(rule))
    return hit.select(F.regexp_extract("value", rule, 1).alias("kind"), F.regexp_extract("value", rule, 2).cast("long").alias("label"))


def label_lines(labels: DataFrame, column: str = "label") -> DataFrame:
    """One label a line."""
    return labels.select(F.col(column).cast("string").alias("value"))


def parse_labels(lines: DataFrame) -> DataFrame:
    return lines.filter(F.trim("value").rlike(r"^-?\d+$")).select(F.trim("value").cast("long").alias("label"))


def _triple(group: int, rule: str) -> Column:
    return F.transform(F.split(F.regexp_extract("value", rule, group), ","), lambda x: F.trim(x).cast("double"))


def parse_shapes(lines: DataFrame) -> DataFrame:
    """kind, centre, direction, radius, extent, value of lines ``e[c] r v``, ``t[c][d] r len v``, ``p[c][n] r thick v``; and ord, if the lines have one."""
    rank = ["ord"] if "ord" in lines.columns else []
    number = r"\s+([-+.\deE]+)"
    e = r"^\s*(e)\[([^\]]*)\]" + number * 2
    o = r"^\s*([tp])\[([^\]]*)\]\[([^\]]*)\]" + number * 3
    first = lines.filter(F.col("value").rlike(e)).select(
        *rank, F.lit("e").alias("kind"), _triple(2, e).alias("centre"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("direction"),
        F.regexp_extract("value", e, 3).cast("double").alias("radius"), F.lit(0.0).alias("extent"), F.regexp_extract("value", e, 4).cast("double").alias("value"),
    )
    second = lines.filter(F.col("value").rlike(o)).select(
        *rank, F.regexp_extract("value", o, 1).alias("kind"), _triple(2, o).alias("centre"), _triple(3, o).alias("direction"),
        F.regexp_extract("value", o, 4).cast("double").alias("radius"), F.regexp_extract("value", o, 5).cast("double").alias("extent"), F.regexp_extract("value", o, 6).cast("double").alias("value"),
    )
    return first.unionByName(second)


def parse_size(text: str) -> tuple[int, ...]:
    """Extents written ``WxHxD``."""
    size = tuple(int(p) for p in text.lower().split("x"))
    if len(size) not in (2, 3) or min(size) < 1:
        raise ValueError(f"no extents: {text}")
    return size


def graphml_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): GraphML elements of a flow network, ordered by part: head, nodes, edges, foot."""
    spark = vertices.sparkSession

    def edge(a: Column, b: Column, c: Column) -> Column:
        return F.concat(F.lit('<edge source="'), a, F.lit('" target="'), b, F.lit('"><data key="capacity">'), c.cast("string"), F.lit("</data></edge>"))

    node = F.concat(F.lit("n"), F.col("id").cast("string"))
    head = spark.createDataFrame([(0, '<graphml><key id="capacity" for="edge" attr.name="capacity" attr.type="double"/><graph edgedefault="directed">'), (1, '<node id="source"/>'), (1, '<node id="sink"/>'), (4, "</graph></graphml>")], "part int, value string")
    nodes = vertices.select(F.lit(2).alias("part"), F.concat(F.lit('<node id="'), node, F.lit('"/>')).alias("value"))
    source = vertices.filter("cap_src > 0").select(F.lit(3).alias("part"), edge(F.lit("source"), node, F.col("cap_src")).alias("value"))
    sink = vertices.filter("cap_snk > 0").select(F.lit(3).alias("part"), edge(node, F.lit("sink"), F.col("cap_snk")).alias("value"))
    inner = edges.select(F.lit(3).alias("part"), edge(F.concat(F.lit("n"), F.col("a").cast("string")), F.concat(F.lit("n"), F.col("b").cast("string")), F.col("w_fwd")).alias("value"))
    out = head
    for x in (nodes, source, sink, inner):
        out = out.unionByName(x)
    return out
