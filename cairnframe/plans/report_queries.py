"""Queries of configurations, surveys and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnframe.functions import measures
from cairnframe.sources import evidence

from . import reports
from .catalog import add

# Rules for walls, from a profile and by hand.
add(
    "wall_rules",
    """WITH c AS (SELECT id, CASE WHEN id % 2 = 0 THEN [[id % 256, 0, 0]] END AS p_rgb, CASE WHEN id % 3 = 0 THEN 10 END AS p_tol, CASE WHEN id % 5 = 0 THEN 250 END AS p_dark, CASE WHEN id % 7 = 0 THEN [[1, 2, 3]] END AS rgb, CASE WHEN id % 11 = 0 THEN 40 END AS tol, CASE WHEN id % 13 = 0 THEN 200 END AS dark FROM colour),
    r AS (SELECT id, coalesce(rgb, p_rgb) AS rgb, coalesce(tol, p_tol) AS tol, coalesce(dark, CASE WHEN rgb IS NULL THEN p_dark END) AS dark FROM c)
    SELECT id, rgb[1][1] AS red, CASE WHEN rgb IS NOT NULL THEN coalesce(tol, 24) ELSE tol END AS tol, CASE WHEN rgb IS NULL AND tol IS NULL AND dark IS NULL THEN 300 ELSE dark END AS dark_sum FROM r""",
    "colour",
)(
    lambda t: t.select(
        "id",
        evidence.wall_rule(F.expr("CASE WHEN id % 2 = 0 THEN array(array(id % 256, 0L, 0L)) END"), F.expr("CASE WHEN id % 3 = 0 THEN 10 END"), F.expr("CASE WHEN id % 5 = 0 THEN 250 END"), F.expr("CASE WHEN id % 7 = 0 THEN array(array(1L, 2L, 3L)) END"), F.expr("CASE WHEN id % 11 = 0 THEN 40 END"), F.expr("CASE WHEN id % 13 = 0 THEN 200 END")).alias("w"),
    ).select("id", F.get(F.get("w.rgb", F.lit(0)), F.lit(0)).alias("red"), "w.tol", "w.dark_sum")
)
# Extents of bars in boxes; S11: spans left; S16, O01: rows of both frames.
add(
    "bar_extents",
    """SELECT b."case", b.ord, CASE WHEN count(m.x) > 0 THEN max(m.x) - min(m.x) + 1e0 END AS px FROM (SELECT img AS "case", y AS ord, min(x) + 3 AS x0, 10 AS y0, max(x) - 5 AS x1, 14 AS y1 FROM pixel GROUP BY 1, 2) b
    LEFT JOIN (SELECT img, y, x FROM pixel WHERE r < 60) m ON m.img = b."case" AND m.x >= b.x0 AND m.x < b.x1 AND m.y >= b.y0 AND m.y < b.y1 GROUP BY 1, 2""",
    "pixel",
)(lambda t: evidence.bar_extents(t.groupBy(F.col("img").alias("case"), F.col("y").alias("ord")).agg((F.min("x") + 3).alias("x0"), F.lit(10).alias("y0"), (F.max("x") - 5).alias("x1"), F.lit(14).alias("y1")), t.where("r < 60").select(F.col("img").alias("case"), "y", "x")))
add("spans_left", "SELECT id FROM span WHERE words IS NULL OR NOT regexp_matches(words, '(?i)mm|x')", "span")(lambda t: evidence.without_text(t.withColumnRenamed("words", "text"), "(?i)mm|x").select("id"))
add("trace_rows", "SELECT id, x0, y0, 'floor' AS frame FROM box WHERE id % 3 > 0 UNION ALL SELECT id, x0, NULL, 'reference' FROM box WHERE id % 3 = 0", "box")(lambda t: evidence.trace_rows(t.where("id % 3 > 0").select("id", "x0", "y0"), t.where("id % 3 = 0").select("id", "x0")))
# points in JSON properties.
add("json_points", "SELECT id, CASE WHEN id % 4 > 0 THEN [[id / 4e0, 1e0], [id + 0e0, y0 + 0e0]][2][2] END AS y FROM box", "box")(
    lambda t: t.select("id", F.get(F.get(evidence.points_of(F.expr("CASE WHEN id % 4 > 0 THEN concat('[[', id / 4, ', 1], [', id, ', ', y0, ']]') ELSE 'no points' END")), F.lit(1)), F.lit(1)).alias("y"))
)
# Reports; A16, Q12: counts by class; A33: what surveys find.
add(
    "quality_reports",
    """SELECT coalesce(bool_and(passed), FALSE) AND count(passed) > 0 AS passed, count(*) AS checks, count(*) FILTER (passed IS NULL) AS not_run FROM record WHERE name LIKE '%77%'""",
    "record",
)(lambda t: reports.quality_report(t.where("name LIKE '%77%'").select("name", "passed", F.lit("{}").alias("detail")), F.lit("orders"), "test").select("passed", F.size("checks").cast("long").alias("checks"), F.size("not_run").cast("long").alias("not_run")))
add(
    "validation",
    """WITH f AS (SELECT brand AS floor, count(*) AS doors, CAST(sum(x1 - x0) AS BIGINT) AS spaces, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS area, count(*) FILTER (id % 50 = 0) AS problems FROM box GROUP BY 1) SELECT * FROM f UNION ALL SELECT NULL, CAST(sum(doors) AS BIGINT), CAST(sum(spaces) AS BIGINT), CAST(sum(area) AS BIGINT), CAST(sum(problems) AS BIGINT) FROM f""",
    "box",
)(lambda t: reports.validation(t.groupBy(F.col("brand").alias("floor")).agg(F.count("*").alias("doors"), F.sum(F.expr("x1 - x0")).alias("spaces"), F.sum(F.expr("(x1 - x0) * (y1 - y0)")).alias("area")), t.where("id % 50 = 0").select(F.col("brand").alias("floor"), F.lit("gap").alias("text"))))
add("tessellated", """SELECT count(*) AS "count", count(*) FILTER (x1 - x0 = 7) AS failed, count(DISTINCT brand) AS classes, count(*) > 0 AND count(*) FILTER (x1 - x0 = 7) = 0 AS passed FROM box""", "box")(
    lambda t: reports.tessellated(t.select(F.col("brand").alias("class"), F.expr("CASE WHEN x1 - x0 <> 7 THEN 12 END").alias("triangles"))).withColumn("classes", F.size("by_class").cast("long")).drop("by_class")
)
_HIT = lambda k: "regexp_matches(t, '" + measures.TEXT_PATTERNS[k].replace("'", "''") + "')"
add(
    "surveys",
    r"""WITH x AS (SELECT id, regexp_replace(body, '\d+\s*°\s*\d+\s*''\s*\d+(?:\.\d+)?\s*"', '', 'g') AS t FROM note), h AS (SELECT id, """
    + ", ".join(f"bool_or({_HIT(k)}) AS {k}" for k in ("ft_in", "ft_dims", "metric_dims", "mm_dims", "sq_ft", "sq_m", "area_table", "ceiling_height"))
    + """, bool_or(any_hit) AS any_hit FROM (SELECT *, """
    + " OR ".join(_HIT(k) for k in measures.TEXT_PATTERNS)
    + """ AS any_hit FROM x) GROUP BY 1)
    SELECT id, CASE WHEN (ft_in OR ft_dims) AND (metric_dims OR mm_dims) THEN 'ft-in+metric' WHEN ft_in OR ft_dims THEN 'ft-in' WHEN metric_dims OR mm_dims THEN 'metric' ELSE 'none' END AS dims, CASE WHEN sq_ft AND sq_m THEN 'sq ft+sq m' WHEN sq_ft THEN 'sq ft' WHEN sq_m THEN 'sq m' ELSE 'none' END AS area,
      coalesce(nullif(concat_ws('+', CASE WHEN id % 3 = 0 THEN 'bar' END, CASE WHEN ft_dims OR metric_dims THEN 'dims' END, CASE WHEN area_table OR sq_ft OR sq_m THEN 'area' END, CASE WHEN ceiling_height THEN 'ceiling_height' END), ''), 'none') AS evidence FROM h""",
    "note",
)(lambda t: reports.survey(measures.text_evidence(t, "body"), t.select("id", (F.col("id") % 3 == 0).alias("labelled")), "id"))
