"""Queries of what is written on plans: lengths, areas, text evidence, colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnframe.functions import measures

from .catalog import add

# lengths as written.
add(
    "parsed_lengths",
    r"""WITH t AS (SELECT id, written, trim(replace(replace(replace(replace(replace(written, '’', chr(39)), '′', chr(39)), '”', '"'), '″', '"'), chr(39) || chr(39), '"')) AS t FROM lengths),
    p AS (SELECT *, regexp_extract(t, '^(\d+(?:\.\d+)?)\s*''\s*-?\s*(?:(\d+(?:\.\d+)?)\s*(?:(\d+)/(\d+))?\s*"?)?$', ['ft', 'inch', 'n', 'd']) AS f, regexp_extract(t, '^(\d+(?:\.\d+)?)\s*"$', 1) AS inch, regexp_extract(t, '(?i)^(\d+(?:\.\d+)?)\s*(ft|feet|m|mm|cm|in)?$', ['v', 'u']) AS u FROM t)
    SELECT id, written, round(CASE WHEN f.ft <> '' THEN TRY_CAST(f.ft AS DOUBLE) * 0.3048 + (CASE WHEN f.inch <> '' THEN TRY_CAST(f.inch AS DOUBLE) ELSE 0 END + CASE WHEN f.n <> '' THEN TRY_CAST(f.n AS DOUBLE) / TRY_CAST(f.d AS DOUBLE) ELSE 0 END) * 0.0254
      WHEN inch <> '' THEN TRY_CAST(inch AS DOUBLE) * 0.0254 WHEN u.v <> '' THEN TRY_CAST(u.v AS DOUBLE) * CASE lower(u.u) WHEN 'ft' THEN 0.3048 WHEN 'feet' THEN 0.3048 WHEN 'mm' THEN 0.001 WHEN 'cm' THEN 0.01 WHEN 'in' THEN 0.0254 ELSE 1 END END, 6) AS metres FROM p""",
    "lengths",
)(lambda t: t.withColumn("metres", measures.length_m(F.col("written"))))
# areas as written.
add(
    "parsed_areas",
    r"""SELECT id, round(CASE WHEN v = '' THEN NULL WHEN u IN ('', 'm2', 'm²', 'sqm', 'sqm2') THEN CAST(v AS DOUBLE) WHEN u IN ('sqft', 'sf', 'ft2', 'ft²', 'squarefeet') THEN CAST(v AS DOUBLE) * 0.3048 * 0.3048 END, 6) AS m2 FROM (
      SELECT id, regexp_extract(replace(trim(written), ',', ''), '^(\d+(?:\.\d+)?)\s*(.*)$', 1) AS v, lower(regexp_replace(regexp_extract(replace(trim(written), ',', ''), '^(\d+(?:\.\d+)?)\s*(.*)$', 2), '[ .]', '', 'g')) AS u FROM areas)""",
    "areas",
)(lambda t: t.select("id", measures.area_m2(F.col("written")).alias("m2")))
# What texts say about units and scale.
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
add(
    "text_evidence",
    r"""WITH t AS (SELECT id, regexp_replace(replace(replace(replace(replace(replace(replace(body, '’’', '"'), chr(39) || chr(39), '"'), '″', '"'), '”', '"'), '’', chr(39)), '′', chr(39)), '\d+\s*°\s*\d+\s*''\s*\d+(?:\.\d+)?\s*"', '', 'g') AS t FROM note),
    h AS ("""
    + " UNION ALL ".join(f"SELECT id, {_quoted(k)} AS pattern, regexp_extract_all(t, {_quoted(p)}) AS hits FROM t" for k, p in measures.TEXT_PATTERNS.items())
    + """) SELECT id, pattern, len(hits) AS "count", array_to_string(list_sort(list_distinct(hits))[1:3], '|') AS examples FROM h WHERE len(hits) > 0""",
    "note",
)(lambda t: measures.text_evidence(t, "body").withColumn("examples", F.array_join("examples", "|")))
# sizes of rooms.
_FT = r"""(\d+)\s*''\s*-?\s*(\d+(?:\.\d+)?)?\s*"?"""
add(
    "room_sizes",
    rf"""WITH f AS (SELECT id, unnest(regexp_extract_all(words, '{_FT}\s*[xX×]?\s*{_FT}')) AS m FROM span), g AS (SELECT id, regexp_extract(m, '{_FT}\s*[xX×]?\s*{_FT}', ['a', 'b', 'c', 'd']) AS x FROM f),
    k AS (SELECT id, unnest(regexp_extract_all(words, '\b\d{{1,2}}[.,]\d{{1,2}}\s*[xX×]\s*\d{{1,2}}[.,]\d{{1,2}}\b')) AS m FROM span), n AS (SELECT id, regexp_extract(words, '^\s*(\d{{3,5}})\s*(?:[mM][mM])?\s*$', 1) AS v FROM span)
    SELECT id, 'ft-in' AS unit, round_even(TRY_CAST(x.a AS DOUBLE) * 0.3048 + coalesce(TRY_CAST(x.b AS DOUBLE), 0) * 0.0254, 4) AS m0, round_even(TRY_CAST(x.c AS DOUBLE) * 0.3048 + coalesce(TRY_CAST(x.d AS DOUBLE), 0) * 0.0254, 4) AS m1, FALSE AS candidate FROM g
    UNION ALL SELECT id, 'm', TRY_CAST(replace(regexp_extract(m, '^[\d.,]+'), ',', '.') AS DOUBLE), TRY_CAST(replace(regexp_extract(m, '[\d.,]+$'), ',', '.') AS DOUBLE), FALSE FROM k
    UNION ALL SELECT id, 'mm', TRY_CAST(v AS DOUBLE) / 1000, NULL, TRUE FROM n WHERE v LIKE '%0'""",
    "span",
)(lambda t: measures.dimensions(t, "words").select("id", "unit", F.get("m", F.lit(0)).alias("m0"), F.get("m", F.lit(1)).alias("m1"), "candidate"))
# Colours as whole channels.
add(
    "colours",
    """SELECT id, CASE WHEN hex IS NOT NULL THEN CAST('0x' || substr(hex, 2, 2) AS INTEGER) WHEN greatest(r, g) <= 1 THEN CAST(round_even(r * 255, 0) AS INTEGER) ELSE CAST(floor(r) AS INTEGER) END AS r255,
      CASE WHEN hex IS NOT NULL THEN CAST('0x' || substr(hex, 4, 2) AS INTEGER) WHEN greatest(r, g) <= 1 THEN CAST(round_even(g * 255, 0) AS INTEGER) ELSE CAST(floor(g) AS INTEGER) END AS g255 FROM colour""",
    "colour",
)(lambda t: t.withColumn("c", measures.rgb255(F.array(F.col("r").cast("double"), F.col("g").cast("double")), F.col("hex"))).select("id", F.col("c")[0].alias("r255"), F.col("c")[1].alias("g255")))
# F16: significant digits.
add("significant_digits", """SELECT l_id, round(v * pow(10, 2 - floor(log10(v)))) / pow(10, 2 - floor(log10(v))) AS v3 FROM (SELECT id AS l_id, id * 7.123457 AS v FROM customer_at WHERE id > 0)""", "customer_at")(
    lambda t: t.where("id > 0").select(F.col("id").alias("l_id"), measures.significant(F.col("id") * F.lit(7.123457)).alias("v3"))
)
