"""Geometry-shaped views over the driver's tables: stand-ins for plans and meshes, by fixed arithmetic on their columns.

Each is given twice, for Spark and as DuckDB SQL; the text is the same where both read it alike. What
lies in space goes on in blocks of rows beside one another, so that pairs grow as the rows do.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    # Items of evidence: a case per supplier.
    "evidence": """SELECT CAST(l_suppkey AS BIGINT) AS "case", CASE l_linenumber WHEN 1 THEN 'dim' WHEN 2 THEN 'area' WHEN 3 THEN 'bar' WHEN 4 THEN 'pt' WHEN 5 THEN 'fixture' WHEN 6 THEN 'bar_box' ELSE 'dim' END AS kind,
        CASE WHEN l_linenumber IN (2, 4, 6) THEN NULL WHEN l_partkey % 9 = 0 THEN 'diag' WHEN l_linestatus = 'F' THEN 'x' ELSE 'y' END AS axis, CASE WHEN l_linenumber NOT IN (2, 4) THEN CAST(l_quantity AS DOUBLE) * 20 END AS px,
        (1 + l_orderkey % 37 * l_orderkey % 11 / 400.0) * 0.02 AS m_per_px, CASE WHEN l_partkey % 13 = 0 THEN 0.04 END AS tol FROM lineitem WHERE l_suppkey % 3 > 0 OR l_linenumber IN (4, 5)""",
    "align": """SELECT l_returnflag AS "case", l_linestatus AS axis, l_extendedprice AS a, l_quantity AS b FROM lineitem""",
    # Points near a circle per user.
    "ring": """SELECT user_id AS "case", event_id AS ord, 3 + (10 + value / 1000) * cos(event_id % 360 * 0.017453292519943295) AS x, 4 + (10 + value / 1000) * sin(event_id % 360 * 0.017453292519943295) AS y FROM events""",
    "polygon": """SELECT l_orderkey % 1000 AS "case", l_orderkey * 10 + l_linenumber AS ord, l_partkey % 97 AS x, l_suppkey % 89 AS y FROM lineitem""",
    # A mask along each user's events in the order of their ids.
    "mask": """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, event_type IN ('view', 'click') AS "on" FROM events""",
    "solid": """SELECT user_id AS col, CAST(floor(value * 10) AS BIGINT) AS lo, CAST(floor(value * 10) AS BIGINT) + 50 AS hi, event_id FROM events""",
    "carve": """SELECT user_id AS col, CAST(floor(value * 10) AS BIGINT) + 20 AS lo, CAST(floor(value * 10) AS BIGINT) + 40 AS hi FROM events WHERE event_id % 3 = 0""",
    "box": """SELECT p_partkey AS id, p_partkey * 37 % 500 + 600 * CAST(floor(p_partkey / 2000) AS BIGINT) AS x0, p_partkey * 37 % 500 + p_size + 600 * CAST(floor(p_partkey / 2000) AS BIGINT) AS x1, p_partkey * 91 % 500 AS y0, p_partkey * 91 % 500 + p_size AS y1, p_brand AS brand FROM part""",
    "pixel": """SELECT l_linenumber + 10 * CAST(floor(l_orderkey / 32768) AS BIGINT) AS img, l_orderkey % 64 AS y, l_partkey % 64 AS x, max(l_orderkey % 256) AS r, max(l_partkey % 256) AS g, max(l_suppkey * 7 % 256) AS b FROM lineitem GROUP BY l_linenumber + 10 * CAST(floor(l_orderkey / 32768) AS BIGINT), l_orderkey % 64, l_partkey % 64""",
    "tri": """SELECT l_linenumber + 10 * CAST(floor(l_orderkey / 32768) AS BIGINT) AS mesh, l_orderkey * 10 + l_linenumber AS tid, l_orderkey % 97 AS a, l_partkey % 97 AS b, l_suppkey % 97 AS c FROM lineitem""",
    "vertex": """SELECT l_linenumber + 10 * CAST(floor(l_orderkey / 32768) AS BIGINT) AS mesh, l_orderkey % 97 AS vid, CAST(max(l_quantity) AS DOUBLE) AS x, CAST(max(l_partkey % 50) AS DOUBLE) AS y, CAST(max(l_orderkey % 97 * 7 % 20) AS DOUBLE) AS z FROM lineitem GROUP BY l_linenumber + 10 * CAST(floor(l_orderkey / 32768) AS BIGINT), l_orderkey % 97""",
    # Small triangles over a floor, seen from above.
    "facet": """SELECT p_partkey AS id, CAST(p_partkey * 37 % 200 + 250 * CAST(floor(p_partkey / 2000) AS BIGINT) AS DOUBLE) AS ax, CAST(p_partkey * 91 % 200 AS DOUBLE) AS ay, CAST(p_size AS DOUBLE) AS az,
        CAST(p_partkey * 37 % 200 + p_size % 7 + 1 + 250 * CAST(floor(p_partkey / 2000) AS BIGINT) AS DOUBLE) AS bx, CAST(p_partkey * 91 % 200 AS DOUBLE) AS "by", CAST(p_size AS DOUBLE) AS bz,
        CAST(p_partkey * 37 % 200 + 250 * CAST(floor(p_partkey / 2000) AS BIGINT) AS DOUBLE) AS cx, CAST(p_partkey * 91 % 200 + p_size % 5 + 1 AS DOUBLE) AS cy, CAST(p_size AS DOUBLE) AS cz FROM part""",
    "slab": """SELECT p_partkey * 37 % 40 + 40 * CAST(floor(p_partkey / 2000) AS BIGINT) AS i, p_partkey * 91 % 40 AS j, p_size AS lo, p_size + 3 AS hi FROM part""",
    "customer_at": """SELECT c_custkey AS id, c_custkey * 37 % 1000 + 1200 * CAST(floor(c_custkey / 1500) AS BIGINT) AS x, c_custkey * 91 % 1000 AS y FROM customer""",
    "supplier_at": """SELECT s_suppkey AS id, s_suppkey * 53 % 1000 + 1200 * CAST(floor(s_suppkey / 100) AS BIGINT) AS x, s_suppkey * 71 % 1000 AS y FROM supplier""",
    "storey": """SELECT n_regionkey AS building, n_nationkey AS ord, n_nationkey % 3 + 2 AS wall, 1 AS slab FROM nation""",
    "record": """SELECT o_orderpriority AS priority, CAST(o_orderkey AS VARCHAR) AS name, CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN o_orderkey % 50 <> 7 ELSE NULL END AS passed FROM orders""",
    "lengths": """SELECT p_partkey AS id, translate(CASE p_partkey % 17 WHEN 0 THEN concat(p_size, '~', p_partkey % 12, '^') WHEN 1 THEN concat(p_size, ' ft') WHEN 2 THEN concat(p_size, '.5 M') WHEN 3 THEN concat(p_size * 10, 'mm') WHEN 4 THEN concat(p_size, '″')
        WHEN 5 THEN concat('about ', p_size) WHEN 6 THEN concat(p_size, '~-6') WHEN 7 THEN concat(p_size, '~-6~~') WHEN 8 THEN concat('-', p_size, ' m') WHEN 9 THEN concat(p_size, '~ 3 1/4^') WHEN 10 THEN concat(p_size, '') WHEN 11 THEN concat(' ', p_size, '  Feet ')
        WHEN 12 THEN concat(p_size, '’ 7”') WHEN 13 THEN concat(p_size, ' km') WHEN 14 THEN concat(p_size, '~') WHEN 15 THEN concat(p_size, '.') ELSE NULL END, '~^', concat(chr(39), chr(34))) AS written FROM part""",
    "areas": """SELECT p_partkey AS id, CASE p_partkey % 11 WHEN 0 THEN concat(p_size, ' sq ft') WHEN 1 THEN concat(p_size, ' square feet') WHEN 2 THEN concat('2,', p_size + 100, ' SQ.FT') WHEN 3 THEN concat(p_size, '.25 sq m') WHEN 4 THEN concat(p_size, ' sqm2')
        WHEN 5 THEN concat(p_size, 'm²') WHEN 6 THEN concat(p_size, '') WHEN 7 THEN concat(p_size, ' acres') WHEN 8 THEN concat('-', p_size) WHEN 9 THEN concat(p_size, ' s f') ELSE NULL END AS written FROM part""",
    "note": """SELECT p_partkey AS id, translate(concat(CASE p_partkey % 7 WHEN 0 THEN concat(p_size, '~ 6^ x ', p_size + 1, '~') WHEN 1 THEN concat('Room 3.', p_size, ' x 4,', p_size) WHEN 2 THEN concat(p_size, '00 mm') WHEN 3 THEN concat('Total  Area ', p_size, ' sq. ft, 80 sqm, sf ')
        WHEN 4 THEN concat('Scale 1 : ', p_size + 10, ' see www.plan-', p_size, '.com') WHEN 5 THEN concat('N 12° 30~ ', p_size, '^ ceiling') ELSE 'nothing here' END, chr(10), CASE p_size % 3 WHEN 0 THEN 'N' WHEN 1 THEN concat(p_size, '0') ELSE 'north, clear  height' END), '~^', concat(chr(39), chr(34))) AS body FROM part""",
    "span": """SELECT p_partkey AS id, translate(CASE p_partkey % 6 WHEN 0 THEN concat(p_size, '~-6^ x ', p_size % 9, '~') WHEN 1 THEN concat('3.', p_size, ' x 4,', p_size) WHEN 2 THEN concat(' ', p_size, '00 MM') WHEN 3 THEN concat(p_size + 100, '') WHEN 4 THEN concat(p_size, '~ ', p_size, '~') ELSE NULL END, '~^', concat(chr(39), chr(34))) AS words FROM part""",
    "colour": """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN concat('#', lower(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 6))) END AS hex, CASE WHEN p_partkey % 3 = 1 THEN p_size / 50.0 ELSE p_size * 3.0 END AS r, CASE WHEN p_partkey % 3 = 1 THEN p_partkey % 50 / 50.0 ELSE p_partkey % 200 + 0.0 END AS g FROM part""",
    # Doors and their leaves.
    "door": """SELECT p_partkey AS name, CASE p_partkey % 8 WHEN 0 THEN 'single' WHEN 1 THEN 'double' WHEN 2 THEN 'open' WHEN 3 THEN 'glass' WHEN 4 THEN 'elev' WHEN 5 THEN 'slide' WHEN 6 THEN 'slide_double' ELSE 'slide_glass' END AS kind,
        CASE p_size % 2 WHEN 0 THEN 'x' ELSE 'y' END AS axis, CASE p_partkey % 3 WHEN 0 THEN 'a' ELSE 'b' END AS hinge, CASE p_partkey % 5 WHEN 0 THEN 'N' WHEN 1 THEN 'E' WHEN 2 THEN 'S' WHEN 3 THEN 'W' END AS side, p_size / 16.0 AS width,
        p_partkey * 37 % 500 + 600 * CAST(floor(p_partkey / 2000) AS BIGINT) + 0.0 AS ax, p_partkey * 91 % 500 + 0.0 AS ay, p_partkey * 37 % 500 + 600 * CAST(floor(p_partkey / 2000) AS BIGINT) + CASE p_size % 2 WHEN 0 THEN p_size / 16.0 ELSE 0.25 END AS bx, p_partkey * 91 % 500 + CASE p_size % 2 WHEN 0 THEN 0.25 ELSE p_size / 16.0 END AS "by" FROM part""",
    "opened": """SELECT l_orderkey AS door, 1 + l_orderkey % 7 / 8.0 AS width, CAST(l_quantity AS DOUBLE) / 64 AS length, l_linenumber / 128.0 AS thick, CASE WHEN l_partkey % 11 > 0 THEN CAST(l_suppkey % 91 AS DOUBLE) END AS angle FROM lineitem""",
    # Names, entries and measures of meshes; markers and rooms.
    "mesh_name": """SELECT concat(CASE p_partkey % 3 WHEN 0 THEN 'COL_' ELSE '' END, CASE p_partkey % 5 WHEN 0 THEN 'DoorLeaf' ELSE 'Wall' END, p_partkey) AS name FROM part""",
    "entry": """SELECT concat(CASE p_partkey % 3 WHEN 0 THEN 'COL_' ELSE '' END, CASE p_partkey % 5 WHEN 0 THEN 'DoorLeaf' ELSE 'Wall' END, p_partkey) AS name, CASE p_partkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS collision,
        CASE WHEN p_partkey % 8 = 0 THEN concat(CASE (p_partkey + 1) % 3 WHEN 0 THEN 'COL_' ELSE '' END, CASE (p_partkey + 1) % 5 WHEN 0 THEN 'DoorLeaf' ELSE 'Wall' END, p_partkey + 1) END AS render_mesh FROM part WHERE p_partkey % 7 > 0""",
    "marker": """SELECT concat(CASE p_partkey % 6 WHEN 0 THEN 'DOOR_' WHEN 1 THEN 'ROOM_' WHEN 2 THEN 'STAIR_A_' WHEN 3 THEN 'OPEN' WHEN 4 THEN 'OPEN_' ELSE '_' END, p_partkey % 900) AS name, p_partkey * 37 % 1000 + 1200 * CAST(floor(p_partkey / 2000) AS BIGINT) + 0.0 AS x, p_partkey * 91 % 1000 + 0.0 AS y, p_size % 4 + 0.0 AS z, CASE p_partkey % 9 WHEN 0 THEN 'void' WHEN 1 THEN 'slab' END AS kind, p_partkey AS id FROM part""",
    "measured": """SELECT p_partkey AS name, p_size + 0.0 AS x0, p_size + 1.0 AS x1, 0.0 AS y0, p_partkey % 9 + 1.0 AS y1, 0.0 AS z0, 3.0 AS z1, p_size * 2 AS triangles, p_partkey % 4 AS uv_layers, p_brand AS materials, p_partkey % 3 = 0 AS collision FROM part WHERE p_partkey % 11 > 0""",
    "expected": """SELECT p_partkey AS name, p_size + 0.0 AS x0, p_size + 1.0 AS x1, 0.0 AS y0, p_partkey % 9 + CASE WHEN p_partkey % 17 = 0 THEN 1.25 ELSE 1.00005 END AS y1, 0.0 AS z0, 3.0 AS z1, CASE WHEN p_partkey % 19 > 0 THEN p_size * 2 - CASE WHEN p_partkey % 23 = 0 THEN 1 ELSE 0 END END AS triangles, CASE WHEN p_partkey % 5 = 0 THEN 'other' ELSE p_brand END AS materials FROM part WHERE p_partkey % 13 > 0""",
    # Rectangular faces in planes across the axes.
    "face": """SELECT concat('m', p_partkey % 40) AS mesh, p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS axis, CASE p_partkey % 2 WHEN 0 THEN 1 ELSE -1 END AS facing, p_partkey * 7 % 20 + p_partkey % 4 / 2048.0 AS "offset",
        p_partkey * 37 % 60 + 80 * CAST(floor(p_partkey / 2000) AS BIGINT) AS u0, p_partkey * 37 % 60 + p_size % 8 + 1 + 80 * CAST(floor(p_partkey / 2000) AS BIGINT) AS u1, p_partkey * 91 % 60 AS v0, p_partkey * 91 % 60 + p_size % 7 + 1 AS v1 FROM part""",
    # A cube of side 4 for each supplier, and a smaller one in or beside it, turned inside out or not.
    "shell_vertex": """SELECT s_suppkey AS mesh, c.v + 8 * k.k AS vid, CASE WHEN k.k = 0 THEN 4.0 * (c.v % 2) WHEN s_suppkey % 4 = 2 THEN 10 + 2.0 * (c.v % 2) ELSE 1 + 2.0 * (c.v % 2) END AS x, CASE k.k WHEN 0 THEN 4.0 ELSE 2.0 END * (CAST(floor(c.v / 2) AS BIGINT) % 2) + k.k AS y, CASE k.k WHEN 0 THEN 4.0 ELSE 2.0 END * CAST(floor(c.v / 4) AS BIGINT) + k.k AS z
        FROM supplier CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS c(v) CROSS JOIN (VALUES (0), (1)) AS k(k) WHERE k.k = 0 OR s_suppkey % 4 < 3""",
    "shell_tri": """SELECT s_suppkey AS mesh, t.n + 12 * k.k AS tid, t.a + 8 * k.k AS a, CASE WHEN k.k = 1 AND s_suppkey % 4 <> 1 THEN t.c ELSE t.b END + 8 * k.k AS b, CASE WHEN k.k = 1 AND s_suppkey % 4 <> 1 THEN t.b ELSE t.c END + 8 * k.k AS c
        FROM supplier CROSS JOIN (VALUES (0, 0, 2, 1), (1, 1, 2, 3), (2, 4, 5, 6), (3, 5, 7, 6), (4, 0, 1, 4), (5, 1, 5, 4), (6, 2, 6, 3), (7, 3, 6, 7), (8, 0, 4, 2), (9, 2, 4, 6), (10, 1, 3, 5), (11, 3, 7, 5)) AS t(n, a, b, c) CROSS JOIN (VALUES (0), (1)) AS k(k) WHERE k.k = 0 OR s_suppkey % 4 < 3""",
    "half_open": """SELECT user_id AS col, CASE WHEN event_id % 97 > 0 THEN CAST(floor(value * 10) AS BIGINT) END AS lo, CASE WHEN event_id % 89 > 0 THEN CAST(floor(value * 10) AS BIGINT) + 50 END AS hi FROM events""",
    # Storeys, columns, stairs, images.
    "pillar": """SELECT p_brand AS building, p_partkey % 5 AS k, p_partkey % 41 AS name, CASE WHEN p_partkey % 6 = 0 THEN (p_partkey % 5 + 1) % 5 END AS "to", p_partkey % 7 = 0 AS through, p_size + p_partkey % 3 / 8.0 AS x, p_size * 2.0 AS y, p_partkey AS id FROM part""",
    "level_height": """SELECT n_nationkey % 5 AS floor, CAST(n_nationkey % 5 * 4 AS DOUBLE) AS z, 3.5 AS wall, 0.5 AS slab FROM nation WHERE n_nationkey < 5""",
    "stair": """SELECT p_partkey AS name, p_size + 0.0 AS z, 3.0 AS rise, p_size % 9 + 2 AS risers, 0.25 AS run, p_partkey % 50 + 0.0 AS x, 1.0 AS y, 1.25 AS width, 0.125 AS gap, 1.5 AS depth FROM part""",
    "image": """SELECT p_partkey AS img, p_size * 90 + 100 AS width, p_size * 70 AS height FROM part""",
    "drawing": """SELECT p_partkey AS id, CAST(p_partkey % 700 AS DOUBLE) AS p, CASE WHEN p_partkey % 3 = 0 THEN 1.5 END AS a, CASE WHEN p_partkey % 3 = 0 THEN 12.0 END AS bx, CASE WHEN p_partkey % 3 = 1 THEN 0.75 END AS s, CASE WHEN p_partkey % 3 = 1 THEN 7.0 END AS tx, p_size / 40.0 AS cover, p_partkey % 400 AS drawings FROM part""",
    # Outlines of ten to fourteen corners near a rectangle or a circle.
    "outline": """SELECT p_partkey AS shape, c.k AS ord, CASE WHEN p_partkey % 2 = 0 THEN 3 * cos(c.k * 0.5235987755982988) + p_size % 3 * c.k % 2 / 16.0 ELSE CASE WHEN c.k < 6 THEN c.k * 1.0 ELSE 11.0 - c.k END + p_partkey * c.k % 7 / 512.0 END AS x,
        CASE WHEN p_partkey % 2 = 0 THEN 3 * sin(c.k * 0.5235987755982988) ELSE CASE WHEN c.k < 6 THEN 0.0 ELSE 4.0 END + p_partkey * c.k % 5 / 64.0 END AS y FROM part CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) AS c(k)""",
}

#: Numbers with a point are doubles, not decimals, in both.
VIEWS = {name: re.sub(r"(?<![\w.])\d+\.\d+(?![\w.])", r"\g<0>e0", text) for name, text in VIEWS.items()}
#: Spark's names for what DuckDB calls otherwise.
_SPARK = (('"case"', "`case`"), ('"on"', "`on`"), ('"by"', "`by`"), ('"to"', "`to`"), ('"offset"', "`offset`"), ("VARCHAR", "STRING"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    tables = {t for t in ("lineitem", "events", "part", "orders", "customer", "supplier", "nation") if re.search(rf"FROM {t}\b", text)}
    for a, b in _SPARK:
        text = text.replace(a, b)
    for t in tables:
        text = re.sub(rf"FROM {t}\b", f"FROM parquet.`{sf_dir}/{t}.parquet`", text)
    return spark.sql(text)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the views before it."""
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    rest = sql.strip()
    return f"WITH RECURSIVE {head}{', ' + rest[5:] if rest.upper().startswith('WITH ') else ' ' + rest}"
