"""Secret scans with linking of credentials that come in parts.

Base kinds are reported wherever they stand. Weak kinds (user names, long opaque strings,
addresses of services) mean little alone: a weak candidate is reported only if its complementary
parts lie within the same scope, ``scope`` characters to either side. An identifier needs a secret, a
secret an identifier, an endpoint both. The interval join is a sweep: with a document's
candidates sorted by start, the nearest part of each role before and after a candidate are a running
maximum of ends and a running minimum of starts, so no pairs are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SCOPE = 256
#: Kinds in order: pattern; the group whose length counts (0: the match) and its least length; role; weak.
KINDS: dict[str, tuple[str, int, int, str, bool]] = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "secret", False),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, "identifier", False),
    "hex": (r"[0-9a-f]{24,}", 0, 24, "secret", False),
    "user": (r"""(?i:(user_?name|user_?id|login|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", 2, 3, "identifier", True),
    "blob": (r"[A-Za-z0-9+/]{32,}={0,2}", 0, 32, "secret", True),
    "endpoint": (r"""(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20"'<>]+""", 0, 8, "endpoint", True),
}
BASE = [k for k, v in KINDS.items() if not v[4]]
ROLES = ("identifier", "secret", "endpoint")
#: Plain strings of which a match holds one; looked for first where that is cheaper than the pattern.
HOLDS = {"access": "AKIA", "endpoint": "://"}
MASK = "<secret>"


def _parts(text: Column, order: int, kind: str) -> Column:
    """The kind's matches, leftmost and non-overlapping: length of what lies between the last match (or the text's start) and it, its own length, and whether it is long enough."""
    pattern, group, least, _, _ = KINDS[kind]
    between = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.arrays_zip(between.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    fits = lambda m: F.length(F.regexp_extract(m, pattern, group) if group else m) >= least
    if kind == "blob":  # of mixed letters and digits
        fits = lambda m: (F.length(m) >= least) & m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
    found = F.transform(
        F.filter(zipped, lambda x: x["match"].isNotNull()),
        lambda x, i: F.struct(F.lit(order).alias("kind"), i.alias("at"), x["gap"].alias("gap"), F.length(x["match"]).alias("length"), fits(x["match"]).alias("fits")),
    )
    there = text.rlike(pattern) if kind not in HOLDS else text.contains(HOLDS[kind]) & text.rlike(pattern)
    return F.when(there, found).otherwise(F.array().cast("array<struct<kind:int,at:int,gap:int,length:int,fits:boolean>>"))


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """place, kind, start, end of the reported spans, and ``clear``: the end of what those before it cover."""
    per_kind = Window.partitionBy("place", "kind").orderBy("at")
    after = F.sum(F.col("gap") + F.col("length")).over(per_kind.rowsBetween(Window.unboundedPreceding, 0))
    spans = parts.withColumn("end", after.cast("int")).withColumn("start", F.col("end") - F.col("length")).where("fits")
    names = list(KINDS)
    is_weak = F.col("kind").isin([i for i, k in enumerate(names) if KINDS[k][4]])
    order = Window.partitionBy("place").orderBy("start", "kind")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    covered = F.coalesce(F.max(F.when(~is_weak, F.col("end"))).over(back) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(~is_weak, F.col("start"))).over(ahead) < F.col("end"), F.lit(False))
    near = {}
    marked = spans.withColumn("covered", is_weak & covered)
    for role in ROLES:
        has = F.col("kind").isin([i for i, k in enumerate(names) if KINDS[k][3] == role]) & ~F.col("covered")
        before = F.col("start") - F.max(F.when(has, F.col("end"))).over(back) <= scope
        behind = F.min(F.when(has, F.col("start"))).over(ahead) - F.col("end") <= scope
        near[role] = F.coalesce(before, F.lit(False)) | F.coalesce(behind, F.lit(False))
    wants = {"identifier": near["secret"], "secret": near["identifier"], "endpoint": near["identifier"] & near["secret"]}
    linked = F.lit(False)
    for role in ROLES:
        linked |= F.col("kind").isin([i for i, k in enumerate(names) if KINDS[k][3] == role]) & wants[role]
    reported = marked.withColumn("linked", linked).where(~is_weak | (F.col("linked") & ~F.col("covered")))
    return reported.withColumn("clear", F.coalesce(F.max("end").over(back), F.lit(0))).select("place", "kind", "start", "end", "clear")


_SPANS = "array<struct<start:int,kind:int,end:int,clear:int>>"


def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE, keep_text: bool = False) -> DataFrame:
    """The rows of docs as a struct ``row`` (without their text unless keep_text), with ``spans`` by start, then kind.

    Positions are code points, ends exclusive. Null texts are empty. Every row is scanned on its
    own, equal ones too; the whole text is scanned.
    """
    kept = [c for c in docs.columns if keep_text or c != text]
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*kept).alias("row"), whole.alias("text"), F.monotonically_increasing_id().alias("place"))
    parts = F.concat(*[_parts(F.col("text"), i, k) for i, k in enumerate(KINDS)])
    rows = stored(rows.select("row", "place", parts.alias("parts")), "parts")
    some = rows.where(F.size("parts") > 0)
    linked = _linked(some.select("place", F.inline("parts")), scope)
    spans = F.array_sort(F.collect_list(F.struct("start", "kind", "end", "clear"))).cast(_SPANS)  # as many as fit in one text
    found = linked.groupBy(F.col("place").alias("found_at")).agg(spans.alias("spans"))
    hit = some.join(found, F.col("place") == F.col("found_at"), "left").select("row", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))
    return hit.unionByName(rows.where(F.size("parts") == 0).select("row", F.array().cast(_SPANS).alias("spans")))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """text with what the spans cover replaced, a mask for each stretch."""
    step = lambda acc, s: F.when(
        s["start"] > acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)).alias("out"))
    ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when((s["start"] == 0) & (acc["out"] == ""), F.lit(mask)).otherwise(acc["out"]).alias("out")))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, end)).otherwise(text)


def query(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))
    names = list(KINDS)
    of = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [of(names.index(k)).alias(f"n_{k}") for k in BASE]
    return found.select("row.doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def oracle_sql(scope: int = SCOPE) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    names = list(KINDS)
    scans = []
    for i, (name, (pattern, group, least, _, _)) in enumerate(KINDS.items()):
        fits = f"length(regexp_extract(match, {quoted(pattern)}, {group})) >= {least}" if group else f"length(match) >= {least}"
        if name == "blob":
            fits += " AND regexp_matches(match, '[0-9]') AND regexp_matches(match, '[A-Z]') AND regexp_matches(match, '[a-z]')"
        scans.append(f"""SELECT place, {i} AS kind, pos, length(gap) AS gap, length(match) AS length, {fits} AS fits FROM (
  SELECT place, generate_subscripts(m, 1) AS pos, unnest(m) AS match, unnest(g[:len(m)]) AS gap FROM (SELECT place, regexp_extract_all(text, {quoted(pattern)}) AS m, regexp_split_to_array(text, {quoted(pattern)}) AS g FROM d))""")
    of = {r: ", ".join(str(i) for i, k in enumerate(names) if KINDS[k][3] == r) for r in ROLES}
    weak = ", ".join(str(i) for i, k in enumerate(names) if KINDS[k][4])
    near = lambda r: f"coalesce(s - max(CASE WHEN kind IN ({of[r]}) AND NOT covered THEN e END) OVER back <= {scope}, FALSE) OR coalesce(min(CASE WHEN kind IN ({of[r]}) AND NOT covered THEN s END) OVER ahead - e <= {scope}, FALSE)"
    windows = "WINDOW back AS (PARTITION BY place ORDER BY s, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ahead AS (PARTITION BY place ORDER BY s, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    list_of = lambda where: f"coalesce(string_agg(CASE kind {' '.join(f'WHEN {i} THEN {quoted(k)}' for i, k in enumerate(names))} END || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (WHERE {where}), '')"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{k}" for i, k in enumerate(names) if k in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, coalesce(text, '') AS text FROM documents),
p AS ({' UNION ALL '.join(scans)}),
n AS (SELECT place, kind, fits, length, sum(gap + length) OVER (PARTITION BY place, kind ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM p),
c AS (SELECT place, kind, e - length AS s, e FROM n WHERE fits),
v AS (SELECT *, kind IN ({weak}) AND (coalesce(max(CASE WHEN kind NOT IN ({weak}) THEN e END) OVER back > s, FALSE) OR coalesce(min(CASE WHEN kind NOT IN ({weak}) THEN s END) OVER ahead < e, FALSE)) AS covered FROM c {windows}),
l AS (SELECT *, {near('identifier')} AS near_identifier, {near('secret')} AS near_secret FROM v {windows}),
r AS (SELECT * FROM l WHERE kind NOT IN ({weak}) OR (NOT covered AND CASE WHEN kind IN ({of['identifier']}) THEN near_secret WHEN kind IN ({of['secret']}) THEN near_identifier ELSE near_identifier AND near_secret END))
SELECT any_value(doc_id) AS doc_id, {counts}, sha256({list_of(f'kind < {len(BASE)}')}) AS base_sha256, {list_of('kind IS NOT NULL')} AS spans
FROM d LEFT JOIN r USING (place) GROUP BY place
"""


ORACLE_SQL = oracle_sql()
