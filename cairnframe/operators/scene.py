"""Objects of a scene: their place in the world through chains of parents, and what their matrices scale by.

A matrix is an array of twelve doubles, three rows of four; it takes an object's own space to its
parent's, or to the world where there is none. Names are unique; a parent that is not in the table is
none. Objects on a loop of parents, or below one, and those with a matrix that is null or of another length on
their way have no place: their matrix is null. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnframe.storage import discard, stored


def composed(outer: Column, inner: Column) -> Column:
    """The matrix that takes a point through ``inner``, then ``outer``."""
    at = lambda m, r, c: m[r * 4 + c]
    return F.array(*[sum((at(outer, r, k) * at(inner, k, c) for k in range(1, 3)), at(outer, r, 0) * at(inner, 0, c)) + (at(outer, r, 3) if c == 3 else F.lit(0.0)) for r in range(3) for c in range(4)])


def world(objects: DataFrame) -> DataFrame:
    """objects (name, parent, matrix, and others) with each matrix the one to the world. By pointer jumping: in each round an object takes on the matrix of the one it points to, and points where that did, so a chain takes as many rounds as its length has binary digits."""
    names = objects.select(F.col("name").alias("known"))
    whole = F.when(F.size("matrix") == 12, F.col("matrix"))
    now = stored(objects.select("name", "parent", whole.alias("matrix")).join(names, F.col("parent") == F.col("known"), "left").select("name", F.col("known").alias("to"), "matrix"), "scene")
    rounds = now.count().bit_length()
    for _ in range(rounds):
        if now.where("to IS NOT NULL").isEmpty():
            break
        far = now.select(F.col("name").alias("f_name"), F.col("to").alias("f_to"), F.col("matrix").alias("f_matrix"))
        # Objects that have arrived meet nothing.
        met = now.where("to IS NOT NULL").join(far, F.col("to") == F.col("f_name")).select("name", F.col("f_to").alias("to"), F.when(F.col("f_matrix").isNotNull() & F.col("matrix").isNotNull(), composed(F.col("f_matrix"), F.col("matrix"))).alias("matrix"))
        then = stored(now.where("to IS NULL").unionByName(met), "scene")
        discard(now)
        now = then
    placed = now.select(F.col("name").alias("of"), F.when(F.col("to").isNull(), F.col("matrix")).alias("matrix"))
    return objects.drop("matrix").join(placed, F.col("name") == F.col("of")).drop("of")


def scales(placed: DataFrame) -> DataFrame:
    """placed (name, matrix) with sx, sy and sz: how long the axes become, all negative where the matrix mirrors; null without a matrix."""
    m = F.col("matrix")
    long = lambda c: F.sqrt(m[c] * m[c] + m[4 + c] * m[4 + c] + m[8 + c] * m[8 + c])
    det = m[0] * (m[5] * m[10] - m[6] * m[9]) - m[1] * (m[4] * m[10] - m[6] * m[8]) + m[2] * (m[4] * m[9] - m[5] * m[8])
    sign = F.when(det < 0, -1.0).otherwise(1.0)
    return placed.withColumns({f"s{x}": sign * long(c) for c, x in enumerate("xyz")})


def sound(placed: DataFrame, tol: float = 1e-5) -> DataFrame:
    """One row on placed objects (name, type, matrix): how many are neither MESH nor EMPTY, how many are scaled by other than 1 or have no place, how many EMPTY there are, and passed: none of the first two."""
    s = scales(placed)
    off = F.coalesce(F.greatest(*[F.abs(F.col(f"s{x}") - 1) for x in "xyz"]) >= tol, F.lit(True)) | F.col("sx").isNull()
    found = s.agg(F.count_if(~F.coalesce(F.col("type").isin("MESH", "EMPTY"), F.lit(False))).alias("other_objects"), F.count_if(off).alias("scaled"), F.count_if(F.col("type") == "EMPTY").alias("empties"))
    return found.withColumn("passed", (F.col("other_objects") == 0) & (F.col("scaled") == 0))
