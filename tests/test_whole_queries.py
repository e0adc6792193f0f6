"""Registered queries over whole tables, against brute force on small ones."""

from cairnframe.plans import registry


def test_mesh_islands_follow_every_triangle(spark, tmp_path):
    rows = [(n, 1 + n % 2, n * 5 + 1, n * 3 + 2, float(n)) for n in range(1, 25)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    island = {(m, o % 97): o % 97 for o, m, *_ in rows}
    assert {(m, v % 97) for o, m, p, s, _ in rows for v in (o, p, s)} - set(island)  # corners that are no vertices connect vertices too
    at = {(m, v % 97): v % 97 for o, m, p, s, _ in rows for v in (o, p, s)}
    for _ in at:
        for o, m, p, s, _q in rows:
            corners = [(m, v % 97) for v in (o, p, s)]
            least = min(at[c] for c in corners)
            at.update({c: least for c in corners})
    want = {}
    for m, v in island:
        want[m, at[m, v]] = want.get((m, at[m, v]), 0) + 1
    assert 2 < len(want) < len(island)
    got = registry.QUERIES["mesh_islands"](spark, str(tmp_path)).collect()
    assert {(r.mesh, r.island): r.vertices for r in got} == want and len(got) == len(want)


def test_interval_lookup_takes_every_interval(spark, tmp_path):
    parts = [(i, 1 + i * 7 % 50, "b") for i in range(1, 30)] + [(501, 8, "b"), (1001, 8, "b")]  # the same x0, and of part 1 the same interval
    customers = [(i,) for i in range(1, 400)]
    spark.createDataFrame(parts, "p_partkey long, p_size long, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(customers, "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    want = {}
    for (c,) in customers:
        x = c * 37 % 1000
        want[c] = (x, min((p for p, size, _ in parts if p * 37 % 500 <= x <= p * 37 % 500 + size), default=None))
    assert len({o for _, o in want.values()}) > 10 and None in {o for _, o in want.values()}
    got = registry.QUERIES["interval_lookup"](spark, str(tmp_path)).collect()
    assert {r.id: (r["at"], r.ord) for r in got} == want and len(got) == len(want)
