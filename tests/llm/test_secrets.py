import hashlib
import re

from cairnframe.llm import secrets

KEY = "AKIA" + "ABCDEFGHIJKLMNOP"
HEX = "0123456789abcdef" * 2
TEXTS = [None, "", "no secrets", f"token = \"{HEX}\" and {KEY}", "secret: token: abcdefg", "PassWord=abc passwd:abcdef", f"é👍 api_key={HEX}", f"{HEX}{HEX} AKIA12", "token=abcdef" * 500,
         f"{KEY} then https://db.example.com/x and password: hunter2hunter2", "https://db.example.com/x alone", "user_name: alice " + "." * 400 + " password: hunter22", "user_name: alice password: hunter22",
         "x" * 200_000 + f" token={HEX}"]


def base(text):
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    kinds = [("assign", rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m)]
    return [f"{name}:{s}:{e}" for s, _, name, e in sorted(found)]


def test_base_spans_agree_with_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[3])], "doc_id long, text string")
    rows = secrets.query(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        want = base(TEXTS[3 if r.doc_id is None else r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert r.n_assign + r.n_access + r.n_hex == len(want)
        assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == want


def test_weak_candidates_need_their_complements(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    kinds = {r.doc_id: {s.split(":")[0] for s in r.spans.split(",")} for r in secrets.query(df).collect()}
    assert "endpoint" in kinds[9] and "endpoint" not in kinds[10]
    assert "user" in kinds[12] and "user" not in kinds[11]


def test_masking_leaves_the_rest(spark):
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans int, row string")
    found = secrets.scan(df, keep_text=True)
    got = {r["id"]: r.masked for r in found.select("row.doc_id", secrets.masked(found["row.text"], found["spans"]).alias("masked")).toDF("id", "masked").collect()}
    assert got[2] == "no secrets" and got[0] is None
    assert got[3] == f"{secrets.MASK}\" and {secrets.MASK}"
    assert got[6] == f"é👍 {secrets.MASK}"
    assert KEY not in got[9] and "hunter2" not in got[9] and " then " in got[9]


def test_empty_table(spark):
    assert secrets.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0
