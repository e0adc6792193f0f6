import random


def text(seed, bad=0):
    r = random.Random(seed)
    w = [r.choice("abcdefgh") + str(r.randrange(3000)) for _ in range(r.randrange(60, 120))]
    for _ in range(bad):
        w[r.randrange(len(w))] = r.choice(["vile", "rotten", "nasty", "grim"])
    return " ".join(w)


def documents():
    rows = [(i, text(i)) for i in range(100)] + [(i, text(i, 5)) for i in range(100, 160)]
    rows += [(500, text(500)), (501, text(500)), (502, text(500) + " more"), (600, text(600) + " password: hunter2hunter2"), (700, None), (None, text(700))]
    return [(i, t, "en", ["a", "b", None][(i or 0) % 3], len(t or "")) for i, t in rows]


def labels():
    return [(i, 1, int(i >= 100)) for i in range(0, 160, 1)]
