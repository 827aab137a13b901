"""Conversation repair against a dynamic programme over (cost, audit), one conversation at a time."""

import hashlib
import itertools
import random
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from kpiforge.llm import conversation_repair as repair

SPACE = " \t\n\x0b\x0c\r"


def hash64(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def step(state, letter):
    """The pattern (s?(ua)+)?; None if the letter cannot follow."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, letter))


def grow(best, extra=()):
    """Insertions from every state, until nothing gets better."""
    for _ in range(4):
        for (state, (cost, audit, lines)), new in itertools.product(list(best.items()), "ua"):
            to = step(state, new)
            if to:
                entry = (cost + 2, audit + "I", lines + (("user:" if new == "u" else "assistant:"),))
                best[to] = min(best.get(to, entry), entry)
    return best


def mend(conv, rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hash64(r[3])))
    counts, seen, best = [0, 0, 0], set(), {"": (0, "", ())}
    for _, _, role, text in rows:
        core = text.rstrip(SPACE)
        fault = 0 if not core else 1 if (role, text) in seen else 2 if core[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        new = {}
        for state, (cost, audit, lines) in grow(best).items():
            options = [(state, (cost + 3, audit + "D", lines))]
            if fault in (2, None):
                extra = 1 if fault == 2 else 0
                options.append((step(state, role[:1]), (cost + extra, audit + "K", (*lines, f"{role}:{text}"))))
                options += [(step(state, x[0]), (cost + 2 + extra, audit + "R", (*lines, f"{x}:{text}"))) for x in ("user", "assistant")]
            for to, entry in options:
                if to is not None:
                    new[to] = min(new.get(to, entry), entry)
        best = new
    cost, audit, lines = min(grow(best)[s] for s in ("", "a") if s in best)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def fixture():
    rnd = random.Random(11)
    roles = ["user", "assistant", "system", "tool", None, "", "User", "s"]
    texts = ["Yes.", "no", "Why? \n", "  \t", "", None, "é!\x0b", "a.b"]
    rows = []
    for conv in range(150):
        n = rnd.randrange(1, 9)
        for turn in range(n):
            role = rnd.choice(roles) if rnd.random() < 0.3 else "system" if turn == 0 and rnd.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rnd.choice(texts) if rnd.random() < 0.4 else f"text {rnd.randrange(6)}" + rnd.choice([".", "!", "", "?  "])
            rows.append((conv, rnd.choice([None, turn]) if rnd.random() < 0.05 else turn + (turn > 3 and conv % 3), role, text))
    rows += [(None, t, "user", f"q{t}.") for t in range(4)] + [(500, None, None, None), (501, 1, "system", "s."), (502, 2, "tool", "t.")]
    rows += [(1 << 60, t, rnd.choice(["user", "assistant", "assistant", "tool"]), f"m{rnd.randrange(300)}" + rnd.choice([".", ""])) for t in range(400)]
    rows += [(600, 3, "user", "same."), (600, 3, "user", "same."), (600, 3, "user", "other."), (600, -2, "user", "same.")]
    rows += [(601, t, "user", "all alike.") for t in range(100)]
    return rows


@pytest.mark.parametrize("segment", [16, 3])
def test_equals_dynamic_programme(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = fixture()
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("letters", F.lit(1)).withColumn("seq", F.lit("x"))
    df = df.toDF("conv_id", "turn", "role", "text", "TEXT", "seq").repartition(3)
    for got, given in ((repair.repair(repair.damage(df)), damaged(rows)), (repair.repair(df), [(c, t, r or (" " if r is None else ""), x if x is not None else " ") for c, t, r, x in rows])):
        convs = {r[0] for r in rows}
        want = sorted((mend(c, [r for r in given if r[0] == c]) for c in convs), key=repr)
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_empty_table(spark):
    assert repair.repair(repair.damage(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))).count() == 0


def test_auction_equals_enumeration():
    rnd = random.Random(2)
    for _ in range(200):
        letters = "".join(rnd.choice("brsuaoSUAO") for _ in range(rnd.randrange(7)))
        ends = tuple(rnd.choice([0, 1, 4, repair._NONE]) for _ in range(3)) + (0,)
        lattice = repair.Lattice(letters, ends)
        paths = {q: [] for q in range(4)}

        def walk(origin, node, cost, what):
            if cost > 60 or len(what) > len(letters) + 6:
                return
            if node == lattice.goal:
                paths[origin].append((cost, what))
                return
            for c, w, j in lattice.arcs[node]:
                if not (w == "I" and what.endswith("II")):
                    walk(origin, j, cost + c, what + w)

        if len(letters) < 4:
            for q in range(4):
                walk(q, q, 0, "")
                if paths[q]:
                    cost, what = min(paths[q])
                    assert lattice.auction(q) == cost and lattice.trace(q)[0] == what
