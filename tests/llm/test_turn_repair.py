"""Conversation repair against all edit sequences, by brute force, and segments of any size against whole conversations."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakequarry.llm import turn_repair as R

from .fixtures import table

SCHEMA = "conv_id long, turn long, role string, text string, present string, key string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def all_repairs(rows, faults):
    """The least (cost, audit, repaired) of all edit sequences, tried in the order of cost and audit."""
    best = None

    def go(p, roles, cost, audit, out, run):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if p == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(x for x in (best, (cost, audit, out)) if x is not None)
        if not re.fullmatch("s?(ua)*u?", roles):
            return
        if run < 2:
            for role in ("user", "assistant"):
                go(p, roles + role[0], cost + 3, audit + "I", [*out, (role, "")], run + 1)
        if p < len(rows):
            (role, text), extra = rows[p], 3 if faults[p] == "truncated" else 0
            go(p + 1, roles, cost + 4, audit + "D", out, 0)
            if faults[p] not in ("blank", "duplicate"):
                go(p + 1, roles + (role[:1] or "?"), cost + extra, audit + "K", [*out, (role, text)], 0)
                for to in ("user", "assistant"):
                    go(p + 1, roles + to[0], cost + 3 + extra, audit + "R", [*out, (to, text)], 0)

    go(0, "", 0, "", [], 0)
    return best


def brute(rows):
    """Answers by conversation from (conv_id, turn, role, text) as they are after damage."""
    out = {}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role, text))
    for conv, own in by.items():
        own.sort()
        seen, faults = set(), []
        for _, _, role, text in own:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for has, t, _, _ in own if has}
        pairs = [(a[2][:1] or "?") + (b[2][:1] or "?") for a, b in zip(own, own[1:], strict=False)]
        cost, audit, fixed = all_repairs([r[2:] for r in own], faults)
        n = Counter(faults)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


def made(n=150, seed=4, longest=5):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Why? ", "  ", "", "Go!\n", "well ", "ok .", None, "x" * 5000 + "."]
    rows = []
    for conv in range(n):
        turns = sorted(rng.sample(range(-2, 9), rng.randrange(1, longest + 1)))
        for k, t in enumerate(turns):
            usual = "system" if k == 0 and rng.random() < 0.3 else ["user", "assistant"][k % 2]
            role = rng.choice([usual] * 6 + ["user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([t, t, t, t, None, turns[0]]), role, rng.choice(texts[:2] * 4 + texts)))
    return rows + [(None, 1, "user", "a."), (None, None, "assistant", "b."), (None, None, None, None), (500, 3, "user", "same."), (500, 3, "user", "same.")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def answers(df):
    names = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    rows = df.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r[n] for n in names) for r in rows}


def test_answers_equal_brute_force(spark):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in made()]
    want = brute(rows)
    df = frame(spark, rows)
    assert answers(R.repair(df)) == want
    assert answers(R.repair(df, most_rows=2)) == want  # nearly all conversations in segments
    assert answers(R.repair(df, most_rows=1)) == want


def test_query_damages_and_keeps_every_conversation(spark, tmp_path):
    rows = made(300, 9, 4) + [(c, 0, "user", "alone.") for c in range(1000, 1040)]  # some lose their only row
    d = table(spark, tmp_path, "conversations", frame(spark, rows))
    got = answers(R.op13_turn_repair(spark, d))
    left = brute(damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got == {c: left.get(c, nothing) for c in {r[0] for r in rows}}
    assert set(left) < set(got)
    empty = table(spark, tmp_path / "none", "conversations", frame(spark, rows).limit(0))
    assert R.op13_turn_repair(spark, empty).count() == 0


@pytest.mark.parametrize("most_rows", [7, 64])
def test_long_conversations_equal_the_plain_program(spark, most_rows):
    rng = random.Random(6)
    rows = [(c, rng.randrange(400), rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(["a.", "b!", f"{i}.", f"{i}", " "])) for c in (1, 2) for i in range(500)]
    df = frame(spark, rows)
    got = answers(R.repair(df, most_rows=most_rows))
    assert got == answers(R.repair(df, most_rows=10_000))
    placed = R.repaired_turns(df, most_rows=most_rows).collect()
    for c in (1, 2):
        own = [(r.role, r.text) for r in sorted((r for r in placed if r.conv_id == c), key=lambda r: tuple(r.place))]
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in own).encode()).hexdigest() == got[c][-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in own))


def test_matrices_compose():
    rng = random.Random(2)
    for _ in range(300):
        symbols = "".join(rng.choice("suaxSUAX0145uaua") for _ in range(rng.randrange(12)))
        cut = rng.randrange(len(symbols) + 1)
        assert R.onto(R.matrix(symbols[:cut]), R.onto(R.matrix(symbols[cut:]), R.AT_END))[0] == R.cheapest(symbols) if 0 < cut < len(symbols) else True
        rows = [(R.NAMES.get(R.INITIAL_OF[c], {"s": "system", "x": "tool"}.get(R.INITIAL_OF[c])), c) for c in symbols[:5]]
        assert R.cheapest(symbols[:5]) == all_repairs(rows, [R.FAULT_OF[c] for c in symbols[:5]])[:2]


def test_long_texts_and_damage(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "word " * 60_000 + str(t) + ".") for t in range(6)]
    df = R.damaged(frame(spark, rows))
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in df.where("present").collect()) == sorted(damage(rows))
    assert answers(R.repair(frame(spark, rows))) == brute(rows)
    assert R.repair(frame(spark, rows).where(F.lit(False))).count() == 0
