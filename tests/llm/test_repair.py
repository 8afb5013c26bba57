"""Repaired conversations against a plain search over edit scripts."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fernglas.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string, block int, key string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit, roles and texts) over all scripts; turns: (initial, must go, truncated, role, text)."""
    best = {q: (0, "", ()) if q in ("", "a") else None for q in ("", "s", "u", "a")}

    def insert(best):
        for _ in range(4):
            for q in best:
                after = best[NEXT[q]]
                if after is not None:
                    role = {"u": "user", "a": "assistant"}[NEXT[q]]
                    new = (after[0] + 3, "I" + after[1], ((role, ""), *after[2]))
                    if best[q] is None or new[:2] < best[q][:2]:
                        best[q] = new
        return best

    best = insert(best)
    for initial, goes, truncated, role, text in reversed(turns):
        now = {}
        for q in best:
            options = [(best[q][0] + 4, "D" + best[q][1], best[q][2])]
            if not goes:
                x = best[NEXT[q]]
                options.append((x[0] + 3 + 3 * truncated, "R" + x[1], (({"u": "user", "a": "assistant"}[NEXT[q]], text), *x[2])))
                if (q, initial) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                    x = best[initial]
                    options.append((x[0] + 3 * truncated, "K" + x[1], ((role, text), *x[2])))
            now[q] = min(options, key=lambda o: o[:2])
        best = insert(now)
    return best[""]


def plain(rows, damaged):
    own = defaultdict(list)
    for conv, turn, role, text in damaged:
        own[conv].append((turn, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(own[conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        counts, seen, made = [0, 0, 0], set(), []
        for _, _, role, text in turns:
            core = text.strip(" \t\n\v\f\r")
            fault = 0 if not core else 1 if (role, text) in seen else 2 if core[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            made.append((role[:1], fault in (0, 1), fault == 2, role, text))
        numbers = {t[0] for t in turns if t[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(made, made[1:]))
        cost, audit, left = cheapest(made)
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())
    return out


def check(spark, monkeypatch, rows):
    rows = [tuple(r) for r in rows]
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    monkeypatch.setattr(queries, "table", lambda *_: table)
    out = queries.op12_repair(spark, "")
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = out.collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == plain(rows, plain_damage(rows))


def random_rows(seed, conversations, longest):
    rnd = random.Random(seed)
    rows = []
    for c in range(conversations):
        turn = rnd.choice([0, 0, -3, 10])
        for _ in range(rnd.randint(0, longest)):
            role = rnd.choice(["user", "assistant", "assistant", "system", "tool", "", None, "unknown", "User"]) if rnd.random() < 0.3 else rnd.choice(["user", "assistant"])
            text = rnd.choice(["Hi.", "ok", "Well? ", "no!\n", "", " \t", None, "same.", "é", " ", "a.\x1c"])
            rows.append((c, None if rnd.random() < 0.05 else turn, role, text))
            turn += rnd.choice([0, 1, 1, 1, 1, 2])
    return rows


ODD = [
    (None, 0, "user", "no id."), (None, None, None, None), (1, None, "user", "a."), (1, None, "user", "a."), (1, None, "assistant", None), (2, 5, "system", "only system."),
    (3, 2**40, "user", "far."), (3, -(2**40), "assistant", "far."), (4, 0, "user", "x" * 3_000_000 + "."), (4, 1, "assistant", ". " * 500_000), (5, 0, "user", "😀?"), (5, 1, "assistant", "İ.")
]


def test_conversations(spark, monkeypatch):
    check(spark, monkeypatch, spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect())


@pytest.mark.parametrize("block", [2, 3, 8192])
def test_random_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)  # below: conversations over several blocks
    check(spark, monkeypatch, random_rows(block, 60, 14) + ODD + [(900, k // 7, ("user", "assistant")[k % 2], f"{k % 11}.") for k in range(100)])


def test_empty(spark, monkeypatch):
    check(spark, monkeypatch, [])
    gone = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    check(spark, monkeypatch, [(7, gone, "user", "a.")])


def test_distances_by_block():
    rnd = random.Random(5)
    for _ in range(300):
        turns = [(rnd.choice("suaax"), rnd.random() < 0.2, rnd.random() < 0.2) for _ in range(rnd.randint(0, 12))]
        whole = repair.distances(turns, repair._END, True)
        cut = rnd.randint(0, len(turns))
        rest = repair.distances(turns[cut:], repair._END, True)
        assert repair.distances(turns[:cut], rest[:4], False)[: 4 * cut] == whole[: 4 * cut]
        letters = "".join(e for e, _, _ in repair.walk(turns, whole, 0, True))
        assert (whole[0], letters) == cheapest([(*t, "", "") for t in turns])[:2]


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Oh."), (1, 2, "assistant", "Yes.")]
    out = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select(F.inline("edits")).collect()
    assert [(r["edit"], r["role"], r["text"]) for r in out] == [("K", "user", "Hi."), ("I", "assistant", ""), ("K", "user", "Oh."), ("K", "assistant", "Yes.")]
