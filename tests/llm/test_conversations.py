"""Conversation repair against a search over edit strings."""

import hashlib
import random
import re
import zlib

import pytest

from docloom.llm import base, conversations, queries

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(faults):
    """Least (cost, audit, roles) over all edits, by a table of states from the front: whole strings are compared."""
    at = {"": (0, "", ())}  # what the grammar has seen: "", s, u, a
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    def put(table, state, way):
        if state not in table or way < table[state]:
            table[state] = way

    def inserted(table):
        for _ in range(4):
            for state, (cost, audit, roles) in list(table.items()):
                for i in follows[state]:
                    if i != "s":
                        put(table, i, (cost + 2, audit + "I", (*roles, (i, None))))
        return table

    at = inserted(at)
    for n, (initial, fault) in enumerate(faults):
        nxt = {}
        for state, (cost, audit, roles) in at.items():
            put(nxt, state, (cost + 3, audit + "D", roles))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            for i in follows[state]:
                if initial == i:
                    put(nxt, i, (cost + more, audit + "K", (*roles, (i, n))))
                elif i != "s":
                    put(nxt, i, (cost + 2 + more, audit + "R", (*roles, (i, n))))
        at = inserted(nxt)
    return min(v for k, v in at.items() if k in ("", "a"))


def brute(rows, every):
    out = {}
    groups = {c: [] for c in every}
    for r in rows:
        groups[r[0]].append(r)
    for conv, turns in groups.items():
        same = lambda r: hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).hexdigest()
        turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), same(r)))
        seen, faults = set(), []
        for _, _, role, text in turns:
            body = text.strip(SPACES)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append((role[:1], fault))
        numbers = [t for _, t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(faults, faults[1:]))
        cost, audit, roles = cheapest(faults)
        names = {"u": "user", "a": "assistant"}
        lines = []
        for i, n in roles:
            role, text = ("", "") if n is None else turns[n][2:]
            lines.append((role if role[:1] == i else names[i]) + ":" + text)
        count = lambda f: sum(x == f for _, x in faults)
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_dict(df):
    rows = df.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


def test_query_on_whole_table(spark):
    rows = [tuple(r) for r in base.table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = as_dict(queries.QUERIES["op11_dawg_repair"](spark, SF))
    assert got == brute(damaged(rows), {r[0] for r in rows})


SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING, cost STRING, word INT, `_g` STRING"


@pytest.mark.parametrize("word", [conversations.WORD, 3])
def test_random_conversations(spark, monkeypatch, word):
    """Short and long ones, ties of turns, nulls anywhere, odd roles; also with words that cut conversations."""
    monkeypatch.setattr(conversations, "WORD", word)
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.choice([0, 1, 2, 5, 9, 40])):
            rows.append((conv, rng.choice([None, *range(30)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Uno"]),
                         rng.choice(["a.", "b", "c! ", "", " \n", None, "d?", "e ", "f" * 50, "g."]), "x", 1, "y"))
    rows += [(99, t, "user" if t % 2 else "assistant", f"text {t % 50}.", "x", 1, "y") for t in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = as_dict(conversations.repair(conversations.damage(df), every=df))
    assert got == brute(damaged([r[:4] for r in rows]), {r[0] for r in rows})


def test_small_cases(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi."), (1, 1, "assistant", "yo."), (2, 5, "assistant", "yo"), (3, None, "user", " ")], "conv_id LONG, turn LONG, role STRING, text STRING")
    got = as_dict(conversations.repair(df))
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1] == (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:hi.\nassistant:yo.").hexdigest())
    assert got[2] == (0, 0, 0, 1, 0, 3, "D", empty)  # as cheap as an inserted user before it; D is less than I
    assert got[3] == (0, 1, 0, 0, 0, 3, "D", empty)
    assert as_dict(conversations.repair(df.limit(0), every=df)) == {i: (0, 0, 0, 0, 0, 0, "", empty) for i in (1, 2, 3)}
    assert as_dict(conversations.repair(df.limit(0))) == {}
