"""Conversation repair against all edit sequences of small conversations, and whole strings on the table."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from compare import DATA

from spanloom.llm import queries, repair

SF = f"{DATA}/sf0.001"
LEGAL = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()


def faults(rows):
    """``blank``, ``duplicate``, ``truncated`` or None of each ``(turn, role, text)``."""
    out, seen = [], set()
    for _, role, text in rows:
        said = text.strip(WHITE)
        if not said:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append(None if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least ``(cost, audit)`` over edit sequences, best first, with the repaired rows."""
    fault = faults(rows)
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        if (audit, at) in done:
            continue
        done.add((audit, at))
        initials = "".join(r[0][:1] or "-" for r in out)
        if at == len(rows) and LEGAL.fullmatch(initials):
            best = [(cost, audit, out)]
            while heap and heap[0][0] == cost:  # all others of this cost
                c, a, i, o = heapq.heappop(heap)
                step(heap, rows, fault, c, a, i, o)
                if i == len(rows) and LEGAL.fullmatch("".join(r[0][:1] or "-" for r in o)):
                    best.append((c, a, o))
            return min(best, key=lambda b: b[1])
        step(heap, rows, fault, cost, audit, at, out)


def step(heap, rows, fault, cost, audit, at, out):
    last = out[-1][0][:1] if out else ""

    def may(role):
        return (last, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    for role in ("user", "assistant"):
        if may(role):
            heapq.heappush(heap, (cost + 5, audit + "I", at, (*out, (role, ""))))
    if at == len(rows):
        return
    _, role, text = rows[at]
    heapq.heappush(heap, (cost + 2, audit + "D", at + 1, out))
    if fault[at] in ("blank", "duplicate"):
        return
    more = 5 if fault[at] else 0
    if may(role):
        heapq.heappush(heap, (cost + more, audit + "K", at + 1, (*out, (role, text))))
    for other in ("user", "assistant"):
        if may(other):
            heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, (*out, (other, text))))


def strings(rows):
    """The same over places, with whole strings: for long conversations."""
    fault = faults(rows)
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    ways = {"": (0, "", ())}

    def offer(to, place, way):
        if place not in to or way[:2] < to[place][:2]:
            to[place] = way

    def inserted(ways):
        for _ in range(3):
            for place, (cost, audit, out) in list(ways.items()):
                for i in after[place]:
                    if i in names:
                        offer(ways, i, (cost + 5, audit + "I", (*out, (names[i], ""))))

    for (_, role, text), f in zip(rows, fault):
        inserted(ways)
        new = {}
        more = 5 if f else 0
        for place, (cost, audit, out) in ways.items():
            offer(new, place, (cost + 2, audit + "D", out))
            if f in ("blank", "duplicate"):
                continue
            if role[:1] and role[:1] in after[place]:
                offer(new, role[:1], (cost + more, audit + "K", (*out, (role, text))))
            for i in after[place]:
                if i in names:
                    offer(new, i, (cost + 1 + more, audit + "R", (*out, (names[i], text))))
        ways = new
    inserted(ways)
    return min((ways[p] for p in ("", "a") if p in ways), key=lambda w: w[:2])


def expected(rows, search=strings):
    """All columns but ``conv_id`` of one conversation's rows after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = search(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(found.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


def run(rows, prime=repair.PRIME):
    state = repair.Repair(prime)
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        state.row(*r)
    return state.result()


def drawn(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "u", "User"]
    texts = ["", " \t", "a.", "b!", "b", "c?", "d. ", "é", "e\x0b."]
    return [(rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(texts) + rng.choice(["", str(rng.random()) + "."])) for _ in range(n)]


def test_against_all_edits():
    rng = random.Random(1)
    for i in range(250):
        rows = drawn(rng, i % 7)
        assert run(rows) == expected(rows, cheapest) == expected(rows)


@pytest.mark.parametrize("prime", [repair.PRIME, 5, 2])
def test_long_and_colliding(prime):
    """Rolling hashes modulo 2 and 5 nearly always collide."""
    rng = random.Random(2)
    for n in (30, 80, 150):
        for _ in range(6):
            rows = drawn(rng, n)
            assert run(rows, prime) == expected(rows)
    tied = [(i, "assistant", f"{i}.") for i in range(400)]
    assert run(tied, prime) == expected(tied)


def test_audits_compare():
    rng = random.Random(3)
    for prime in (repair.PRIME, 3):
        audits, texts = repair.Audits(prime), [""]
        for _ in range(300):
            at = rng.randrange(len(texts))
            letter = rng.choice("DK")
            assert audits.longer(at, letter) == len(texts)
            texts.append(texts[at] + letter)
        for _ in range(3000):
            a, b = rng.randrange(len(texts)), rng.randrange(len(texts))
            assert audits.less(a, b) == (texts[a] < texts[b])
            assert audits.text(a) == texts[a]


def plain_damage(table):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        mine = convs[conv]
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        mine += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return {c: expected(r) for c, r in convs.items()}


def test_query(spark, duck):
    table = duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    df = queries.QUERIES["op12_structure_repair"](spark, SF)
    assert {r[0]: tuple(r[1:]) for r in df.collect()} == plain_damage(table)


def test_awkward_rows(spark):
    rows = [
        (None, None, None, None),
        (None, 3, "user", "a."),
        (1, None, "user", "x"),
        (1, None, "user", "x"),
        (1, 2, "assistant", "y."),
        (1, 2, "assistant", "y."),
        (1, 9, None, "z."),
        (2, 0, "user", ""),
        (3, 0, "user", "w " * 200_000 + "."),
        (4, None, None, ""),
        *((10 + i // 4, i % 4, "user" if i % 2 else "assistant", f"{i}?") for i in range(400)),
    ]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS kept", "2 AS fault", "3 AS times", "'x' AS audit")
    got = repair.repaired(repair.damaged(df.repartition(3))).collect()
    assert {r["conv_id"]: tuple(r[1:]) for r in got} == plain_damage(rows)
    assert len(got) == len({r[0] for r in rows})
    none = repair.repaired(repair.damaged(df.where("false")))
    assert none.isEmpty() and none.columns == got[0].__fields__
    dropped = spark.sql("SELECT 7L AS conv_id, 1L AS turn, 'user' AS role, 'a' AS text, false AS kept")
    assert tuple(repair.repaired(dropped).first()) == (7, 0, 0, 0, 0, 0, 0, "", EMPTY)
