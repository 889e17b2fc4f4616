"""Repair of conversations against a search over whole edit scripts."""

import hashlib
import random
import re
import zlib
from functools import cache

from filetrail.llm import turns
from filetrail.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
NAMES = {"u": "user", "a": "assistant"}
FOLLOWING = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
COLUMNS = "conv_id long, turn long, role string, text string"


def damaged(rows):
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * ((kind != 0) + (kind == 3))
    return convs


def cheapest(rows, faults):
    """Least (cost, audit, repaired rows) over all scripts."""
    @cache
    def best(i, last, inserted):
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []

        def add(cost, edit, i, last, inserted, row):
            more = best(i, last, inserted)
            if more:
                found.append((cost + more[0], edit + more[1], row + more[2]))

        legal = [r for r in "sua" if (last, r) in FOLLOWING]
        for r in legal:
            if r != "s" and inserted < 4:
                add(5, "I", i, r, inserted + 1, ((NAMES[r], ""),))
        if i < len(rows):
            add(2, "D", i + 1, last, 0, ())
            if faults[i] not in ("blank", "duplicate"):
                extra, (_, role, text) = 5 * (faults[i] == "truncated"), rows[i]
                if role[:1] in legal:
                    add(extra, "K", i + 1, role[:1], 0, ((role, text),))
                for r in legal:
                    if r != "s":
                        add(1 + extra, "R", i + 1, r, 0, ((NAMES[r], text),))
        return min(found) if found else None
    return best(0, "", 0)


def brute(rows):
    out = []
    for conv, mine in damaged(rows).items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        numbers, faults, seen = {t for t, _, _ in mine if t is not None}, [], set()
        for _, role, text in mine:
            bare = text.strip(" \t\n\x0b\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:], strict=False)]
        cost, audit, kept = cheapest(mine, faults)
        out.append((conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(f) for f in (
            "blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return sorted(out, key=str)


def repaired(df):
    return sorted((tuple(r) for r in turns.repair(turns.damage(df)).collect()), key=str)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_turn_repair"](spark, SF_DIR).collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    draw = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "über"]
    texts = ["Hi.", "", " \t", "no end", "Ok! \n", None, "x? ", " ", "mid. dle"]
    rows = [(c, draw.choice([None, 1, 2, 3, 5, 6, 7, 9, 11, -4]), draw.choice(roles), draw.choice(texts))
            for c in [None, -1, *range(200)] for _ in range(draw.randrange(1, 12))]
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' as digest", "1 as kind", "true as dropped", "2 as cost")
    assert repaired(df) == brute(rows)


def test_long_conversation_and_shared_suffixes(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(6000)]
    rows += [(c, t, "user" if t != c else "tool", "Same.") for c in range(2, 300) for t in range(4)]
    got = {r[0]: r for r in repaired(spark.createDataFrame(rows, COLUMNS).repartition(7))}
    expected = {r[0]: r for r in brute([r for r in rows if r[0] > 1])}
    assert {c: r for c, r in got.items() if c > 1} == expected
    head = brute([r for r in rows if r[0] == 1 and r[1] < 80])[0]
    assert got[1][7].startswith(head[7][:70]) and len(got[1][7]) > 5500


def test_no_rows_left_and_empty_table(spark):
    conv = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "Hi."), (conv, 0, "assistant", "Ok.")], COLUMNS)
    assert repaired(df) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repaired(df.limit(0)) == []


def test_nodes_are_shared():
    automaton = turns.Automaton()
    draw, alphabet = random.Random(3), "suaoSUAOx"
    for _ in range(2000):
        node = automaton.end
        for _ in range(30):
            node, _ = automaton.before(draw.choice(alphabet), node)
    assert len(automaton.tables) < 400
