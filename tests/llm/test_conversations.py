"""Repair of conversations against a plain search over all edits, and the SQL on odd rows."""

import hashlib
import random
import zlib

import duckdb
import pytest

from wingtally.llm import conversations as cv


def plain(turns):
    """Least cost, least audit and repaired lines by states and cheapest scripts from the end; turns: (initial, fault, role, text)."""
    after = {"0": {"s": "1", "u": "2"}, "1": {"u": "2"}, "2": {"a": "3"}, "3": {"u": "2"}}
    names = {"u": "user", "a": "assistant"}

    def put(best):
        for _ in range(3):
            for q, ways in after.items():
                for r in "ua":
                    if r in ways and ways[r] in best:
                        c, a, t = best[ways[r]]
                        best[q] = min(best.get(q, (c + 5, "I" + a, [names[r] + ":"] + t)), (c + 5, "I" + a, [names[r] + ":"] + t))
        return best

    best = put({"0": (0, "", []), "3": (0, "", [])})
    for initial, fault, role, text in reversed(turns):
        now, extra = {}, 5 * (fault == "t")
        for q, ways in after.items():
            every = []
            if q in best:
                c, a, t = best[q]
                every.append((c + 2, "D" + a, t))
            if fault not in ("b", "d"):
                for r, to in ways.items():
                    c, a, t = best[to]
                    if r == initial:
                        every.append((c + extra, "K" + a, [f"{role}:{text}"] + t))
                    if r in names:
                        every.append((c + 1 + extra, "R" + a, [f"{names[r]}:{text}"] + t))
            now[q] = min(every)
        best = put(now)
    return best["0"]


def expected(rows):
    """All columns of the report, from the rows after damage of one conversation in order."""
    seen, turns = set(), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault = "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        turns.append((role[:1], fault, role, text))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    pairs = [a[0] + b[0] for a, b in zip(turns, turns[1:])]
    cost, audit, lines = plain(turns)
    faults = [t[1] for t in turns]
    return (gaps, *(faults.count(f) for f in "bdt"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_layers_equal_a_plain_search():
    draw, layers = random.Random(5), cv.Layers()
    for size in [*range(9)] * 60 + [200, 1500]:
        turns = [(draw.choice("sssuuuuaaaa-"), draw.choice(["", "", "", "", "b", "d", "t"])) for _ in range(size)]
        kinds = bytes(4 * "sua-".index(r) + ["", "b", "d", "t"].index(f) for r, f in turns)
        cost, audit, steps = layers.repair(kinds)
        assert (cost, audit) == plain([(r, f, r, "x") for r, f in turns])[:2]
        assert len(steps) == size + 1 and "".join(steps).translate(str.maketrans("uaUA", "IIRR")) == audit


@pytest.fixture(scope="module")
def odd_rows(spark):
    draw = random.Random(2)
    rows = [(7, None, "user", "Hi."), (7, None, "assistant", "Yes."), (None, 1, "system", "Be."), (None, 2, "user", "Go?"), (None, 3, "assistant", "No!"), (3, 1, None, "a."), (3, 2, "user", None), (3, 2, "user", "b."), (3, 2, "assistant", "b.")]
    rows += [(8, 5, "user", "Same."), (8, 5, "user", "Same."), (9, 0, "tool", "x "), (9, 1, "", "y."), (9, 2, "süd", "z!\x0b"), (10, 0, "user", "w " * 100_000 + "."), (10, 1, "assistant", "ok .")]
    rows += [(11, t, draw.choice(["user", "assistant", "system"]), draw.choice(["One.", "Two!", "three", "", f"Own {t}."])) for t in range(9000)]
    for conv in range(20, 120):
        rows += [(conv, t, draw.choice(["user", "assistant", "user", "assistant", "system", "tool"]), draw.choice([f"T {t}.", "Yes.", "cut off", " "])) for t in range(draw.randint(0, 12))]
    return spark.createDataFrame([r + ("x", 1) for r in rows], "conv_id long, turn long, role string, text string, at string, cost int")


def damaged_plainly(rows):
    out = {}
    for r in rows:
        conv, turn, role, text = r["conv_id"], r["turn"], r["role"], r["text"]
        name = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        here = out.setdefault(conv, [])
        if fault:
            text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
            here += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return {c: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, rows in out.items()}


def test_report_on_odd_rows(spark, odd_rows):
    got = cv.report(cv.damaged(odd_rows), odd_rows)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r[0]: tuple(r[1:]) for r in got.collect()}
    want = {c: expected(rows) if rows else (0,) * 6 + ("", hashlib.sha256().hexdigest()) for c, rows in damaged_plainly(odd_rows.collect()).items()}
    assert got == want
    assert cv.report(cv.damaged(odd_rows.where("false")), odd_rows.where("false")).count() == 0


def test_sql_on_odd_rows(odd_rows):
    conversations = odd_rows.where("conv_id is null or conv_id <> 11").toPandas()
    conversations["conv_id"], conversations["turn"] = conversations["conv_id"].astype("Int64"), conversations["turn"].astype("Int64")
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = {c: expected(rows) if rows else (0,) * 6 + ("", hashlib.sha256().hexdigest()) for c, rows in damaged_plainly(odd_rows.where("conv_id is null or conv_id <> 11").collect()).items()}
    assert {r[0]: tuple(r[1:]) for r in con.sql(cv.ORACLE).fetchall()} == want


def test_string_ids_and_repair_alone(spark):
    rows = spark.createDataFrame([("a", 1, "user", "One."), ("a", 2, "user", "Two."), ("b", 1, "assistant", "Three.")], "conv_id string, turn int, role string, text string")
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in cv.report(rows, rows).collect()}
    assert got == {"a": (1, "KR"), "b": (2, "D")}
