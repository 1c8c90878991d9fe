import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest

from varietas.llm import conversations as C
from varietas.llm.oracle import REPAIR

SCHEMA = "conv_id long, turn long, role string, text string, extra string, place string, head int"


def damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d:
            row = (turn, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)
            out += [(conv, *row)] * (2 if d == 3 else 1)
    return out


def cheapest(kinds):
    """Least (cost, audit, lines) over all edit sequences, straight from the rules."""
    fit = {0: "user", 1: "user", 2: "assistant", 3: "user"}

    @lru_cache(None)
    def best(i, state, inserts):
        options = []
        if i == len(kinds):
            if state in (0, 3):
                options.append((0, "", ()))
        else:
            role, text, fault = kinds[i]
            c, a, t = best(i + 1, state, 0)
            options.append((c + 4, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(state)
                if to is not None:
                    c, a, t = best(i + 1, to, 0)
                    options.append((c + more, "K" + a, (f"{role}:{text}", *t)))
                c, a, t = best(i + 1, 3 if state == 2 else 2, 0)
                options.append((c + 3 + more, "R" + a, (f"{fit[state]}:{text}", *t)))
        if inserts < 3:
            c, a, t = best(i, 3 if state == 2 else 2, inserts + 1)
            options.append((c + 3, "I" + a, (f"{fit[state]}:", *t)))
        return min(options, default=(10 ** 9, "", ()))
    return best(0, 0, 0)


def brute(rows):
    """The query's rows by brute force."""
    out = {}
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds = set(), []
        for _, role, text in mine:
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            kinds.append((role, text, fault))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [k[2] for k in kinds]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = cheapest(tuple(kinds))
        out[conv] = (gaps, *[faults.count(f) for f in C.FAULTS], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    got = C.repair_damaged(df).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def random_rows(seed, convs, turns):
    r = random.Random(seed)
    texts = ["Yes.", "No", "Why?", " ", "", "so it is.", "\t", None, "…", "a.\n", "user:x"]
    roles = ["user", "assistant", "system", "tool", "", None, "ua"]
    return [(c, None if r.random() < 0.05 else t, r.choices(roles, [6, 6, 1, 1, 0.3, 0.3, 0.3])[0], r.choice(texts) if r.random() < 0.5 else f"text {t}.")
            for c in [None, *range(convs)] for t in range(r.randint(1, turns))]


def test_edits_equal_brute_force(spark):
    rows = random_rows(1, 150, 9)
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_conversations_over_many_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(C, "BLOCK_BITS", 2)
    monkeypatch.setattr(C, "FAN_BITS", 1)
    rows = random_rows(seed, 6, 40) + random_rows(seed + 10, 0, 150)
    assert result(spark, rows) == brute(rows)


def test_ties_repeats_and_nothing_left(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    rows = [(gone, 1, "user", "all dropped.")] + [(7001, 3, "user", "same.")] * 5 + [(7001, 3, "assistant", "same.")] * 2
    rows += [(7002, None, None, None), (7003, None, "assistant", "late turn " * 5000)]
    got = result(spark, rows)
    assert got == brute(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.repair_damaged(df).collect() == []


def test_oracle_sql_equals_brute_force():
    rows = random_rows(5, 60, 7)
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in con.execute(REPAIR).fetchall()} == brute(rows)


def test_meeting_vectors_find_the_least_audit():
    r = random.Random(9)
    for _ in range(300):
        kinds = [r.choice("sua-") + r.choice("..xt") for _ in range(r.randint(1, 12))]
        tables = [C.steps(k) for k in kinds]
        cost, end = C.last_state(C.fold(tables))
        rows = [(k, {"s": "system", "u": "user", "a": "assistant", "-": "tool"}[k[0]], str(i)) for i, k in enumerate(kinds)]
        audit, text = C.apply_edits(rows, C.crossings(tables, 0, end), 0, True)
        fault = {".": "", "x": "blank", "t": "truncated"}
        assert (cost, audit, text) == (lambda b: (b[0], b[1], "\n".join(b[2])))(
            cheapest(tuple((role, t, fault[k[1]]) for k, role, t in rows)))
