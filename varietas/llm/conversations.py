"""Conversation structure repair: the cheapest edits that make a conversation ``(s?(ua)+)?``, by Hirschberg.

*Model.*  Reading a conversation's rows in order, the repaired roles are in one of four states: nothing yet,
a system turn, a user turn, an assistant turn (the first and the last may end it).  A row is kept (0, when
its role fits), given the fitting role user/assistant (3), or deleted (4, the only way for blank and
duplicate rows); a turn with empty text may be inserted anywhere (3); a truncated row that is not deleted
adds 3.  A state and a letter (Delete, Insert, Keep, Rerole) fix the next state, so the string of letters,
the audit, fixes the repair.

*Method.*  A forward vector holds for each state the least cost of the rows up to a point, just behind a
row's own letter, and the order of the least audits that lead there: such audits hold equally many row
letters and end in one, so none begins another and their order is settled whatever follows.  A backward
vector holds the least cost to the end.  Where the two meet, the state of least total, and of these the
first in audit order, is on the audit-least optimal path; both halves are then solved alone, which needs
only vectors, never a table of all points (:func:`crossings`).

*Spark.*  Damaged rows are range-sorted by (conversation, turn, role, text) and stored with their place;
blocks of at most ``2 ** BLOCK_BITS`` places are solved in one cogroup with the first places of every
(conversation, role, text), so no task holds a whole conversation or all copies of a turn.  Conversations
inside a block are finished there.  The piece at either edge of a block becomes a four by four table of
costs and orders; pieces of a conversation are folded ``2 ** FAN_BITS`` at a time, and on the way back each
fold is split by the same meeting of forward and backward vectors, down to the rows.

Defined results: nulls in role and text are one space; rows come by turn (nulls first), ties by role, then
text; a null conversation id is a conversation; a conversation without rows has zeros, an empty audit and no
parts; repeated rows are rows (their texts make them duplicates); an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.llm.common import WHITE, store
from varietas.operators.rows import with_row_index

BLOCK_BITS, FAN_BITS = 9, 6
NONE = 1 << 40
#: State behind the fitting user or assistant turn: from nothing, system, user, assistant.
FITTING = (2, 2, 3, 2)
#: Least cost and letters from a state to an allowed end.
CLOSING = ((0, ""), (6, "II"), (3, "I"), (0, ""))
ROLE = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


@cache
def steps(kind: str) -> tuple:
    """For each state: {next state: (cost, letters)} of one row of a kind, inserted turns before it included.

    A kind is an initial (s, u, a or -) and a fault (``.`` none, ``x`` must go, ``t`` truncated).
    """
    initial, fault = kind
    extra = 3 if fault == "t" else 0
    out = []
    for state in range(4):
        best: dict = {}
        at = state
        for inserted in range(3):
            options = [(at, 4, "D")]
            if fault != "x":
                if (kept := KEEPS.get(initial, {}).get(at)) is not None:
                    options.append((kept, extra, "K"))
                options.append((FITTING[at], 3 + extra, "R"))
            for to, cost, letter in options:
                entry = (cost + 3 * inserted, "I" * inserted + letter)
                best[to] = min(best.get(to, (NONE, "")), entry)
            at = FITTING[at]
        out.append(best)
    return tuple(out)


def _ahead(vector: dict, table) -> dict:
    """Forward vector {state: (cost, order)} carried over one table of steps."""
    best: dict = {}
    for state, (cost, order) in vector.items():
        for to, (more, key) in table[state].items():
            entry = (cost + more, order, key)
            if to not in best or entry < best[to]:
                best[to] = entry
    ranked = sorted(best, key=lambda to: best[to][1:])
    return {to: (best[to][0], i) for i, to in enumerate(ranked)}


def _back(costs: dict, table) -> dict:
    """Least cost to the end, one table of steps earlier."""
    out = {}
    for state in range(4):
        reach = [more + costs[to] for to, (more, _) in table[state].items() if to in costs]
        if reach:
            out[state] = min(reach)
    return out


def crossings(tables: list, start: int, end: int) -> list[int]:
    """States of the audit-least cheapest path from ``start`` to ``end`` behind every table, in linear space."""
    path = [0] * len(tables)
    todo = [(0, len(tables), start, end)]
    while todo:
        lo, hi, first, last = todo.pop()
        if hi <= lo:
            continue
        if hi - lo == 1:
            path[lo] = last
            continue
        mid = (lo + hi) // 2
        forward, backward = {first: (0, 0)}, {last: 0}
        for table in tables[lo:mid]:
            forward = _ahead(forward, table)
        for table in reversed(tables[mid:hi]):
            backward = _back(backward, table)
        meet = min((s for s in forward if s in backward), key=lambda s: (forward[s][0] + backward[s], forward[s][1]))
        todo += [(lo, mid, first, meet), (mid, hi, meet, last)]
    return path


def fold(tables: list) -> list[dict]:
    """One table for a run of tables: for each state {next state: (cost, order of the least audits)}."""
    out = []
    for state in range(4):
        vector = {state: (0, 0)}
        for table in tables:
            vector = _ahead(vector, table)
        out.append(vector)
    return out


def last_state(table) -> tuple[int, int]:
    """(cost, state behind the last row) of the audit-least cheapest path of a folded conversation."""
    total, _, state = min((cost + CLOSING[s][0], order, s) for s, (cost, order) in table[0].items())
    return total, state


def apply_edits(rows: list[tuple[str, str, str]], path: list[int], start: int, close: bool) -> tuple[str, str]:
    """(audit, newline-joined repaired lines) of (kind, role, text) rows along a path of states."""
    audit, lines, state = [], [], start
    for (kind, role, text), to in zip(rows, path):
        letters = steps(kind)[state][to][1]
        audit.append(letters)
        for letter in letters:
            if letter == "K":
                lines.append(f"{role}:{text}")
            elif letter in "IR":
                state = FITTING[state]
                lines.append(f"{ROLE[state]}:{text if letter == 'R' else ''}")
        state = to
    if close:
        audit.append(CLOSING[state][1])
        for _ in CLOSING[state][1]:
            state = FITTING[state]
            lines.append(f"{ROLE[state]}:")
    return "".join(audit), "\n".join(lines)


def kind_of(role: str, text: str, repeated: bool) -> tuple[str, str]:
    """(kind of the row, its first fault: blank, duplicate, truncated or nothing)."""
    initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
    words = text.strip(WHITE)
    if not words:
        return initial + "x", "blank"
    if repeated:
        return initial + "x", "duplicate"
    if words[-1] not in ".!?":
        return initial + "t", "truncated"
    return initial + ".", ""


FAULTS = ("blank", "duplicate", "truncated")


def _piece(rows: list[tuple[str, str]], repeated: list[bool]) -> dict:
    """Kinds and counts of a run of one conversation's (role, text) rows."""
    kinds, faults = zip(*(kind_of(role, text, again) for (role, text), again in zip(rows, repeated)))
    initials = [role[:1] for role, _ in rows]
    return {"kinds": list(kinds), "first": initials[0], "last": initials[-1],
            **{f: faults.count(f) for f in FAULTS},
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))}


def _flat(table: list[dict]) -> list[int]:
    """A folded table as 32 integers (cost and order, or -1 and 0 where a state is not reached)."""
    return [v for row in table for to in range(4) for v in row.get(to, (-1, 0))]


def _table(flat: list[int]) -> list[dict]:
    return [{to: (flat[8 * s + 2 * to], flat[8 * s + 2 * to + 1]) for to in range(4) if flat[8 * s + 2 * to] >= 0}
            for s in range(4)]


_COUNTS = "blank long, duplicate long, truncated long, illegal long"


def damage(turns: DataFrame) -> DataFrame:
    """The query's damage by crc32(``conv_id:turn``) mod 20 (nulls: one space): 0 drops the row, 1 empties its text,
    2 removes its ``.!?``, 3 repeats it, 4 makes it a user turn."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    out = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                       (F.crc32(key.cast("binary")) % 20).alias("_d")).where("_d <> 0")
    d = F.col("_d")
    out = out.select("conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"),
                     F.when(d == 1, "").when(d == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                     F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return out.drop("_copy")


def _solve_blocks(rows: DataFrame) -> DataFrame:
    """Stored pieces of conversations: finished ones with cost, audit and text, those at block edges with their table."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    firsts = rows.groupBy("conv_id", "role", F.md5(F.col("text").cast("binary"))).agg(F.min("place").alias("place"))
    block = F.shiftright("place", BLOCK_BITS)
    schema = (f"conv_id {conv}, place long, finished boolean, first string, last string, {_COUNTS}, cost long, audit string, "
              "part string, tables array<long>, kinds array<string>, roles array<string>, texts array<string>")

    out_schema = _arrow(schema)

    def solve(left, right):
        left = left.sort_by("place")
        convs, places, roles, texts = (left.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))
        first = set(right.column("place").to_pylist())
        out, lo, n = [], 0, len(convs)
        while lo < n:
            hi = lo + 1
            while hi < n and convs[hi] == convs[lo]:
                hi += 1
            rows_ = list(zip(roles[lo:hi], texts[lo:hi]))
            piece = _piece(rows_, [p not in first for p in places[lo:hi]])
            kinds = piece.pop("kinds")
            tables = [steps(k) for k in kinds]
            piece |= {"conv_id": convs[lo], "place": places[lo], "finished": lo > 0 and hi < n}
            if piece["finished"]:
                piece["cost"], end = last_state(fold_from(tables, 0))
                piece["audit"], piece["part"] = apply_edits(
                    [(k, r, t) for k, (r, t) in zip(kinds, rows_)], crossings(tables, 0, end), 0, True)
            else:
                piece |= {"tables": _flat(fold(tables)), "kinds": kinds, "roles": roles[lo:hi], "texts": texts[lo:hi]}
            out.append(piece)
            lo = hi
        return pa.Table.from_pylist(out, schema=out_schema)

    grouped = rows.withColumn("_block", block).groupBy("_block").cogroup(firsts.select("place").withColumn("_block", block).groupBy("_block"))
    return store(grouped.applyInArrow(solve, schema))


def fold_from(tables: list, state: int) -> list[dict]:
    """:func:`fold` from one state only."""
    vector = {state: (0, 0)}
    for table in tables:
        vector = _ahead(vector, table)
    return [vector if s == state else {} for s in range(4)]


def _arrow(ddl: str) -> pa.Schema:
    """Arrow schema of a Spark DDL (on the driver)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


_PLAIN = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _plain(ddl: str) -> pa.Schema:
    """Arrow schema of a DDL of plain types (in tasks)."""
    return pa.schema([pa.field(name, _PLAIN[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


_NODE = f"head long, r long, first string, last string, {_COUNTS}, tables array<long>"


def _fold_group(key, table):
    nodes = table.sort_by("r").to_pylist()
    node = {"head": nodes[0]["head"], "r": key[1].as_py(), "first": nodes[0]["first"], "last": nodes[-1]["last"],
            "tables": _flat(fold([_table(x["tables"]) for x in nodes]))}
    for c in (*FAULTS, "illegal"):
        node[c] = sum(x[c] for x in nodes)
    node["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(nodes, nodes[1:]))
    return pa.Table.from_pylist([node], schema=_plain(_NODE))


_STATES = "head long, r long, start int, stop int"


def _split_group(key, table):
    nodes = table.sort_by("r").to_pylist()
    path = crossings([_table(x["tables"]) for x in nodes], nodes[0]["start"], nodes[0]["stop"])
    starts = [nodes[0]["start"], *path]
    return pa.Table.from_pylist([{"head": x["head"], "r": x["r"], "start": s, "stop": t} for x, s, t in zip(nodes, starts, path)],
                                schema=_plain(_STATES))


def _top(batches):
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            x["cost"], x["stop"] = last_state(_table(x.pop("tables")))
            out.append(x | {"start": 0})
        yield pa.RecordBatch.from_pylist(out, schema=_plain(_TOP))


_TOP = f"head long, r long, first string, last string, {_COUNTS}, cost long, start int, stop int"


def _join_pieces(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversation rows, parts) of the conversations with pieces at block edges."""
    conv = pieces.schema["conv_id"].dataType.simpleString()
    numbered = store(with_row_index(pieces.select("conv_id", "place", "first", "last", *FAULTS, "illegal", "tables"), ["place"], "_g"))
    heads = numbered.groupBy("conv_id").agg(F.min("_g").alias("head"), F.count(F.lit(1)).alias("_n"))
    level = numbered.withColumnRenamed("conv_id", "_c").join(heads, F.col("_c").eqNullSafe(F.col("conv_id"))) \
        .select("conv_id", "place", "head", (F.col("_g") - F.col("head")).alias("r"), "_n", "first", "last", *FAULTS, "illegal", "tables")
    level = store(level)
    leaves = level.select("conv_id", "place", "head", "r", "_n")
    longest = level.agg(F.max("_n")).first()[0] or 0
    levels = [level.select("head", "r", "first", "last", *FAULTS, "illegal", "tables")]
    while longest > 1:
        up = levels[-1].withColumn("_u", F.shiftright("r", FAN_BITS)).groupBy("head", "_u").applyInArrow(_fold_group, _NODE)
        levels.append(store(up))
        longest = (longest + (1 << FAN_BITS) - 1) >> FAN_BITS
    top = store(levels[-1].mapInArrow(_top, _TOP))
    states = top.select("head", "r", "start", "stop")
    for below in reversed(levels[:-1]):
        parents = states.select("head", F.col("r").alias("_u"), "start", "stop")
        children = below.select("head", "r", "tables", F.shiftright("r", FAN_BITS).alias("_u"))
        states = store(children.join(parents, ["head", "_u"]).groupBy("head", "_u").applyInArrow(_split_group, _STATES))

    parts_schema = f"conv_id {conv}, head long, place long, whole boolean, audit string, part string"
    edited = _arrow(parts_schema)

    def edit(batches):
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                rows = list(zip(x["kinds"], x["roles"], x["texts"]))
                path = crossings([steps(k) for k in x["kinds"]], x["start"], x["stop"])
                audit, part = apply_edits(rows, path, x["start"], x["r"] == x["_n"] - 1)
                out.append({"conv_id": x["conv_id"], "head": x["head"], "place": x["place"], "whole": x["_n"] == 1, "audit": audit, "part": part})
            yield pa.RecordBatch.from_pylist(out, schema=edited)

    work = pieces.select("place", "kinds", "roles", "texts").join(leaves.join(states, ["head", "r"]), "place")
    parts = store(work.mapInArrow(edit, parts_schema))
    audits = parts.groupBy("head").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("place", "audit"))).alias("_a"))
    audits = audits.select("head", "conv_id", F.array_join(F.transform("_a", lambda x: x["audit"]), "").alias("audit"))
    return top.join(audits, "head").select("conv_id", *FAULTS, "illegal", "cost", "audit"), parts.drop("head", "audit")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair (conv_id, turn, role, text) rows: (report, parts).

    The report has a row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit.  The repaired
    text of a conversation is its parts (conv_id, place, whole, part), in order of place, joined by newlines;
    empty parts are left out.  Most conversations are one part (``whole``).
    """
    order = ["conv_id", "turn", "role"]
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    rows = store(rows.withColumn("place", F.monotonically_increasing_id()))
    pieces = _solve_blocks(rows)
    done = pieces.where("finished").select("conv_id", *FAULTS, "illegal", "cost", "audit")
    edges, edge_parts = _join_pieces(pieces.where("not finished"))
    gaps = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    solved = done.unionByName(edges).withColumn("gaps", F.lit(0).cast("long"))
    for c in (*FAULTS, "illegal", "cost"):
        gaps = gaps.withColumn(c, F.lit(0).cast("long"))
    report = solved.unionByName(gaps.withColumn("audit", F.lit("")))
    parts = pieces.where("finished").select("conv_id", "place", F.lit(True).alias("whole"), "part").unionByName(edge_parts)
    return report.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in ("gaps", *FAULTS, "illegal", "cost", "audit")]), parts


def hash_parts(parts: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the parts.  A conversation of several parts is hashed part by part in one
    task, whose memory holds one part (a running hash cannot be split)."""
    conv = parts.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, repaired_sha256 string"
    hashed = _arrow(schema)
    whole = parts.where("whole").select("conv_id", F.sha2(F.col("part").cast("binary"), 256).alias("repaired_sha256"))

    def run(batches):
        current, digest, seen, convs, out = None, None, False, [], []
        for batch in batches:
            for conv_id, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest is None or conv_id != current:
                    if digest is not None:
                        convs.append(current)
                        out.append(digest.hexdigest())
                    current, digest, seen = conv_id, hashlib.sha256(), False
                if part:
                    digest.update((("\n" if seen else "") + part).encode())
                    seen = True
        if digest is not None:
            convs.append(current)
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(convs, hashed.field(0).type), pa.array(out, pa.string())], schema=hashed)

    several = parts.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "part")
    return whole.unionByName(several.mapInArrow(run, schema))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damage, repair and digest: one row per original conversation id."""
    report, parts = repair(damage(conversations))
    counts = ["gaps", *FAULTS, "illegal", "cost"]
    empty = hashlib.sha256(b"").hexdigest()
    everyone = conversations.select("conv_id").distinct().select(
        "conv_id", *[F.lit(0).cast("long").alias(c) for c in counts], F.lit("").alias("audit"), F.lit(None).cast("string").alias("repaired_sha256"))
    hashes = hash_parts(parts).select("conv_id", *[F.lit(0).cast("long").alias(c) for c in counts], F.lit("").alias("audit"), "repaired_sha256")
    out = everyone.unionByName(report.withColumn("repaired_sha256", F.lit(None).cast("string"))).unionByName(hashes)
    out = out.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in (*counts, "audit", "repaired_sha256")])
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(empty)))
