"""Conversation repair against a search over all edits, in one piece and in blocks."""

import hashlib
import heapq
import random

import numpy as np
import pytest

from tempestry.llm import repairs
from tempestry.llm.repairs import RepairParams

SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired) by a search in the order of (cost, audit) over (role initial, fault, role, text)."""
    after = {"": {"s": "system", "u": "user"}, "s": {"u": "user"}, "u": {"a": "assistant"}, "a": {"u": "user"}}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(out)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        for c, name in after[last].items():
            if name != "system":
                heapq.heappush(heap, (cost + 2, audit + "I", i, c, (*out, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] in after[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
                for c, name in after[last].items():
                    if name != "system":
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, c, (*out, f"{name}:{text}")))


def expected(rows):
    """Per conv_id the result of (conv_id, turn, role, text, gone) rows."""
    groups = {}
    for conv, turn, role, text, gone in rows:
        groups.setdefault(conv, [])
        if not gone:
            groups[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv, said in groups.items():
        said.sort()
        seen, judged = set(), []
        for _, _, role, text in said:
            fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = {t for known, t, _, _ in said if known}
        initials = [r[:1] for r, _, _ in judged]
        cost, audit, text = cheapest(judged)
        count = [sum(f == kind for _, _, f in judged) for kind in ("blank", "duplicate", "truncated")]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def conversations(seed, n, most):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for _ in range(rng.randrange(1, most)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "superuser", " "])
            text = rng.choice(["Yes.", "No!", "why", " ", "", "é?\n", "cut off ", f"text {rng.randrange(9)}.", "so. "])
            rows.append((conv, rng.choice([None, *range(most)]), role, text, rng.random() < 0.1))
    return rows


COLUMNS = "conv_id long, turn int, role string, text string, gone boolean"


@pytest.mark.parametrize("params", [RepairParams(), RepairParams(row_limit=3, block=4), RepairParams(row_limit=6, block=2)])
def test_against_search(spark, params):
    rows = conversations(7, 40, 14)
    rows += [rows[0]] * 5  # repeated rows
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = repairs.repaired(spark.createDataFrame(rows, COLUMNS).repartition(3), params).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_all_rows_gone_and_no_rows(spark):
    rows = [(1, 0, "user", "a.", True), (1, 1, "user", "b.", True), (2, 0, "user", "a.", False)]
    empty = hashlib.sha256(b"").hexdigest()
    for params in (RepairParams(), RepairParams(row_limit=1)):
        got = {r.conv_id: tuple(r)[1:] for r in repairs.repaired(spark.createDataFrame(rows, COLUMNS), params).collect()}
        assert got[1] == (0, 0, 0, 0, 0, 0, "", empty)
        assert got[2][5:7] == (2, "KI")
    assert repairs.repaired(spark.createDataFrame([], COLUMNS)).count() == 0


def test_damage(spark):
    import zlib

    rows = [(c, t, None if c == 3 else "assistant", None if t == 2 else f"Is it {t}? Yes!") for c in (None, *range(1, 60)) for t in (None, *range(5))]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, GONE string")
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.replace("?", "").replace("!", "") if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
    got = [tuple(r) for r in repairs.damaged(turns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {tuple(r)[0]: tuple(r)[1:] for r in repairs.repaired(repairs.damaged(turns)).collect()} == expected(want)


def test_ranks_order_nodes_by_their_audits():
    rng = np.random.default_rng(3)
    sizes = np.array([0, 1, 5, 9, 2])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    role, fault = rng.integers(0, 4, starts[-1]), rng.integers(0, 4, starts[-1])
    p = RepairParams()
    cost = repairs.cost_to_go(role, fault, starts, np.tile(repairs.last_costs(p), (5, 1)), p)
    edit, to = repairs.successors(role, fault, starts, cost, True, p)
    rank, jumps = repairs.ranked(edit, to)

    def audit(node):
        out = ""
        while edit[node]:
            out += " DIKR"[edit[node]]
            node = to[node]
        return out

    said = [audit(v) for v in range(len(edit))]
    for a in range(len(said)):
        for b in range(len(said)):
            assert (rank[a] < rank[b]) == (said[a] < said[b])
    nodes, bounds = repairs.paths(edit, jumps, np.arange(len(edit)))
    assert [len(s) for s in said] == np.diff(bounds).tolist()


def test_very_long_texts_and_conversation(spark):
    long = "word " * 100_000
    rows = [(1, 0, "user", long + ".", False), (1, 1, "assistant", long, False), (1, 2, "user", long, False), (1, 3, "user", long + ".", False)]
    rows += [(2, t, ("user", "assistant")[t % 2], f"turn {t}.", False) for t in range(3000)]
    want = expected(rows)
    for params in (RepairParams(), RepairParams(row_limit=2, block=512)):
        got = {r.conv_id: tuple(r)[1:] for r in repairs.repaired(spark.createDataFrame(rows, COLUMNS), params).collect()}
        assert got == want
