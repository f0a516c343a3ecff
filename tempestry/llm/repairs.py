"""Repair of conversation structure: the cheapest edits that make a conversation `(s?(ua)+)?`, ties by the least audit.

A conversation's rows are slots; a node is a slot and what was said last (nothing, system, user, assistant).  Edits are
arcs: Keep and Rerole and Delete lead to the next slot, Insert to another node of the same one.  Of one node every edit
leads to one node, so an audit (the edits' initials) names one path.

1. Cost DP: from the last slot back, the cheapest way on from every node, for all conversations of a batch at once.
2. Optimal arcs, those that lose nothing, are kept, and of a node's the least initial: arcs differ in theirs, so this
   settles its successor.  Prefix doubling ranks the nodes by their audits of 1, 2, 4, ... initials (a rank is the place
   of the pair of ranks of half the length) and doubles the successors alike.
3. The least path is read through the doubled pointers: the node after k edits by the bits of k.

A conversation of up to `row_limit` rows is solved in one piece, many per batch.  A longer one is dealt by ranges of
turns and cut into blocks: each block gives the costs between its entry and exit states (4 x 4 numbers), these are
chained over blocks, and every block is then solved alone, for each state it may be entered in.  Only the digest of the
repaired text, which is sequential by nature, reads a conversation's kept texts in one task, as a stream.

Defined results: a null role or text is one space, as is a null id or turn in the damage hash; null turns come first;
rows of the same turn are ordered by role, then text; a null conv_id is a conversation of its own; repeated rows count
as often as they occur; a role counts by its first character; a very long text travels once and is read once; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.llm.common import stored

START, SYSTEM, USER, ASSISTANT = range(4)
#: What may be said next after each state, and the initials of the edits in their order.
NEXT = (USER, USER, ASSISTANT, USER)
END, DELETE, INSERT, KEEP, REROLE = range(5)
INITIALS = np.frombuffer(b" DIKR", np.uint8)
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 40
#: A row's role as a state (START: none of them) and its fault.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
VISIBLE = "[^\\x20\\x09-\\x0D]"
RESULT = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@dataclass(frozen=True)
class RepairParams:
    delete: int = 3
    insert: int = 2
    rerole: int = 2
    truncated: int = 1
    row_limit: int = 1 << 14
    block: int = 1 << 12


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of (conv_id, turn, role, text) after the contract's damage; a dropped row stays, with gone true."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))), F.lit(20))
    rows = turns.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(times).alias("copy")).drop("copy")


# ---- one batch of conversations ------------------------------------------------------------------------------------


def cost_to_go(role: np.ndarray, fault: np.ndarray, starts: np.ndarray, after: np.ndarray, p: RepairParams) -> np.ndarray:
    """[slot, state]: the cheapest way from there to the end of the piece.

    Piece k has rows starts[k] to starts[k + 1] and one slot more; after[k] is what its exit states cost.
    """
    sizes = np.diff(starts)
    first = starts[:-1] + np.arange(len(sizes))  # first slot of each piece
    cost = np.full((len(role) + len(sizes), 4), FAR, np.int64)
    cost[first + sizes] = after
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    many = np.searchsorted(-sizes[order], -np.arange(longest), side="left")  # pieces with more than `back` rows
    for back in range(longest):
        piece = order[: many[back]]
        slot = first[piece] + sizes[piece] - 1 - back
        cost[slot] = through(role[slot - piece], fault[slot - piece], cost[slot + 1], p)
    return cost


def through(role: np.ndarray, fault: np.ndarray, onward: np.ndarray, p: RepairParams) -> np.ndarray:
    """Costs before each row from those after it, inserts before the row included."""
    out = onward + p.delete
    usable = (fault == SOUND) | (fault == TRUNCATED)
    extra = np.where(fault == TRUNCATED, p.truncated, 0)
    for state in range(4):
        goal = NEXT[state]
        keep = np.where(role == goal, 0, p.rerole)
        out[:, state] = np.minimum(out[:, state], np.where(usable, onward[:, goal] + keep + extra, FAR))
    opens = usable & (role == SYSTEM)
    out[:, START] = np.minimum(out[:, START], np.where(opens, onward[:, SYSTEM] + extra, FAR))
    return inserts(out, p)


def inserts(cost: np.ndarray, p: RepairParams) -> np.ndarray:
    """The costs of a slot with inserts in it: twice around, since user and assistant lead to each other."""
    for _ in range(2):
        for state in range(4):
            cost[:, state] = np.minimum(cost[:, state], cost[:, NEXT[state]] + p.insert)
    return cost


def last_costs(p: RepairParams) -> np.ndarray:
    """Costs at the end of a conversation, which may end before anything is said or after an assistant."""
    return inserts(np.array([[0, FAR, FAR, 0]], np.int64), p)[0]


def successors(role: np.ndarray, fault: np.ndarray, starts: np.ndarray, cost: np.ndarray, last: bool, p: RepairParams) -> tuple[np.ndarray, np.ndarray]:
    """(edit, next node) of every node, numbered 4 * slot + state: the least edit among those that lose nothing.

    In a piece that others follow, its exit nodes are ends; in a last one those that cost nothing.
    """
    slots, sizes = len(cost), np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    row = np.arange(slots) - owner
    closing = np.zeros(slots, bool)
    closing[starts[1:] + np.arange(len(sizes))] = True
    row[closing] = 0  # unused
    usable = ~closing & np.isin(fault[row], (SOUND, TRUNCATED)) if len(fault) else np.zeros(slots, bool)
    extra = np.where(usable & (fault[row] == TRUNCATED), p.truncated, 0) if len(fault) else np.zeros(slots, np.int64)
    said = role[row] if len(role) else np.zeros(slots, int)
    onward = np.vstack([cost[1:], np.full((1, 4), FAR)])
    edit = np.zeros((slots, 4), np.int8)
    to = np.tile(np.arange(slots)[:, None] * 4, (1, 4)) + np.arange(4)
    slot = np.arange(slots)
    for state in range(4):
        goal, mine = NEXT[state], cost[:, state]
        done = closing & ((mine == 0) if last else True) & (mine < FAR)
        # from the greatest initial to the least, so that the least one stays
        options = [
            (REROLE, usable & (onward[:, goal] + p.rerole + extra == mine) & (said != goal), 4 * (slot + 1) + goal),
            (KEEP, usable & (onward[:, goal] + extra == mine) & (said == goal), 4 * (slot + 1) + goal),
            (INSERT, cost[:, goal] + p.insert == mine, 4 * slot + goal),
            (DELETE, ~closing & (onward[:, state] + p.delete == mine), 4 * (slot + 1) + state),
        ]
        if state == START:
            options.insert(1, (KEEP, usable & (onward[:, SYSTEM] + extra == mine) & (said == SYSTEM), 4 * (slot + 1) + SYSTEM))
        for name, holds, target in options:
            holds = holds & ~done & (mine < FAR)
            edit[holds, state], to[holds, state] = name, target[holds]
    return edit.ravel(), to.ravel()


def ranked(edit: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rank of every node by its whole audit, successors after 1, 2, 4, ... edits), by prefix doubling."""
    rank, jumps = edit.astype(np.int64), [to]
    while True:
        pair = rank * (int(rank.max(initial=0)) + 1) + rank[jumps[-1]]
        rank = np.unique(pair, return_inverse=True)[1]
        if not edit[jumps[-1]].any():  # every audit ends within the length that is ranked now
            return rank, jumps
        jumps.append(jumps[-1][jumps[-1]])


def paths(edit: np.ndarray, jumps: list[np.ndarray], entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, bounds): the nodes with an edit on the way from each entry node, place k by the bits of k."""
    length = np.zeros(len(entry), np.int64)
    at = entry.copy()
    for k in range(len(jumps) - 1, -1, -1):  # as far as an edit is left there
        ahead = jumps[k][at]
        go = edit[ahead] != END
        at, length = np.where(go, ahead, at), length + (go << k)
    length += edit[entry] != END
    bounds = np.concatenate([[0], np.cumsum(length)])
    node = np.repeat(entry, length)
    step = np.arange(bounds[-1]) - np.repeat(bounds[:-1], length)
    for k, jump in enumerate(jumps):
        node = np.where(step >> k & 1, jump[node], node)
    return node, bounds


@dataclass
class Solved:
    """What a batch of pieces costs from each entry, the audits of the least paths, and where these leave them."""

    cost: np.ndarray
    audits: list[str]
    leaves: np.ndarray
    nodes: np.ndarray
    bounds: np.ndarray
    edit: np.ndarray
    to: np.ndarray


def solve(role: np.ndarray, fault: np.ndarray, starts: np.ndarray, after: np.ndarray, last: bool, entries: list[int], p: RepairParams) -> Solved:
    """The least path of every piece from each of the `entries` states, piece by piece."""
    cost = cost_to_go(role, fault, starts, after, p)
    edit, to = successors(role, fault, starts, cost, last, p)
    _, jumps = ranked(edit, to)
    first = starts[:-1] + np.arange(len(starts) - 1)
    entry = (4 * first[:, None] + np.array(entries)).ravel()
    nodes, bounds = paths(edit, jumps, entry)
    said = INITIALS[edit[nodes]].tobytes().decode()
    ends = jumps[-1][jumps[-1][entry]]
    return Solved(cost.ravel()[entry], [said[a:b] for a, b in zip(bounds[:-1], bounds[1:])], ends % 4, nodes, bounds, edit, to)


def pieces(audit: str, entry: int, roles: list, texts: list) -> list[str]:
    """`role:text` of what an audit leaves of a piece's rows, entered in a state."""
    out, i, state = [], 0, entry
    for c in audit:
        if c == "D":
            i += 1
            continue
        if c == "K":
            state = SYSTEM if roles[i][:1] == "s" else NEXT[state]
            out.append(f"{roles[i]}:{texts[i]}")
        else:
            state = NEXT[state]
            out.append(f"{NAMES[state]}:{texts[i] if c == 'R' else ''}")
        i += c != "I"
    return out


def states(roles: pa.Array) -> np.ndarray:
    """The state that each role stands for, by its first character."""
    initial = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
    return np.array([initial.get(r[:1], START) for r in roles.to_pylist()], np.int64)


def illegal_steps(initials: np.ndarray) -> np.ndarray:
    """Whether each row may not follow the one before it: neither su, ua nor au."""
    a, b = initials[:-1], initials[1:]
    return ~(((a == SYSTEM) & (b == USER)) | ((a == USER) & (b == ASSISTANT)) | ((a == ASSISTANT) & (b == USER)))


_VISIBLE = re.compile(r"[^\x20\t-\r]")
_LAST = re.compile(r"[.!?][\x20\t-\r]*\Z")


def text_fault(text: str) -> int:
    """A row's fault by its own text, before copies are looked at."""
    if not _VISIBLE.search(text):
        return BLANK
    return SOUND if _LAST.search(text) else TRUNCATED


def repaired_rows(table: pa.Table, p: RepairParams) -> pa.RecordBatch:
    """One result row per conversation of a table sorted by (conv_id, turn, role, text), whole conversations each."""
    ids, gone = table.column("conv_id").combine_chunks(), table.column("gone").to_numpy(zero_copy_only=False).astype(bool)
    codes = ids.dictionary_encode(null_encoding="encode")
    code = codes.indices.to_numpy(zero_copy_only=False)
    heads = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1])  # first row of each conversation
    conversation = np.cumsum(np.isin(np.arange(len(code)), heads)) - 1
    live = np.flatnonzero(~gone)
    rows = table.take(pa.array(live))
    owner = conversation[live]
    n = len(heads)
    starts = np.searchsorted(owner, np.arange(n + 1))
    roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
    said = states(rows.column("role"))
    fault = np.array([text_fault(t) for t in texts], np.int64)
    seen: set = set()
    for k, key in enumerate(zip(owner.tolist(), roles, texts)):
        if key in seen and fault[k] != BLANK:
            fault[k] = DUPLICATE
        seen.add(key)
    turn = rows.column("turn").to_pylist()
    gaps = [_gaps(turn[a:b]) for a, b in zip(starts[:-1], starts[1:])]
    wrong = np.zeros(n, np.int64)
    if len(said) > 1:
        bad = illegal_steps(said) & (owner[1:] == owner[:-1])
        wrong = np.bincount(owner[1:][bad], minlength=n)
    done = solve(said, fault, starts, np.tile(last_costs(p), (n, 1)), True, [START], p)
    digests = [hashlib.sha256("\n".join(pieces(a, START, roles[i:j], texts[i:j])).encode()).hexdigest() for a, i, j in zip(done.audits, starts[:-1], starts[1:])]
    count = lambda kind: pa.array(np.bincount(owner[fault == kind], minlength=n).astype(np.int64))
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(heads)), pa.array(gaps, pa.int64()), count(BLANK), count(DUPLICATE), count(TRUNCATED), pa.array(wrong.astype(np.int64)), pa.array(done.cost), pa.array(done.audits), pa.array(digests)],
        names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    )


def _gaps(turns: list) -> int:
    known = {int(t) for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _short(rows: DataFrame, p: RepairParams) -> DataFrame:
    """Conversations that fit a batch: dealt by id, sorted, solved many at once."""
    kind = dict(rows.dtypes)["conv_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += [batch] if batch.num_rows else []
            if sum(b.num_rows for b in held) >= p.row_limit:
                whole = pa.Table.from_batches(held)
                ids = whole.column("conv_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                cut = int(np.flatnonzero(ids != ids[-1])[-1]) + 1 if (ids != ids[-1]).any() else 0  # the last one may go on
                if cut:
                    yield repaired_rows(whole.slice(0, cut), p)
                held = [b for b in whole.slice(cut).to_batches() if b.num_rows]
        if held:
            yield repaired_rows(pa.Table.from_batches(held), p)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(work, RESULT.format(kind))


# ---- conversations of any length -----------------------------------------------------------------------------------


def _long(rows: DataFrame, p: RepairParams) -> DataFrame:
    """Conversations beyond `row_limit` rows, dealt by ranges of their turns and solved block by block."""
    kind = dict(rows.dtypes)["conv_id"]
    everyone = rows.select("conv_id").distinct()
    turn = F.col("turn").asc_nulls_first()
    live = rows.filter(~F.col("gone")).drop("gone")
    # a place is (partition, row): it grows in the order of the rows
    placed = live.repartitionByRange(F.col("conv_id"), turn).sortWithinPartitions("conv_id", turn, "role", "text")
    placed = stored(placed.withColumn("place", F.monotonically_increasing_id()))
    blank = ~F.col("text").rlike(VISIBLE)
    light = placed.select(
        "conv_id", "turn", "place", F.expr(f"place DIV {p.block}").alias("block"), "role", F.sha2("text", 256).alias("said_hash"),
        blank.alias("blank"), (~blank & ~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")).alias("open"),
    )
    same = ["conv_id", "role", "said_hash"]
    again = light.groupBy(*[F.col(c).alias(f"its_{c}") for c in same]).agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = [F.col(c).eqNullSafe(F.col(f"its_{c}")) for c in same]
    copied = F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    fault = F.when(F.col("blank"), BLANK).when(copied, DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(SOUND)
    said = F.when(F.col("role").startswith("s"), SYSTEM).when(F.col("role").startswith("u"), USER).when(F.col("role").startswith("a"), ASSISTANT).otherwise(START)
    coded = light.join(again.hint("merge"), met, "left").select("conv_id", "turn", "place", "block", fault.cast("int").alias("fault"), said.cast("int").alias("said"))
    coded = stored(coded)

    key = ["conv_id", "block"]
    piece = coded.groupBy(*key).applyInPandas(lambda g: _crossing(g, p), f"conv_id {kind}, block long, costs array<long>, first int, last int, illegal long")
    # one row a block from here on
    after = piece.groupBy("conv_id").applyInPandas(lambda g: _chained(g, p), f"conv_id {kind}, block long, after array<long>, final boolean, bad long")
    after = stored(after)
    meets = [F.col(c).eqNullSafe(F.col(f"its_{c}")) for c in key]
    solved = coded.join(after.withColumnsRenamed({c: f"its_{c}" for c in key}).hint("merge"), meets).select(*key, "place", "fault", "said", "after", "final", "bad")
    solved = solved.groupBy(*key).applyInPandas(lambda g: _solved(g, p), f"conv_id {kind}, block long, bad long, audits array<string>, leaves array<int>, costs array<long>")
    chosen = stored(solved.groupBy("conv_id").applyInPandas(_walked, f"conv_id {kind}, block long, bad long, entry int, cost long, audit string"))
    blocks = placed.withColumn("block", F.expr(f"place DIV {p.block}"))
    texts = blocks.join(chosen.withColumnsRenamed({c: f"its_{c}" for c in key}).hint("merge"), meets).select(*key, "place", "entry", "audit", "role", "text")
    left = texts.groupBy(*key).applyInPandas(_left, f"conv_id {kind}, block long, audit string, said array<string>")
    digests = left.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_digests, f"conv_id {kind}, audit string, repaired_sha256 string")
    known = F.col("turn").cast("long")
    # distinct turns first, so that no task holds a conversation's
    spread = coded.select("conv_id", known.alias("turn")).distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    count = lambda k: F.count_if(F.col("fault") == k)
    counts = coded.groupBy("conv_id").agg(count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated"))
    totals = chosen.groupBy("conv_id").agg(F.max("bad").alias("illegal"), F.max("cost").alias("cost"))
    for part in (spread, counts, totals, digests):
        part = part.withColumnRenamed("conv_id", "other")
        everyone = everyone.join(part.hint("merge"), F.col("conv_id").eqNullSafe(F.col("other")), "left").drop("other")
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return everyone.select("conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _codes(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g = g.sort_values("place")
    return g["said"].to_numpy(np.int64), g["fault"].to_numpy(np.int64), np.array([0, len(g)])


def _crossing(g: pd.DataFrame, p: RepairParams) -> pd.DataFrame:
    """The costs of a block from each entry state to each exit state, and what its ends and insides say."""
    said, fault, starts = _codes(g)
    costs = []
    for leave in range(4):
        after = np.full((1, 4), FAR, np.int64)
        after[0, leave] = 0
        costs.append(cost_to_go(said, fault, starts, after, p)[0])
    wrong = int(illegal_steps(said).sum())
    return pd.DataFrame({"conv_id": g["conv_id"].iloc[:1].to_numpy(), "block": g["block"].iloc[:1].to_numpy(), "costs": [np.array(costs).T.ravel()], "first": [said[0]], "last": [said[-1]], "illegal": [wrong]})


def _chained(g: pd.DataFrame, p: RepairParams) -> pd.DataFrame:
    """What is still to pay after each block, from the last one back; illegal steps inside and between blocks."""
    g = g.sort_values("block")
    cost, after = last_costs(p), []
    for between in reversed(g["costs"].tolist()):
        after.append(cost.copy())
        cost = np.minimum((np.asarray(between, np.int64).reshape(4, 4) + cost).min(1), FAR)
    edge = np.column_stack([g["last"].to_numpy()[:-1], g["first"].to_numpy()[1:]])
    bad = int(g["illegal"].sum()) + sum(int(illegal_steps(e)[0]) for e in edge)
    return pd.DataFrame({"conv_id": g["conv_id"].to_numpy(), "block": g["block"].to_numpy(), "after": after[::-1], "final": np.arange(len(g)) == len(g) - 1, "bad": bad})


def _solved(g: pd.DataFrame, p: RepairParams) -> pd.DataFrame:
    """A block's least audit from every state that it may be entered in."""
    said, fault, starts = _codes(g)
    done = solve(said, fault, starts, np.array([g["after"].iloc[0]], np.int64), bool(g["final"].iloc[0]), [0, 1, 2, 3], p)
    one = g.iloc[:1]
    return pd.DataFrame({"conv_id": one["conv_id"].to_numpy(), "block": one["block"].to_numpy(), "bad": one["bad"].to_numpy(), "audits": [done.audits], "leaves": [done.leaves.astype(np.int32)], "costs": [done.cost]})


def _walked(g: pd.DataFrame) -> pd.DataFrame:
    """The entry state of each block along the least path, and the audit that it gives."""
    g = g.sort_values("block")
    state, entry, audit = START, [], []
    for said, leaves in zip(g["audits"], g["leaves"]):
        entry.append(state)
        audit.append(said[state])
        state = int(leaves[state])
    return pd.DataFrame({"conv_id": g["conv_id"].to_numpy(), "block": g["block"].to_numpy(), "bad": g["bad"].to_numpy(), "entry": entry, "cost": int(g["costs"].iloc[0][START]), "audit": audit})


def _left(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("place")
    said = pieces(g["audit"].iloc[0], int(g["entry"].iloc[0]), g["role"].tolist(), g["text"].tolist())
    return pd.DataFrame({"conv_id": g["conv_id"].iloc[:1].to_numpy(), "block": g["block"].iloc[:1].to_numpy(), "audit": g["audit"].iloc[:1].to_numpy(), "said": [said]})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of each conversation from its blocks in order; texts go through the hash as they come."""
    current, audit, digest, any_yet, ready = None, [], hashlib.sha256(), False, []

    def closed():
        return current[0], "".join(audit), digest.hexdigest()

    for batch in batches:
        for conv, piece, said in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "audit", "said"))):
            if current != (conv,):
                if current:
                    ready.append(closed())
                current, audit, digest, any_yet = (conv,), [], hashlib.sha256(), False
            audit.append(piece)
            for s in said:
                digest.update((("\n" if any_yet else "") + s).encode())
                any_yet = True
        if ready:
            yield _digest_rows(ready, batch.schema.field("conv_id").type)
            ready = []
        kind = batch.schema.field("conv_id").type
    if current:
        yield _digest_rows([closed()], kind)


def _digest_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids, audits, digests = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(audits), pa.array(digests)], names=["conv_id", "audit", "repaired_sha256"])


def repaired(rows: DataFrame, p: RepairParams = RepairParams()) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, gone): faults, cost, audit and digest of its repair."""
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > p.row_limit).select(F.col("conv_id").alias("long_id"))
    sizes = stored(sizes)
    if not sizes.take(1):
        return _short(rows, p)
    same: Column = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = rows.join(sizes.hint("merge"), same, "left_anti")
    return _short(short, p).unionByName(_long(rows.join(sizes.hint("merge"), same, "left_semi"), p))
