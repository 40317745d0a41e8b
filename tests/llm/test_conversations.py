"""Conversation repair against a search over all edits in plain Python."""

from __future__ import annotations

import hashlib
import heapq
import os
import random
import re
import zlib

import pytest

from carbonsplit.llm import conversations
from carbonsplit.llm.queries import damaged
from carbonsplit.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
PATTERN = re.compile(r"(s?(ua)+)?")


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        read = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{read[0]}:{read[1]}".encode()) % 20
        role, text = read[2:]
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(rows):
    """``(cost, audit, repaired)`` by best-first search; nodes are rows read and role initials so far, so every way is tried."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))

    def tail(initials):  # all that matters of what was read
        return initials if len(initials) < 3 else initials[0] + "…" + initials[-1]

    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, initials, out = heapq.heappop(queue)
        if at == len(rows) and PATTERN.fullmatch(initials):
            return cost, audit, [":".join(x) for x in out], faults
        if (at, tail(initials)) in done:
            continue
        done.add((at, tail(initials)))
        steps = [(2, "I", 0, (r, "")) for r in ("user", "assistant")]
        if at < len(rows):
            role, text = rows[at]
            extra = faults[at] == "truncated"
            steps.append((3, "D", 1, None))
            if faults[at] not in ("blank", "duplicate"):
                steps += [(extra, "K", 1, (role, text)), *((2 + extra, "R", 1, (r, text)) for r in ("user", "assistant"))]
        for price, edit, read, turn in steps:
            now = initials + (turn[0][:1] or "?" if turn else "")
            if re.fullmatch(r"(s?(ua)*u?)?", now):
                heapq.heappush(queue, (cost + price, audit + edit, at + read, now, (*out, turn) if turn else out))


def by_hand(rows):
    """The query's rows, from rows that are already damaged."""
    found = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        cost, audit, repaired, faults = cheapest([r[2:] for r in own])
        turns = {r[1] for r in own} - {None}
        initials = [r[2][:1] for r in own]
        found[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            cost,
            audit,
            hashlib.sha256("\n".join(repaired).encode()).hexdigest(),
        )
    return found


def invented(seed, n, longest, roles=("user", "assistant", "system", "tool", "")):
    choose = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        size = choose.randint(1, longest)
        for turn in range(size):
            text = choose.choice(["", " \n", "Yes.", "So?", "and then", "end! \t", f"{choose.random()}.", f"{choose.random()}"])
            role = choose.choice(roles) if choose.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv, choose.choice([turn, turn, turn + 3, None]), role, text))
    choose.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, block string, place int, kinds long, edits int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def result(spark, rows, chunk):
    turns, summary = conversations.repair(frame(spark, rows), chunk)
    digests = {r[0]: r[1] for r in conversations.text_digests(turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    number = {None: None, **{str(n): n for n in range(10_000)}}
    return {number[r.conv_id]: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests.get(r.conv_id, empty)) for r in summary.collect()}


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_every_chunk_size_finds_the_least_audit(spark, chunk):
    rows = invented(7, 60, 12)
    assert result(spark, rows, chunk) == by_hand(rows)


def test_vectors_that_never_converge(spark):
    """Turns of one role keep two vectors apart over every chunk, so the passes must reach further each time."""
    rows = [(1, n, "user", f"{n}.") for n in range(400)] + [(1, 400, "assistant", "no"), (1, 401, "assistant", "yes")]
    rows += [(2, n, "user", "same.") for n in range(300)] + [(2, 300, "user", "more."), (2, 301, "assistant", "x")]
    assert result(spark, rows, 3) == by_hand(rows)


def test_no_rows(spark):
    turns, summary = conversations.repair(frame(spark, [(1, 1, "user", "x")]).limit(0))
    assert turns.collect() == [] and summary.collect() == []


def test_edits_are_told_row_by_row(spark):
    turns, _ = conversations.repair(frame(spark, [(5, 1, "assistant", "Hello."), (5, 2, "tool", None), (5, 3, "assistant", "Bye")]), 2)
    rows = [(r.edit, r.role, r.text) for r in turns.orderBy("block", "n").collect()]
    assert rows == [("R", "user", "Hello."), ("D", "tool", ""), ("K", "assistant", "Bye")]
    turns, _ = conversations.repair(frame(spark, [(5, 1, "assistant", "Hello."), (5, 2, "user", "Hi.")]), 1)
    assert [(r.edit, r.role) for r in turns.orderBy("block", "n").collect()] == [("I", "user"), ("K", "assistant"), ("K", "user"), ("I", "assistant")]


def test_long_text(spark):
    long = "word " * 200_000
    assert result(spark, [(1, 1, "user", long + "."), (1, 2, "assistant", long)], 4096) == by_hand([(1, 1, "user", long + "."), (1, 2, "assistant", long)])


def test_damage(spark):
    rows = [*invented(3, 40, 9), (None, None, None, None), (2, 1, None, "a.b!"), (2, None, "user", None)]
    got = damaged(frame(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, damaged_by_hand(rows)))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    found = by_hand(damaged_by_hand(rows))
    want = {conv: found.get(conv, none) for conv in {r[0] for r in rows}}
    got = QUERIES["op12_conversation_repair"](spark, FOLDER)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_few_rows_are_not_dealt_out_again_and_again(spark):
    """With many partitions the tasks of small steps were most of the work."""
    parts = 40
    held = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    context = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("op12-tasks", "")
        QUERIES["op12_conversation_repair"](spark, FOLDER).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    status = context.statusTracker()
    stages = {s for job in status.getJobIdsForGroup("op12-tasks") for s in status.getJobInfo(job).stageIds}
    done = [info.numCompletedTasks for s in stages if (info := status.getStageInfo(s))]
    assert sum(n >= parts for n in done) <= 11
