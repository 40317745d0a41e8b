"""Repair of conversation structure with the fewest edits, by rank-convergence parallel Viterbi.

The turns of a conversation must read ``(s?(ua)+)?`` by role initials.  Four states tell
what has been read: nothing, a system turn, a user turn last, an assistant turn last.  The
cost vector before a turn holds the least cost of the rest from each state, and follows
from the vector after it.

All turns are put in order and cut into chunks, which start at once from a speculative
vector behind them.  Where the vector that the next chunk then finds differs from the
speculated one by more than a constant, the chunk runs again.  Constants do not change
which edits are cheapest, so the stitched vectors drive one forward trace per chunk.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carbonsplit.llm.common import cut, small

#: Turns of a chunk at most.
CHUNK = 4096
#: Chunks that one task may fix one after another, to the power of the number of passes that did not suffice.
REACH = 64
#: Chunks of longer conversations for each task that works on them.
CHUNKS_PER_TASK = 64

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state behind a user or assistant turn, whichever can follow.
NEED = (USER, USER, ASSISTANT, USER)
INITIALS = "sua"
#: The state behind a turn that keeps its role, by initial and state; other turns cannot be kept there.
KEPT = {(0, NOTHING): SYSTEM, (1, NOTHING): USER, (1, SYSTEM): USER, (1, ASSISTANT): USER, (2, USER): ASSISTANT}
#: Least cost of the rest once no turns are left: two states may end, the others need turns.
FINAL = (0, 4, 2, 0)
DELETE, INSERT, REROLE = 3, 2, 2
#: What a turn can be faulted for; from the third on it must go.
FAULTS = ("none", "truncated", "duplicate", "blank")
SPACES = "\t\n\x0b\x0c\r "


class Steps(dict):
    """The vector before a turn and the constant taken from it, by the vector behind it and the kind of turn."""

    def __missing__(self, key):
        behind, kind = key
        initial, fault = divmod(ord(kind) - 65, 4)
        least = []
        for state in range(4):
            cost = behind[state] + DELETE
            if fault < 2:
                cost = min(cost, behind[NEED[state]] + REROLE + fault)
                if (initial, state) in KEPT:
                    cost = min(cost, behind[KEPT[initial, state]] + fault)
            least.append(cost)
        user, assistant = min(least[USER], least[ASSISTANT] + INSERT), min(least[ASSISTANT], least[USER] + INSERT)
        vector = (min(least[NOTHING], user + INSERT), min(least[SYSTEM], user + INSERT), user, assistant)
        low = min(vector)
        self[key] = tuple(x - low for x in vector), low
        return self[key]


def levelled(vector) -> tuple[int, ...]:
    low = min(vector)
    return tuple(int(x - low) for x in vector)


def backward(steps: Steps, kinds: str, goal) -> list[int]:
    """The vector before the first turn, given the one behind the last."""
    vector, total = levelled(goal), int(min(goal))
    for kind in reversed(kinds):
        vector, low = steps[vector, kind]
        total += low
    return [x + total for x in vector]


def forward(steps: Steps, kinds: str, goal, state: int, last: bool) -> tuple[str, int]:
    """The edits of a cheapest way from ``state``, least by ASCII, and the state it ends in.

    An edit letter fixes the next state, so the least letter on any cheapest way is right.
    Turns inserted between two chunks are the later chunk's.
    """
    vectors, lows = [levelled(goal)], []
    for kind in reversed(kinds):
        vector, low = steps[vectors[-1], kind]
        vectors.append(vector)
        lows.append(low)
    vectors.reverse()
    lows.reverse()
    edits = []
    at = 0
    while at < len(kinds) or (last and state not in (NOTHING, ASSISTANT)):
        if at == len(kinds):
            edits.append("I")
            state = NEED[state]
            continue
        here, behind = vectors[at][state], vectors[at + 1]
        rest = here + lows[at]
        initial, fault = divmod(ord(kinds[at]) - 65, 4)
        if behind[state] + DELETE == rest:
            edits.append("D")
        elif vectors[at][NEED[state]] + INSERT == here:
            edits.append("I")
            state = NEED[state]
            continue
        elif fault < 2 and (initial, state) in KEPT and behind[KEPT[initial, state]] + fault == rest:
            edits.append("K")
            state = KEPT[initial, state]
        else:
            edits.append("R")
            state = NEED[state]
        at += 1
    return "".join(edits), state


def _initial(role: Column) -> Column:
    """0 to 2 for s, u, a; 3 for any other role, which cannot be kept."""
    out = F.lit(3)
    for n, letter in enumerate(INITIALS):
        out = F.when(F.substring(role, 1, 1) == letter, n).otherwise(out)
    return out


def matched(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on ``names``, null equal to null; the right side's own keys are left out."""
    named = right.withColumnsRenamed({n: f"_{n}" for n in names})
    equal = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    return left.join(named, equal, how).drop(*[f"_{n}" for n in names])


def in_order(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Written rows with ``place``, which grows in the order of conversations and turns, and ``block``.

    A block holds at most ``chunk`` consecutive rows; blocks are numbered without gaps, so
    a conversation goes on in the next block or not at all.  The order needs no task that
    sees a whole conversation: range partitions are sorted on their own, and equal rows are
    told apart by their place in the input.
    """
    rows = conversations.select(
        F.col("conv_id").cast("string").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = ["conv_id", "turn", "role", "text", "_row"]
    said = F.rtrim("text", F.lit(SPACES))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.monotonically_increasing_id().alias("place"),
        _initial(F.col("role")).alias("initial"),
        (said == "").alias("blank"),
        (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)).alias("said"),
    )
    placed = cut(placed, "turns").withColumn("_part", F.shiftright("place", 33))
    sizes = placed.groupBy("_part").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("_n"))
    # one row per shuffle partition; written, since every reader of the turns joins it
    starts = sizes.coalesce(1).select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    starts = cut(starts, "starts")
    block = F.col("_start") + F.floor(F.col("place").bitwiseAND((1 << 33) - 1) / chunk)
    return placed.join(F.broadcast(starts), "_part").withColumn("block", block.cast("long")).drop("_part", "_start")


def chunks(turns: DataFrame) -> DataFrame:
    """``conv_id, block, kinds, low, high, numbers``: one letter per turn of a chunk, which tells initial and first fault; least and greatest turn number and how many there are.

    A turn is a duplicate unless it is the first of its conversation with that role and
    text; the first ones come as rows of their own to the turns' blocks, so no frequent
    text is joined.  Roles and texts are compared by SHA-256.
    """
    first = turns.groupBy("conv_id", "said").agg(F.min(F.struct("place", "block")).alias("at")).select("conv_id", "at.*")
    marks = ["initial", "blank", "truncated"]
    rows = turns.select("conv_id", "block", "place", *marks, "turn", F.lit(False).alias("first"))
    rows = rows.unionByName(first.withColumn("first", F.lit(True)), allowMissingColumns=True)
    one = rows.repartition("block").groupBy("conv_id", "block", "place").agg(*[F.max(m).alias(m) for m in (*marks, "turn", "first")])
    fault = F.when(F.col("blank"), 3).when(~F.col("first"), 2).when(F.col("truncated"), 1).otherwise(0)
    kind = F.char(65 + 4 * F.col("initial") + fault)
    letters = F.array_sort(F.collect_list(F.struct("place", kind.alias("kind"))))
    numbers = [F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.array_distinct(F.collect_list("turn"))).cast("long").alias("numbers")]
    return one.groupBy("conv_id", "block").agg(F.array_join(F.transform(letters, lambda x: x["kind"]), "").alias("kinds"), *numbers)


_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _measured(kinds: pd.Series) -> pd.DataFrame:
    """Counts of a chunk, and its first vector if its end were the conversation's."""
    steps = Steps()
    plain = str.maketrans({chr(65 + 4 * i + f): str(i) for i in range(4) for f in range(4)})
    legal = {"01", "12", "21"}
    out = []
    for text in kinds:
        roles = text.translate(plain)
        faults = [sum(text.count(chr(65 + 4 * i + f)) for i in range(4)) for f in (3, 2, 1)]
        pairs = sum(a + b not in legal for a, b in itertools.pairwise(roles))
        out.append((*faults, pairs, backward(steps, text, FINAL)))
    return pd.DataFrame(out, columns=[*_COUNTS, "begin"])


def solved(found: DataFrame) -> DataFrame:
    """``conv_id, block, kinds, goal, begin``: every chunk of a longer conversation with the vector behind it, up to a constant.

    Pass by pass, chunks whose next chunk begins otherwise than they assumed run again.  A
    pass that leaves some behind is followed by one in which a task goes through ``REACH``
    times as many chunks, from the last to the first, so the passes grow with the
    logarithm of a conversation's length even if vectors never converge.
    """
    reach, tasks = 1, _tasks(found)
    while True:
        ahead = found.select("conv_id", (F.col("block") - 1).alias("block"), F.col("begin").alias("seen"))
        joined = matched(found, ahead, ["conv_id", "block"], "left")

        def level(vector: str) -> Column:
            return F.transform(vector, lambda x: x - F.array_min(vector))

        if joined.filter(level("seen") != level("goal")).isEmpty():
            return joined
        group = F.floor(F.col("block") / reach)
        queued = joined.withColumn("group", group).repartition("group").coalesce(tasks).sortWithinPartitions("group", "conv_id", F.col("block").desc()).drop("group")
        found = cut(queued.mapInPandas(_rerun, queued.drop("seen").schema), "vectors")
        reach *= REACH


def _tasks(found: DataFrame) -> int:
    """Tasks for the chunks of longer conversations, a written table: a few chunks are not dealt out over all partitions."""
    return max(1, math.ceil(found.count() / CHUNKS_PER_TASK))


def _rerun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    steps = Steps()
    ahead = None
    for batch in batches:
        goals, begins = [], []
        for conv, block, kinds, goal, begin, seen in zip(*(batch[c] for c in ("conv_id", "block", "kinds", "goal", "begin", "seen")), strict=True):
            if seen is not None:
                # the next chunk may just have run in this task
                seen = ahead[2] if ahead is not None and ahead[:2] == (conv, block + 1) else seen
                if levelled(seen) != levelled(goal):
                    goal, begin = seen, backward(steps, kinds, seen)
            ahead = (conv, block, begin)
            goals.append([int(x) for x in goal])
            begins.append([int(x) for x in begin])
        yield batch.drop(columns="seen").assign(goal=goals, begin=begins)


def traced(found: DataFrame) -> DataFrame:
    """``conv_id, block, edits, start`` from ``conv_id, block, kinds, goal, start, last``."""

    def trace(batches):
        steps = Steps()
        for b in batches:
            ways = [forward(steps, *row)[0] for row in zip(b["kinds"], b["goal"], b["start"], b["last"], strict=True)]
            yield pd.DataFrame({"conv_id": b["conv_id"], "block": b["block"], "edits": ways, "start": b["start"]})

    return found.select("conv_id", "block", "kinds", "goal", "start", "last").mapInPandas(trace, "conv_id string, block long, edits string, start int")


def started(found: DataFrame) -> DataFrame:
    """The chunks of longer conversations with the state that each starts in.

    Each chunk's way is traced from all four states at once; what is then passed from
    chunk to chunk, in the order of a conversation, is four numbers a chunk.
    """

    @F.pandas_udf("array<int>")
    def ends(kinds: pd.Series, goals: pd.Series, last: pd.Series) -> pd.Series:
        steps = Steps()
        return pd.Series([[forward(steps, k, g, s, bool(at_end))[1] for s in range(4)] for k, g, at_end in zip(kinds, goals, last, strict=True)])

    def walk(batches):
        at, state = None, NOTHING
        for b in batches:
            states = []
            for block, is_first, way in zip(b["block"], b["first"], b["ends"], strict=True):
                state = NOTHING if is_first else state
                states.append(state)
                state = int(way[state])
            yield pd.DataFrame({"conv_id": b["conv_id"], "block": b["block"], "start": states})

    maps = found.select("conv_id", "block", "first", ends("kinds", "goal", "last").alias("ends")).repartition("conv_id").coalesce(_tasks(found)).sortWithinPartitions("conv_id", "block")
    states = maps.mapInPandas(walk, "conv_id string, block long, start int")
    return matched(found, states, ["conv_id", "block"])


def repair(conversations: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Repaired turns, and a summary of every conversation that has turns.

    The first is ``conv_id`` (as string) ``, block, n, edit, role, text``: all edits in the order of
    ``block, n``.  ``edit`` is K (kept), R (another role), D (deleted, as it was) or I (a
    turn without text put in).  Deleting costs 3, a new role or a turn put in 2, and a
    truncated turn that stays 1; blank and duplicate turns must go.  Of the cheapest
    edits, those whose letters are least by ASCII are taken.

    The second is ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``:
    turn numbers missing between the least and the greatest, turns by their first fault,
    neighbours whose initials are not su, ua or au, the cost, and the edits' letters.

    Turns go by ``turn`` (null first), ties by role and text; null roles and texts are
    empty, which cannot be kept or is blank; rows with a null ``conv_id`` are one
    conversation; repeated rows are turns of their own and so duplicates; empty tables
    give no rows; other columns do not matter.  A conversation may have any number of
    turns: chunks of it are worked on by different tasks.
    """
    turns = in_order(conversations, chunk)
    measure = F.pandas_udf(_measured, "blank long, duplicate long, truncated long, illegal long, begin array<long>")
    numbers = ["low", "high", "numbers"]
    cuts = chunks(turns).select("conv_id", "block", "kinds", *numbers, F.array(*[F.lit(x).cast("long") for x in FINAL]).alias("goal"), measure("kinds").alias("m"))
    cuts = cut(cuts.select("conv_id", "block", "kinds", *numbers, "goal", "m.*"), "chunks")

    spans = cuts.groupBy("conv_id").agg(F.min("block").alias("_low"), F.max("block").alias("_high")).filter("_low < _high")
    # at most one conversation for each two neighbouring blocks
    spans = small(cut(spans, "spans"))
    vectors = ["conv_id", "block", "kinds", *numbers, "goal", "begin"]
    longer = matched(cuts.select(vectors), spans, ["conv_id"])
    longer = cut(longer.withColumns({"first": F.col("block") == F.col("_low"), "last": F.col("block") == F.col("_high")}).drop("_low", "_high"), "longer")
    whole = matched(cuts, spans, ["conv_id"], "left_anti")
    joint = cut(solved(longer), "joint")

    ways = traced(whole.withColumns({"start": F.lit(NOTHING), "last": F.lit(True)})).unionByName(traced(started(joint)))
    ways = cut(ways, "ways")
    return _edited(turns, ways), _summary(cuts, whole, joint, ways)


def _summary(cuts: DataFrame, whole: DataFrame, joint: DataFrame, ways: DataFrame) -> DataFrame:
    """What the chunks of a conversation add up to, in one grouped pass."""
    # a chunk's vector is right up to the constant by which the next chunk's exceeds the one assumed
    shift = F.coalesce(F.col("seen")[0] - F.col("goal")[0], F.lit(0))
    costs = whole.select("conv_id", F.col("begin")[0].alias("cost"))
    costs = costs.unionByName(joint.select("conv_id", (shift + F.when(F.col("first"), F.col("begin")[0]).otherwise(0)).alias("cost")))
    ahead = joint.select("conv_id", (F.col("block") - 1).alias("block"), _role_of(F.substring("kinds", 1, 1)).alias("next"), F.col("low").alias("next_low"))
    pairs = matched(joint, ahead, ["conv_id", "block"])
    pair = F.concat(_role_of(F.substring("kinds", -1, 1)), "next")
    # turns go by number, so two chunks share at most the number between them
    pairs = pairs.select("conv_id", (~pair.isin("01", "12", "21")).cast("int").alias("illegal"), F.when(F.col("high") == F.col("next_low"), -1).otherwise(0).alias("numbers"))
    counts = cuts.select("conv_id", *_COUNTS, "low", "high", "numbers")
    for part in (costs, pairs, ways.select("conv_id", F.struct("block", "edits").alias("way"))):
        counts = counts.unionByName(part, allowMissingColumns=True)
    sums = [F.sum(c).cast("long").alias(c) for c in (*_COUNTS, "cost")]
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("numbers"), F.lit(0)).cast("long").alias("gaps")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list("way")), lambda x: x["edits"]), "").alias("audit")
    return counts.groupBy("conv_id").agg(gaps, *sums, audit)


def _role_of(kind: Column) -> Column:
    return F.floor((F.ascii(kind) - 65) / 4).cast("string")


def _edited(turns: DataFrame, ways: DataFrame) -> DataFrame:
    """The edits of each block applied to its turns as they stream by."""
    rows = turns.select("conv_id", "block", "place", "role", "text")
    heads = ways.select("conv_id", "block", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.lit("").alias("text"), "edits", "start")
    both = rows.unionByName(heads, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "conv_id", "place")

    def apply(batches):
        edits, at, state = "", 0, NOTHING
        for b in batches:
            out = []
            for conv_id, block, place, role, text, way, start in zip(*(b[c] for c in ("conv_id", "block", "place", "role", "text", "edits", "start")), strict=True):
                if place < 0:
                    edits, at, state = way, 0, int(start)
                elif edits[at] == "R":
                    state = NEED[state]
                    out.append((conv_id, block, at, "R", ROLES[state], text))
                    at += 1
                else:
                    state = KEPT[INITIALS.index(role[0]), state] if edits[at] == "K" else state
                    out.append((conv_id, block, at, edits[at], role, text))
                    at += 1
                while at < len(edits) and edits[at] == "I":
                    state = NEED[state]
                    out.append((conv_id, block, at, "I", ROLES[state], ""))
                    at += 1
            yield pd.DataFrame(out, columns=_EDITED)

    return both.mapInPandas(apply, "conv_id string, block long, n long, edit string, role string, text string")


_EDITED = ["conv_id", "block", "n", "edit", "role", "text"]


def text_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of ``role:text`` of the turns that stay, newline between them.

    The digest of a conversation needs its turns one after another, so they stream through
    one task; no more than a batch is held.
    """
    kept = turns.filter("edit <> 'D'").repartition("conv_id").sortWithinPartitions("conv_id", "block", "n")

    def digest(batches):
        rows = ((c, r, t) for b in batches for c, r, t in zip(b["conv_id"], b["role"], b["text"], strict=True))
        out = []
        for conv_id, own in itertools.groupby(rows, key=lambda x: x[0]):
            sum_ = hashlib.sha256()
            for n, (_, role, text) in enumerate(own):
                sum_.update(f"{chr(10) if n else ''}{role}:{text}".encode())
            out.append((conv_id, sum_.hexdigest()))
            if len(out) == 1000:
                yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"])

    return kept.mapInPandas(digest, "conv_id string, repaired_sha256 string")
