"""Best-fit packing of documents into sequences of a fixed number of tokens.

How documents pack depends only on how many pieces of each length there are:
a table with at most ``capacity`` rows, whatever the corpus. The plan is made
on that table by bin completion and handed back as ranges of ranks; each piece
then finds its sequence from its rank among the pieces of its length. No group
of rows is brought together.

Bin completion: the first incumbent is best-fit decreasing. From the least
number of sequences that the lengths allow (Martello and Toth's bound) up to one
less than the incumbent's, a depth-first search tries to do with that many: it
takes the largest length left (or, of few lengths and with less to waste than
the least one, that with fewest fillings), enumerates the fillings around it that waste no
more than may still be wasted and that no other filling dominates, and applies
one as often as the counts allow, or, where that fails, less often. A branch is
cut when the bound of what is left exceeds the sequences left. The search is
exact until its steps run out; then the incumbent stands.

Defined results: null text counts as empty (one piece, the end id alone); rows
with equal doc_id are packed one by one; an empty table gives no sequences;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored
from .tokens import TOKENIZER, encoder, forgetting

CAPACITY = 2048
#: Search steps in all and for the fillings around one length (with STEPS the
#: driver is busy for some seconds), and most lengths that are compared for fewest.
STEPS, AROUND, COMPARED = 1_000_000, 20_000, 128

Plan = list[tuple[tuple[int, ...], int]]  # (lengths in one sequence, how many such)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, with equal sequences handled together."""
    open_at: dict[int, list[list]] = {}  # room left -> [lengths, how many]
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], n: int):
        if room not in open_at:
            open_at[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        open_at[room].append([lengths, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_right(rooms, length - 1)
            if k == len(rooms):
                each = capacity // length
                n, rest = divmod(left, each)
                if n:
                    put(capacity - each * length, (length,) * each, n)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            room = rooms[k]
            bins = open_at[room]
            lengths, n = bins[-1]
            take = min(n, left)
            bins[-1][1] -= take
            if not bins[-1][1]:
                bins.pop()
                if not bins:
                    del open_at[room], rooms[k]
            put(room - length, (*lengths, length), take)
            left -= take
    return [(tuple(b[0]), b[1]) for bins in open_at.values() for b in bins]


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether b's lengths fit into a's, each of a's holding some of b's: then
    a filling of a leaves no worse a remainder than one of b."""
    if not b:
        return True
    room = list(a)

    def place(k: int) -> bool:
        if k == len(b):
            return True
        for j, r in enumerate(room):
            if r >= b[k] and r not in room[:j]:
                room[j] -= b[k]
                if place(k + 1):
                    return True
                room[j] += b[k]
        return False

    return sum(b) <= sum(a) and place(0)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: lengths over half a sequence need one each, and
    those down to k that don't fit beside them need more."""
    if not counts:
        return 0
    x = np.array(sorted(counts), "i8")
    n = np.array([counts[k] for k in x.tolist()], "i8")
    held, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    half = int(np.searchsorted(x, capacity // 2, side="right"))
    k = np.concatenate([[0], x[:half]])  # thresholds
    lo, hi = np.searchsorted(x, k), np.searchsorted(x, capacity - k, side="right")
    room = (held[hi] - held[half]) * capacity - (total[hi] - total[half])  # beside lengths that can hold k or more
    spill = np.maximum(total[half] - total[lo] - room, 0)
    return int((held[-1] - held[half] + -(-spill // capacity)).max())


def fillings(counts: dict[int, int], room: int, most_waste: int, budget: list[int], dominated: bool = False) -> list[tuple[int, ...]]:
    """Undominated (or all) fillings of room that waste at most so much, least
    waste first, lengths falling."""
    lengths = sorted(x for x, n in counts.items() if n and x <= room)
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = begun = min(AROUND, budget[0])
    used = dict.fromkeys(lengths, 0)

    def go(k: int, left: int, chosen: tuple[int, ...]):
        nonlocal steps
        j, full = bisect_right(lengths, left, 0, k) - 1, True
        while j >= 0 and steps > 0:
            x = lengths[j]
            steps -= 1
            if used[x] < counts[x]:
                full = False
                if x * (left // lengths[0]) < left - most_waste:  # not even as many as fit are enough
                    break
                if most_waste < left - x < lengths[0]:  # nothing fits beside it, and too much is lost
                    j = bisect_right(lengths, left - lengths[0], 0, j) - 1
                    continue
                used[x] += 1
                go(j + 1, left - x, (*chosen, x))
                used[x] -= 1
            j -= 1
        if full and left <= most_waste:
            found.append((left, chosen))

    go(len(lengths), room, ())
    budget[0] -= begun - steps + 1
    kept: list[tuple[int, tuple[int, ...]]] = []
    for waste, f in sorted(found, key=lambda w: (w[0], len(w[1]), [-x for x in w[1]])):
        if not dominated and len(f) <= 8 and len(kept) <= 200 and any(len(g) <= 8 and _dominates(g, f) for _, g in kept):
            continue
        kept.append((waste, f))
    return [f for _, f in kept]


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Plan:
    """As few sequences as the search finds; never more than best-fit's."""
    counts = {x: n for x, n in counts.items() if n}
    best = best_fit(counts, capacity)
    fewest, budget = sum(n for _, n in best), [steps]
    for target in range(lower_bound(counts, capacity), fewest):
        plan = _within(counts, capacity, target, budget)
        if plan is not None:
            return plan
        if budget[0] <= 0:
            break
    return best


def _within(counts: dict[int, int], capacity: int, target: int, budget: list[int]) -> Plan | None:
    """A plan of at most ``target`` sequences, if the search finds one.

    Counts grow with the corpus, what is held doesn't: how often a filling is
    applied is counted down, not listed, and the lengths left are one table,
    put back on the way up.
    """
    total = sum(x * n for x, n in counts.items())
    slack = target * capacity - total
    tight = bool(counts) and len(counts) <= COMPARED and slack < min(counts)
    around: dict[int, list] = {}  # if tight, the fillings around each length
    now, bins, spare = dict(counts), 0, slack  # lengths left, sequences made, what may still be wasted
    path: Plan = []
    stack: list[Iterator] = []

    def apply(sequence: tuple[int, ...], times: int):
        nonlocal bins, spare
        bins, spare = bins + times, spare - times * (capacity - sum(sequence))
        for x in sequence:
            now[x] = now.get(x, 0) - times
            if not now[x]:
                del now[x]

    def tries(top: int, found: list[tuple[int, ...]]):
        """Each filling as often as can be, then each less often."""
        for less in (False, True):
            for f in found:
                sequence = (top, *f)
                lost = capacity - sum(sequence)
                times = min([now[x] // sequence.count(x) for x in set(sequence)] + ([spare // lost] if lost else []))
                for n in range(times - 1, 0, -1) if less else [max(times, 1)]:
                    yield sequence, n

    def frame():
        if tight:
            fewest = None
            for x in sorted(now, reverse=True):
                if x not in around:
                    around[x] = fillings(counts | {x: counts[x] - 1}, capacity - x, slack, budget, True)  # a better one may be used up later
                can = []
                for f in around[x]:
                    budget[0] -= 1
                    if capacity - x - sum(f) <= spare and all((x, *f).count(y) <= now.get(y, 0) for y in (x, *f)):
                        can.append(f)
                if fewest is None or len(can) < len(fewest[1]):
                    fewest = (x, can)
                if len(can) < 2:
                    break
            return tries(*fewest)
        top = max(now)
        return tries(top, fillings(now | {top: now[top] - 1}, capacity - top, spare, budget))

    stack.append(frame())
    while stack and budget[0] > 0:
        if len(path) == len(stack):  # back from below
            sequence, times = path.pop()
            apply(sequence, -times)
        if (step := next(stack[-1], None)) is None:
            stack.pop()
            continue
        budget[0] -= 10
        apply(*step)
        path.append(step)
        if bins + lower_bound(now, capacity) > target:
            continue
        if not now:
            return path
        stack.append(frame())
    return None


def rank_ranges(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, how many in a sequence, first sequence,
    place of the first one) for each length of each kind of sequence."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, n in plan:
        place = 0
        for x in sorted(set(lengths), reverse=True):
            k, lo = lengths.count(x), used.get(x, 0)
            used[x] = lo + n * k
            out.append((x, lo, lo + n * k, k, sequence, place))
            place += k * x
        sequence += n
    return out


_PIECE = [("doc_id", "long"), ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("part", "int"), ("part_rank", "long")]


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row for each piece, and its rank among its length's in its partition.

    Documents of over ``capacity`` ids are cut so that the first piece is the
    shorter one.
    """

    def rows(batches):
        part, encode, end = TaskContext.get().partitionId(), encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        seen = [0] * (capacity + 1)
        for b in batches:
            out = tuple([] for _ in _PIECE)
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                at, size = 0, (n - 1) % capacity + 1
                k = 0
                while at < n:
                    row = (doc_id, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), part, seen[size])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    seen[size] += 1
                    at, k, size = at + size, k + 1, capacity
            types = [pa.int32() if t == "int" else pa.int64() for _, t in _PIECE]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types, strict=True)], [n for n, _ in _PIECE]
            )

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows_in.mapInArrow(forgetting(rows, tokenizer), ", ".join(f"{n} {t}" for n, t in _PIECE))


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, capacity, end_id, tokenizer), "pieces")
    # At most ``capacity`` rows come to the driver.
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    ranges = spark.createDataFrame(
        rank_ranges(complete_bins(counts, capacity)) or [(0, 0, 0, 1, 0, 0)],
        "length long, lo long, hi long, each long, sequence long, place long",
    )
    held = pieces.groupBy("part", "length").agg((F.max("part_rank") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases.hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("part_rank"))
    # One range or more for each length and kind of sequence: each kind uses up
    # a length, so their number is bounded by capacity, not by rows.
    within = (ranked["length"] == ranges["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    at = F.col("rank") - F.col("lo")
    return ranked.join(F.broadcast(ranges), within).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("sequence") + F.floor(at / F.col("each"))).alias("sequence_id"),
        (F.col("place") + at % F.col("each") * ranked["length"]).alias("offset"),
    )


def op4_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
