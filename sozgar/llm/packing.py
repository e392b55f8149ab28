"""Best-fit packing of token pieces into sequences by bin completion.

Packing needs only how many pieces have each length: at most ``capacity`` numbers, whatever the size of
the table. The solver works on this histogram on the driver and returns runs (a pattern of lengths and
the number of sequences that repeat it). Pieces are then ranked within their length, bucket by bucket,
and their rank names run, sequence and offset.

Solver: best-fit decreasing gives the first incumbent. Bin completion takes the longest piece left,
enumerates fillings around it, drops those that Martello and Toth's test shows dominated, and tries the
rest, least waste first, each as often as the counts allow and then less often. Branches are pruned whose
waste passes what the incumbent's number of sequences leaves, or whose lower bound passes it. The order of
the search is by discrepancy: dives that leave the first choice 0, 1, 3, 7, ... times. The first dive always
runs, and its packing is taken if it needs no more sequences than best fit.

Limits: ``WORK`` steps in all (a step places a piece in a filling), ``STEPS`` steps for the fillings of one
node (fewer where the work left would not last a dive, 64 at least), ``SHARE`` of them for each longest piece, a
dominance test for every ten,
``BRANCHES`` fillings at a node; a filling is tried n, n - 1, n / 2 and 1 times. Where none of them is met, or the lower bound is, the packing is optimal (``Packing.proven``);
else the best packing found is returned. A packing has at most 13 runs per length (each run at least halves
what is left of a length beyond the pattern), so the runs are bounded like the histogram.

Defined results: null or empty text is one piece that holds the end id alone; only texts longer than the
capacity are cut; null ids and repeated rows are packed like any row; an empty table gives an empty
result; extra columns are ignored by the query and carried by ``pack``, whatever their names.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sozgar.llm.common import Scratch, boxed, column, slices, text_bytes, unboxed
from sozgar.llm.ranking import bucket_of, bucket_totals, counted_rows, each_copy
from sozgar.llm.tokenize import encoder

CAPACITY = 4096
END_ID = 1
#: Buckets into which the pieces of one length are dealt for ranking.
LENGTH_BUCKETS = 64
#: Limits of the search: steps in all, steps for one node, steps for one longest piece, fillings tried at a node.
WORK, STEPS, SHARE, BRANCHES = 1_000_000, 600, 60, 8

Run = tuple[int, tuple[tuple[int, int], ...]]


# --- solver --------------------------------------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing on a histogram: equal open sequences are kept as one entry with a number."""
    rooms: list[int] = []
    held: dict[int, list[list]] = {}

    def put(room: int, n: int, pattern: dict[int, int]) -> None:
        if n:
            if room not in held:
                insort(rooms, room)
            held.setdefault(room, []).append([n, pattern])

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                per = capacity // size
                put(capacity - per * size, left // per, {size: per})
                if left % per:
                    put(capacity - left % per * size, 1, {size: left % per})
                break
            room = rooms[k]
            n, pattern = held[room].pop()
            if not held[room]:
                del held[room]
                rooms.pop(k)
            per = room // size
            full = min(n, left // per)
            put(room - per * size, full, pattern | {size: per})
            left -= full * per
            if full < n and left:
                put(room - left * size, 1, pattern | {size: left})
                full, left = full + 1, 0
            put(room, n - full, pattern)
    return [(n, tuple(sorted(p.items(), reverse=True))) for groups in held.values() for n, p in groups]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Total length, and Martello and Toth's bound: pieces that cannot share with those above a threshold."""
    if not counts:
        return 0
    sizes = np.array(sorted(counts), np.int64)
    number = np.array([counts[s] for s in sizes.tolist()], np.int64)
    rows = np.concatenate([[0], np.cumsum(number)])
    length = np.concatenate([[0], np.cumsum(number * sizes)])
    middle = np.searchsorted(sizes, capacity // 2, "right")  # sizes before it fit twice
    small = np.concatenate([[0], sizes[:middle]])
    low, high = np.searchsorted(sizes, small, "left"), np.maximum(np.searchsorted(sizes, capacity - small, "right"), middle)
    half = rows[high] - rows[middle]
    free = half * capacity - (length[high] - length[middle])
    rest = length[middle] - length[np.minimum(low, middle)]
    shared = np.maximum(0, -(-(rest - free) // capacity))
    return max(-(-int(length[-1]) // capacity), int((rows[-1] - rows[high] + half + shared).max()))


def dominated(filling: dict[int, int], room: int, present: int, counts: dict[int, int]) -> bool:
    """Martello and Toth's dominance: whether a piece left out can take the place of some pieces of the filling.

    It can where it is longer than they are together and still fits, or as long as several of them (then the
    several are the easier to place elsewhere). Sums of subsets are bits of an integer; ``present`` has the bits
    of the lengths that are left.
    """
    held = sum(s * m for s, m in filling.items())
    some = several = 0  # sums of one or more pieces, of two or more
    out = present & ((1 << (room + 1)) - 1)
    for s, m in filling.items():
        if counts[s] == m:
            out &= ~(1 << s)
        for _ in range(m):
            several |= some << s
            some |= (some << s) | (1 << s)
    spare = room - held
    if several & out:
        return True
    if not spare:
        return False
    longer = (some | 1) << 1  # sums a piece longer, up to what is spare
    width = 1
    while width < spare:
        step = min(width, spare - width)
        longer |= longer << step
        width += step
    return bool(longer & out)


class _Steps:
    """Work that may still be done."""

    def __init__(self, most: int):
        self.most, self.done = most, 0


def fillings(room: int, sizes: list[int], counts: dict[int, int], present: int, wanted: int, steps: int, share: int) -> tuple[list[dict[int, int]], bool, int]:
    """Undominated fillings of ``room``, least waste first, longer pieces first; whether none was passed over; steps taken.

    Each longest piece of a filling is given ``share`` steps, all together ``steps``; at most ``wanted`` are returned.
    """
    top = bisect_right(sizes, room)
    if not top:
        return [{}], True, 1
    if room in counts and counts[room]:
        return [{room: 1}], True, 1  # it dominates all others
    least = 2 * sizes[0] if counts[sizes[0]] > 1 else sizes[0] + (sizes[1] if len(sizes) > 1 else room)
    if least > room:
        return [{sizes[top - 1]: 1}], True, 1  # one piece fits, and the longest dominates
    found: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    taken, whole = 0, True

    def go(left: int, k: int, chosen: tuple[tuple[int, int], ...], budget: _Steps) -> None:
        """Fillings of ``left`` by the sizes before the k-th."""
        budget.done += 1
        exact = counts.get(left, 0) if left and (k >= len(sizes) or left < sizes[k]) else 0
        if exact:
            found.append((0, (*chosen, (left, 1))))
            return  # for this choice of longer pieces it dominates the rest
        k = min(bisect_right(sizes, left), k) - 1
        if k < 0:
            found.append((left, chosen))
            return
        while k >= 0:
            size = sizes[k]
            for n in range(min(counts[size], left // size), 0, -1):
                go(left - n * size, k, (*chosen, (size, n)), budget)
                if budget.done > budget.most:
                    return
            k -= 1

    for k in range(top - 1, -1, -1):
        size = sizes[k]
        mine = _Steps(min(share, steps - taken))
        for n in range(min(counts[size], room // size), 0, -1):
            go(room - n * size, k, ((size, n),), mine)
            if mine.done > mine.most:
                break
        taken += mine.done
        whole &= mine.done <= mine.most
        perfect = sum(w == 0 for w, _ in found)
        if taken >= steps or perfect >= 2 * wanted:
            whole = whole and k == 0
            break
    found = sorted(set(found), key=lambda x: (x[0], [(-s, -m) for s, m in x[1]]))
    kept, tests = [], max(8, steps // 10)
    for n, (_, pattern) in enumerate(found):
        if n == tests:
            whole = False
            break
        taken += 10  # a test costs about so many steps
        if not dominated(dict(pattern), room, present, counts):
            kept.append(dict(pattern))
            if len(kept) == wanted:
                whole &= n == len(found) - 1
                break
    return kept or [dict(found[0][1])], whole, taken


@dataclass
class Packing:
    """A packing: runs, their number of sequences, the lower bound, what best fit needs, the nodes visited, and who found it."""

    runs: list[Run]
    sequences: int
    bound: int
    best_fit: int
    nodes: int
    found_by: str
    proven: bool


def search(counts: dict[int, int], capacity: int = CAPACITY, work: int = WORK, branches: int = BRANCHES, steps: int = STEPS, share: int = SHARE) -> Packing:
    """Bin completion with best fit as the first incumbent; see the module's text for the limits."""
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return Packing([], 0, 0, 0, 0, "best fit", True)
    best = best_fit(counts, capacity)
    most = first = sum(n for n, _ in best)
    bound, total = lower_bound(counts, capacity), sum(s * n for s, n in counts.items())
    name, salt = "best fit", random.Random(0)
    hashes = {s: salt.getrandbits(64) for s in counts}
    sizes, present = sorted(counts), sum(1 << s for s in counts)
    path: list[Run] = []
    seen: dict[int, tuple[int, int]] = {}
    state = sum(hashes[s] * n for s, n in counts.items())
    used = wasted = nodes = done = 0
    whole = True

    def take(run: Run, sign: int) -> None:
        nonlocal present, used, wasted, state
        n, pattern = run
        for s, m in pattern:
            was = counts[s]
            counts[s] = was - sign * n * m
            state -= sign * hashes[s] * n * m
            if not counts[s]:
                sizes.pop(bisect_left(sizes, s))
                present &= ~(1 << s)
            elif not was:
                insort(sizes, s)
                present |= 1 << s
        used += sign * n
        wasted += sign * n * (capacity - sum(s * m for s, m in pattern))

    def options(goal: int, wanted: int) -> list[Run]:
        nonlocal done, whole
        ahead = min(goal - used, 4 * len(sizes)) + 1  # nodes to the end of the dive, about
        effort = min(steps, max(64, (work - done) // (3 * ahead)))
        top = sizes[-1]
        counts[top] -= 1
        inner, left = (sizes, present) if counts[top] else (sizes[:-1], present & ~(1 << top))
        some, complete, took = fillings(capacity - top, inner, counts, left, wanted, effort, min(share, max(8, effort // 10)))
        counts[top] += 1
        done += took + 8
        whole &= complete
        often, seldom = [], []
        for filling in some:
            pattern = dict(filling)
            pattern[top] = pattern.get(top, 0) + 1
            key = tuple(sorted(pattern.items(), reverse=True))
            n = min(counts[s] // m for s, m in key)
            often.append((n, key))
            seldom += [(k, key) for k in sorted({n - 1, n // 2, 1} - {0, n}, reverse=True)]
            whole &= n <= 4  # between these, repetitions are passed over
        return often + seldom

    def dive(turns: int, goal: int) -> tuple[list[Run] | None, bool]:
        """A packing into at most ``goal`` sequences that leaves the first choice at most ``turns`` times; whether more turns could matter."""
        nonlocal nodes
        cut = not turns  # the first dive sees one filling at each node
        wanted = branches if turns else 1
        stack = [[options(goal, wanted), 0, turns]]
        while stack:
            frame = stack[-1]
            choices, k, left = frame
            if k >= len(choices) or (k and not left) or done > work:
                cut |= k < len(choices)
                stack.pop()
                if path:
                    take(path.pop(), -1)
                continue
            frame[1] += 1
            run = choices[k]
            waste = run[0] * (capacity - sum(s * m for s, m in run[1]))
            if wasted + waste > goal * capacity - total:
                continue
            take(run, 1)
            path.append(run)
            nodes += 1
            if not sizes:
                result = list(path) if used <= goal else None
                if result is not None:
                    while path:
                        take(path.pop(), -1)
                    return result, cut
                take(path.pop(), -1)
                continue
            left -= k > 0
            known = seen.get(state)
            hopeless = known is not None and known[0] <= used and known[1] >= left
            if not hopeless and (turns or len(sizes) <= 64):
                hopeless = used + lower_bound({s: counts[s] for s in sizes}, capacity) > goal
            if hopeless:
                take(path.pop(), -1)
                continue
            seen[state] = (used, left)
            stack.append([options(goal, wanted), 0, left])
        return None, cut

    turns, goal = 0, most  # the first dive may equal best fit: then its packing is taken
    while True:
        seen.clear()
        found, cut = dive(turns, goal)
        if found is not None:
            best, most, name = found, sum(n for n, _ in found), "bin completion"
        if most == bound or done > work or (found is None and not cut and goal < most):
            break
        goal = most - 1
        if found is None:
            turns = 2 * turns + 1
    return Packing(best, most, bound, first, nodes, name, most == bound or (whole and done <= work))


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, **limits: int) -> list[Run]:
    """Runs that pack the histogram into as few sequences as the bounded search finds."""
    return search(counts, capacity, **limits).runs


# --- DataFrame operators -------------------------------------------------------------------------


def token_pieces(df: DataFrame, doc_id: str, text: str, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each text's ids and the end id, cut at the capacity."""

    def cut(batches):
        encode = encoder(tokenizer).ids
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, text):
            keys, rows = batch.column(doc_id), []
            for i, ids in enumerate(encode(text_bytes(batch.column(text)))):
                ids += end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((i, p, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(columns[0], pa.int32())), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], [doc_id, "piece", "start", "length", "ids_crc32"]
            )

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(doc_id, text).mapInArrow(cut, f"`{doc_id}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, length: str, tie: list[str], capacity: int = CAPACITY, work: int = WORK) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. ``pieces`` should be a written table, as it is read twice; ``tie`` tells rows apart."""
    spark = pieces.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy(column(length)).count().collect()}  # at most ``capacity`` rows
    if any(s < 1 or s > capacity for s in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    runs, first = [], 0
    ranks = dict.fromkeys(counts, 0)
    for n, pattern in bin_completion(counts, capacity, work=work):
        offset = 0
        for size, times in pattern:
            runs.append((size, ranks[size], first, times, offset))
            ranks[size] += n * times
            offset += size * times
        first += n
    runs.sort()
    table = spark.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 5))

    def place(batches):
        t = table.value
        keys = t[:, 0] * (1 << 48) + t[:, 1]
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "rank"))
            run = t[np.searchsorted(keys, size * (1 << 48) + rank, "right") - 1] if len(t) else np.zeros((0, 5), np.int64)
            turn, within = np.divmod(rank - run[:, 1], np.maximum(run[:, 3], 1))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(run[:, 2] + turn), pa.array(run[:, 4] + within * size)], ["row", "sequence_id", "offset"])

    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(*map(column, keep))
    ties = [column(c) for c in tie]
    unit = F.shiftrightunsigned(F.xxhash64(*ties), 11) / F.lit(float(1 << 53))
    rows = pieces.select(boxed(pieces), column(length).cast("long").alias("size"), F.struct(*ties).alias("tie"), unit.alias("unit")).withColumn("bucket", bucket_of(F.col("unit"), LENGTH_BUCKETS))
    rows = counted_rows(rows)
    totals = bucket_totals(rows, ["size"], F.col("m")).select("size", "bucket", "amount_before")
    before = Window.partitionBy("size", "bucket").orderBy("unit", "tie").rowsBetween(Window.unboundedPreceding, -1)
    ranked = each_copy(rows.withColumn("local", F.coalesce(F.sum("m").over(before), F.lit(0))).join(totals, ["size", "bucket"]))
    ranked = ranked.select("row", "size", (F.col("amount_before") + F.col("local") + F.col("copy")).cast("long").alias("rank"))
    schema = T.StructType([T.StructField("row", pieces.schema), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema).select(*unboxed(pieces, keep), "sequence_id", "offset")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    pieces = Scratch(docs.sparkSession, "pack").write(token_pieces(docs, "doc_id", "text", tokenizer, capacity), "pieces")
    return pack(pieces, "length", ["doc_id", "piece", "ids_crc32"], capacity)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
