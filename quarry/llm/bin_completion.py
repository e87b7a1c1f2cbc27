"""Best-fit packing by bin completion branch-and-bound (operator 11).

Documents are tokenised whole; only one longer than a window is cut, into full
windows and a last, shorter piece. A full window is a sequence of its own. All
other pieces are packed together, over the whole table: how they fit depends on
their lengths alone, and there are fewer than ``window`` different lengths,
however many documents there are. So Spark counts the pieces of each length,
one bounded search works on those counts, and its fillings are dealt back to
the pieces by their running number within their length.

The search takes the largest length left and enumerates the undominated fillings of
the room beside it (no filling where a piece left over could stand in for
smaller ones without exceeding the room, and no filling with room for one more
piece), fullest first, each repeated as often as the counts allow, or once. A
branch ends when the waste of its closed windows exceeds what the wanted number of
windows allows, or when the windows used and the lower bound of the lengths left
(Martello and Toth's L2) exceed it. Best-fit decreasing gives the first
incumbent; the wanted number moves between the lower bound and the incumbent by
halving, within a budget of steps (``WORK``, ``FILL_WORK``), after which the
incumbent stands: a budget bounds the proof of fewer windows, never the pieces.

Every piece's number is its number among the equal lengths of its task, plus those
of the tasks before: no window over a length, so a length that a third of all
pieces has is no hot key. What is sent to all tasks are the fillings: a few
thousand times at most sqrt(2 * window) lengths each, at any size of the table.

Defined cases: null and empty texts are documents of the end id alone (one token,
one piece); a repeated row is packed again as its own pieces; an empty table gives
no pieces; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm.common import prepare, row_slices, stash
from quarry.llm.packing import encoder

WINDOW = 4096
END_ID = 1
WORK = 4_000_000               # steps of the whole search; a step is one length tried in a room
FILL_WORK = 2_000              # steps for the fillings of one room, per waste class
BOUND_WORK, DOMINANCE_WORK = 100, 10       # steps that a lower bound and a dominance test count as
RANK_BITS = 48                 # a piece's number within its length, in the keys of the lookup

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint"
PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"

Filling = tuple[tuple[int, int], ...]      # (length, how often), longest first


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document; ``nth`` counts the equal lengths of a task (``part``)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        for whole in batches:
            for batch in row_slices(whole, 1):
                rows = []
                for doc, ids in zip(batch.column(0).to_pylist(), ids_of.encode(batch.column(1))):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * window)):
                        some = ids[at:at + 4 * window]
                        length = len(some) // 4
                        rows.append((doc, piece, at // 4, length, zlib.crc32(some), part, seen[length]))
                        seen[length] += 1
                kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 5
                columns = list(zip(*rows)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, PIECES)


def lower_bound(counts: np.ndarray, window: int) -> int:
    """Martello and Toth's L2: for every a up to half a window, the pieces over
    window - a stand alone, those over half a window need a window each, and the pieces
    from a to half a window need what room the latter leave, at least."""
    lengths = np.arange(len(counts))
    total = int((counts * lengths).sum())
    if total == 0:
        return 0
    half = window // 2
    number = np.concatenate([[0], np.cumsum(counts)])           # pieces shorter than i
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    a = np.arange(1, half + 1)
    alone = number[-1] - number[np.minimum(window - a + 1, len(counts))]
    over = number[np.minimum(window - a + 1, len(counts))] - number[np.minimum(half + 1, len(counts))]
    over_tokens = tokens[np.minimum(window - a + 1, len(counts))] - tokens[np.minimum(half + 1, len(counts))]
    small = tokens[np.minimum(half + 1, len(counts))] - tokens[np.minimum(a, len(counts))]
    rest = np.maximum(0, small - (over * window - over_tokens))
    best = int((alone + over + -(-rest // window)).max(initial=0))
    return max(best, -(-total // window))


def best_fit(counts: list[int], window: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over counts: (filling, number of windows) pairs. Windows of
    equal contents are handled together; a piece goes where the least room that suffices is."""
    done: list[tuple[Filling, int]] = []
    open_: dict[int, list[tuple[Filling, int]]] = {}
    rooms: list[int] = []

    def put(filling: Filling, room: int, times: int) -> None:
        if room == 0:
            done.append((filling, times))
        elif room in open_:
            open_[room].append((filling, times))
        else:
            open_[room] = [(filling, times)]
            insort(rooms, room)

    for size in range(len(counts) - 1, 0, -1):
        left = counts[size]
        while left:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                room, filling, times = window, (), left
            else:
                room = rooms[i]
                filling, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            each = room // size
            full = min(times, left // each)
            if full:
                put(filling + ((size, each),), room - each * size, full)
                left -= full * each
                times -= full
            if left and times and left < each:
                put(filling + ((size, left),), room - left * size, 1)
                times -= 1
                left = 0
            if times and filling:
                put(filling, room, times)
    for classes in open_.values():
        done += classes
    return done


def spread(bits: int, by: int) -> int:
    """``bits`` and all positions up to ``by`` above each."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        bits |= bits << step
        done += step
    return bits


class Search:
    """Depth-first bin completion over counts of lengths."""

    def __init__(self, counts: np.ndarray, window: int):
        self.window = window
        self.hist = counts.astype(np.int64)
        self.counts = [int(c) for c in counts]
        self.sizes = [s for s, c in enumerate(self.counts) if c]
        self.bits = sum(1 << s for s in self.sizes)         # lengths that are left
        self.tokens = sum(s * c for s, c in enumerate(self.counts))
        self.work = 0

    def take(self, filling: Filling, times: int) -> None:
        for size, uses in filling:
            self.counts[size] -= uses * times
            self.hist[size] -= uses * times
            self.tokens -= size * uses * times
            if self.counts[size] == 0:
                del self.sizes[bisect_left(self.sizes, size)]
                self.bits &= ~(1 << size)

    def give(self, filling: Filling, times: int) -> None:
        for size, uses in filling:
            if self.counts[size] == 0:
                insort(self.sizes, size)
                self.bits |= 1 << size
            self.counts[size] += uses * times
            self.hist[size] += uses * times
            self.tokens += size * uses * times

    def dominated(self, filling: Filling, waste: int) -> bool:
        """Whether a length left over fits into the room that stays, or can stand in for
        shorter pieces beside the largest one."""
        self.work -= DOMINANCE_WORK
        left = self.bits
        for size, uses in filling:
            if self.counts[size] == uses:
                left &= ~(1 << size)
        if left & ((2 << waste) - 1):
            return True
        one = several = 0                           # sums of one piece, of several
        for rank, (size, uses) in enumerate(filling):
            for _ in range(uses - (rank == 0)):
                several |= (several | one) << size
                one |= 1 << size
        # A length stands in for one shorter piece, or for several, within the room that stays.
        reach = spread(several, waste)
        if waste:
            reach |= spread(one << 1, waste - 1)
        return bool(reach & left)

    def fillings(self, most_waste: int) -> Iterator[tuple[Filling, int]]:
        """Undominated (filling, waste) around the largest length left, fullest first."""
        sizes, counts = self.sizes, self.counts
        largest = sizes[-1]
        room = self.window - largest
        others = self.tokens - largest
        if others <= room:                          # one window holds all the rest
            if room - others <= most_waste:
                yield tuple((s, counts[s]) for s in reversed(sizes)), room - others
            return
        fitting = sizes[:bisect_right(sizes, room)]
        have = [counts[s] - (s == largest) for s in fitting]
        reach, total = [], 0                        # tokens of all lengths up to each
        for s, n in zip(fitting, have):
            total += s * n
            reach.append(total)
        low = 0
        while low <= most_waste:
            high = min(most_waste, 8 * low)
            for chosen, waste in self.fill(fitting, have, reach, room, low, high):
                if chosen and chosen[0][0] == largest:
                    filling = ((largest, chosen[0][1] + 1),) + chosen[1:]
                else:
                    filling = ((largest, 1),) + chosen
                if not self.dominated(filling, waste):
                    yield filling, waste
            low = high + 1

    def branches(self, most_waste: int) -> Iterator[tuple[Filling, int, int]]:
        for filling, waste in self.fillings(most_waste):
            most = min(self.counts[size] // uses for size, uses in filling)
            if waste:
                most = min(most, most_waste // waste)
            yield filling, waste, most
            if most > 1:
                yield filling, waste, 1

    def fill(self, sizes: list[int], have: list[int], reach: list[int], room: int, low: int, high: int) \
            -> Iterator[tuple[Filling, int]]:
        """Sets of lengths, longest first, that leave ``low`` to ``high`` of ``room``: (set, room left)."""
        chosen: list[tuple[int, int]] = []
        budget = FILL_WORK

        def deeper(last: int, left: int) -> Iterator[tuple[Filling, int]]:
            nonlocal budget
            i = min(last, bisect_right(sizes, left) - 1)
            while i >= 0 and reach[i] >= left - high:   # else all that is left leaves too much room
                size = sizes[i]
                for uses in range(min(have[i], left // size), 0, -1):
                    budget -= 1
                    self.work -= 1
                    if budget < 0 or self.work < 0:
                        return
                    chosen.append((size, uses))
                    yield from deeper(i - 1, left - size * uses)
                    chosen.pop()
                i -= 1
            if low <= left <= high:
                yield tuple(chosen), left

        yield from deeper(len(sizes) - 1, room)

    def within(self, target: int, work: int) -> list[tuple[Filling, int]] | None:
        """(filling, number of windows) pairs of at most ``target`` windows; None if there
        are none, or ``work`` runs out. The counts are as before afterwards."""
        allowed = target * self.window - self.tokens
        path: list[tuple[Filling, int, int]] = []
        frames = [self.branches(allowed)]
        used = waste = 0
        found = None
        self.work = work
        while frames and self.work > 0 and found is None:
            if len(path) == len(frames):            # back from below: undo this frame's last branch
                filling, spare, times = path.pop()
                self.give(filling, times)
                used, waste = used - times, waste - spare * times
            branch = next(frames[-1], None)
            if branch is None:
                frames.pop()
                continue
            filling, spare, times = branch
            self.take(filling, times)
            path.append(branch)
            used, waste = used + times, waste + spare * times
            self.work -= BOUND_WORK
            if self.tokens == 0:
                found = [(f, t) for f, _, t in path]
            elif used + lower_bound(self.hist, self.window) <= target:
                frames.append(self.branches(allowed - waste))
        for filling, _, times in reversed(path):
            self.give(filling, times)
        return found


def complete(counts: np.ndarray, window: int = WINDOW, work: int = WORK) -> list[tuple[Filling, int]]:
    """Fillings and how many windows have each, of as few windows as the search finds.
    Every try may use half of the work that is left."""
    best = best_fit([int(c) for c in counts], window)
    low, high = lower_bound(counts, window), sum(times for _, times in best)
    search, target = Search(counts, window), low
    while low < high and work > BOUND_WORK:
        found = search.within(target, work // 2)
        work -= work // 2 - max(search.work, 0)
        if found is None:
            low = target + 1
        else:
            best, high = found, sum(times for _, times in found)
        target = (low + high) // 2
    return best


def intervals(best: list[tuple[Filling, int]]) -> pd.DataFrame:
    """Where the pieces of a length go: from number ``first`` on, ``uses`` a window from window
    ``sequence`` on, the first of them at ``offset``."""
    rows, windows, given = [], 0, {}
    for filling, times in best:
        offset = 0
        for size, uses in filling:
            first = given.get(size, 0)
            rows.append((size, first, uses, windows, offset))
            given[size] = first + uses * times
            offset += size * uses
        windows += times
    return pd.DataFrame(rows, columns=["length", "first", "uses", "sequence", "offset"], dtype="int64")


def pack_few(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
             window: int = WINDOW, end_id: int = END_ID, work: int = WORK) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    prepare(spark)
    table = stash(pieces(docs, tokenizer_path, id_col, text_col, window, end_id), "completion-pieces")
    short = table.filter(F.col("length") < window)
    per_part = short.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    bases = per_part.select("length", "part", before.alias("base"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(window, np.int64)
        for some in batches:
            np.add.at(counts, some["length"].to_numpy(np.int64), some["n"].to_numpy(np.int64))
        yield intervals(complete(counts, window, work))

    # Fewer than ``window`` rows reach the one task of the search, whatever the table's size.
    histogram = per_part.groupBy("length").agg(F.sum("n").alias("n")).coalesce(1)
    plan = stash(histogram.mapInPandas(solve, "length bigint, first bigint, uses bigint, sequence bigint, offset bigint"),
                 "completion-plan").toPandas().sort_values(["length", "first"])
    keys = (plan["length"].to_numpy(np.int64) << RANK_BITS) + plan["first"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((keys, plan[["first", "uses", "sequence", "offset"]].to_numpy(np.int64)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, plan = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            nth = batch.column("nth").to_numpy(zero_copy_only=False)
            first, uses, sequence, offset = plan[np.searchsorted(keys, (length << RANK_BITS) + nth, side="right") - 1].T
            window_no, slot = np.divmod(nth - first, uses)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence + window_no), pa.array(offset + slot * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    packed = (short.join(bases, ["length", "part"])
              .select(*columns, (F.col("base") + F.col("nth")).alias("nth")).mapInArrow(place, PACKED))
    # A full window is a sequence by itself, numbered by its task and its number there.
    alone = table.filter(F.col("length") == window).select(
        *columns, (F.lit(1 << 62) + F.shiftleft("part", 40) + F.col("nth")).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(alone)
