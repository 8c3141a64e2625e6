"""Best-fit packing of token sequences by bin completion.

Documents become token ids; those longer than a sequence are cut into full pieces and a rest. How many pieces there are of
each length (at most `capacity` lengths) is all the driver sees. Best-fit decreasing over this histogram, or best fit
bin by bin where that is better, is the incumbent;
where it needs more sequences than a lower bound, a branch and bound over sequences enumerates undominated fillings around
the largest piece left, says how often each is used, and prunes by the waste that a better plan may have and by the bound.
It ends when it meets the bound, has tried all, or has opened NODES nodes; Packing says which, and the gap. The pieces then
find their places by their number among those of equal length, so no group of pieces meets in one task.

A null text is an empty one; an empty text is one piece, the end id alone. Equal rows are packed each for itself. A null
id stays null. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, number_rows, slices, table

CAPACITY, END_ID = 2048, 0
#: Bytes of chunks and their ids, as counted here, that a worker remembers.
REMEMBERED, ENTRY = 96 << 20, 200
#: Nodes that the branch and bound may open, on the driver, where best fit needs more sequences than the lower bound; a
#: filling's search counts once more for each LENGTHS lengths, up to which the lower bound is taken at each node.
NODES, LENGTHS = 300_000, 64

#: A stop or comma after an ASCII letter and before white space or the end is a chunk of its own for the tokenizer.
STOP = re.compile(r"(?<=[A-Za-z])([.,])(?=[ \n]|$)")


class ChunkTokenizer:
    """The tokenizer's ids of whole texts, chunk by chunk; for tokenizers whose pre-tokenizer drops white space.

    No token crosses white space there, so that chunks between spaces are encoded apart, and their ids remembered.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.held = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        known, found, missing = self.known, [], set()
        for t in texts:
            if "Σ" not in t and "İ" not in t:  # these two have lower cases that depend on more than the letter
                t = t.lower()
            chunks = STOP.sub(r" \1", t).replace("\n", " ").replace("\t", " ").split(" ")
            got = list(map(known.get, chunks))
            if None in got:
                missing.update(c for c, g in zip(chunks, got, strict=True) if g is None)
            else:
                chunks = None
            found.append((chunks, got))
        now, new = {}, list(missing)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for c, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                now[c] = array("I", e.ids).tobytes()
        if (size := sum(ENTRY + 5 * len(c) for c in new)) + self.held > REMEMBERED:
            known.clear()
            known[""] = b""
            self.held = 0
        if size <= REMEMBERED:
            known.update(now)
            self.held += size
        return [b"".join([now[c] if g is None else g for c, g in zip(chunks, got, strict=True)] if chunks else got) for chunks, got in found]


@cache
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids as little-endian bytes) of each piece."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tok = chunk_tokenizer(tokenizer)
        for batch in slices(batches, 1, most=2 << 20):
            rows: list[tuple] = []
            for d, ids in zip(batch.column(0).to_pylist(), tok.encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                ids += END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((d, k, at // 4, len(part) // 4, zlib.crc32(part), *[part] * keep_ids))
            columns = list(zip(*rows, strict=True)) or [[]] * (5 + keep_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: by tokens, and by pieces of over half a sequence with what cannot join them."""
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    lengths = sorted(counts)
    for k in [x for x in lengths if 2 * x <= capacity]:
        alone = sum(c for n, c in counts.items() if n > capacity - k)
        shared = {n: c for n, c in counts.items() if capacity - k >= n > capacity / 2}
        room = sum((capacity - n) * c for n, c in shared.items())
        small = sum(n * c for n, c in counts.items() if k <= n <= capacity / 2)
        best = max(best, alone + sum(shared.values()) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over the histogram: fillings and how often each is used.

    A piece goes where the least room is left; what stays there is the least room for the next piece of the same length
    while it fits, so that equal sequences fill up together.
    """
    by_room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, filling: tuple, times: int) -> None:
        if times:
            if room not in by_room:
                insort(rooms, room)
                by_room[room] = []
            by_room[room].append((filling, times))

    for n in sorted((n for n, c in counts.items() if c), reverse=True):
        count, at, filled = counts[n], bisect_left(rooms, n), []
        while count and at < len(rooms):
            room = rooms[at]
            each = room // n
            groups = by_room.pop(room)
            del rooms[at]
            left = []
            for filling, times in groups:
                full = min(times, count // each)
                filled.append((room - each * n, (*filling, (n, each)), full))
                count -= full * each
                if full < times and 0 < count < each:
                    filled.append((room - count * n, (*filling, (n, count)), 1))
                    full, count = full + 1, 0
                left.append((filling, times - full))
            for filling, times in left:
                put(room, filling, times)
            if room in by_room:
                at += 1
        each = capacity // n
        filled.append((capacity - each * n, ((n, each),), count // each))
        if count % each:
            filled.append((capacity - count % each * n, ((n, count % each),), 1))
        for x in filled:
            put(*x)
    return [(list(filling), times) for room in rooms for filling, times in by_room[room]]


def bin_by_bin(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Each filling around the largest piece left takes the largest piece that fits, again and again, and is used while it can be."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c}
    plan = []
    while left:
        room, filling = capacity, []
        for n, c in left.items():
            if n <= room:
                filling.append((n, k := min(c, room // n)))
                room -= n * k
                if not room:
                    break
        times = min(left[n] // k for n, k in filling)
        plan.append((filling, times))
        for n, k in filling:
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return plan


class Spent(Exception):
    """The search has opened all its nodes."""


class Search:
    """Bin completion over the histogram `left` of pieces that are still to be packed.

    At each node the largest piece left is packed: undominated fillings around it are enumerated, and each is used as often
    as it can be, or less often. A filling that was used is not taken again below for pieces of the same length, and those
    before it are not either, so that no set of fillings is met twice. What the sequences may waste in all, if they are to be
    fewer than the best known, bounds both the fillings and the branches.
    """

    def __init__(self, counts: dict[int, int], capacity: int, nodes: int) -> None:
        self.left = {n: c for n, c in sorted(counts.items(), reverse=True) if c}
        self.capacity, self.nodes = capacity, nodes

    def open(self, cost: int = 1) -> None:
        self.nodes -= cost
        if self.nodes < 0:
            raise Spent

    def dominated(self, taken: list[tuple[int, int]], slack: int) -> bool:
        """Whether pieces of the filling (one, several or none) can give way to a larger one that is left and fits."""
        sums = 1
        for n, k in taken:
            for _ in range(k):
                sums |= sums << n
        used = dict(taken)
        for x, c in self.left.items():
            if c > used.get(x, 0):
                # sums from x - slack to x; x itself stands for x where the filling holds it
                high = x - 1 if x in used else x
                low = max(0, x - slack)
                if low <= high and sums >> low & (1 << (high - low + 1)) - 1:
                    if high == x and low == x and self.only(taken, x):
                        continue
                    return True
        return False

    @staticmethod
    def only(taken: list[tuple[int, int]], x: int) -> bool:
        """Whether x is no sum of several pieces of the filling."""
        return not any(n < x for n, _ in taken)

    def fillings(self, room: int, most: int, exact: bool) -> Iterator[tuple[list[tuple[int, int]], int]]:
        """Undominated fillings of the room and their waste: those without any, or those of 1 to `most`; larger pieces first."""
        self.open(len(self.left) // LENGTHS)
        lengths = [n for n, c in self.left.items() if c and n <= room]
        rest = np.cumsum([n * self.left[n] for n in reversed(lengths)])[::-1].tolist() + [0]
        low, high = (0, 0) if exact else (1, most)

        def dive(at: int, room: int, taken: list[tuple[int, int]]) -> Iterator[tuple[list[tuple[int, int]], int]]:
            self.open()
            for i in range(at, len(lengths)):
                if room - rest[i] > high:
                    return
                n = lengths[i]
                if n <= room:
                    for k in range(min(self.left[n], room // n), 0, -1):
                        yield from dive(i + 1, room - k * n, [*taken, (n, k)])
            if low <= room <= high and not self.dominated(taken, room):
                yield taken, room

        yield from dive(0, room, [])

    def branches(self, waste: int, after: tuple | None) -> Iterator[tuple[tuple, dict[int, int], int, int]]:
        """Order, filling, times and waste of each branch from here; after: the order of the filling that was used above."""
        big = next((n for n, c in self.left.items() if c), 0)
        if not big:
            return
        for exact in (True, False):
            if not exact and not waste:
                return
            self.left[big] -= 1
            found = self.fillings(self.capacity - big, waste, exact)
            while True:
                got = next(found, None)
                self.left[big] += 1
                if got is None:
                    break
                taken, lost = got
                order = (big, not exact, [(-n, -k) for n, k in taken])
                if after is None or after[0] != big or order[1:] > after[1:]:
                    filling = dict(taken)
                    filling[big] = filling.get(big, 0) + 1
                    most = min(self.left[n] // k for n, k in filling.items())
                    if lost:
                        most = min(most, waste // lost)
                    for times in range(most, 0, -1):
                        yield order, filling, times, lost
                self.left[big] -= 1

    def below(self, best: int, bound: int) -> list[tuple[dict[int, int], int]] | None:
        """Fillings and times that need fewer than `best` sequences, as few as `bound` if the nodes allow; None if there are none."""
        total, plan = sum(n * c for n, c in self.left.items()), None
        path: list[tuple[dict[int, int], int, int]] = []
        waste = (best - 1) * self.capacity - total
        todo = [self.branches(waste, None)]
        try:
            while todo and best > bound:
                branch = next(todo[-1], None)
                if branch is None:
                    todo.pop()
                    if path:
                        filling, times, lost = path.pop()
                        waste += lost * times
                        for n, k in filling.items():
                            self.left[n] += k * times
                    continue
                order, filling, times, lost = branch
                self.open()
                if lost * times > waste:  # a better plan was found since
                    continue
                path.append((filling, times, lost))
                waste -= lost * times
                for n, k in filling.items():
                    self.left[n] -= k * times
                used = sum(t for _, t, _ in path)
                if not any(self.left.values()):
                    plan = [(f, t) for f, t, _ in path]
                    waste -= (best - used) * self.capacity
                    best = used
                    todo.append(iter(()))
                elif len(self.left) <= LENGTHS and used + lower_bound(self.left, self.capacity) >= best:  # the token bound is the waste
                    todo.append(iter(()))
                else:
                    todo.append(self.branches(waste, order))
        except Spent:
            pass
        return plan


class Packing(NamedTuple):
    """Fillings ((length, how many) of each) with how often each is used, their number, and how many are needed at least.

    `sequences` is the least possible if it equals `bound` or the search ended within its nodes (`proven`).
    """

    fillings: list[tuple[list[tuple[int, int]], int]]
    sequences: int
    bound: int
    proven: bool


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = NODES) -> Packing:
    """As few sequences as the search finds within its nodes; best fit where it finds no fewer."""
    bound = lower_bound(counts, capacity)
    plan = min((f(counts, capacity) for f in (best_fit, bin_by_bin)), key=lambda p: sum(t for _, t in p))
    used = sum(t for _, t in plan)
    proven = used == bound
    if not proven:
        search = Search(counts, capacity, nodes)
        if better := search.below(used, bound):
            plan = [(sorted(filling.items(), reverse=True), times) for filling, times in better]
            used = sum(t for _, t in plan)
        proven = used == bound or search.nodes >= 0
    return Packing(plan, used, bound, proven)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found (a written table with doc_id, piece and length) with sequence_id and offset."""
    counts = {r[0]: r[1] for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = bin_completion(counts, capacity).fillings
    segments, first, seen = [], 0, dict.fromkeys(counts, 0)
    for filling, times in plan:
        offset = 0
        for n, k in filling:
            segments.append((n, seen[n], first, k, offset))
            seen[n] += k * times
            offset += n * k
        first += times
    seg = np.array(sorted(segments), np.int64).reshape(-1, 5)
    keys = seg[:, 0] << np.int64(44) | seg[:, 1]

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            s = seg[np.searchsorted(keys, n << np.int64(44) | rank, "right") - 1]
            at = rank - s[:, 1]
            batch = batch.drop_columns(["__rank"])
            yield batch.append_column("sequence_id", pa.array(s[:, 2] + at // s[:, 3])).append_column("offset", pa.array(s[:, 4] + at % s[:, 3] * n))

    numbered = number_rows(found, "length", ["doc_id", "piece", "start"], "__rank").select(*found.columns, "__rank")
    return numbered.mapInArrow(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long")


def op4_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(materialise(found, "pieces"))
