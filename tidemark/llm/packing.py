"""Best-fit packing after Martello and Toth's dominance reduction, on the numbers of pieces of each length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import gapless, read, written
from ._tokens import encoder, slices, vocabulary_path
from ._words import released

CAPACITY = 2048
#: Pieces that one task ranks at once.
RANK_ROWS = 50_000


@dataclass
class Pattern:
    """`times` sequences that hold the same lengths: (length, number) in the order of their places."""

    times: int
    items: list[tuple[int, int]] = field(default_factory=list)


def reduce_by_dominance(left: list[int], capacity: int) -> list[Pattern]:
    """Fixes sequences that some optimal packing holds, taking their pieces from left (pieces of each length).

    For the longest piece x first: alone if nothing fits beside it; with its exact complement; with the longest piece y that fits, if only one
    fits, or if at most two fit and no two of them are longer than y. Each such set dominates all others that hold x.
    """
    fixed = []
    for x in range(capacity, 0, -1):
        while left[x]:
            present = [n for n in range(1, capacity + 1) if left[n]]

            def smallest(k: int, x: int = x, present: list[int] = present) -> int:
                """Sum of the k shortest other pieces; more than fits if there are fewer."""
                total = 0
                for n in present:
                    have = min(k, left[n] - (n == x))
                    total, k = total + n * have, k - have
                    if not k:
                        return total
                return capacity + 1

            room = capacity - x
            if smallest(1) > room:
                fixed.append(Pattern(left[x], [(x, 1)]))
                left[x] = 0
                break
            y = next(n for n in reversed(present) if n <= room and left[n] - (n == x) > 0)
            if y != room and smallest(2) <= room:
                if smallest(3) <= room:
                    break
                bits = sum(1 << n for n in present)
                pairs = 0
                for n in present:
                    other = bits if left[n] - (n == x) > 1 else bits & ~(1 << n)
                    pairs |= (other << n) if left[n] - (n == x) > 0 else 0
                if (pairs & ((1 << (room + 1)) - 1)).bit_length() - 1 > y:
                    break
            times = left[x] // 2 if y == x else min(left[x], left[y])
            fixed.append(Pattern(times, [(x, 2)] if y == x else [(x, 1), (y, 1)]))
            left[x] -= times * (1 + (y == x))
            left[y] -= times * (y != x)
    return fixed


def best_fit(left: list[int], capacity: int) -> list[Pattern]:
    """Best fit, longest first, of left pieces of each length; equal sequences are handled together."""
    open_: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(pattern: Pattern, room: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append(pattern)

    for n in range(capacity, 0, -1):
        while left[n]:
            at = bisect_left(rooms, n)
            room = rooms[at] if at < len(rooms) else capacity
            if at < len(rooms):
                pattern = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                pattern = Pattern(left[n])
            each = min(room // n, left[n])
            times = min(pattern.times, left[n] // each)
            if times < pattern.times and at < len(rooms) + 1 and pattern.items:
                put(Pattern(pattern.times - times, pattern.items), room)
            put(Pattern(times, [*pattern.items, (n, each)]), room - each * n)
            left[n] -= each * times
    return [p for r in rooms for p in open_[r]]


def plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """(length, first, sequence, each, offset): pieces of a length with ranks from `first` on go `each` to a sequence, from `sequence` on, at `offset`.

    Depends on the numbers of lengths up to the capacity only, so its size and time are bounded whatever the number of documents.
    """
    left = [0] * (capacity + 1)
    for n, c in counts.items():
        left[n] = c
    rows, ranks, sequence = [], [0] * (capacity + 1), 0
    for p in reduce_by_dominance(left, capacity) + best_fit(left, capacity):
        offset = 0
        for n, each in p.items:
            rows.append((n, ranks[n], sequence, each, offset))
            ranks[n] += each * p.times
            offset += each * n
        sequence += p.times
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "each", "offset"]).astype("int64").sort_values(["length", "first"])


def _pieces(path: str, end_id: int | None, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for at, end in slices(batch.column(1)):
                ids, sizes = coder.encode(batch.column(1).slice(at, end - at))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(sizes), end_id)
                    sizes = sizes + 1
                many = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), many)
                piece = np.arange(len(doc)) - (np.cumsum(many) - many)[doc]
                start = piece * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                first = (np.cumsum(sizes) - sizes)[doc] + start
                plain = ids.astype("<u4").tobytes()
                cut = [plain[4 * a : 4 * (a + n)] for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).slice(at, end - at).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(cut, pa.binary())] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
        released()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids as little-endian uint32 bytes if with_ids), a row for each piece.

    A document is its ids and end_id; only longer ones are cut, at multiples of the capacity. The numbers of pieces of each length, at most
    `capacity` of them, are all that the plan needs: dominance reduction, then best fit. Pieces find their place by their rank among
    pieces of their length, which is counted in chunks. Null text counts as empty; with end_id None, an empty document has no piece. Null ids and
    rows that repeat an id are documents of their own. No rows give no rows. Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = written(source.mapInArrow(_pieces(tokenizer, end_id, capacity, with_ids), schema), "pieces")
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = plan(counted, capacity)
    chunks = 1 + max(counted.values(), default=0) // RANK_ROWS
    ranked = gapless(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    lengths, firsts = table["length"].to_numpy(), table["first"].to_numpy()
    sequences, eachs, offsets = (table[c].to_numpy() for c in ("sequence", "each", "offset"))
    key = lengths.astype(np.float64) * 2.0**40 + firsts

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n, rank = part["length"].to_numpy(), part["rank"].to_numpy()
            at = np.searchsorted(key, n.astype(np.float64) * 2.0**40 + rank, "right") - 1
            more = rank - firsts[at]
            yield part.drop(columns="rank").assign(sequence_id=sequences[at] + more // eachs[at], offset=offsets[at] + more % eachs[at] * n)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return ranked.select(*names, "rank").mapInPandas(place, schema + ", sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
