"""Packing documents into fixed windows by minimum bin slack over the multiset of remaining lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import materialize, whole_text
from graphloom.llm.tokens import END, encoder

#: Tokens of a sequence.
CAPACITY = 2048
#: Documents of a block, within which they are ranked.
RANKED = 2_000

#: Slack in a window that is padded rather than filled with the head of a cut piece.
TOLERANCE = 15

_TOKENS = "doc_id long, doc_tokens long, full_crc array<long>, rest int, rest_crc long, rest_ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Encode each document and cut it every `capacity` ids: checksums of the full pieces, and the rest's ids.

    The rest's ids take two bytes each where all of them fit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(vocabulary), np.array([END], np.uint32).tobytes()
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary())
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part, rows = b.slice(k, 1024), []
                for i, ids in zip(part.column(0).to_pylist(), code.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    cut = len(ids) // (4 * capacity) * 4 * capacity
                    full = [zlib.crc32(ids[j : j + 4 * capacity]) for j in range(0, cut, 4 * capacity)]
                    rest = np.frombuffer(ids[cut:], np.uint32)
                    short = rest.astype(np.uint16).tobytes() if len(rest) and rest.max() < 1 << 16 else ids[cut:]
                    rows.append((i, len(ids) // 4, full, len(rest), zlib.crc32(ids[cut:]), short))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "doc_tokens", "full_crc", "rest", "rest_crc", "rest_ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(run, _TOKENS)


def fill(counts: np.ndarray, goal: int) -> np.ndarray:
    """How many to take of each length 1.. so that they sum up closest to `goal` without passing it.

    Each length's pieces come in bundles of powers of two, the longest lengths first, so that a multiset is a choice
    among bundles. One large integer is the bitset of sums that the bundles so far can reach; from the best sum the
    choices are traced back.
    """
    bundles, reach = [], [1]
    mask = (1 << (goal + 1)) - 1
    for length in np.flatnonzero(counts[: goal + 1])[::-1].tolist():
        n, size = min(int(counts[length]), goal // length), 1
        while n > 0 and not reach[-1] >> goal & 1:
            take = min(size, n)
            now = reach[-1] | (reach[-1] << (length * take)) & mask
            if now != reach[-1]:
                bundles.append((length, take))
                reach.append(now)
            n, size = n - take, 2 * size
    chosen, at = np.zeros(len(counts), np.int64), reach[-1].bit_length() - 1
    for (length, take), before in zip(reversed(bundles), reversed(reach[:-1]), strict=True):
        if not before >> at & 1:
            chosen[length] += take
            at -= length * take
    return chosen


def plan_windows(counts: np.ndarray, capacity: int = CAPACITY, tolerance: int = TOLERANCE) -> list[tuple[int, np.ndarray, int, int]]:
    """Windows (times, pieces by length, cut, head) that use up `counts[l]` pieces of each length l < capacity.

    A window takes the longest length left and what fills it closest to the capacity, as often as the pieces allow. If
    over `tolerance` stays empty, it also takes the first `head` ids of a piece of length `cut` (0: none); that piece's
    tail goes back to the pieces. Each pattern uses up a length but for fewer pieces than one window takes of it.
    """
    left, plan, sizes = counts.astype(np.int64).copy(), [], np.arange(len(counts))
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        pattern = fill(left, capacity - longest)
        left[longest] += 1
        pattern[longest] += 1
        slack = capacity - int((pattern * sizes).sum())
        used, after = pattern.copy(), left - pattern
        cut = head = 0
        if slack > tolerance and after.any():
            cut, head = int(np.flatnonzero(after)[-1]), slack  # longer than the slack, or the window would hold it
            used[cut] += 1
        times = int((left[used > 0] // used[used > 0]).min())
        left -= times * used
        if cut:
            left[cut - head] += times
        plan.append((times, pattern, cut, head))
    return plan


def _slots(plan: list[tuple[int, np.ndarray, int, int]], counts: np.ndarray) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, copies a window, offset, head, first rank of the tail).

    head 0: the pieces are whole. Tails are ranked behind the pieces that were there before.
    """
    slots, sequence, taken, made = {}, 0, {}, counts.astype(np.int64).copy()
    for times, pattern, cut, head in plan:
        offset = 0
        for length in np.flatnonzero(pattern)[::-1].tolist():
            copies = int(pattern[length])
            slots.setdefault(length, []).append((taken.get(length, 0), sequence, copies, offset, 0, 0))
            taken[length] = taken.get(length, 0) + times * copies
            offset += copies * length
        if cut:
            slots.setdefault(cut, []).append((taken.get(cut, 0), sequence, 1, offset, head, int(made[cut - head])))
            taken[cut] = taken.get(cut, 0) + times
            made[cut - head] += times
        sequence += times
    return {k: np.array(v, np.int64) for k, v in slots.items()}


def _placed(rest: np.ndarray, rank: np.ndarray, slots: dict[int, np.ndarray]) -> np.ndarray:
    """Rows (row, start within the rest, length, sequence, offset) for all pieces of the rests of given ranks."""
    row, start, out = np.flatnonzero(rest > 0), np.zeros(int((rest > 0).sum()), np.int64), []
    rest, rank = rest[row], rank[row]
    while len(row):
        length, seq, offset, tail = rest.copy(), np.zeros_like(rank), np.zeros_like(rank), np.zeros_like(rank)
        for size in np.unique(rest).tolist():
            at, s = np.flatnonzero(rest == size), slots[size]
            k = s[np.searchsorted(s[:, 0], rank[at], "right") - 1]
            over = rank[at] - k[:, 0]
            seq[at], offset[at] = k[:, 1] + over // k[:, 2], k[:, 3] + over % k[:, 2] * size
            length[at] = np.where(k[:, 4] > 0, k[:, 4], size)
            tail[at] = k[:, 5] + over
        out.append(np.stack([row, start, length, seq, offset], axis=1))
        more = length < rest
        row, start, rest, rank = row[more], (start + length)[more], (rest - length)[more], tail[more]
    return np.concatenate(out) if out else np.zeros((0, 5), np.int64)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Return one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Full pieces are sequences of their own. The rests' lengths, of which there are fewer than `capacity` whatever the
    corpus, are counted; the driver plans windows from these counts; a rest finds its place by its rank among those of
    its length, which is the count in earlier blocks plus its rank in its own block. Null texts are empty, one id;
    repeated rows are packed each; an empty table gives an empty result; other columns are ignored.
    """
    rows = materialize(token_pieces(docs, doc_id, text, capacity, vocabulary), "tokens")
    blocks = rows.count() // RANKED + 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "rest_crc"), F.lit(blocks)).cast("int")).withColumn("full", F.size("full_crc"))
    counts, base, fulls = np.zeros(capacity, np.int64), {}, 0
    sizes = rows.groupBy("rest").agg(F.count("*"), F.sum("full")).collect()  # at most `capacity` rows
    for length, n, f in sorted(sizes):
        counts[length], base[length], fulls = n, fulls, fulls + f
    counts[0] = 0
    plan = plan_windows(counts, capacity)
    slots, windows = _slots(plan, counts), sum(p[0] for p in plan)
    # Rests and, for the numbers of their sequences, full pieces are counted by (length of the rest, block, id).
    earlier = Window.partitionBy("rest").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("rest", "block").agg(F.count("*").alias("n"), F.sum("full").alias("f"))
    starts = starts.select("rest", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank0"), F.coalesce(F.sum("f").over(earlier), F.lit(0)).alias("full0"))
    own = Window.partitionBy("rest", "block").orderBy("doc_id", "doc_tokens", "rest_crc")
    ranked = rows.withColumn("r", F.row_number().over(own) - 1).withColumn("f", F.coalesce(F.sum("full").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.join(starts, ["rest", "block"]).select("doc_id", "doc_tokens", "full_crc", "rest", "rest_crc", "rest_ids", (F.col("rank0") + F.col("r")).alias("rank"), (F.col("full0") + F.col("f")).alias("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, rest, crc, rank, nth = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 3, 4, 6, 7))
            full, row_ids = b.column(2), b.column(5)
            n_full = np.diff(full.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), n_full)
            j = np.arange(len(row)) - np.repeat(np.cumsum(n_full) - n_full, n_full)
            first = windows + nth + np.array([base[r] for r in rest.tolist()], np.int64)
            parts = [(row, j * capacity, np.full(len(row), capacity), full.flatten().to_numpy(zero_copy_only=False), first[row] + j, 0 * j)]
            r, start, length, seq, offset = _placed(rest, rank, slots).T
            sums = crc[r]
            for k in np.flatnonzero(length < rest[r]).tolist():
                ids = row_ids[int(r[k])].as_py()
                ids = np.frombuffer(ids, np.uint16 if len(ids) == 2 * rest[r[k]] else np.uint32)[start[k] : start[k] + length[k]]
                sums[k] = zlib.crc32(ids.astype(np.uint32).tobytes())
            parts.append((r, tokens[r] - rest[r] + start, length, sums, seq, offset))
            r, start, length, sums, seq, offset = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
            cols = [b.column(0).take(pa.array(r)), start, length, sums, tokens[r], seq, offset]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, _PIECES)
