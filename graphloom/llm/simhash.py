"""SimHash near-deduplication: a binary trie of fingerprints joined with itself under a Hamming budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, text_bytes
from graphloom.llm.components import connected_components

#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: Fingerprints that one task joins at once; a larger subtree is divided by more of its bits first.
GROUP = 50_000
#: Node pairs that are opened at once.
PAIRS = 1 << 18


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of the lower-cased (A-Z) words' shingles, repeats included; zero if there is no word."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    ends = ends[min(width, len(words)) - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        part = [digest(whole[a:b], 42) for a, b in zip(starts[k : k + CHUNK].tolist(), ends[k : k + CHUNK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Return (doc_id, fp) with fp the fingerprint as a signed long; one row per input row, null text as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


class _Forest:
    """Component labels of rows, joined as links are found."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            if (keep := x != y).sum() == 0:
                return
            a, b, x, y = a[keep], b[keep], x[keep], y[keep]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(nxt := label[label], label):
                label = nxt
            self.label = label


def _opened(pairs: np.ndarray, ones: dict[int, np.ndarray], rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the next open bit turns to one within either node of each pair."""
    alo, ahi, blo, bhi, _, left = pairs.T
    amid, bmid = ahi.copy(), bhi.copy()
    for bit in np.unique(left - 1):
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((rest >> np.int64(bit)) & 1)])
        at, c = left - 1 == bit, ones[bit]
        amid[at] -= c[ahi[at]] - c[alo[at]]
        bmid[at] -= c[bhi[at]] - c[blo[at]]
    return amid, bmid


def _filled(*columns: np.ndarray) -> np.ndarray:
    pairs = np.stack(columns, axis=1)
    return pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])]


def _product(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of node pairs; within one node, each once."""
    n, m = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
    size = n * m
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    wide = np.repeat(m, size)
    x, y = np.repeat(pairs[:, 0], size) + at // wide, np.repeat(pairs[:, 2], size) + at % wide
    keep = x < y
    return x[keep], y[keep]


def trie_links(group: np.ndarray, rest: np.ndarray, length: np.ndarray, budget: int = 3, judge: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Labels of rows: equal where links of at most `budget` differing bits connect rows of the same group.

    A judge has the last word on pairs of rows (x, y) within the budget; without one, all of them link.

    Rows are sorted by group, then rest. rest: the bits that the group does not share, `length` of them. A node of a
    group's trie is a run of rows with a common prefix. Pairs of nodes are opened together, one bit at a time, with the
    number of bits in which they differ so far: a pair beyond the budget goes; a pair whose open bits fit into what
    is left of the budget is linked whole; a pair that lies in one component already is not opened. Sibling nodes are
    paired from the deepest up, so that a dense group is one component before its upper nodes meet.
    """
    n = len(rest)
    forest = _Forest(n)
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if n else np.zeros(1, int)
    lo, hi = edge[:-1], edge[1:]
    pairs = np.stack([lo, hi, lo, hi, 0 * lo, length[lo].astype(np.int64)], axis=1)
    siblings, ones = [], {}
    while len(pairs := pairs[(pairs[:, 1] - pairs[:, 0] > 1) & (pairs[:, 5] > 0)]):
        lo, hi, _, _, err, left = pairs.T
        mid, _ = _opened(pairs, ones, rest)
        siblings.append(_filled(lo, mid, mid, hi, err + 1, left - 1))
        pairs = np.concatenate([_filled(lo, mid, lo, mid, err, left - 1), _filled(mid, hi, mid, hi, err, left - 1)])
        siblings.append(pairs[(pairs[:, 1] - pairs[:, 0] > 1) & (pairs[:, 5] == 0)])
    for pairs in reversed(siblings):
        stack = [pairs]
        while stack:
            pairs = stack.pop()
            if len(pairs) > PAIRS:
                stack += [pairs[k : k + PAIRS] for k in range(0, len(pairs), PAIRS)]
                continue
            alo, ahi, blo, bhi, err, left = pairs.T
            change = np.concatenate([[0], np.cumsum(forest.label[1:] != forest.label[:-1])])
            joined = (forest.label[alo] == forest.label[blo]) & (change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo])
            pairs = pairs[~joined & (err <= budget)]
            alo, ahi, blo, bhi, err, left = pairs.T
            single = (ahi - alo == 1) & (bhi - blo == 1)
            x, y = alo[single], blo[single]
            near = np.bitwise_count((rest[x] ^ rest[y]).astype(np.uint64)) <= budget
            x, y = x[near], y[near]
            full = ~single & (err + left <= budget if judge is None else left == 0)
            if judge is not None:
                # Leaves of several rows: their pairs, a bounded number at a time.
                leaves = pairs[full]
                sizes = np.cumsum((leaves[:, 1] - leaves[:, 0]) * (leaves[:, 3] - leaves[:, 2]))
                for part in np.split(leaves, np.flatnonzero(np.diff(sizes // PAIRS)) + 1) if len(leaves) else ():
                    u, v = _product(part)
                    sure = judge(u, v)
                    forest.join(u[sure], v[sure])
                sure = judge(x, y)
                x, y = x[sure], y[sure]
            forest.join(x, y)
            if judge is not None:
                pairs = pairs[~single & ~full]
                full = single = np.zeros(len(pairs), bool)
                alo, ahi, blo, bhi, err, left = pairs.T
            for first, end in ((alo[full], ahi[full]), (blo[full], bhi[full])):
                rows = end - first
                forest.join(np.repeat(alo[full], rows), np.repeat(first - np.cumsum(rows) + rows, rows) + np.arange(rows.sum()))
            pairs = pairs[~single & ~full]
            if len(pairs):
                alo, ahi, blo, bhi, err, left = pairs.T
                amid, bmid = _opened(pairs, ones, rest)
                same = [_filled(alo, amid, blo, bmid, err, left - 1), _filled(amid, ahi, bmid, bhi, err, left - 1)]
                stack.append(np.concatenate([*same, _filled(alo, amid, bmid, bhi, err + 1, left - 1), _filled(amid, ahi, blo, bmid, err + 1, left - 1)]))
    return forest.label


def _divide(rows: DataFrame, level: int, *carried: str) -> DataFrame:
    """Four copies of each row, each under the value of another quarter of its open bits.

    Three differing bits leave one quarter untouched, so a pair within the budget meets under at least one of them.
    """
    parts = []
    for o in range(4):
        w, low = "cast(__left div 4 as int)", f"cast(__left - {o + 1} * (__left div 4) as int)"
        block = f"(shiftrightunsigned(__rest, {low}) & (shiftleft(1L, {w}) - 1))"
        above = f"shiftleft(shiftrightunsigned(__rest, {low} + {w}), {low})" if o else "0L"
        below = f"(__rest & (shiftleft(1L, {low}) - 1))"
        path = f"shiftleft(__path, {w} + 2) + shiftleft({o}L, {w}) + {block}"
        parts.append(f"struct({path} as p, {above} + {below} as r, __left - {w} as l)")
    copies = rows.withColumn("__c", F.expr(f"explode(array({', '.join(parts)}))"))
    return copies.select("rep", *carried, F.lit(level).alias("__level"), F.col("__c.p").alias("__path"), F.col("__c.r").alias("__rest"), F.col("__c.l").alias("__left"))


def _links(batches: Iterator[pa.RecordBatch], budget: int = 3) -> Iterator[pa.RecordBatch]:
    """Links to a group's smallest members, for batches sorted by (level, path, rest)."""

    def join(cols: list[np.ndarray]) -> pa.RecordBatch:
        level, path, rest, left, rep = cols
        changed = np.concatenate([[False], (level[1:] != level[:-1]) | (path[1:] != path[:-1])])
        label = trie_links(np.cumsum(changed), rest, left, budget)
        away = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(rep[away]), pa.array(rep[label[away]])], ["a", "b"])

    held: list[list[np.ndarray]] = []
    size = 0
    for b in batches:
        held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
        size += b.num_rows
        if size >= 2 * GROUP:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = np.flatnonzero((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]))[0]
            if last:
                yield join([c[:last] for c in cols])
            held = [[c[last:] for c in cols]]
            size = len(cols[0]) - last
    if size:
        yield join([np.concatenate(x) for x in zip(*held, strict=True)])


def hamming_links(prints: DataFrame, budget: int = 3) -> DataFrame:
    """Links (a, b) of ids that connect all rows of (rep, fp), fp distinct, at up to 3 differing bits.

    A trie is built under four orders of bits, each with another quarter of them first; pairs are sought under
    nodes at that depth. A node with over GROUP rows is divided again, until its open bits bound its rows. A connected
    group may come as fewer links than it has pairs, never as two groups.
    """
    if budget > 3:
        raise ValueError("four quarters find up to 3 differing bits")
    rows = prints.select("rep", F.lit(0).alias("__level"), F.lit(0).cast("long").alias("__path"), F.col("fp").alias("__rest"), F.lit(64).alias("__left"))
    ready = None
    for level in range(1, 7):
        rows = materialize(_divide(rows, level), "tries")
        counts = rows.groupBy("__path").count().where(f"count > {GROUP}").select("__path")
        large = materialize(counts, "large")
        whole = large.isEmpty()
        part = rows if whole or level == 6 else rows.join(large, "__path", "left_anti")
        ready = part if ready is None else ready.unionByName(part)
        if whole:
            break
        rows = rows.join(large, "__path", "left_semi")
    ready = ready.select("__level", "__path", "__rest", "__left", "rep").repartition("__level", "__path").sortWithinPartitions("__level", "__path", "__rest")
    return ready.mapInArrow(lambda it: _links(it, budget), "a long, b long")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = 3, width: int = 3) -> DataFrame:
    """Return (doc_id, fingerprint, component_id, links): one row per input row.

    fingerprint: 16 hex digits. component_id: the smallest id reachable over links of at most `budget` bits. links: the
    distinct fingerprints of the component, this one included. Texts without words all have the zero fingerprint and
    link like others; null counts as empty; repeated rows stay; rows without an id are left out, as no link can name
    them; other columns are ignored; an empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs.where(F.col(doc_id).isNotNull()), doc_id, text, width), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    # The trie joins fingerprints, so the links name them rather than documents, whose ids may repeat.
    nodes = distinct.select(F.col("fp").alias("rep"), "fp")
    comps = connected_components(hamming_links(nodes, budget))
    mapped = distinct.join(comps, distinct["fp"] == comps["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    mapped = materialize(mapped, "mapped")
    lowest = materialize(mapped.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("links")), "lowest")
    by_print = mapped.join(lowest, "root").select("fp", "component_id", "links")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")
