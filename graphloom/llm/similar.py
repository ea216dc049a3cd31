"""Documents of a given similarity: SimHash tries over wide fingerprints, then exact shingle sets.

Two texts whose shingle sets share s of their union differ in each fingerprint bit with a chance of
acos(2s / (1 + s)) / pi, 0.15 at 0.8: ten bits of 64, beyond what tries of short fingerprints can tell from chance. So the
fingerprint has WORDS words of 64 bits. Each half word is a band; tries of a band are joined with themselves at up to
three differing bits, which finds nearly all pairs in at least one band, and the whole fingerprints then tell the pairs that
chance brought together. What may be similar is connected first, a link a row rather than a link a pair; the texts of each
such group then decide, one text against all others of its group that are not connected yet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import simhash
from graphloom.llm.common import materialize, text_bytes
from graphloom.llm.components import connected_components

#: Words of a fingerprint, and bits by which two members of a band may differ.
WORDS, BUDGET = 6, 3
#: Standard deviations from the expected differing bits up to what is possible.
POSSIBLE = 3.0
#: Bytes of text that one task compares at once; a larger group is dealt into blocks.
LIMIT = 32 << 20

_MIX = 0x9E3779B97F4A7C15
#: By level of a trie: the bits that a path has gained since its first level.
_DEEPER = np.array([0, 0, 8, 14, 19])


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each shingle of words, A-Z lower-cased; a text of fewer words has one, of none no shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    return np.fromiter((xxhash.xxh64_intdigest(whole[a:b], 42) for a, b in zip(starts, ends[min(width, len(words)) - 1 :].tolist(), strict=True)), np.uint64, n)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash that follows from one: a splitmix step."""
    h = h + np.uint64(_MIX * k % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def wide_fingerprint(text: bytes, width: int = 5, words: int = WORDS) -> np.ndarray:
    """SimHash of the set of shingles, of `words` words; zero without a word of text."""
    h, counts = np.unique(shingle_hashes(text, width)), np.zeros(64 * words, np.int64)
    for k in range(0, len(h), simhash.CHUNK):
        part = np.stack([_mixed(h[k : k + simhash.CHUNK], j) for j in range(1, words + 1)], axis=1)
        bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little")
        full = len(bits) // 255
        counts += bits[: full * 255].reshape(full, 255, 64 * words).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[full * 255 :].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)


def threshold(similarity: float, words: int = WORDS) -> int:
    """Differing bits up to which two texts may have the similarity."""
    p, n = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * words
    return math.ceil(n * p + POSSIBLE * math.sqrt(n * p * (1 - p)))


def _far(prints: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of the whole fingerprints of rows."""
    far = np.zeros(len(x), np.int64)
    for k in range(prints.shape[1]):
        far += np.bitwise_count(prints[x, k] ^ prints[y, k])
    return far


def _leaders(group: np.ndarray, rest: np.ndarray, prints: np.ndarray, most: int) -> np.ndarray:
    """The leader of each row: of rows alike in group and rest, the first that is left takes those that it may link to."""
    leader = np.arange(len(rest))
    key = np.cumsum(np.concatenate([[True], (group[1:] != group[:-1]) | (rest[1:] != rest[:-1])])) - 1
    left = np.arange(len(rest))
    while len(left):
        k = key[left]
        first = np.concatenate([[True], k[1:] != k[:-1]])
        head = left[first][np.cumsum(first) - 1]
        others = ~first
        near = _far(prints, head[others], left[others]) <= most
        leader[left[others][near]] = head[others][near]
        left = left[others][~near]
    return leader


class _Judge:
    """Tells pairs of leaders by the whole fingerprints of all rows that they stand for, and keeps a link for each pair.

    Followers are within a radius of their leader, so leaders that are farther apart than both radii and what is possible
    have no possible pair, and no rows of theirs are compared.
    """

    def __init__(self, prints: np.ndarray, leader: np.ndarray, most: int) -> None:
        self.prints, self.most = prints, most
        self.heads = np.flatnonzero(leader == np.arange(len(leader)))
        self.rows = np.argsort(leader, kind="stable")
        self.first = np.searchsorted(leader[self.rows], self.heads)
        self.count = np.diff(np.concatenate([self.first, [len(leader)]]))
        self.radius = np.zeros(len(leader), np.int64)
        np.maximum.at(self.radius, leader, _far(prints, leader, np.arange(len(leader))))
        self.radius = self.radius[self.heads]
        followers = np.flatnonzero(leader != np.arange(len(leader)))
        self.links = [np.stack([leader[followers], followers])]

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        far = _far(self.prints, self.heads[x], self.heads[y])
        linked = far <= self.most
        self.links.append(np.stack([self.heads[x[linked]], self.heads[y[linked]]]))
        reach = np.flatnonzero(~linked & (far <= self.most + self.radius[x] + self.radius[y]))
        x, y = x[reach], y[reach]
        ends = np.cumsum(self.count[x] * self.count[y])
        for k in range(0, int(ends[-1]) if len(ends) else 0, simhash.PAIRS):
            at = np.arange(k, min(k + simhash.PAIRS, int(ends[-1])))
            pair = np.searchsorted(ends, at, side="right")
            wide = self.count[y[pair]]
            place = at - ends[pair] + self.count[x[pair]] * wide
            u, v = self.rows[self.first[x[pair]] + place // wide], self.rows[self.first[y[pair]] + place % wide]
            near = np.flatnonzero(_far(self.prints, u, v) <= self.most)
            _, one = np.unique(pair[near], return_index=True)
            near = near[one]
            self.links.append(np.stack([u[near], v[near]]))
            linked[reach[pair[near]]] = True
        return linked


def _met_before(prints: np.ndarray, u: np.ndarray, v: np.ndarray, band: np.ndarray, quarter: np.ndarray) -> np.ndarray:
    """Whether pairs of rows that meet under a quarter of a band do so under an earlier one as well."""
    before = np.zeros(len(u), bool)
    for b in range(2 * prints.shape[1]):
        differ = ((prints[u, b // 2] ^ prints[v, b // 2]) >> np.uint64(32 * (b % 2))) & np.uint64(0xFFFFFFFF)
        before |= (b < band) & (np.bitwise_count(differ) <= BUDGET)
        for o in range(3):
            before |= (b == band) & (o < quarter) & ((differ >> np.uint64(24 - 8 * o)) & np.uint64(255) == 0)
    return before


def _spanning(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few of the links as connect the same rows."""
    forest, chosen = simhash._Forest(n), [np.zeros((2, 0), np.int64)]
    while True:
        x, y = forest.label[u], forest.label[v]
        keep = x != y
        u, v, high = u[keep], v[keep], np.maximum(x, y)[keep]
        if not len(u):
            return tuple(np.concatenate(chosen, axis=1))
        _, one = np.unique(high, return_index=True)
        chosen.append(np.stack([u[one], v[one]]))
        forest.join(u[one], v[one])


def _join(cols: list[np.ndarray], most: int) -> pa.RecordBatch:
    """Links (a, b) that connect the possible pairs of groups; a pair that meets elsewhere before is linked there."""
    level, path, rest, left, rep, prints = cols
    group = np.cumsum(np.concatenate([[False], (level[1:] != level[:-1]) | (path[1:] != path[:-1])]))
    leader = _leaders(group, rest, prints, most)
    judge = _Judge(prints, leader, most)
    simhash.trie_links(group[judge.heads], rest[judge.heads], left[judge.heads], BUDGET, judge)
    u, v = np.concatenate(judge.links, axis=1)
    top = path[u] >> _DEEPER[level[u]]
    first = ~_met_before(prints, u, v, top >> 10, (top >> 8) & 3)
    # Rows of one document are one node, under whichever group they are.
    reps, node = np.unique(rep, return_inverse=True)
    u, v = _spanning(len(reps), node[u[first]], node[v[first]])
    return pa.RecordBatch.from_arrays([pa.array(reps[u]), pa.array(reps[v])], ["a", "b"])


def _links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        return [*cols, np.stack([batch.column(5 + k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(WORDS)], axis=1)]

    held: list[list[np.ndarray]] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(columns(b))
        size += b.num_rows
        if size >= 2 * simhash.GROUP:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = np.flatnonzero((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]))[0]
            if last:
                yield _join([c[:last] for c in cols], most)
            held = [[c[last:] for c in cols]]
            size = len(cols[0]) - last
    if size:
        yield _join([np.concatenate(x) for x in zip(*held, strict=True)], most)


def _candidates(prints: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect rows (rep, w0, w1, ...), fingerprints distinct, wherever two may have the similarity.

    A band's row meets those that share a quarter of it. A group with over GROUP rows is divided by quarters of what
    is open, until its open bits are few; leaders stand for rows that share all of the band.
    """
    words = [f"w{k}" for k in range(WORDS)]
    bands = ", ".join(f"struct({2 * k + h} as b, shiftrightunsigned(w{k}, {32 * h}) & 4294967295 as r)" for k in range(WORDS) for h in (0, 1))
    rows = prints.withColumn("__b", F.expr(f"explode(array({bands}))")).select("rep", *words, F.col("__b.b").alias("__path"), F.col("__b.r").alias("__rest"), F.lit(32).alias("__left"))
    rows = rows.withColumn("__path", F.col("__path").cast("long"))
    ready = None
    for level in range(1, len(_DEEPER)):
        rows = simhash._divide(rows, level, *words)
        large = materialize(rows.groupBy("__path").count().where(f"count > {simhash.GROUP}").select("__path"), "large")
        whole = large.isEmpty()
        part = rows if whole or level == len(_DEEPER) - 1 else rows.join(large, "__path", "left_anti")
        ready = part if ready is None else ready.unionByName(part)
        if whole:
            break
        rows = rows.join(large, "__path", "left_semi")
    most = threshold(similarity)
    ready = ready.select("__level", "__path", "__rest", "__left", "rep", *words).repartition("__level", "__path").sortWithinPartitions("__level", "__path", "__rest")
    return ready.mapInArrow(lambda it: _links(it, most), "a long, b long")


class _Overlaps:
    """Shingle sets of a group, by shingle: one set is held against all that are left in a single pass over its shingles."""

    def __init__(self, sets: list[np.ndarray], similarity: float) -> None:
        self.similarity, self.sizes = similarity, np.array([len(s) for s in sets], np.int64)
        tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(self.sizes)
        self.own = [at[e - n : e] for e, n in zip(ends.tolist(), self.sizes.tolist(), strict=True)]
        order = np.argsort(at, kind="stable")
        self.sets = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.first = np.searchsorted(at[order], np.arange(len(tokens) + 1))
        self.left = len(sets)

    def similar_to(self, x: int) -> np.ndarray:
        """The sets left that have the similarity to x."""
        begin, count = self.first[self.own[x]], self.first[self.own[x] + 1] - self.first[self.own[x]]
        ends = np.cumsum(count)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + count, count)
        if 8 * len(at) > len(self.sizes):
            counts = np.bincount(self.sets[at], minlength=len(self.sizes))
            y = np.flatnonzero(counts)
            both = counts[y]
        else:
            y, both = np.unique(self.sets[at], return_counts=True)
        return y[both / (self.sizes[x] + self.sizes[y] - both) >= self.similarity]

    def keep(self, mask: np.ndarray) -> None:
        """Leave only the sets of the mask; done once they have become few, so that all such calls cost little."""
        if 2 * (n := int(mask.sum())) > self.left:
            return
        self.left, kept = n, mask[self.sets]
        before = np.concatenate([[0], np.cumsum(kept)])
        self.sets, self.first = self.sets[kept], before[self.first]


def _grouped(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The first set of each set's component, of those that links of the similarity connect."""
    label = np.arange(len(sets))
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.zeros(2, int) if both and both / (len(sets[0]) + len(sets[1]) - both) >= similarity else label
    found, new = _Overlaps(sets, similarity), np.ones(len(sets), bool)
    for seed in range(len(sets)):
        if not new[seed]:
            continue
        new[seed], ahead = False, [seed]
        while ahead:
            near = found.similar_to(ahead.pop())
            near = near[new[near]]
            new[near], label[near] = False, seed
            ahead += near.tolist()
            found.keep(new)
    return label


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Runs of rows that are alike in the first columns, as lists of the others' values."""
    held, last = None, None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != last:
                if held:
                    yield held
                held, last = [[] for _ in row[keys:]], row[:keys]
            for values, x in zip(held, row[keys:], strict=True):
                values.append(x)
    if held:
        yield held


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _set(text: bytes, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def _by_text(rows: DataFrame, similarity: float, width: int, limit: int | None = None) -> DataFrame:
    """Links (a, b) that connect rows (component, node, text) of a component wherever two texts have the similarity.

    A task holds a component. One of more than `limit` bytes is dealt into blocks, and a sample of all its rows, as large as
    a block, is one block more that connects those of different blocks. Rows that are then still apart from
    the largest part of their component meet every block, so no link is lost; there are few unless
    a group is large and alike but not similar.
    """
    limit = limit or LIMIT
    rows = materialize(rows, "grouped")
    sizes = rows.groupBy("component").agg(F.sum(F.octet_length("text") + 64).alias("bytes")).where(F.col("bytes") > limit)
    large = materialize(sizes.select("component", F.ceil(F.col("bytes") / limit).cast("int").alias("blocks")), "large")
    split = not large.isEmpty()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, texts in _groups(batches, 2):
            if len(nodes) > 1:
                label = _grouped([_set(t, width) for t in texts], similarity)
                away = np.flatnonzero(label != np.arange(len(label))).tolist()
                yield _pairs([nodes[i] for i in away], [nodes[label[i]] for i in away])

    dealt = rows.withColumn("block", F.lit(0))
    if split:
        place = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "node"), n).cast("int")
        large_rows = materialize(rows.join(large, "component").withColumn("block", place(1, F.col("blocks"))), "large")
        sample = large_rows.where(place(2, F.col("blocks")) == 0).withColumn("block", F.lit(-1))
        dealt = dealt.join(large, "component", "left_anti").unionByName(large_rows.drop("blocks")).unionByName(sample.drop("blocks"))
    dealt = dealt.select("component", "block", "node", "text").repartition("component", "block").sortWithinPartitions("component", "block")
    links = materialize(dealt.mapInArrow(first, "a long, b long"), "links")
    if not split:
        return links

    parts = connected_components(links)
    known = large_rows.join(parts.select("node", F.col("component").alias("__part")), "node", "left").withColumn("part", F.coalesce("__part", "node")).drop("__part")
    known = materialize(known.withColumn("size", F.octet_length("text") + 64), "known")
    by_part = known.groupBy("component", "part").agg(F.sum("size").alias("size"))
    main = by_part.groupBy("component").agg(F.max_by("part", F.struct("size", "part")).alias("main"), F.sum("size").alias("all"), F.max("size").alias("most"))
    main = materialize(main.select("component", "main", F.ceil((F.col("all") - F.col("most")) / limit).cast("int").alias("chunks")).where("chunks > 0"), "main")
    known = known.join(main, "component").withColumn("apart", F.col("part") != F.col("main"))
    held = known.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("asks", F.lit(False))
    asking = known.where("apart").withColumn("chunk", place(3, F.col("chunks"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, asks, texts in _groups(batches, 3):
            index = _Overlaps([_set(t, width) for t in texts], similarity)
            names, label = np.unique(parts, return_inverse=True)
            forest = simhash._Forest(len(names))
            for x in np.flatnonzero(asks).tolist():
                near = np.unique(label[index.similar_to(x)])
                forest.join(np.full(len(near), label[x]), near)
            away = np.flatnonzero(forest.label != np.arange(len(names)))
            yield _pairs(names[away].tolist(), names[forest.label[away]].tolist())

    both = held.unionByName(asking).select("component", "block", "chunk", "part", "asks", "text")
    more = both.repartition("component", "block", "chunk").sortWithinPartitions("component", "block", "chunk").mapInArrow(second, "a long, b long")
    return links.unionByName(materialize(more, "links"))


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, width: int = 5) -> DataFrame:
    """Return (doc_id, component_id), one row for each id: component_id is the least id that links lead to.

    Texts link at `similarity` or more of their shingle sets, which is decided exactly. Texts with the same fingerprint, such as
    equal ones and all those without a word, are one node. The fingerprints' bands pass over about one pair in fifty
    at the similarity itself, unless other texts connect the two, and fewer above. Nulls are empty; rows without an id are
    left out; of an id's rows all texts count; an empty table gives an empty result.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([wide_fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(prints[:, k]) for k in range(WORDS))], ["doc_id", *words])

    words = [f"w{k}" for k in range(WORDS)]
    prints = materialize(rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{w} long" for w in words)), "prints")
    nodes = materialize(prints.groupBy(*words).agg(F.min("doc_id").alias("rep")), "nodes")
    possible = materialize(connected_components(_candidates(nodes, similarity)), "possible")
    links = _by_text(rows.join(possible, rows["doc_id"] == possible["node"]).select("component", "node", "text"), similarity, width)
    comps = materialize(connected_components(links), "components")
    member = prints.join(nodes, words).select("doc_id", "rep")
    return member.join(comps, member["rep"] == comps["node"], "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of docs, all columns, but for documents that are not the least id of their component; rows without an id stay."""
    copies = similar_components(docs, doc_id, text, similarity, width).where("doc_id != component_id").select(F.col("doc_id").alias("__id"))
    return docs.join(copies, docs[doc_id] == copies["__id"], "left_anti")
