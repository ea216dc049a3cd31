"""Language-model scoring by a weighted backoff automaton over word trigrams.

States are the histories that training has seen: two words, one word (the start of a text counts as one), and the root,
which has none. A state has an arc for each word that has followed it, which leads to the longest history that is a state
then; any other word takes the state's failure arc, which leads to the history without its first word, and from
there to the root, where every word has an arc. With c the training counts, h a history, h' the one its failure arc leads
to and M the weight of a prior,

    arc:      log10 P(w | h),  P(w | h) = (c(hw) + M P(w | h')) / (c(h) + M),  P(w) = (c(w) + 1) / (N + V + 1) at the root
    failure:  log10(M / (c(h) + M))

so that each state's probabilities sum up to one. A text is read once from left to right: the state is carried from word to
word, and the weights of all arcs taken, failure arcs included, add up.

The automaton grows with the corpus, so no task holds it whole. Tasks cut documents into blocks of bounded size. A
block asks the owners of its distinct n-grams (by hash, so a frequent one is one entry of each block at most) for their
counts, sending its own counts along; an owner adds up what all blocks sent and answers each. A block then builds the
part of the automaton that its texts can reach.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, own_dir, text_bytes

#: Bytes of text in a block, and buckets that blocks are dealt into at most.
BLOCK, BUCKETS = 8 << 20, 20_000
#: Weights of the prior in states of one word and of two. On held-out documents of half of the 0.1 tables, log10 probabilities of a
#: token are -3.58 at these, -3.61 at 300 and 20, -3.72 at 100 and 100; the root alone has -4.15.
PRIOR = (500.0, 5.0)
#: Documents with this remainder of crc32(doc_id) modulo 7 are held out.
FOLDS, HELD_OUT = 7, 2
#: Bits of the keys of bigrams and trigrams; those of words have 64.
BITS = 48
#: Keys of the end of a text and of its start, which no hash of a word equals but by chance of 2**-64.
END_KEY, START_KEY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Local ids of the two.
END, START = 0, 1

_BLOCKS = "block long, ids array<long>, held array<boolean>, lengths array<int>, tokens binary, words binary"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs of keys, mixed so that the order counts."""
    x = a * np.uint64(0x9FB21C651E98DF25) + (b ^ (b >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of the documents (doc_id, held, text) of a partition: their words as numbers, and the words' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        fields = [pa.field(n, t) for n, t in (("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("tokens", pa.binary()), ("words", pa.binary()))]

        def block(ids: list, held: list, texts: list[bytes]) -> pa.RecordBatch:
            local: dict[bytes, int] = {}
            number, words, lengths = local.setdefault, [], []
            for t in texts:
                found = t.lower().split()
                words += [number(w, len(local) + 2) for w in found]
                words.append(END)
                lengths.append(len(found) + 1)
            keys = np.array([int(END_KEY), int(START_KEY), *map(xxhash.xxh64_intdigest, local)], np.uint64)
            tokens = zlib.compress(np.array(words, np.uint16 if len(keys) <= 1 << 16 else np.uint32).tobytes(), 1)
            row = ((part << 32) + done, ids, held, lengths, tokens, keys.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, fields, strict=True)], schema=pa.schema(fields))

        ids, held, texts, size = [], [], [], 0
        for b in batches:
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                t = t.as_py()
                if texts and size + len(t) > block_bytes:
                    yield block(ids, held, texts)
                    ids, held, texts, size, done = [], [], [], 0, done + 1
                ids.append(i), held.append(h), texts.append(t)
                size += len(t) + 64
        if texts:
            yield block(ids, held, texts)

    return rows.mapInArrow(run, _BLOCKS)


def _bucketed(blocks: DataFrame, buckets: int) -> DataFrame:
    """Blocks as a table of buckets in the shared folder, so that answers are brought to blocks and blocks stay where they are.

    The catalog only serves to name the buckets; the table leaves it at once, and its files stay.
    """
    spark, name = blocks.sparkSession, f"blocks_{uuid.uuid4().hex}"
    blocks.write.bucketBy(buckets, "block").option("path", f"{own_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


class _Block:
    """The n-grams of a block: numbers of the word, bigram and trigram that end at each place, and each one's key.

    Places follow one another, document after document, each with the end's behind its words. A trigram whose first word
    would lie before the start of the text is none.
    """

    def __init__(self, row: dict) -> None:
        self.lengths = np.array(row["lengths"], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.held = np.array(row["held"], bool)
        self.keys = np.frombuffer(row["words"], np.uint64)
        tokens = np.frombuffer(zlib.decompress(row["tokens"]), np.uint16 if len(self.keys) <= 1 << 16 else np.uint32)
        self.word = tokens.astype(np.int64)
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.starts] = START
        self.bigram, pairs = pd.factorize(before * len(self.keys) + self.word)
        self.first, self.last = np.divmod(pairs, len(self.keys))
        ahead = np.empty_like(self.bigram)
        ahead[1:] = self.bigram[:-1]
        ahead[self.starts] = len(pairs)  # no history of two words
        self.trigram, triples = pd.factorize(ahead * len(self.keys) + self.word)
        self.history, word = np.divmod(triples, len(self.keys))
        whole = self.history < len(pairs)
        pair_keys = _mixed(self.keys[self.first], self.keys[self.last])
        keys = _mixed(np.append(pair_keys, np.uint64(0))[self.history] ^ START_KEY, self.keys[word])
        # Distinct numbers by their keys: bigrams, then trigrams.
        self.grams = np.concatenate([pair_keys, keys[whole]]) >> np.uint64(64 - BITS)
        self.pairs, self.whole = len(pairs), whole

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of words and of grams; those of held-out texts alone are zero."""
        train = np.repeat(~self.held, self.lengths)
        word = np.bincount(self.word[train], minlength=len(self.keys))
        grams = [np.bincount(self.bigram[train], minlength=self.pairs), np.bincount(self.trigram[train], minlength=len(self.whole))[self.whole]]
        return word, np.concatenate(grams)


def _runs(keys: np.ndarray, bits: int, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of keys, the owners that have any, by the keys' upper bits, and the ends of their runs in that order."""
    order = np.argsort(keys)
    own = (keys[order] >> np.uint64(bits - 24)) * np.uint64(owners) >> np.uint64(24)
    ends = np.flatnonzero(np.append(own[1:] != own[:-1], True)) + 1 if len(own) else np.zeros(0, np.int64)
    return order, own[ends - 1].astype(np.int64), ends


def _deltas(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and differences, in four bytes each where these fit."""
    steps = np.diff(keys)
    return keys[:1].tobytes() + (steps.astype(np.uint32) if not len(steps) or int(steps.max()) < 1 << 32 else steps).tobytes()


def _undelta(data: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(data, np.uint32 if len(data) == 4 + 4 * n else np.uint64, offset=8)
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1), steps.astype(np.uint64)]), dtype=np.uint64)


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype(np.uint32).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint32).astype(np.int64)


_KINDS = (("words", 64), ("grams", BITS))


def _asked(blocks: DataFrame, owners: int) -> DataFrame:
    """A row for each owner of any of a block's n-grams: their keys, and the block's own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                block = _Block(row)
                out = {}
                for (kind, bits), keys, counts in zip(_KINDS, (block.keys, block.grams), block.counts(), strict=True):
                    order, own, ends = _runs(keys, bits, owners)
                    keys, counts = keys[order], counts[order]
                    for owner, a, z in zip(own.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                        out.setdefault(owner, {})[kind] = (z - a, _deltas(keys[a:z]), _packed(counts[a:z]))
                none = (0, None, None)
                rows = [(owner, row["block"], *got.get("words", none), *got.get("grams", none)) for owner, got in out.items()]
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["owner", "block", "n_words", "words", "word_counts", "n_grams", "grams", "gram_counts"])

    return blocks.mapInArrow(run, "owner int, block long, n_words int, words binary, word_counts binary, n_grams int, grams binary, gram_counts binary")


def _summed(n: list[int], keys: list[bytes | None], counts: list[bytes | None]) -> tuple[list[bytes | None], np.ndarray]:
    """Each row's counts summed over all rows, and the sums of distinct keys."""
    has = [i for i, k in enumerate(keys) if k is not None]
    out: list[bytes | None] = [None] * len(keys)
    sums = np.zeros(0)
    if has:
        distinct, at = np.unique(np.concatenate([_undelta(keys[i], n[i]) for i in has]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([_unpacked(counts[i]) for i in has]), len(distinct))
        for i, x in zip(has, np.split(at, np.cumsum([n[i] for i in has])[:-1]), strict=True):
            out[i] = _packed(sums[x])
    return out, sums


def _answer(table: pa.Table) -> pa.Table:
    """An owner's answers to all blocks; the first row has the training tokens, and the distinct ones, that it owns."""
    got = table.to_pydict()
    (words, sums), (grams, _) = (_summed(got[f"n_{k}s"], got[f"{k}s"], got[f"{k}_counts"]) for k in ("word", "gram"))
    rest = [0] * (len(words) - 1)
    cols = [table["block"], table["owner"], pa.array(words, pa.binary()), pa.array(grams, pa.binary()), pa.array([int(sums.sum()), *rest], pa.int64()), pa.array([int((sums > 0).sum()), *rest], pa.int64())]
    return pa.table(cols, ["block", "owner", "words", "grams", "tokens", "types"])


class Automaton:
    """States, arcs and failure arcs that the texts of a block can reach.

    State 0 is the root; then come states of one word, by its number, and those of two, by the bigram's. Each place
    of a text has up to three arcs that read its word: one from a state of two words, of one, and from the root.
    """

    def __init__(self, block: _Block, words: np.ndarray, grams: np.ndarray, tokens: int, types: int, prior: tuple[float, float]) -> None:
        pairs, triples = grams[: block.pairs], np.zeros(len(block.whole), np.int64)
        triples[block.whole] = grams[block.pairs :]
        visits = words.copy()
        visits[START] = words[END]  # texts start in training as often as they end
        root = (words + 1) / (tokens + types + 1)
        one = (pairs + prior[0] * root[block.last]) / (visits[block.first] + prior[0])
        # A trigram's own bigram, from a place where both end.
        inner = np.zeros(len(block.whole), np.int64)
        inner[block.trigram] = block.bigram
        two = (triples + prior[1] * one[inner]) / (np.append(pairs, 0)[block.history] + prior[1])
        self.root = np.log10(root)
        self.arcs = [self.root[block.word], np.where(pairs > 0, np.log10(one), np.nan)[block.bigram], np.where(triples > 0, np.log10(two), np.nan)[block.trigram]]
        # Where each arc leads: the longest history that is a state.
        n = len(words)
        self.to = np.where(pairs[block.bigram] > 0, 1 + n + block.bigram, np.where(words[block.word] > 0, 1 + block.word, 0))
        self.kind = np.concatenate([[0], np.full(n, 1), np.full(len(pairs), 2)])
        self.failure = np.concatenate([[0.0], np.log10(prior[0] / (visits + prior[0])), np.log10(prior[1] / (pairs + prior[1]))])
        self.back = np.concatenate([[0], np.zeros(n, np.int64), 1 + block.last])
        self.block = block

    def scores(self) -> list[float]:
        """The sum of weights along each text, read from left to right."""
        root, one, two = (memoryview(np.ascontiguousarray(a)) for a in self.arcs)
        to, failure, back = (memoryview(np.ascontiguousarray(a)) for a in (self.to, self.failure, self.back))
        kind, out = self.kind.astype(np.uint8).tobytes(), []
        for a, z in zip(self.block.starts.tolist(), self.block.ends.tolist(), strict=True):
            state, total = 1 + START, 0.0
            for i in range(a, z):
                if kind[state] == 2:
                    arc = two[i]
                    if arc == arc:  # an arc that is not there is no number
                        total += arc
                        state = to[i]
                        continue
                    total += failure[state]
                    state = back[state]
                if kind[state] == 1:
                    arc = one[i]
                    if arc == arc:
                        total += arc
                        state = to[i]
                        continue
                    total += failure[state]
                total += root[i]
                state = to[i]
            out.append(total)
        return out


def _score(row: dict, answers: list[dict], owners: int, tokens: int, types: int, prior: tuple[float, float]) -> pa.Table:
    block = _Block(row)
    by_owner = {a["owner"]: a for a in answers}
    found = []
    for (kind, bits), keys in zip(_KINDS, (block.keys, block.grams), strict=True):
        order, own, _ = _runs(keys, bits, owners)
        counts = np.zeros(len(keys), np.int64)
        counts[order] = np.concatenate([_unpacked(by_owner[o][kind]) for o in own.tolist()] or [order])
        found.append(counts)
    words, grams = found
    automaton = Automaton(block, words, grams, tokens, types, prior)
    add = lambda x: np.add.reduceat(x, block.starts) if len(x) else x
    cols = [pa.array(row["ids"], pa.int64()), pa.array(block.held), pa.array(block.lengths), pa.array(add((words[block.word] > 0).astype(np.int64))), pa.array(np.full(len(block.lengths), tokens)), pa.array(add(automaton.root[block.word])), pa.array(automaton.scores(), pa.float64())]
    return pa.table(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def ngram_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prior: tuple[float, float] = PRIOR, block_bytes: int = BLOCK) -> DataFrame:
    """Return doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Null texts are empty: one token, the end. Null ids hash as the empty text. Rows that repeat count each. base_score
    adds up the root's log10((c + 1) / (N + V + 1)); score is the automaton's. With no training document, every count
    is zero. An empty table gives an empty result; other columns are ignored.
    """
    key = F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.crc32(key.cast("binary")) % FOLDS == HELD_OUT).alias("held"), text_bytes(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    owners = size // block_bytes + 1
    blocks = _bucketed(_blocks(rows, block_bytes), min(owners, BUCKETS))
    answered = _asked(blocks, owners).groupBy("owner").applyInArrow(_answer, "block long, owner int, words binary, grams binary, tokens long, types long")
    answers = materialize(answered, "answers")
    tokens, types = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("types")).first())
    answers = answers.drop("tokens", "types")

    def score(block: pa.Table, got: pa.Table) -> pa.Table:
        return _score(block.to_pylist()[0], got.to_pylist(), owners, tokens, types, prior)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
