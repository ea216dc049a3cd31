"""Personal data by patterns and a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import whole_text

#: Fixed values of the contract: the kinds in their order and the patterns of their base spans.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Documents that the field is fitted on, and the change below which a message has settled.
SAMPLE, SETTLED = 20_000, 1e-6
#: Probability of a kind from which a token is added.
CERTAIN = 0.5
#: Log potentials that fitting starts from and is drawn to: of being outside, and of equal labels along a skip.
OUTSIDE, SKIP = 2.0, 4.0

_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_NOT_DIGIT, _NOT_WORD = re.compile(r"[^0-9]+"), re.compile(r"[\W_]+")
_LABELS = 1 + len(KINDS)
#: Bits of a token's features.
_DIGITS = (0, 2, 3, 6, 7, 9, 12, 15, 19)
FEATURES = len(_DIGITS) + 1 + 9


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _is_octet(digits: str) -> bool:
    """At most 255, whatever the number of digits."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the longest run of local characters before it, then a domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, (done := m.end())
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; matches that fail their check are dropped."""
    spans = [(0, *s) for s in _emails(text)]
    spans += [(1, *m.span()) for m in IP.finditer(text) if all(map(_is_octet, m[0].split(".")))] if "." in text else []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            spans.append((2, *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            spans.append((3, *m.span()))
    return spans


def _features(token: str) -> int:
    """Bits that tell what a token looks like."""
    digits = _NOT_DIGIT.sub("", token)
    n = len(digits)
    bits = 1 << sum(n > d for d in _DIGITS)
    bare = token.strip(".,;:!?()[]{}<>\"'|")
    tests = (
        "@" in token, token[:1] == "+", token[:1] == "(", bare.isdigit(), any(c.isalpha() for c in token), "-" in bare,
        bare.count(".") == 3 and bare.replace(".", "").isdigit(), 16 <= n <= 19 and luhn(digits), "." in bare,
    )
    return bits | sum(1 << (len(_DIGITS) + 1 + k) for k, t in enumerate(tests) if t)


def _keys(token: str) -> set[str]:
    """What a token shares with repeated and similar ones: its letters and digits, an address's name, a number's end."""
    keys = {_NOT_WORD.sub("", token.lower())}
    if "@" in token:
        keys.add(_NOT_WORD.sub("", token.lower().partition("@")[0]))
    digits = _NOT_DIGIT.sub("", token)
    if len(digits) >= 7:
        keys.add(digits[-7:])
    return {k for k in keys if len(k) >= 4}


class Field:
    """The variables of a batch of texts: tokens with a digit or an @; all others are outside any entity."""

    def __init__(self, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> None:
        self.doc, self.start, self.end, self.bits, self.base = [], [], [], [], []
        self.chain, self.skip = [], []
        for d, (text, base) in enumerate(zip(texts, bases, strict=True)):
            last: dict[str, int] = {}
            before = -1
            ordered = sorted((s, e, k) for k, s, e in base)
            first = 0
            for m in _TOKEN.finditer(text):
                i, (s, e) = len(self.doc), m.span()
                while first < len(ordered) and ordered[first][1] <= s:
                    first += 1
                near = ordered[first : first + 2 * len(KINDS)]
                self.base.append(min((1 + k for a, b, k in near if a < e and s < b), default=0))
                self.doc.append(d), self.start.append(s), self.end.append(e), self.bits.append(_features(m[0]))
                if before >= 0 and text[before:s].isspace():
                    self.chain.append((i - 1, i))
                before = e
                for key in _keys(m[0]):
                    if key in last:
                        self.skip.append((last[key], i))
                    last[key] = i
        self.n = len(self.doc)
        self.base = np.array(self.base, np.int64)
        self.x = (np.array(self.bits, np.int64).reshape(-1, 1) >> np.arange(FEATURES)) & 1
        self.chain, self.skip = (np.array(sorted(set(p)), np.int64).reshape(-1, 2) for p in (self.chain, self.skip))


@dataclass(frozen=True)
class Weights:
    """Log potentials: of features by label, of labels in a row, of equal labels along a skip."""

    node: np.ndarray
    chain: np.ndarray
    skip: float


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each token, its features, its label by the base spans, and those of its neighbours."""
    for b in batches:
        texts = b.column(1).to_pylist()
        f = Field(texts, [base_spans(t) for t in texts])
        before, after = np.full(f.n, -1), np.full(f.n, -1)
        before[f.chain[:, 1]], after[f.chain[:, 0]] = f.base[f.chain[:, 0]], f.base[f.chain[:, 1]]
        linked = np.zeros((f.n, _LABELS), np.int64)
        np.add.at(linked, (f.skip[:, 0], f.base[f.skip[:, 1]]), 1)
        np.add.at(linked, (f.skip[:, 1], f.base[f.skip[:, 0]]), 1)
        # A token that the patterns pass over but that shares something with one of theirs has no known label.
        told = (f.base > 0) | (linked[:, 1:].sum(axis=1) == 0)
        cols = [c[told] for c in (np.array(f.bits, np.int64), f.base, before, after, *np.minimum(linked, 3).T)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["bits", "label", "before", "after", *(f"l{k}" for k in range(_LABELS))])


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, steps: int = 200) -> Weights:
    """Weights of greatest pseudo-likelihood, given labels from base spans, on at most about `sample` documents.

    Those are the ones whose ids hash lowest. Their tokens come to the driver counted by what describes them, of which
    there are few. Without any token, all tokens are outside.
    """
    rows = docs.select(F.xxhash64(F.col(doc_id)).alias("h"), whole_text(text).alias("text"))
    low = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    names = ["bits", "label", "before", "after", *(f"l{k}" for k in range(_LABELS))]
    got = rows.where(F.col("h") <= F.lit(low)).mapInArrow(_sample, ", ".join(f"{n} long" for n in names)).groupBy(*names).count().collect()
    prior = np.zeros((FEATURES, _LABELS))
    prior[: len(_DIGITS) + 1, 0] = OUTSIDE
    node, chain, skip = prior.copy(), np.zeros((_LABELS, _LABELS)), SKIP
    if got:
        data = np.array(got, np.int64)
        x = ((data[:, :1] >> np.arange(FEATURES)) & 1).astype(float)
        y = np.eye(_LABELS)[data[:, 1]]
        before, after = (np.where(data[:, [k]] >= 0, np.eye(_LABELS)[np.maximum(data[:, k], 0)], 0.0) for k in (2, 3))
        linked, weight = data[:, 4 : 4 + _LABELS].astype(float), np.sqrt(data[:, -1:].astype(float))
        weight /= weight.sum()
        for step in range(steps):
            logit = x @ node + before @ chain + after @ chain.T + skip * linked
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            off = weight * (y - p / p.sum(axis=1, keepdims=True))
            rate = 4.0 / (1 + step / 50)
            node += rate * (x.T @ off - 1e-4 * (node - prior))
            chain += rate * (before.T @ off + off.T @ after - 1e-3 * chain)
            skip += rate * (float((linked * off).sum()) - 1e-2 * (skip - SKIP))
    return Weights(node, chain, max(skip, 0.0))


def propagate(f: Field, w: Weights) -> np.ndarray:
    """Marginal probabilities of labels (0: outside) after loopy message passing; base labels are held.

    A document's messages go on until all have settled. Where loops keep them from it, they end after rounds that
    lead damped messages along the longest possible way, over all of the document's variables.
    """
    unary = f.x @ w.node
    unary[f.base > 0] = -30.0
    unary[np.arange(f.n)[f.base > 0], f.base[f.base > 0]] = 30.0
    pairs = np.concatenate([f.chain, f.skip])
    psi = np.concatenate([np.broadcast_to(w.chain, (len(f.chain), _LABELS, _LABELS)), np.broadcast_to(w.skip * np.eye(_LABELS), (len(f.skip), _LABELS, _LABELS))])
    src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    psi = np.concatenate([psi, psi.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    messages = np.zeros((len(src), _LABELS))
    doc = np.asarray(f.doc, np.int64)[src]
    rounds = 50 + 4 * np.bincount(np.asarray(f.doc, np.int64)) if f.n else np.zeros(0, np.int64)
    live, done = np.arange(len(src)), 0  # messages of documents that have not settled
    while len(live):
        belief = unary.copy()
        np.add.at(belief, dst[live], messages[live])
        inward = (belief[src[live]] - messages[back[live]])[:, :, None] + psi[live]
        top = inward.max(axis=1, keepdims=True)
        new = np.log(np.exp(inward - top).sum(axis=1)) + top[:, 0]
        new = 0.5 * messages[live] + 0.5 * (new - new.max(axis=1, keepdims=True))
        moving = np.zeros(len(rounds), bool)
        moving[doc[live[np.abs(new - messages[live]).max(axis=1) > SETTLED]]] = True
        messages[live] = new
        done += 1
        live = live[(moving & (done < rounds))[doc[live]]]
    belief = unary.copy()
    np.add.at(belief, dst, messages)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _added(f: Field, p: np.ndarray, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans of tokens outside base spans that are likely of a kind; such tokens in a row are one span."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    label = np.where((f.base == 0) & (p[:, 1:].max(axis=1, initial=0) >= CERTAIN), p.argmax(axis=1), 0) if f.n else np.zeros(0, int)
    in_row = set(map(tuple, f.chain.tolist()))
    for i in np.flatnonzero(label).tolist():
        d, s, e, kind = f.doc[i], f.start[i], f.end[i], int(label[i]) - 1
        token = texts[d][s:e]
        s, e = s + len(token) - len(token.lstrip(".,;:!?[]{}<>\"'|")), e - len(token) + len(token.rstrip(".,;:!?[]{}<>\"'|"))
        if s >= e:
            continue
        if out[d] and out[d][-1][0] == kind and i and label[i - 1] == label[i] and (i - 1, i) in in_row:
            out[d][-1] = (kind, out[d][-1][1], e)
        else:
            out[d].append((kind, s, e))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weights: Weights | None = None) -> DataFrame:
    """Return doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added, one row per input row.

    spans holds the base spans and what the field adds: tokens like those of a kind that the patterns' checks pass over,
    and those that repeat, or share a name or a number's end with, one that the patterns found in the same document.
    Null texts are empty; other columns are ignored; an empty table gives an empty result.
    """
    w = weights or fit(docs, doc_id, text)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                texts = b.column(1).to_pylist()
                bases = [base_spans(t) for t in texts]
                f = Field(texts, bases)
                more = _added(f, propagate(f, w), texts)
                counts = [[sum(s[0] == k for s in base) for base in bases] for k in range(len(KINDS))]
                sums = [hashlib.sha256(_joined(base).encode()).hexdigest() for base in bases]
                spans = [_joined(sorted([*base, *new])) for base, new in zip(bases, more, strict=True)]
                cols = [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums), pa.array(spans), pa.array([len(m) for m in more], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
