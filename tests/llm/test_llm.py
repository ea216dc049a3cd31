"""The training-data operators on rows with nulls, empty and long texts, ties, repeats and clashing columns, against
plain versions of what they compute."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import exact_dedup, language_id, mixing, ngram_lm, order_minhash, packing, pii, similar, simhash, token_counts, tokens, url_filter
from graphloom.llm.components import connected_components

random.seed(5)
WORDS = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "théta", "iota", "kappa"]


def words(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


LONG = words(30_000)
NEAR = words(400)
TEXTS = [None, "", "a", "A b", "same text here", "same text here", LONG, LONG + "!", LONG, NEAR, NEAR + " tail", " \n\t ", "é" * 5000, "write to jo.doe@mail.example.com or +1 (052) 555-0934, card 4539578763621486 and 10.0.0.255"]
TEXTS += [words(random.randint(1, 60)) for _ in range(40)]
SCHEMA = "doc_id long, text string, lang string, source string, block int, range int, rank int, __name long, fp long"


@pytest.fixture(scope="module")
def rows():
    out = [(3 * i + 1, t, random.choice(["en", "de", None]), random.choice(["s", "s", "s", "t", None]), i, i, i, i, i) for i, t in enumerate(TEXTS)]
    return [*out, out[4]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_empty_tables(spark, empty):
    for f in (exact_dedup.exact_dedup, simhash.simhash_components, packing.pack, ngram_lm.ngram_scores, order_minhash.fingerprints, pii.find_pii, similar.similar_components, mixing.mix, token_counts.token_counts, language_id.identify_documents):
        assert f(empty).count() == 0, f
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "a b c", None, None), (None, None, "en", "s"), (7, "a b c", "en", "s"), (8, "x", "en", None)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in collected(exact_dedup.exact_dedup(df)) if r["text_sha256"] == hashlib.sha256(b"a b c").hexdigest()}
    assert got[7]["kept"] and not got[None]["kept"] and got[7]["group_size"] == 2
    for f, n in ((ngram_lm.ngram_scores, 4), (pii.find_pii, 4), (mixing.mix, 4), (language_id.identify_documents, 4), (simhash.simhash_components, 2), (order_minhash.fingerprints, 4), (token_counts.token_counts, 2), (similar.similar_components, 2)):
        assert f(df).count() == n, f
    assert packing.pack(df).agg(F.sum("length")).first()[0] == sum(len(x) + 1 for x in library_ids(["a b c", "", "a b c", "x"]))
    assert {r.doc_id for r in similar.drop_near_copies(df).collect()} == {None, 7, 8}


def test_stages_on_odd_rows(spark, docs, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, "").count() == 0
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()


def test_exact_dedup(docs, rows):
    found = collected(exact_dedup.exact_dedup(docs, block=64))
    got = {r["doc_id"]: r for r in found}
    ids = {r[0]: r[1] or "" for r in rows}
    assert sorted(r["doc_id"] for r in found) == sorted(r[0] for r in rows)
    for i, t in ids.items():
        same = [r[0] for r in rows if (r[1] or "") == t]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(same), len(same), i == max(same))
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r["kept"])


def test_names_depend_on_the_texts_alone(spark, docs):
    found = []
    for n in ("3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(tuple(r) for r in exact_dedup.block_identities(docs.repartition(int(n)), block=64).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and max(r.copies for r in exact_dedup.block_identities(docs).collect()) == 2


def plain_simhash(text, width):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s, seed=42).intdigest()
        counts = [c + (h >> i & 1) for i, c in enumerate(counts)]
    return sum(1 << i for i, c in enumerate(counts) if 2 * c > len(shingles))


def plain_components(nodes, links):
    root = {n: n for n in nodes}
    for _ in nodes:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    return root


def test_simhash(docs, rows):
    got = collected(simhash.simhash_components(docs))
    prints = {r[0]: plain_simhash(r[1], 3) for r in rows if len(r[1] or "") < 10_000}
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["fingerprint"] == f"{p:016x}" for i, p in prints.items())
    prints = {i: int(r["fingerprint"], 16) for i, r in by.items()}
    links = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
    assert {i: r["component_id"] for i, r in by.items()} == plain_components(prints, links)


@pytest.mark.parametrize("bits", [64, 20, 11])
def test_trie_links(bits):
    rng = np.random.default_rng(bits)
    centre = rng.integers(0, 1 << min(bits, 62), 30)
    flips = (1 << rng.integers(0, min(bits, 62), (600, 2))).astype(np.int64)
    rest = np.unique(centre[rng.integers(0, 30, 600)] ^ flips[:, 0] ^ flips[:, 1])
    group = np.sort(rng.integers(0, 3, len(rest)))
    order = np.lexsort((rest, group))
    group, rest = group[order], rest[order]
    label = simhash.trie_links(group, rest, np.full(len(rest), min(bits, 63)))
    near = [(i, j) for i in range(len(rest)) for j in range(i) if group[i] == group[j] and bin(int(rest[i] ^ rest[j])).count("1") <= 3]
    want = plain_components(range(len(rest)), near)
    assert label.tolist() == [want[i] for i in range(len(rest))]


def test_divided_tries(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 62))
    prints = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (80, 2))} | set(rng.integers(0, 1 << 62, 60).tolist()))
    links = [(a, b) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 3]
    monkeypatch.setattr(simhash, "GROUP", 10)
    found = simhash.hamming_links(spark.createDataFrame([(p, p) for p in prints], "rep long, fp long"))
    comps = {r["node"]: r["component"] for r in connected_components(found).collect()}
    want = plain_components(prints, links)
    assert {p: comps.get(p, p) for p in prints} == want


def edited(text, n):
    w = text.split()
    for i in random.sample(range(len(w)), n):
        w[i] = f"x{random.random()}"
    return " ".join(w)


def share(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def test_similar_documents(spark, docs, monkeypatch):
    assert {r["doc_id"] for r in collected(similar.similar_components(docs))} == {3 * i + 1 for i in range(len(TEXTS))}
    random.seed(11)
    texts = [" ".join(f"w{random.randint(0, 3000)}" for _ in range(250)) for _ in range(150)]
    texts += [edited(t, random.randint(0, 5)) for t in texts[:100]]
    texts += [edited(texts[0], 1) for _ in range(40)]  # a dense group
    sets = [set(similar.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if share(sets[i], sets[j]) >= 0.8]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_components(range(len(texts)), links)
    for group, limit in ((simhash.GROUP, similar.LIMIT), (30, 4000)):
        monkeypatch.setattr(simhash, "GROUP", group)
        monkeypatch.setattr(similar, "LIMIT", limit)
        got = {r["doc_id"]: r["component_id"] for r in collected(similar.similar_components(df))}
        assert sum(got[i] == want[i] for i in got) >= 0.99 * len(got)  # what no band finds
        assert all(got[i] == i for i in range(100, 150))


@pytest.mark.parametrize("limit", [1 << 20, 6000, 1500])
def test_texts_of_a_large_group_decide_exactly(spark, limit):
    rng = random.Random(limit)
    base = [f"w{rng.randint(0, 400)}" for _ in range(80)]

    def copy(n):
        w = base[:]
        for i in rng.sample(range(len(w)), n):
            w[i] = f"x{rng.random()}"
        return " ".join(w)

    texts = [copy(rng.randint(0, 4)) for _ in range(60)]
    texts += [e for t in texts[-8:] for e in (edited(t, 1), edited(t, 3))] + [" ".join(f"y{rng.randint(0, 99)}" for _ in range(30))] * 2
    sets = [set(similar.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if share(sets[i], sets[j]) >= 0.8]
    want = plain_components(range(len(texts)), links)
    assert 3 < len(set(want.values())) < len(texts) - 10
    df = spark.createDataFrame([(7, i, t.encode()) for i, t in enumerate(texts)], "component long, node long, text binary")
    got = {r["node"]: r["component"] for r in connected_components(similar._by_text(df, 0.8, 5, limit)).collect()}
    assert {i: got.get(i, i) for i in want} == want


def band_rows(prints, level=1):
    """The columns of all groups that rows meet in on the first level, as `similar._join` takes them."""
    parts = []
    for band in range(2 * similar.WORDS):
        r = (prints[:, band // 2] >> np.uint64(32 * (band % 2))).astype(np.int64) & 0xFFFFFFFF
        for o in range(4):
            low = 24 - 8 * o
            path, rest = band << 10 | o << 8 | r >> low & 255, (r >> low + 8) << low | r & ((1 << low) - 1)
            order = np.lexsort((rest, path))
            n = len(r)
            parts.append([np.ones(n, np.int32), path[order], rest[order], np.full(n, 24), 1000 + order, prints[order]])
    return parts


def flipped(base, bits):
    out = np.unpackbits(base.view(np.uint8), bitorder="little")
    out[bits] ^= 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def met(x, y):
    """Whether two fingerprints are alike enough in a band."""
    return any(bin((int(a ^ b) >> h) & 0xFFFFFFFF).count("1") <= similar.BUDGET for a, b in zip(x, y, strict=True) for h in (0, 32))


@pytest.mark.parametrize("together", [True, False])
def test_possible_pairs_are_connected_by_few_links(together):
    rng = np.random.default_rng(3)
    bases = rng.integers(0, 1 << 63, (6, similar.WORDS)).astype(np.uint64)
    prints = np.stack([flipped(bases[k % 6], rng.choice(384, int(rng.integers(0, 60)), replace=False)) for k in range(240)])
    most = 80
    links = [(1000 + i, 1000 + j) for i in range(240) for j in range(i) if np.bitwise_count(prints[i] ^ prints[j]).sum() <= most and met(prints[i], prints[j])]
    want = plain_components(range(1000, 1240), links)
    parts = band_rows(prints)
    if together:
        parts = [[np.concatenate(c) for c in zip(*parts, strict=True)]]
    found = [(a, b) for cols in parts for a, b in zip(*(c.to_pylist() for c in similar._join(cols, most).columns), strict=True)]
    assert plain_components(range(1000, 1240), found) == want and len(links) > 2000 and len(found) < 4 * 240


def test_followers_of_different_leaders_are_compared():
    rng = np.random.default_rng(4)
    base, order = rng.integers(0, 1 << 63, similar.WORDS).astype(np.uint64), np.concatenate([32 + rng.permutation(352), np.arange(32)])
    places = [0, 30, 60, 120, 150, 180]  # alike in the first band; the leaders are too far apart, followers are not
    prints = np.stack([flipped(base, order[:p]) for p in places])
    links = {(a, b) for a, b in zip(*(c.to_pylist() for c in similar._join(band_rows(prints)[0], 65).columns), strict=True)}
    assert plain_components(range(1000, 1006), links) == dict.fromkeys(range(1000, 1006), 1000)


def test_sets_of_a_group_against_all_pairs():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(45, 61)], rng.integers(0, 1 << 62, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(120)] + [np.zeros(0, np.uint64)]
    plain = [set(s.tolist()) for s in sets]
    links = [(i, j) for i in range(121) for j in range(i) if share(plain[i], plain[j]) >= 0.8]
    want = plain_components(range(121), links)
    assert similar._grouped(sets, 0.8).tolist() == [want[i] for i in range(121)]
    for i, j in ((0, 1), (2, 3), (0, 0)):
        assert similar._grouped([sets[i], sets[j]], 0.8).tolist() == [0, 0 if share(plain[i], plain[j]) >= 0.8 else 1]


def test_bound_of_possible_pairs_loses_none_at_the_similarity():
    rng, most, lost = random.Random(1), similar.threshold(0.8), 0
    for _ in range(400):
        a = [f"w{rng.randint(0, 10**6)}" for _ in range(404)]
        b, at = a[:], rng.randrange(360)
        b[at : at + 40] = [f"y{rng.random()}" for _ in range(40)]
        a, b = (" ".join(x).encode() for x in (a, b))
        s, t = (set(similar.shingle_hashes(x, 5).tolist()) for x in (a, b))
        assert len(s & t) >= 0.8 * len(s | t)
        lost += int(np.bitwise_count(similar.wide_fingerprint(a, 5) ^ similar.wide_fingerprint(b, 5)).sum()) > most
    assert lost <= 1


def test_components_of_a_chain(spark):
    ids = list(range(200))
    random.shuffle(ids)
    df = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(199)] + [(900, 901), (902, 902)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == dict.fromkeys(range(200), 0) | {900: 900, 901: 900}


def test_pii_base():
    text = "x" * 50 + "a.b@c.d.e,@f.g h@i j@k.l@m.n 1.2.3.4.5.6.7.8 999.1.1.1 no 4539 5787 6362 1486 +1 (052) 555-0934 +12 3456 +4-4"
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    want = [(0, *m.span()) for m in email.finditer(text)] + [(1, *m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    got = pii.base_spans(text)
    assert [s for s in got if s[0] < 2] == want
    assert [text[s:e] for k, s, e in got if k == 2] == ["4539 5787 6362 1486"]
    assert [text[s:e] for k, s, e in got if k == 3] == ["+1 (052) 555-0934"]


def test_pii_base_on_long_runs_of_digits():
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(1, 0, 5006)]
    assert pii.base_spans("9" * 5000 + ".1.1.1 " + "1" * 6000 + " +" + "2" * 6000) == []
    assert pii.base_spans("255.256.1.1 00255.0.0.000 1.2.3.1000") == [(1, 12, 25)]


def test_pii_base_by_the_plain_patterns():
    rng = random.Random(6)
    plain = {2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"}
    holds = {
        0: lambda m: True,
        1: lambda m: all(int(p) <= 255 for p in m.split(".")),
        2: lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0,
        3: lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    found = Counter()
    for _ in range(3000):
        t = "".join(rng.choice("0123456789 .-+()@a") for _ in range(60)) + rng.choice(["", " 4539578763621486", " 4539 5787 6362 1486", "x4539-5787 63621486-", " 10.0.0.7", "1.1.2.3.4.5"])
        want = [(k, *m.span()) for k in range(4) for m in re.finditer(plain[k], t) if holds[k](m[0])]
        assert pii.base_spans(t) == want, t
        found.update(k for k, *_ in want)
    assert all(found[k] > 10 for k in range(4))


def test_marginals_of_the_field_by_enumeration():
    import itertools

    rng = np.random.default_rng(5)
    texts = ["a1b2 c3 a1b2 +1 555 mia@x.org", "mia.k@x.org 77", "x 12 y"]
    bases = [pii.base_spans(t) for t in texts]
    f = pii.Field(texts, bases)
    labels = 1 + len(pii.KINDS)
    w = pii.Weights(rng.normal(0, 0.3, (pii.FEATURES, labels)), rng.normal(0, 0.3, (labels, labels)), 0.7)
    unary = f.x @ w.node
    total, sums = 0.0, np.zeros((f.n, labels))
    for y in itertools.product(range(labels), repeat=f.n):
        if any(b and y[i] != b for i, b in enumerate(f.base)):
            continue
        p = np.exp(sum(unary[i, y[i]] for i in range(f.n) if not f.base[i]) + sum(w.chain[y[a], y[b]] for a, b in f.chain) + sum(w.skip * (y[a] == y[b]) for a, b in f.skip))
        total += p
        for i in range(f.n):
            sums[i, y[i]] += p
    assert f.n >= 6 and len(f.skip) and len(f.chain)
    assert np.abs(pii.propagate(f, w) - sums / total).max() < 0.03  # loops are short of exact


def test_pii_field(spark, docs, rows):
    got = {r["doc_id"]: r for r in collected(pii.find_pii(docs))}
    r = got[3 * 13 + 1]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[1]["spans"] == ""
    # A number that repeats the end of a phone number, and a name of an address, far away in the same text.
    texts = [(i, f"{words(20)} +1 (052) 555-09{i:02} {words(30)} mia.k{i}@mail.example.com {words(50)} 052555-09{i:02} {words(9)} mia.k{i} {words(5)} 17 pages") for i in range(40)]
    texts += [(100 + i, f"{words(20)} in {1900 + i} there were {i} of {100 + i}") for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"].split(",") for r in collected(pii.find_pii(df))}
    for i, t in texts[:40]:
        found = {(s.split(":")[0], t[int(s.split(":")[1]) : int(s.split(":")[2])]) for s in got[i]}
        assert {("phone", f"+1 (052) 555-09{i:02}"), ("email", f"mia.k{i}@mail.example.com"), ("phone", f"052555-09{i:02}"), ("email", f"mia.k{i}")} <= found
        assert not any("17" == x for _, x in found)
    assert all(got[100 + i] == [""] for i in range(40))


def test_evidence_reaches_all_repeats():
    n, labels = 40, 1 + len(pii.KINDS)
    f = pii.Field([" ".join(["x1234"] * n)], [[(3, 0, 5)]])
    f.chain = f.chain[:0]
    assert len(f.skip) == n - 1
    p = pii.propagate(f, pii.Weights(np.zeros((pii.FEATURES, labels)), np.zeros((labels, labels)), 4.0))
    step = np.exp(4.0 * np.eye(labels))
    step /= step.sum(axis=1)
    want = [np.linalg.matrix_power(step, i)[4] for i in range(n)]
    assert np.abs(p - want).max() < 1e-4


def test_ngram_scores(docs, rows):
    got = collected(ngram_lm.ngram_scores(docs, block_bytes=20_000))
    assert len(got) == len(rows)
    texts = [(i, (t or "").encode().lower().split()) for i, t, *_ in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter()  # of n-grams; the start of a text is 0, its end None
    for i, w in texts:
        if not held(i):
            line = [0, *w, None]
            count.update((x,) for x in line)
            count.update(zip(line, line[1:], strict=False))
            count.update(zip(line, line[1:], line[2:], strict=False))
    n, v = sum(c for g, c in count.items() if len(g) == 1 and g != (0,)), sum(len(g) == 1 and g != (0,) for g in count)

    def p(gram):
        if len(gram) == 1:
            return (count[gram] + 1) / (n + v + 1)
        m = ngram_lm.PRIOR[len(gram) - 2]
        return (count[gram] + m * p(gram[1:])) / (count[gram[:-1]] + m)

    by = {r["doc_id"]: r for r in got}
    for i, w in texts:
        line, r = [0, *w, None], by[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w) + 1, sum(count[(x,)] > 0 for x in line[1:]), n)
        assert math.isclose(r["base_score"], sum(math.log10(p((x,))) for x in line[1:]), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(tuple(line[max(0, k - 2) : k + 1]))) for k in range(1, len(line))), rel_tol=1e-9)


def test_the_automaton_by_hand():
    """Two failure arcs in a row, from a history of two words to the root, and states that are carried on."""
    local = [b"a", b"b", b"c", b"z"]
    keys = np.array([int(ngram_lm.END_KEY), int(ngram_lm.START_KEY), *map(xxhash.xxh64_intdigest, local)], np.uint64)
    a, b, c, z, end = 2, 3, 4, 5, ngram_lm.END
    row = {"ids": [1, 2], "held": [False, True], "lengths": [4, 5], "words": keys.tobytes(), "tokens": zlib.compress(np.array([a, b, c, end, a, b, z, b, end], np.uint16).tobytes())}
    block = ngram_lm._Block(row)
    words, grams = block.counts()
    m = ngram_lm.Automaton(block, words, grams, 4, 4, (2.0, 3.0))
    assert m.kind[m.to].tolist()[:3] == [2, 2, 2] and m.kind[m.to].tolist()[4:8] == [2, 2, 0, 1]
    root = lambda n: (n + 1) / 9
    one = lambda n: (n + 2 * root(1)) / 3
    two = lambda n: (n + 3 * one(1)) / 4
    first = [one(1), two(1), two(1), two(1)]
    # a and b as above; z fails from (a, b) to b to the root and leaves it there; b then comes from the root, the end from b
    second = [one(1), two(1), 3 / 4 * (2 / 3) * root(0), root(1), 2 / 3 * root(1)]
    assert m.scores() == pytest.approx([sum(map(math.log10, x)) for x in (first, second)])


def test_messages_follow_the_distinct_ngrams(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, False, " ".join(f"w{rng.randint(0, 50)}" for _ in range(20)).encode()) for i in range(400)], "doc_id long, held boolean, text binary").repartition(4)
    blocks = ngram_lm._blocks(df, 200).cache()
    sent = ngram_lm._asked(blocks, 300).agg(F.count("*"), F.sum(F.col("n_words") + F.col("n_grams")), F.min(F.col("n_words") + F.col("n_grams"))).first()
    assert blocks.count() > 200 and sent[0] <= sent[1] <= 3 * 22 * 400 and sent[2] >= 1


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    random.seed(3)
    follows = {w: random.sample(WORDS, 2) for w in WORDS}

    def walk(n):
        out = [random.choice(WORDS)]
        while len(out) < n:
            out.append(random.choice(follows[out[-1]]))
        return " ".join(out)

    df = spark.createDataFrame([(i, walk(200)) for i in range(200)], "doc_id long, text string")
    held = [r for r in collected(ngram_lm.ngram_scores(df)) if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert len(held) > 10 and gain > 0.5  # log10 of five is what two followers of ten words save


def test_mixing(docs, rows, spark):
    got = collected(mixing.mix(docs, targets={"lang": {"en": 1, "de": 2, "": 1}}))
    assert len(got) == len(rows)
    by = Counter()
    for r in got:
        by[r["lang"]] += r["weight"] * r["n_tokens"]
    assert by["de"] / by["en"] == pytest.approx(2, rel=1e-6) and all(r["margins_met"] for r in got)
    assert all(0 <= r["probability"] <= 1 for r in got)
    total = sum(r["n_tokens"] for r in got)
    assert sum(r["probability"] * r["n_tokens"] for r in got) / total == pytest.approx(mixing.KEEP, rel=0.01)
    assert mixing.sample(docs).columns == docs.columns
    # Targets that the cells cannot meet together are reported.
    cells = spark.createDataFrame([("a", "x", 10), ("b", "y", 10)], "source string, lang string, tokens long")
    assert mixing.rake(cells, ["source", "lang"], {"source": {"a": 1, "b": 1}, "lang": {"x": 1, "y": 3}}, most=8).first().error > 0.1
    assert mixing.rake(cells, ["source", "lang"], {"source": {"a": 1, "b": 3}, "lang": {"x": 1, "y": 3}}).first().error < 1e-9
    texts = {"1 22 333 4 55": "numbers", "a | b | c": "tables", "f(x) = {y; z}": "code", "so it is, and no more": "prose", "- a\n- b\n- c": "lists", "Who? She! He?": "dialogue", "": "prose"}
    assert {r.text: r.topic for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.topic_of().alias("topic")).collect()} == texts


def test_url_filter(spark):
    urls = [None, "", "nonsense", "http://A.Example.org/es/1", "https://example.org/en/12#x", "http://notexample.org/en/1", "http://example.org", "ftp://x.com/fr/?q", "http://y.com/de/é", "http://z.net/a.pdf?x", "http://z.net/login", "http://z.net/logins", "http://z.net/cart", "http://z.net/?sid=4", "http://z.net/ok"]
    urls += ["http://foo bar.org/x", "http://a\nb.org\n", "http://b.org\n/x", "http:// org/q", "http://org", "http://x.COM/fr/", "http://x.com /fr/", "http://user@x.com:80/fr/", "http://x.com/de/\n" + "y" * 200_000, "://com/fr/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in collected(url_filter.judge(df))}
    rules = sorted(url_filter.SITE_RULES, key=lambda r: -len(r.name))
    for i, u in enumerate(urls):
        host, path = url_filter.split_url(u)
        fits = [r for r in rules if (host == (h := r.name.partition("/"))[0] or host.endswith("." + h[0])) and path.startswith("/" + h[2])]
        pattern = next((r for r in url_filter.PATTERN_RULES if re.search(r.pattern, u or "")), None)
        want = fits[0].verdict if fits else pattern.verdict if pattern else "allow"
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, fits[0].name if fits else None, want), u
    assert got[3]["rule"] == "example.org/es/" and got[6]["rule"] is None and got[9]["verdict"] == "block"


def test_url_filter_on_repeated_rows_and_other_columns(spark):
    rows = [(1, "http://a.org/x", "h", "r"), (1, "http://a.org/x", "h", "r"), (None, "http://a.org/x", None, None)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string, rule string"))
    assert sorted((r.page_id or 0, r.host, r.rule) for r in got.collect()) == [(0, "a.org", "org/"), (1, "a.org", "org/"), (1, "a.org", "org/")]


def test_url_filter_finds_rules_whose_literal_is_part_of_a_token(spark):
    urls = [f"http://z.net/{x}" for x in ("userlogin", "accountlogin", "user/login", "a/userlogin?x=1", "login", "userlogins", "mylogin")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["pattern"]) for r in collected(url_filter.judge(df))}
    assert [got[i] for i in range(7)] == [("block", "login")] * 5 + [("allow", None)] * 2


def test_literals_are_whole_tokens_of_what_fits():
    fits = {"tracking": ["?utm_source=spam", "&utm_source=ads"], "print": ["?print=1", "&print=true"], "calendar": ["/calendar/2020/1"], "cart": ["/cart", "/cart/", "/cart?x"], "wp admin": ["/wp-admin/"], "login": ["/login", "/userlogin", "/accountlogin", "/user/login"]}
    for rule in url_filter.PATTERN_RULES:
        for part in fits.get(rule.name, [f".{rule.name[5:]}", f".{rule.name[5:]}?x"] if rule.name.startswith("file ") else []):
            assert re.search(rule.pattern, f"http://z.net/a{part}")
            assert set(rule.literals) <= set(re.findall("[a-z0-9]+", f"http://z.net/a{part}")), rule.name


def plain_signature(text):
    def hashed(*xs):
        h = 42
        for x in xs:
            h = xxhash.xxh64(x if isinstance(x, bytes) else x.to_bytes(8 if isinstance(x, np.int64) else 4, "little", signed=True), seed=h).intdigest()
        return h

    w, k, low = [x.encode() for x in re.split(r"[\x20\x09-\x0D]+", text) if x], order_minhash.K, (1 << order_minhash.ORDER) - 1
    seen, elements = Counter(), []
    for i in range(max(0, len(w) - k) + 1 if w else 0):
        h = hashed(*w[i : i + k]) & low
        n, seen[h] = seen[h], seen[h] + 1
        elements.append((hashed(h.to_bytes(8, "little"), n) & low if n else h, i))
    out = []
    for j, start in enumerate(sorted(order_minhash.starts())):
        two = sorted(elements, key=lambda e: ((e[0] - start - 1) & low, e[1]))[:2]
        two = sorted(2 * two if len(two) == 1 else two, key=lambda e: e[1])
        out.append(hashed(j, *(e.to_bytes(8, "little") for e, _ in two)) & 0xFFFFFF if two else 0)
    return out


def test_order_minhash(spark, docs, rows):
    got = collected(order_minhash.fingerprints(docs))
    assert len(got) == len(rows)
    texts = sorted((i, t or "") for i, t, *_ in rows)
    by = {r["doc_id"]: r for r in got}
    like = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / order_minhash.SIZE
    for (i, t), (_, nxt) in zip(texts, [*texts[1:], texts[0]], strict=True):
        if [x for x, _ in texts].count(i) > 1:
            continue
        half, r = len(t) // 2, by[i]
        edited = t[: len(t) - half] + nxt[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if len(t) + len(nxt) < 20_000:
            a, b, c = plain_signature(t), plain_signature(edited), plain_signature(nxt)
            assert r["fingerprint"] == "".join(f"{x:06x}" for x in a) and r["edited_fingerprint"] == "".join(f"{x:06x}" for x in b)
            assert (r["near_edited"], r["near_next"]) == (like(a, b), like(a, c))


def test_likeness_is_not_biased_by_length(spark):
    rng = random.Random(2)
    whole = [[f"w{rng.random()}" for _ in range(2000)] for _ in range(16)]
    df = spark.createDataFrame([(" ".join(w), " ".join(w[:1001])) for w in whole], "a string, b string")
    signed = df.select(F.expr(order_minhash.signature_sql("a")).alias("a"), F.expr(order_minhash.signature_sql("b")).alias("b"))
    mean = signed.agg(F.avg(order_minhash.likeness("a", "b"))).first()[0]
    assert abs(mean - 0.25) < 0.08, mean  # both k-mers of a tuple lie in the first half


def test_order_minhash_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "RANGE", 3)
    ids = [*random.sample(range(-500, 10_000), 57), 1 << 62, -(1 << 62), (1 << 62) + 1]  # far ids leave the others' ranges as they are
    ranges = order_minhash._dealt(spark.createDataFrame([(i,) for i in ids], "doc_id long"))[0].groupBy("range").count()
    assert ranges.agg(F.max("count")).first()[0] <= 12
    df = spark.createDataFrame([(i, f"t{i} {words(8)}") for i in ids], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in df.collect()}
    ids.sort()
    for r in order_minhash.fingerprints(df).collect():
        t, nxt = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % 60]]
        half = len(t) // 2
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder():
    texts = ["", "a  b\n\n c", "it's  \t x", "é" * 99, "   \x1c\x85 x", "<|endoftext|> 12 34-56", "".join(chr(random.choice([32, 10, 65, 233, 0x4E2D, 39, 48])) for _ in range(2000)), LONG[:5000]]
    assert [np.frombuffer(b, np.uint32).tolist() for b in tokens.encoder().encode(texts)] == library_ids(texts)


def test_token_counts(docs, rows, tmp_path, spark):
    got = collected(token_counts.token_counts(docs, block=196))
    want = [(i, len(x)) for (i, *_), x in zip(rows, library_ids([r[1] or "" for r in rows]), strict=True)]
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted(want)
    ids = [[5, 6], [], [7] * 40, [8]]
    for width, big in ((2, 9), (4, token_counts.SEPARATOR + (1 << 16))):  # an id whose lower half is the separator's
        folder = tmp_path / str(width)
        folder.mkdir()
        stream = [x for d in ids for x in [*d, token_counts.SEPARATOR]]
        (folder / "a.bin").write_bytes(np.array([*stream, big, 9], f"<u{width}").tobytes())
        (folder / "b.bin").write_bytes(b"")
        spans = collected(token_counts.document_spans(token_counts.separators(token_counts.list_token_files(spark, str(folder), width), block=28)))
        assert sorted((r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in spans) == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 40, True), (3, 45, 1, True), (4, 47, 2, False)]


@pytest.mark.parametrize("counts", [{5: 3}, {60: 5, 50: 7, 3: 1}, {63: 4, 1: 2}, {33: 9, 40: 2, 7: 5}, {}])
def test_windows(counts):
    have = np.zeros(64, np.int64)
    for k, n in counts.items():
        have[k] = n
    plan = packing.plan_windows(have, 64, tolerance=0)
    total = 0
    for times, pattern, _, head in plan:
        size = int((pattern * np.arange(64)).sum()) + head
        assert size <= 64
        total += times * size
    assert total == int((have * np.arange(64)).sum())
    assert sum(p[0] for p in plan) == -(-total // 64)


def test_fill_is_closest():
    for _ in range(50):
        have = np.zeros(40, np.int64)
        for _ in range(random.randint(0, 6)):
            have[random.randint(1, 39)] += random.randint(1, 3)
        goal, sums = random.randint(1, 70), {0}
        for k in range(1, 40):
            for _ in range(have[k]):
                sums |= {s + k for s in sums}
        got = packing.fill(have, goal)
        assert (got <= have).all() and int((got * np.arange(40)).sum()) == max(s for s in sums if s <= goal)


def test_packing(docs, rows):
    got = collected(packing.pack(docs, capacity=64))
    want = {i: [*x, tokens.END] for (i, *_), x in zip(rows, library_ids([r[1] or "" for r in rows]), strict=True)}
    covered, sequences = Counter(), {}
    for r in got:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], np.uint32).tobytes())
        covered.update((r["doc_id"], k) for k in range(r["start"], r["start"] + r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    times = Counter(r[0] for r in rows)
    assert covered == Counter({(i, k): times[i] for i, ids in want.items() for k in range(len(ids))})
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist() and sum(n for _, n in parts) <= 64


def test_markup_that_never_ends_takes_no_longer():
    import time

    began = time.process_time()
    for t in (b"<" * 5_000_000, b"<script>" * 300_000, b"<style><script>" * 100_000, b"<script>" + b"</script " * 300_000):
        assert language_id.strip_markup(t)
    assert time.process_time() - began < 10
    assert language_id.strip_markup(b"a<script x='1'>b<i>c</i></script>d<Style>q</sTyle >e<p>f < g") == b"a d e f < g"


def test_language_id(spark):
    random.seed(1)
    en, de = "the of and to in that was for with this".split(), "der die und das nicht ein ist mit auf für".split()
    text = lambda v, n: " ".join(random.choice(v) for _ in range(n))
    docs = [(i, text(en if i % 2 else de, 60), "en" if i % 2 else "de", "s") for i in range(80)]
    docs += [(100, "#$ 0x9f8e7d6c5b4a " * 40, None, "s"), (101, None, "en", None), (102, "", None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in collected(language_id.identify_documents(df))}
    assert all(got[i]["lang"] == lang and got[i]["accepted"] for i, _, lang, _ in docs[:80])
    assert not got[100]["accepted"] and got[101]["lang"] == "en"
    assert {r.doc_id for r in language_id.keep_identified(df).collect()} >= set(range(80))
    model = language_id.fit_text(df)
    short = [(i, f"http://h.x.{'de' if i % 2 else 'uk'}/{i}", f"<html><body>{text(de if i % 2 else en, 30)}</body></html>") for i in range(30)]
    short += [(90, "http://h.x.de/q", "<html><script>the of and</script></html>"), (91, None, None)]
    pages = spark.createDataFrame(short, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in collected(language_id.identify_pages(pages, model))}
    assert all(got[i]["lang"] == ("de" if i % 2 else "en") for i in range(30)) and len(got) == 32
    assert got[90]["lang"] == "de"  # by its address alone


def test_language_posterior_by_plain_bayes(spark):
    """The fused posterior of pages, worked out row by row from the text model's evidence."""
    random.seed(9)
    vocab = {"en": "the of and to in that was for with this".split(), "de": "der die und das nicht ein ist mit auf für".split(), "fr": "le la et les des une est pour dans que".split()}
    text = lambda lang, n: " ".join(random.choice(vocab[lang]) for _ in range(n))
    train = [(i, text(lang, 50), lang) for i, lang in enumerate(["en", "de", "fr"] * 20)]
    model = language_id.fit_text(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    rows = []
    for i in range(90):
        lang = random.choice(["en", "de", "fr"])
        host = random.choice([None, f"a{i % 4}.x.{lang}", f"b.y{i % 2}.org", "solo.de"])
        rows.append((i, None if i % 17 == 0 else text(lang, random.choice([1, 3, 30])), random.choice([None, lang, lang.upper(), "xx"]), host, "clash"))
    rows += [rows[5], rows[5], (None, "der die das", "de", "b.y1.org", "clash"), (900, "", None, None, None), (901, "le " * 200_000, "fr", "solo.de", "clash")]
    df = spark.createDataFrame(rows, "page_id long, text string, declared string, host string, p0 string")
    df = df.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", language_id.domain_of(F.col("host")))
    found = collected(language_id.identify(df, ["page_id"], model, declared="declared", suffix="suffix", host="host", domain="domain"))
    assert len(found) == len(rows)

    n = len(model.langs)
    ev = [model.evidence((r[1] or "").encode()) for r in rows]
    own = [np.exp(e - e.max()) / np.exp(e - e.max()).sum() for e in ev]
    values = [{"declared": r[2] and r[2].lower(), "host": r[3], "suffix": r[3] and r[3].split(".")[-1], "domain": r[3] and ".".join(r[3].split(".")[-2:])} for r in rows]
    every = sum(own)
    sums, count = {}, Counter()
    for v, p in zip(values, own, strict=True):
        for e, x in v.items():
            if x is not None:
                sums[e, x] = sums.get((e, x), 0) + p
                count[e, x] += 1
    want = {}
    for r, v, e, p in zip(rows, values, ev, own, strict=True):
        score, prior = e.copy(), (every + 1) / (len(rows) + n)
        for k in ("declared", "suffix"):
            if v[k] is not None:
                kinds = len({x for kind, x in sums if kind == k})
                score += np.log((sums[k, v[k]] + language_id.ALPHA) / (every + language_id.ALPHA * (kinds + 1)))
        for k in ("domain", "host"):
            if v[k] is not None:
                prior = (np.maximum(sums[k, v[k]] - p, 0) + language_id.KAPPA * prior) / (count[k, v[k]] - 1 + language_id.KAPPA)
        score += np.log(prior)
        post = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        want[r[0]] = (model.langs[int(post.argmax())], round(float(post.max()), 6), post.argmax() != n - 1 and post.max() >= 0.5)
    for r in found:
        lang, probability, accepted = want[r["page_id"]]
        assert r["lang"] == lang and r["probability"] == pytest.approx(probability, abs=2e-6) and r["accepted"] == accepted, r


def test_pipeline(spark, tmp_path, docs, rows):
    random.seed(2)
    clean = [(1000 + i, words(40 + i), "en", f"s{i % 3}") for i in range(60)]
    near = [(2000 + i, clean[i][1] + " x", "en", "s0") for i in range(5)]
    exact = [(3000 + i, clean[i][1], "en", "s1") for i in range(7)]
    df = spark.createDataFrame([*clean, *near, *exact], "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [at.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == df.columns
        kept.append(at.count())
    assert kept[1] == 72 and kept[2] == 65 and kept[3] <= 65 and 0 < kept[4] <= kept[3]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in at.select("doc_id").collect()}
