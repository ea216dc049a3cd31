"""Document fingerprints by Order MinHash, in built-in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import materialize, whole_text
from graphloom.plans import ordered

#: Words of a k-mer and numbers of a signature; a tuple has two k-mers.
K, SIZE = 3, 32
#: Bits of a k-mer's place in its text, as a text has under 2**31 bytes; the 33 bits above them order the k-mers.
PLACE = 30
ORDER = 63 - PLACE
#: Documents of a range of ids, within which the next document is sought; a range of over four times as many is divided.
RANGE = 1_000
#: Ranges whose first ids are broadcast: some 40 bytes each.
FEW = 1_000_000


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with name standing for value, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def starts(size: int = SIZE) -> list[int]:
    """Where the order of each number of a signature begins on the ring of k-mer orders: a Weyl sequence, evenly spread."""
    return [(j * 0x9E3779B97F4A7C15 + 0x3C6EF372FE94F82B) % (1 << 64) >> (64 - ORDER) for j in range(size)]


def signature_sql(text: str, k: int = K, size: int = SIZE) -> str:
    """SQL for the signature of a text, `size` numbers of 24 bits.

    Words are runs without ASCII white space. A k-mer is k words (a shorter text: all of them) and has a random order.
    Sorting orders with places brings equal k-mers together in text order, which numbers their occurrences: in sorted
    order, the j-th element (from 0) that repeats its left neighbour, at i, has i - j first occurrences up to it, so its
    k-mer's first one is that of index i - j - 1. Numbered occurrences get orders of their own.

    Number j ranks all of them by their order less a start of its own, modulo the orders there are, which is a random
    ranking as well. Its two smallest are those that follow the start on the ring of sorted orders; sorting all starts in
    among the k-mers finds them: the j-th start in order, at i, has i - j k-mers before it. The pair is put back
    into the order of the text and hashed, so a number changes where either k-mer goes or the two change places.
    """
    low = (1 << PLACE) - 1
    order, place = f"shiftright(v[i], {PLACE})", f"(v[i] & {low})"
    words = f"filter(split({text}, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x != '')"
    each = f"xxhash64(slice(w, i + 1, {k}))" if k > 4 else f"xxhash64({', '.join(f'get(w, i + {j})' for j in range(k))})"  # a slice would be copied
    kmers = f"if(size(w) = 0, cast(array() as array<bigint>), transform(sequence(0, greatest(0, size(w) - {k})), i -> shiftleft({each} & {(1 << ORDER) - 1}, {PLACE}) + i))"
    alike = f"(v[i] ^ v[i - 1]) <= {low}"
    first, again = f"filter(sequence(0, size(v) - 1), i -> i = 0 or not ({alike}))", f"filter(sequence(1, size(v) - 1), i -> {alike})"
    numbered = f"transform(r, (i, j) -> shiftleft(xxhash64({order}, i - f[i - j - 1]) & {(1 << ORDER) - 1}, {PLACE}) + {place})"
    every = f"if(size(v) < 2, v, {_let(again, 'r', 'if(size(r) = 0, v, ' + _let(first, 'f', f'sort_array(concat(transform(f, i -> v[i]), {numbered}))') + ')')})"
    marks = "array(" + ", ".join(f"{(s << PLACE) + low}L" for s in sorted(starts(size))) + ")"
    at = f"filter(sequence(0, size(m) + {size - 1}), i -> (g[i] & {low}) = {low})"
    one, two = "m[(x - j) % size(m)]", "m[(x - j + 1) % size(m)]"
    by_place = f"if(({one} & {low}) < ({two} & {low}), xxhash64(j, shiftright({one}, {PLACE}), shiftright({two}, {PLACE})), xxhash64(j, shiftright({two}, {PLACE}), shiftright({one}, {PLACE})))"
    tuples = f"transform({_let(f'sort_array(concat(m, {marks}))', 'g', at)}, (x, j) -> cast({by_place} & 16777215 as int))"
    signed = f"if(size(m) = 0, cast(array_repeat(0, {size}) as array<int>), {tuples})"
    return _let(words, "w", _let(f"sort_array({kmers})", "v", _let(every, "m", signed)))


def signature_text(signature: str) -> Column:
    """A signature as hex digits, six for each number."""
    return F.expr(f"array_join(transform({signature}, x -> lpad(lower(hex(x)), 6, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """Share of equal numbers of two signatures."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1D, 0D)), 0D, (s, x) -> s + x) / size({a})")


def _dealt(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with `range`, so that each holds ids that follow one another, and how many ranges there are at most.

    Ranges are as wide as leaves about RANGE rows in each if ids are spread evenly. Where they are not, ranges of over four
    times as many rows are divided anew, by their own span, until none is left but for repeated ids.
    """
    rows = rows.withColumn("range", F.lit("")).withColumn("__open", F.lit(True))
    ranges = rows.where("__open").select("doc_id").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).withColumn("range", F.lit("")).where("n > 0")
    total, bits = 1, 64
    while True:
        sizes = ranges.agg(F.min(F.expr(f"ceil(log2((cast(high as double) - low + 1) * {RANGE} / n))")), F.count("*")).first()
        if not sizes[1]:
            return rows.drop("__open"), total
        bits, count = max(0, min(int(sizes[0]), bits - 1, 62)), sizes[1]
        path = F.concat_ws("/", "range", F.shiftright("doc_id", bits).cast("string"))
        rows = rows.withColumn("range", F.when(F.col("__open"), path).otherwise(F.col("range")))
        found = materialize(rows.where("__open").groupBy("range").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")), "ranges")
        total += found.count()
        ranges = found.where(f"n > {4 * RANGE} and high > low")
        if not bits or ranges.isEmpty():
            return rows.drop("__open"), total
        ranges = materialize(ranges, "ranges")
        more = ranges.select("range", F.lit(True).alias("__more"))
        rows = rows.drop("__open").join(F.broadcast(more) if total <= FEW else more, "range", "left").withColumn("__open", F.coalesce("__more", F.lit(False))).drop("__more")


def _firsts(rows: DataFrame) -> DataFrame:
    """For each range of (doc_id, range) its least id, and the range before it; before the first comes the last."""
    least = materialize(rows.groupBy("range").agg(F.min("doc_id").alias("least")), "firsts")
    last = least.agg(F.max_by("range", "least")).first()[0]
    before = ordered.previous(least, "least", "range", "before")
    return before.select("least", F.coalesce("before", F.lit(last)).alias("range"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row per row.

    The next document is the one of the next larger id (ties: by text, so that repeated rows follow each other); after
    the last comes the first, and rows without an id, by their texts, come before all others. Its first floor(n_chars / 2)
    code points, or all, replace as many at the end of the edited text. Null texts are empty; texts without words are all
    alike; an empty table gives an empty result; other columns are ignored. A single document is its own next one.

    Texts move once, to ranges of ids; the first document of each range goes to the range before as well.
    """
    least = -(1 << 63)
    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(least)).alias("doc_id"), whole_text(text).alias("text"))
    dealt, count = _dealt(rows)
    firsts = materialize(_firsts(dealt.select("doc_id", "range")), "firsts")
    # One row of those that share a range's least id goes before it: the first by text, as rows follow each other.
    heads = dealt.join(F.broadcast(firsts) if count <= FEW else firsts, dealt["doc_id"] == firsts["least"]).groupBy(firsts["range"]).agg(F.min(F.struct(dealt["doc_id"], "text")).alias("h"))
    guards = heads.select(F.lit(None).cast("long").alias("__id"), "h.doc_id", "h.text", "range", F.lit(1).alias("guard"))
    signed = dealt.withColumn("guard", F.lit(0)).select("__id", "doc_id", "text", "range", "guard").unionByName(guards).withColumn("signature", F.expr(signature_sql("text")))
    follow = Window.partitionBy("range").orderBy("guard", "doc_id", "text")
    pairs = signed.select("__id", "text", "guard", "signature", F.lead("text").over(follow).alias("next_text"), F.lead("signature").over(follow).alias("next_signature")).where("guard = 0")
    pairs = pairs.withColumn("edited", F.expr("concat(substring(text, 1, cast(length(text) - length(text) div 2 as int)), substring(next_text, 1, cast(length(text) div 2 as int)))"))
    pairs = pairs.withColumn("edited_signature", F.expr(signature_sql("edited")))
    return pairs.select(F.col("__id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), signature_text("signature").alias("fingerprint"), signature_text("edited_signature").alias("edited_fingerprint"), likeness("signature", "edited_signature").alias("near_edited"), likeness("signature", "next_signature").alias("near_next"))
