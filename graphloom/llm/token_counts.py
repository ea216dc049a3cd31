"""Token counts of documents in flat token files without an index, by a scan for separators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import materialize, own_dir, whole_text
from graphloom.llm.tokens import encoder
from graphloom.sources.files import list_files

#: The vocabulary's own end of a text, which no text encodes to.
SEPARATOR = 50256
#: Bytes of a block, which one read takes in.
BLOCK = 1 << 20

#: part: "file" for a flat file of `size` bytes, `width` a token, "ids" for a piece of the list of documents that it holds, in order.
_LISTING = "file long, part string, path string, size long, width int, first long, ids array<long>"


def write_token_files(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """Write flat files, one for each partition of docs, of each text's ids and a separator; return what lists them.

    Files are bare little-endian ids of two bytes, or of four where the vocabulary has more than those count. The list
    of documents goes beside, as a corpus builder keeps it. Null texts are empty. A task that runs again writes another
    file; files that the listing does not name are none. The folder is one that pyarrow's file systems reach from all
    executors, as the shared folder is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, file, listed = encoder(vocabulary), TaskContext.get().partitionId(), 0
        width = 2 if max(code.tokenizer.get_vocab_size(), separator + 1) <= 1 << 16 else 4
        end = separator.to_bytes(width, "little")
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path)
        name = f"tokens-{file:06d}-{uuid.uuid4().hex}.bin"

        def row(part: str, size: int | None, first: int | None, ids: pa.Array | None) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids) if ids is not None else pa.array([None], pa.list_(pa.int64()))
            cols = [pa.array([file]), pa.array([part]), pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([width], pa.int32()), pa.array([first], pa.int64()), lists]
            return pa.RecordBatch.from_arrays(cols, ["file", "part", "path", "size", "width", "first", "ids"])

        with system.open_output_stream(f"{path}/{name}") as out:
            for whole in batches:
                for k in range(0, whole.num_rows, 512):
                    b = whole.slice(k, 512)
                    for ids in code.encode(b.column(1).to_pylist()):
                        out.write(np.frombuffer(ids, np.uint32).astype(f"<u{width}").tobytes() + end)
                    yield row("ids", None, listed, b.column(0).cast(pa.int64()))
                    listed += b.num_rows
            size = out.tell()
        yield row("file", size, None, None)

    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(run, _LISTING)


def list_token_files(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """The flat files that a path or glob names, as `separators` takes them, numbered in the order of their paths."""
    rows = [(i, p, size, width) for i, (p, size) in enumerate(list_files(spark, path))]
    return spark.createDataFrame(rows, "file long, path string, size long, width int")


def separators(files: DataFrame, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """(file, block, n, places): for each block of flat files (file, path, size, width) its tokens and the separators' places.

    Blocks of a file are read by whichever tasks, each from its own offset on, so a file's size does not matter. The ids of a
    block are compared with the separator all at once.
    """
    step = block // 4 * 4
    cut = files.where("size > 0").select("file", "path", "size", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {step}"))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, path, size, width, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, inside = fs.FileSystem.from_uri(path)
                with system.open_input_file(inside) as f:
                    f.seek(k * step)
                    tokens = np.frombuffer(f.read(min(step, size // width * width - k * step)), f"<u{width}")
                places = np.flatnonzero(tokens == separator)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k]), pa.array([len(tokens)]), pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), pa.array(places, pa.int64()))], ["file", "block", "n", "places"])

    return cut.repartition("file", "block").mapInArrow(run, "file long, block long, n long, places array<long>")


def document_spans(found: DataFrame) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of each document, from `separators`.

    A prefix scan over a file's blocks, a few numbers each, gives each block its start, the separators before it and the last
    of them, which is where a document that began in an earlier block starts. Tokens behind a file's last separator are a
    document that has not ended. Separators do not count.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = found.select("file", "block", "n", F.size("places").alias("found"), F.expr("if(size(places) > 0, places[size(places) - 1], null)").alias("last"))
    heads = heads.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("seps", F.coalesce(F.sum("found").over(before), F.lit(0)))
    heads = heads.withColumn("last", F.col("start") + F.col("last")).withColumn("open", F.coalesce(F.max("last").over(before), F.lit(-1)) + 1)
    heads = materialize(heads, "heads")
    ends = found.select("file", "block", "places").join(heads.select("file", "block", "start", "seps", "open"), ["file", "block"]).select("file", "start", "seps", "open", "places", F.posexplode("places").alias("j", "place"))
    first = F.expr("if(j = 0, open, start + places[j - 1] + 1)")
    spans = ends.select("file", (F.col("seps") + F.col("j")).alias("ordinal"), first.alias("start"), (F.col("start") + F.col("place") - first).alias("n_tokens"), F.lit(True).alias("ended"))
    whole = heads.groupBy("file").agg(F.sum("n").alias("n"), F.sum("found").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"))
    return spans.unionByName(whole.where("n > start").select("file", "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")))


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, vocabulary: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """Return doc_id, n_tokens, file, ordinal, start of each document in flat files that are written from docs and scanned.

    One row per input row, but for rows without an id, which no list can name; repeated rows have a row each; null
    texts count no tokens; other columns are ignored; an empty table gives an empty result.
    """
    folder = f"{own_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    listing = materialize(write_token_files(docs, folder, doc_id, text, vocabulary, separator), "listing")
    found = materialize(separators(listing.where("part = 'file'"), separator, block), "separators")
    listed = listing.where("part = 'ids'").select("file", "first", F.posexplode("ids").alias("j", "doc_id")).select("file", (F.col("first") + F.col("j")).alias("ordinal"), "doc_id")
    return document_spans(found).join(listed, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
