"""Operator 6: documents counted in flat token files that have no index.

A flat file is a run of little-endian ids, each document ended by the
end-of-document id. Files are cut into blocks of equal size, one row for each
byte range, which tasks open and seek to on their own. Within a block a
vectorised comparison finds the separators; a prefix scan over the blocks of a
file, of one short row each, says where the document that is open at a
block's start began and how many ended before. That scan is one sort for each
file over rows of some 40 bytes: 1 TB in one file is a million of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topograph.functions.scratch import materialize, scratch_path
from topograph.llm.bpe import automaton, vocabulary
from topograph.llm.text import byte_column

#: Bytes of a block; a multiple of 4, so that no id of 2 or 4 bytes is cut.
BLOCK = 1 << 20


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k.json", eod: int = 50256) -> DataFrame:
    """(file, length, ordinal, id): documents in flat files of uint16 ids in the shared folder, one file for each partition.

    Strings of special tokens in a text are encoded as ordinary text, so only
    separators have the id eod. A null text is a document of no tokens. An
    attempt that is lost leaves a file that no row names. Names begin with the
    partition's number.
    """
    folder = scratch_path(docs.sparkSession, "flat")
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(vocabulary(name))
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        batches = chain([first], batches)
        uri = f"{folder}/part-{first.column('part')[0].as_py()}-{uuid.uuid4().hex}.bin"
        system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
        out, size, n = None, 0, 0
        for batch in batches:
            if out is None:
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(path)
            data, offsets = byte_column(batch.column("text"))
            for _, _, ids, ends in auto.rows(data, offsets, special=False):
                flat = np.insert(ids, ends, eod).astype("<u2").tobytes()
                out.write(flat)
                size += len(flat)
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([uri] * k, pa.string()), pa.nulls(k, pa.int64()), pa.array(np.arange(n, n + k)), batch.column("id")], ["file", "length", "ordinal", "id"])
            n += k
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], ["file", "length", "ordinal", "id"])

    return given.mapInArrow(run, "file string, length long, ordinal long, id long")


def files_under(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of the files under path, of any size; they are listed, not read."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("file"), "length")


def scan(files: DataFrame, eod: int = 50256, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, block, first_document, lengths) of files (file, length): the documents that end in each block, in order, in tokens.

    A document that no separator ends has one more row: block is null and
    lengths its length, unless it is empty. Files without bytes give no rows;
    files that are named twice count once, null names not at all. Other
    columns of files play no part. file is a URI of a store that pyarrow can
    open in every task.
    """
    per_block = block // width
    given = files.where("file is not null and length > 0").groupBy("file").agg(F.max("length").alias("length"))
    ranges = given.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {block}"))).alias("block"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, source = None, None
        for batch in batches:
            places, sizes = [], []
            for file, length, number in zip(*(batch.column(c).to_pylist() for c in ("file", "length", "block")), strict=True):
                if file != held:
                    if source is not None:
                        source.close()
                    system, path = fs.FileSystem.from_uri(file) if "://" in file else (fs.LocalFileSystem(), file)
                    held, source = file, system.open_input_file(path)
                data = source.read_at(min(block, length - number * block), number * block)
                ids = np.frombuffer(data, f"<u{width}", len(data) // width)
                places.append(np.flatnonzero(ids == eod) + number * per_block)
                sizes.append(len(ids))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int32)
            flat = np.concatenate(places) if places else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))], ["file", "block", "n", "places"])
        if source is not None:
            source.close()

    ranges = ranges.repartition("file", F.expr(f"block div {max(1, (16 << 20) // block)}")).sortWithinPartitions("file", "block")
    found = materialize(ranges.mapInArrow(find, "file string, block long, n long, places array<long>"), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    slim = found.select("file", "block", "n", F.size("places").alias("ended"), F.try_element_at("places", F.lit(-1)).alias("last"))
    carried = slim.select(
        "file", "block",
        F.coalesce(F.sum("ended").over(before), F.lit(0)).alias("first_document"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("since"),
    )
    # hints: rows that a file holds in a byte or two are some hundred in memory, so its size says nothing of a broadcast's
    stitched = found.hint("merge").join(carried, ["file", "block"]).select(
        "file", "block", "first_document",
        F.transform("places", lambda p, i: p - F.when(i == 0, F.col("since")).otherwise(F.element_at("places", F.greatest(i, F.lit(1)))) - 1).alias("lengths"),
    )
    whole = slim.groupBy("file").agg(F.sum("n").alias("n"), F.sum("ended").alias("first_document"), F.coalesce(F.max("last"), F.lit(-1)).alias("last")).where("n - 1 > last")
    rest = whole.select("file", F.lit(None).cast("long").alias("block"), "first_document", F.array(F.col("n") - 1 - F.col("last")).alias("lengths"))
    return stitched.union(rest)


def document_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id_col, file, ordinal, n_tokens) of every row of docs, counted from the flat files alone.

    file is the number of the partition of docs that a file holds. A null or empty text has 0 tokens;
    rows that repeat and null ids are counted each; an empty table has no files
    and no rows; texts of any length may run over many blocks. Other columns
    play no part.
    """
    stored = materialize(token_files(docs, id_col, text_col), "tokens")
    found = scan(stored.where("length is not null").select("file", "length"), block=block)
    each = found.where("block is not null").select("file", "first_document", F.posexplode("lengths").alias("at", "n_tokens")).select("file", (F.col("first_document") + F.col("at")).alias("ordinal"), "n_tokens")
    named = stored.where("length is null").select("file", "ordinal", F.col("id").alias(id_col))
    return named.hint("merge").join(each, ["file", "ordinal"]).select(id_col, F.regexp_extract("file", r"/part-(\d+)-[^/]*$", 1).cast("long").alias("file"), "ordinal", "n_tokens")
