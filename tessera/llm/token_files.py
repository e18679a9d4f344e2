"""Operator 10: token ids in files, frequency-ranked, byte-aligned and of variable length, with separate control bytes.

Format of a file `part-NNNNN-*.tkv`: blocks one after another, each with a header of four little-endian unsigned 64-bit
integers (documents, ids, control bytes, data bytes), then doc_ids (int64), ids per document (uint32), control bytes and
data bytes. An id is written as its frequency rank in 1 to 4 bytes; a control byte holds the lengths of four ids, two bits
each; every document starts a control byte. `ranks.bin` maps ranks to ids (uint32). Decoding looks lengths up in a
256 x 4 table and gathers the data bytes with numpy. Documents without a doc_id stand in `part-none-*.tkv`, where doc_ids
are 0 and mean nothing. The files that count are those listed by the writer: a task that is run again writes under another
name, and what it wrote before is deleted.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_path, text_slices, tidied

#: Ids in a block, which a reader holds at a time; a longer document is a block of its own.
BLOCK_IDS = 1 << 20

#: Ids in a file, about.
FILE_IDS = 1 << 26

#: Buckets for documents without a doc_id, which may be any share of all.
NONE = 16

#: Text bytes whose distinct chunks are encoded together; a longer text is taken alone.
ENCODE_BYTES = 16 << 20

#: Letters, perhaps with one mark and a blank behind: tokenizers of lower case that part letters from marks encode the word and the mark.
MARKED = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[.,]?) ?$"

LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1

#: Blanks, tabs and line ends, at which no tokenizer that drops white space has a token across.
BLANKS = np.frombuffer(b" \t\r\n", np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks."""
    ranks = ranks.astype("<u4")
    n = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(n) // 4) * 4, np.uint8)
    padded[: len(n)] = n
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= n[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranks of documents with `counts` ids each, every one of which starts a control byte."""
    lengths = LENGTHS[control].ravel()
    slots = -(-counts // 4) * 4
    first = np.cumsum(slots) - slots
    real = np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts)
    n = lengths[real].astype(np.int64)
    at = np.cumsum(n) - n
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    out = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = n > k
        if not more.any():
            break
        out[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def file_selector(root: str):
    from pyarrow import fs

    return fs.FileSelector(root)


class ChunkEncoder:
    """Encodes distinct chunks of text between blanks, in columns.

    For tokenizers that drop white space, lower-case, and end each word with a token of its own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])

    def words(self, words: pa.Array) -> pa.Array:
        """The ids of words of letters, in one call: each ends with the only token that ends a word."""
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer doesn't end each word with one token")
        offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])

    def others(self, chunks: pa.Array) -> pa.Array:
        """The ids of any chunks, one by one."""
        found = self.tokenizer.encode_batch_fast(chunks.to_pylist(), add_special_tokens=False)
        return pa.array([np.array(e.ids, "<u4").tobytes() for e in found], pa.binary())

    def encode(self, chunks: pa.Array) -> pa.Array:
        parts = pc.extract_regex(chunks, MARKED)
        hit = parts.is_valid()
        word, mark = parts.filter(hit).flatten()
        word, mark = pc.utf8_lower(word).dictionary_encode(), mark.dictionary_encode()
        marked = pc.binary_join_element_wise(self.words(word.dictionary).take(word.indices), self.others(mark.dictionary).take(mark.indices), b"")
        hit = hit.to_numpy(zero_copy_only=False)
        order = np.empty(len(chunks), np.int64)
        order[np.concatenate([np.flatnonzero(hit), np.flatnonzero(~hit)])] = np.arange(len(chunks))
        return pa.concat_arrays([marked, self.others(chunks.filter(pa.array(~hit)))]).take(pa.array(order))


@lru_cache(maxsize=1)
def chunk_encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker."""
    return ChunkEncoder(path)


def encode_slice(texts: pa.Array, encoder: ChunkEncoder, end: bytes) -> pa.Array:
    """The ids of texts without nulls as bytes, `end` behind each.

    Chunks reach up to a blank or the end of their text and are views on one buffer; the ids of the distinct ones are
    gathered by number, so that no chunk of letters becomes a Python object.
    """
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].copy()
    at = at - at[0]
    blank = np.isin(data, BLANKS)
    data[blank] = 32
    edge = np.zeros(len(data) + 1, bool)
    edge[1:] = blank
    edge[at] = True
    edges = np.flatnonzero(edge).astype(np.int32)
    views = pa.Array.from_buffers(pa.string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
    coded = views.dictionary_encode()
    stops = np.searchsorted(edges, at[1:])
    codes = np.insert(coded.indices.to_numpy(), stops, len(coded.dictionary))
    ids = pa.concat_arrays([encoder.encode(coded.dictionary), pa.array([end], pa.binary())]).take(pa.array(codes))
    ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
    offsets = ends[np.concatenate([[0], stops + np.arange(1, len(stops) + 1)])]
    return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), ids.buffers()[2]])


def encode_ids(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(doc_id, ids): ids of whole texts by the tokenizers library, then `end_id`, as little-endian unsigned 32-bit integers.

    For tokenizers that drop white space: texts are cut at blanks, tabs and line ends and the distinct chunks of about
    16 MB of texts are encoded once. A null text counts as empty and has the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = chunk_encoder(tokenizer_path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            for part in text_slices(batch, limit=ENCODE_BYTES):
                ids = encode_slice(part.column("text").fill_null(""), encoder, end)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, ids binary")


def id_counts(encoded: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs, added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in text_slices(batch, "ids"):
                ids = np.frombuffer(b"".join(x for x in part.column("ids").to_pylist() if x), "<u4")
                more = np.bincount(ids, minlength=len(total))
                more[: len(total)] += total
                total = more
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return encoded.select("ids").mapInArrow(tidied(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(spark: SparkSession, encoded: DataFrame, folder: str) -> list[tuple[str, int, int]]:
    """Writes (doc_id, ids) in ascending doc_id order; returns (file, documents, ids) of each file, in order.

    Only counts by id (as many as the vocabulary has) and one row for each file come to the driver. Each attempt of a task
    writes files of its own, and only those of tasks that ended well are listed; nothing is renamed, so that any file system
    will do. Documents of one doc_id stand together, many of them in several files; those without one come first, in files of their own.
    """
    counted = sorted(((r["n"], r["id"]) for r in id_counts(encoded).collect()), key=lambda x: (-x[0], x[1]))
    ids_by_rank = np.array([i for _, i in counted], "<u4")
    total = sum(n for n, _ in counted)
    rank_of = np.zeros(int(ids_by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[ids_by_rank] = np.arange(len(ids_by_rank), dtype=np.uint32)
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/ranks.bin") as out:
        out.write(ids_by_rank.tobytes())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "ids"):
                raw = [np.frombuffer(x or b"", "<u4") for x in part.column("ids").to_pylist()]
                both = [pack(rank_of[x]) for x in raw]
                doc = part.column("doc_id").fill_null(0)
                # Buckets of documents without an id come first; they have no order, so that each task fills one of its own.
                # A doc_id that many rows share is a bound more than once; its rows are dealt to all buckets between.
                first, last = (np.searchsorted(bounds, doc.to_numpy(), side) for side in ("left", "right"))
                own = NONE + first + np.where(last > first, 1 + np.arange(len(first)) % np.maximum(1, last - first), 0)
                bucket = np.where(part.column("doc_id").is_null().to_numpy(zero_copy_only=False), TaskContext.get().partitionId() % NONE, own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket, pa.int32()), doc, pa.array([len(x) for x in raw], pa.int64()), pa.array([c for c, _ in both], pa.binary()), pa.array([d for _, d in both], pa.binary())],
                    ["bucket", "doc_id", "n", "control", "data"],
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        held: list[pa.RecordBatch] = []
        out, bucket, own, docs, n_ids, waiting = None, None, "", 0, 0, 0

        def flush() -> None:
            if held:
                rows = pa.Table.from_batches(held)
                control, data = (b"".join(rows[c].to_pylist()) for c in ("control", "data"))
                counts = rows["n"].to_numpy()
                out.write(np.array([len(counts), counts.sum(), len(control), len(data)], "<u8").tobytes())
                out.write(rows["doc_id"].to_numpy().astype("<i8").tobytes() + counts.astype("<u4").tobytes() + control + data)
                held.clear()

        def close() -> pa.RecordBatch:
            flush()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([own]), pa.array([docs], pa.int64()), pa.array([n_ids], pa.int64())], ["k", "file", "docs", "ids"])

        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            for b in np.unique(buckets).tolist():
                if b != bucket:
                    if out is not None:
                        yield close()
                    bucket, own, docs, n_ids, waiting = b, f"part-{'none' if b < NONE else f'{b - NONE:05d}'}-{uuid.uuid4().hex}.tkv", 0, 0, 0
                    out = fs.open_output_stream(f"{root}/{own}")
                first, end = np.searchsorted(buckets, [b, b + 1])
                for part in text_slices(batch.slice(first, end - first), "data"):
                    n = sum(part.column("n").to_pylist())
                    if waiting and waiting + n > BLOCK_IDS:
                        flush()
                        waiting = 0
                    held.append(part)
                    waiting, docs, n_ids = waiting + n, docs + part.num_rows, n_ids + n
        if out is not None:
            yield close()

    # Buckets are ranges of doc_id with about as many documents each; a bucket is a file.
    files = max(1, -(-total // FILE_IDS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = encoded.where("doc_id is not null").approxQuantile("doc_id", [k / files for k in range(1, files)], 0.2 / files) if files > 1 else []
    bounds = np.sort(np.array(cuts, np.int64))
    done = (
        encoded.mapInArrow(tidied(packed), "bucket int, doc_id long, n long, control binary, data binary")
        .repartitionById(NONE + len(bounds) + 1, "bucket")  # a task for each bucket
        .sortWithinPartitions("bucket", "doc_id")
        .mapInArrow(tidied(write), "k long, file string, docs long, ids long")
        .collect()
    )
    listed = {r["file"] for r in done}
    for f in fs.get_file_info(file_selector(root)):
        if f.base_name.endswith(".tkv") and f.base_name not in listed:
            fs.delete_file(f.path)
    return [(r["file"], r["docs"], r["ids"]) for r in sorted(done, key=lambda r: r["k"])]


def read_token_files(spark: SparkSession, folder: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, ids): every document of the files; start counts the ids of all documents before it."""
    rows, start = [], 0
    for name, _, n in files:
        rows.append((name, start))
        start += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        with fs.open_input_stream(f"{root}/ranks.bin") as f:
            ids_by_rank = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for name, at in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}") as f:
                    while len(head := f.read(32)) == 32:
                        docs, _, n_control, n_data = map(int, np.frombuffer(head, "<u8"))
                        doc_ids = np.frombuffer(f.read(8 * docs), "<i8")
                        counts = np.frombuffer(f.read(4 * docs), "<u4").astype(np.int64)
                        control = np.frombuffer(f.read(n_control), np.uint8)
                        ids = ids_by_rank[unpack(control, np.frombuffer(f.read(n_data), np.uint8), counts)] if counts.sum() else np.zeros(0, "<u4")
                        ends = np.cumsum(counts)
                        raw = pa.array([ids[a:b].tobytes() for a, b in zip(ends - counts, ends, strict=True)], pa.binary())
                        own = pa.nulls(docs, pa.int64()) if name.startswith("part-none-") else pa.array(doc_ids)
                        yield pa.RecordBatch.from_arrays([own, pa.array(at + ends - counts), raw], ["doc_id", "start", "ids"])
                        at += int(counts.sum())

    listed = spark.createDataFrame(rows or [], "file string, start long")
    return listed.repartition(max(1, len(rows))).mapInArrow(tidied(run), "doc_id long, start long, ids binary")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encodes whole texts, writes them as token files and reads these back: (doc_id, start, ids).

    The ids are cut into a table in the shared folder once, so that counting and writing don't encode again. An empty
    table gives no rows; null texts have the end id alone; rows with one doc_id stay separate and stand together in any order;
    rows without a doc_id come first and are returned without one; other columns are left out.
    """
    spark = docs.sparkSession
    encoded = cut(encode_ids(docs, tokenizer_path, end_id), "ids")
    folder = folder or shared_path(spark, "tokens")
    return read_token_files(spark, folder, write_token_files(spark, encoded, folder))
