"""Operator 2: line dedup over range-partitioned line hashes, with per-document keep bitmaps.

Hashes of line keys are range-partitioned and sorted by (hash, doc_id, position), so that one pass over a partition meets
the first occurrence of each key before all others. doc_id is part of the range key: a hot line spreads over many
partitions. What a partition can't know, the first owner of the key it starts with, comes from one row a partition.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, join_one, shared_dir, text_slices, tidied

#: Code points that a key must have; shorter lines are never dropped.
LEAST = 10

#: Bytes of all bitmaps up to which they are broadcast, and of a row beside its bitmap.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64

# The blanks that a key loses at both ends.
BLANKS = " \t\n\x0b\x0c\r"

LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def line_hashes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(h1, h2, doc_id, pos): 128-bit hashes of the keys that are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                hashes, ids, places = [], [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for pos, line in enumerate((text or "").split("\n")):
                        key = line.strip(BLANKS)
                        if len(key) >= least:
                            hashes.append(hashlib.blake2b(key.translate(LOWER).encode(), digest_size=16).digest())
                            ids.append(doc)
                            places.append(pos)
                both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64()), pa.array(places, pa.int32())], ["h1", "h2", "doc_id", "pos"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "h1 long, h2 long, doc_id long, pos int")


def key_runs(batch: pa.RecordBatch, held: tuple[int, int, int] | None):
    """(doc_ids, positions, owner of each row, last key with its owner) of sorted rows; `held`: the last key before them."""
    h1, h2, doc, pos = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("h1", "h2", "doc_id", "pos"))
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    runs = np.flatnonzero(new)
    owners = doc[runs]
    if held and held[:2] == (h1[0], h2[0]):
        owners[0] = held[2]
    return doc, pos, np.repeat(owners, np.diff(np.append(runs, len(h1)))), (int(h1[-1]), int(h2[-1]), int(owners[-1]))


def dropped_lines(hashes: DataFrame, partitions: int) -> DataFrame:
    """(doc_id, pos) of lines whose key a document of smaller doc_id holds."""
    order = ("h1", "h2", "doc_id", "pos")
    # Ranges come from a sample of the rows, so these are written first and not worked out twice. A checkpoint keeps
    # partitions and their order as they are, so both passes see the same ranges.
    ordered = cut(hashes, "line-hashes").repartitionByRange(partitions, *order).sortWithinPartitions(*order).checkpoint()

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = held = None
        for batch in batches:
            if batch.num_rows:
                first = first or (batch.column("h1")[0].as_py(), batch.column("h2")[0].as_py())
                held = key_runs(batch, held)[3]
        if held:
            row = (TaskContext.get().partitionId(), *first, *held)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], ["part", "f1", "f2", "l1", "l2", "owner"])

    carried: dict[int, tuple[int, int, int]] = {}
    before = None
    for r in sorted(ordered.mapInArrow(tidied(edges), "part long, f1 long, f2 long, l1 long, l2 long, owner long").collect()):
        owner = r["owner"]
        if before and before[:2] == (r["f1"], r["f2"]):
            carried[r["part"]] = before
            if (r["f1"], r["f2"]) == (r["l1"], r["l2"]):
                owner = before[2]
        before = (r["l1"], r["l2"], owner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = carried.get(TaskContext.get().partitionId())
        for batch in batches:
            if batch.num_rows:
                doc, pos, owner, held = key_runs(batch, held)
                out = owner != doc
                yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(pos[out])], ["doc_id", "pos"])

    return ordered.mapInArrow(tidied(run), "doc_id long, pos int")


def bitmap(positions: np.ndarray) -> bytes:
    """Positions as a deflated bitmap."""
    bits = np.zeros(int(positions.max()) + 1, np.uint8)
    bits[positions] = 1
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6)


def positions(packed: bytes) -> list[int]:
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), bitorder="little")).tolist()


def drop_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, dropped): the line dedup of `docs`, one deflated bitmap of dropped line numbers for each document that loses lines.

    Lines end at \\n alone; a null or empty text is one empty line. A key is a line without blanks at both ends and with A-Z
    lower-cased; keys of `least` code points or more stay only in the smallest doc_id that holds them. Rows with one doc_id
    are one document to this operator: they keep their shared lines, and the bitmap holds the line numbers dropped in any of
    them. Rows with a null doc_id keep all lines. An empty table gives no rows; other columns are not read.
    """
    shared_dir(docs.sparkSession)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [bitmap(np.array(p)) for p in batch.column("places").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(maps, pa.binary())], ["doc_id", "dropped"])

    # As many places as the document has lines.
    return dropped_lines(line_hashes(known, least), partitions).groupBy("doc_id").agg(F.collect_set("pos").alias("places")).mapInArrow(tidied(pack), "doc_id long, dropped binary")


def keep_lines(docs: DataFrame, bitmaps: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text, *carry): whole texts without their dropped lines; columns named in `carry` come along."""
    carried = docs.select(*carry).schema if carry else StructType()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                lines, lost, texts = [], [], []
                for text, packed in zip(part.column("text").to_pylist(), part.column("dropped").to_pylist(), strict=True):
                    all_lines = (text or "").split("\n")
                    out = set(positions(packed)) if packed else ()
                    kept = [x for i, x in enumerate(all_lines) if i not in out] if out else all_lines
                    lines.append(len(all_lines))
                    lost.append(len(all_lines) - len(kept))
                    texts.append("\n".join(kept))
                own = [part.column("doc_id"), pa.array(lines, pa.int64()), pa.array(lost, pa.int64()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([*own, *[part.column(c) for c in carry]], ["doc_id", "n_lines", "n_dropped", "text", *carry])

    wanted, stored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry), cut(bitmaps, "bitmaps")
    size = stored.agg(F.sum(F.octet_length("dropped") + ROW_BYTES)).first()[0] or 0
    # The size decides, not the planner's guess: while the bitmaps are few, no text is shuffled.
    both = wanted.join(F.broadcast(stored), "doc_id", "left") if size <= BROADCAST_BYTES else join_one(wanted, stored, ["doc_id"], "left")
    own = StructType().add("doc_id", "long").add("n_lines", "long").add("n_dropped", "long").add("text", "string")
    return both.mapInArrow(tidied(run), StructType([*own.fields, *carried.fields]))


def dedup_lines(docs: DataFrame, least: int = LEAST, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text, *carry) of every row of `docs`; see drop_bitmaps() and keep_lines()."""
    return keep_lines(docs, drop_bitmaps(docs, least), carry)
