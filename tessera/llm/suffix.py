"""Operator 3: removal of repeated byte strings with suffix arrays.

Every string of `length` bytes belongs to its smallest hashed gram, so equal strings belong to equal grams. A *run* is a
maximal row of strings of one gram in one text. Runs of grams that occur once need no more work. The others are sorted
by gram and content into shards of bounded size; equal runs are counted before, and one of them stands for all in the
array, where its strings count as often. A shard's suffix array is
built by Larsson-Sadakane refinement, the common prefixes come from Kasai's observation, and neighbours that share
`length` bytes are repeats. A gram's runs can be cut across shards; the strings of such grams are merged across shards by
binary search over their sorted digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, cut, join_one, release, text_slices, tidied
from .net import text_bytes

#: Bytes of a string that counts as repeated.
LENGTH = 200
#: Bytes of a gram, a power of two.
GRAM = 32
#: Runs of a gram beyond which its runs are dealt out to several shards.
HOT = 2000
#: Bytes of a text that are hashed at a time, and of a shard's suffix array.
PIECE, SHARD = 1 << 18, 1 << 20

# Odd multipliers of the gram hash, one for each doubling.
MULTIPLIERS = [np.uint64(x | 1) for x in np.random.default_rng(41).integers(1 << 62, 1 << 63, size=64, dtype=np.uint64).tolist()]
BYTE_CODES = np.random.default_rng(43).integers(0, 1 << 63, size=256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= MULTIPLIERS[60]
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all grams of GRAM bytes."""
    h, k = BYTE_CODES[data], 1
    while k < GRAM:
        nxt = h[:-k] * MULTIPLIERS[k.bit_length()]
        nxt += h[k:]
        h, k = nxt, 2 * k
    return mixed(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x, k = np.minimum(x[:-k], x[k:]), 2 * k
    return np.minimum(x[: len(x) - (width - k)], x[width - k :])


def find_runs(data: np.ndarray, offsets: np.ndarray, length: int):
    """(text, start, strings, gram, content, weight) of every run in texts that lie one after another in `data`.

    The weight is 2 for a run that holds its gram more than once, as only such a run can repeat a string within itself.
    """
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    grams = gram_hashes(data)
    least = sliding_min(grams, length - GRAM + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    valid = np.arange(len(least)) + length <= offsets[text + 1]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    new &= valid
    starts = np.flatnonzero(new)
    # Valid strings of a text are contiguous, so a run ends at the next run or where its text's strings end.
    ends = np.minimum(np.append(starts[1:], len(least)), offsets[text[starts] + 1] - length + 1)
    n = ends - starts
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams)])
    weighted = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams * np.arange(len(grams), dtype=np.uint64))])
    stop = ends + length - GRAM
    s = total[stop] - total[starts]
    content = mixed((weighted[stop] - weighted[starts] - s * starts.astype(np.uint64)) * MULTIPLIERS[61] + s * MULTIPLIERS[62] + n.astype(np.uint64))
    span = n + length - GRAM
    first = np.cumsum(span) - span
    own = grams[np.arange(int(span.sum())) + np.repeat(starts - first, span)] == np.repeat(least[starts], span)
    weight = 1 + (np.add.reduceat(own.astype(np.int32), first) > 1) if len(first) else first
    return text[starts], starts - offsets[text[starts]], n, least[starts].view(np.int64), content.view(np.int64), weight.astype(np.int64)


def packed(codes: np.ndarray) -> np.ndarray:
    """The seven codes (0 to 256) from each place on as one number; 0 after the end."""
    one = np.concatenate([codes, np.zeros(7, codes.dtype)]).astype(np.int64)
    two = one[:-1] << 9 | one[1:]
    four = two[:-2] << 18 | two[2:]
    n = len(codes)
    return four[:n] << 27 | two[4 : 4 + n] << 9 | one[6 : 6 + n]


def suffix_order(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, again, h): suffixes of `codes` (0 to 256) sorted by their first h codes, `depth` or more, by Larsson-Sadakane refinement.

    `again` tells for each place of the order whether those h codes are the same as at the place before.
    """
    n = len(codes)
    key = packed(codes)
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    place = np.arange(n)
    active, h = place, 7
    while True:
        first = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        rank[order[active]] = first
        single = new & np.append(new[1:], True)
        active = active[~single]
        if h >= depth or not len(active):
            ranks = rank[order]
            return order, np.append(False, ranks[1:] == ranks[:-1]), h
        suffix = order[active]
        key = rank[suffix] << 32 | (rank[np.minimum(suffix + h, n)] + 1)
        by = np.argsort(key)
        order[active], key = suffix[by], key[by]
        new = np.ones(len(active), bool)
        new[1:] = key[1:] != key[:-1]
        h *= 2


def common_prefixes(codes: np.ndarray, order: np.ndarray, again: np.ndarray, h: int) -> np.ndarray:
    """Common prefixes of each suffix in `order` with the one before it, counted up to h codes.

    Kasai: if the suffixes at i and j are neighbours and so are those at i-1 and j-1, which start alike, the prefix is one
    shorter than theirs. Neighbours that refinement left together share h codes, so only the others are compared, seven
    codes at a time, and these differ within h codes however long the text repeats itself.
    """
    n = len(codes)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    whole = np.zeros(n, bool)
    whole[order] = again
    i = np.arange(n)
    heads = np.ones(n, bool)
    heads[1:] = (before[1:] < 1) | (before[:-1] != before[1:] - 1) | (codes[:-1] != codes[np.maximum(before[1:], 1) - 1])
    found = np.where(whole, h, 0)
    at = np.flatnonzero(heads & ~whole & (before >= 0))
    heads |= whole
    pack = np.append(packed(codes), 0)
    a, b, whose = at.copy(), before[at], at
    while len(a):
        same = (pack[a] == pack[b]) & (a + 7 <= n) & (b + 7 <= n)
        rest = ~same
        ra, rb, rw = a[rest], b[rest], whose[rest]
        for _ in range(7):
            ok = (ra < n) & (rb < n)
            ok[ok] = codes[ra[ok]] == codes[rb[ok]]
            found[rw[ok]] += 1
            ra, rb, rw = ra[ok] + 1, rb[ok] + 1, rw[ok]
        found[whose[same]] += 7
        a, b, whose = a[same] + 7, b[same] + 7, whose[same]
    head = np.maximum.accumulate(np.where(heads, i, 0))
    prefix = np.maximum(found[head] - (i - head), 0)
    return prefix[order]


def repeated_strings(contexts: list[bytes], strings: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context of each string, group of each string): strings are equal if and only if their groups are.

    Context k has `strings[k]` strings; they are numbered context by context.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    codes = np.zeros(int(sizes.sum()) + len(contexts), np.int16)  # 0 ends a context
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    codes[np.arange(len(data)) + np.repeat(np.arange(len(contexts)), sizes)] = data.astype(np.int16) + 1
    order, again, h = suffix_order(codes, length)
    group_of = np.empty(len(codes), np.int64)
    group_of[order] = np.cumsum(common_prefixes(codes, order, again, h) < length)
    of = np.repeat(np.arange(len(contexts)), strings)
    return of, group_of[starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings)]


def spans(flags: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the maximal rows of set flags within one context."""
    on = np.flatnonzero(flags)
    if not len(on):
        return on, on
    gap = np.flatnonzero((np.diff(on) != 1) | (np.diff(of[on]) != 0))
    return on[np.append(0, gap + 1)], on[np.append(gap, len(on) - 1)]


RUN = "gram long, content long, doc_id long, copy long, start long, n long, weight long"


def text_runs(docs: DataFrame, length: int) -> DataFrame:
    """The runs of all texts; a long text is hashed in pieces that overlap so that each string is in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=PIECE):
                data, offsets = text_bytes(part.column("text"))
                ids, copies = (part.column(c).to_numpy() for c in ("doc_id", "copy"))
                pieces = [(data, offsets, 0)]
                if part.num_rows == 1 and len(data) > PIECE:
                    cuts = [(a, min(a + PIECE + length - 1, len(data))) for a in range(0, len(data) - length + 1, PIECE)]
                    pieces = [(data[a:b], np.array([0, b - a]), a) for a, b in cuts]
                for own, off, base in pieces:
                    text, start, n, gram, content, weight = find_runs(own, off, length)
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(content), pa.array(ids[text]), pa.array(copies[text]), pa.array(start + base), pa.array(n), pa.array(weight)], ["gram", "content", "doc_id", "copy", "start", "n", "weight"])

    return docs.mapInArrow(tidied(run), RUN)


def with_text(docs: DataFrame, by_doc: DataFrame) -> DataFrame:
    """Joins texts to one row a document; where the ids are few enough, other texts are left out before the shuffle."""
    ids = by_doc.select("doc_id").distinct()
    if ids.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return docs.join(by_doc, ["doc_id", "copy"])


SHARD_NAMES = ["gram", "content", "lo", "hi", "digest"]
SHARD_ROW = "gram long, content long, lo long, hi long, digest binary"


def shard_results(batches: Iterator[pa.RecordBatch], length: int, limit: int = SHARD) -> Iterator[pa.RecordBatch]:
    """Works through runs sorted by gram: rows of repeated strings, and digests of the strings of grams that are cut across shards."""
    held: list[tuple] = []
    size = 0

    def flush(cut_grams: set[int]) -> Iterator[pa.RecordBatch]:
        gram, content, n, copies, hot, raw = zip(*held, strict=True)
        gram, content, n, copies = np.array(gram), np.array(content), np.array(n), np.array(copies)
        of, group = repeated_strings(list(raw), n, length)
        again = np.bincount(group, weights=copies[of])[group] > 1
        first = np.cumsum(n) - n
        a, b = spans(again, of)
        k = of[a]
        yield pa.RecordBatch.from_arrays([pa.array(gram[k]), pa.array(content[k]), pa.array(a - first[k]), pa.array(b - first[k]), pa.nulls(len(a), pa.binary())], SHARD_NAMES)
        edges = cut_grams | {g for g, h in zip(gram.tolist(), hot, strict=True) if h}
        if edges:
            at = np.flatnonzero(np.isin(gram, list(edges))[of])
            # One string stands for all that are known to be equal; single ones stand for themselves.
            at = at[np.unique(np.where(again[at], group[at], -1 - at), return_index=True)[1]]
            k, place = of[at], at - first[of[at]]
            digests = [hashlib.blake2b(raw[c][p : p + length], digest_size=16).digest() for c, p in zip(k, place, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(gram[k]), pa.array(content[k]), pa.array(place), pa.array(place), pa.array(digests, pa.binary())], SHARD_NAMES)

    was_cut: set[int] = set()
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "content", "n", "copies", "hot", "raw")), strict=True):
            if size > limit and (row[0] != held[-1][0] or size > 2 * limit):
                cut_now = {row[0]} if row[0] == held[-1][0] else set()
                yield from flush(was_cut | cut_now)
                held, size, was_cut = [], 0, cut_now
            held.append(row)
            size += len(row[-1]) + 1
    if held:
        yield from flush(was_cut)


def merge_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings that more than one shard holds: binary search of each digest among the sorted digests of all shards."""
    held: pa.Table | None = None

    def repeats(rows: pa.Table, final: bool) -> tuple[pa.RecordBatch, pa.Table]:
        keys = np.frombuffer(b"".join(rows["digest"].to_pylist()), "S16")
        left, right = np.searchsorted(keys, keys, "left"), np.searchsorted(keys, keys, "right")
        last = len(keys) if final else int(left[-1])  # strings of the last digest wait for the next batch
        good = np.flatnonzero((right - left > 1) & (left < last))
        out = rows.take(pa.array(good)).select(["gram", "content", "lo", "hi"]).combine_chunks()
        return pa.RecordBatch.from_arrays([out[c].combine_chunks() for c in out.column_names], out.column_names), rows.slice(last)

    for batch in batches:
        if batch.num_rows:
            more = pa.Table.from_batches([batch])
            out, held = repeats(pa.concat_tables([held, more]) if held is not None else more, False)
            yield out
    if held is not None and held.num_rows:
        yield repeats(held, True)[0]


def repeated_rows(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, copy, spans): [from, to) byte ranges covered by repeated strings, for documents that have any; ranges may overlap."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = cut(text_runs(docs, length), "runs")
    often = runs.groupBy("gram").agg(F.sum("weight").alias("seen")).where("seen > 1")
    common = cut(join_one(runs.drop("weight"), often, ["gram"]), "common-runs")
    release(spark)
    one = F.struct("doc_id", "copy", "start", "n")
    classes = common.groupBy("gram", "content").agg(F.min(one).alias("a"), F.max(one).alias("b"), F.max("seen").alias("seen"))
    copies = F.when(F.col("a") == F.col("b"), 1).otherwise(2)  # equal rows are one document
    reps = classes.select("a.doc_id", "a.copy", F.struct("gram", "content", "seen", F.col("a.start").alias("start"), F.col("a.n").alias("n"), copies.alias("copies")).alias("run"))
    wanted = cut(reps.groupBy("doc_id", "copy").agg(F.collect_list("run").alias("runs")), "wanted-runs")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                rows = []
                for text, own in zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                    data = text.encode()
                    rows += [(r["gram"], r["content"], r["seen"], r["n"], r["copies"], data[r["start"] : r["start"] + r["n"] + length - 1]) for r in own]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["gram", "content", "seen", "n", "copies", "raw"])

    texts = with_text(docs, wanted).mapInArrow(tidied(contexts), "gram long, content long, seen long, n long, copies long, raw binary")
    salt = F.pmod("content", F.ceil(F.col("seen") / HOT))
    dealt = texts.withColumn("hot", F.col("seen") > HOT).repartition(partitions, "gram", salt).sortWithinPartitions("gram", "content")
    limit = SHARD
    results = cut(dealt.select("gram", "content", "n", "copies", "hot", "raw").mapInArrow(tidied(lambda it: shard_results(it, length, limit)), SHARD_ROW), "shards")
    release(spark)
    merged = results.where("digest is not null").repartition(partitions, "digest").sortWithinPartitions("digest").mapInArrow(tidied(merge_edges), "gram long, content long, lo long, hi long")
    found = results.where("digest is null").select("gram", "content", "lo", "hi").unionByName(merged)
    spans_of = F.struct((F.col("start") + F.col("lo")).alias("a"), (F.col("start") + F.col("hi") + length).alias("b"))
    by_class = found.groupBy("gram", "content").agg(F.collect_set(F.struct("lo", "hi")).alias("own"))  # as many as a run has strings
    covered = join_one(common.select("gram", "content", "doc_id", "copy", "start"), by_class, ["gram", "content"]).select("doc_id", "copy", "start", F.explode("own").alias("x")).select("doc_id", "copy", "start", "x.*")
    return covered.groupBy("doc_id", "copy").agg(F.collect_set(spans_of).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: `kept` are the bytes that no repeated string covers.

    A string of `length` (64 or more) bytes is repeated if it starts anywhere else too, overlaps and the same document included; `spans`
    are the maximal ranges removed. A null text is empty; texts shorter than `length` stay as they are. Rows with one doc_id
    and one text count as one document, and each is returned; with different texts they are documents of their own. Rows
    with a null doc_id stay as they are and are not compared. An empty table gives no rows; other columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("copy", F.xxhash64("text"))
    found = cut(repeated_rows(docs.where(F.col("doc_id").isNotNull()), length), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sizes, gone, kept = [], [], []
                for text, own in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    data = text.encode()
                    merged: list[list[int]] = []
                    for a, b in sorted((r["a"], r["b"]) for r in own or ()):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    at, parts = 0, []
                    for a, b in merged:
                        parts.append(data[at:a])
                        at = b
                    sizes.append(len(data))
                    gone.append([{"start": a, "end": b} for a, b in merged])
                    kept.append(b"".join([*parts, data[at:]]))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    out = "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"
    ids = found.select("doc_id", "copy")
    if ids.count() > BROADCAST_IDS:
        return docs.join(found, ["doc_id", "copy"], "left").mapInArrow(tidied(run), out)
    none = F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("spans")
    return docs.join(F.broadcast(ids), ["doc_id", "copy"], "left_anti").select("doc_id", "text", none).mapInArrow(tidied(run), out).unionByName(with_text(docs, found).mapInArrow(tidied(run), out))
