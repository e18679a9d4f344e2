"""Operator 1: near-duplicate documents by chosen-path set similarity join.

Documents are sets of word shingles. In each of several independent trees a node branches by selected minwise tokens: its
documents go to the child of their smallest token under a chosen hash function, now and then under two. A node that is
small enough is compared exhaustively, by sketches first and then on the full sets. Documents with J at or over the threshold
meet in a child with a chance of J or more, so the trees together miss a link with a chance that falls geometrically.

The first tree is solved before the others, which then compare only documents that aren't connected yet; so large groups of
near copies cost about one comparison a document, and never all pairs. Equal sets are joined before all this.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, few, join_one, release, text_slices, tidied
from .net import text_bytes
from .shingles import fingerprint, minwise, shingle_sets

#: Minwise hash functions; one byte of each makes up the sketch.
FUNCTIONS = 64
#: Trees, and how many of them branch under a second function at the root: 1.25 functions each, the inverse of J = 0.8.
TREES, SECOND = 12, 3
#: Documents of a node that are compared exhaustively, and levels of branching before a larger node is compared in blocks.
LEAF, DEPTH = 2048, 5
#: Documents of a block; nodes of more are compared in pairs of blocks, so that no task gets a whole large node.
BLOCK = 512
#: Standard deviations below the threshold at which a sketch rules a pair out.
MARGIN = 4.5
#: Sizes up to which pairs of many nodes are compared together.
SMALL = 64


def describe(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, f1, f2, mins): size, fingerprint and minwise tokens of each document's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=1 << 20):
                sets = shingle_sets(*text_bytes(part.column("text")), words)
                prints = [fingerprint(s) for s in sets]
                mins = pa.array([minwise(s, FUNCTIONS).view(np.int32) for s in sets], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), mins], ["doc_id", "n", "f1", "f2", "mins"])

    return docs.mapInArrow(tidied(run), "doc_id long, n long, f1 long, f2 long, mins array<int>")


def child(node: Column | None, function: Column) -> Column:
    """The node for the token under a function, below `node`."""
    token = F.get("mins", function)
    return F.xxhash64(function, token) if node is None else F.xxhash64(node, function, token)


def in_blocks(rows: DataFrame) -> DataFrame:
    """(node, rep): large nodes, with their `size`, as one node for each pair of blocks, in which all their pairs meet."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.xxhash64("node", F.least(b, F.col("own")), F.greatest(b, F.col("own"))))
    return dealt.select(F.explode(pairs).alias("node"), "rep")


def leaves(reps: DataFrame, functions: list[int]) -> DataFrame:
    """(node, rep): documents in the leaves of the trees with these functions at their roots, two or more a leaf."""
    rows = reps.select(F.explode(F.array(*[child(None, F.lit(f)) for f in functions])).alias("node"), "rep")
    found = []
    for level in range(DEPTH + 1):
        sizes = cut(rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "nodes")
        small, medium, large = sizes.where(F.col("size") <= BLOCK), sizes.where((F.col("size") > BLOCK) & (F.col("size") <= LEAF)), sizes.where(F.col("size") > LEAF)
        found.append(rows.join(small.select("node"), "node", "left_semi"))
        if medium.take(1):
            found.append(in_blocks(rows.join(few(medium), "node")))
        if not large.take(1):
            break
        rest = rows.join(few(large), "node")
        if level == DEPTH:  # what branching didn't split
            found.append(in_blocks(rest))
            break
        pick = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(FUNCTIONS)).cast("int")
        second = F.when(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(4)) == 0, child(F.col("node"), pick(2)))
        both = F.array_distinct(F.array_compact(F.array(child(F.col("node"), pick(1)), second)))
        rows = cut(rest.join(reps.select("rep", "mins"), "rep").select(F.explode(both).alias("node"), "rep"), "branches")
    return reduce(DataFrame.unionByName, found)


def sketch_floor(threshold: float) -> float:
    return FUNCTIONS * (threshold - MARGIN * (threshold * (1 - threshold) / FUNCTIONS) ** 0.5)


def candidate_pairs(node: np.ndarray, label: np.ndarray, n: np.ndarray, sketch: np.ndarray, threshold: float):
    """Yields (first, second, agreement) of pairs of one node that the sketches allow, with different labels. Rows are sorted by node."""
    starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    sizes = np.diff(np.append(starts, len(node)))
    floor = sketch_floor(threshold)

    def allowed(i: np.ndarray, j: np.ndarray):
        keep = (label[i] != label[j]) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9)
        i, j = i[keep], j[keep]
        agree = (sketch[i] == sketch[j]).sum(1)
        keep = agree >= floor
        return i[keep], j[keep], agree[keep]

    for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
        a, b = np.triu_indices(size, 1)
        own = starts[sizes == size]
        step = max(1, 200_000 // len(a))
        for k in range(0, len(own), step):
            base = own[k : k + step, None]
            yield allowed((base + a).ravel(), (base + b).ravel())
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        own = sketch[start : start + size]
        for i in range(0, size - 1, 256):
            rows = own[i : i + 256]
            agree = np.zeros((len(rows), size - i), np.uint8)
            for f in range(FUNCTIONS):
                agree += rows[:, f, None] == own[None, i:, f]
            x, y = np.nonzero(agree >= floor)
            x, y = (x + i + start)[y > x], (y + i + start)[y > x]
            if len(x):
                yield allowed(x, y)


def whole_nodes(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows that end where a node ends; the rows are sorted by node."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= rows:
            t = pa.concat_tables(held)
            node = t["node"].to_numpy()
            last = int(np.searchsorted(node, node[-1], "left"))
            if last:
                yield t.slice(0, last)
            held = [t.slice(last)]
    if held:
        yield pa.concat_tables(held)


def binaries(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def active(members: DataFrame, threshold: float) -> DataFrame:
    """(node, rep): documents with a candidate in their node that isn't connected to them yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_nodes(batches, 20_000):
            node, rep, label, n = (t[c].to_numpy() for c in ("node", "rep", "label", "n"))
            on = np.zeros(len(node), bool)
            for i, j, _ in candidate_pairs(node, label, n, binaries(t["sketch"], FUNCTIONS), threshold):
                on[i] = on[j] = True
            yield pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(rep[on])], ["node", "rep"])

    return members.mapInArrow(tidied(run), "node long, rep long")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def solve(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links of a star over each connected group of a node, a being its smallest document; judged on full sets."""
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_nodes(batches, 500):
            node, rep, label, n = (t[c].to_numpy() for c in ("node", "rep", "label", "n"))
            sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
            pairs = list(candidate_pairs(node, label, n, binaries(t["sketch"], FUNCTIONS), threshold))
            if not pairs:
                continue
            i, j, agree = (np.concatenate([p[k] for p in pairs]) for k in range(3))
            order = np.argsort(-agree.astype(np.int64), kind="stable")
            i, j = i[order], j[order]
            # Rows of one node and label are connected from the start.
            _, root = np.unique(np.stack([node, label]), axis=1, return_inverse=True)
            root = root.ravel()
            while len(i):
                for x, y in zip(i[:2000].tolist(), j[:2000].tolist(), strict=True):
                    if root[x] != root[y] and linked(sets[x], sets[y], percent):
                        root[root == root[y]] = root[x]
                i, j = i[2000:], j[2000:]
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
            order = np.lexsort((rep, root))
            first = np.append(True, root[order][1:] != root[order][:-1])
            head = rep[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            other = head != rep[order]
            yield pa.RecordBatch.from_arrays([pa.array(head[other]), pa.array(rep[order][other])], ["a", "b"])

    return members.mapInArrow(tidied(run), "a long, b long")


def by_node(rows: DataFrame) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node").sortWithinPartitions("node")


def shingles_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(rep, shingles): full shingle sets of some documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sets = shingle_sets(*text_bytes(part.column("text")), words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "shingles"])

    return docs.join(few(ids.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi").mapInArrow(tidied(run), "rep long, shingles binary")


def tree_links(docs: DataFrame, reps: DataFrame, labels: DataFrame | None, functions: list[int], words: int, threshold: float) -> DataFrame:
    """(a, b): links found by the trees with these functions at their roots."""
    known = reps.select("rep", "n", "sketch", F.col("rep").alias("label"))
    if labels is not None:
        known = reps.select("rep", "n", "sketch").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    members = leaves(reps, functions).join(known, "rep")
    on = cut(active(by_node(members.select("node", "rep", "label", "n", "sketch")), threshold), "active")
    release(docs.sparkSession)
    full = on.join(known, "rep").join(shingles_of(docs, on.select("rep").distinct(), words), "rep")
    links = cut(solve(by_node(full.select("node", "rep", "label", "n", "sketch", "shingles")), threshold).distinct(), "links")
    release(docs.sparkSession)
    return links


def roots(links: DataFrame) -> DataFrame:
    """(rep, label): for each document with links the smallest one that it reaches."""
    label = cut(links.select(F.col("b").alias("rep"), F.col("a").alias("label")).union(links.select("a", "a")).groupBy("rep").agg(F.min("label").alias("label")), "labels")
    while True:
        at = label.withColumnRenamed("rep", "a").withColumnRenamed("label", "la")
        sides = join_one(links, at, ["a"]).join(label.select(F.col("rep").alias("b"), F.col("label").alias("lb")), "b")
        low = F.least("la", "lb")
        # A smaller label goes to both ends, and to the document that was their label.
        told = sides.where("la <> lb").select(F.explode(F.array("a", "b", "la", "lb")).alias("rep"), low.alias("label"))
        better = label.union(told).groupBy("rep").agg(F.min("label").alias("label"))
        up = better.select(F.col("rep").alias("label"), F.col("label").alias("top"))
        new = cut(join_one(better, up, ["label"], "left", counted=label).select("rep", F.coalesce("top", "label").alias("label")), "labels")
        moved = new.join(label.withColumnRenamed("label", "was"), "rep").where("label <> was").take(1)
        label = new
        if not moved:
            return label


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of `docs`, linked if their shingle sets are similar.

    Words are runs of other bytes than ASCII white space, A-Z count as a-z; a text of fewer than `words` words is one shingle,
    one without words (null, empty or blank) has none and is linked with nothing. component_id is the smallest doc_id that
    links reach. Rows with one doc_id count as one document if their sets are equal, else as documents that share a name: they
    share a component. Rows with a null doc_id are linked with nothing, come out with a null component and are kept. An
    empty table gives no rows; other columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where(F.col("doc_id").isNotNull())
    described = cut(describe(docs, words), "described")
    sketch = F.concat(*[F.unhex(F.lpad(F.hex(F.get("mins", F.lit(k)).bitwiseAND(F.lit(255))), 2, "0")) for k in range(FUNCTIONS)])
    sets = ["f1", "f2", "n"]
    one = described.where("n > 0 and doc_id is not null").groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.first("mins").alias("mins"))
    classes = cut(one.withColumn("sketch", sketch), "classes")
    # A doc_id can stand for several sets if rows share it; the first of them stands for it in the trees.
    reps = classes
    functions = [[t, *([TREES + t] if t < SECOND else [])] for t in range(TREES)]
    links = tree_links(known, reps, None, functions[0], words, threshold)
    labels = roots(links)
    links = links.union(tree_links(known, reps, labels, sum(functions[1:], []), words, threshold))
    component = roots(cut(links.distinct(), "links"))
    of_set = classes.select(*sets, "rep").join(component, "rep", "left").select(*sets, F.coalesce("label", "rep").alias("component_id"))
    worded = F.col("n") > 0  # rows without words stay out of the join, which would bring them all together
    out = join_one(described.drop("mins").where(worded), of_set, sets, "left").unionByName(described.drop("mins").where(~worded).withColumn("component_id", F.col("doc_id")))
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
