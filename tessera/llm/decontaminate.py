"""Operator 8: benchmark decontamination by spaced seeds, with DataFrame operations only.

A mask names the positions of a short span of words that count; the others may differ. Every span of a training text and of
a benchmark item is hashed under each mask and the hashes are joined; around each hit the words on the same alignment are
compared, and an overlap counts if some window of words agrees in all but a few. The two masks leave no window of 12
words with 2 substitutions, wherever they are, without an intact seed, so the seeds lose no such overlap.

A seed of an item carries the few words around it that a comparison can need, so its size has a bound. While all seeds
together stay under a fixed number of bytes they are broadcast and documents don't move. Beyond it only (doc_id, place, seed)
is shuffled, and only for seeds whose bit is set in a bitmap of fixed size; words are joined back to hits alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Spans of 8 words of which 5 count.
MASKS = ("11110001", "10100111")
#: Words of a window and those that must agree in it.
WINDOW, LEAST = 12, 10
#: Bytes of all benchmark seeds with their words up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
#: Bits of the bitmap that rules seeds out before a shuffle: 4,096 rows of 4 kB.
BITMAP = 1 << 27
#: Parts that the documents of one seed are dealt to in a shuffle, as a common phrase may stand in a third of them.
SALT = 16


def words(text: Column) -> Column:
    """The lower-cased runs of letters and digits of a text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def seeds(table: DataFrame, masks: tuple[str, ...], short: list[int]) -> DataFrame:
    """Adds `at`, the place of a span, and `seed`, its hash under a mask or as a whole item of a `short` length; tables have `words`.

    Spans that reach over the end of a text are hashed without the missing words, which costs a comparison and no result.
    """
    least = min([len(masks[0]), *short])
    # A condition on size(words) would split each text twice, once for the condition.
    places = F.when(F.size("words") >= least, F.sequence(F.lit(0), F.size("words") - least))
    placed = table.withColumn("at", F.explode(places))
    forms = [(k, [i for i, c in enumerate(m) if c == "1"]) for k, m in enumerate(masks)] + [(-n, list(range(n))) for n in short]
    hashes = [F.xxhash64(F.lit(k), *[F.get("words", F.col("at") + i) for i in own]) for k, own in forms]
    return placed.withColumn("seed", F.explode(F.array(*hashes)))


def around(at: Column, window: int, span: int) -> tuple[Column, Column]:
    """(words around a place that a comparison can need, place among them)."""
    before = F.least(at, F.lit(window - 1))
    return F.slice("words", at - before + 1, before + F.lit(window + span - 1)), before


def most_agreeing(train: Column, i: Column, item: Column, j: Column, size: Column, window: int) -> Column:
    """Most words that agree in a window of `window` words on the alignment of places i and j of two stretches of words.

    An item (of `size` words) shorter than the window is compared as a whole and counts only if all of it agrees; then the answer is `window`.
    """
    before = F.least(i, j)
    length = before + F.greatest(F.least(F.size(train) - i, F.size(item) - j), F.lit(0))  # rows of one doc_id can differ in length
    both = F.zip_with(F.slice(train, i - before + 1, length), F.slice(item, j - before + 1, length), lambda x, y: (x == y).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def judged(same: Column) -> Column:
        windows = F.array_max(F.transform(F.sequence(F.lit(1), F.size(same) - window + 1), lambda s: total(F.slice(same, s, window))))
        whole = F.when((size == F.size(same)) & (total(same) == size), F.lit(window)).otherwise(0)
        return F.when(F.size(same) >= window, windows).otherwise(F.when(size < window, whole).otherwise(0))

    # A lambda's own variable is worked out once; the words would else be compared for each mention of `same`.
    return F.get(F.transform(F.array(both), judged), F.lit(0))


def few_hits(placed: DataFrame, of_items: DataFrame) -> DataFrame:
    """(doc_id, at, item_id, item_at) of equal seeds, by a shuffle of the documents' seeds that pass the bitmap."""
    bit = F.pmod("seed", F.lit(BITMAP))
    bitmap = of_items.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    asked = placed.select("doc_id", "at", "seed", bit.alias("bit")).withColumn("bucket", F.expr("bitmap_bucket_number(bit)")).join(F.broadcast(bitmap), "bucket")
    position = F.expr("cast(bitmap_bit_position(bit) as int)")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.call_function("div", position, F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = asked.where(F.call_function("shiftright", byte, position % 8).bitwiseAND(F.lit(1)) == 1)
    salted = may.select("doc_id", "at", "seed", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).alias("salt"))
    return salted.join(of_items.select("seed", "item_id", "item_at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt")), ["seed", "salt"]).select("doc_id", "at", "item_id", "item_at").distinct()


def find_overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, overlap): documents that hold a passage of a benchmark item, and the most words that agree in a window.

    `least` of `window` aligned words must agree; an item shorter than the window must stand in the document as a whole,
    however short it is. Words ignore case and punctuation. Null, empty or wordless texts and null ids have no overlaps;
    rows with one doc_id or item_id count as one, repeated rows too; an empty table on either side gives no rows; other
    columns are left out.
    """
    span = len(masks[0])
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0)
    short = sorted(r["n"] for r in items.select(F.size("words").alias("n")).where(F.col("n") < span).distinct().collect())  # less than a span's words
    context, place = around(F.col("at"), window, span)
    of_items = seeds(items, masks, short).select("seed", "item_id", F.col("at").alias("item_at"), context.alias("item_words"), place.alias("j"), F.size("words").alias("item_size"))
    bytes_held = of_items.agg(F.sum(F.aggregate("item_words", F.lit(72), lambda s, x: s + F.octet_length(x) + 15))).first()[0] or 0
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("words"))
    placed = seeds(texts, masks, short)
    if bytes_held <= BROADCAST_BYTES:
        hits = placed.join(F.broadcast(of_items), "seed")
        train, i = F.col("words"), F.col("at")
    else:
        found = cut(few_hits(placed, of_items), "hits")
        # Documents stream through the join one by one; a hit leaves it with its own few words.
        near = texts.join(found, "doc_id").where(F.col("at") < F.size("words")).select("doc_id", "item_id", "item_at", context.alias("train"), place.alias("i"))
        hits = near.join(of_items.drop("seed").distinct(), ["item_id", "item_at"])
        train, i = F.col("train"), F.col("i")
    agree = most_agreeing(train, i, F.col("item_words"), F.col("j"), F.col("item_size"), window)
    # Filtered after the aggregate only: as a condition of the join, the comparison would keep it out of generated code.
    return hits.select("doc_id", "item_id", agree.alias("overlap")).groupBy("doc_id", "item_id").agg(F.max("overlap").alias("overlap")).where(F.col("overlap") >= least)
