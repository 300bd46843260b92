"""Operator 10: benchmark decontamination by spaced-seed hashing, in DataFrame operations alone.

A mask marks the positions of a window of words that count; the others may differ. Windows of documents and benchmark items are
hashed under each mask and joined on the hashes, which finds passages with substituted words. Around each hit, document and item
are then compared word by word along the hit's diagonal.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtflow.llm.shared import stored, text_or_empty, without

#: Masks of one span; 1 marks a position that counts. In WINDOW words or more, one of them misses any substitutions that are allowed.
MASKS = ("110101011", "111001011", "101110011")
SPAN = 9
#: An overlap is a window of this many words, or the whole item if that is shorter, of which SIMILARITY agree.
WINDOW = 13
SIMILARITY = 0.8
#: Benchmark seeds are broadcast up to this many rows (of about 40 bytes) and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: Hash buckets of texts that are needed again; a text outside them isn't shuffled.
BUCKETS = 1 << 18


def substitutions(n: int) -> int:
    """How many words of an item of n words, n at most WINDOW, may differ."""
    return n - ceil(SIMILARITY * n - 1e-9)


def short_masks(n: int) -> tuple[str, ...]:
    """Masks over a whole item of n words, fewer than WINDOW, one of which misses any substitutions that are allowed.

    The item is cut into blocks, two more than words may differ, and each mask has two blocks, so that at least two are unharmed.
    """
    allowed = substitutions(n)
    if not allowed:
        return ("1" * n,)
    block = [i * (allowed + 2) // n for i in range(n)]
    return tuple("".join("1" if b in kept else "0" for b in block) for kept in combinations(range(allowed + 2), 2))


def words(text: F.Column) -> F.Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows(table: DataFrame, masks: tuple[str, ...], keep: list[str]) -> DataFrame:
    """keep, seed and start for each window and mask of a table with hashes of its words in column w; masks have one span.

    Starts are exploded before the seeds are made of them, so that generated code does both row by row and a long text's windows are
    never held at once. The outer explode keeps the optimizer from a filter on w, for which the words would be split once more.
    """
    span = len(masks[0])
    starts = F.when(F.size("w") >= span, F.sequence(F.lit(0), F.greatest(F.size("w") - span, F.lit(0))))
    rows = table.select(*keep, "w", F.explode_outer(starts).alias("start")).filter(F.col("start").isNotNull())
    seeds = F.array(*(F.xxhash64(F.lit(m), *(F.get("w", F.col("start") + k) for k, c in enumerate(m) if c == "1")) for m in masks))
    return rows.select(*keep, "start", F.explode(seeds).alias("seed"))


def overlaps(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, h (the text's hash), item_id, n_words, matched and similarity for each document and item that overlap.

    n_words: words of the item; matched: most words that agree on one diagonal; similarity: most of a window's words that agree, as
    a share. Null texts are empty and overlap with nothing, as do items without words. A null id, of a document or an
    item, is reported as null. Repeated rows are reported once. Items shorter than WINDOW have masks over the whole item, and may reach past either end of a document by
    as many words as may differ. Other columns are not read.
    """
    text = text_or_empty(text_col)
    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    hashed = lambda t: F.transform(words(t), lambda w: F.xxhash64(w))
    docs = source.select("doc_id", "h", hashed(F.col("text")).alias("w"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), hashed(text_or_empty(item_text_col)).alias("w")).filter(F.size("w") > 0).distinct()
    # a number of their own, as ids may be null, or one item's may be another's
    items = stored(items.withColumn("item", F.monotonically_increasing_id()), "items", compact=True)
    short = sorted(r[0] for r in items.filter(F.size("w") < WINDOW).select(F.size("w")).distinct().collect())  # fewer than WINDOW numbers

    hits = None
    passes = [(MASKS, 0, items.filter(F.size("w") >= WINDOW)), *((short_masks(n), substitutions(n), items.filter(F.size("w") == n)) for n in short)]
    for masks, beyond, chosen in passes:
        seeds = stored(_windows(chosen, masks, ["item"]).distinct(), "seeds", compact=True)
        n = seeds.count()
        if not n:
            continue
        # the empty word, which no item has, stands for words past a document's ends
        ends = F.array_repeat(F.xxhash64(F.lit("")), beyond)
        found = _windows(docs.withColumn("w", F.concat(ends, "w", ends)) if beyond else docs, masks, ["doc_id", "h"]).join(
            (F.broadcast(seeds) if n <= BROADCAST_ROWS else seeds).withColumnRenamed("start", "item_start"), "seed"
        )
        found = found.select("doc_id", "h", "item", (F.col("start") - F.col("item_start") - beyond).alias("diagonal"))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = docs.limit(0).select("doc_id", "h", F.lit(0).cast("long").alias("item"), F.lit(0).alias("diagonal"))
    # a document's diagonals are fewer than its words
    hits = stored(hits.groupBy("doc_id", "h", "item").agg(F.collect_set("diagonal").alias("diagonals")), "hits", compact=True)

    bucket = F.col("h").bitwiseAND(BUCKETS - 1)
    # safe to broadcast: at most BUCKETS numbers
    some = source.withColumn("bucket", bucket).join(F.broadcast(hits.select(bucket.alias("bucket")).distinct()), "bucket", "left_semi")
    wanted = hits.select(F.col("doc_id").alias("wanted_id"), F.col("h").alias("wanted_h")).distinct()
    texts = some.join(wanted, (F.col("h") == F.col("wanted_h")) & F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").dropDuplicates(["doc_id", "h"])
    texts = texts.select(F.col("doc_id").alias("wanted_id"), F.col("h").alias("wanted_h"), hashed(F.col("text")).alias("w"))
    both = hits.join(texts, (F.col("h") == F.col("wanted_h")) & F.col("doc_id").eqNullSafe(F.col("wanted_id"))).join(items.withColumnRenamed("w", "b"), "item")

    length = F.size("b")
    window = F.least(length, F.lit(WINDOW))

    def agreeing(d: F.Column) -> F.Column:
        return F.transform(F.sequence(F.lit(0), length - 1), lambda j: F.when(d + j < 0, 0).otherwise(F.coalesce((F.get(F.col("w"), F.greatest(d + j, F.lit(0))) == F.get(F.col("b"), j)).cast("int"), F.lit(0))))

    def total(xs: F.Column) -> F.Column:
        return F.aggregate(xs, F.lit(0), lambda s, x: s + x)

    compared = both.withColumn("lines", F.transform("diagonals", agreeing))
    best = F.array_max(F.transform("lines", lambda xs: F.array_max(F.transform(F.sequence(F.lit(1), length - window + 1), lambda at: total(F.slice(xs, at, window))))))
    compared = compared.select("doc_id", "h", "item_id", length.alias("n_words"), F.array_max(F.transform("lines", total)).alias("matched"), (best / window).alias("similarity"))
    return compared.filter(F.col("similarity") >= SIMILARITY)


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_words, matched and similarity: one row for each document id and benchmark item that it overlaps with.

    Rows of one id count as one document, as do all without an id, whose doc_id is null; of their overlaps with an item the best is
    reported. Null and empty texts overlap with nothing; an empty table on either side gives no rows; other columns are not read.
    """
    found = overlaps(documents, benchmark)
    return found.groupBy("doc_id", "item_id", "n_words").agg(F.max("matched").alias("matched"), F.max("similarity").alias("similarity"))


def without_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents without those that overlap with an item, with all columns, whatever their names.

    A row goes if its own text overlaps, so that rows of one id may part, and repeated rows stay or go together. Null and empty texts
    stay. Without items all rows stay; an empty table stays so.
    """
    return without(documents, overlaps(documents, benchmark, id_col, text_col), id_col, text_col)
