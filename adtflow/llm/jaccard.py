"""Operator 7: exact n-gram Jaccard join by a token-group matrix.

Sets of word shingles are compared through groups of similar documents. Rows of the matrix are tokens (hashed shingles), columns are
groups, and a group's column is the union of its members' tokens. A document can be similar to a member of a group only if its
overlap with the union is large enough; only such groups are opened, and their members compared one by one.

 1. Documents with equal sets form one class; the rest works on classes.
 2. Any two similar sets share one of their first n - ceil(t n) + 1 tokens in any common order of tokens. The order used has the
    tokens that few documents hold first, so that common passages index nothing; tokens of a single document are counted but never
    stored. Documents whose first tokens are all their own are done. Holders of a token that many index get a second order, of all
    their tokens among these holders alone; two similar sets that share only such tokens are both among them.
 3. Among the holders of a token the one with the fewest rarer tokens is the leader. Documents that are similar to their best leader form its group.
 4. The matrix of indexed tokens and groups gives the groups that a document may reach; sizes, positions and then the overlap with
    the group's union bound what it can find there. Of a group left, the leader is compared, and where that makes no link between
    the two groups, every member.
 5. Connected components of all links found.

The first counts of step 2 are taken on a fixed share of the hash space (the tokens that make up nearly all indexes), over all
documents.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adtflow.llm.classifier import _DOWN, _P, _P_INVERSE, _SPACE, _UP, _powers, segments
from adtflow.llm.components import connected_components
from adtflow.llm.shared import map_arrow, stored, text_or_empty, without

#: Hash buckets of texts that are needed again; a text outside them isn't shuffled.
BUCKETS = 1 << 20
#: Pairs are broadcast up to this many (16 bytes each).
BROADCAST_PAIRS = 1_000_000
#: A token that more documents than this index is hot; its holders are compared through the second order of tokens.
HOT = 64
#: Sets the second order's lists apart from the first's.
SECOND = 0x2545F4914F6CDD1D
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words between the white space 9 to 13 and 32, with A to Z in lower case."""
    out = []
    for b in segments(text):
        space = _SPACE[b]
        edges = np.flatnonzero(space)
        starts, ends = edges[:-1] + 1, edges[1:]
        some = ends > starts
        starts, ends = starts[some], ends[some]
        n = len(b)
        up, down = (_UP, _DOWN) if n < len(_UP) else (_powers(_P, n + 1), _powers(_P_INVERSE, n + 1))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[b].astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
        out.append((total[ends] - total[starts]) * down[starts])
    w = np.concatenate(out)
    w = (w ^ (w >> np.uint64(29))) * _MIX
    return w ^ (w >> np.uint64(32))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles; with fewer words the whole sequence is one; without words, none."""
    w = word_hashes(text)
    if not len(w):
        return np.empty(0, np.int64)
    size = min(k, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = (h * _P) ^ w[i : len(w) - size + 1 + i]
        h = (h ^ (h >> np.uint64(31))) * _MIX
    return np.unique((h ^ (h >> np.uint64(30))).view(np.int64))


def index_length(n: np.ndarray | int, percent: int):
    """How many first tokens of a set of size n any similar set must share one of."""
    return n - (percent * n + 99) // 100 + 1


def _first_class(tokens: np.ndarray, share: int) -> np.ndarray:
    return (tokens & np.int64(0xFFFF)) < share


def _sets(batch: pa.RecordBatch, k: int, percent: int, share: int) -> pa.RecordBatch:
    rows = []
    for text in batch.column("text").to_pylist():
        s = shingle_set(text, k)
        n = len(s)
        first = _first_class(s, share)
        kept, rest = s[first], index_length(n, percent) - int(first.sum())
        if n and rest > 0:
            kept = np.concatenate([kept, s[~first][:rest]])
        u = s.view(np.uint64)
        a = int(np.bitwise_xor.reduce((u ^ (u >> np.uint64(27))) * _P)) if n else 0
        b = int(np.sum((u ^ (u >> np.uint64(33))) * _MIX, dtype=np.uint64)) if n else 0
        rows.append((n, int(first.sum()), np.uint64(a).astype(np.int64), np.uint64(b).astype(np.int64), kept if n > 1 else kept[:0]))
    offsets = np.concatenate([[0], np.cumsum([len(r[4]) for r in rows])]).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[4] for r in rows]), pa.int64()))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
    columns = [*(batch.column(c) for c in ("r", "doc_id", "h")), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)), tokens]
    return pa.RecordBatch.from_arrays(columns, ["r", "doc_id", "h", "n", "first", "d1", "d2", "tokens"])


def _full(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    sets = [shingle_set(t, k) for t in batch.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column("r"), pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))], ["r", "tokens"])


def _similar(o: F.Column, n: F.Column, m: F.Column, percent: int) -> F.Column:
    return 100 * o >= percent * (n + m - o)


def _least_overlap(n: F.Column, m: F.Column, percent: int) -> F.Column:
    """The overlap that similar sets of sizes n and m have at least."""
    return F.ceil((percent * (n + m)) / F.lit(100 + percent) - 1e-9)


def _verified(pairs: DataFrame, tokens: DataFrame, percent: int, label: str) -> DataFrame:
    """The similar ones of pairs (a, b), stored.

    Pairs of a checked number are broadcast to the sets, so that only sets in pairs move; beyond it all sets are shuffled by id, the
    leaders' first, as b may be the leader of many and the rows that meet it are still short.
    """
    pairs = stored(pairs, f"{label}_pairs", compact=True)
    one = tokens.select(F.col("r").alias("a"), F.col("tokens").alias("ta"))
    two = tokens.select(F.col("r").alias("b"), F.col("tokens").alias("tb"))
    if pairs.count() <= BROADCAST_PAIRS:
        both = one.join(F.broadcast(pairs), "a").join(two.join(F.broadcast(pairs), "b"), ["a", "b"])
    else:
        both = pairs.join(two, "b").join(one, "a")
    overlap = F.size(F.array_intersect("ta", "tb")).cast("long")
    return stored(both.filter(_similar(overlap, F.size("ta").cast("long"), F.size("tb").cast("long"), percent)).select("a", "b"), label, compact=True)


def link_components(documents: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (the text's hash), n_shingles and component_id, the smallest doc_id reachable over links, of every document.

    Documents link when 100 * intersection >= percent * union of their shingle sets. Documents without words are linked with
    nothing. Texts that differ in case or white space alone have equal sets. A null text is empty. A null id never is a
    component's id: component_id is null where no document of the component has an id. Repeated rows are documents of their own.
    An empty table gives no rows. Other columns are not read. A long text takes memory in proportion to its own length.
    """
    share = min(1 << 16, int((1 << 16) * (100 - percent) / 100 * 5 / 3))
    text = text_or_empty(text_col)
    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    sets = stored(
        map_arrow(
            source.withColumn("r", F.monotonically_increasing_id()),
            partial(_sets, k=k, percent=percent, share=share),
            "r long, doc_id long, h long, n long, first long, d1 long, d2 long, tokens array<long>",
        ),
        "sets",
    )
    key = ["d1", "d2", "n"]
    length = F.expr(f"n - ((n * {percent} + 99) div 100) + 1")
    classes = stored(
        sets.filter("n > 0").groupBy(*key).agg(F.min(F.struct("r", "doc_id", "h", "first")).alias("c"), F.min("doc_id").alias("low")).select(*key, "c.*", "low"), "classes", compact=True
    )

    # tokens that some other document holds too, with how many do
    holders = sets.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # a document's copies are dropped here, after the tokens that only it holds
    shared = (
        sets.select("r", F.explode("tokens").alias("t"))
        .join(holders, "t")
        .join(classes.select("r", "n", "first"), "r")
        .withColumn("rest", ((F.col("t").bitwiseAND(0xFFFF)) >= share).cast("int"))
    )
    mine = Window.partitionBy("r")
    rank = F.row_number().over(mine.orderBy("rest", "df", "t"))
    own = F.col("first") - F.sum(1 - F.col("rest")).over(mine)  # first-class tokens of this document alone
    placed = shared.withColumn("own", own).withColumn("pos", F.when(F.col("rest") == 0, F.col("own") + rank - 1).otherwise(F.col("first")))
    index = stored(placed.filter(F.col("pos") < length).select("t", "r", "n", "pos"), "index")

    # documents with a token that many index, and those that may be similar to one that shares a rarer token, by sizes and positions
    near = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)
    lists = index.groupBy("t").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    hot = lists.filter(F.col("c") > HOT).select("t")
    busy = stored(index.join(hot, "t", "left_semi").select("r").distinct(), "busy", compact=True)
    one = index.join(lists.filter(F.col("c") <= HOT).select("t"), "t", "left_semi")
    two = one.select("t", F.col("r").alias("s"), F.col("n").alias("m"), F.col("pos").alias("at"))
    met = one.join(two, "t").filter(
        (F.col("r") < F.col("s")) & near(F.col("n"), F.col("m")) & (F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at")) >= _least_overlap(F.col("n"), F.col("m"), percent))
    )
    alive = stored(met.select(F.explode(F.array("r", "s")).alias("r")).unionByName(busy).distinct(), "alive", compact=True)
    index = stored(index.join(hot, "t", "left_anti").join(alive, "r"), "index", compact=True)

    # their whole sets, from their texts
    needed = alive.join(classes.select("r", "doc_id", "h"), "r").select("r", "doc_id", "h")
    bucket = F.col("h").bitwiseAND(BUCKETS - 1).alias("bucket")
    # safe to broadcast: at most BUCKETS numbers
    some = source.withColumn("bucket", bucket).join(F.broadcast(needed.select(bucket).distinct()), "bucket", "left_semi")
    wanted = needed.select("r", F.col("doc_id").alias("wanted_id"), F.col("h").alias("wanted_h"))
    same = (F.col("h") == F.col("wanted_h")) & F.col("doc_id").eqNullSafe(F.col("wanted_id"))
    texts = some.join(wanted, same).select("r", "text").dropDuplicates(["r"])
    tokens = stored(map_arrow(texts, partial(_full, k=k), "r long, tokens array<long>"), "tokens")

    # documents with a token that many index: all their tokens are ordered anew, rarest among these documents first
    whole = tokens.join(busy, "r", "left_semi").select("r", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("t"))
    whole = stored(whole, "whole")
    again = whole.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    again = whole.join(again, "t").withColumn("own", F.col("n") - F.count(F.lit(1)).over(mine))
    again = again.withColumn("pos", F.col("own") + F.row_number().over(mine.orderBy("df", "t")) - 1).filter(F.col("pos") < length)
    # lists of their own, apart from those of the first order
    index = index.unionByName(again.select(F.col("t").bitwiseXOR(F.lit(SECOND)).alias("t"), "r", "n", "pos"))
    index = stored(index, "second", compact=True)

    # leaders, those with the fewest rarer tokens, and the best of each document's
    leaders = index.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("pos", "r", "n")).alias("l")).filter("c > 1")
    n, m = F.col("n"), F.col("l.n")
    best = (
        index.join(leaders, "t")
        .filter(F.col("r") != F.col("l.r"))
        .filter(near(n, m) & (F.least(n - F.col("pos"), m - F.col("l.pos")) >= _least_overlap(n, m, percent)))
        .groupBy("r", F.col("l.r").alias("b"))
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy(F.col("r").alias("a"))
        .agg(F.max(F.struct("c", "b")).alias("x"))
        .select("a", "x.b")
    )
    stars = _verified(best, tokens, percent, "stars")

    # groups: a document's leader, or that one's leader
    up = stars.select(F.col("a").alias("b"), F.col("b").alias("above"))
    groups = stars.join(up, "b", "left").select(F.col("a").alias("r"), F.coalesce("above", "b").alias("g"))
    groups = stored(index.select("r", "n").distinct().join(groups, "r", "left").withColumn("g", F.coalesce("g", "r")), "groups", compact=True)
    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("members"))
    listed = stored(index.join(groups.join(sizes, "g").drop("n"), "r"), "listed", compact=True)

    # the matrix, where a token has several groups
    cells = listed.groupBy("t", "g", "members").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("pos").alias("at"))
    several = cells.groupBy("t").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("t")
    cells = cells.join(several, "t", "left_semi").select("t", F.col("g").alias("to"), F.col("members").alias("to_members"), "least", "most", "at")
    floor = F.greatest(F.col("least"), F.expr(f"(n * {percent} + 99) div 100"))
    reach = (
        listed.join(cells, "t")
        .filter(F.struct("members", "g") < F.struct("to_members", "to"))  # the smaller group asks the larger
        .filter((floor <= F.col("most")) & (F.col("least") * percent <= 100 * F.col("n")))
        .filter(F.least(F.col("n") - F.col("pos"), F.col("most") - F.col("at")) >= _least_overlap(F.col("n"), floor, percent))
        .groupBy("r", "n", "to", "to_members", "least")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy("r", "n", "to", "to_members")
        .agg(F.min("least").alias("least"))
    )
    reach = stored(reach, "reach", compact=True)

    # overlap with the union of each larger group's tokens
    member = groups.select(F.col("g").alias("to"), F.col("r").alias("s"), F.col("n").alias("ns"))
    many = reach.filter("to_members > 1")
    asked = member.join(many.select("to").distinct(), "to", "left_semi")
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_PAIRS else df
    union = tokens.withColumnRenamed("r", "s").join(small(asked, groups.count()), "s").select("to", F.explode("tokens").alias("t")).distinct()
    held = tokens.join(small(many, reach.count()), "r").select("r", "n", "to", "least", F.explode("tokens").alias("t")).join(union, ["to", "t"])
    opened = held.groupBy("r", "n", "to", "least").agg(F.count(F.lit(1)).alias("o")).filter(F.col("o") >= _least_overlap(F.col("n"), floor, percent))
    # first the group's own leader; a group's members are linked, so that one link to it is enough. A group of one is compared by its
    # member, which isn't its leader where that one is in a group of its own
    single = reach.filter("to_members = 1").join(member, "to").filter(near(F.col("n"), F.col("ns")))
    first = opened.select("r", F.col("to").alias("s")).unionByName(single.select("r", "s")).select(F.col("r").alias("a"), F.col("s").alias("b"))
    first = _verified(first.distinct(), tokens, percent, "first")
    own_group = groups.select("r", "g")
    met = first.join(own_group.withColumnRenamed("r", "a"), "a").select("g", F.col("b").alias("to")).distinct()
    rest = opened.join(own_group, "r").join(met, ["g", "to"], "left_anti").join(member, "to")
    rest = rest.filter(near(F.col("n"), F.col("ns")) & (F.col("s") != F.col("to"))).select(F.col("r").alias("a"), F.col("s").alias("b"))
    links = stars.unionByName(first).unionByName(_verified(rest.distinct(), tokens, percent, "rest"))

    roots = connected_components(links)
    linked = classes.join(roots.withColumnRenamed("node", "r"), "r", "left").withColumn("root", F.coalesce("root", "r"))
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = linked.join(lows, "root").select(*key, "component_id")
    return sets.join(named, key, "left").select("doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(documents: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents without those that a linked document with a smaller id stands for, with all columns.

    Rows repeated under one id and text stay or go together. Rows without an id go if a linked row has one.
    """
    gone = link_components(documents, k, percent, id_col, text_col).filter(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
    return without(documents, gone, id_col, text_col)
