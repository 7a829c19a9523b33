"""Near duplicates by minhash with tensored tables, confirmed on full shingle sets (operator 6).

Two collections A and B of T short keys (K minhashes each) are computed per distinct shingle set:
2 T K minhashes serve T x T tables, whose key (i, j) combines the i-th key of A with the j-th key of
B. Two sets meet in a table exactly if they share a key of A and a key of B; at the default
parameters a pair of similarity 0.75 is met with probability 0.999, of 0.8 with 0.99993.

Steps, all of them joins or grouped minima that spread over tasks:
1. One pass over the texts makes a sketch per document: set size, 128-bit fingerprint of the set,
   keys of A and B, and a parity bitmap of the set. It is stored; texts are not shuffled.
2. Documents of equal sets become one class, whose representative is its smallest id.
3. Keys of one holder are dropped before keys are combined, so a text without near copies has no
   table rows. In each table bucket one hub - the member that shares most keys - is paired with
   the others: linear in the bucket.
4. What the hubs left in different components is compared directly: pairs that share a key of A
   and one of B, each once. Before a pair is made, set sizes and parity bitmaps bound its
   similarity from above; the bound is exact, so no link is lost by it.
5. Links are confirmed on the full sets, which are computed again only for texts in a pair.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlog.llm.common import checkpointed, query, stored, table
from wardlog.llm.components import components
from wardlog.llm.shingles import minhash_seeds, minhashes, mix, shingle_hashes

TABLES = 10          # keys in each of the two collections
HASHES = 2           # minhashes in a key
WORDS = 5
PERCENT = 75
PARITY_BITS = 1024
BROADCAST_IDS = 1_000_000   # ids of texts in pairs that may be sent to every task (8 MB)

BROADCAST_REMOVED = 1_000_000   # removed documents that may be sent to every task

SKETCH = "doc_id bigint, text_hash bigint, n bigint, f1 bigint, f2 bigint, a array<bigint>, b array<bigint>, p array<bigint>"


def _sketch(hashes: np.ndarray, seeds: np.ndarray):
    if not len(hashes):
        return 0, 0, [], [], []
    low = minhashes(hashes, seeds).astype(np.uint64).reshape(-1, HASHES)
    keys = low[:, 0]
    for column in range(1, HASHES):
        keys = mix(keys) + low[:, column]
    keys = mix(keys).view(np.int64)
    bits = np.bincount((hashes & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    parity = np.packbits(bits.astype(np.uint8)).view(np.int64)
    with np.errstate(over="ignore"):
        first = int(np.sum(mix(hashes + np.uint64(1))).astype(np.uint64).view(np.int64))
        second = int(np.sum(mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A))).astype(np.uint64).view(np.int64))
    half = len(keys) // 2
    return first, second, keys[:half].tolist(), keys[half:].tolist(), parity.tolist()


def sketches(docs: DataFrame, tables: int = TABLES, words: int = WORDS) -> DataFrame:
    """A sketch per row of (doc_id bigint, text string)."""
    def run(batches):
        seeds = minhash_seeds(2 * tables * HASHES)
        for batch in batches:
            columns = [[] for _ in range(6)]
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py(), words)
                for column, value in zip(columns, (len(hashes), *_sketch(hashes, seeds))):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "text_hash", "n", "f1", "f2", "a", "b", "p"])
    return docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, s): the whole shingle set of each row."""
    def run(batches):
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), words).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()),
                                              pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "s"])
    return docs.mapInArrow(run, "doc_id bigint, s array<bigint>")


def _can_link(x: str, y: str, percent: int) -> Column:
    """Upper bound of the similarity of two sketches reaches the threshold.

    J = (m - d) / (m + d) for m = |X| + |Y| and the size d of the symmetric difference; d is at
    least the number of differing parity bits, and at least the difference of the sizes.
    """
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    differing = F.aggregate(F.zip_with(f"{x}.p", f"{y}.p", lambda p, q: F.bit_count(p.bitwiseXOR(q))),
                            F.lit(0), lambda total, one: total + one)
    near = (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny))
    return near & ((100 + percent) * differing <= (100 - percent) * (nx + ny))


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """Pairs (u, v) of ids whose full sets reach the threshold."""
    ids = checkpointed(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())
    small = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    sets = stored(full_sets(texts.select("doc_id", "text"), words), "sets")
    left = sets.select(F.col("doc_id").alias("u"), F.col("s").alias("su"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("s").alias("sv"))
    shared = F.size(F.array_intersect("su", "sv"))
    return (pairs.join(left, "u").join(right, "v")
            .select("u", "v", shared.alias("i"), (F.size("su") + F.size("sv")).alias("m"))
            .where(100 * F.col("i") >= percent * (F.col("m") - F.col("i"))).select("u", "v").distinct())


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS,
                    tables: int = TABLES) -> DataFrame:
    """Rows of `docs` (doc_id, text) to (doc_id, n_shingles, component_id, text_hash, kept), one per row.

    Two documents are linked if 100 |X & Y| >= percent |X or Y| for their sets of distinct shingles
    of `words` words; a component is named by its smallest id.
    * Null, empty and blank texts have an empty set and are linked with nothing.
    * Fewer words than `words` form one shingle. Texts are used whole, whatever their length.
    * doc_id is meant to be unique; rows that share one are each judged by their own text.
    * A null doc_id joins the component of an equal set that has an id; otherwise component_id is
      null and the row is kept.
    * Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_rows = stored(sketches(docs, tables, words), "sketches")
    rows = all_rows.select("doc_id", "text_hash", "n", "f1", "f2")
    filled = rows.where("n > 0")
    classes = checkpointed(filled.groupBy("f1", "f2", "n").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("rows")).where("rep is not null"))
    reps = classes.select(F.col("rep").alias("doc_id"), "f1", "f2", "n")

    def keys(side: str) -> DataFrame:
        exploded = all_rows.where("n > 0 and doc_id is not null").select("doc_id", F.posexplode(side).alias("i", "k"))
        held = exploded.groupBy("i", "k").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                                              F.count("*").alias("weight"))
        # stored before the join: what is grouped and joined by one shuffle cannot be split where a key is crowded
        return exploded.join(checkpointed(held.where("low <> high").select("i", "k", "weight")), ["i", "k"])

    # only one row of each class goes on; classes are few where rows are many
    singles = all_rows.join(reps.select("doc_id", "f1", "f2", "n"), ["doc_id", "f1", "f2", "n"], "left_semi")
    all_rows = stored(singles.where("n > 0").dropDuplicates(["doc_id", "f1", "f2", "n"]), "classes")
    packed = lambda side: keys(side).groupBy("doc_id").agg(
        F.collect_set(F.struct("i", "k")).alias(side), F.sum("weight").alias(f"w{side}"))
    shared = checkpointed(packed("a").join(packed("b"), "doc_id"))
    members = stored(shared.select("doc_id", (F.col("wa") + F.col("wb")).alias("weight"), F.explode("a").alias("x"), "b")
                     .select("doc_id", "weight", "x", F.explode("b").alias("y"))
                     .select("doc_id", "weight", F.xxhash64("x.i", "y.i", "x.k", "y.k").alias("bucket")), "tables")
    hubs = checkpointed(members.groupBy("bucket").agg(
        F.max(F.struct("weight", (-F.col("doc_id")).alias("low"))).alias("hub"), F.count("*").alias("rows"))
        .where("rows > 1").select("bucket", "hub"))
    stars = (members.join(hubs, "bucket")
             .select((-F.col("hub.low")).alias("u"), F.col("doc_id").alias("v")).where("u <> v").distinct())
    mask = all_rows.select("doc_id", "n", "p")
    stars = checkpointed(
        stars.join(mask.select(F.col("doc_id").alias("u"), F.struct("n", "p").alias("x")), "u")
        .join(mask.select(F.col("doc_id").alias("v"), F.struct("n", "p").alias("y")), "v")
        .where(_can_link("x", "y", percent)).select("u", "v").distinct())
    first = components(_confirmed(stars, docs, percent, words))

    # members of different components that share a key of A and a key of B
    placed = (all_rows.join(shared.select("doc_id", F.col("a").alias("own")), "doc_id")
              .join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left")
              .select("doc_id", "n", "a", "b", "p", "own", F.coalesce("component", "doc_id").alias("c")))
    spread = placed.select("doc_id", "n", "a", "b", "p", "c", F.explode("own").alias("e")).select(
        "doc_id", "n", "a", "b", "p", "c", F.col("e.i").alias("i"), F.col("e.k").alias("k"))
    open_keys = checkpointed(spread.groupBy("i", "k").agg(F.min("c").alias("c1"), F.max("c").alias("c2"))
                             .where("c1 <> c2").select("i", "k"))
    spread = checkpointed(spread.join(open_keys, ["i", "k"], "left_semi"))
    x, y = spread.alias("x"), spread.alias("y")
    get = lambda side, at: F.get(side, F.lit(at))
    earlier = reduce(lambda p, q: p | q, [
        (F.lit(at) < F.col("x.i")) & (get("x.a", at) == get("y.a", at)) for at in range(tables)])
    meets = reduce(lambda p, q: p | q, [get("x.b", at) == get("y.b", at) for at in range(tables)])
    rest = x.join(y, (F.col("x.i") == F.col("y.i")) & (F.col("x.k") == F.col("y.k"))
                  & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.c") != F.col("y.c"))
                  & ~earlier & meets & _can_link("x", "y", percent))
    rest = checkpointed(rest.select(F.col("x.doc_id").alias("u"), F.col("y.doc_id").alias("v")))
    found = components(first.select(F.col("node").alias("u"), F.col("component").alias("v"))
                       .unionAll(_confirmed(rest, docs, percent, words)))

    named = (rows.join(classes.where("rows > 1").select("f1", "f2", "n", "rep"), ["f1", "f2", "n"], "left")
             .select("doc_id", "text_hash", "n", F.coalesce("rep", "doc_id").alias("rep")))
    return (named.join(found.withColumnRenamed("node", "rep"), "rep", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"), "text_hash")
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())))


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The rows of `docs` without those that another document of their component stands for.

    Of each component the rows of its smallest id stay; rows that repeat an id and a text stay once. Rows
    without an id stay unless an equal text has an id. Their own columns are returned.
    """
    judged = checkpointed(near_duplicates(docs, percent, words).select("doc_id", "text_hash", "kept"))
    removed = judged.where(~F.col("kept")).select("doc_id", "text_hash").distinct()
    removed = F.broadcast(removed) if removed.count() <= BROADCAST_REMOVED else removed
    repeated = checkpointed(judged.where("kept").groupBy("doc_id", "text_hash").count().where("count > 1").drop("count"))

    def meets(other: DataFrame, how: str) -> DataFrame:
        left, right = docs.alias("d"), other.alias("o")
        return left.join(right, F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("o.doc_id")) & (
            F.xxhash64(F.col("d.text").cast("string")) == F.col("o.text_hash")), how).select("d.*")

    if not repeated.head(1):
        return meets(removed, "left_anti")
    return meets(removed.unionAll(repeated), "left_anti").unionByName(
        meets(repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


@query("op6_minhash_near_duplicates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
