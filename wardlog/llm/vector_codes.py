"""Vector code compression with product codebooks, assigned through a trie of parts (operator 13).

Vectors of integers are cut into equal parts and each part is replaced by the number of its nearest codebook entry.
A task sorts the distinct parts of a block lexicographically, which is the preorder of their trie, and walks
down depth first. A node holds the distances of its prefix to the same dimensions of all entries; children add
one dimension to it. Children with few parts are not walked into: their remaining dimensions are added to the
distances of their parent together. A leaf takes the nearest entry, and what its part adds to that entry is
weighted by how often the part occurs.

A training round is one pass over the vectors whose only shuffle is of partial sums, a row per task and entry at
most. Codebooks have `entries` rows per part, whatever the table's size, and are all that the driver holds.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlog.llm.common import query, stored, table

SCALE = 1024
FEW_PARTS = 32          # children with no more parts than this are not walked into
STRETCH = 1024          # parts whose remaining dimensions are added together
EXACT = 2 ** 53         # integers below it are exact in floating point


def limit_of(dimensions: int) -> int:
    """Components are held within +-limit, so that no squared distance of whole vectors leaves a BIGINT."""
    return math.isqrt((2 ** 63 - 1) // max(4 * dimensions, 1))


def nearest(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lexicographically sorted distinct rows: number of the nearest entry (ties: the first), squared distance."""
    n, width = parts.shape
    code, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n or not width:
        return code, error
    largest = max(np.abs(parts).max(), np.abs(codebook).max())
    kind = np.float64 if 4 * width * int(largest) ** 2 < EXACT else np.int64
    parts, entries = parts.astype(kind), codebook.astype(kind)
    tails = np.cumsum((entries ** 2)[:, ::-1], 1)[:, ::-1]      # squares of an entry's dimensions from d on
    stack = [(0, n, 0, np.zeros(len(entries), kind))]
    while stack:
        low, high, depth, distance = stack.pop()
        if depth == width:      # a single part
            code[low], error[low] = distance.argmin(), distance.min()
            continue
        values = parts[low:high, depth]
        heads = np.append(low + np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))), high)
        shared = np.flatnonzero(np.diff(heads) > FEW_PARTS)
        stack += [(heads[c], heads[c + 1], depth + 1, distance + (entries[:, depth] - parts[heads[c], depth]) ** 2)
                  for c in shared[::-1]]
        begin = low             # stretches between the children that are walked into
        for stop, after in [*zip(heads[shared], heads[shared + 1]), (high, high)]:
            for at in range(begin, stop, STRETCH):
                rest = parts[at:min(at + STRETCH, stop), depth:]
                here = distance + tails[:, depth] - 2 * (rest @ entries[:, depth:].T) + (rest ** 2).sum(1)[:, None]
                code[at:at + len(rest)], error[at:at + len(rest)] = here.argmin(1), here.min(1)
            begin = after
    return code, error


def assign(vectors: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Codes and errors of each vector and part, and per part (sums, counts) of the entries used.

    `vectors` is (n, dimensions) of integers, `codebooks` (parts, entries, width).
    """
    n_parts, entries, width = codebooks.shape
    codes, errors = np.zeros((len(vectors), n_parts), np.int64), np.zeros((len(vectors), n_parts), np.int64)
    totals = []
    for k in range(n_parts):
        part = vectors[:, k * width:(k + 1) * width]
        order = np.lexsort(part.T[::-1]) if width else np.arange(len(part))
        sorted_ = part[order]
        new = np.ones(len(part), bool)
        new[1:] = (sorted_[1:] != sorted_[:-1]).any(1)
        leaf = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        code, error = nearest(sorted_[heads], codebooks[k])
        codes[order, k], errors[order, k] = code[leaf], error[leaf]
        weights = np.diff(np.append(heads, len(part)))
        sums = np.zeros((entries, width), np.int64)
        np.add.at(sums, code, sorted_[heads] * weights[:, None])
        totals.append((sums, np.bincount(code, weights, entries).astype(np.int64)))
    return codes, errors, totals


def scaled(batch_column: pa.ListArray, dimensions: int) -> np.ndarray:
    """Rows of floor(SCALE * x); exact, as SCALE is a power of two and the components are doubles."""
    flat = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    limit = limit_of(dimensions)
    return np.clip(np.floor(flat * SCALE), -limit, limit).astype(np.int64).reshape(len(batch_column), dimensions)


def _usable(vector: Column) -> Column:
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(good(x), F.lit(False)))


def usable_vectors(vectors: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, label, vector) of the rows that count, and their dimension.

    A vector that is null or has a null or non-finite component is dropped. The dimension is that of the row of least
    vec_id; vectors of another one, or of one that cannot be cut into equal parts, have no code and are dropped too.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label",
                          F.col("embedding").cast("array<double>").alias("vector")).where(_usable(F.col("vector")))
    whole = rows.where(F.size("vector") % parts == 0)
    first = whole.select(F.size("vector").alias("n"), "vec_id").orderBy(F.asc_nulls_last("vec_id"), "n").limit(1).collect()
    n = first[0].n if first else 0
    return whole.where(F.size("vector") == n), n


def first_codebooks(rows: DataFrame, dimensions: int, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors of the `entries` smallest ids (equal ids: by vector), in that order."""
    first = rows.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    limit, width = limit_of(dimensions), dimensions // parts
    whole = np.array([r.vector for r in first], np.float64).reshape(len(first), dimensions)
    return np.clip(np.floor(whole * SCALE), -limit, limit).astype(np.int64).reshape(
        len(first), parts, width).transpose(1, 0, 2).copy()


def train(rows: DataFrame, codebooks: np.ndarray, dimensions: int) -> np.ndarray:
    """One round: every entry becomes the floor of its parts' mean, an unused one stays."""
    n_parts, entries, width = codebooks.shape

    def sums(batches):
        total = None
        for batch in batches:
            found = assign(scaled(batch.column(0), dimensions), codebooks)[2]
            # sums of a task are Python integers: they cannot overflow
            found = [(s.astype(object), c) for s, c in found]
            total = found if total is None else [(a + c, b + d) for (a, b), (c, d) in zip(total, found)]
        for k, (s, c) in enumerate(total or []):
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({
                "part": np.full(len(used), k, np.int32), "entry": used.astype(np.int32), "n": c[used],
                "total": pa.array([[str(x) for x in row] for row in s[used]], pa.list_(pa.string()))})

    partial = rows.select("vector").mapInArrow(sums, "part int, entry int, n bigint, total array<string>")
    each = partial.select("part", "entry", "n", F.posexplode_outer("total").alias("at", "x"))
    merged = each.groupBy("part", "entry", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    out = codebooks.copy()
    for r in merged.where("at is not null").collect():      # parts x entries x width rows, whatever the input
        out[r.part, r.entry, r.at] = int(r.x) // r.n
    return out


def codebooks_text(codebooks: np.ndarray) -> str:
    return ",".join(map(str, codebooks.ravel().tolist()))


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable vectors, and the codebooks (parts, entries, width) they refer to.

    `vectors` has vec_id, embedding and label; other columns are ignored. Columns of the result: vec_id, label,
    code (one number per part), errors (squared distance per part, in units of 1/SCALE**2). Fewer vectors than entries
    give that many entries; an empty table gives no rows and no entries. Repeated ids, null ids and null labels
    are kept as rows of their own. A component beyond +-`limit_of` is held there. Every round covers all rows.
    """
    rows, dimensions = usable_vectors(vectors, parts)
    codebooks = first_codebooks(rows, dimensions, parts, entries)
    for _ in range(rounds if codebooks.shape[1] else 0):
        codebooks = train(rows, codebooks, dimensions)
    final = codebooks

    def codes(batches):
        for batch in batches:
            if batch.num_rows:
                code, error, _ = assign(scaled(batch.column(2), dimensions), final)
                offsets = pa.array(np.arange(0, code.size + 1, parts, dtype=np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (code, error)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *lists], names=["vec_id", "label", "code", "errors"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(codes, f"vec_id bigint, label {label}, code array<bigint>, errors array<bigint>"), codebooks


@query("op13_trie_codes")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, codebooks = compress(table(spark, sf_dir, "embeddings"))
    hexes = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    error = F.aggregate("errors", F.lit(0).cast("bigint"), lambda a, b: a + b)
    rows = stored(found.select("vec_id", "label", hexes.alias("code"), error.alias("error")), "vector_codes")
    sums = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(codebooks_text(codebooks).encode()).hexdigest()
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
