"""Conversation structure repair with Four-Russians block tables (operator 12).

The cheapest edits that give a conversation the form `(s?(ua)+)?` are a shortest path over four states (nothing yet, after
the system turn, after a user turn, after an answer). What matters to the left of a row are the least costs of
finishing from each state; less their minimum, only a few such vectors exist. A table gives, for every vector
and every block of BLOCK symbols, the vector left of the block and what it adds to the cost. Conversations are
processed from the right, a block per lookup, and traced from the left: each block is expanded backward again,
and where several edits are cheapest the first in the alphabet is taken, so ties are settled in reading order.

Symbols, one byte a turn, are sorted by conversation and streamed first; the texts follow in a second pass, each
conversation behind its edits. So a task holds the symbols and edits of one conversation, but no texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wardlog.llm.common import query, table

BLOCK = 4
SPACES = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = ".!?"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1       # costs
NO_FAULT, BLANK, DUPLICATE, UNFINISHED = range(4)
ROLES = "sua"                                         # initials that the form knows; others are class 3
LEGAL = {(0, 1), (1, 2), (2, 1)}                      # su, ua, au
START, LED, ASKED, ANSWERED = range(4)
NEXT = {START: (ASKED, "user"), LED: (ASKED, "user"), ASKED: (ANSWERED, "assistant"), ANSWERED: (ASKED, "user")}
KEPT = {(START, 0): LED, (START, 1): ASKED, (LED, 1): ASKED, (ASKED, 2): ANSWERED, (ANSWERED, 1): ASKED}
MUST_GO, SYMBOLS = 8, 9                               # else 2 * class of the role + truncated

REPORT = {"gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint",
          "cost": "bigint", "audit": "string"}
REPORT_SQL = "conv_id bigint, " + ", ".join(f"{n} {t}" for n, t in REPORT.items())
ROWS_SQL = REPORT_SQL + ", position bigint, role string, text string"
REPORT_ARROW = [("conv_id", pa.int64()), *((n, pa.string() if t == "string" else pa.int64()) for n, t in REPORT.items())]
ROWS_ARROW = pa.schema([*REPORT_ARROW, ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
LONGEST = 2 ** 63 - 1


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[q][0]]) for q, c in enumerate(costs)]
    return tuple(costs)


def _edits(after: tuple[int, ...], symbol: int, q: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost to the end, state behind) of the ways to take a row in state q, in the letters' order."""
    yield "D", DELETE + after[q], q
    if symbol != MUST_GO:
        kind, late = divmod(symbol, 2)
        if (q, kind) in KEPT:
            yield "K", late * TRUNCATED + after[KEPT[q, kind]], KEPT[q, kind]
        yield "R", REROLE + late * TRUNCATED + after[NEXT[q][0]], NEXT[q][0]


def _before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    return _with_inserts([min(cost for _, cost, _ in _edits(after, symbol, q)) for q in range(4)])


def _taken(after: tuple[int, ...], symbol: int, q: int) -> tuple[str, int]:
    """Letters of the inserts before a row and of its edit, and the state behind it; ties go to the first letter."""
    best, letters = _before(after, symbol), ""
    while True:
        ways = [(letter, behind, True) for letter, cost, behind in _edits(after, symbol, q) if cost == best[q]]
        if INSERT + best[NEXT[q][0]] == best[q]:
            ways.append(("I", NEXT[q][0], False))
        letter, q, over = min(ways)
        letters += letter
        if over:
            return letters, q


class Tables:
    """Normalised cost vectors, what each symbol and each block does to them, and the edits of each row."""

    def __init__(self, block: int = BLOCK) -> None:
        far = 10 ** 6
        self.vectors = [_with_inserts([0, far, far, 0])]
        steps: list[list[tuple[int, int]]] = []
        for vector in self.vectors:                  # grows while new vectors are reached
            steps.append([])
            for symbol in range(SYMBOLS):
                costs = _before(vector, symbol)
                normal = tuple(c - min(costs) for c in costs)
                if normal not in self.vectors:
                    self.vectors.append(normal)
                steps[-1].append((self.vectors.index(normal), min(costs)))
        self.step = steps
        self.edits = [[[_taken(v, s, q) for s in range(SYMBOLS)] for q in range(4)] for v in self.vectors]
        one = np.array(steps)
        to, add = one[:, :, 0], one[:, :, 1]
        for _ in range(block - 1):                   # one more symbol in front of each block
            to, add = (np.stack([one[to, s, 0] for s in range(SYMBOLS)], 1).reshape(len(one), -1),
                       np.stack([add + one[to, s, 1] for s in range(SYMBOLS)], 1).reshape(len(one), -1))
        self.block, self.block_to, self.block_add = block, to.tolist(), add.tolist()

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """Least cost and, of the cheapest edits, those whose letters come first in the alphabet."""
        size, whole = self.block, len(symbols) - len(symbols) % self.block
        vector, cost = 0, 0
        for s in reversed(symbols[whole:]):
            vector, add = self.step[vector][s]
            cost += add
        right_of = []                                # vector right of each block, the last block first
        for at in range(whole - size, -1, -size):
            number = 0
            for s in symbols[at:at + size]:
                number = number * SYMBOLS + s
            right_of.append(vector)
            cost += self.block_add[vector][number]
            vector = self.block_to[vector][number]
        cost += self.vectors[vector][START]
        letters, q = [], START
        for at in range(0, whole, size):
            q = self._trace(symbols[at:at + size], right_of.pop(), q, letters)
        q = self._trace(symbols[whole:], 0, q, letters)
        while q not in (START, ANSWERED):
            letters.append("I")
            q = NEXT[q][0]
        return cost, "".join(letters)

    def _trace(self, symbols: bytes, vector: int, q: int, letters: list[str]) -> int:
        after = []
        for s in reversed(symbols):
            after.append(vector)
            vector = self.step[vector][s][0]
        for s in symbols:
            taken, q = self.edits[after.pop()][q][s]
            letters.append(taken)
        return q


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


class _Conversation:
    def __init__(self, number: int | None) -> None:
        self.number, self.symbols, self.before = number, bytearray(), None
        self.faults, self.illegal, self.turns, self.first, self.last = [0, 0, 0, 0], 0, 0, None, None

    def add(self, turn: int | None, kind: int, fault: int) -> None:
        if self.before is not None:
            self.illegal += (self.before, kind) not in LEGAL
        self.before = kind
        self.faults[fault] += 1
        self.symbols.append(MUST_GO if fault in (BLANK, DUPLICATE) else 2 * kind + (fault == UNFINISHED))
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn

    def report(self) -> tuple:
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.turns, LONGEST)
        return (self.number, gaps, *self.faults[1:], self.illegal, *tables().repair(bytes(self.symbols)))


def _reports(batches) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, present, turn, kind, fault) in order to one report per conversation."""
    schema, now = pa.schema(REPORT_ARROW), None
    for batch in batches:
        out = []
        for number, present, turn, kind, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or number != now.number:
                out += [now.report()] if now is not None else []
                now = _Conversation(number)
            if present:
                now.add(turn, kind, fault)
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, now.report()))], schema)


def _applied(batches) -> Iterator[pa.RecordBatch]:
    """Reports, each followed by its conversation's rows in order, to reports and repaired rows."""
    number, audit, at, q, position = None, "", 0, START, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, q, position
        while at < len(audit) and audit[at] == "I":
            q, role = NEXT[q]
            at, position = at + 1, position + 1
            yield number, *empty, position, role, ""

    empty = (None,) * len(REPORT)
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            *report, is_row, role, text = row
            if not is_row:
                number, audit, at, q, position = report[0], report[-1], 0, START, 0
                out.append((*report, 0, None, None))
                out += inserted()
                continue
            edit, at = audit[at], at + 1
            if edit != "D":
                kind = ROLES.find(role[:1]) if role[:1] else -1
                q, role = (KEPT[q, kind], role) if edit == "K" else NEXT[q]
                position += 1
                out.append((number, *empty, position, role, text))
            out += inserted()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
            zip(*out) if out else [[]] * len(ROWS_ARROW), ROWS_ARROW)], schema=ROWS_ARROW)


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """Turns (conv_id, turn, role, text) to reports and repaired turns.

    For each conversation a row of position 0 has the report: gaps, blank, duplicate, truncated, illegal, cost, audit.
    Rows of position 1, 2, ... have the repaired turns (role, text). Rows for which `present` is false belong to no
    conversation, but theirs is reported. Within a partition rows come by conversation and position.

    Turns are taken by number, nulls first; those of one number by role and then by the digest of their text, equal
    ones next to each other. A null role or text is a space. A null conv_id names one conversation. Other columns
    are ignored; an empty table gives an empty result. Gaps beyond BIGINT are its largest value. A conversation is
    streamed through one task, whatever its length, as the order of its edits demands; texts are never collected.
    """
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        or_space("role").alias("role"), or_space("text").alias("text"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    said, initial = F.rtrim("text", F.lit(SPACES)), F.substring("role", 1, 1)
    equal = Window.partitionBy("conv_id", "present", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    narrow = rows.select(
        "conv_id", "present", "turn", "role", "digest", (said == "").alias("blank"),
        F.substring(said, -1, 1).isin(*SENTENCE_ENDS).alias("ended"),
        F.coalesce(*[F.when(initial == c, F.lit(k)) for k, c in enumerate(ROLES)], F.lit(len(ROLES))).alias("kind")
    ).withColumn("repeated", F.row_number().over(equal) > 1)
    fault = (F.when(F.col("blank"), BLANK).when(F.col("repeated"), DUPLICATE).when(~F.col("ended"), UNFINISHED)
             .otherwise(NO_FAULT))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest"]
    reports = (narrow.repartition("conv_id").sortWithinPartitions(*order, "repeated")
               .select("conv_id", "present", "turn", "kind", fault.alias("fault")).mapInArrow(_reports, REPORT_SQL))
    texts = rows.where("present").select("conv_id", "turn", "role", "digest", "text", F.lit(True).alias("is_row"))
    both = reports.withColumn("is_row", F.lit(False)).unionByName(texts, allowMissingColumns=True)
    return (both.repartition("conv_id")
            .sortWithinPartitions(F.asc_nulls_first("conv_id"), "is_row", *order[1:])
            .select("conv_id", *REPORT, "is_row", "role", "text").mapInArrow(_applied, ROWS_SQL))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with planted faults, by the checksum of `conv_id:turn` modulo 20: 0 loses the row (column `present`), 1 its
    text, 2 its sentence ends; 3 repeats it, 4 makes it the user's. Nulls are a space."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    return turns.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), fate.alias("fate")).select(
        "conv_id", "turn", (F.col("fate") != 0).alias("present"),
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", SENTENCE_ENDS, ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    ).drop("copy")


def _digests(batches) -> Iterator[pa.RecordBatch]:
    """Reports and repaired rows in order to reports with the checksum of `role:text`, joined by line ends."""
    schema, report, digest, first = pa.schema([*REPORT_ARROW, ("repaired_sha256", pa.string())]), None, None, True
    for batch in batches:
        out = []
        for *row, position, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if position == 0:
                out += [(*report, digest.hexdigest())] if report else []
                report, digest, first = row, hashlib.sha256(), True
            else:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
    if report:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*report, digest.hexdigest())))], schema)


@query("op12_four_russians_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damaged(table(spark, sf_dir, "conversations"))
    return repair(turns, F.col("present")).mapInArrow(_digests, REPORT_SQL + ", repaired_sha256 string")
