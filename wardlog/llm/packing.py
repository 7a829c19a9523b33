"""Order-preserving packing of documents into training sequences (operator 9).

Documents keep the order they are stored in and are laid end to end; a window is a run of that
stream. Windows are cut by dynamic programming: a cut may lie at the end of a document (free), at
the end of a sentence (a small penalty) or inside a very long sentence (a larger one), and the sum of
padding and penalties is least. With f the least cost of a stream up to a cut,

    f(j) = penalty(j) + length - pos(j) + min over cuts i with pos(j) - pos(i) <= length of f(i) + pos(i)

and a monotone queue keeps that minimum, so each cut costs constant time.

One pass without a shuffle: every task packs the rows of its own partition, in blocks of a bounded
number of tokens; what the last windows of a block hold is carried over to the next one.
"""

from __future__ import annotations

import base64
import sys
import zlib
from array import array
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardlog.llm.common import query, table

LENGTH = 2048
END_ID = 1
SENTENCE_PENALTY = 4      # padding tokens that a cut between two sentences is worth
INSIDE_PENALTY = 8        # ... and one inside a sentence of more than LONG_SENTENCE tokens
LONG_SENTENCE = 64
INSIDE_STEP = 32
BLOCK_TOKENS = 1 << 18

SENTENCE_ENDS = (b".", b"!", b"?")     # a sentence ends where such a byte is followed by white space

OUTPUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64())])
OUTPUT_SQL = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
              "sequence_id bigint, offset bigint")


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, and where sentences end among them.

    The byte-pair encoder of the same vocabulary gives the same ids in a third of the time; texts that hold
    the string of a special token go to the library itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pairs = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        size = max(max(ranks.values()) + 1, self.library.get_vocab_size(with_added_tokens=True))
        self.ends, self.begins = np.zeros(size, bool), np.zeros(size, bool)
        for token, number in ranks.items():
            self.ends[number] = token[-1:] in SENTENCE_ENDS
            self.begins[number] = token[:1].isspace()

    def encode(self, text: str) -> tuple[bytes, np.ndarray]:
        """The ids, and the places among them where a sentence begins after another one."""
        if any(s in text for s in self.special):
            ids = as_bytes(self.library.encode(text, add_special_tokens=False).ids)
        else:
            ids = as_bytes(self.pairs.encode_ordinary(text))
        numbers = np.frombuffer(ids, "<u4")
        return ids, np.flatnonzero(self.ends[numbers[:-1]] & self.begins[numbers[1:]]) + 1


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str, pattern: str) -> Encoder:
    return Encoder(json_path, ranks_path, pattern)


def least_cost_cuts(positions: list[int], penalties: list[int], length: int) -> list[int]:
    """Indexes of the chosen cuts, first and last included; no two positions lie further apart."""
    cost, back = [0] * len(positions), [0] * len(positions)
    queue = deque([0])
    for j in range(1, len(positions)):
        here = positions[j]
        while positions[queue[0]] < here - length:
            queue.popleft()
        i = queue[0]
        cost[j] = cost[i] + positions[i] + length - here + penalties[j]
        back[j] = i
        reach = cost[j] + here
        while queue and cost[queue[-1]] + positions[queue[-1]] >= reach:
            queue.pop()
        queue.append(j)
    chosen = [len(positions) - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return chosen[::-1]


class Packer:
    """The stream of one partition: add documents, take finished pieces."""

    def __init__(self, length: int, first_sequence: int) -> None:
        self.length, self.sequence = length, first_sequence
        self.held: list[list] = []       # [doc_id, ids, taken so far, ends of sentences]
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes, sentences: np.ndarray) -> None:
        ids = ids + END_ID.to_bytes(4, "little")
        self.held.append([doc_id, ids, 0, sentences.tolist()])
        self.tokens += len(ids) // 4
        if self.tokens >= BLOCK_TOKENS:
            self.pack(final=False)

    def _cuts(self) -> tuple[list[int], list[int]]:
        positions, penalties, base = [0], [0], 0
        for _, ids, taken, ends in self.held:
            total, last = len(ids) // 4, taken
            for end in [*(e for e in ends if taken < e < total - 1), total]:
                inside = range(last + INSIDE_STEP, end, INSIDE_STEP) if end - last > LONG_SENTENCE else ()
                positions += [base + at - taken for at in inside]
                penalties += [INSIDE_PENALTY] * len(inside)
                positions.append(base + end - taken)
                penalties.append(SENTENCE_PENALTY if end < total else 0)
                last = end
            base += total - taken
        return positions, penalties

    def pack(self, final: bool) -> None:
        if not self.held:
            return
        positions, penalties = self._cuts()
        ends = [positions[i] for i in least_cost_cuts(positions, penalties, self.length)][1:]
        if not final:
            ends = ends[:-2]
        at, done = 0, 0
        for end in ends:
            offset = 0
            while at < end:
                doc_id, ids, taken, _ = doc = self.held[done]
                take = min(end - at, len(ids) // 4 - taken)
                crc = zlib.crc32(memoryview(ids)[4 * taken:4 * (taken + take)])
                self.rows.append((doc_id, taken, take, crc, len(ids) // 4, self.sequence, offset))
                doc[2] = taken + take
                done += doc[2] == len(ids) // 4
                at += take
                offset += take
            self.sequence += 1
        self.held, self.tokens = self.held[done:], self.tokens - at

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[] for _ in OUTPUT]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, OUTPUT)], schema=OUTPUT)


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, length: int = LENGTH) -> DataFrame:
    """Rows of (doc_id, text) to pieces of sequences of at most `length` ids, one row per piece.

    A document is its ids and then END_ID; each id lies in exactly one piece. `start` counts the
    document's ids before the piece, `offset` those of the sequence before it. A null or empty text
    is END_ID alone. Every row is a document of its own, also with a null or repeated doc_id. Sequence
    numbers are unique, and rise with the stored order within a partition. Other columns are ignored;
    an empty table gives an empty result. The lengths of windows that happen to be a power of two need
    no padding; they are not sought.
    """
    def run(batches):
        words = encoder(json_path, ranks_path, pattern)
        packer = Packer(length, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                packer.add(doc_id.as_py(), *words.encode(text.as_py() or ""))
            yield packer.take()
        packer.pack(final=True)
        yield packer.take()
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, OUTPUT_SQL)


def pack_with_public_tokenizer(docs: DataFrame) -> DataFrame:
    import public_tokenizers as public
    return pack(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


@query("op9_ordered_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_with_public_tokenizer(table(spark, sf_dir, "documents"))
