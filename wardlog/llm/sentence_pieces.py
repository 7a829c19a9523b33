"""SentencePiece encoding and decoding by vectorised merge rounds (operator 11).

Encoding joins, again and again, the adjacent pair of symbols whose union has the best score, the leftmost first.
Pairs never join across two characters that stand together in no piece of the vocabulary, so a text falls into
short segments that do not influence each other, and equal words of a block are encoded once. All segments of
a block lie in flat arrays and go through rounds together. In a round each segment finds its best rank and joins
all pairs of that rank, leftmost first and without overlap. Finished segments leave the arrays.

One-at-a-time joining would turn to a pair that a join has just made if its rank is as good as the current one.
A segment's joins of a round therefore end with the first one that makes such a pair; the others follow later.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wardlog.llm.common import query, table

SPACE = "▁"
NEVER = np.iinfo(np.int32).max      # rank of a pair that does not join
BLOCK_CHARS = 1 << 21               # characters whose words are encoded together
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)     # kinds of pieces


class _Pairs:
    """Values of pairs of small numbers in a hash table of twice to four times as many places."""

    def __init__(self, size: int, found: dict[tuple[int, int], int]) -> None:
        self.size, self.bits = size, max(len(found).bit_length() + 1, 4)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        keys = np.array([a * size + b for a, b in found], np.int64)
        for key, place, value in zip(keys.tolist(), self._place(keys).tolist(), found.values()):
            while self.keys[place] >= 0:
                place = (place + 1) % len(self.keys)
            self.keys[place], self.values[place] = key, value

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The value of each pair, -1 where there is none (also for negative numbers)."""
        wanted = left.astype(np.int64) * self.size + right
        place = self._place(wanted)
        there = self.keys[place]
        out = np.where(there == wanted, self.values[place], -1)
        open_ = np.flatnonzero((there != wanted) & (there >= 0))     # another pair is there: look behind it
        place = place[open_]
        while len(open_):
            place = (place + 1) % len(self.keys)
            there = self.keys[place]
            hit = there == wanted[open_]
            out[open_[hit]] = self.values[place[hit]]
            more = ~hit & (there >= 0)
            open_, place = open_[more], place[more]
        out[(left < 0) | (right < 0)] = -1
        return out


class PieceModel:
    """A SentencePiece model of the pair-joining kind with byte fallback and without normalisation rules."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules, trainer = model.normalizer_spec, model.trainer_spec
        kinds = [p.type for p in model.pieces]
        if (trainer.model_type != trainer.BPE or not trainer.byte_fallback or rules.precompiled_charsmap
                or rules.remove_extra_whitespaces or not rules.escape_whitespaces
                or trainer.treat_whitespace_as_suffix or {USER_DEFINED, UNUSED} & set(kinds)):
            raise ValueError(f"{path}: not a byte-fallback BPE model without normalisation")
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.byte_ids = np.full(256, -1, np.int32)
        surfaces = []
        for number, piece in enumerate(model.pieces):
            if piece.type == BYTE:
                value = int(piece.piece[3:5], 16)      # written as <0x41>
                self.byte_ids[value] = number
                surfaces.append(bytes([value]))
            else:
                surfaces.append({CONTROL: "", UNKNOWN: trainer.unk_surface}.get(
                    piece.type, piece.piece.replace(SPACE, " ")).encode())
        self.spaced = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in model.pieces])
        self.widths = np.array([len(s) for s in surfaces], np.int64)
        self.surfaces = np.frombuffer(b"".join(surfaces), np.uint8)
        self.places = np.concatenate(([0], np.cumsum(self.widths)[:-1]))

        pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        scores = np.array([-p.score for p in model.pieces], np.float32)
        self.ranks = np.append(np.unique(scores, return_inverse=True)[1].astype(np.int32), NEVER)   # [-1]: no piece
        symbols = dict(pieces)       # characters of pieces that are no piece of their own have numbers past the ids
        for c in sorted(set("".join(pieces)) - set(pieces)):
            symbols[c] = len(kinds) + len(symbols) - len(pieces)
        self.n_ids, size = len(kinds), len(kinds) + len(symbols) - len(pieces)
        self.symbols = np.full(0x110000, -1, np.int32)
        for s, number in symbols.items():
            if len(s) == 1:
                self.symbols[ord(s)] = number
        self.neighbours = _Pairs(size, {(symbols[a], symbols[b]): 1 for p in pieces for a, b in zip(p, p[1:])})
        self.joined = _Pairs(size, {
            (symbols[p[:k]], symbols[p[k:]]): number for p, number in pieces.items() for k in range(1, len(p))
            if p[:k] in symbols and p[k:] in symbols})
        self.words = re.compile(self._word_pattern(pieces))
        self.cut = re.compile(f"[^{SPACE}](?={SPACE})")

    def _word_pattern(self, pieces: dict[str, int]) -> str:
        """A word is a run of spaces and what follows. Where no piece has a space behind another character, words
        do not influence each other. Runs of spaces join last and from the left, if their pieces share the worst
        rank; once the first piece is as long as any and the rest is untouched, it is a word by itself as well."""
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            return r"[\s\S]+"
        runs = {len(p): self.ranks[i] for p, i in pieces.items() if not p.strip(SPACE)}
        longest, worst = max(runs, default=1), max(self.ranks[i] for i in pieces.values())
        stretch = ""
        if longest > 1 and all(r == worst for n, r in runs.items() if n > 1) and not any(
                p.startswith(2 * SPACE) and p.strip(SPACE) for p in pieces):
            line = [1] * (2 * longest)
            while line[0] < longest and (i := next((i for i in range(len(line) - 1) if line[i] + line[i + 1] in runs), -1)) >= 0:
                line[i:i + 2] = [line[i] + line[i + 1]]
            if line[0] == longest and set(line[1:]) == {1}:
                stretch = f"{SPACE}{{{longest}}}(?={SPACE})|"
        return f"{stretch}{SPACE}+[^{SPACE}]*|[^{SPACE}]+"

    def normalised(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def split(self, text: str, size: int = BLOCK_CHARS) -> Iterator[list[str]]:
        """The words of a text, in lists of about `size` characters."""
        text, at = self.normalised(text), 0
        while at < len(text):
            found = self.cut.search(text, at + size)
            end = found.end() if found else len(text)
            yield self.words.findall(text, at, end)
            at = end

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each word has."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.symbols[points]
        heads = np.ones(len(points), bool)
        heads[1:] = self.neighbours(symbols[:-1], symbols[1:]) < 0
        heads[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        final = self._rounds(symbols, np.cumsum(heads))
        return self._with_bytes(points, final, lengths)

    def _rounds(self, symbols: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """Per character the piece that begins with it, -2 inside a piece (-1 or past the ids: no piece)."""
        final = np.full(len(symbols), -2, np.int32)
        sym, seg, place = symbols, segments, np.arange(len(symbols))
        made = np.full(len(sym), -1, np.int32)
        inside = np.flatnonzero(seg[1:] == seg[:-1])
        made[inside] = self.joined(sym[inside], sym[inside + 1])
        rank = self.ranks[made]
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            sizes = np.diff(np.append(starts, len(seg)))
            best = np.minimum.reduceat(rank, starts)
            if (best == NEVER).any():
                done = np.repeat(best == NEVER, sizes)
                final[place[done]] = sym[done]
                left = ~done
                sym, seg, place, made, rank = sym[left], seg[left], place[left], made[left], rank[left]
                sizes, best = sizes[best != NEVER], best[best != NEVER]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            number = np.arange(len(at))
            first = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) == 1, 0, number))
            at = self._until_overtaken(at[(number - first) % 2 == 0], sym, seg, made, rank)
            sym[at] = made[at]
            left = np.ones(len(sym), bool)
            left[at + 1] = False
            sym, seg, place, made, rank = sym[left], seg[left], place[left], made[left], rank[left]
            at = at - np.arange(len(at))
            for changed in (at, at[at > 0] - 1):
                after = np.minimum(changed + 1, len(sym) - 1)
                inside = (after > changed) & (seg[after] == seg[changed])
                new = np.where(inside, self.joined(sym[changed], sym[after]), -1)
                made[changed], rank[changed] = new, self.ranks[new]
        return final

    def _until_overtaken(self, at, sym, seg, made, rank) -> np.ndarray:
        """The joins up to and including the first of its segment that makes a pair to be joined before the rest."""
        new, old = made[at], rank[at]
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(sym) - 1)
        left = np.where(np.diff(at, prepend=-9) == 2, np.roll(new, 1), sym[before])
        left = np.where((at > 0) & (seg[before] == seg[at]), left, -1)
        right = np.where((at + 2 < len(sym)) & (seg[after] == seg[at]), sym[after], -1)
        overtaken = (self.ranks[self.joined(left, new)] <= old) | (self.ranks[self.joined(new, right)] <= old)
        if not overtaken.any():
            return at
        earlier = np.cumsum(overtaken) - overtaken
        own = seg[at]
        heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        return at[earlier == np.repeat(earlier[heads], np.diff(np.append(heads, len(at))))]

    def _with_bytes(self, points, final, lengths) -> tuple[np.ndarray, np.ndarray]:
        """Pieces to ids; a character that is no piece becomes its bytes."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        begins = final != -2
        ids, word, points = final[begins], word[begins], points[begins]
        alone = np.flatnonzero((ids < 0) | (ids >= self.n_ids))
        if len(alone):
            count = np.ones(len(ids), np.int64)
            p = points[alone]
            count[alone] = 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)
            raw = np.frombuffer("".join(map(chr, p)).encode(), np.uint8)
            wide = np.repeat(ids, count)
            is_alone = np.zeros(len(ids), bool)
            is_alone[alone] = True
            wide[np.repeat(is_alone, count)] = self.byte_ids[raw]
            ids, word = wide, np.repeat(word, count)
        return ids, np.bincount(word, minlength=len(lengths))

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order. Words are looked at in blocks, long texts in several."""
        waiting: list[list[str]] = []     # words of each text since the last block; the first may go on from it
        held, parts = 0, []               # characters waiting, ids of the first text's earlier blocks

        def block() -> list[np.ndarray]:
            done = self._encode_block(waiting)
            return [np.concatenate([*parts, done[0]]), *done[1:]] if parts else done

        for text in texts:
            waiting.append([])
            for words in self.split(text):
                waiting[-1] += words
                held += sum(map(len, words))
                if held >= BLOCK_CHARS:
                    *done, last = block() if len(waiting) > 1 else self._encode_block(waiting)
                    parts = [last] if len(waiting) > 1 else [*parts, last]
                    yield from done
                    waiting, held = [[]], 0
        if waiting:
            yield from block()

    def _encode_block(self, waiting: list[list[str]]) -> list[np.ndarray]:
        numbers: dict[str, int] = {}
        code = np.array([numbers.setdefault(w, len(numbers)) for words in waiting for w in words], np.int64)
        ids, counts = self.encode_words(list(numbers))
        begins = np.cumsum(counts) - counts
        each = counts[code]
        ends = np.cumsum(each)
        flat = ids[np.repeat(begins[code] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.cumsum([len(words) for words in waiting])[:-1]
        return np.split(flat, np.concatenate(([0], ends))[cuts])

    def surface_bytes(self, ids: np.ndarray) -> bytes:
        """The surfaces of the pieces one after another."""
        width = self.widths[ids]
        ends = np.cumsum(width)
        return self.surfaces[np.repeat(self.places[ids] - (ends - width), width)
                             + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the leading space that encoding has added.

        Each byte that belongs to no character becomes U+FFFD; control pieces say nothing, but end a run of bytes.
        """
        silent = self.widths[ids] == 0
        stretches = np.split(ids, np.flatnonzero(silent)) if silent.any() else [ids]
        text = "".join(_characters(self.surface_bytes(s)) for s in stretches)
        first = ids[~silent][:1]
        return text[1:] if self.prefix and self.spaced[first].any() else text


def _characters(raw: bytes) -> str:
    out = []
    while raw:
        try:
            return "".join([*out, raw.decode()])
        except UnicodeDecodeError as error:
            out += raw[:error.start].decode(), "\ufffd"
            raw = raw[error.start + 1:]
    return "".join(out)


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def _added(df: DataFrame, column: str, kind: str, out: str, out_type: T.DataType, values) -> DataFrame:
    """`df` with the column `out` made by `values(array)`, batch by batch; a column of that name is replaced."""
    ready = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()],
                      F.col(f"`{column}`").cast(kind).alias(out))
    schema = T.StructType([*ready.schema.fields[:-1], T.StructField(out, out_type)])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values(batch.column(batch.num_columns - 1))],
                                             names=schema.names)
    return ready.mapInArrow(run, schema)


def encode_texts(df: DataFrame, model_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """`df` with the ids of a text column, as the sentencepiece library gives them without begin and end.

    A null or empty text has no ids. Every row stands for itself, whatever its other columns hold; those are
    kept, but for one named like `out`, which is replaced. Whole texts are encoded, in blocks of bounded size that
    are cut between words. An empty table gives an empty one.
    """
    def values(column: pa.Array) -> pa.Array:
        found = list(piece_model(model_path).encode(t or "" for t in column.to_pylist()))
        offsets = np.concatenate(([0], np.cumsum([len(ids) for ids in found]))).astype(np.int32)
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
    return _added(df, text, "string", out, T.ArrayType(T.IntegerType()), values)


def decode_ids(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the text of a column of ids. Null ids, arrays or elements, count as missing: null gives ''.

    Ids outside the vocabulary are an error, as they are in the library.
    """
    def values(column: pa.Array) -> pa.Array:
        model, texts = piece_model(model_path), []
        for row in column:
            found = row.values
            found = found.drop_null().to_numpy(zero_copy_only=False) if found is not None else np.zeros(0, np.int32)
            if len(found) and not 0 <= found.min() <= found.max() < model.n_ids:
                raise ValueError("id outside the vocabulary")
            texts.append(model.decode(found))
        return pa.array(texts, pa.string())
    return _added(df, ids, "array<int>", out, T.StringType(), values)


@query("op11_sentencepiece_rounds")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public
    path = public.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode_ids(encode_texts(docs, path).select("doc_id", "ids"), path)
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
