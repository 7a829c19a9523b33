"""License scan by conditional compression (operator 10).

Candidate blocks are runs of lines that speak of licenses, a few other lines in between allowed. A block is
compressed alone and once with each template as a raw zstandard dictionary; the share of bytes a template
saves ranks it. Best first, templates are confirmed by the exact differences of wording: what a template says
and the block does not, and the other way round. The first confirmed one names the license.

Wrapped wording has lines, also its first and last ones, that speak of nothing. So the words around each cue, by
twice the longest template on both sides, are ranked and confirmed first; the differences trim the ends. Lines
confirmed that way are one block, with the cue lines next to it; the rest of the runs are blocks as they are.

One pass over the texts, a task's work is its own rows; a block's cost is its length times the templates.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardlog.llm.common import query, table
from wardlog.llm.license_texts import TEMPLATES

CUES = re.compile(r"licen[cs]|copyright|\(c\)|©|permission|warrant|redistribut|public domain|creative commons|\bcc0?\b|"
                  r"\bspdx\b|\bgpl|\bmpl\b|liabilit|liable|merchantab|\"software\"|noninfringement", re.I)
QUICK = ("licen", "copyright", "(c)", "©", "permission", "warrant", "redistribut", "public domain", "creative commons",
         "cc0", "spdx", "gpl", "mpl")     # a text without any of these has no block that names a license
GAP_LINES = 1            # lines without a cue that may lie inside a block
LEVEL = 3
LEAST_SAVED = 0.3        # share of the compressed bytes of the block, or of the template if that has fewer
MISSING_SHARE = 0.08     # words of the template that may be missing from the block
WORD = re.compile(r"[^\W_]+(?:[.\-'’][^\W_]+)*")
WRAP = r"-[ \t]*\r?\n[ \t]*(?:[#*/;%>]+[ \t]*)?"             # a line end behind a hyphen, and the mark of a comment
WRAPPED_WORD = re.compile(rf"[^\W_]+(?:(?:[.\-'’]|{WRAP})[^\W_]+)*")
WRAPPED_CUE = re.compile(r"public[\W_]+domain|creative[\W_]+commons", re.I)       # cues of two words, also on two lines

OUTPUT_SQL = ("doc_id bigint, first_line bigint, last_line bigint, license string, confirmed boolean, saved_bytes bigint, "
              "block_bytes bigint, missing_words bigint, extra_words bigint, missing string, extra string, "
              "ranking array<string>, block string")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.casefold())


class Scanner:
    """Templates as ready dictionaries and word lists; one per worker process."""

    def __init__(self, templates) -> None:
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.templates, self.sizes = [], []
        for name, wording in templates:
            raw = zstandard.ZstdCompressionDict(self.normal(wording), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.templates.append((name, words_of(wording), zstandard.ZstdCompressor(
                level=LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False)))
            self.sizes.append(len(self.alone.compress(self.normal(wording))))

    @staticmethod
    def normal(text: str) -> bytes:
        return " ".join(text.casefold().split()).encode("utf-8", "surrogatepass")

    def rank(self, block: str) -> tuple[int, list[tuple[int, int]]]:
        """Compressed bytes of the block, and (bytes saved, template) of those that save enough, best first.

        Equal savings are ordered by the closer length of wording, then by the order of the templates.
        """
        data = self.normal(block)
        size = len(self.alone.compress(data))
        saved = [(size - len(c.compress(data)), i) for i, (_, _, c) in enumerate(self.templates)]
        count = len(words_of(block))
        ranked = [(s, i) for s, i in saved if s >= LEAST_SAVED * min(size, self.sizes[i])]
        return size, sorted(ranked, key=lambda x: (-x[0], abs(len(self.templates[x[1]][1]) - count), x[1]))

    def differences(self, block: str, template: int) -> tuple[list[str], list[str]]:
        """Words of the template that the block lacks, and the words inside its wording that are not the template's."""
        said, here = self.templates[template][1], words_of(block)
        match = difflib.SequenceMatcher(None, said, here, autojunk=False)
        same = [m for m in match.get_matching_blocks() if m.size]
        first = same[0].b if same else 0
        last = same[-1].b + same[-1].size if same else 0
        missing, extra = [], []
        for kind, a, b, c, d in match.get_opcodes():
            if kind != "equal":
                missing += said[a:b]
                extra += here[max(c, first):min(d, last)]
        return missing, extra

    def close(self, template: int, missing: list[str], extra: list[str]) -> bool:
        allowed = MISSING_SHARE * len(self.templates[template][1])
        return len(missing) <= allowed and len(extra) <= len(missing) + allowed

    def locate(self, text: str, here: list[str]) -> tuple | None:
        """(template, first word, end, missing, extra) of the best template confirmed inside a text of words `here`.

        Of the words in common, the run that counts most less the words in between is the license's. The best is
        the one with most words in common less the differences, then the one that saves most.
        """
        won, most = None, 0
        known, match = set(here), difflib.SequenceMatcher(None, (), here, autojunk=False)
        for _, i in self.rank(text)[1]:
            said = self.templates[i][1]
            if sum(w not in known for w in said) > MISSING_SHARE * len(said):
                continue
            match.set_seq1(said)
            same = [m for m in match.get_matching_blocks() if m.size]
            best, total, start = (0, 0, 0), 0, 0
            for k, m in enumerate(same):
                between = m.b - same[k - 1].b - same[k - 1].size if k else 0
                total, start = (total - between, start) if total > between else (0, k)
                total += m.size
                best = max(best, (total, start, k + 1), key=lambda x: x[0])
            kept = same[best[1]:best[2]]
            missing, extra = said[:kept[0].a], []
            for m, n in zip(kept, kept[1:]):
                missing, extra = missing + said[m.a + m.size:n.a], extra + here[m.b + m.size:n.b]
            missing = missing + said[kept[-1].a + kept[-1].size:]
            gain = len(said) - 2 * len(missing) - len(extra)
            if gain > most and self.close(i, missing, extra):
                won, most = (i, kept[0].b, kept[-1].b + kept[-1].size, missing, extra), gain
        return won

    def located(self, text: str) -> list[tuple]:
        """(first line, last line, template, missing, extra) of the licenses confirmed around the cues of a text."""
        found = list(WRAPPED_WORD.finditer(text))
        words = [(re.sub(WRAP, "-", m[0]) if "\n" in m[0] else m[0]).casefold() for m in found]
        starts = [m.start() for m in found]
        cues = sorted({max(bisect_right(starts, m.start()) - 1, 0) for c in (CUES, WRAPPED_CUE) for m in c.finditer(text)})
        breaks = [m.end() for m in re.finditer("\n", text)]
        longest = max(len(t[1]) for t in self.templates)
        taken, at, low, high = [], 0, 0, len(words)       # no words before `low` or from `high` on are free
        while words and at < len(cues):
            a, b = max(low, cues[at] - 2 * longest), min(high, cues[at] + 2 * longest + 1)
            got = self.locate(text[starts[a]:found[b - 1].end()], words[a:b]) if a < b else None
            if got is None:
                # what lies whole in these words was tried; up to a license behind them nothing is left
                seen = min(cues[at] + longest, high - 1)
                if high < len(words):
                    low, high = next(t[1] for t in taken if t[0] == high), len(words)
                    seen = low - 1
                at = next((k for k in range(at, len(cues)) if cues[k] > max(seen, cues[at])), len(cues))
                continue
            i, first, end, missing, extra = got
            taken.append((a + first, a + end, i, missing, extra))
            if a + end <= cues[at]:
                low = a + end
            elif a + first > cues[at]:
                high = a + first
            else:
                low = a + end
                at = next((k for k in range(at, len(cues)) if cues[k] >= low), len(cues))
        return sorted(((bisect_right(breaks, starts[s]), bisect_right(breaks, found[e - 1].end() - 1), i, missing, extra)
                       for s, e, i, missing, extra in taken), key=lambda x: x[:2])

    def blocks(self, text: str) -> list[tuple]:
        """(first line, last line, block, what judge() gives) of each block of a text."""
        runs = blocks_of(text)
        if not runs and not WRAPPED_CUE.search(text):
            return []
        lines, near = text.split("\n"), GAP_LINES + 1
        merged: list[list] = []
        for first, last, *more in self.located(text):
            if merged and self.templates[merged[-1][2]][0] == self.templates[more[0]][0] and first - merged[-1][1] <= near:
                longer = max(merged[-1][2:], more, key=lambda x: len(self.templates[x[0]][1]))
                merged[-1] = [merged[-1][0], max(last, merged[-1][1]), *longer]
            else:
                merged.append([first, last, *more])
        inside = {k for first, last, *_ in merged for k in range(first, last + 1)}
        free = [k for a, b, _ in runs for k in range(a, b + 1) if k not in inside and CUES.search(lines[k])]
        left, grown = set(free), {}
        for k in reversed(free):        # cue lines next to a license belong to it: a holder before it, remarks behind it
            grown[k] = next((m for m in merged if 0 < m[0] - k <= near), None)
            if grown[k]:
                grown[k][0] = k
                left.discard(k)
        for k in free:
            after = next((m for m in merged if 0 < k - m[1] <= near), None) if k in left else None
            if after:
                after[1] = k
                left.discard(k)
        rows = []
        for first, last, i, missing, extra in merged:
            block = "\n".join(lines[first:last + 1])
            said = self.judge(block)
            name, _, compressor = self.templates[i]
            if said[0] != name:
                saved = said[3] - len(compressor.compress(self.normal(block)))
                said = (name, True, saved, said[3], missing, extra, said[6])
            rows.append((first, last, block, said))
        rest: list[list[int]] = []
        for k in sorted(left):
            if rest and k - rest[-1][1] <= near and not any(rest[-1][1] < m[0] < k for m in merged):
                rest[-1][1] = k
            else:
                rest.append([k, k])
        for first, last in rest:
            block = "\n".join(lines[first:last + 1])
            rows.append((first, last, block, self.judge(block)))
        return sorted(rows, key=lambda r: r[:2])

    def judge(self, block: str) -> tuple:
        """(license, confirmed, saved, bytes, missing, extra, ranking); an unconfirmed best has no license."""
        size, ranked = self.rank(block)
        ranking = [f"{self.templates[i][0]} {s}" for s, i in ranked]
        shown = None
        for s, i in ranked:
            missing, extra = self.differences(block, i)
            shown = shown or (s, missing, extra)
            if self.close(i, missing, extra):
                return self.templates[i][0], True, s, size, missing, extra, ranking
        s, missing, extra = shown or (0, [], [])
        return None, False, s, size, missing, extra, ranking


@lru_cache(maxsize=2)
def scanner(templates) -> Scanner:
    return Scanner(templates)


def blocks_of(text: str) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of each candidate block, lines counted from 0."""
    low = text.casefold()
    if not any(q in low for q in QUICK):
        return []
    lines = text.split("\n")
    at = [i for i, line in enumerate(lines) if CUES.search(line)]
    runs: list[list[int]] = []
    for i in at:
        if runs and i - runs[-1][1] <= GAP_LINES + 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return [(a, b, "\n".join(lines[a:b + 1])) for a, b in runs]


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Rows of `docs` (doc_id, text) to one row per candidate block or license found around its cues.

    Columns: doc_id, first_line, last_line, license (null if none is confirmed), confirmed, saved_bytes and
    block_bytes (of the confirmed or best template), missing_words, extra_words and these words, ranking
    (identifiers with the bytes they save, best first), block. Equal rankings are ordered by the closer length
    of wording, then by the templates' order. Null and empty texts have no block; a block may be a line of any
    length. Repeated rows and ids are scanned each by itself. Other columns are ignored; an empty table gives
    an empty result.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("first_line", pa.int64()), ("last_line", pa.int64()), ("license", pa.string()),
        ("confirmed", pa.bool_()), ("saved_bytes", pa.int64()), ("block_bytes", pa.int64()), ("missing_words", pa.int64()),
        ("extra_words", pa.int64()), ("missing", pa.string()), ("extra", pa.string()),
        ("ranking", pa.list_(pa.string())), ("block", pa.string())])

    def run(batches):
        known = scanner(templates)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                for first, last, block, judged in known.blocks(text.as_py() or ""):
                    name, sure, saved, size, missing, extra, ranking = judged
                    rows.append((doc_id.as_py(), first, last, name, sure, saved, size, len(missing), len(extra),
                                 " ".join(missing), " ".join(extra), ranking, block))
            columns = list(zip(*rows)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, OUTPUT_SQL)


@query("op10_license_compression")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
