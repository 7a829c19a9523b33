import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from wardlog.llm.conversation_repair import Tables, damaged, repair, tables
from wardlog.llm.queries import QUERIES

LAST = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")
FORM = re.compile(r"(s?(ua)+)?\Z")


def all_audits(rows, most_inserts):
    """Every (cost, audit, roles) that gives the form; rows are (initial, fault)."""
    def go(i, roles, left):
        if i == len(rows):
            yield 0, "", roles
        else:
            initial, fault = rows[i]
            yield from ((c + 3, "D" + a, r) for c, a, r in go(i + 1, roles, left))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                yield from ((c + late, "K" + a, r) for c, a, r in go(i + 1, roles + initial, left))
                for new in "ua":
                    yield from ((c + 2 + late, "R" + a, r) for c, a, r in go(i + 1, roles + new, left))
        if left:
            for new in "ua":
                yield from ((c + 2, "I" + a, r) for c, a, r in go(i, roles + new, left - 1))
    return (x for x in go(0, "", most_inserts) if FORM.match(x[2]))


@pytest.mark.parametrize("block", [1, 3, 4])
def test_cheapest_edits_of_all(block):
    rng, t = random.Random(block), Tables(block)
    for _ in range(60):
        rows = [(rng.choice("suaat"), rng.choice(["", "", "blank", "truncated"])) for _ in range(rng.randint(0, 4))]
        symbols = bytes(8 if f == "blank" else 2 * "suat".index(r) + (f == "truncated") for r, f in rows)
        cost, audit, _ = min(all_audits(rows, 4))
        assert t.repair(symbols) == (cost, audit), rows


def test_block_size_changes_nothing():
    rng, other = random.Random(5), Tables(3)
    for n in (0, 1, 5, 63, 64, 65, 1000):
        symbols = bytes(rng.randrange(9) for _ in range(n))
        assert tables().repair(symbols) == other.repair(symbols)


def plain_edits(rows):
    """Least (cost, audit) from each row and state on, and the repaired rows."""
    n, after = len(rows), {"": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}
    best = {}
    for i in range(n, -1, -1):
        for q in ("", "s", "u", "a"):
            best[i, q] = (0, "") if i == n and q in ("", "a") else (10 ** 9, "")
            if i < n:
                role, _, fault = rows[i]
                ways = [(3, "D", q)]
                if fault not in ("blank", "duplicate"):
                    late = fault == "truncated"
                    if role[:1] == after[q][0] or (role[:1] == "s" and q == ""):
                        ways.append((late, "K", role[:1]))
                    ways.append((2 + late, "R", after[q][0]))
                best[i, q] = min((c + best[i + 1, b][0], x + best[i + 1, b][1]) for c, x, b in ways)
        for _ in range(3):
            for q in ("", "s", "u", "a"):
                c, a = best[i, after[q][0]]
                best[i, q] = min(best[i, q], (c + 2, "I" + a))
    cost, audit = best[0, ""]
    out, q, rest = [], "", list(rows)
    for x in audit:
        row = rest.pop(0) if x != "I" else None
        if x == "D":
            continue
        out.append((row[0] if x == "K" else after[q][1]) + ":" + (row[1] if row else ""))
        q = row[0][:1] if x == "K" else after[q][0]
    return cost, audit, "\n".join(out)


def plain(table):
    """{conv_id: columns of the query} of rows (conv_id, turn, role, text), by the contract's words."""
    rows = defaultdict(list)
    for conv, turn, role, text in table:
        rows[conv]
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        rows[conv] += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    out = {}
    for conv, found in rows.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in found:
            last = LAST.search(text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen
                          else "truncated" if last.group() not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in found if t is not None}
        cost, audit, text = plain_edits([(r, t, f) for (_, r, t), f in zip(found, faults)])
        initials = [r[:1] for _, r, _ in found]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


def as_plain(df):
    rows = [tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                        "repaired_sha256").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_query_is_the_plain_version(spark):
    for sf in ("sf0.001", "sf0.01"):
        folder = f"/root/testdata/{sf}"
        table = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert as_plain(QUERIES["op12_four_russians_repair"](spark, folder)) == plain(table)


def test_edges(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " \t", "Yes.", "No", "Well!  ", "a\nb?", "　", "x" * 100_000 + ".", "🙂"]
    roles = [None, "", "user", "assistant", "system", "User", "tool", "unknown", "s"]
    table = [(rng.choice([None, *range(40)]), rng.choice([None, *range(-3, 12)]), rng.choice(roles), rng.choice(texts))
             for _ in range(700)]
    table += [(77, t, "user" if t % 2 else "assistant", f"line {t}.") for t in range(5000)]
    table += [(78, 2 ** 62, "user", "a."), (78, -2 ** 62, "user", "b."), (79, 5, "user", "same.")] + [(79, 5, "user", "same.")] * 30
    df = spark.createDataFrame([(*r, "x", 1) for r in table], "conv_id bigint, turn bigint, role string, text string, digest string, audit int")
    df.repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    assert as_plain(QUERIES["op12_four_russians_repair"](spark, str(tmp_path))) == plain(table)
    assert repair(df.limit(0)).count() == 0


def test_repaired_rows_have_the_form(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    lost = damaged(turns)
    rows = repair(lost, lost.present).where("position > 0").collect()
    by_conv = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.conv_id, r.position)):
        by_conv[r.conv_id].append(r.role[0])
    assert by_conv and all(FORM.match("".join(x)) for x in by_conv.values())
