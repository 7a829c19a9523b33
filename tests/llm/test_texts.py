import textwrap

from pyspark.sql import functions as F
from wardlog.llm import preference
from wardlog.llm.license_scan import Scanner, blocks_of, scan
from wardlog.llm.license_texts import MIT_TERMS, TEMPLATES


def test_every_template_is_found_with_a_holder_before_it():
    scanner = Scanner(TEMPLATES)
    for name, wording in TEMPLATES:
        assert scanner.judge("Copyright (c) 2021 Jane Doe\n" + wording)[:2] == (name, True), wording[:60]
    for block in ("Licensed under CC BY-NC 4.1.", "Permission denied", "We discuss the license at length", MIT_TERMS[:300]):
        assert scanner.judge(block)[:2] == (None, False), block
    changed = scanner.judge(MIT_TERMS.replace("sell", "lease"))
    assert changed[:2] == ("MIT", True) and changed[4:6] == (["sell"], ["lease"])


def test_scan(spark):
    rows = [(1, "prose\nReleased under the MIT License.\nmore prose"), (2, f"x\n{MIT_TERMS}\ny"), (3, None), (4, ""),
            (5, "nothing here"), (1, "prose\nReleased under the MIT License.\nmore prose"), (None, "Licensed under CC BY 4.0."),
            (6, "word " * 50_000 + "Licensed under CC BY-SA 4.0. " + "word " * 50_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, license int")
    got = sorted((str(r.doc_id), r.first_line, r.last_line, r.license) for r in scan(docs).collect())
    assert got == [("1", 1, 1, "MIT")] * 2 + [("2", 1, 3, "MIT"), ("6", 0, 0, "CC-BY-SA-4.0"), ("None", 0, 0, "CC-BY-4.0")]
    assert scan(docs.limit(0)).count() == 0
    assert [b[:2] for b in blocks_of("license\na\nlicense\nb\nc\nlicense")] == [(0, 2), (5, 5)]


def wrapped(wording, width, mark="", between="\n"):
    return between.join(textwrap.fill(p, width, initial_indent=mark, subsequent_indent=mark) for p in wording.split("\n"))


def test_wrapped_templates_are_found(spark):
    """Every template hard-wrapped, with prose around it, is one block of exactly its lines and its holder's."""
    rows, want = [], []
    for width in (72, 74, 76, 78, 80):
        for name, wording in TEMPLATES:
            for mark, between, holder in (("", "\n", ""), ("", "\n\n", "Copyright (c) 2021 Jane Doe\n\n"), ("# ", "\n#\n", "")):
                body = holder + wrapped(wording, width, mark, between)
                want.append((len(rows), 2, 2 + body.count("\n"), name, body))
                rows.append((len(rows), f"Some prose of the page\n\n{body}\n\nmore of the same prose\nand more"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id, r.first_line, r.last_line, r.license, r.block) for r in scan(docs).collect()) == want


def test_neighbouring_and_damaged_licenses():
    scanner, terms = Scanner(TEMPLATES), dict(TEMPLATES)
    two = wrapped(MIT_TERMS, 78) + "\n\n" + wrapped(terms["BSD-3-Clause"], 20) + "\n\n" + wrapped(MIT_TERMS, 72)
    assert [r[3][0] for r in scanner.blocks(two)] == ["MIT", "BSD-3-Clause", "MIT"]
    half = wrapped(MIT_TERMS[:300], 78)
    assert {r[3][0] for r in scanner.blocks(half)} == {None}
    both = half + "\n\n" + wrapped(MIT_TERMS, 78)
    assert [r[3][:2] for r in scanner.blocks(both)][-1] == ("MIT", True)
    assert scanner.blocks("a\nwe put this into the public\ndomain") == []
    many = "\n".join([*["word " * 9] * 3, *wrapped(MIT_TERMS, 78).split("\n")] * 40)
    assert [r[3][0] for r in scanner.blocks(many)] == ["MIT"] * 40


def turns(spark, talks):
    rows = [(i, k, role, text, "x") for i, talk in talks.items() for k, (role, text) in enumerate(talk)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, prompt string")


def test_pairs(spark):
    head = [("system", "be kind"), ("user", "héllo")]
    chosen = turns(spark, {1: [*head, ("assistant", "good"), ("user", "ok")], 2: head, 3: head, 4: [("user", None)]})
    rejected = turns(spark, {1: [*head, ("assistant", "bad")], 2: head, 3: [*head, ("assistant", "more")], 4: [(None, "")]})
    pairs = spark.createDataFrame([(i, i, i) for i in (1, 2, 3, 4, 9)], "pair_id long, chosen_id long, rejected_id long")
    got = {r.pair_id: r for r in preference.format_pairs(chosen, rejected, pairs).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    line = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got[1].prompt == line("system", "be kind") + line("user", "héllo") and got[1].prompt_turns == 2
    assert got[1].chosen == line("assistant", "good") + line("user", "ok") and got[1].rejected == line("assistant", "bad")
    assert [got[1].chosen[s.start:s.start + s.length] for s in got[1].chosen_spans] == ["good"]
    assert [got[1].rejected[s.start:s.start + s.length] for s in got[1].rejected_spans] == ["bad"]
    assert (got[2].chosen, got[2].rejected, got[2].distinct) == ("", "", False)
    assert (got[3].chosen, got[3].distinct) == ("", True) and got[3].rejected == line("assistant", "more")
    assert got[4].prompt == "" and got[4].prompt_turns == 0      # roles differ
    empty = preference.format_pairs(chosen.limit(0), rejected, pairs)
    assert empty.count() == 0


def test_swapped_replies(spark):
    talks = turns(spark, {0: [("user", "q"), ("assistant", "a0")], 1: [("user", "r"), ("assistant", "x"), ("assistant", "a1")],
                          2: [("user", "s"), ("assistant", "a2")], 3: [("user", "t")]})
    got = preference.with_swapped_reply(talks).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("l"))
    assert {r.conv_id: r.l.text for r in got.collect()} == {0: "a1", 1: "a0", 2: "", 3: "t"}
