import plain
from wardlog.llm.decontamination import contaminated, occurrences, remove_contaminated

ITEM = ("A train leaves the old station with 120 people and after 3 hours of travel Anna counts 45 of them, "
        "so how many people did Anna lose on the way?")
OTHER = ("A train leaves the old station with 77 people and after 9 minutes of travel Maria counts 12 of them, "
         "so how many people did Maria lose on the way?")
MIXED = OTHER.replace("did Maria", "did Peter")
ITEMS = [(1, ITEM), (2, "what is the tallest hill here"), (3, "too short"), (4, None), (5, ""), (5, ITEM)]


def tables(spark, rows, items=ITEMS):
    return (spark.createDataFrame(rows, "doc_id bigint, text string, item_id string, h string"),
            spark.createDataFrame(items, "item_id bigint, text string"))


def test_finds_copies_and_new_parameters_but_not_inconsistent_ones(spark):
    docs, items = tables(spark, [
        (1, f"Before it. {ITEM} After it.", "x", "x"), (2, OTHER, "x", "x"), (3, MIXED, "x", "x"),
        (4, ITEM.upper().replace("ANNA", "Anna").replace("A TRAIN", "A train"), "x", "x"),
        (5, "something else entirely that has nothing to do with trains or people at all in it", "x", "x"),
        (6, "ask: what is the tallest hill here?", "x", "x"), (7, "too short", "x", "x"), (8, None, "x", "x"), (9, "", "x", "x")])
    got = {(r.doc_id, r.item_id): r for r in occurrences(docs, items).collect()}
    assert {(1, 1), (1, 5), (2, 1), (2, 5), (6, 2)} <= set(got)
    assert {d for d, _ in got} <= {1, 2, 3, 4, 6}
    assert got[1, 1].changed_slots == 0 and got[2, 1].changed_slots >= 4
    # the part of the mixed text after the exchanged name is too short to count with it
    assert (3, 1) not in got or got[3, 1].covered < got[2, 1].covered


def test_rows_keep_their_columns_and_repeat(spark):
    rows = [(1, ITEM, "x", "h"), (1, ITEM, "x", "h"), (None, ITEM, "y", "h"), (None, "clean", "y", "h"), (2, "clean", None, None)]
    docs, items = tables(spark, rows)
    assert [(r.doc_id, r["items"]) for r in contaminated(docs, items).orderBy("doc_id").collect()] == [(None, [1, 5]), (1, [1, 5])]
    left = remove_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == ["clean", "clean"]
    for a, b in ((docs.limit(0), items), (docs, items.limit(0))):
        assert contaminated(a, b).count() == 0 and remove_contaminated(a, b).count() == a.count()


def test_long_text_and_private_characters(spark):
    long = "filler words go on and on " * 20_000 + ITEM
    docs, items = tables(spark, [(1, long, "x", "x"), (2, "\ue000 \ue001 " + ITEM, "x", "x")])
    assert {r.doc_id for r in contaminated(docs, items).collect()} == {1, 2}


def test_short_items_are_found_behind_anything(spark):
    """An item's first token is a slot or not by what stands before it."""
    items = [(1, "What is the tallest hill"), (2, "Which of these old rivers is the longest one in the whole wide land"),
             (3, "Seconds are what we measure with a watch"), (4, "second laws are what we ask about here")]
    befores = ["", "Question: ", "3) ", "\"", "as asked \u2013 ", "Here it is. ", "x\n", "three "]
    rows = [(10 * k + i, f"{before}{text}, they said", "x", "x") for k, before in enumerate(befores) for i, text in items]
    others = ["Question: Where is the tallest hill", "3) Whose is the tallest hill", "5 hours are what we measure with a watch"]
    docs, table = tables(spark, rows + [(1000 + k, t, "x", "x") for k, t in enumerate(others)], items)
    got = {(r.doc_id, r.item_id): r.changed_slots for r in occurrences(docs, table).collect()}
    assert got == {(10 * k + i, i): 0 for k in range(len(befores)) for i, _ in items}


def test_items_of_numbers_and_very_short_ones_are_found(spark):
    """Few plain words suffice where the item has no more; what has no template is found by its exact tokens."""
    items = [(1, "What is 15 percent of 80?"), (2, "Solve 3x + 5 = 20 for x"), (3, "What is 7x8?"), (4, "Name three primes"),
             (5, "12 15 18 21 24 27 30 33 36"), (6, "Add 13, 15, 18, 21, 24, 27, 30, 33, 36, 39, 42, 45 and 48 up")]
    befores = ["", "Question: ", "3) "]
    rows = [(10 * k + i, f"{before}{text}\nAnswer it.", "x", "x") for k, before in enumerate(befores) for i, text in items]
    others = ["What is 20 percent of 50?", "What is 7x9?", "12 15 18 21 24 27 30 33 37", "1 2 3 4 5 6 7 8 9 10 11 12 13",
              "Add 13, 15, 18, 21, 24, 27, 30, 33, 36, 39, 42, 45 and 49 up", "Name of three primes"]
    docs, table = tables(spark, rows + [(1000 + k, t, "x", "x") for k, t in enumerate(others)], items)
    got = {(r.doc_id, r.item_id): r.changed_slots for r in occurrences(docs, table).collect()}
    assert got.pop((1000, 1)) == 2 and got.pop((1001, 3)) == 1
    assert got == {(10 * k + i, i): 0 for k in range(len(befores)) for i, _ in items}


def test_consistent_runs_count(spark):
    """One edited value leaves the rest of a copy, and two values may become one."""
    start = "when Anna came back into the old town by the river she had lost 12 of her best coins"
    end = "and so the people there gave Anna all of the bread that they had left for the winter"
    twice = "the old man took 12 apples and 15 pears from the wide field behind his house"
    items = [(1, f"{start} {end}"), (2, twice)]
    texts = {1: f"{start} {end}", 2: f"{start} {end.replace('Anna', 'Maria')}", 3: f"{start.replace('Anna', 'Maria')} {end}",
             4: twice.replace("12", "9").replace("15", "9"), 5: "when Anna came and so they gave Maria bread"}
    short = "he says 12 and then 12 and now 12 are left"
    docs, table = tables(spark, [(k, f"then {t} again", "x", "x") for k, t in texts.items()]
                         + [(6, short.replace("now 12", "now 13"), "x", "x"), (7, short.replace("12", "13"), "x", "x")],
                         [*items, (3, short)])
    got = {(r.doc_id, r.item_id): (r.covered, r.changed_slots) for r in occurrences(docs, table).collect()}
    whole = len(f"{start} {end}".split())
    assert got == {(1, 1): (whole, 0), (2, 1): (whole - 2, 0), (3, 1): (whole - 2, 0), (4, 2): (len(twice.split()), 2), (7, 3): (11, 1)}


def test_table_agrees_with_whole_items(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    texts, wanted = docs.collect(), [r.text for r in items.collect()]
    want = {r.doc_id for r in texts if any(plain.holds_whole(r.text, w) for w in wanted)}
    assert {r.doc_id for r in contaminated(docs, items).collect()} == want and want
