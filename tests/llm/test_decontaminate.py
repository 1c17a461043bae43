from __future__ import annotations

import re

from rallypoint.llm import decontaminate as d
from rallypoint.llm.queries import ORACLES, QUERIES
from tests.compare import same_rows
from tests.llm.helpers import no_documents, odd_documents

QUESTION = "A baker in the village sells 12 loaves to his neighbour Anna and then gives Anna another 5 loaves before he walks 3 km home"
OTHER = "Every train that leaves the station carries several hundred people towards the old harbour in the evening"


def setup(spark, docs, items):
    return (
        spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"),
        spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"),
    )


def leaks(spark, docs, items):
    return {(r["doc_id"], r["item_id"]) for r in d.find_leaks(*setup(spark, docs, items)).collect()}


def test_copies_and_new_parameters(spark):
    changed = QUESTION.replace("12", "40").replace("5", "7").replace("3 km", "9 miles").replace("Anna", "Maria")
    torn = "A baker in the village sells 12 loaves to his neighbour Anna and then gives Maria another 5 loaves before he walks 3 km home"
    docs = [f"some words before {QUESTION} and some after", changed, torn, OTHER, f"x {OTHER} y. {QUESTION.upper()}", "", None]
    assert leaks(spark, docs, [QUESTION, OTHER, None, ""]) == {(0, 0), (1, 0), (3, 1), (4, 1), (4, 0)}


LONG = "Tom buys 1,250 red and 300 blue pencils for the school of the town. Tom hands 2.5 boxes to Dr Green, who counts 7 of them (Ann helps) and asks how many boxes are left over"


def other_values(text):
    for a, b in (("Tom", "Zoe"), ("1,250", "96"), ("300", "4,100.5"), ("2.5", "11"), ("Green", "Ibsen"), ("Ann", "Per"), ("7 of", "83 of")):
        text = text.replace(a, b)
    return text


def test_new_values_in_every_place(spark):
    """Numbers with separators, names that begin a sentence or follow brackets, digits, wraps and quotes, and other case."""
    new = other_values(LONG)
    docs = [new, new.replace(" ", "\n"), new.replace(" ", "  \t"), f'He said: "{new}"', LONG.title(), LONG.lower(), LONG.upper(), new.replace("Dr", "\u201cDr"), OTHER]
    assert leaks(spark, docs, [LONG, OTHER]) == {(i, 0) for i in range(8)} | {(8, 1)}
    assert leaks(spark, [new.replace("Zoe hands", "Tom hands")], [LONG]) == set()


def test_part_of_an_item_is_no_leak(spark):
    half = " ".join(QUESTION.split()[:12])
    assert leaks(spark, [half, "the of and a in to", "of"], [QUESTION, "of", "of the"]) == {(2, 1)}


def test_short_item_needs_the_whole_text(spark):
    assert leaks(spark, ["of the", "all of the rest", "Of, the!"], ["of the"]) == {(0, 0), (2, 0)}


def test_numbers_alone_keep_their_own_windows(spark):
    assert leaks(spark, ["1 2 3 4 5 6 7", "9 8 7 6 5 4 3"], ["1 2 3 4 5 6 7"]) == {(0, 0)}


def test_query_finds_every_whole_copy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    items = spark.read.parquet(f"{small}/benchmark.parquet").collect()
    clean = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    want = {(a["doc_id"], b["item_id"]) for a in docs for b in items if len(clean(b["text"]).split()) > 8 and clean(b["text"]) in clean(a["text"])}
    found = QUERIES["op10_template_windows"](spark, small).collect()
    members = {r["item_id"]: r["class_item_id"] for r in found if r["doc_id"] is None}
    want = {(a, members.get(b, b)) for a, b in want}
    got = {(r["doc_id"], r["item_id"]) for r in found if r["doc_id"] is not None}
    assert want <= got and len(got) <= len(want) + len(docs) // 50


def test_query_equals_sql(spark, duck, small):
    same_rows(QUERIES["op10_template_windows"](spark, small), duck.sql(ORACLES["op10_template_windows"]))


def test_sql_on_hand_built_cases(spark):
    import duckdb

    changed = QUESTION.replace("12", "40").replace("Anna", "Maria")
    docs, items = [f"some words before {QUESTION} and", changed, QUESTION.upper(), "of", "1 2 3 4 5 6", None], [QUESTION, OTHER, "of", "", "1 2 3 4 5 6", LONG, other_values(LONG), QUESTION, QUESTION.replace("Anna an", "Eva an"), "OF"]
    docs += [QUESTION.replace("Anna an", "Eva an").lower(), QUESTION.lower(), LONG.title(), other_values(LONG).replace(" ", "\n"), "a@B 1,2,3,4 x.5 6.y 7 Km", "Of"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(docs)))
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", list(enumerate(items)))
    same_rows(d.leaks_and_members(*setup(spark, docs, items)), con.sql(ORACLES["op10_template_windows"]))


def test_odd_rows(spark):
    docs, items = odd_documents(spark), setup(spark, [], [QUESTION, "a b c", None])[1]
    out = d.drop_leaks(docs, items)
    assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
    assert out.where("text = 'a b c'").count() == 0 and out.count() == docs.where("NOT text <=> 'a b c'").count()
    assert d.drop_leaks(no_documents(spark), items).count() == 0
    assert d.drop_leaks(docs, items.limit(0)).count() == docs.count()


def test_main_path_has_no_python(spark):
    docs, items = setup(spark, [QUESTION], [QUESTION])
    for df in (d.find_leaks(docs, items), d.drop_leaks(docs, items)):
        assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def one_template(i, j):
    return f"A farmer in the valley takes {i + 10} sheep to the market of Town{i}x and then sells {j + 3} of them before he walks {i * j + 2} km home to {('Anna', 'Berta', 'Cora')[i % 3]}"


def test_items_of_one_template_are_one_class(spark):
    """200 items and 200 documents of one template: rows in proportion to their sum, and every document caught."""
    docs, items = [one_template(i, 7) for i in range(200)], [one_template(i, 5) for i in range(300, 500)]
    found = d.leaks_and_members(*setup(spark, docs, items)).collect()
    assert len(found) == 200 + 199
    assert {r.doc_id for r in found if r.doc_id is not None} == set(range(200)) and {r.item_id for r in found if r.doc_id is not None} == {0}
    assert {(r.item_id, r.class_item_id) for r in found if r.doc_id is None} == {(i, 0) for i in range(1, 200)}
    lower = d.leaks_and_members(*setup(spark, [items[7].lower(), items[8].upper()], items)).where("doc_id IS NOT NULL").collect()
    assert {(r.doc_id, r.class_item_id) for r in lower} == {(0, 0), (1, 0)}


def test_equal_values_in_other_places_are_another_class(spark):
    items = ["Sam gives 5 pears to the man and keeps 5 pears at the old house", "Sam gives 4 pears to the man and keeps 9 pears at the old house", "Sam gives 8 pears to the man and keeps 8 pears at the old house"]
    docs = ["Sam gives 6 pears to the man and keeps 7 pears at the old house", "Sam gives 2 pears to the man and keeps 2 pears at the old house"]
    found = d.leaks_and_members(*setup(spark, docs, items)).collect()
    assert {(r.item_id, r.class_item_id) for r in found if r.doc_id is None} == {(2, 0)}
    assert {(r.doc_id, r.item_id) for r in found if r.doc_id is not None} == {(0, 1), (1, 0), (1, 1)}


def test_names_alone_in_other_case(spark):
    """An item that its class's least item doesn't stand for: a lower-case copy, full of names, of another member."""
    items = ["Anna met Bob and Cora saw Dan then Eve told Finn of Gus", "Hans met Ida and Jon saw Kim then Lea told Max of Nora"]
    found = d.leaks_and_members(*setup(spark, [items[1].lower(), items[0], items[1]], items)).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.doc_id is not None} == {(0, 1), (1, 0), (2, 0)}
    assert {(r.item_id, r.class_item_id) for r in found if r.doc_id is None} == {(1, 0)} and {r.class_item_id for r in found} == {0}
