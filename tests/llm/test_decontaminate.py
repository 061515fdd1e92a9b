import random
import re

from tests.llm.conftest import LONG

from gleaner.llm import decontaminate


def sets(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} - {""}


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    out = []
    for d, t in docs:
        w = words(t)
        for i, q in items:
            a, b = sets(t), sets(q)
            if (m := len(words(q))) < 5:  # a short item is looked for as a run of its own length
                a = {" ".join(w[k : k + m]) for k in range(len(w) - m + 1)}
            if b and 100 * len(a & b) >= 75 * len(b):
                out.append((d, i, len(a & b), len(b)))
    return sorted(out, key=str)


def result(spark, make, docs, items):
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(make(docs, extra=True), frame).collect()
    assert all(r.containment == r.shared / r.item_shingles for r in got)
    return sorted(((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got), key=str)


def test_against_brute_force(spark, make):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 9, 20, 60])))) for i in range(60)]
    docs = []
    for d in range(200):
        words = rng.choices(vocabulary, k=rng.choice([2, 30, 300, 3000]))
        for _ in range(rng.randrange(3)):
            passage = items[rng.randrange(60)][1].split()
            for k in range(len(passage)):
                if rng.random() < rng.choice([0, 0.03, 0.1]):
                    passage[k] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = passage
        docs.append((d, " ".join(words)))
    want = brute(docs, items)
    assert len(want) > 40 and result(spark, make, docs, items) == want


def test_case_and_punctuation_do_not_count(spark, make):
    assert result(spark, make, [(1, "So: ONE, two. three\nfour (five) six!")], [(7, "one two three four five six")]) == [(1, 7, 2, 2)]


def test_edges(spark, make):
    item = "one two three four five six seven"
    docs = [(1, None), (2, ""), (3, "..."), (None, item), (4, item), (4, item), (4, "else"), (5, LONG + " " + item), (6, "short one")]
    items = [(1, item), (2, None), (3, ""), (4, "short one"), (None, item)]
    want = [(4, 1, 3, 3), (4, None, 3, 3), (5, 1, 3, 3), (5, None, 3, 3), (6, 4, 1, 1), (None, 1, 3, 3), (None, None, 3, 3)]
    assert result(spark, make, docs, items) == sorted(want, key=str)
    assert result(spark, make, [], items) == [] and result(spark, make, docs, []) == []


def test_clean_documents_stay(spark, make):
    item = "one two three four five six seven"
    docs = make([(1, item), (2, "clean"), (3, None)], extra=True)
    out = decontaminate.clean_documents(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]


def test_short_items_are_found_inside_long_documents(spark, make):
    items = [(1, "Capital of France"), (2, "word77 word78"), (3, "word9999"), (4, "a b c d"), (5, "of France Paris is the")]
    docs = [(1, "What is the capital of France? Paris is the capital."), (2, LONG), (3, "capital of"), (4, "capital of, france"), (5, "b a b c d")]
    want = [(1, 1, 1, 1), (1, 5, 1, 1), (2, 2, 1, 1), (2, 3, 1, 1), (4, 1, 1, 1), (5, 4, 1, 1)]
    assert brute(docs, items) == want and result(spark, make, docs, items) == want


def test_an_item_of_several_rows_may_be_short_and_long(spark, make):
    items = [(1, "one two"), (1, "a b c d e"), (1, "three")]
    docs = [(1, "x one two x three"), (2, "x one two three a b c d e"), (3, "one two")]
    assert result(spark, make, docs, items) == [(2, 1, 3, 3)]
