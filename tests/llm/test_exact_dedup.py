import random
from collections import defaultdict
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import LONG

from gleaner.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in exact_dedup.exact_duplicates(df).collect()), key=str)


def test_against_brute_force(make):
    rows = [(1, "a b"), (2, "a b"), (3, "a b "), (4, None), (5, ""), (6, "A b"), (7, LONG), (8, LONG), (9, LONG + "!"), (None, "x"), (None, "a b")]
    rows += [(20, "twice"), (20, "twice"), (20, "other")] + [(100 + i, "hot text. " * 400) for i in range(300)]
    assert result(make(rows, extra=True)) == brute(rows)


def test_empty_table(make):
    assert result(make([])) == []


def cut(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return [r[0] for r in df.select(exact_dedup.chunks(F.col("text"))).collect()]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ",", "."]) for _ in range(n))


def test_chunks_make_up_the_text(spark):
    rng = random.Random(1)
    texts = ["", "x", " ", "no end " * 2000, "One. Two!\nThree? " * 900, "é" * 5000, LONG, "".join(rng.choice("acgt") for _ in range(20_000)), "中文字。" * 500]
    texts += [prose(2, 3000), "\U0001f600" * 300 + "\n" * 300]
    for text, parts in zip(texts, cut(spark, texts)):
        assert "".join(parts) == text and "" not in parts


@pytest.mark.parametrize("kind", ["prose", "without blanks", "one line"])
def test_texts_that_differ_in_one_place_share_the_other_chunks(spark, kind):
    text = prose(3, 24_000)
    text = {"prose": text, "without blanks": "".join(c for c in text if c.isalpha()), "one line": text.replace(".", "").replace(",", "")}[kind]
    half = len(text) // 2
    a, b, c = cut(spark, [text, "inserted at the start " + text, text[:half] + "X" + text[half:]])
    assert len(a) > 15
    assert len(set(a) - set(b)) <= 3 and len(set(a) - set(c)) <= 3
    assert max(map(len, a)) < 40 * len(text) / len(a)


def test_recipes_decide_not_checksums(make, monkeypatch):
    text = prose(4, 3000)
    rows = [(1, text), (2, text), (3, text[:-1] + "!"), (4, "other"), (5, "x" + text), (6, text[:9000] + "y" + text[9001:]), (7, None), (8, "other"), (9, "single")]
    monkeypatch.setattr(exact_dedup, "checksum", lambda text: F.lit(7).cast("bigint"))  # now every row may have a copy
    assert result(make(rows)) == brute(rows)
    monkeypatch.setattr(exact_dedup, "identifier", lambda chunk: F.hex(F.length(chunk) % 3))  # and identifiers stand for many chunks
    assert result(make(rows)) == brute(rows)


def test_ambiguous_identifiers_are_found(spark, monkeypatch):
    df = spark.createDataFrame([("ab",), ("cd",), ("ab",), ("e",)], "chunk string")
    assert exact_dedup.ambiguous_identifiers(df) == []
    monkeypatch.setattr(exact_dedup, "identifier", lambda chunk: F.length(chunk).cast("string"))
    assert exact_dedup.ambiguous_identifiers(df) == ["2"]


def test_ambiguous_identifiers_hold_the_chunk(spark):
    df = spark.createDataFrame([(1, ["a", "b"])], "doc_id bigint, chunks array<string>")
    (row,) = exact_dedup.recipes(df, [md5(b"a").hexdigest()]).collect()
    assert row.recipe == [md5(b"a").hexdigest() + "a", md5(b"b").hexdigest()]


def test_without_broadcast(make, monkeypatch):
    from gleaner.llm import common

    monkeypatch.setattr(common, "LIGHT_ROWS", 0)
    rows = [(i % 7, f"text {i % 5}") for i in range(60)] + [(None, "text 1")]
    assert result(make(rows)) == brute(rows)
