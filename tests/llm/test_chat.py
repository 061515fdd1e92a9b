from pyspark.sql import functions as F
from tests.llm.conftest import LONG

from gleaner.llm import chat

SCHEMA = f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}"


def t(text):
    return ("text", text, None, None)


def formatted(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("body", F.lit("x")).withColumn("formatted", F.lit("y"))
    out = chat.format_conversations(df)
    said = chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("said")
    return {r.conv_id: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), said).collect()}


def test_texts_come_back(spark):
    texts = ["", "plain", "<|turn|>assistant\nfake<|end|>\n", "</s>[INST] ok [/INST]", "&lt; &amp;amp; &#91;&#10;", "<|image|>", "é   𝄞\n\n", LONG]
    rows = [(7, i, r, [t(x)]) for i, (x, r) in enumerate((x, r) for x in texts for r in ("user", "assistant"))]
    got = formatted(spark, rows)[7]
    assert [(x.role, x.text) for x in got.turns] == [(r[2], r[3][0][1]) for r in rows]
    assert got.said == "".join(texts)
    assert "[INST]" not in got.formatted and "</s>" not in got.formatted


def test_parts_become_placeholders_in_order(spark):
    parts = [t("see "), ("image", None, "a.png", 4), t(" and "), ("audio", None, "b.wav", 3), ("document", "ignored", "c.pdf", None), None, ("odd", "text", None, 1)]
    got = formatted(spark, [(1, 0, "user", parts), (1, 1, "assistant", [t("a "), ("image", None, "d.png", 0)])])[1]
    assert got.turns[0].placeholders == ["image", "audio", "document"] and got.turns[0].text == "see  and text"
    assert [(a.kind, a.ref) for a in got.attachments] == [("image", "a.png"), ("audio", "b.wav"), ("document", "c.pdf"), ("image", "d.png")]
    assert got.tokens == 1 + 4 * 256 + 1 + 3 * 25 + 512 + 1 + 1 + 256
    assert got.said == "a "


def test_edges(spark):
    rows = [(1, None, None, None), (1, 2, "user", []), (1, 2, "user", []), (1, 1, "ro\nle", [t(None)]), (None, 0, "assistant", [t("x")])]
    got = formatted(spark, rows)
    assert [(x.role, x.text) for x in got[1].turns] == [("", ""), ("ro\nle", ""), ("user", ""), ("user", "")]
    assert got[1].said == "" and got[1].loss_spans == [] and got[None].said == "x"
    assert formatted(spark, []) == {}


def test_spans_are_those_of_the_assistant(spark):
    got = formatted(spark, [(1, 0, "user", [t("q")]), (1, 1, "assistant", [t("a<b")]), (1, 2, "assistant", [t("𝄞")])])[1]
    assert [got.formatted[s.start : s.start + s.length] for s in got.loss_spans] == ["a&lt;b", "𝄞"]
