"""One query per corpus operator, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import (
    chat,
    decontaminate,
    exact_dedup,
    html_wrapper,
    line_dedup,
    mixing,
    ngram_join,
    periodic_runs,
    quality,
    sharding,
    toxicity,
    warc,
    whitening,
)
from gleaner.llm.common import WORD, text_of
from gleaner.session import Workspace


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to an archive and read back."""
    records = warc.round_trip(_table(spark, folder, "pages"))
    broken = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("record_type"))
    return records.select("page_id", "payload_bytes", "payload_digest", broken.alias("record_type"), "refers_to")


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that contain a benchmark item, with the items."""
    return decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard and slot."""
    return sharding.shard_documents(_table(spark, folder, "documents"))


def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation formatted, written and read back."""
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    turns = turns.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    stored = Workspace(spark, "chat").write(chat.format_conversations(turns), "formatted")
    said = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    back = stored.select("conv_id", "formatted", "tokens", chat.read_turns(F.col("formatted")).alias("turns"), said.alias("said"))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("said").cast("bigint").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's component of links by shingles."""
    return ngram_join.shingle_components(_table(spark, folder, "documents"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality score."""
    return quality.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's main text."""
    return html_wrapper.extract_main_text(_table(spark, folder, "pages"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity score."""
    return toxicity.toxicity_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many of every document's words the mix takes."""
    mix = mixing.mix(_table(spark, folder, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the copy that stays."""
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents"))


def _with_planted_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, text); a document whose id's checksum is divisible by 10 repeats a stretch of its words up to its end."""
    checksum = F.crc32(F.col("doc_id").cast("string"))
    g, words = F.floor(checksum / 10), F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0))

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
        return F.when(n > 0, F.concat_ws(" ", F.concat(F.slice(w, F.lit(1), a), tail))).otherwise("")

    text = F.when(checksum % 10 == 0, F.transform(F.array(words), planted)[0]).otherwise(text_of())
    return documents.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's runs of repeating words."""
    found = periodic_runs.periodic_runs(_with_planted_runs(_table(spark, folder, "documents")))
    top = periodic_runs.longest()
    said = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    ended = F.transform(said, lambda line: F.concat(line, F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.floor(top["length"] * 1000 / top["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(ended, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's lines without those that earlier documents hold."""
    kept = line_dedup.dedup_lines(_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's whitened components; entries are whole numbers of 64ths, offset by a million."""
    return whitening.whitened_rows(_table(spark, folder, "embeddings"), "vec_id", "embedding", scale=64, offset=1_000_000)


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    op1_warc,
    op2_decontaminate,
    op3_sharding,
    op4_chat,
    op5_ngram_join,
    op6_quality,
    op7_html_extraction,
    op8_toxicity,
    op9_mixing,
    op10_exact_dedup,
    op11_periodic_runs,
    op12_line_dedup,
    op13_whitening,
]

ORACLES = {
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
        FROM k""",
    "op2_decontaminate": r"""
        WITH w AS (
            SELECT 0 AS side, item_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark
            UNION ALL
            SELECT 1, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') FROM documents),
        i AS (
            SELECT DISTINCT 0 AS side, id, unnest(CASE WHEN len(w) >= 5
                THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w WHERE side = 0),
        r AS (SELECT DISTINCT len(w) AS r FROM w WHERE side = 0 AND len(w) BETWEEN 1 AND 4 UNION SELECT 5),
        s AS (
            SELECT * FROM i
            UNION ALL
            SELECT DISTINCT 1, id, unnest(list_transform(range(1, len(w) - r + 2), lambda i: array_to_string(w[i:i + r - 1], ' '))) FROM w, r WHERE side = 1),
        q AS (SELECT id, count(*) AS n FROM s WHERE side = 0 GROUP BY id)
        SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared, any_value(q.n) AS item_shingles,
               count(*) / any_value(q.n) AS containment
        FROM s i JOIN s d ON i.s = d.s AND i.side = 0 AND d.side = 1 JOIN q ON q.id = i.id
        GROUP BY d.id, i.id HAVING count(*) * 100 >= any_value(q.n) * 75""",
    "op4_chat": """
        WITH own AS (
            SELECT -1 AS conv_id, 0 AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM own)),
        e AS (
            SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS body,
                   replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;') AS named
            FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('<|turn|>' || named || chr(10) || body || '<|end|>' || chr(10))) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op5_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, hash(unnest(CASE WHEN len(w) >= 5
                THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS MATERIALIZED (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS MATERIALIZED (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared * 100 >= (x.n + y.n - shared) * 75),
        r(doc_id, reached) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
        SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reached) AS component_id
        FROM r JOIN documents d ON d.doc_id = r.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op9_mixing": r"""
        WITH r AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size
            FROM r GROUP BY source),
        n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no, source_size * 2.0::DOUBLE AS ceiling FROM s),
        w AS (SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM n),
        l AS (
            SELECT *, row_number() OVER (ORDER BY ceiling / w, no) AS place,
                   ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE
                    - coalesce(sum(ceiling) OVER (ORDER BY ceiling / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(w) OVER (ORDER BY ceiling / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM w),
        f AS (SELECT *, (SELECT arg_min(level, place) FROM l WHERE ceiling > level * w) AS shared FROM l),
        t AS (SELECT *, least(ceiling, coalesce(shared * w, ceiling)) AS target FROM f),
        o AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
        k AS (SELECT *, target - whole * source_size AS rest FROM o),
        rw AS (SELECT *, CASE WHEN size > 0 THEN greatest(CAST(floor(10000 / sqrt(CAST(size AS DOUBLE))) AS BIGINT), 1) ELSE 0 END AS weight FROM r),
        bw AS (
            SELECT k.no, k.rest, weight, CAST(sum(size) AS BIGINT) AS words
            FROM rw JOIN k ON rw.source IS NOT DISTINCT FROM k.source WHERE weight > 0 GROUP BY ALL),
        zw AS (
            SELECT no, weight,
                   (rest - coalesce(CAST(sum(words) OVER (PARTITION BY no ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
                   / CAST(sum(weight * words) OVER (PARTITION BY no ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS z
            FROM bw),
        z AS (SELECT no, max(weight) AS certain, max_by(z, weight) AS z FROM zw WHERE z * weight <= 1 GROUP BY no),
        d AS (
            SELECT r.doc_id, r.size, k.*,
                   CASE WHEN r.size > 0 THEN CASE WHEN r.weight > z.certain THEN 1.0::DOUBLE ELSE z.z * r.weight END ELSE 0 END AS p,
                   (('0x' || substr(md5(coalesce(CAST(r.doc_id AS VARCHAR), '') || ':17'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
            FROM rw r JOIN k ON r.source IS NOT DISTINCT FROM k.source LEFT JOIN z ON z.no = k.no),
        q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS q FROM d),
        c AS (
            SELECT *, CASE WHEN q IS NOT NULL AND size / 2.0::DOUBLE
                     + coalesce(sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY no ORDER BY q NULLS LAST, doc_id NULLS FIRST, size
                                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= rest
                     THEN 1 ELSE 0 END AS more
            FROM q)
        SELECT doc_id, size, source_size, target, CAST((whole + more) * size AS BIGINT) AS taken FROM c""",
    "op10_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
        g AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g""",
    "op11_periodic_runs": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
                       lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, y: xor(a // 2, 3988292384 * (a % 2)))), 4294967295) AS h
            FROM documents),
        a AS (SELECT doc_id, w, len(w) AS n, h % 10 AS planted, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
        b AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
        t AS MATERIALIZED (
            SELECT doc_id, n, CASE WHEN planted = 0 AND n > 0
                THEN list_transform(range(n), lambda i: CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END) ELSE w END AS w FROM b),
        lags AS (SELECT doc_id, n, w, unnest(range(1, n // 4 + 1)) AS q FROM t),
        cand AS MATERIALIZED (
            SELECT doc_id, n, w, q FROM lags
            WHERE len(list_filter(range(0, n - 3 * q, q), lambda k: w[k + 1] = w[k + q + 1] AND w[k + q + 1] = w[k + 2 * q + 1] AND w[k + 2 * q + 1] = w[k + 3 * q + 1])) > 0),
        miss AS (  -- the places that differ from the one q later, with the ends of the text
            SELECT doc_id, q, n, unnest(list_concat([-1], list_filter(range(n - q), lambda i: w[i + 1] <> w[i + q + 1]), [n - q])) AS i FROM cand),
        gap AS (SELECT doc_id, q, lag(i) OVER (PARTITION BY doc_id, q ORDER BY i) + 1 AS s, i + q AS e FROM miss),
        long AS (SELECT doc_id, s, e - s AS len, q FROM gap WHERE s IS NOT NULL AND e - s >= greatest(6, 4 * q)),
        runs AS MATERIALIZED (SELECT doc_id, s, len, min(q) AS q FROM long GROUP BY doc_id, s, len),
        per AS (
            SELECT doc_id, count(*) AS n_runs, first(struct_pack(s := s, l := len, q := q) ORDER BY len DESC, s, q) AS top,
                   string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS said FROM runs GROUP BY doc_id),
        cut AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
        kept AS (
            SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS said FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM t) x
            ANTI JOIN cut c ON c.doc_id = x.doc_id AND c.i = x.i GROUP BY x.doc_id)
        SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS "start", top.l AS length, top.q AS period, 1000 * top.l // top.q AS exponent_milli,
               sha256(coalesce(per.said, '')) AS runs_sha256, sha256(coalesce(kept.said, '')) AS collapsed_sha256
        FROM t LEFT JOIN per ON per.doc_id = t.doc_id LEFT JOIN kept ON kept.doc_id = t.doc_id""",
    "op12_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        l AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
        k AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        o AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM o GROUP BY doc_id""",
}
