"""One query per operator over the given tables. Each takes (session, folder) and returns a DataFrame."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.functions.descriptors import MOLECULE_DESCRIPTORS, with_descriptors, with_smiles_descriptors
from gleaner.functions.names import file_stem
from gleaner.functions.records import drop_tag, first_line, lines, set_tag, to_sdf
from gleaner.functions.scores import parse_score, score_or_sentinel
from gleaner.functions.signatures import explode_signatures, ngram_bytes, ngrams_once, with_atom_signatures, with_ngrams
from gleaner.functions.staging import staged
from gleaner.functions.vectors import from_dense, parse_vector, sparse, vector_text
from gleaner.operators import conformal, labels, learner, overlap, sampling, scorers, sets, topn, universe
from gleaner.operators import rules as rule_ops
from gleaner.plans import recipes
from gleaner.plans import stand_in as S
from gleaner.plans.screen import ScreenParams, ScreenResult, screen
from gleaner.session import Workspace
from gleaner.sources import models, sdf, sinks, smiles
from gleaner.sources import rules as rule_files

SEED = 11
TARGET = "/data/targets/protein_a.bin"
CODE = "1abc"

MOTIFS = {
    "peroxide": "OO",
    "phosphorane": "C=P",
    "carbodiimide": "N=C=N",
    "iso_thio_cyanate": "N=C=[S,O]",
    "thiocyanate": "SC#N",
    "p_s_halide": "[P,S][Cl,Br,F,I]",
    "n_o_s": "[#7,#8,#16]",
    "unsaturated": "[C,N]=C[C,O]",
}

RULE_TEXT = """
# limits that the derived molecules break often enough to be worth checking
MIN_MOLWT 180 "Minimum molecular weight"
MAX_MOLWT 380 "Maximum molecular weight"
MAX_NUM_HVY 21 "Maximum number of heavy atoms"
MIN_CARBONS 4 "Minimum number of carbons"
MAX_Het_C_Ratio 2.0 "Maximum ratio"
MAX_SSSR_RINGS 1 "Maximum number of rings"
MAX_HBOND_DONORS 3 "Maximum number of donors"
MAX_SUM_FORMAL_CRG 1 "Maximum sum of formal charges"
MAX_XLOGP 6.0 "not evaluated: no such column"
ALLOWED_ELEMENTS C,N,O,S,P,F,Cl,H
ELIMINATE_METALS Fe,Co,Ni
NEWRULE N_O_S 9 [#7,#8,#16]
NEWRULE P_S_halide 1 [P,S][Cl,Br,F,I]
RULE 0 peroxide
RULE 0 phosphoranes
"""

SMILES_RULES = """
MAX_NUM_HVY 22 "Maximum number of heavy atoms"
MIN_CARBONS 6 "Minimum number of carbons"
MAX_COUNT_FORMAL_CRG 3 "Maximum number of charges"
ALLOWED_ELEMENTS C,N,O,S,P,Cl,Br
"""


# --- poses: events, id = user, key = event, score = value, error events have failed -------------------------------


def _poses(spark: SparkSession, d: str) -> DataFrame:
    events = S.table(spark, d, "events")
    score = F.when(F.col("event_type") != "error", F.col("value"))
    return events.select(F.col("event_id").alias("row_key"), F.col("user_id").alias("mol_id"), score.alias("score"))


def top_n_poses(spark, d):
    return topn.top_n(_poses(spark, d), 30)


def top_n_lowest(spark, d):
    return topn.top_n(_poses(spark, d), 30, ascending=True, drop_failed=True)


def top_n_payload(spark, d):
    hits = topn.top_n(_poses(spark, d), 30)
    events = S.table(spark, d, "events").select(F.col("event_id").alias("row_key"), "event_type", "props")
    return topn.attach_payload(hits, events)


def best_pose_per_id(spark, d):
    return topn.best_per_id(_poses(spark, d))


def collapse_best_2(spark, d):
    out = topn.collapse(_poses(spark, d), 2)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


def sorted_first_100(spark, d):
    return topn.first_n(topn.sort_by_score(_poses(spark, d)), 100)


def sort_by_score(spark, d):
    return topn.sort_by_score(_poses(spark, d)).withColumn("score", score_or_sentinel(F.col("score")))


def top_n_long(spark, d):
    """The 20,000 best orders by price: a list too long for one task."""
    orders = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_key"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("score"))
    return topn.top_n(orders.withColumn("mol_id", F.col("row_key")), 20_000).select("mol_id", "score")


def select_best_third(spark, d):
    """The best third of all events by value, which often repeats; narrowed further than its size asks for."""
    poses = _poses(spark, d)
    return topn.select_best(poses, poses.count() // 3, bucket_rows=20)


def collapse_best_50(spark, d):
    """The best 50 events of every user, through salted users."""
    out = topn.collapse(_poses(spark, d), 50)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


def score_parse(spark, d):
    """Scores written as data items, failed ones in every way they can be, and read back."""
    text = (
        F.when(F.col("event_type") == "error", F.lit("340282346638528859811704183484516925440.000000"))
        .when(F.col("event_type") == "signup", F.lit(""))
        .when((F.col("event_type") == "view") & (F.col("user_id") % 3 == 0), F.lit("not a number"))
        .when((F.col("event_type") == "view") & (F.col("user_id") % 3 == 1), F.lit("NaN"))
        .otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    )
    tags = F.create_map(
        F.when(F.col("event_type") == "purchase", F.lit("PLP")).otherwise(F.lit("Chemgauss4")), text
    )
    events = S.table(spark, d, "events")
    score = parse_score(tags, "Chemgauss4")
    return events.select("event_id", "user_id", score.alias("score"), score_or_sentinel(score).alias("stored_score"))


def top_semi_join(spark, d):
    poses = _poses(spark, d)
    return topn.semi_join_top(poses, topn.top_n(poses, 30))


def pool_minus_scored(spark, d):
    """Events of users without an event of a value of 250 or more, of which a user may have several; a user's events all stay."""
    pool = S.table(spark, d, "events").withColumnRenamed("user_id", "row_key")
    scored = pool.filter(F.col("value") >= 250).select("row_key")
    return sets.minus(pool, scored).select("row_key", "event_id", "event_type", "value")


def union_sources(spark, d):
    lines = S.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("row_key"), F.col("l_partkey").alias("mol_id"), F.col("l_extendedprice").alias("score"), "l_returnflag"
    )
    flag = F.col("l_returnflag")
    known = ("A", "N", "R")
    parts = [lines.filter(flag == f) for f in known] + [lines.filter(~flag.isin(*known)), lines.filter(flag.isNull())]
    return schemas.union_stage(parts, "pose")


def hit_overlap(spark, d):
    """Top 1000 parts by quantity against the top 1000 by revenue; parts named by brand, so ids repeat."""
    lines = S.table(spark, d, "lineitem")
    by = lines.groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("q"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("r")
    )
    brand = S.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("mol_id"))
    top = lambda c: by.orderBy(F.desc(c), "l_partkey").limit(1000).join(brand, "l_partkey").select("mol_id")
    return overlap.hit_overlap(top("q"), top("r"), 1000).withColumn("percent", F.round("percent", 6))


# --- samples and splits -------------------------------------------------------------------------------------------


def exact_sample(spark, d):
    return sampling.exact_sample(S.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id", 100, SEED)


def exact_sample_large(spark, d):
    """A third of all orders, with the ranges of hashes narrowed further than their size asks for."""
    orders = S.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    n = orders.count() // 3
    return sampling.exact_sample(orders, "o_orderkey", n, 1234, bucket_rows=50)


def exact_sample_copies(spark, d):
    """A third of the line items by their order, a key that repeats; how many rows of each order."""
    lines = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return sampling.exact_sample(lines, "l_orderkey", lines.count() // 3, 1234).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


def fraction_sample(spark, d):
    return sampling.fraction_sample(S.table(spark, d, "documents").select("doc_id", "source"), "doc_id", 0.25, SEED)


def split_proper_calibration(spark, d):
    return sampling.with_split(S.table(spark, d, "labels"), "doc_id", 0.3, SEED)


def split_stratified(spark, d):
    return sampling.with_stratified_split(S.table(spark, d, "labels"), "doc_id", "quality", 0.3, SEED)


# --- bins and labels ----------------------------------------------------------------------------------------------


def score_histogram(spark, d):
    out = labels.score_histogram(_poses(spark, d))
    return out.select(F.col("bin").cast("bigint").alias("bin"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


def label_extremes(spark, d):
    return labels.label_extremes(_poses(spark, d), 1, 4)


# --- SDF and line notation ----------------------------------------------------------------------------------------


def _records(spark: SparkSession, d: str) -> DataFrame:
    return sdf.explode_records(S.sdf_chunks(spark, d), "chunk")


def _molecules_from_text(spark: SparkSession, d: str, *wanted: str) -> DataFrame:
    """The records with the ``wanted`` columns; with their score where ``tags`` and ``parse_ok`` are among these."""
    parsed = sdf.parse_molecules(_records(spark, d), wanted)
    return sdf.with_score(parsed, "Chemgauss4") if {"tags", "parse_ok"} <= set(wanted) else parsed


def sdf_split(spark, d):
    raw = F.col("raw")
    return _records(spark, d).select(
        "o_orderkey", first_line(raw).alias("mol_id"), F.size(lines(raw)).cast("bigint").alias("n_lines")
    )


def sdf_tags(spark, d):
    tags = F.col("tags")
    return _molecules_from_text(spark, d, "mol_id", "parse_ok", "tags").select(
        "mol_id",
        "parse_ok",
        F.size(tags).cast("bigint").alias("n_tags"),
        F.try_element_at(tags, F.lit("Chemgauss4")).alias("score_text"),
        F.try_element_at(tags, F.lit("Priority")).alias("priority"),
        "score",
    )


def sdf_atoms(spark, d):
    parsed = _molecules_from_text(spark, d, "mol_id", "header", "atoms")
    atoms = F.col("atoms")
    texts = lambda f: F.array_join(F.transform(atoms, f), ",")
    total = lambda field: F.aggregate(atoms, F.lit(0.0), lambda t, a: t + a[field])
    return parsed.select(
        "mol_id",
        "header",
        F.size(atoms).cast("bigint").alias("n_atoms"),
        texts(lambda a: a["element"]).alias("elements"),
        texts(lambda a: a["charge"].cast("string")).alias("charges"),
        texts(lambda a: a["parity"].cast("string")).alias("parities"),
        F.round(total("x"), 4).alias("sum_x"),
        F.round(total("y"), 4).alias("sum_y"),
    )


def sdf_bonds(spark, d):
    text = F.transform("bonds", lambda b: F.concat_ws("-", b["a"].cast("string"), b["b"].cast("string"), b["ord"].cast("string")))
    return _molecules_from_text(spark, d, "mol_id", "bonds").select(
        "mol_id", F.size("bonds").cast("bigint").alias("n_bonds"), F.array_join(text, ",").alias("bond_text")
    )


def sdf_write_tag(spark, d):
    """Adds one data item, drops another, writes the record and parses it again."""
    parsed = _molecules_from_text(spark, d, "parse_ok", "tags")
    label = F.when(F.col("score") > 50000, F.lit("1.0")).otherwise(F.lit("0.0"))
    tags = drop_tag(set_tag(F.col("tags"), "Label", label), "Priority")
    text = staged(parsed.select("raw", "tags", "score"), {"text": to_sdf(F.col("raw"), tags)}).select("text")
    again = sdf.parse_molecules(sdf.explode_records(text, "text"), ("mol_id", "parse_ok", "atoms", "tags"))
    return again.select(
        "mol_id",
        "parse_ok",
        F.size("atoms").cast("bigint").alias("n_atoms"),
        F.try_element_at("tags", F.lit("Label")).alias("label_text"),
        F.try_element_at("tags", F.lit("Chemgauss4")).alias("score_text"),
        F.try_element_at("tags", F.lit("Priority")).alias("priority"),
    )


def _write_chunks(chunks: DataFrame, path: str) -> None:
    """Files of record text; a chunk has two records."""
    sinks.write_texts(chunks.select("chunk"), path, sinks.FILE_RECORDS // 2)


def _sdf_file(spark: SparkSession, d: str) -> str:
    path = Workspace(spark, "sdf").table_path("text")
    _write_chunks(S.sdf_chunks(spark, d), path)
    return path


def sdf_file_poses(spark, d):
    """The best pose of every molecule of a scored file."""
    poses = sdf.read_poses(spark, _sdf_file(spark, d), "Chemgauss4", ("row_key", "mol_id"))
    best = topn.best_per_id(poses.select("mol_id", "row_key", "score"))
    return best.select("mol_id", "score")


def top_of_file(spark, d):
    """The scores of the best 100 molecules of a file that holds every record twice, with their record text."""
    path = Workspace(spark, "sdf").table_path("twice")
    chunks = S.sdf_chunks(spark, d).select("chunk")
    _write_chunks(chunks.unionAll(chunks), path)
    hits = recipes.top_of_file(spark, path, "Chemgauss4", 100)
    whole = F.md5("raw") == F.col("row_key")
    return hits.groupBy("score").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("mol_id").alias("ids"), F.count_if(whole).alias("texts"))


def compare_files(spark, d):
    """A scored file against one of urgent and low orders; every molecule has two records in either."""
    path = Workspace(spark, "sdf").table_path("some")
    priority = S.table(spark, d, "orders").select("o_orderkey", "o_orderpriority").filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    _write_chunks(S.sdf_chunks(spark, d).join(priority, "o_orderkey", "left_semi"), path)
    return recipes.compare_files(spark, _sdf_file(spark, d), path, 1000).withColumn("percent", F.round("percent", 6))


def saved_records(spark, d):
    """Records written with a new data item and read from the files again."""
    path = Workspace(spark, "saved").table_path("sdf")
    poses = _molecules_from_text(spark, d, "parse_ok", "tags")
    sinks.write_sdf(poses.withColumn("tags", set_tag(F.col("tags"), "Label", F.lit("1.0"))), path)
    again = sdf.with_features(sdf.read_poses(spark, path, "Chemgauss4", ("mol_id", "tags")))
    return again.groupBy("mol_id").agg(F.max("score").alias("score"), F.sum("label").alias("labels"))


def signed_records(spark, d):
    """Records written with their count vectors, and read from the files again with the vectors as features."""
    path = Workspace(spark, "signed").table_path("sdf")
    recipes.signed_records(_molecules_from_text(spark, d, "row_key", "mol_id", "atoms", "bonds", "tags").drop("o_orderkey"), path)
    again = _vector_summary(sdf.read_featured(spark, path, ("mol_id", "tags")).withColumnRenamed("mol_id", "id").withColumn("row_key", F.col("id")))
    return again.groupBy("row_key", "size", "n_ids", "vector_md5").agg(F.count(F.lit(1)).alias("records"))


def sample_of_file(spark, d):
    """100 records of a file by hash and 100 of its first ones: how many there are, and how many of them the file has."""
    path = _sdf_file(spark, d)
    every = sdf.scan_records(spark, path).select(F.md5("raw").alias("row_key"))
    out = None
    for name, rows in (("sample", recipes.sample_records(spark, path, 100)), ("first", recipes.first_records(spark, path, 100))):
        found = rows.select(F.md5("raw").alias("row_key")).join(every, "row_key", "left_semi")
        one = found.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("records"), F.countDistinct("row_key").alias("texts"))
        out = one if out is None else out.unionByName(one)
    return out


def report_in_one_file(spark, d):
    """The best 30 users written as lines of one file: each line with its place, and the number of files."""
    path = Workspace(spark, "report").table_path("text")
    hits = topn.top_n(_poses(spark, d), 30)
    sinks.write_single(hits, path, F.concat_ws(" ", F.col("mol_id").cast("string"), F.col("row_key").cast("string")))
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("place"), F.input_file_name().alias("file"))
    files = lines.agg(F.countDistinct("file").alias("files"))
    return lines.select("value", "place").crossJoin(F.broadcast(files))  # one row


def fewer_files(spark, d):
    """All events in three files."""
    path = Workspace(spark, "fewer").table_path("events")
    sinks.write_fewer(S.table(spark, d, "events").repartition(8), 3, path)
    rows = spark.read.parquet(path).select(F.input_file_name().alias("file"))
    return rows.agg(F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("n"))


def record_count(spark, d):
    return sdf.count_records(spark, _sdf_file(spark, d))


def smiles_split(spark, d):
    return smiles.split_smiles(S.smiles_lines(spark, d))


def smiles_descriptors(spark, d):
    out = with_smiles_descriptors(smiles_split(spark, d))
    ints = [F.col(c).cast("bigint").alias(c) for c in ("heavy_atoms", "carbons", "hetero_atoms", "charge_sum", "charge_count", "rings")]
    return out.select("title", *ints, F.round("hetero_carbon_ratio", 6).alias("hetero_carbon_ratio"), F.array_join("elements", ",").alias("elements"))


def standardise(spark, d):
    rules = rule_files.parse_rules(SMILES_RULES)
    return recipes.standardise(smiles_split(spark, d), rules, rule_files.parse_rules("MIN_SUM_FORMAL_CRG 0"))


# --- signatures and vectors ---------------------------------------------------------------------------------------


def _signed(spark: SparkSession, d: str) -> DataFrame:
    return with_atom_signatures(S.molecules(spark, d).select("row_key", "atoms", "bonds")).select("row_key", "signatures")


def graph_signatures(spark, d):
    s = F.col("signatures")
    at = lambda h: F.size(F.filter(s, lambda x: x["height"] == h)).cast("bigint")
    texts = F.sort_array(F.transform(s, lambda x: F.concat(x["height"].cast("string"), F.lit(":"), x["signature"])))
    return _signed(spark, d).select(
        "row_key", at(1).alias("n_h1"), at(2).alias("n_h2"), at(3).alias("n_h3"), F.md5(F.array_join(texts, ";")).alias("all_signatures")
    )


def signature_counts(spark, d):
    """Occurrences of each signature of every height and the molecules that have it."""
    per_row = universe.counts_by_row(_signed(spark, d), S.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("row_key")))
    return per_row.groupBy("height", "signature").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("molecules"))


def _ngrams(spark: SparkSession, d: str) -> DataFrame:
    docs = sets.fill_cores(S.table(spark, d, "documents").select("doc_id", "lang", "text"))
    return with_ngrams(docs.select(F.col("doc_id").alias("row_key"), "lang", "text"), "text").drop("text")


def signature_universe(spark, d):
    docs = sets.fill_cores(S.table(spark, d, "documents").select("text"))
    found = universe.build_universe(ngrams_once(docs, "text"), ngram_bytes(docs, "text"))
    return found.withColumn("sig_id", F.col("sig_id").cast("bigint"))


def graph_universe(spark, d):
    found = universe.build_universe(explode_signatures(_signed(spark, d)))
    return universe.universe_size(found).select(F.col("size").cast("bigint").alias("size"))


def universe_roundtrip(spark, d):
    """The n-gram dictionary written as text and read again."""
    path = Workspace(spark, "universe").table_path("text")
    universe.write_universe(signature_universe(spark, d), path)
    return universe.read_universe(spark, path).withColumn("sig_id", F.col("sig_id").cast("bigint"))


def _vector_summary(vectors: DataFrame) -> DataFrame:
    f = F.col("features")
    return vectors.select(
        "row_key",
        f["size"].cast("bigint").alias("size"),
        F.size(f["ids"]).cast("bigint").alias("n_ids"),
        F.md5(vector_text(f)).alias("vector_md5"),
    )


def _frozen(spark: SparkSession, d: str, **bounds) -> DataFrame:
    ws = Workspace(spark, "vectors")
    rows = ws.write(_ngrams(spark, d), "ngrams")
    known = universe.stored_universe(rows.filter(F.col("lang") == "en"), ws)
    return _vector_summary(universe.count_vectors(rows.select("row_key", "signatures"), known, **bounds))


def frozen_vectors(spark, d):
    """All documents counted over the n-grams of the English ones; unknown n-grams are skipped."""
    return _frozen(spark, d)


def frozen_vectors_shuffled(spark, d):
    """The same by the path for dictionaries of any size."""
    return _frozen(spark, d, max_rows=0)


def universe_extended(spark, d):
    """The dictionary of the English n-grams, extended with those of all documents; old ids stay."""
    docs = sets.fill_cores(S.table(spark, d, "documents").select("lang", "text"))
    english, size = docs.filter(F.col("lang") == "en"), ngram_bytes(docs, "text")
    known = universe.build_universe(ngrams_once(english, "text"), ngram_bytes(english, "text"))
    return universe.extend_universe(Workspace(spark, "universe").write(known, "known"), ngrams_once(docs, "text"), size)


def graph_vectors(spark, d):
    ws = Workspace(spark, "vectors")
    rows = ws.write(_signed(spark, d), "signatures")
    known = universe.stored_universe(rows, ws)
    return _vector_summary(universe.count_vectors(rows, known))


def vector_text_roundtrip(spark, d):
    """Sparse vectors of whole thousandths made from all places of the embeddings that aren't 0, to text and back."""
    e = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000) + 0.0)
    at = F.filter(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.get(e, i) != 0)
    vals = F.transform(at, lambda i: F.get(e, i))
    rows = S.table(spark, d, "embeddings").select("vec_id", sparse(F.size(e), at, vals).alias("f"))
    back = staged(rows, {"text": vector_text(F.col("f"))}).select("vec_id", "text", parse_vector(F.col("text")).alias("g"))
    total = F.aggregate(F.col("g.vals"), F.lit(0.0), lambda t, v: t + v)
    return back.select(
        "vec_id",
        "text",
        F.col("g.size").cast("bigint").alias("size"),
        F.size("g.ids").cast("bigint").alias("n_ids"),
        F.array_join(F.col("g.ids").cast("array<string>"), " ").alias("ids"),
        total.alias("sum_vals"),
    )


# --- descriptors and rules ----------------------------------------------------------------------------------------


def _described(spark: SparkSession, d: str) -> DataFrame:
    return with_descriptors(S.molecules(spark, d))


def descriptors(spark, d):
    whole = [c for c in MOLECULE_DESCRIPTORS if c not in ("mol_weight", "hetero_carbon_ratio")]
    return _described(spark, d).select(
        "row_key",
        F.round("mol_weight", 4).alias("mol_weight"),
        F.round("hetero_carbon_ratio", 6).alias("hetero_carbon_ratio"),
        *[F.col(c).cast("bigint").alias(c) for c in whole],
        F.array_join("elements", ",").alias("elements"),
    )


def rule_filter(spark, d):
    return rule_ops.rule_filter(_described(spark, d), rule_files.parse_rules(RULE_TEXT)).select("row_key", "mol_id")


def rule_violations(spark, d):
    found = rule_ops.rule_violations(_described(spark, d), rule_files.parse_rules(RULE_TEXT), ["row_key"])
    return found.withColumn("value", F.round("value", 4))


def preset_filter(spark, d):
    return rule_ops.rule_filter(_described(spark, d), rule_files.preset_rules("lead")).select("row_key", "mol_id")


def preset_drug(spark, d):
    return rule_ops.rule_filter(_described(spark, d), rule_files.preset_rules("drug")).select("row_key", "mol_id")


def rules_from_files(spark, d):
    """The custom filter with its rules read from two files of a folder."""
    path = Workspace(spark, "rules").table_path("text")
    rule_lines = [line for line in RULE_TEXT.splitlines() if line.strip()]
    for i, part in enumerate((rule_lines[::2], rule_lines[1::2])):
        spark.createDataFrame([("\n".join(part),)], "value string").coalesce(1).write.text(f"{path}/{i}")
    rules = rule_files.read_rules(spark, f"{path}/*")
    return rule_ops.rule_filter(_described(spark, d), rules).select("row_key", "mol_id")


def filter_score_sort(spark, d):
    """The 50 best molecules that pass the custom filter, by a score known from a table."""
    described = _described(spark, d)
    key = F.col("o_orderkey")
    scores = S.table(spark, d, "orders").select(key.cast("string").alias("row_key"), (key.cast("bigint") % 97).cast("double").alias("score"))
    path = Workspace(spark, "kept").table_path("kept")
    out = recipes.filter_score_sort(described, rule_files.parse_rules(RULE_TEXT), scorers.table_scorer(scores), 50, path)
    return out.select("row_key", "mol_id", "score")


def element_lists(spark, d):
    """Molecules by element lists alone: nothing but the allowed elements, none of the denied ones."""
    rules = rule_files.parse_rules("ALLOWED_ELEMENTS C,N,O,S,P,F,H\nELIMINATE_METALS F,P")
    return rule_ops.rule_filter(_described(spark, d), rules).select("row_key", F.array_join("elements", ",").alias("elements"))


def path_motifs(spark, d):
    counts = rule_ops.motif_counts(S.molecules(spark, d), MOTIFS, ["row_key"])
    return counts.select("row_key", *[F.col(c).cast("bigint").alias(c) for c in MOTIFS])


def target_name(spark, d):
    return S.table(spark, d, "pages").select("page_id", file_stem(F.col("url")).alias("name"))


# --- conformal prediction with fixed weights ----------------------------------------------------------------------


def _fixed_model(spark: SparkSession) -> learner.LinearModel:
    return learner.LinearModel.dense(spark, S.MODEL_WEIGHTS, 0.25)


def _with_margin(spark: SparkSession, d: str, **bounds) -> DataFrame:
    """Margins of all rows; those of the side ``calibration`` are known, and all are predicted."""
    rows = S.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row_key"), from_dense(F.col("embedding")).alias("features"), (F.col("label") >= 5).cast("int").alias("label")
    )
    scored = _fixed_model(spark).with_margin(rows, **bounds).select("row_key", "label", "margin")
    return sampling.with_split(scored, "row_key", 0.3, SEED)


def _p_values(spark: SparkSession, d: str, **options) -> DataFrame:
    rows = _with_margin(spark, d)
    calibration = conformal.calibration_table(rows.filter(F.col("side") == "calibration"), F.col("margin"))
    return conformal.with_p_values(rows, calibration, **options)


def conformal_p_values(spark, d):
    out = _p_values(spark, d)
    return out.select("row_key", F.round("margin", 6).alias("margin"), F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"))


def conformal_p_values_sorted(spark, d):
    """The same numbers by the path for calibration tables of any size."""
    out = _p_values(spark, d, max_calibration_rows=0)
    return out.select("row_key", F.round("margin", 6).alias("margin"), F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"))


def _p_values_nulls(spark: SparkSession, d: str, **options) -> DataFrame:
    """Every test row twice, and no margin for a seventh of the keys."""
    rows = _with_margin(spark, d)
    calibration = conformal.calibration_table(rows.filter(F.col("side") == "calibration"), F.col("margin"))
    test = rows.withColumn("margin", F.when(F.col("row_key") % 7 != 0, F.col("margin")))
    out = conformal.with_p_values(test.unionAll(test), calibration, **options)
    return out.select("row_key", F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"))


def conformal_p_values_nulls(spark, d):
    return _p_values_nulls(spark, d)


def conformal_p_values_nulls_sorted(spark, d):
    return _p_values_nulls(spark, d, max_calibration_rows=0)


def margins_shuffled(spark, d):
    """Margins by the path for models of any size."""
    return _with_margin(spark, d, max_weights=0).select("row_key", F.round("margin", 6).alias("margin"))


def nonconformity(spark, d):
    rows = _with_margin(spark, d)
    return conformal.calibration_table(rows, F.col("margin")).select(F.col("label").cast("bigint").alias("label"), F.round("alpha", 6).alias("alpha"))


def _predicted(spark: SparkSession, d: str, significance: float = 0.2) -> DataFrame:
    return conformal.with_predictions(_p_values(spark, d), significance)


def prediction_sets(spark, d):
    out = _predicted(spark, d)
    return out.select("row_key", F.array_join(F.col("pred_set").cast("array<string>"), ",").alias("pred_set"))


def verdicts(spark, d):
    return _predicted(spark, d).select("row_key", "verdict")


def efficiency(spark, d):
    out = conformal.efficiency(_predicted(spark, d))
    return out.withColumn("efficiency", F.round("efficiency", 6))


def score_with_stored_model(spark, d):
    """Model and calibration rows stored as tables, loaded by name, and applied to all rows."""
    path = Workspace(spark, "models").path
    rows = _with_margin(spark, d)
    calibration = conformal.calibration_table(rows.filter(F.col("side") == "calibration"), F.col("margin"))
    models.save_model(path, models.StoredModel("protein_a", CODE, 1, _fixed_model(spark), 0.2, 64, calibration))
    stored = models.load_model(spark, path, "protein_a", CODE)
    fresh = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("row_key"), from_dense(F.col("embedding")).alias("features"))
    out = models.predict_with(stored, fresh, significance=0.5)
    return out.select("row_key", F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"), "verdict")


def prediction_rows(spark, d):
    rows = _predicted(spark, d).withColumn("mol_id", F.concat(F.lit("vec "), F.col("row_key").cast("string")))
    return sinks.prediction_rows(rows, TARGET, CODE)


def score_rows(spark, d):
    return sinks.score_rows(_poses(spark, d), TARGET, CODE)


def predict_new_molecules(spark, d):
    """Vectors of all molecules over a stored dictionary of their smaller signatures, and what a stored model makes of them."""
    ws = Workspace(spark, "new")
    mols = ws.write(_signed(spark, d), "signatures")
    known = universe.stored_universe(mols, ws, below=3)
    weights = known.select("sig_id", ((F.col("sig_id") * 29) % 13 - 6).cast("double").alias("weight"))
    alphas = spark.range(40).select((F.col("id") % 2).cast("int").alias("label"), ((F.col("id") * 7) % 41 - 20).cast("double").alias("alpha"))
    models.save_model(ws.path, models.StoredModel("protein_a", CODE, 3, learner.LinearModel(weights, 0.25), 0.2, 0, alphas))
    stored = models.load_model(spark, ws.path, "protein_a", CODE)
    out = recipes.predict_new(mols, known, stored)
    return out.select("row_key", F.round("margin", 6).alias("margin"), F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"), "verdict")


def appended_scores(spark, d):
    """Scores of two runs appended once each, although the first is repeated and the second was killed before its end."""
    path = Workspace(spark, "appended").path
    rows = score_rows(spark, d)
    rows.limit(10).write.partitionBy("r_name").parquet(f"{path}/rows/run=second")  # what the killed one left
    for run in ("first", "first", "second", "first"):
        sinks.append_once(rows, path, run)
    return sinks.read_appended(spark, path, schemas.DB_SCORES)


def external_scorer(spark, d):
    """Twice the value plus one, worked out by a child process per batch; it gives no answer for values below 1."""
    code = (
        "import sys\n"
        "for line in sys.stdin:\n"
        "    key, value = line.rstrip('\\n').split('\\t')\n"
        "    if float(value) >= 1.0:\n"
        "        print(key, 2.0 * float(value) + 1.0, sep='\\t')\n"
    )
    events = S.table(spark, d, "events").select(F.col("event_id").alias("row_key"), "value")
    run = scorers.external_scorer([sys.executable, "-c", code], "value", timeout=600.0)
    return scorers.score_rows_with(run, events).withColumn("score", F.round("score", 6))


def external_records(spark, d):
    """Records through a program that adds twice the number of atoms as a score and leaves out every third size."""
    code = (
        "import sys\n"
        "record = []\n"
        "for line in sys.stdin:\n"
        "    if line.rstrip() != '$$$$':\n"
        "        record.append(line)\n"
        "        continue\n"
        "    atoms = int(record[3][:3])\n"
        "    if atoms % 3:\n"
        "        print(''.join(record) + f'> <Hybrid2>\\n{2.0 * atoms}\\n\\n$$$$')\n"
        "    record = []\n"
    )
    mols = _molecules_from_text(spark, d, "row_key", "tags")
    poses = scorers.external_records(mols, [sys.executable, "-c", code], "Hybrid2", timeout=600.0, wanted=("mol_id", "atoms"))
    found = poses.groupBy("mol_id").agg(F.max("score").alias("score"), F.countDistinct("row_key").alias("records"), F.max(F.size("atoms")).alias("n"))
    return found.withColumn("n", F.col("n").cast("bigint"))


# --- learning and the loop ----------------------------------------------------------------------------------------


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidates with scaled embeddings, and the table that holds the true score of each."""
    rows = S.table(spark, d, "embeddings")
    e = F.col("embedding")
    weights = F.array(*[F.lit(w) for w in S.SCORE_WEIGHTS])
    score = F.aggregate(F.zip_with(e, weights, lambda x, w: x.cast("double") * w), F.lit(0.0), lambda t, x: t + x)
    key = F.col("vec_id").cast("string")
    scaled = F.transform(e, lambda x: x.cast("double") * S.FEATURE_SCALE)
    mol_id = F.concat(F.lit("vec "), key)
    candidates = rows.select(key.alias("row_key"), mol_id.alias("mol_id"), from_dense(scaled).alias("features"))
    return candidates, rows.select(key.alias("row_key"), score.alias("score"))


def _screened(spark: SparkSession, d: str) -> ScreenResult:
    candidates, scores = _candidates(spark, d)
    return screen(candidates, scorers.table_scorer(scores), ScreenParams(bad_bin=4, good_bin=6))


def svm_margins(spark, d):
    """Margins of all rows under a model fitted to all of them, labelled by the sign of the true score."""
    candidates, scores = _candidates(spark, d)
    rows = candidates.join(scores, "row_key").withColumn("label", (F.col("score") > 0).cast("double"))
    model = learner.LinearSVM().fit(rows)
    return model.with_margin(rows).select("row_key", "label", F.round("margin", 4).alias("margin"))


def _telling(spark: SparkSession, d: str) -> DataFrame:
    """Wide sparse rows: a feature that hardly another row has among ten million, and one that tells the label by a wide gap."""
    label = (F.col("label") >= 5).cast("double")
    ids = F.array((F.col("vec_id") * 997) % 10_000_000, F.lit(12_345_678).cast("bigint"))
    vals = F.array(F.lit(1.0), F.when(label == 1, 10.0).otherwise(-10.0))
    rows = S.table(spark, d, "embeddings")
    return rows.select(F.col("vec_id").alias("row_key"), label.alias("label"), sparse(F.lit(20_000_000), ids, vals).alias("features"))


def _sides(spark: SparkSession, d: str, chosen: learner.Learner) -> DataFrame:
    rows = _telling(spark, d)
    out = chosen.fit(rows).with_margin(rows)
    return out.select("row_key", "label", (F.col("margin") > 0).alias("above"))


def svm_sparse(spark, d):
    """On which side of a fitted plane each row of a very wide table lies."""
    return _sides(spark, d, learner.LinearSVM())


def logistic_sparse(spark, d):
    return _sides(spark, d, learner.Logistic())


def _screened_known(spark: SparkSession, d: str, **params) -> ScreenResult:
    """The loop with a model that is there already, so that all of it but the fit can be followed."""
    candidates, scores = _candidates(spark, d)
    known = learner.Known(learner.LinearModel.dense(spark, S.MODEL_WEIGHTS, 0.0))
    return screen(candidates, scorers.table_scorer(scores), ScreenParams(bad_bin=4, good_bin=6, **params), known)


def _scored_rows(result: ScreenResult) -> DataFrame:
    return result.scored.select("row_key", "mol_id", F.round("score", 6).alias("score"), F.col("cycle").cast("bigint").alias("cycle"))


def screen_single_cycle_fixed(spark, d):
    return _scored_rows(_screened_known(spark, d, single_cycle=True))


def screen_two_cycles_fixed(spark, d):
    return _scored_rows(_screened_known(spark, d, max_cycles=2))


def screen_cycles_fixed(spark, d):
    """What each of two cycles sampled and labelled, and how decisive it was."""
    out = _screened_known(spark, d, max_cycles=2).cycles_table(spark)
    return out.withColumns({"cycle": F.col("cycle").cast("bigint"), "efficiency": F.round("efficiency", 6)})


def learned_screening_tables(spark, d):
    """All tables that two cycles leave behind, stored twice under one name and read again."""
    path = Workspace(spark, "stored").path
    result = _screened_known(spark, d, max_cycles=2)
    reference = S.table(spark, d, "embeddings").select(F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("mol_id"))
    for _ in range(2):
        recipes.store_screening(result, 30, path, TARGET, CODE, "run-1", universe_size=64, reference=reference)
    none = F.lit(None).cast("double")
    row = lambda df, what, name, text, value: df.select(F.lit(what).alias("what"), name.alias("name"), text.alias("text"), F.round(value, 6).alias("value"))
    predictions = sinks.read_appended(spark, f"{path}/predictions", schemas.DB_PREDICTIONS)
    scores = sinks.read_appended(spark, f"{path}/scores", schemas.DB_SCORES)
    stored = models.load_model(spark, path, "protein_a", CODE)
    hits = spark.read.text(f"{path}/hits").select(F.split("value", "\t").alias("v"))
    tables = [
        row(predictions, "prediction", F.col("l_id"), F.col("l_prediction"), none),
        row(scores, "score", F.col("l_id"), F.col("r_name"), F.col("l_score")),
        row(stored.model.weights, "weight", F.col("sig_id").cast("string"), F.lit(stored.target), F.col("weight")),
        row(hits, "hit", F.col("v")[0], F.lit(None).cast("string"), F.col("v")[1].cast("double")),
        row(spark.read.parquet(f"{path}/overlap"), "overlap", F.lit("percent"), F.lit(None).cast("string"), F.col("percent")),
    ]
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def screen_top_n(spark, d):
    return topn.top_n(_screened(spark, d).scored, 30)


def screen_cycles(spark, d):
    return _screened(spark, d).cycles_table(spark)


def screen_molecules(spark, d):
    """Signatures of all derived molecules, the loop with a score known from a table, and the best 30."""
    mols = S.molecules(spark, d)
    carbons = F.size(F.filter("atoms", lambda a: a["element"] == "C"))
    hetero = F.size(F.filter("atoms", lambda a: a["element"].isin("N", "O", "S")))
    scores = mols.select("row_key", (carbons * 2.0 - hetero * 1.5).alias("score"))
    params = ScreenParams(initial_size=200, increment_size=100, bad_bin=4, good_bin=6, unique_keys=True)
    hits, _ = recipes.learned_screening(mols, scorers.table_scorer(scores), 30, params)
    return hits


def plain_screening(spark, d):
    """A quarter of the events scored by table and the best 30 users."""
    events = S.table(spark, d, "events")
    pool = events.select(F.col("event_id").alias("row_key"), F.col("user_id").alias("mol_id"))
    return recipes.plain_screening(pool, scorers.table_scorer(_poses(spark, d)), 30, 0.25, SEED)


QUERIES = [
    top_n_poses, top_n_lowest, top_n_payload, best_pose_per_id, collapse_best_2, sorted_first_100, sort_by_score,
    top_n_long, select_best_third, collapse_best_50, signed_records, sample_of_file, report_in_one_file, fewer_files,
    frozen_vectors_shuffled, universe_extended, margins_shuffled, predict_new_molecules, appended_scores, svm_sparse, logistic_sparse,
    screen_single_cycle_fixed, screen_two_cycles_fixed, screen_cycles_fixed, learned_screening_tables,
    score_parse, top_semi_join, pool_minus_scored, union_sources, hit_overlap, exact_sample, exact_sample_large, exact_sample_copies,
    fraction_sample, split_proper_calibration, split_stratified, score_histogram, label_extremes, sdf_split, sdf_tags,
    sdf_atoms, sdf_bonds, sdf_write_tag, sdf_file_poses, top_of_file, compare_files, saved_records, record_count, smiles_split, smiles_descriptors, standardise,
    graph_signatures, signature_counts, signature_universe, universe_roundtrip, graph_universe, frozen_vectors, graph_vectors,
    vector_text_roundtrip, descriptors, rule_filter, rule_violations, preset_filter, preset_drug, rules_from_files, filter_score_sort, element_lists, path_motifs,
    target_name, conformal_p_values, conformal_p_values_sorted, conformal_p_values_nulls, conformal_p_values_nulls_sorted, nonconformity, prediction_sets, verdicts, efficiency,
    score_with_stored_model, prediction_rows, score_rows, external_scorer, external_records, svm_margins, screen_top_n, screen_cycles,
    screen_molecules, plain_screening,
]
