"""The queries of ``queries`` as SQL for DuckDB. A query without an entry has no SQL form."""

from __future__ import annotations

from gleaner.functions.chem import ATOMIC_WEIGHTS
from gleaner.plans import stand_in as S

_FAILED = "-1.7976931348623157e308::DOUBLE"


def _texts(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _numbers(values) -> str:
    return "[" + ", ".join(f"{v}::DOUBLE" for v in values) + "]"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _hex(key: str, seed: int) -> str:
    return f"md5(CAST({key} AS VARCHAR) || ':{seed}')"


# The first 8 hex digits of a hash that lies below 0.3 and below 0.25 of the span.
_BELOW_30 = "<= '4ccccccc'"
_BELOW_25 = "<= '3fffffff'"

_POSES = """poses AS (SELECT event_id AS row_key, user_id AS mol_id,
  CASE WHEN event_type <> 'error' THEN value END AS score FROM events)"""

_BEST = """best AS (SELECT mol_id, score, row_key FROM (SELECT *, row_number() OVER
  (PARTITION BY mol_id ORDER BY score DESC NULLS LAST, row_key) AS rn FROM poses) WHERE rn = 1)"""

_TOP = "top AS (SELECT * FROM best ORDER BY score DESC NULLS LAST, row_key LIMIT 30)"

# --- molecules derived from orders ---

_DIGITS = """dig AS (SELECT o_orderkey AS k, o_orderpriority AS prio, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
  list_transform(string_split(CAST(o_orderkey AS VARCHAR) || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)
    || strftime(o_orderdate, '%Y%m%d'), ''), lambda c: CAST(c AS INTEGER)) AS d FROM orders)"""

_ATOMS = f"""atoms AS (SELECT k, i, d[i] AS x, {_texts(S.DIGIT_ELEMENTS)}[d[i] + 1] AS e,
  CASE WHEN d[i] = 1 AND i % 5 = 0 THEN 1 WHEN d[i] = 2 AND i % 7 = 0 THEN -1 ELSE 0 END AS charge,
  CASE WHEN d[i] = 7 THEN 1 ELSE 0 END AS parity
  FROM (SELECT k, d, unnest(range(1, len(d) + 1)) AS i FROM dig))"""

_BONDS = """bonds AS (SELECT k, i AS a, i + 1 AS b, (d[i] + d[i + 1]) % 3 + 1 AS ord
    FROM (SELECT k, d, unnest(range(1, len(d))) AS i FROM dig)
  UNION ALL SELECT k, len(d), 1, 1 FROM dig WHERE d[len(d)] % 2 = 0)"""

# The ring bond is written (1, n) in the records; both ends are listed here once per direction.
_STEPS = """steps AS (SELECT s.k, s.u, s.v, s.ord, p.e AS eu, q.e AS ev FROM (
    SELECT k, a AS u, b AS v, ord FROM bonds UNION ALL SELECT k, b, a, ord FROM bonds) s
  JOIN atoms p ON p.k = s.k AND p.i = s.u JOIN atoms q ON q.k = s.k AND q.i = s.v)"""

_MOLECULE = (_DIGITS, _ATOMS, _BONDS)


def _height(h: int) -> str:
    return f"""h{h} AS (SELECT k, i, t AS s FROM (
    SELECT a.k, a.i, a.e || '(' || coalesce(string_agg(CAST(s.ord AS VARCHAR) || p.s, ','
      ORDER BY CAST(s.ord AS VARCHAR) || p.s), '') || ')' AS t
    FROM atoms a LEFT JOIN steps s ON s.k = a.k AND s.u = a.i LEFT JOIN h{h - 1} p ON p.k = s.k AND p.i = s.v
    GROUP BY a.k, a.i, a.e))"""


_SIGNATURES = (
    *_MOLECULE,
    _STEPS,
    "h0 AS (SELECT k, i, e AS s FROM atoms)",
    _height(1),
    _height(2),
    _height(3),
    """sigs AS (SELECT k, 1 AS height, s FROM h1 UNION ALL SELECT k, 2, s FROM h2 UNION ALL SELECT k, 3, s FROM h3)""",
)

_CONFORMERS = """conf AS (SELECT dig.*, c.conformer FROM dig, (VALUES (1), (2)) c(conformer))"""

_SCORE_TEXT = """CASE WHEN prio = '1-URGENT' THEN '340282346638528859811704183484516925440.000000'
  WHEN prio = '5-LOW' AND conformer = 2 THEN '' ELSE CAST(cents % 100000 - conformer AS VARCHAR) END"""

_SCORED_CONF = f"""scored AS (SELECT *, 'order ' || CAST(k AS VARCHAR) AS mol_id, {_SCORE_TEXT} AS score_text,
  CASE WHEN prio = '1-URGENT' OR (prio = '5-LOW' AND conformer = 2) THEN NULL
    ELSE CAST(cents % 100000 - conformer AS DOUBLE) END AS score FROM conf)"""

_SMILES_TOKEN = _texts(S.DIGIT_SMILES)
_SMILES = f"""smi AS (SELECT k, d, 'C1' || list_aggregate(list_transform(d, lambda x: {_SMILES_TOKEN}[x + 1]), 'string_agg', '')
  || 'C1' AS smiles, 'order ' || CAST(k AS VARCHAR) AS title FROM dig)"""

# Atoms of the notation: those of the digits and a carbon at either end.
_SMILES_DESC = f"""sd AS (SELECT k, smiles, title,
  len(d) + 2 AS heavy_atoms,
  2 + len(list_filter(d, lambda x: x IN (0, 5))) AS carbons,
  len(list_filter(d, lambda x: x NOT IN (0, 5))) AS hetero_atoms,
  len(list_filter(d, lambda x: x = 9)) - len(list_filter(d, lambda x: x = 8)) AS charge_sum,
  len(list_filter(d, lambda x: x IN (8, 9))) AS charge_count,
  1 AS rings,
  list_sort(list_distinct(list_concat(['C'], list_transform(d,
    lambda x: ['C', 'N', 'O', 'S', 'Cl', 'C', 'P', 'Br', 'O', 'N'][x + 1])))) AS els FROM smi)"""

_WEIGHTS = "CASE e " + " ".join(f"WHEN '{e}' THEN {w}" for e, w in ATOMIC_WEIGHTS.items() if e in S.DIGIT_ELEMENTS) + " END"

_DESCRIBED = f"""described AS (SELECT a.k, sum({_WEIGHTS}) AS mol_weight,
    count(*) FILTER (e <> 'H') AS heavy_atoms, count(*) FILTER (e = 'C') AS carbons,
    count(*) FILTER (e NOT IN ('C', 'H')) AS hetero_atoms, CAST(sum(charge) AS BIGINT) AS charge_sum,
    count(*) FILTER (charge <> 0) AS charge_count, count(*) FILTER (e IN ('N', 'O')) AS acceptors,
    CAST(sum(parity) AS BIGINT) AS chiral_centers, list_sort(list(DISTINCT e)) AS els,
    coalesce(any_value(dn.donors), 0) AS donors, any_value(len(dig.d)) AS n,
    any_value(CASE WHEN dig.d[len(dig.d)] % 2 = 0 THEN 1 ELSE 0 END) AS rings
  FROM atoms a JOIN dig ON dig.k = a.k
  LEFT JOIN (SELECT k, count(DISTINCT u) AS donors FROM steps WHERE eu IN ('N', 'O') AND ev = 'H' GROUP BY k) dn ON dn.k = a.k
  GROUP BY a.k),
desc_ratio AS (SELECT *, CASE WHEN carbons > 0 THEN hetero_atoms / carbons::DOUBLE END AS hetero_carbon_ratio FROM described)"""

_DESC = (*_MOLECULE, _STEPS, _DESCRIBED)

_MARK = {"-": "IN (1, 4)", "=": "= 2", "#": "= 3"}


def _chain(name: str, atoms: list[str], bonds: list[str]) -> str:
    """Distinct chains per molecule, a chain and its reverse being one."""
    atom = lambda col, symbols: f"{col} IN (" + ", ".join(f"'{s}'" for s in symbols.split()) + ")"
    if len(atoms) == 1:
        return f"{name} AS (SELECT k, count(*) AS n FROM atoms WHERE {atom('e', atoms[0])} GROUP BY k)"
    joins, where = "steps s0", [f"s0.ord {_MARK[bonds[0]]}", atom("s0.eu", atoms[0]), atom("s0.ev", atoms[1])]
    places = ["s0.u", "s0.v"]
    for j in range(1, len(bonds)):
        joins += f" JOIN steps s{j} ON s{j}.k = s0.k AND s{j}.u = s{j - 1}.v"
        where += [f"s{j}.ord {_MARK[bonds[j]]}", atom(f"s{j}.ev", atoms[j + 1])]
        where += [f"s{j}.v <> {p}" for p in places]
        places.append(f"s{j}.v")
    forward, back = "[" + ", ".join(places) + "]", "[" + ", ".join(reversed(places)) + "]"
    return f"""{name} AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT s0.k AS k, least({forward}, {back}) AS p FROM {joins}
  WHERE {' AND '.join(where)}) GROUP BY k)"""


_MOTIF_CTES = {
    "peroxide": _chain("peroxide", ["O", "O"], ["-"]),
    "phosphorane": _chain("phosphorane", ["C", "P"], ["="]),
    "carbodiimide": _chain("carbodiimide", ["N", "C", "N"], ["=", "="]),
    "iso_thio_cyanate": _chain("iso_thio_cyanate", ["N", "C", "S O"], ["=", "="]),
    "thiocyanate": _chain("thiocyanate", ["S", "C", "N"], ["-", "#"]),
    "p_s_halide": _chain("p_s_halide", ["P S", "Cl Br F I"], ["-"]),
    "n_o_s": _chain("n_o_s", ["N O S"], []),
    "unsaturated": _chain("unsaturated", ["C N", "C", "C O"], ["=", "-"]),
}


def _motif_columns(names) -> str:
    return ", ".join(f"coalesce({n}.n, 0) AS {n}" for n in names)


def _motif_joins(names, key: str) -> str:
    return " ".join(f"LEFT JOIN {n} ON {n}.k = {key}" for n in names)


_RULE_MOTIFS = ("n_o_s", "p_s_halide", "peroxide", "phosphorane")

_CHECKED = f"""checked AS (SELECT x.*, {_motif_columns(_RULE_MOTIFS)},
  len(list_filter(els, lambda e: e NOT IN ('C', 'N', 'O', 'S', 'P', 'F', 'Cl', 'H'))) AS not_allowed
  FROM desc_ratio x {_motif_joins(_RULE_MOTIFS, 'x.k')}),
violated AS (
  SELECT k, 'MIN_MOLWT' AS rule, mol_weight AS value, 180.0 AS low, NULL::DOUBLE AS high FROM checked WHERE mol_weight < 180
  UNION ALL SELECT k, 'MAX_MOLWT', mol_weight, NULL, 380 FROM checked WHERE mol_weight > 380
  UNION ALL SELECT k, 'MAX_NUM_HVY', heavy_atoms, NULL, 21 FROM checked WHERE heavy_atoms > 21
  UNION ALL SELECT k, 'MIN_CARBONS', carbons, 4, NULL FROM checked WHERE carbons < 4
  UNION ALL SELECT k, 'MAX_Het_C_Ratio', hetero_carbon_ratio, NULL, 2 FROM checked WHERE hetero_carbon_ratio > 2
  UNION ALL SELECT k, 'MAX_SSSR_RINGS', rings, NULL, 1 FROM checked WHERE rings > 1
  UNION ALL SELECT k, 'MAX_HBOND_DONORS', donors, NULL, 3 FROM checked WHERE donors > 3
  UNION ALL SELECT k, 'MAX_SUM_FORMAL_CRG', charge_sum, NULL, 1 FROM checked WHERE charge_sum > 1
  UNION ALL SELECT k, 'ALLOWED_ELEMENTS', not_allowed, NULL, 0 FROM checked WHERE not_allowed > 0
  UNION ALL SELECT k, 'N_O_S', n_o_s, NULL, 9 FROM checked WHERE n_o_s > 9
  UNION ALL SELECT k, 'P_S_halide', p_s_halide, NULL, 1 FROM checked WHERE p_s_halide > 1
  UNION ALL SELECT k, 'peroxide', peroxide, NULL, 0 FROM checked WHERE peroxide > 0
  UNION ALL SELECT k, 'phosphoranes', phosphorane, NULL, 0 FROM checked WHERE phosphorane > 0)"""

_RULED = (*_DESC, *[_MOTIF_CTES[n] for n in _RULE_MOTIFS], _CHECKED)

# --- n-grams of documents ---

_GRAMS = """w AS (SELECT doc_id, lang, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT doc_id, lang, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
  list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM w)"""


def _vectors(keys: str, key: str, occurrences: str) -> str:
    return f"""counts AS (SELECT o.{key} AS row_key, u.sig_id, count(*) AS n FROM {occurrences} o JOIN universe u ON u.s = o.s GROUP BY ALL),
texts AS (SELECT row_key, count(*) AS n_ids, string_agg(CAST(sig_id AS VARCHAR), ',' ORDER BY sig_id) AS ids,
  string_agg(CAST(n AS VARCHAR) || '.0', ',' ORDER BY sig_id) AS vals FROM counts GROUP BY row_key)
SELECT r.row_key, z.size, coalesce(n_ids, 0) AS n_ids,
  md5('(' || CAST(z.size AS VARCHAR) || ',[' || coalesce(ids, '') || '],[' || coalesce(vals, '') || '])') AS vector_md5
FROM ({keys}) r LEFT JOIN texts t ON t.row_key = r.row_key, (SELECT coalesce(max(sig_id) + 1, 0) AS size FROM universe) z"""


# --- conformal prediction on embeddings ---

_MARGINS = f"""margins AS (SELECT vec_id AS row_key, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label,
  list_reduce(list_concat([0.0::DOUBLE], list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE)
    * {_numbers(S.MODEL_WEIGHTS)}[i])), lambda t, x: t + x) + 0.25 AS margin,
  substr({_hex('vec_id', 11)}, 1, 8) {_BELOW_30} AS held FROM embeddings)"""

_CONFORMAL = f"""{_MARGINS},
cal AS (SELECT label, CASE WHEN label = 1 THEN -margin ELSE margin END AS alpha FROM margins WHERE held),
test AS (SELECT row_key, margin,
  ((SELECT count(*) FROM cal WHERE label = 0 AND alpha >= m.margin) + 1.0) / ((SELECT count(*) FROM cal WHERE label = 0) + 1.0) AS p0,
  ((SELECT count(*) FROM cal WHERE label = 1 AND alpha >= -m.margin) + 1.0) / ((SELECT count(*) FROM cal WHERE label = 1) + 1.0) AS p1
  FROM margins m)"""


def _sets(significance: float) -> str:
    return f"""sets AS (SELECT *, p0 > {significance} AS in0, p1 > {significance} AS in1,
  CASE WHEN p0 > {significance} AND NOT p1 > {significance} THEN 'BAD'
    WHEN p1 > {significance} AND NOT p0 > {significance} THEN 'GOOD' ELSE 'UNKNOWN' END AS verdict FROM test)"""


_P_VALUES = f"WITH {_CONFORMAL} SELECT row_key, round(margin, 6) AS margin, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM test"

_P_VALUES_NULLS = f"""WITH {_CONFORMAL} SELECT row_key, CASE WHEN CAST(row_key AS BIGINT) % 7 <> 0 THEN round(p0, 6) END AS p0,
  CASE WHEN CAST(row_key AS BIGINT) % 7 <> 0 THEN round(p1, 6) END AS p1 FROM test, (VALUES (1), (2)) twice(i)"""

_GRAM_UNIVERSE = "universe AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS sig_id FROM (SELECT DISTINCT s FROM grams WHERE lang = 'en'))"

# --- the loop with a known model, unrolled ---


def _linear(weights: list[float], scale: str = "1.0") -> str:
    return f"""list_reduce(list_concat([0.0::DOUBLE], list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * {scale}::DOUBLE
    * {_numbers(weights)}[i])), lambda t, x: t + x)"""


_CANDIDATES = f"""cand AS (SELECT CAST(vec_id AS VARCHAR) AS row_key, 'vec ' || CAST(vec_id AS VARCHAR) AS mol_id, {_hex('vec_id', 11)}[:15] AS u,
  substr({_hex('vec_id', 12)}, 1, 8) {_BELOW_30} AS held, {_linear(S.SCORE_WEIGHTS)} AS score,
  {_linear(S.MODEL_WEIGHTS, str(S.FEATURE_SCALE))} AS margin FROM embeddings)"""


def _cycle(i: int, size: int) -> str:
    """Sample, labels, calibration and verdicts of cycle ``i``, after those of the cycles before."""
    pool = "" if i == 1 else f"WHERE u > (SELECT max(u) FROM s{i - 1}) " + "".join(
        f"AND row_key NOT IN (SELECT row_key FROM v{j} WHERE verdict = 'BAD') " for j in range(1, i)
    )
    known = " UNION ALL ".join(f"SELECT label, margin FROM t{j} WHERE held" for j in range(1, i + 1))
    p = lambda c, sign: f"""((SELECT count(*) FROM c{i} WHERE label = {c} AND alpha >= {sign}m.margin) + 1.0)
    / ((SELECT count(*) FROM c{i} WHERE label = {c}) + 1.0)"""  # noqa: E731
    return f"""s{i} AS MATERIALIZED (SELECT * FROM cand {pool}ORDER BY u LIMIT {size}),
e{i} AS (SELECT min(score) AS lo, max(score) AS hi FROM s{i}),
t{i} AS MATERIALIZED (SELECT *, CASE WHEN score <= lo + (hi - lo) * 4 / 10 THEN 0 ELSE 1 END AS label FROM s{i}, e{i}
  WHERE score <= lo + (hi - lo) * 4 / 10 OR score >= lo + (hi - lo) * 6 / 10),
c{i} AS MATERIALIZED (SELECT label, CASE WHEN label = 1 THEN -margin ELSE margin END AS alpha FROM ({known})),
v{i} AS MATERIALIZED (SELECT *, CASE WHEN p0 > 0.2 AND NOT p1 > 0.2 THEN 'BAD' WHEN p1 > 0.2 AND NOT p0 > 0.2 THEN 'GOOD' ELSE 'UNKNOWN' END AS verdict,
  (p0 > 0.2) <> (p1 > 0.2) AS one FROM (SELECT *, {p(0, '')} AS p0, {p(1, '-')} AS p1 FROM cand m))"""


def _screened(cycles: int) -> tuple[str, ...]:
    sizes = [100] + [50] * (cycles - 1)
    samples = " UNION ALL ".join(f"SELECT row_key, mol_id, score, {i} AS cycle FROM s{i}" for i in range(1, cycles + 1))
    last = f"""scored AS (SELECT * FROM sampled UNION ALL SELECT row_key, mol_id, score, {cycles + 1} FROM v{cycles}
  WHERE verdict = 'GOOD' AND row_key NOT IN (SELECT row_key FROM sampled))"""
    return (_CANDIDATES, *[_cycle(i, n) for i, n in enumerate(sizes, 1)], f"sampled AS ({samples})", last)


_SCORED_ROWS = "SELECT row_key, mol_id, round(score, 6) AS score, CAST(cycle AS BIGINT) AS cycle FROM scored"

_SPAN = "span AS (SELECT min(score) AS lo, max(score) AS hi FROM poses)"

_TOP_PARTS = """sums AS (SELECT l_partkey, sum(l_quantity) AS q, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS r FROM lineitem GROUP BY 1),
a AS (SELECT p_brand AS id, count(*) AS n FROM (SELECT * FROM sums ORDER BY q DESC, l_partkey LIMIT 1000) JOIN part ON p_partkey = l_partkey GROUP BY 1),
b AS (SELECT p_brand AS id, count(*) AS n FROM (SELECT * FROM sums ORDER BY r DESC, l_partkey LIMIT 1000) JOIN part ON p_partkey = l_partkey GROUP BY 1)"""

ORACLES: dict[str, str] = {
    "top_n_poses": _with(_POSES, _BEST, _TOP) + "SELECT mol_id, score, row_key FROM top",
    "top_n_lowest": _with(_POSES)
    + """SELECT mol_id, score, row_key FROM (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY score, row_key) AS rn
  FROM poses WHERE score IS NOT NULL) WHERE rn = 1 ORDER BY score, row_key LIMIT 30""",
    "top_n_payload": _with(_POSES, _BEST, _TOP)
    + "SELECT t.mol_id, t.score, t.row_key, e.event_type, e.props FROM top t JOIN events e ON e.event_id = t.row_key",
    "best_pose_per_id": _with(_POSES, _BEST) + "SELECT mol_id, score, row_key FROM best",
    "collapse_best_2": _with(_POSES)
    + """SELECT row_key, mol_id, score, rank FROM (SELECT *, row_number() OVER
  (PARTITION BY mol_id ORDER BY score DESC NULLS LAST, row_key) AS rank FROM poses) WHERE rank <= 2""",
    "sorted_first_100": _with(_POSES) + "SELECT * FROM poses ORDER BY score DESC NULLS LAST, row_key LIMIT 100",
    "sort_by_score": _with(_POSES) + f"SELECT row_key, mol_id, coalesce(score, {_FAILED}) AS score FROM poses ORDER BY 3 DESC, 1",
    "score_parse": f"""SELECT event_id, user_id, s AS score, coalesce(s, {_FAILED}) AS stored_score FROM (
  SELECT event_id, user_id, CASE WHEN event_type = 'click' OR (event_type = 'view' AND user_id % 3 = 2) THEN value END AS s FROM events)""",
    "top_semi_join": _with(_POSES, _BEST, _TOP)
    + """SELECT row_key, mol_id, score FROM poses p WHERE EXISTS (SELECT 1 FROM top t
  WHERE t.mol_id = p.mol_id AND t.score IS NOT DISTINCT FROM p.score)""",
    "pool_minus_scored": """SELECT user_id AS row_key, event_id, event_type, value FROM events e
  WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.value >= 250)""",
    "top_n_long": "SELECT o_orderkey AS mol_id, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20000",
    "select_best_third": _with(_POSES)
    + """SELECT row_key, mol_id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, row_key) AS rn, count(*) OVER () AS n
  FROM poses) WHERE rn <= n // 3""",
    "collapse_best_50": _with(_POSES)
    + """SELECT row_key, mol_id, score, rank FROM (SELECT *, row_number() OVER
  (PARTITION BY mol_id ORDER BY score DESC NULLS LAST, row_key) AS rank FROM poses) WHERE rank <= 50""",
    "union_sources": "SELECT l_orderkey AS row_key, l_partkey AS mol_id, l_extendedprice AS score, l_returnflag FROM lineitem",
    "hit_overlap": _with(_TOP_PARTS)
    + """SELECT CAST(coalesce(sum(a.n * b.n), 0) AS BIGINT) AS pair_matches, count(*) AS distinct_matches,
  round(coalesce(sum(a.n * b.n), 0) / 1000.0 * 100.0, 6) AS percent FROM a JOIN b USING (id)""",
    "exact_sample": f"SELECT doc_id, lang, n_chars FROM documents ORDER BY {_hex('doc_id', 11)}, doc_id LIMIT 100",
    "exact_sample_large": f"""SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY {_hex('o_orderkey', 1234)}, o_orderkey) AS rn,
  count(*) OVER () AS n FROM orders) WHERE rn <= n // 3""",
    "exact_sample_copies": f"""SELECT l_orderkey, count(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY {_hex('l_orderkey', 1234)}, l_orderkey) AS rn,
  count(*) OVER () AS n FROM lineitem) WHERE rn <= n // 3 GROUP BY 1""",
    "fraction_sample": f"SELECT doc_id, source FROM documents WHERE substr({_hex('doc_id', 11)}, 1, 8) {_BELOW_25}",
    "split_proper_calibration": f"""SELECT *, CASE WHEN substr({_hex('doc_id', 11)}, 1, 8) {_BELOW_30} THEN 'calibration' ELSE 'proper' END AS side
  FROM labels""",
    "split_stratified": f"""SELECT doc_id, quality, toxic, CASE WHEN rn <= ceil(round(0.3::DOUBLE * n, 9)) THEN 'calibration' ELSE 'proper' END AS side FROM (
  SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_hex('doc_id', 11)}, doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels)""",
    "score_histogram": _with(
        _POSES,
        _SPAN,
        """bins AS (SELECT least(CAST(floor((score - lo) / (hi - lo) * 10) AS BIGINT), 9) AS bin, count(*) AS n
  FROM poses, span WHERE score IS NOT NULL GROUP BY 1)""",
    )
    + """SELECT k AS bin, round(lo + (hi - lo) * k / 10, 6) AS low, round(CASE WHEN k = 9 THEN hi ELSE lo + (hi - lo) * (k + 1) / 10 END, 6) AS high,
  coalesce(n, 0) AS n FROM range(10) r(k) LEFT JOIN bins ON bin = k, span""",
    "label_extremes": _with(_POSES, _SPAN)
    + """SELECT row_key, mol_id, score, CASE WHEN score <= lo + (hi - lo) * 1 / 10 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS label FROM poses, span
  WHERE score <= lo + (hi - lo) * 1 / 10 OR score >= lo + (hi - lo) * 4 / 10""",
    "sdf_split": _with(_DIGITS, _CONFORMERS)
    + """SELECT k AS o_orderkey, 'order ' || CAST(k AS VARCHAR) AS mol_id,
  4 + len(d) + len(d) - 1 + CASE WHEN d[len(d)] % 2 = 0 THEN 1 ELSE 0 END + 8 AS n_lines FROM conf""",
    "sdf_tags": _with(_DIGITS, _CONFORMERS, _SCORED_CONF)
    + "SELECT mol_id, true AS parse_ok, 2::BIGINT AS n_tags, score_text, prio AS priority, score FROM scored",
    "sdf_atoms": _with(*_MOLECULE, _CONFORMERS)
    + """SELECT 'order ' || CAST(a.k AS VARCHAR) AS mol_id, '  rendered' AS header, count(*) AS n_atoms,
  string_agg(e, ',' ORDER BY i) AS elements, string_agg(CAST(charge AS VARCHAR), ',' ORDER BY i) AS charges,
  string_agg(CAST(parity AS VARCHAR), ',' ORDER BY i) AS parities, round(sum(i * 1.5), 4)::DOUBLE AS sum_x,
  round(sum(x + 0.5 * (conformer - 1)), 4)::DOUBLE AS sum_y
  FROM atoms a JOIN (VALUES (1), (2)) c(conformer) ON true GROUP BY a.k, conformer""",
    "sdf_bonds": _with(*_MOLECULE)
    + """SELECT 'order ' || CAST(k AS VARCHAR) AS mol_id, count(*) AS n_bonds,
  string_agg(CASE WHEN b = 1 THEN '1-' || CAST(a AS VARCHAR) ELSE CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) END
    || '-' || CAST(ord AS VARCHAR), ',' ORDER BY a, b DESC) AS bond_text
  FROM bonds, (VALUES (1), (2)) c(conformer) GROUP BY k, conformer""",
    "sdf_write_tag": _with(_DIGITS, _CONFORMERS, _SCORED_CONF)
    + """SELECT mol_id, true AS parse_ok, CAST(len(d) AS BIGINT) AS n_atoms, CASE WHEN score > 50000 THEN '1.0' ELSE '0.0' END AS label_text,
  score_text, NULL::VARCHAR AS priority FROM scored""",
    "sdf_file_poses": _with(_DIGITS, _CONFORMERS, _SCORED_CONF) + "SELECT mol_id, max(score) AS score FROM scored GROUP BY mol_id",
    "top_of_file": _with(_DIGITS, _CONFORMERS, _SCORED_CONF)
    + """SELECT score, count(*) AS hits, count(*) AS ids, count(*) AS texts FROM (
  SELECT max(score) AS score FROM scored GROUP BY mol_id ORDER BY score DESC NULLS LAST LIMIT 100) GROUP BY score""",
    "compare_files": """SELECT 4 * count(*) AS pair_matches, count(*) AS distinct_matches, round(4 * count(*) / 1000.0 * 100.0, 6) AS percent
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""",
    "signed_records": _with(
        *_SIGNATURES,
        "named AS (SELECT 'order ' || CAST(k AS VARCHAR) AS k, s FROM sigs)",
        "universe AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS sig_id FROM (SELECT DISTINCT s FROM named))",
    ).rstrip()
    + ",\n"
    + _vectors("SELECT 'order ' || CAST(o_orderkey AS VARCHAR) AS row_key FROM orders", "k", "named").replace(
        "SELECT r.row_key", "SELECT 2::BIGINT AS records, r.row_key"
    ),
    "sample_of_file": """SELECT what, least(2 * count(*), 100) AS records, least(2 * count(*), 100) AS texts
  FROM orders, (VALUES ('sample'), ('first')) w(what) GROUP BY what""",
    "report_in_one_file": _with(_POSES, _BEST, _TOP)
    + """SELECT CAST(mol_id AS VARCHAR) || ' ' || CAST(row_key AS VARCHAR) AS value,
  row_number() OVER (ORDER BY score DESC NULLS LAST, row_key) - 1 AS place, 1::BIGINT AS files FROM top""",
    "fewer_files": "SELECT 3::BIGINT AS files, count(*) AS n FROM events",
    "external_records": _with(_DIGITS, _CONFORMERS, _SCORED_CONF)
    + """SELECT mol_id, 2.0::DOUBLE * any_value(len(d)) AS score, count(*) AS records, CAST(any_value(len(d)) AS BIGINT) AS n
  FROM scored WHERE len(d) % 3 <> 0 GROUP BY mol_id""",
    "saved_records": _with(_DIGITS, _CONFORMERS, _SCORED_CONF)
    + "SELECT mol_id, max(score) AS score, CAST(count(*) AS DOUBLE) AS labels FROM scored GROUP BY mol_id",
    "record_count": "SELECT 2 * count(*) AS n_records FROM orders",
    "smiles_split": _with(_DIGITS, _SMILES) + "SELECT smiles, title FROM smi",
    "smiles_descriptors": _with(_DIGITS, _SMILES, _SMILES_DESC)
    + """SELECT title, heavy_atoms, carbons, hetero_atoms, charge_sum, charge_count, CAST(rings AS BIGINT) AS rings,
  round(hetero_atoms / carbons::DOUBLE, 6) AS hetero_carbon_ratio, array_to_string(els, ',') AS elements FROM sd""",
    "standardise": _with(_DIGITS, _SMILES, _SMILES_DESC)
    + """SELECT smiles, title FROM sd WHERE heavy_atoms <= 22 AND carbons >= 6 AND charge_count <= 3 AND charge_sum >= 0
  AND len(list_filter(els, lambda e: e NOT IN ('C', 'N', 'O', 'S', 'P', 'Cl', 'Br'))) = 0""",
    "graph_signatures": _with(*_SIGNATURES)
    + """SELECT CAST(k AS VARCHAR) AS row_key, count(*) FILTER (height = 1) AS n_h1, count(*) FILTER (height = 2) AS n_h2,
  count(*) FILTER (height = 3) AS n_h3,
  md5(string_agg(CAST(height AS VARCHAR) || ':' || s, ';' ORDER BY CAST(height AS VARCHAR) || ':' || s)) AS all_signatures FROM sigs GROUP BY k""",
    "signature_counts": _with(*_SIGNATURES)
    + "SELECT height, s AS signature, count(*) AS occurrences, count(DISTINCT k) AS molecules FROM sigs GROUP BY height, s",
    "signature_universe": _with(_GRAMS, "u AS (SELECT DISTINCT s FROM grams)")
    + "SELECT s AS signature, row_number() OVER (ORDER BY s) - 1 AS sig_id FROM u",
    "universe_roundtrip": _with(_GRAMS, "u AS (SELECT DISTINCT s FROM grams)")
    + "SELECT s AS signature, row_number() OVER (ORDER BY s) - 1 AS sig_id FROM u",
    "graph_universe": _with(*_SIGNATURES) + "SELECT count(DISTINCT s) AS size FROM sigs",
    "frozen_vectors": _with(_GRAMS, _GRAM_UNIVERSE, _vectors("SELECT doc_id AS row_key FROM documents", "doc_id", "grams")),
    "frozen_vectors_shuffled": _with(_GRAMS, _GRAM_UNIVERSE, _vectors("SELECT doc_id AS row_key FROM documents", "doc_id", "grams")),
    "universe_extended": _with(_GRAMS, _GRAM_UNIVERSE, "more AS (SELECT DISTINCT s FROM grams WHERE s NOT IN (SELECT s FROM universe))")
    + """SELECT s AS signature, sig_id FROM universe
  UNION ALL SELECT s, (SELECT count(*) FROM universe) + row_number() OVER (ORDER BY s) - 1 FROM more""",
    "graph_vectors": _with(
        *_SIGNATURES,
        "named AS (SELECT CAST(k AS VARCHAR) AS k, s FROM sigs)",
        "universe AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS sig_id FROM (SELECT DISTINCT s FROM named))",
        _vectors("SELECT CAST(o_orderkey AS VARCHAR) AS row_key FROM orders", "k", "named"),
    ),
    "vector_text_roundtrip": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 1000) + 0.0::DOUBLE) AS e FROM embeddings),
f AS (SELECT vec_id, len(e) AS size, list_filter(range(0, len(e)), lambda i: e[i + 1] <> 0) AS ids, e FROM e),
g AS (SELECT vec_id, size, ids, list_transform(ids, lambda i: e[i + 1]) AS vals FROM f)
SELECT vec_id, '(' || CAST(size AS VARCHAR) || ',[' || array_to_string(ids, ',') || '],[' || array_to_string(vals, ',') || '])' AS text,
  size, len(ids) AS n_ids, array_to_string(ids, ' ') AS ids, coalesce(list_sum(vals), 0.0) AS sum_vals FROM g""",
    "descriptors": _with(*_DESC)
    + """SELECT CAST(k AS VARCHAR) AS row_key, round(mol_weight, 4)::DOUBLE AS mol_weight, round(hetero_carbon_ratio, 6) AS hetero_carbon_ratio,
  heavy_atoms, carbons, hetero_atoms, charge_sum, charge_count, donors, acceptors, CAST(rings AS BIGINT) AS rings, chiral_centers,
  array_to_string(els, ',') AS elements FROM desc_ratio""",
    "rule_filter": _with(*_RULED)
    + """SELECT CAST(k AS VARCHAR) AS row_key, 'order ' || CAST(k AS VARCHAR) AS mol_id FROM checked c
  WHERE NOT EXISTS (SELECT 1 FROM violated v WHERE v.k = c.k)""",
    "rule_violations": _with(*_RULED)
    + "SELECT CAST(k AS VARCHAR) AS row_key, rule, round(value, 4)::DOUBLE AS value, low::DOUBLE AS low, high::DOUBLE AS high FROM violated",
    "preset_filter": _with(*_DESC)
    + """SELECT CAST(k AS VARCHAR) AS row_key, 'order ' || CAST(k AS VARCHAR) AS mol_id FROM desc_ratio
  WHERE mol_weight BETWEEN 150 AND 350 AND heavy_atoms BETWEEN 5 AND 26 AND carbons >= 3 AND rings <= 4 AND donors <= 4
  AND acceptors <= 8 AND charge_sum BETWEEN -2 AND 2""",
    "preset_drug": _with(*_DESC)
    + """SELECT CAST(k AS VARCHAR) AS row_key, 'order ' || CAST(k AS VARCHAR) AS mol_id FROM desc_ratio
  WHERE mol_weight BETWEEN 200 AND 500 AND carbons >= 5 AND rings <= 7 AND donors <= 5 AND acceptors <= 10 AND charge_sum BETWEEN -2 AND 2
  AND len(list_filter(els, lambda e: e NOT IN ('H', 'B', 'C', 'N', 'O', 'F', 'P', 'S', 'Cl', 'Br', 'I'))) = 0""",
    "rules_from_files": _with(*_RULED)
    + """SELECT CAST(k AS VARCHAR) AS row_key, 'order ' || CAST(k AS VARCHAR) AS mol_id FROM checked c
  WHERE NOT EXISTS (SELECT 1 FROM violated v WHERE v.k = c.k)""",
    "filter_score_sort": _with(*_RULED)
    + """SELECT CAST(k AS VARCHAR) AS row_key, 'order ' || CAST(k AS VARCHAR) AS mol_id, CAST(k % 97 AS DOUBLE) AS score FROM checked c
  WHERE NOT EXISTS (SELECT 1 FROM violated v WHERE v.k = c.k) ORDER BY k % 97 DESC, CAST(k AS VARCHAR) LIMIT 50""",
    "element_lists": _with(*_DESC)
    + """SELECT CAST(k AS VARCHAR) AS row_key, array_to_string(els, ',') AS elements FROM desc_ratio
  WHERE NOT list_has_any(els, ['Cl', 'F', 'P'])""",
    "path_motifs": _with(*_MOLECULE, _STEPS, *_MOTIF_CTES.values())
    + f"SELECT CAST(dig.k AS VARCHAR) AS row_key, {_motif_columns(_MOTIF_CTES)} FROM dig {_motif_joins(_MOTIF_CTES, 'dig.k')}",
    "target_name": r"SELECT page_id, regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1) AS name FROM pages",
    "conformal_p_values": _P_VALUES,
    "conformal_p_values_sorted": _P_VALUES,
    "conformal_p_values_nulls": _P_VALUES_NULLS,
    "conformal_p_values_nulls_sorted": _P_VALUES_NULLS,
    "margins_shuffled": f"WITH {_MARGINS} SELECT row_key, round(margin, 6) AS margin FROM margins",
    "predict_new_molecules": _with(
        *_SIGNATURES,
        "universe AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS sig_id FROM (SELECT DISTINCT s FROM sigs WHERE height < 3))",
        """found AS (SELECT k, sum((sig_id * 29) % 13 - 6) AS total FROM sigs JOIN universe USING (s) GROUP BY k)""",
        """m AS (SELECT CAST(o_orderkey AS VARCHAR) AS row_key, CAST(coalesce(total, 0) AS DOUBLE) + 0.25 AS margin
  FROM orders LEFT JOIN found ON k = o_orderkey)""",
        "cal AS (SELECT id % 2 AS label, CAST((id * 7) % 41 - 20 AS DOUBLE) AS alpha FROM range(40) r(id))",
        """test AS (SELECT row_key, margin, ((SELECT count(*) FROM cal WHERE label = 0 AND alpha >= m.margin) + 1.0) / 21.0 AS p0,
  ((SELECT count(*) FROM cal WHERE label = 1 AND alpha >= -m.margin) + 1.0) / 21.0 AS p1 FROM m)""",
        _sets(0.5),
    )
    + "SELECT row_key, round(margin, 6) AS margin, round(p0, 6) AS p0, round(p1, 6) AS p1, verdict FROM sets",
    "appended_scores": _with(_POSES)
    + f"""SELECT 'protein_a' AS r_name, '1abc' AS "r_pdbCode", CAST(mol_id AS VARCHAR) AS l_id, coalesce(score, {_FAILED}) AS l_score, run
  FROM poses, (VALUES ('first'), ('second')) r(run)""",
    "svm_sparse": "SELECT vec_id AS row_key, CAST(label >= 5 AS DOUBLE) AS label, label >= 5 AS above FROM embeddings",
    "logistic_sparse": "SELECT vec_id AS row_key, CAST(label >= 5 AS DOUBLE) AS label, label >= 5 AS above FROM embeddings",
    "screen_single_cycle_fixed": _with(*_screened(1)) + _SCORED_ROWS,
    "screen_two_cycles_fixed": _with(*_screened(2)) + _SCORED_ROWS,
    "screen_cycles_fixed": _with(*_screened(2))
    + " UNION ALL ".join(
        f"""SELECT {i}::BIGINT AS cycle, (SELECT count(*) FROM s{i}) AS sampled, (SELECT count(*) FROM t{i}) AS labelled, true AS trained,
  round((SELECT count(*) FILTER (one) / count(*)::DOUBLE FROM v{i}), 6) AS efficiency"""
        for i in (1, 2)
    ),
    "learned_screening_tables": _with(
        *_screened(2), "top AS (SELECT mol_id, score FROM scored ORDER BY score DESC, row_key LIMIT 30)"
    )
    + f"""SELECT 'prediction' AS what, mol_id AS name, verdict AS text, NULL::DOUBLE AS value FROM v2
  UNION ALL SELECT 'score', mol_id, 'protein_a', round(score, 6) FROM scored
  UNION ALL SELECT 'hit', mol_id, NULL, round(score, 6) FROM top
  UNION ALL SELECT 'weight', CAST(i - 1 AS VARCHAR), 'protein_a', {_numbers(S.MODEL_WEIGHTS)}[i] FROM range(1, 65) r(i) WHERE {_numbers(S.MODEL_WEIGHTS)}[i] <> 0
  UNION ALL SELECT 'overlap', 'percent', NULL, round(count(*) / 30.0 * 100.0, 6)::DOUBLE FROM top""",
    "nonconformity": f"""WITH {_MARGINS} SELECT CAST(label AS BIGINT) AS label, round(CASE WHEN label = 1 THEN -margin ELSE margin END, 6) AS alpha
  FROM margins""",
    "prediction_sets": f"""WITH {_CONFORMAL}, {_sets(0.2)} SELECT row_key,
  CASE WHEN in0 AND in1 THEN '0,1' WHEN in0 THEN '0' WHEN in1 THEN '1' ELSE '' END AS pred_set FROM sets""",
    "verdicts": f"WITH {_CONFORMAL}, {_sets(0.2)} SELECT row_key, verdict FROM sets",
    "efficiency": f"""WITH {_CONFORMAL}, {_sets(0.2)} SELECT count(*) FILTER (in0 <> in1) AS singletons, count(*) AS total,
  round(count(*) FILTER (in0 <> in1) / count(*)::DOUBLE, 6) AS efficiency FROM sets""",
    "score_with_stored_model": f"""WITH {_CONFORMAL}, {_sets(0.5)} SELECT row_key, round(p0, 6) AS p0, round(p1, 6) AS p1, verdict FROM sets""",
    "prediction_rows": f"""WITH {_CONFORMAL}, {_sets(0.2)} SELECT 'protein_a' AS r_name, '1abc' AS "r_pdbCode",
  'vec ' || CAST(row_key AS VARCHAR) AS l_id, verdict AS l_prediction FROM sets""",
    "score_rows": _with(_POSES)
    + f"""SELECT 'protein_a' AS r_name, '1abc' AS "r_pdbCode", CAST(mol_id AS VARCHAR) AS l_id, coalesce(score, {_FAILED}) AS l_score FROM poses""",
    "external_scorer": "SELECT event_id AS row_key, CASE WHEN value >= 1.0 THEN round(2.0::DOUBLE * value + 1.0::DOUBLE, 6) END AS score FROM events",
    "plain_screening": _with(
        _POSES,
        f"""kept AS (SELECT * FROM poses WHERE substr({_hex('row_key', 11)}, 1, 8) {_BELOW_25})""",
        _BEST.replace("FROM poses)", "FROM kept)"),
        _TOP,
    )
    + "SELECT mol_id, score, row_key FROM top",
}
