"""Columns each stage needs, and the check that a table has them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_INT, _LONG, _TEXT, _NUMBER = T.IntegerType(), T.LongType(), T.StringType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ATOM = _struct(idx=_INT, x=_NUMBER, y=_NUMBER, z=_NUMBER, element=_TEXT, charge=_INT, parity=_INT)
BOND = _struct(a=_INT, b=_INT, ord=_INT, stereo=_INT)
FEATURES = _struct(size=_LONG, ids=T.ArrayType(_LONG), vals=T.ArrayType(_NUMBER))

STAGES = {
    "smiles": _struct(smiles=_TEXT, title=_TEXT),
    "molecule": _struct(
        row_key=_TEXT,
        mol_id=_TEXT,
        raw=_TEXT,
        atoms=T.ArrayType(ATOM),
        bonds=T.ArrayType(BOND),
        tags=T.MapType(_TEXT, _TEXT),
    ),
    "pose": _struct(row_key=_TEXT, mol_id=_TEXT, score=_NUMBER),
    "candidate": _struct(row_key=_TEXT, mol_id=_TEXT, features=FEATURES),
    "universe": _struct(signature=_TEXT, sig_id=_LONG),
    "labelled": _struct(row_key=_TEXT, label=_NUMBER, features=FEATURES),
}

# The two output tables, column for column.
DB_PREDICTIONS = T.StructType(
    [
        T.StructField("r_name", T.StringType(), False),
        T.StructField("r_pdbCode", T.StringType(), False),
        T.StructField("l_id", T.StringType(), False),
        T.StructField("l_prediction", T.StringType(), False),
    ]
)
DB_SCORES = T.StructType(
    [
        T.StructField("r_name", T.StringType(), False),
        T.StructField("r_pdbCode", T.StringType(), False),
        T.StructField("l_id", T.StringType(), False),
        T.StructField("l_score", T.DoubleType(), False),
    ]
)


def require(df: DataFrame, stage: str) -> DataFrame:
    """``df`` itself, or ValueError naming the columns it lacks for ``stage``.

    Only names and kinds (number, text, array, ...) are compared: keys may be numbers or text.
    """
    wanted = STAGES[stage]
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in wanted.fields if f.name not in have]
    if missing:
        raise ValueError(f"stage '{stage}' needs the columns {missing}; got {df.columns}")
    for field in wanted.fields:
        nested = (T.ArrayType, T.MapType, T.StructType)
        if isinstance(field.dataType, nested) and not isinstance(have[field.name], type(field.dataType)):
            raise ValueError(f"column '{field.name}' of stage '{stage}' is {have[field.name].simpleString()}")
    return df


def union_stage(dfs: list[DataFrame], stage: str) -> DataFrame:
    """One table of a stage out of several, duplicates kept."""
    if not dfs:
        raise ValueError("no tables to unite")
    return reduce(DataFrame.unionByName, [require(df, stage) for df in dfs])
