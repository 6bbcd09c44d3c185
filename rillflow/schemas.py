"""Named schemas of rows at rest and in flight, and checks against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
DOUBLES, INTS, LONGS = T.ArrayType(T.DoubleType()), T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PROMPT = _schema(
    data_source=T.StringType(),
    prompt=MESSAGES,
    ability=T.StringType(),
    reward_model=_schema(style=T.StringType(), ground_truth=T.StringType()),
    extra_info=_schema(split=T.StringType(), index=T.LongType(), answer=T.StringType(), question=T.StringType()),
)
SFT = _schema(prompt=T.StringType(), response=T.StringType())
MULTI_TURN = _schema(messages=MESSAGES)
PREFERENCE = _schema(prompt=T.StringType(), chosen=T.StringType(), rejected=T.StringType())
ROLLOUT_DUMP = _schema(input=T.StringType(), output=T.StringType(), gts=T.StringType(), score=T.DoubleType(), step=T.LongType())
SEQUENCES = _schema(
    seq_id=T.LongType(), uid=T.LongType(), rewards=DOUBLES, values=DOUBLES, old_lp=DOUBLES, rollout_lp=DOUBLES, mask=INTS
)
METRICS = _schema(step=T.LongType(), metric=T.StringType(), value=T.DoubleType())


class SchemaError(ValueError):
    """A frame lacks a column, or has it in another type."""


def validate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` itself, if it has every field of ``schema`` in its type; more columns may be there."""
    own = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f.name for f in schema.fields if f.name not in own or own[f.name].simpleString() != f.dataType.simpleString()]
    if wrong:
        raise SchemaError(f"missing or of another type: {', '.join(wrong)}")
    return df


def describe(df: DataFrame) -> dict[str, str]:
    """Column to type, for logs."""
    return dict(df.dtypes)
