"""Dictionaries of categories, and sequences encoded by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T

PADDING, OOV = "$PADDING$", "$OOV$"


def as_text(value: Column, data_type: str = "string") -> Column:
    """A category as the text that it sorts by: null is ``None``, truth values begin with a capital."""
    text = F.initcap(value.cast("string")) if data_type == "boolean" else value.cast("string")
    return F.coalesce(text, F.lit("None"))


def dictionary(values: DataFrame, padding: bool = True, oov: bool = False) -> DataFrame:
    """(value, code) for the distinct values of a one-column table, nulls too.

    Codes go up in order of the text, so numbers sort as text: -1, -2, 0, 1, 10, 2. Code 0 is the padding if
    there is one; the last one stands for all other values if asked for. Categories are a small table, whose
    order needs one task.
    """
    name, kind = values.dtypes[0]
    once = values.distinct().select(F.col(name).alias("value"), as_text(F.col(name), kind).alias("value_text"))
    code = F.row_number().over(Window.orderBy("value_text")) - (0 if padding else 1)
    coded = once.select(F.col("value_text").alias("value"), code.alias("code"))
    spark = values.sparkSession
    if padding:
        coded = coded.unionByName(spark.createDataFrame([(PADDING, 0)], "value string, code int"))
    if oov:
        coded = coded.unionByName(coded.agg(F.lit(OOV).alias("value"), (F.max("code") + 1).alias("code")))
    return coded


def integer_dictionary(spark, left: int, right: int, labels: list[str] = (), padding: bool = True, log: bool = False) -> DataFrame:
    """The dictionary of clipped integers from one below ``left`` to one above ``right``, and labels."""
    values = sorted({v for v in range(left - 1, right + 2)})
    if log:
        values = sorted({(v > 0) * v.bit_length() - (v < 0) * v.bit_length() for v in values})
    return dictionary(spark.createDataFrame([(str(v),) for v in values] + [(x,) for x in labels], "value string"), padding)


def reverse(coded: DataFrame) -> DataFrame:
    """(code, value); two values of one code are an error."""
    grouped = coded.groupBy("code").agg(F.min("value").alias("value"), F.count("*").alias("n"))
    return grouped.select("code", F.when(F.assert_true(F.col("n") == 1, F.lit("two values have one code")).isNull(), F.col("value")).alias("value"))


def encode(df: DataFrame, column: str, coded: DataFrame, out: str, oov: bool = False) -> DataFrame:
    """Add the code of a column's value; an unknown value gets the code of ``$OOV$``, or is an error.

    The dictionary is joined without a hint, so that Spark broadcasts it if it is as small as it should be.
    """
    key = as_text(F.col(column), dict(df.dtypes)[column])
    joined = df.withColumn("_key", key).join(coded.select(F.col("value").alias("_key"), F.col("code").alias("_code")), "_key", "left")
    if oov:
        unknown = coded.where(F.col("value") == OOV).first()["code"]
        return joined.withColumn(out, F.coalesce("_code", F.lit(unknown))).drop("_key", "_code")
    checked = F.when(F.assert_true(F.col("_code").isNotNull(), F.lit("a value isn't in the dictionary")).isNull(), F.col("_code"))
    return joined.withColumn(out, checked).drop("_key", "_code")


def encode_sequence(sequence: Column, codes: dict[str, int]) -> Column:
    """An array's elements by a dictionary that is a literal of the plan; for small vocabularies."""
    lookup = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    return F.transform(sequence, lambda x: F.element_at(lookup, F.coalesce(x.cast("string"), F.lit("None"))))


def characters(tokens: DataFrame) -> DataFrame:
    """(char): the distinct characters of all tokens."""
    return tokens.select(F.explode(F.split("token", "")).alias("char")).where("char <> ''").distinct()


def vocabulary(tokens: DataFrame | None, model: DataFrame | None = None, **flags: bool) -> DataFrame:
    """(token): normalised tokens of documents, if given, and the tokens of an embeddings model, if given."""
    parts = []
    if tokens is not None:
        parts.append(tokens.select(T.normalize(F.col("token"), **flags).alias("token")).distinct())
    if model is not None:
        parts.append(model.select("token"))
    if not parts:
        raise ValueError("neither tokens nor a model are given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def initial_vectors(words: DataFrame, model: DataFrame, size: int, trainable: bool, seed: int = 0) -> DataFrame:
    """(token, vector): the model's vector, else random ones of a width that fits the size, or zeros."""
    joined = words.join(model.select("token", "vector"), "token", "left")
    bound = (3.0 / size) ** 0.5
    if trainable:
        unit = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.col("token"), i), F.lit(1 << 30)) / F.lit(float(1 << 30)) * 2 - 1) * bound)
    else:
        unit = F.array_repeat(F.lit(0.0), size)
    return joined.select("token", F.coalesce("vector", unit).alias("vector"))


def feature_config(sizes: dict[str, int]) -> dict[str, str]:
    """From sizes to what a feature is: off below zero, one-hot at zero, else embedded; sorted by name."""
    return {k: "one_hot" if v == 0 else "embedded" for k, v in sorted(sizes.items()) if v >= 0}
