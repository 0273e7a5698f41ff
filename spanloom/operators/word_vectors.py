"""Word vectors of several models beside each other, as features of tokens.

A model's vectors are kept as a table bucketed and sorted by word, written once. A vocabulary that is dealt into as many buckets
meets any number of such tables without their being shuffled again. Words get codes in order, for vectors as the rows of a
matrix; words that a model lacks get vectors by rule, zeros or, where they are to be trained, random ones from a hash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators.sampling import with_place

#: Codes of padding, and the mark of words that are in no vocabulary, whose code is the last.
PADDING, OOV = "$PADDING$", "$OOV$"


@dataclass(frozen=True)
class Source:
    """A model's table, how tokens are normalised to look them up in it, and whether its vectors are to be trained on."""

    table: str
    size: int
    trainable: bool = False
    flags: dict[str, bool] = field(default_factory=dict)

    def word(self) -> Column:
        return T.normalize(F.col("token"), **self.flags)


def keep(vectors: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Write (token, vector) as a table bucketed and sorted by word, in the warehouse or at a path; words should be distinct,
    as ``readers.vectors`` gives them."""
    dealt = vectors.select("token", "vector").repartition(buckets, "token").write.mode("overwrite").format("parquet")
    (dealt.option("path", path) if path else dealt).bucketBy(buckets, "token").sortBy("token").saveAsTable(table)


def looked_up(words: DataFrame, sources: list[Source]) -> DataFrame:
    """Distinct words (token) with ``vector_0``, ``vector_1``, ...: each model's vector, null where it has none.

    Words are shuffled once, into the models' buckets; the models' tables are read in place if they have equally many.
    """
    spark = words.sparkSession
    found = words.select("token").distinct()
    for k, source in enumerate(sources):
        model = spark.table(source.table).select("token", F.col("vector").alias(f"vector_{k}"))
        found = found.join(model.hint("merge"), "token", "left")
    return found


def matrix(tokens: DataFrame | None, source: Source, spark: SparkSession, seed: int = 0) -> DataFrame:
    """(token, code, vector): the rows of a model's matrix in order of code.

    The words are the model's own, and with vectors that are trained on those of the tokens too, which then get random
    vectors; padding has code 0 and the mark for unknown words the last one, with vectors by the same rule. Codes are
    places in order of words, from a range partitioning and counts of its parts.
    """
    model = spark.table(source.table).select("token", "vector")
    words = model
    if tokens is not None and source.trainable:
        own = tokens.select(source.word().alias("token")).distinct()
        words = own.join(model.hint("merge"), "token", "full_outer").select("token", "vector")
    placed = with_place(words, ["token"]).select("token", (F.col("place") + 1).alias("code"), "vector", (F.col("rows") + 1).alias("last"))
    n = placed.agg(F.coalesce(F.max("last"), F.lit(1))).first()[0]
    marks = spark.createDataFrame([(PADDING, 0), (OOV, n)], "token string, code long").withColumn("vector", F.lit(None).cast("array<double>"))
    rows = placed.select("token", F.col("code").cast("long").alias("code"), "vector").unionByName(marks)
    return rows.withColumn("vector", F.coalesce("vector", unknown(source, seed)))


def grams(word: Column, shortest: int, longest: int) -> Column:
    """All runs of so many characters of a word between its marks, and the whole of it."""
    marked = F.concat(F.lit("<"), word, F.lit(">"))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1))), lambda i: F.substring(marked, i, F.lit(n)))
    return F.array_append(F.flatten(F.array(*(of(n) for n in range(shortest, longest + 1)))), marked)


def bucket(gram: Column, buckets: int) -> Column:
    """The row of a matrix that a run of characters shares with others, by the first 24 bits of its md5."""
    return (F.conv(F.substring(F.md5(gram), 1, 6), 16, 10).cast("long") % buckets).cast("int")


def composed(words: DataFrame, matrix: DataFrame, buckets: int, shortest: int = 3, longest: int = 5) -> DataFrame:
    """(token, vector) for any distinct words: the mean of the vectors (bucket, vector) of all their runs of characters.

    Runs are counted by word and bucket first and meet the matrix's rows by bucket; sums are taken by word and dimension, so
    neither a word nor the matrix need be in one place. A bucket that the matrix lacks counts as zeros.
    """
    runs = words.select("token").distinct().select("token", F.explode(grams(F.col("token"), shortest, longest)).alias("gram"))
    counted = runs.groupBy("token", bucket(F.col("gram"), buckets).alias("bucket")).agg(F.count("*").alias("n"))
    sizes = counted.groupBy("token").agg(F.sum("n").alias("size"))
    parts = counted.join(matrix, "bucket").select("token", "n", F.posexplode("vector").alias("dim", "x"))
    sums = parts.groupBy("token", "dim").agg(F.sum(F.col("n") * F.col("x")).alias("sum")).join(sizes, "token")
    return sums.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", (F.col("sum") / F.col("size")).alias("x")))), lambda v: v["x"]).alias("vector"))


def unknown(source: Source, seed: int = 0) -> Column:
    """The vector of a word that a model lacks: zeros, or if it is trained random numbers of a width that fits the size."""
    if not source.trainable:
        return F.array_repeat(F.lit(0.0), source.size)
    bound = (3.0 / source.size) ** 0.5
    return F.transform(F.sequence(F.lit(1), F.lit(source.size)), lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.col("token"), i), F.lit(1 << 30)) / F.lit(float(1 << 30)) * 2 - 1) * bound)


def coded(tokens: DataFrame, sources: list[Source], matrices: list[DataFrame]) -> DataFrame:
    """Tokens with ``words_0``, ``words_1``, ...: each model's code of the token, that of unknown words where it has none.

    Distinct words are coded, and tokens get their codes from them, so a frequent word's vectors aren't shipped with each token.
    """
    out = tokens
    for k, (source, rows) in enumerate(zip(sources, matrices, strict=True)):
        codes = rows.select(F.col("token").alias("_word"), F.col("code").alias("_code"))
        last = codes.where(F.col("_word") == OOV).first()["_code"]
        marked = out.withColumn("_word", source.word())
        known = marked.select("_word").distinct().join(codes.where(~F.col("_word").isin(PADDING, OOV)), "_word")
        out = marked.join(known, "_word", "left").withColumn(f"words_{k}", F.coalesce("_code", F.lit(last))).drop("_word", "_code")
    return out
