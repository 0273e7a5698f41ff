"""Vectors, pooling, losses, decoding by given weights, and trainable classifiers for tables of samples.

Neural encoders are not trained here: samples and features are the same tables, and ``pyspark.ml`` models stand
in for networks. A supplied model runs as a function over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed_vector(token: Column, size: int = 16, n: int = 3) -> Column:
    """A vector for any token: the mean of hashed vectors of its character n-grams, between word marks."""
    marked = F.concat(F.lit("<"), token, F.lit(">"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1))), lambda i: F.substring(marked, i, F.lit(n)))
    unit = lambda g, k: (F.pmod(F.xxhash64(g, k), F.lit(2001)) - 1000) / F.lit(1000.0)
    one = lambda k: F.aggregate(grams, F.lit(0.0), lambda s, g: s + unit(g, k)) / F.size(grams)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), one)


def concat_vectors(*vectors: Column) -> Column:
    """Several vectorizers' results as one vector."""
    return F.concat(*vectors)


def plug_in(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Run an external model over batches; ``load`` is called once a task and gives the function for a batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            yield model(frame)

    return df.mapInPandas(run, schema)


def pool(vectors: Column, how: str = "max", index: Column | None = None) -> Column:
    """The element-wise maximum or mean of an array of equally long vectors, or the vector at an index."""
    if how == "indexed":
        return F.get(vectors, index)
    rest, first = F.slice(vectors, 2, F.size(vectors)), F.get(vectors, F.lit(0))
    if how == "max":
        return F.aggregate(rest, first, lambda a, v: F.zip_with(a, v, lambda x, y: F.greatest(x, y)))
    total = F.aggregate(rest, first, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(vectors))


def _let(value: Column, body) -> Column:
    """A body that uses a value many times but computes it once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _matrix(rows: list[list[float]]) -> Column:
    return F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in rows))


def softmax(values: Column) -> Column:
    """Shares of an array of numbers, by their exponentials."""
    parts = lambda top: F.transform(values, lambda x: F.exp(x - top))
    return _let(_let(F.array_max(values), parts), lambda ps: _let(F.aggregate(ps, F.lit(0.0), lambda s, x: s + x), lambda t: F.transform(ps, lambda x: x / t)))


def attend(states: Column, query: Column, weights: dict[str, list]) -> Column:
    """Pooling of an array of vectors, of any number, by attention to a query vector.

    Each vector's energy is s·M·q with the matrix ``score``, or with ``state`` and ``query`` matrices v·tanh(W s + U q) for the
    vector ``score``; what comes out is their sum weighted by the softmax of the energies. Null for an empty array.
    """
    times = lambda matrix, vector: F.transform(matrix, lambda row: _dot(row, vector))
    if "state" in weights:
        score = F.array(*(F.lit(float(x)) for x in weights["score"]))
        turned = times(_matrix(weights["query"]), query)
        energy = lambda q: F.transform(states, lambda s: _dot(score, F.transform(F.zip_with(times(_matrix(weights["state"]), s), q, lambda x, y: x + y), F.tanh)))
    else:
        turned = times(_matrix(weights["score"]), query)
        energy = lambda q: F.transform(states, lambda s: _dot(s, q))

    def pooled(shares: Column) -> Column:
        scaled = F.zip_with(states, shares, lambda s, w: F.transform(s, lambda x: x * w))
        return F.aggregate(F.slice(scaled, 2, F.size(scaled)), F.get(scaled, F.lit(0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))

    return F.when(F.size(states) > 0, _let(_let(turned, lambda q: softmax(energy(q))), pooled))


def masked_softmax(logits: Column, mask: Column) -> Column:
    """Probabilities of an array of logits; those with mask 0 get none."""

    def shares(kept: Column) -> Column:
        parts = lambda top: F.transform(kept, lambda x: F.coalesce(F.exp(x - top), F.lit(0.0)))
        total = lambda ps: F.aggregate(ps, F.lit(0.0), lambda s, x: s + x)
        return _let(_let(F.array_max(kept), parts), lambda ps: _let(total(ps), lambda t: F.transform(ps, lambda x: x / t)))

    return _let(F.zip_with(logits, mask, lambda x, m: F.when(m == 1, x)), shares)


def cross_entropy(logits: Column, mask: Column, label: Column) -> Column:
    return -F.log(F.get(masked_softmax(logits, mask), label))


def sigmoid_cross_entropy(logits: Column, gold: Column) -> Column:
    """The mean over labels, each for itself; ``gold`` is 0 or 1 for each."""
    parts = F.zip_with(logits, gold, lambda x, y: F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x))))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(logits)


def margin_loss(scores: Column, label: Column, positive: float = 2.5, negative: float = 0.5, scale: float = 2.0) -> Column:
    """The pairwise ranking loss: the gold score above one margin, the best wrong one below another."""
    right = F.get(scores, label)
    wrong = F.array_max(F.filter(scores, lambda x, i: i != label))
    return F.log1p(F.exp(scale * (positive - right))) + F.log1p(F.exp(scale * (negative + wrong)))


def l2_loss(weights: Column, share: float) -> Column:
    """Half the sum of squares of an array of weights, times ``share``."""
    return F.aggregate(F.transform(weights, lambda x: x * x), F.lit(0.0), lambda s, x: s + x) * share / 2


def crf_loss(emissions: np.ndarray, transitions: np.ndarray, tags: np.ndarray) -> float:
    """The negative log-likelihood of a tag sequence in a linear-chain model with (time, tags) emissions and (from, to) transitions."""
    forward = emissions[0]
    for row in emissions[1:]:
        moved = forward[:, None] + transitions
        top = moved.max(0)
        forward = top + np.log(np.exp(moved - top).sum(0)) + row
    gold = emissions[np.arange(len(tags)), tags].sum() + transitions[tags[:-1], tags[1:]].sum()
    top = forward.max()
    return float(top + np.log(np.exp(forward - top).sum()) - gold)


def distance_loss(states: np.ndarray, labels: np.ndarray, embeddings: np.ndarray) -> float:
    """The mean of 1 + the distance of a state to its label's embedding - the greatest distance to another label's, both of unit length."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    far = np.linalg.norm(unit(states)[:, None] - unit(embeddings)[None], axis=-1)
    own = far[np.arange(len(labels)), labels]
    far[np.arange(len(labels)), labels] = -np.inf
    return float((1 + own - far.max(1)).mean())


def viterbi(emissions: np.ndarray, transitions: np.ndarray) -> list[int]:
    """The best tag sequence of a linear-chain model with (time, tags) emissions and (from, to) transitions."""
    score, back = emissions[0], []
    for row in emissions[1:]:
        options = score[:, None] + transitions
        back.append(options.argmax(0))
        score = options.max(0) + row
    path = [int(score.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def sentence_samples(tokens: DataFrame, features: list[str]) -> DataFrame:
    """A sample for each sentence: its features as arrays in order, and ``seq_len``."""
    rows = F.array_sort(F.collect_list(F.struct("tok_idx", *features)))
    grouped = tokens.groupBy("doc_id", "sent_idx").agg(rows.alias("rows"))
    return grouped.select("doc_id", "sent_idx", *(F.col("rows")[f].alias(f) for f in features), F.size("rows").alias("seq_len"))


def pair_samples(pairs: DataFrame, tokens: DataFrame, sentences: DataFrame, features: list[str]) -> DataFrame:
    """A sample for each pair: features of all sentences from the first argument's to the last one's, and the arguments' places in it."""
    low, high = F.least("e1.sent_idx", "e2.sent_idx"), F.greatest("e1.sent_idx", "e2.sent_idx")
    s = sentences.select("doc_id", "sent_idx", F.col("start_token").alias("w_start"))
    e = sentences.select("doc_id", F.col("sent_idx").alias("sent_idx2"), F.col("end_token").alias("w_end"))
    window = pairs.withColumns({"sent_idx": low, "sent_idx2": high}).join(s, ["doc_id", "sent_idx"]).join(e, ["doc_id", "sent_idx2"])
    spans = window.select("doc_id", "w_start", "w_end").distinct()
    covered = spans.withColumn("tok_idx", F.explode(F.sequence("w_start", F.col("w_end") - 1))).join(tokens.select("doc_id", "tok_idx", *features), ["doc_id", "tok_idx"])
    rows = covered.groupBy("doc_id", "w_start", "w_end").agg(F.array_sort(F.collect_list(F.struct("tok_idx", *features))).alias("rows"))
    at = lambda k: F.array(*((F.col(f"{k}.{b}_token") - F.col("w_start")) for b in ("start", "end")))
    made = window.join(rows, ["doc_id", "w_start", "w_end"])
    return made.select("doc_id", "e1", "e2", *(c for c in ("label",) if c in pairs.columns), F.array(at("e1"), at("e2")).alias("indices"), *(F.col("rows")[f].alias(f) for f in features), F.size("rows").alias("seq_len"))


def group_samples(samples: DataFrame, group: list[str], shared: list[str], features: list[str]) -> DataFrame:
    """Samples of a group as one, with ``chain_len``; columns that must agree in a group are checked."""
    agree = [F.when(F.assert_true(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("None"))) <= 1, F.lit(f"{c} differs within a group")).isNull(), F.first(c)).alias(c) for c in shared]
    return samples.groupBy(*group).agg(*agree, F.count("*").alias("chain_len"), *(F.collect_list(f).alias(f) for f in features))


def trainer(features: list[str], label: str, size: int = 1 << 12) -> Pipeline:
    """An estimator over columns of any type: hashed features and a multinomial linear model."""
    index = StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="keep", stringOrderType="alphabetAsc")
    hashed = FeatureHasher(inputCols=features, outputCol="hashed", numFeatures=size)
    return Pipeline(stages=[index, hashed, LogisticRegression(featuresCol="hashed", labelCol="label_index", maxIter=20, regParam=0.01)])


def predict(model: PipelineModel, df: DataFrame, out: str = "prediction_label") -> DataFrame:
    """The predicted label, as text; rows where the training had a single label for their type can be given apart."""
    names = F.array(*(F.lit(x) for x in [*model.stages[0].labels, "__unknown"]))
    return model.transform(df).withColumn(out, F.get(names, F.col("prediction").cast("int"))).drop("label_index", "hashed", "rawPrediction", "probability", "prediction")


def with_constant_answers(df: DataFrame, single: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str = "label") -> DataFrame:
    """Rows whose type always has one label get it; the others go through the model. ``single`` is (type, only)."""
    known = df.join(single.select("type", F.col("only").alias(out)), "type")
    return known.unionByName(answer(df.join(single.select("type"), "type", "left_anti")), allowMissingColumns=True)


def retyped(mentions: DataFrame, predicted: DataFrame) -> DataFrame:
    """Mentions with the type that a second classifier gives; without one they keep theirs."""
    new = predicted.select("doc_id", "ent_id", F.col("type").alias("new_type"))
    return mentions.join(new, ["doc_id", "ent_id"], "left").withColumn("type", F.coalesce("new_type", "type")).drop("new_type")


def learning_rate(start: float, decay: float, epoch: int) -> float:
    return start / (1 + (epoch - 1) * decay)


def schedule(frequencies: dict[str, int]) -> list[str]:
    """One round of a multitask schedule: each task as often as it says, in turns."""
    rounds = max(frequencies.values(), default=0)
    return [task for i in range(rounds) for task, n in frequencies.items() if i < n]


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: reduce(lambda x, f: f(x), steps, df)
