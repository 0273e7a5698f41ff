"""A quality classifier: naive Bayes log-count ratios scale n-gram indicators for a linear hinge-loss model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.store import materialise, wider
from spanloom.llm.words import pieces

#: Character n-grams are hashed into this many columns.
COLUMNS = 1 << 18
#: Lengths of the n-grams of characters, of character kinds, and of marks for words that repeat the one before.
LENGTHS = (1, 2, 3)
KIND_LENGTHS = (3, 4)
REPEAT_LENGTHS = (1, 2, 3, 4)
#: Labelled rows that are fitted on at most, those of smallest hash. The bound keeps the fit inside the driver.
TRAINING_ROWS = 12_000
#: Bytes of their indicators at most, a few thousand for a usual text and a million for the longest; rows past them aren't fitted on.
TRAINING_BYTES = 192 << 20
#: Bytes of text that are worked on at once; a longer text is worked on alone.
PIECE_BYTES = 4_000_000
#: Added to each count before ratios are taken.
SMOOTHING = 1.0
#: The share of the scaled weights against their mean magnitude.
INTERPOLATION = 0.25
#: Passes of the dual coordinate descent, and the most that one row's dual variable may reach.
PASSES = 12
COST = 1.0


def kind_table() -> np.ndarray:
    """For each code point below 0x3000 its kind: upper and lower case, digit, space, or else itself."""
    kinds = np.arange(0x3000, dtype=np.uint32) + 8
    for i in range(0x3000):
        c = chr(i)
        kinds[i] = 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else i + 8
    return kinds


def hashed_grams(codes: np.ndarray, lengths: tuple[int, ...], salt: int) -> list[np.ndarray]:
    """The columns of all runs of these lengths."""
    grams = []
    for n in lengths:
        h = np.full(max(0, len(codes) - n + 1), salt + n, np.uint32)
        for i in range(n if len(h) else 0):
            h = (h ^ codes[i : i + len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        grams.append(h >> np.uint32(32 - 18))
    return grams


def columns_of(text: str, kinds: np.ndarray) -> np.ndarray:
    """The distinct columns of all n-grams of the whole text, ascending."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    words = text.split()
    repeats = np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), np.uint32, max(0, len(words) - 1))
    grams = hashed_grams(codes, LENGTHS, 0)
    grams += hashed_grams(kinds[np.minimum(codes, len(kinds) - 1)], KIND_LENGTHS, 100)
    grams += hashed_grams(repeats, REPEAT_LENGTHS, 200)
    mark = np.zeros(COLUMNS, bool)
    mark[np.concatenate(grams)] = True
    return np.flatnonzero(mark)


@dataclass
class Model:
    """Weights by column, an offset, and the two numbers that turn a margin into a probability."""

    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def margin(self, columns: np.ndarray) -> float:
        """Indicators are scaled to length one, so that long texts don't get larger margins."""
        return float(self.weights[columns].sum() / np.sqrt(len(columns)) + self.offset) if len(columns) else self.offset

    def score(self, columns: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(columns) + self.shift, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """For each column the log of its share among good rows' indicators over that among bad rows'."""
    p, q = np.full(COLUMNS, SMOOTHING), np.full(COLUMNS, SMOOTHING)
    for columns, is_good in zip(rows, good, strict=True):
        (p if is_good else q)[columns] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of the linear hinge-loss model, one dual variable at a time in a fixed random order."""
    weights, offset, alpha = np.zeros(COLUMNS), 0.0, np.zeros(len(rows))
    squares = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(11)
    for _ in range(PASSES):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            columns, x, y = rows[i], values[i], signs[i]
            slack = y * (weights[columns] @ x + offset) - 1.0
            new = min(max(alpha[i] - slack / squares[i], 0.0), costs[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                weights[columns] += step * x
                offset += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights, offset


def calibrate(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, by Newton's steps."""
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, w = p - target, p * (1 - p) + 1e-9
        grad = np.array([g @ margins + 1e-6 * a, g.sum()])
        hess = np.array([[w @ margins**2 + 1e-6, w @ margins], [w @ margins, w.sum()]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def weigh(rows: list[np.ndarray], good: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the plain indicators, and the offset, of the interpolated model."""
    ratios = log_count_ratios(rows, good)
    values = [ratios[c] / np.sqrt(max(1, len(c))) for c in rows]
    signs = np.where(good, 1.0, -1.0)
    costs = COST * np.where(good, len(rows) / (2 * max(1, good.sum())), len(rows) / (2 * max(1, (~good).sum())))
    weights, offset = dual_coordinate_descent(rows, values, signs, costs)
    weights = (1 - INTERPOLATION) * np.abs(weights).mean() * np.sign(weights) + INTERPOLATION * weights
    return weights * ratios, INTERPOLATION * offset


def fit(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """Train on the columns of each row and whether it is good.

    Margins become probabilities by a curve through the margins that models of either half give the other.
    Where rows are of one class alone, or fewer than four, every score is the (smoothed) share of good rows.
    """
    share = (good.sum() + 1) / (len(rows) + 2)
    half = np.arange(len(rows)) % 2 == 0
    if any(part.all() or not part.any() for part in (good, good[half], good[~half])):
        return Model(np.zeros(COLUMNS), 0.0, 0.0, float(np.log(share / (1 - share))))
    margins = np.zeros(len(rows))
    for side in (half, ~half):
        part = Model(*weigh([rows[i] for i in np.flatnonzero(side)], good[side]), 1.0, 0.0)
        margins[~side] = [part.margin(rows[i]) for i in np.flatnonzero(~side)]
    return Model(*weigh(rows, good), *calibrate(margins, good))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of at most ``most`` labelled documents, and whether they are good.

    The chosen labels are few and bounded, so they are broadcast. Rows equal in key, label and indicators count
    once; texts that share a key all count. What comes to the driver is at most ``most`` rows and TRAINING_BYTES.
    Rows with a null label, key or text teach nothing.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("label_key"), F.col(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("label_key"), "label_key", "label").limit(most)
    found = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("label_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "label_key").select("label", "label_key", "text")

    def indicators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = kind_table()
        for batch in batches:
            for part, texts in pieces(batch, "text", PIECE_BYTES):
                rows = [columns_of(t, kinds).astype("<u4").tobytes() for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int64()), pa.array(rows, pa.binary())], ["label", "label_key", "columns"])

    made = found.withColumn("label_key", F.xxhash64("label_key")).mapInArrow(indicators, "label int, label_key long, columns binary")
    order = ["label_key", "label", "print"]
    made = materialise(made.withColumn("print", F.xxhash64("columns")).dropDuplicates(order), "indicators")
    sizes = made.select(*order, F.length("columns").alias("size")).orderBy(*order).limit(most).collect()
    total = np.cumsum([r["size"] for r in sizes])
    last = int(np.searchsorted(total, TRAINING_BYTES, side="right")) - 1
    if last < 0:
        return [], np.zeros(0, bool)
    key, label, mark = sizes[last][:3]
    upto = F.struct(*order) <= F.struct(F.lit(key).cast("long"), F.lit(label).cast("int"), F.lit(mark).cast("long"))
    got = made.where(upto).toArrow().sort_by([(c, "ascending") for c in order])
    rows = [np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in got["columns"]]
    return rows, np.array(got["label"].to_pylist(), int) == 1


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of the good class to every row, from its whole text; null counts as empty.

    An empty text gets the score of the model's offset, one of any length is read whole, and equal texts get equal
    scores. All rows and columns are kept, but for a column named as the output, which is replaced. An empty table
    gives an empty one. There is no shuffle.
    """
    docs = docs.drop(out)
    at = docs.columns.index(text)
    shipped = docs.sparkSession.sparkContext.broadcast((model.weights, model.offset, model.slope, model.shift))  # 2 MB

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kinds = Model(*shipped.value), kind_table()
        for batch in batches:
            for part, texts in pieces(batch, batch.schema.names[at], PIECE_BYTES):
                got = [own.score(columns_of(t, kinds)) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], [*batch.schema.names, out])

    return docs.mapInArrow(scored, wider(docs, f"`{out}` double"))


def held_out(doc_id: str = "doc_id") -> Column:
    """The contract's fold: rows whose crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Contract query: learn ``labels.quality`` from the other folds and score all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    model = fit(*training_rows(docs, labels, "quality", "doc_id", "text", TRAINING_ROWS))
    scored = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
