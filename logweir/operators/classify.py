"""Log-type classifier: TF-IDF over character n-grams and multinomial logistic regression.

Scoring needs no key and no shuffle: every Arrow batch of lines meets the term table, which has at
most 300,000 terms and is broadcast as arrays, in the task that reads it, and a line's probabilities stand
in a new column beside it. So repeated lines and keys cannot mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..catalogue import DEFAULT_THRESHOLD
from ..functions import gramwise
from ..functions.sql import name, texts
from ..session import scratch_path
from .ranking import largest
from .route import confidence_filter

# --- fixed values of the model ------------------------------------------------------
MIN_DF = 5
MAX_TERMS = 300_000
INVERSE_REGULARIZATION = 5.0
MAX_ITERATIONS = 2000


@dataclass(frozen=True)
class LogTypeModel:
    """Classes, one intercept each, and a term table ``term, idf, weights ARRAY<DOUBLE>``.

    ``n_terms`` is the size of the term table. More than 300,000 terms, which training never
    keeps, are refused, so what is broadcast has a known bound (tens of MB).
    """

    classes: tuple[str, ...]
    intercepts: tuple[float, ...]
    terms: DataFrame
    n_terms: int

    def __post_init__(self):
        if self.n_terms > MAX_TERMS:
            raise ValueError(f"{self.n_terms} terms; a model has at most {MAX_TERMS}")

    @cached_property
    def shared(self):
        """The vocabulary, the weights by class and the intercepts, as tasks get them."""
        table = self.terms.select("term", "idf", "weights").limit(MAX_TERMS).toArrow()
        flat = table.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        weights = np.ascontiguousarray(flat.reshape(table.num_rows, len(self.classes)).T)
        vocabulary = gramwise.Vocabulary(table.column("term").to_pylist(), table.column("idf").to_numpy())
        return self.terms.sparkSession.sparkContext.broadcast((vocabulary, weights, np.array(self.intercepts)))

    def save(self, path: str) -> None:
        spark = self.terms.sparkSession
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        rows = [(i, c, b) for i, (c, b) in enumerate(zip(self.classes, self.intercepts))]
        (spark.createDataFrame(rows, "position int, label string, intercept double")
         .coalesce(1).write.mode("overwrite").parquet(f"{path}/classes"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "LogTypeModel":
        classes = spark.read.parquet(f"{path}/classes").orderBy("position").collect()
        terms = spark.read.parquet(f"{path}/terms")
        return LogTypeModel(tuple(r.label for r in classes), tuple(r.intercept for r in classes),
                            terms, terms.count())


def term_statistics(lines: DataFrame, text_column: str = "line") -> DataFrame:
    """Per n-gram: ``cf``, its count in the corpus, and ``df``, the lines it occurs in.

    A task counts the terms of a batch before it gives them out, so the shuffle carries
    a batch's distinct terms, not its lines' terms.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield gramwise.counted(batch.column(0).to_pylist())

    return (lines.select(F.col(name(text_column))).mapInArrow(count, "term string, cf long, df long")
            .groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df")))


def tfidf_terms(lines: DataFrame, text_column: str = "line", min_df: int = MIN_DF,
                max_terms: int = MAX_TERMS) -> DataFrame:
    """The vocabulary: the commonest terms in at least ``min_df`` lines, with their smoothed idf.

    Fitting it runs jobs: the terms are counted and written out once, and the cut to
    ``max_terms`` is found from counts per value range, not by sorting them.
    """
    spark = lines.sparkSession
    path = scratch_path(spark, "terms")
    term_statistics(lines, text_column).filter(F.col("df") >= min_df).write.parquet(path)
    kept = largest(spark.read.parquet(path), "cf", "term", max_terms)
    n = lines.agg(F.count("*").alias("n_lines"))
    return (kept.join(F.broadcast(n), F.lit(True))  # one row
            .selectExpr("term", "cf", "df", "ln((1D + n_lines) / (1D + df)) + 1D AS idf"))


def vocabulary(terms: DataFrame) -> gramwise.Vocabulary:
    """A term table (at most 300,000 rows are taken to the driver), in the order of the terms."""
    table = terms.select("term", "idf").orderBy("term").limit(MAX_TERMS + 1).toArrow()
    if table.num_rows > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return gramwise.Vocabulary(table.column("term").to_pylist(), table.column("idf").to_numpy())


def vector_column(column: str, known: gramwise.Vocabulary, spark: SparkSession) -> Column:
    """Sparse vectors of length one, as ``array<struct<place, weight>>``; places follow ``known.terms``."""
    shared = spark.sparkContext.broadcast(known)

    @F.arrow_udf("array<struct<place:int,weight:double>>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lines in batches:
            ends, places, weights = gramwise.vectors(lines.to_pylist(), shared.value)
            entries = pa.StructArray.from_arrays([pa.array(places.astype(np.int32)), pa.array(weights)], ["place", "weight"])
            yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries)

    return vectors(F.col(name(column)))


def tfidf_vectors(lines: DataFrame, key: str, text_column: str, terms: DataFrame) -> DataFrame:
    """Sparse vectors of length one as rows ``key, term, weight``; every line gives its own."""
    known = vocabulary(terms)
    spark = lines.sparkSession
    held = lines.select(F.col(name(key)), vector_column(text_column, known, spark).alias("_v"))
    # Entries are unfolded beside the lines and named by a table of at most 300,000 terms: no second pass through Python.
    named = spark.createDataFrame(pa.table({"_place": pa.array(range(len(known.terms)), pa.int32()), "term": pa.array(known.terms, pa.string())}))
    entries = held.select(F.col(name(key)), F.inline("_v").alias("_place", "weight"))
    return entries.join(F.broadcast(named), "_place").select(F.col(name(key)), "term", "weight")


def probability_column(column: str, model: LogTypeModel) -> Column:
    """The class probabilities of a text column, in class order."""
    shared = model.shared

    @F.arrow_udf("array<double>")
    def score_lines(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, weights, intercepts = shared.value
        for lines in batches:
            p = gramwise.probabilities(lines.to_pylist(), known, weights, intercepts)
            ends = np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(p.ravel()))

    return score_lines(F.col(name(column)))


def with_probabilities(lines: DataFrame, text_column: str, model: LogTypeModel, out: str = "probabilities") -> DataFrame:
    """Adds ``probabilities ARRAY<DOUBLE>``, in class order; rows stay where they are."""
    return lines.withColumn(out, probability_column(text_column, model))


def score(lines: DataFrame, key: str, text_column: str, model: LogTypeModel) -> DataFrame:
    """``key, probabilities`` of every line; keys may repeat."""
    return with_probabilities(lines, text_column, model).select(F.col(name(key)), "probabilities")


def top2_candidates(probabilities: str, classes) -> str:
    """The two most probable labels, best first, rounded to four places; ties go to the later class."""
    order = f"slice(sort_array(transform({probabilities}, (p, i) -> named_struct('p', p, 'i', i)), false), 1, 2)"
    return f"transform({order}, c -> named_struct('label', {texts(classes)}[c.i], 'p', round(c.p, 4)))"


def best_class(probabilities: str, classes) -> str:
    order = f"array_max(transform({probabilities}, (p, i) -> named_struct('p', p, 'i', i)))"
    return f"{texts(classes)}[{order}.i]"


def predictions(scored: DataFrame, classes) -> DataFrame:
    """Adds ``label`` and unrounded ``confidence`` of the best class, and ``candidates``; columns so called before are replaced."""
    carried = [name(c) for c in scored.columns if c not in ("probabilities", "label", "confidence", "candidates")]
    return scored.selectExpr(*carried, f"{best_class('probabilities', classes)} AS label",
                             "array_max(probabilities) AS confidence",
                             f"{top2_candidates('probabilities', classes)} AS candidates")


def classify(df: DataFrame, model: LogTypeModel, threshold: float = DEFAULT_THRESHOLD, text_column: str = "raw") -> DataFrame:
    """Lines gain ``log_type``, ``confidence`` and ``candidates``, without a shuffle."""
    scored = predictions(with_probabilities(df, text_column, model, "probabilities"), model.classes)
    return confidence_filter(scored, threshold).drop("label")


def train(lines: DataFrame, label: str = "label", text_column: str = "line",
          min_df: int = MIN_DF, max_terms: int = MAX_TERMS, c: float = INVERSE_REGULARIZATION,
          max_iter: int = MAX_ITERATIONS, tolerance: float = 1e-5, partitions: int | None = None) -> LogTypeModel:
    """Fit the classifier on labelled lines (cap them per class first); repeated lines count as often as they stand.

    Vectors are made per Arrow batch and written out once, so a lost executor costs the files it was
    reading. Every solver step is a job of ``partitions`` tasks (as many as shuffles have, by default).

    The weight table comes back through the driver: classes times terms, at
    most 300,000 terms.
    """
    spark = lines.sparkSession
    labelled = lines.select(F.col(name(label)).alias("label"), F.col(name(text_column)).alias("line"))
    known = vocabulary(tfidf_terms(labelled, "line", min_df, max_terms))
    classes = sorted(r.label for r in labelled.select("label").distinct().collect())
    size = len(known.terms)
    position = F.array_position(F.lit(list(classes)), F.col("label")) - 1
    # The columns of a sparse vector as the solver stores it; reading them back by its type makes them one.
    sparse = "named_struct('type', 0Y, 'size', {}, 'indices', transform(_v, e -> e.place), 'values', transform(_v, e -> e.weight))"
    path = scratch_path(spark, "vectors")
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (labelled.select(vector_column("line", known, spark).alias("_v"), position.cast("double").alias("target"))
     .selectExpr(f"{sparse.format(size)} AS features", "target").repartition(parts).write.parquet(path))
    data = spark.read.schema(StructType([StructField("features", VectorUDT()), StructField("target", DoubleType())])).parquet(path)
    n = data.count()
    fitted = LogisticRegression(
        featuresCol="features", labelCol="target", family="multinomial", standardization=False,
        maxIter=max_iter, tol=tolerance, regParam=1.0 / (c * n)).fit(data)
    weights = fitted.coefficientMatrix.toArray().T
    table = pa.table({"term": pa.array(known.terms, pa.string()), "idf": pa.array(known.idf),
                      "weights": pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * len(classes)), pa.array(weights.ravel()))})
    return LogTypeModel(tuple(classes), tuple(float(b) for b in fitted.interceptVector), spark.createDataFrame(table), size)
