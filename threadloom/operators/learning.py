"""Supervised text classification and topic clusters with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import textfn as tx


def train_classifier(labelled: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 14) -> PipelineModel:
    """Naive Bayes over TF-IDF of word tokens."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"\W+"),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features),
        IDF(inputCol="__tf", outputCol="features"),
        NaiveBayes(labelCol=label, featuresCol="features"),
    ]
    return Pipeline(stages=stages).fit(labelled)


def classify(model: PipelineModel, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return model.transform(docs).select(id_col, F.col("prediction").cast("int").alias("prediction"))


def tfidf_vectors(docs: DataFrame, text: str = "text", features: int = 1 << 14) -> DataFrame:
    stages = [
        RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"\W+"),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features),
        IDF(inputCol="__tf", outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(docs).transform(docs).drop("__words", "__tf")


def topic_clusters(vectors: DataFrame, k: int, vec_col: str = "embedding", seed: int = 7, min_size: int = 2) -> DataFrame:
    """Cluster number per row; clusters below ``min_size`` become the outlier cluster -1."""
    rows = vectors.withColumn("features", array_to_vector(F.col(vec_col).cast("array<double>")))
    placed = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows).transform(rows)
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("__n"))  # at most k rows
    placed = placed.join(F.broadcast(sizes), "cluster")
    return placed.withColumn("cluster", F.when(F.col("__n") < min_size, -1).otherwise(F.col("cluster"))).drop("__n", "features")


def topic_words(docs: DataFrame, cluster: str, text: str = "text", k: int = 3) -> DataFrame:
    """Leading words per cluster by class TF-IDF."""
    words = docs.select(cluster, F.explode(tx.tokens(F.col(text), r"\b[a-z]{3,}\b")).alias("word"))
    tf = words.groupBy(cluster, "word").agg(F.count("*").alias("tf"))
    totals = tf.groupBy("word").agg(F.sum("tf").alias("all"))
    size = tf.groupBy(cluster).agg(F.sum("tf").alias("__size"))
    average = size.agg(F.avg("__size").alias("__avg"))
    scored = tf.join(totals, "word").join(size, cluster).join(F.broadcast(average))
    score = F.col("tf") / F.col("__size") * F.log(1 + F.col("__avg") / F.col("all"))
    w = Window.partitionBy(cluster).orderBy(F.desc(F.round(score, 9)), "word")
    return scored.select(cluster, "word", "tf", score.alias("score"), F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def topic_labels(words: DataFrame, cluster: str, topics: Sequence[tuple[str, str]]) -> DataFrame:
    """Label (leading words joined) and topic code per cluster; outliers are general."""
    joined = words.groupBy(cluster).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), "_").alias("label")
    )
    code = F.when(F.col(cluster) == -1, "GENRL").otherwise(tx.topic_code(F.col("label"), topics))
    return joined.withColumn("topic", code)
