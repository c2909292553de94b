"""Feature stages that Spark ML does not have, and the feature pipeline.

Every stage can be saved, so one PipelineModel serves training and scoring.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    OneHotEncoder,
    RegexTokenizer,
    SQLTransformer,
    StandardScaler,
    StopWordsRemover,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.functions import features as fx
from loghelm.functions import text
from loghelm.operators.features import WORD, joint_vocabulary, tallied, vocabulary

BEHAVIOUR = ["hour", "weekday", "digit_count", "path_count", "msg_length", "pid"]
TEN = ["message_length", "digit_ratio", "uppercase_ratio", "special_char_count", "contains_ip",
       "contains_failed", "contains_error", "contains_warning", "contains_admin", "contains_login"]
SETS = {"structured_20": fx.STRUCTURED_20, "structured_10": TEN, "behaviour": BEHAVIOUR}
CLEANERS = {"none": text.text_or_empty, "clean": text.clean_message, "mask_v1": text.mask_v1, "mask_v2": text.mask_v2,
            "identity": lambda c: text.mask_identity(F.lower(c))}


class SublinearTf(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Term counts to 1 + ln(count); vectors stay sparse."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        damp = F.udf(lambda v: SparseVector(v.size, v.indices, 1.0 + np.log(v.values)), VectorUDT())
        return df.withColumn(self.getOutputCol(), damp(F.col(self.getInputCol())))


class MessageFeatures(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds a numeric feature set and the cleaned text as columns."""

    features = Param(Params._dummy(), "features", "name of the numeric set, or none", TypeConverters.toString)
    cleaner = Param(Params._dummy(), "cleaner", "name of the text cleaning", TypeConverters.toString)
    timeCol = Param(Params._dummy(), "timeCol", "time column of the behaviour set", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, features="structured_20", cleaner="none", timeCol="timestamp"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        message = F.col(self.getInputCol())
        out = df.withColumn("f_text", CLEANERS[self.getOrDefault(self.cleaner)](message))
        name = self.getOrDefault(self.features)
        if name == "none":
            return out
        if name == "behaviour":
            columns = fx.behaviour(message, F.col(self.getOrDefault(self.timeCol)))
        else:
            columns = getattr(fx, name)(message)
        return out.select("*", *[c.cast("double").alias(f"f_{n}") for c, n in zip(columns, SETS[name])])


def fit_features(
    df: DataFrame, message: str = "message", max_features: int = 500, min_df: int = 1, max_df: float = 1.0,
    sublinear: bool = False, numeric: str = "none", cleaner: str = "none", categories: tuple[str, ...] = (),
    pattern: str = WORD, bigrams: bool = True, stop_words: bool = False, time_col: str = "timestamp",
) -> PipelineModel:
    """Fit text, category and numeric blocks and assemble them into ``features``.

    The vocabulary holds the most frequent terms, equal counts by term. Inverse
    document frequency is ln((1 + n) / (1 + df)) + 1, applied as an element-wise
    product. Numbers are scaled by the population deviation; Spark's scaler
    divides by the sample deviation, which a constant corrects.
    """
    stages: list = [MessageFeatures(inputCol=message, features=numeric, cleaner=cleaner, timeCol=time_col)]
    stages.append(RegexTokenizer(inputCol="f_text", outputCol="f_words", gaps=False, pattern=pattern, toLowercase=True))
    words = "f_words"
    if stop_words:
        stages.append(StopWordsRemover(inputCol="f_words", outputCol="f_kept"))
        words = "f_kept"
    if bigrams:
        stages.append(NGram(n=2, inputCol=words, outputCol="f_pairs"))
        stages.append(SQLTransformer(statement=f"SELECT *, concat({words}, f_pairs) AS f_terms FROM __THIS__"))
        words = "f_terms"
    current = df
    for stage in stages:
        current = stage.transform(current)
    # Each pass cuts the texts anew: token lists kept for the next one would be many times the size of the texts.
    n = current.count()
    tallies = lambda c: current.select(F.inline(tallied(F.col(c))))
    single = "f_kept" if stop_words else "f_words"
    if bigrams:
        vocab = joint_vocabulary(tallies(single), tallies("f_pairs"), tallies(words), n, max_features, min_df, max_df)
    else:
        vocab = vocabulary(tallies(words), n, max_features, min_df, max_df).collect()
    counter = CountVectorizerModel.from_vocabulary([r["term"] for r in vocab], words, "f_tf")
    idf = [math.log((1 + n) / (1 + r["df"])) + 1.0 for r in vocab]
    stages.append(counter)
    tf = "f_tf"
    if sublinear:
        stages.append(SublinearTf(inputCol="f_tf", outputCol="f_damped"))
        tf = "f_damped"
    stages.append(ElementwiseProduct(inputCol=tf, outputCol="f_weighted", scalingVec=Vectors.dense(idf)))
    stages.append(Normalizer(inputCol="f_weighted", outputCol="f_tfidf", p=2.0))
    blocks = ["f_tfidf"]
    for name in categories:
        index = StringIndexer(inputCol=name, outputCol=f"f_i_{name}", handleInvalid="keep", stringOrderType="alphabetAsc").fit(current)
        hot = OneHotEncoder(inputCol=f"f_i_{name}", outputCol=f"f_h_{name}", dropLast=True).fit(index.transform(current))
        stages += [index, hot]
        blocks.append(f"f_h_{name}")
    if numeric != "none":
        parts = VectorAssembler(inputCols=[f"f_{n}" for n in SETS[numeric]], outputCol="f_numbers")
        scaler = StandardScaler(inputCol="f_numbers", outputCol="f_sample", withMean=True, withStd=True).fit(parts.transform(current))
        widen = math.sqrt(n / (n - 1)) if n > 1 else 1.0
        stages += [parts, scaler, ElementwiseProduct(
            inputCol="f_sample", outputCol="f_scaled", scalingVec=Vectors.dense([widen] * len(SETS[numeric])))]
        blocks.append("f_scaled")
    stages.append(VectorAssembler(inputCols=blocks, outputCol="features"))
    return PipelineModel(stages)


def feature_names(model: PipelineModel) -> list[str]:
    """Name of every slot of ``features``, in order."""
    names: list[str] = []
    hot: list[str] = []
    numbers: list[str] = []
    for stage in model.stages:
        kind = type(stage).__name__
        if kind == "CountVectorizerModel":
            names += list(stage.vocabulary)
        elif kind == "StringIndexerModel":
            hot += [f"{stage.getInputCol()}={v}" for v in stage.labels]
        elif kind == "VectorAssembler" and stage.getOutputCol() == "f_numbers":
            numbers = [c[2:] for c in stage.getInputCols()]
    return names + hot + numbers


def featurise(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Apply the feature pipeline and drop its working columns."""
    out = model.transform(df)
    return out.drop(*[c for c in out.columns if c.startswith("f_")])
