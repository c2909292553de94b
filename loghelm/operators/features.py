"""Feature tables: categories, scaling, description, correlation, terms."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark import StorageLevel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loghelm.functions.text import bound

# Token pattern and term weighting presets.
WORD = r"[\p{L}\p{N}_]{2,}"
NUMBER = r"\b\p{Nd}+\b"
PRESETS = {
    "train": {"max_features": 3000, "min_df": 2, "max_df": 0.95, "sublinear": True},
    "corpus": {"max_features": 4000, "min_df": 2, "max_df": 0.95, "sublinear": False},
    "small": {"max_features": 500, "min_df": 1, "max_df": 1.0, "sublinear": False},
}
LISTED_TIES = 200_000


def rare_to_other(df: DataFrame, column: str, least: int = 2) -> DataFrame:
    """Replace values seen fewer than ``least`` times by OTHER."""
    rare = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < least).select(
        F.col(column).alias("_rare"))
    return (
        df.join(rare, F.col(column) == F.col("_rare"), "left")
        .withColumn(column, F.when(F.col("_rare").isNotNull(), "OTHER").otherwise(F.col(column)))
        .drop("_rare")
    )


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): alphabetical index of each category. For columns of few categories."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    return values.withColumn("code", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(column)) - 1)


def with_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the alphabetical index of a category column."""
    return df.join(category_codes(df, column), column, "left").withColumnRenamed("code", name)


def one_hot(df: DataFrame, id_col: str, column: str, known: list[str]) -> DataFrame:
    """One 0/1 column per known category; an unknown value sets none."""
    return df.select(id_col, *[
        F.coalesce(F.col(column) == v, F.lit(False)).cast("int").alias(f"{column}_{v}") for v in known])


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean, unit population deviation; a constant column is only centred."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    out = []
    for name in df.columns:
        if name in columns:
            spread = row[f"s_{name}"] or 1.0
            out.append(((F.col(name) - F.lit(float(row[f"m_{name}"] or 0.0))) / F.lit(float(spread))).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per feature: count, mean, sample deviation, min, max, missing; one pass."""
    stats = [
        F.struct(
            F.lit(c).alias("feature"), F.count(c).alias("rows"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.count_if(F.col(c).isNull()).alias("missing"))
        for c in columns
    ]
    return df.agg(F.array(*stats).alias("a")).select(F.inline("a"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair, in one pass over the rows."""
    pairs = list(combinations(columns, 2))
    row = df.agg(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs]).alias("m"))
    return row.select(F.inline("m"))


def terms(message: Column, pattern: str = WORD, bigrams: bool = True, singles: bool = True) -> Column:
    """Lower-case tokens, and neighbouring pairs joined by a space; without ``singles`` the pairs alone."""
    words = F.regexp_extract_all(F.lower(F.coalesce(message, F.lit(""))), F.lit(pattern), F.lit(0))
    if not bigrams:
        return words
    def paired(w: Column) -> Column:
        return F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b))

    none = F.array().cast("array<string>")
    pairs = lambda w: F.when(F.size(w) > 1, paired(w)).otherwise(none)
    return bound(words, lambda w: F.concat(w, pairs(w)) if singles else pairs(w))


def tallied(terms: Column) -> Column:
    """array<(term, tf)> of a term list: sorted, then the starts of its runs, so nothing but the list itself is held."""
    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        return bound(starts, lambda at: F.zip_with(
            at, F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(s) + 1)),
            lambda i, end: F.struct(F.get(s, i - 1).alias("term"), (end - i).cast("long").alias("tf"))))

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return bound(F.sort_array(terms), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(none))


def _by_repeats(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose id is theirs alone, and the others, None if there are none."""
    shared = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(id_col).alias("_id"))
    if shared.isEmpty():
        return df, None
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    return df.join(shared, same, "left_anti"), df.join(shared, same, "left_semi")


def _shared_counts(shared: DataFrame, id_col: str, message: str, pattern: str, bigrams: bool, singles: bool = True) -> DataFrame:
    made = F.inline(tallied(terms(F.col(message), pattern, bigrams, singles)))
    return shared.select(id_col, made).groupBy(id_col, "term").agg(F.sum("tf").alias("tf"))


def term_counts(df: DataFrame, id_col: str, message: str, pattern: str = WORD, bigrams: bool = True, singles: bool = True) -> DataFrame:
    """(id, term, tf).

    A row is counted in its own place, with no table of terms in a task and no shuffle. Only rows that
    share their id meet others, as counts.
    """
    alone, shared = _by_repeats(df.select(id_col, message), id_col)
    out = alone.select(id_col, F.inline(tallied(terms(F.col(message), pattern, bigrams, singles))))
    return out if shared is None else out.unionAll(_shared_counts(shared, id_col, message, pattern, bigrams, singles))


def _counted(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _most_frequent(counted: DataFrame, documents: int, max_features: int, min_df: int, max_df: float) -> DataFrame:
    return counted.where((F.col("df") >= min_df) & (F.col("df") <= max_df * documents)).orderBy(F.desc("cf"), "term").limit(max_features)


def vocabulary(counts: DataFrame, documents: int, max_features: int, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """(term, df, cf) of the most frequent terms; equal counts go by term."""
    return _most_frequent(_counted(counts), documents, max_features, min_df, max_df)


def joint_vocabulary(words: DataFrame, pairs: DataFrame, both: DataFrame, documents: int, max_features: int, min_df: int = 1,
                     max_df: float = 1.0) -> list[Row]:
    """``vocabulary`` of words and pairs, all lists of (term, tf) with a row per document and term, without counting every pair.

    A pair occurs no more often than either of its words. Words are counted first; a pair is counted only where it
    could still come before the last of the ``max_features`` most frequent words. ``both`` is read only if words hold
    spaces, when a pair does not tell its words.
    """
    single = _counted(words).persist(StorageLevel.DISK_ONLY)
    if not single.where(F.col("term").contains(" ")).isEmpty():
        single.unpersist()
        return vocabulary(both, documents, max_features, min_df, max_df).collect()
    top = _most_frequent(single, documents, max_features, min_df, max_df).collect()
    full = len(top) == max_features
    least, last = (top[-1]["cf"], top[-1]["term"]) if full else (0, "")
    listed = single.where((F.col("df") >= min_df) & (F.col("cf") >= least))
    tie = F.col("cf") == least
    few = listed.where(tie).count() <= LISTED_TIES
    # where many words are as rare as the last one, only those before it are listed: a tied pair begins with one of them
    listed = listed.where(F.lit(few) | ~tie | (F.col("term") < last)).select("term", (~tie).alias("over"))
    first, second = (F.broadcast(listed.select(F.col("term").alias(f"_{x}"), F.col("over").alias(f"_over_{x}"))) for x in "ab")
    chosen = pairs.join(first, F.substring_index("term", " ", 1) == F.col("_a")).join(
        second, F.substring_index("term", " ", -1) == F.col("_b"), "inner" if few else "left")
    if full:
        chosen = chosen.where((F.col("_over_a") & F.coalesce("_over_b", F.lit(False))) | (F.col("term") < last))
    found = top + _most_frequent(_counted(chosen), documents, max_features, min_df, max_df).collect()
    single.unpersist()
    return sorted(found, key=lambda r: (-r["cf"], r["term"].encode()))[:max_features]


def weights(df: DataFrame, id_col: str, message: str, vocab: list[Row], documents: int, sublinear: bool = False,
            pattern: str = WORD, bigrams: bool = True) -> DataFrame:
    """(id, term, weight): ``tf_idf`` of texts, row by row; only rows that share their id are shuffled."""
    listed = df.sparkSession.createDataFrame(vocab, "term string, df long, cf long")
    alone, shared = _by_repeats(df.select(id_col, message), id_col)
    together = None if shared is None else tf_idf(_shared_counts(shared, id_col, message, pattern, bigrams), listed, id_col, documents, sublinear)
    if not vocab:
        return tf_idf(term_counts(df, id_col, message, pattern, bigrams), listed, id_col, documents, sublinear)
    counter = CountVectorizerModel.from_vocabulary([r["term"] for r in vocab], "_terms", "_tf")
    counted = counter.transform(alone.select(id_col, terms(F.col(message), pattern, bigrams).alias("_terms")))
    vector = F.unwrap_udt(F.col("_tf"))
    names = F.split(F.lit("\n".join(r["term"] for r in vocab)), "\n")
    idf = F.split(F.lit("\n".join(repr(math.log((1 + documents) / (1 + r["df"])) + 1) for r in vocab)), "\n").cast("array<double>")
    raw = F.zip_with(vector["indices"], vector["values"], lambda i, tf: F.struct(
        i.alias("at"), ((1 + F.log(tf) if sublinear else tf) * F.get(idf, i)).alias("w")))
    unit = bound(raw, lambda ws: bound(
        F.sqrt(F.aggregate(ws, F.lit(0.0), lambda total, x: total + x["w"] * x["w"])),
        lambda norm: F.transform(ws, lambda x: F.struct(F.get(names, x["at"]).alias("term"), (x["w"] / norm).alias("weight")))))
    out = counted.select(id_col, F.inline(unit))
    return out if together is None else out.unionAll(together)


def tf_idf(counts: DataFrame, vocab: DataFrame, id_col: str, documents: int, sublinear: bool = False) -> DataFrame:
    """(id, term, weight): smooth idf, unit length per document.

    The vocabulary never exceeds its feature limit, so it is broadcast.
    """
    idf = F.log((1 + documents) / (1 + F.col("df"))) + 1
    tf = 1 + F.log("tf") if sublinear else F.col("tf")
    raw = counts.join(F.broadcast(vocab), "term").select(id_col, "term", (tf * idf).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(id_col)))
    return raw.select(id_col, "term", (F.col("_w") / norm).alias("weight"))
