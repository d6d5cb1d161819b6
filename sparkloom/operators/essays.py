"""Essay features: n-grams, tf-idf, lexical measures, embedding similarity, weighted grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, once


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(fold(text), r"[^\p{L}\p{N}_]+"), "")


def ngrams(words: Column, n: int) -> Column:
    """n-grams joined by a space; none of shorter lists."""
    def of(w: Column) -> Column:
        ends = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
        return F.when(F.size(w) >= n, F.transform(ends, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return once(words, of)


def ngram_frequency(df: DataFrame, text_col: str, n: int, stop: list[str] = ()) -> DataFrame:
    """(term, frequency) over all texts."""
    w = tokens(F.col(text_col))
    if stop:
        w = F.filter(w, lambda x: ~x.isin(*stop))
    return df.select(F.explode(ngrams(w, n)).alias("term")).groupBy("term").agg(F.count("*").alias("frequency"))


def tf_idf(df: DataFrame, id_col: str, text_col: str, n: int = 1) -> DataFrame:
    """(term, tfidf_score): mean over documents of tf * ln(N / df), terms of n words. A document's terms are sorted and counted in its row;
    the one shuffle is by term, behind a partial aggregate."""
    docs = df.select(ngrams(tokens(F.col(text_col)), n).alias("w")).where(F.size("w") > 0)
    many = docs.agg(F.count("*").alias("n_docs"))

    def counted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return once(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), ((F.coalesce(F.get(at, k + 1), F.size(s)) - i) / F.size(s)).alias("tf"))))

    t = docs.select(F.explode(once(F.array_sort("w"), counted)).alias("x")).groupBy("x.term").agg(F.sum("x.tf").alias("s"), F.count("*").alias("d"))
    return t.join(F.broadcast(many)).select("term", (F.col("s") * F.log(F.col("n_docs") / F.col("d")) / F.col("n_docs")).alias("tfidf_score"))


def lexical_features(df: DataFrame, id_col: str, text_col: str, technical: list[str]) -> DataFrame:
    w = tokens(F.col(text_col))
    out = df.select(
        id_col,
        F.size(w).alias("word_count"),
        F.greatest(F.size(F.filter(F.split(text_col, r"[.!?]+"), lambda s: F.trim(s) != "")), F.lit(1)).alias("sentence_count"),
        F.size(F.array_distinct(w)).alias("unique_words"),
        F.size(F.filter(w, lambda x: x.isin(*technical))).alias("technical_term_count"),
    )
    ratio = lambda a, b: F.round(F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b)), 4)
    return out.withColumns({"avg_sentence_length": ratio("word_count", "sentence_count"), "lexical_diversity": ratio("unique_words", "word_count"), "technical_density": ratio("technical_term_count", "word_count")})


def cosine_avg(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, avg_similarity): mean cosine to all other rows, exactly, without a pair of rows ever meeting: the mean over others of
    dot products with unit vectors is (u . S - 1) / (n - 1), where S is the sum of all unit vectors (one row of the dimension)."""
    v = F.col(vector_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = df.where(F.col(vector_col).isNotNull()).select(id_col, F.transform(v, lambda x: x / norm).alias("u"))
    total = unit.select(F.posexplode("u").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("s"), F.lit(1).alias("one"))
    n = unit.agg(F.count("*").alias("n"))
    dot = F.aggregate(F.zip_with("u", "s", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return unit.join(F.broadcast(total)).join(F.broadcast(n)).select(id_col, F.when(F.col("n") > 1, (dot - 1) / (F.col("n") - 1)).alias("avg_similarity"))


def weighted_grade(attendance: Column, practice: Column, homework: Column, exam: Column) -> Column:
    """Weights .15, .20, .25, .40; a missing practice mark counts 0."""
    return 0.15 * attendance + 0.20 * F.coalesce(practice, F.lit(0.0)) + 0.25 * homework + 0.40 * exam


def outcome(exam: Column, grade: Column, passing: float = 55.0) -> Column:
    return F.when(exam == 0, "drop out").when(grade >= passing, "aprobado").otherwise("failed")
