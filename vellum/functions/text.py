"""Tokenising and scoring expressions for term search."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def term_frequency(text: Column, term: str) -> Column:
    """How often term is a token of text, without building the tokens."""
    alone = rf"(?<![\p{{L}}\p{{N}}]){re.escape(term)}(?![\p{{L}}\p{{N}}])"
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(alone)), F.lit(0)).cast("long")


def term_counts(text: Column) -> Column:
    """(term, tf, dl) of each different token, dl the number of all, inside the row: runs of the sorted tokens. A transform over an array of one evaluates its element once."""

    def counts(w: Column) -> Column:
        starts = F.filter(F.transform(w, lambda t, i: F.when((i == 0) | (t != F.get(w, i - 1)), i)), F.isnotnull)
        length = lambda s, at, i: F.coalesce(F.get(s, i + 1), F.size(w)) - at
        runs = lambda s: F.transform(s, lambda at, i: F.struct(F.get(w, at).alias("term"), length(s, at, i).cast("long").alias("tf"), F.size(w).cast("long").alias("dl")))
        return F.get(F.transform(F.array(starts), runs), F.lit(0))

    return F.get(F.transform(F.array(F.sort_array(tokens(text))), counts), F.lit(0))


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def bm25(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    """One term's part of the score (Robertson and Zaragoza, 2009)."""
    return idf(n, df) * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / avgdl))
