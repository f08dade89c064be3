"""What several operators need: free column names, word counts and scratch tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources.scratch import folder, forget, keep_out, scope, stored  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
#: A sieve has at most so many rows, of 64 bits each.
SIEVE = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each lengthened until no column of df has it, whatever its case."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once: what a lambda variable stands for is not inlined again and again."""
    return F.transform(F.array(value), body)[0]


def code_points(text: Column) -> Column:
    """Four bytes a code point, so that any of them is reached in constant time."""
    return F.encode(text, "UTF-32")


def part(points: Column, start: Column, n: Column | int) -> Column:
    """n code points of code_points() from start, which counts from 0."""
    return F.substring(points, start * 4 + 1, n * 4 if isinstance(n, Column) else F.lit(n * 4))


def word_count(text: Column) -> Column:
    """Runs of characters other than blank and \\t to \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str, key: Column) -> Column:
    """A number in [0, 2^32) that depends on seed and key only, so reruns and lost executors give it again."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def sieve(ids: DataFrame) -> DataFrame:
    """(word, bits): a bit for each value of the only column of ids, by its hash. At most SIEVE rows, however many ids there are; equal bits combine on
    the map side."""
    h = F.xxhash64(named(ids.columns[0]))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 40).bitwiseAND(63).cast("int"))
    return ids.select(h.bitwiseAND(SIEVE - 1).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def sifted(df: DataFrame, key: Column, through: DataFrame, inside: bool) -> DataFrame:
    """The rows of df whose key may be among the ids of a sieve (inside), or those whose key surely is not. Nothing of df is shuffled: the sieve, whose
    size is bounded, is broadcast. Its false positives grow with the number of ids, so whoever sifts has to compare what is inside exactly."""
    word, bits = fresh(df, "sieve_word", "sieve_bits")
    h = F.xxhash64(key)
    lot = F.call_function("shiftrightunsigned", named(bits), F.shiftrightunsigned(h, 40).bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    out = df.join(F.broadcast(through.select(F.col("word").alias(word), F.col("bits").alias(bits))), h.bitwiseAND(SIEVE - 1) == named(word), "left")
    lot = F.coalesce(lot & key.isNotNull(), F.lit(False))
    return out.filter(lot if inside else ~lot).select(*[named(c) for c in df.columns])
