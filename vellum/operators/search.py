"""Term search: scored by BM25 over a scan, or over a stored index.

A query is text, whose tokens are its terms: case does not matter, and a term that is repeated counts once. Nulls: a null text has no tokens and is found by
nothing, yet counts among the documents; a null doc_id is found as any other.

An index is a folder that all executors share:
    postings  (bucket, part, batch, term, doc_id, tf, dl), in BUCKETS folders by bucket, a hash of the term
    lengths   (batch, doc_id, dl) of every document
    removed   (batch, doc_id): postings of that batch or an earlier one do not count any more
    facts     (batch, n, tokens) to be summed: documents and their tokens; what is removed counts negative
Every change adds files and rewrites none.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.sources.scratch import stored

#: Postings that one file of an index should hold at most on average, folders by term, and tokens whose postings a task should sort.
ROWS, BUCKETS, TASK = 1 << 22, 64, 1 << 20


def terms_of(spark: SparkSession, query: str | list[str]) -> list[str]:
    """The terms of a query, each once, by the very expression that texts are cut by."""
    whole = query if isinstance(query, str) else " ".join(query)
    return list(dict.fromkeys(spark.range(1).select(T.tokens(F.lit(whole))).first()[0]))


def _checked(spark: SparkSession, query: str | list[str], mode: str) -> list[str]:
    if mode not in ("all", "any"):
        raise ValueError("mode is all or any")
    return terms_of(spark, query)


def search(documents: DataFrame, query: str | list[str], mode: str = "all") -> DataFrame:
    """(doc_id, score) of the documents that hold all or any of the query's terms; none for a query without a term.

    No token leaves its row: one scan counts each term in place and is written, and corpus statistics are one row, which is broadcast.
    """
    terms = _checked(documents.sparkSession, query, mode)
    tf = [f"tf_{i}" for i in range(len(terms))]
    low = documents.select("doc_id", F.lower("text").alias("text"))
    counted = stored(low.select("doc_id", T.n_tokens(F.col("text")).alias("dl"), *[T.term_frequency(F.col("text"), t).alias(c) for t, c in zip(terms, tf, strict=True)]), "counted")
    facts = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(c) > 0).alias(f"d{c}") for c in tf])
    match = F.lit(False)
    for i, c in enumerate(tf):
        match = F.col(c) > 0 if not i else match & (F.col(c) > 0) if mode == "all" else match | (F.col(c) > 0)
    score = sum((T.bm25(F.col(c), F.col(f"d{c}"), F.col("dl"), F.col("n"), F.col("avgdl")) for c in tf), F.lit(0.0))
    return counted.filter(match).crossJoin(F.broadcast(facts)).select("doc_id", score.alias("score"))


def postings(documents: DataFrame) -> DataFrame:
    """(term, doc_id, tf, dl): what an index holds. Terms are counted inside each document's row; nothing is shuffled. The outer explode keeps Spark from
    cutting each text a second time to see whether it has tokens, and dl beside each term from cutting it for each of them."""
    each = documents.select("doc_id", F.explode_outer(T.term_counts(F.col("text"))).alias("x"))
    return each.filter("x is not null").select("x.term", "doc_id", "x.tf", "x.dl")


POSTINGS, LENGTHS, REMOVED, FACTS = "part int, batch int, term string, doc_id long, tf long, dl long, bucket int", "batch int, doc_id long, dl long", "batch int, doc_id long", "batch int, n long, tokens long"


def bucket_of(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A part of an index; empty where nothing was written yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(f"{path}/{name}") if there else spark.createDataFrame([], schema)


def _last_batch(spark: SparkSession, path: str) -> int:
    return _read(spark, path, "facts", FACTS).agg(F.max("batch")).first()[0] or 0


def _alive(rows: DataFrame, path: str) -> DataFrame:
    gone = _read(rows.sparkSession, path, "removed", REMOVED).groupBy(F.col("doc_id").alias("gone")).agg(F.max("batch").alias("until"))
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")) & (F.col("batch") <= F.col("until")), "left_anti")


def add_to_index(documents: DataFrame, path: str) -> None:
    """Indexes documents (doc_id, text), whose ids are different; one whose id is there already is replaced.

    Folders follow from a hash of the term, and a folder's postings are dealt by a hash of the document to as many files as their number asks for, so
    no task holds all postings of a frequent term. Postings are shuffled once, without what follows from them, to tasks whose number grows with the tokens, so that
    each sorts its own in memory.
    """
    spark = documents.sparkSession
    lengths = stored(documents.select("doc_id", T.n_tokens(F.col("text")).alias("dl")), "lengths")
    n, tokens, different = lengths.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)), F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).first()
    if not n:
        return
    if n != different:
        raise ValueError("documents with one id cannot be indexed at once")
    remove_from_index(lengths.select("doc_id"), path)
    batch = _last_batch(spark, path) + 1
    parts = 1 + tokens // (BUCKETS * ROWS)
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(BUCKETS * parts, 1 + tokens // TASK))
    bucket, part = bucket_of("term"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    dealt = postings(documents).repartitionById(wide, F.pmod(bucket * F.lit(parts) + part, F.lit(wide)).cast("int"))
    kept = dealt.withColumns({"batch": F.lit(batch), "bucket": bucket, "part": part})
    kept.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("append").parquet(f"{path}/postings")
    lengths.select(F.lit(batch).alias("batch"), "doc_id", "dl").write.mode("append").parquet(f"{path}/lengths")
    spark.createDataFrame([(batch, n, tokens)], FACTS).write.mode("append").parquet(f"{path}/facts")


def remove_from_index(ids: DataFrame, path: str) -> None:
    """Takes the documents of ids (doc_id) out of an index; ids that are not in it are ignored."""
    spark = ids.sparkSession
    batch = _last_batch(spark, path)
    asked = ids.select(F.col("doc_id").cast("long").alias("asked")).distinct()
    gone = stored(_alive(_read(spark, path, "lengths", LENGTHS), path).join(asked, F.col("doc_id").eqNullSafe(F.col("asked")), "left_semi"), "gone")
    n, tokens = gone.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    if n:
        gone.select(F.lit(batch).alias("batch"), "doc_id").write.mode("append").parquet(f"{path}/removed")
        spark.createDataFrame([(batch, -n, -tokens)], FACTS).write.mode("append").parquet(f"{path}/facts")


def search_index(spark: SparkSession, path: str, query: str | list[str], mode: str = "all") -> DataFrame:
    """What search() gives, from an index: only the folders of the query's terms are read, and in them only row groups that may hold a term."""
    terms = _checked(spark, query, mode)
    one = spark.createDataFrame([(t,) for t in terms], "term string")
    buckets = sorted({r[0] for r in one.select(bucket_of("term")).collect()})
    every = _read(spark, path, "postings", POSTINGS)
    mine = _alive(every.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms)), path)
    facts = _read(spark, path, "facts", FACTS).agg(F.sum("n"), F.sum("tokens")).first()
    n, avgdl = facts[0] or 0, (facts[1] or 0) / max(1, facts[0] or 0)
    df = mine.groupBy("term").agg(F.count("*").alias("df"))
    part = T.bm25(F.col("tf"), F.col("df"), F.col("dl"), F.lit(n), F.lit(avgdl))
    hits = mine.join(F.broadcast(df), "term").groupBy("doc_id").agg(F.sum(part).alias("score"), F.count("*").alias("k"))
    return hits.filter(F.col("k") >= (len(terms) if mode == "all" else 1)).select("doc_id", "score")


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best, ties by doc_id; no full sort."""
    return scores.orderBy(F.desc("score"), "doc_id").limit(k)


def index_terms(documents: DataFrame) -> DataFrame:
    """(term, df, cf) of every term. A document gives each of its tokens for cf, and each different one for df; both are summed in one shuffle of a row
    per term and task."""
    w = documents.select(T.tokens(F.col("text")).alias("w"))
    both = F.concat(F.transform("w", lambda t: F.struct(t.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("c"))), F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("c"))))
    return w.select(F.explode(both).alias("x")).groupBy("x.term").agg(F.sum("x.d").alias("df"), F.sum("x.c").alias("cf"))


def index_sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, n_terms, index_bytes): distinct terms of a document, and their bytes plus eight for each; inside the row."""
    once = documents.select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("w"))
    return once.select("doc_id", F.size("w").cast("long").alias("n_terms"), (F.octet_length(F.array_join("w", "")) + F.size("w") * 8).cast("long").alias("index_bytes"))
