"""Listing, storing, reading, encrypting and removing documents.

A stored document is rows of blocks (doc_id, block_no, n_blocks, block). Nulls: a null text is an empty body; an empty body has no blocks; a document
without an owner or an org is nobody's own; a null doc_id cannot be granted or removed.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import crypto

BLOCK_BYTES = 1 << 20


def accessible(documents: DataFrame, shares: DataFrame, users: DataFrame, user_id: int) -> DataFrame:
    """doc_id of every document the caller may read: own, shared with them, or of their org if they are an admin."""
    caller = users.filter(F.col("user_id") == user_id).select("user_id", F.col("org_id").alias("own_org"), "is_admin")
    ids = documents.join(F.broadcast(caller.limit(1)), F.expr("owner_id = user_id or (is_admin and org_id = own_org)"), "left_semi").select("doc_id")
    granted = shares.filter(F.col("grantee_id") == user_id).select("doc_id")
    return ids.union(granted).distinct()


def list_documents(documents: DataFrame, shares: DataFrame, users: DataFrame, user_id: int) -> DataFrame:
    """The records of the accessible documents."""
    ids = accessible(documents, shares, users, user_id)
    return documents.join(ids, "doc_id", "left_semi").select("doc_id", "doc_name", "size_bytes")


def upload(documents: DataFrame, new: DataFrame) -> DataFrame:
    """documents with new ones; the same (org, owner, name), nulls being equal, replaces what was there, so a repeated upload stays one.
    Of equal keys in new the largest doc_id counts, and of equal ones the row whose JSON comes last."""
    key, row = ["org_id", "owner_id", "doc_name"], F.struct(*new.columns)
    once = new.groupBy(*key).agg(F.max_by(row, F.struct("doc_id", F.to_json(row))).alias("row")).select("row.*")
    taken = once.select(*[F.col(k).alias(f"new_{k}") for k in key])
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"new_{k}"))
    return documents.join(taken, same, "left_anti").unionByName(once, allowMissingColumns=True)


def blocks(body: Column, block_bytes: int = BLOCK_BYTES, least: int = 0) -> Column:
    """A binary column as an array of (block_no, block) of at most block_bytes; least: how many blocks an empty body has."""
    n = F.greatest(F.ceil(F.octet_length(body) / F.lit(block_bytes)).cast("int"), F.lit(least))
    numbers = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.struct(i.alias("block_no"), F.substring(body, i * block_bytes + 1, F.lit(block_bytes)).alias("block")))


def body_of(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))


def upload_chunks(documents: DataFrame, block_bytes: int = BLOCK_BYTES, least: int = 0) -> DataFrame:
    """(doc_id, block_no, n_blocks, block) of every text."""
    b = documents.select("doc_id", blocks(body_of(), block_bytes, least).alias("b"))
    return b.select("doc_id", F.size("b").alias("n_blocks"), F.explode("b").alias("b")).select("doc_id", "b.block_no", "n_blocks", "b.block")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Adds blocks to a stored table, as they come: a document's blocks need not meet."""
    chunks.write.mode("append").parquet(path)


def concatenated(parts: Column) -> Column:
    """An array of binaries as one, in time linear in their bytes; null if a part is null."""
    whole = F.array_join(F.transform(parts, lambda x: x.cast("string")), "").cast("binary")
    return F.when(~F.exists(parts, lambda x: x.isNull()), whole)


def download(documents: DataFrame, chunks: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_id, body, intact) of documents (doc_id, size_bytes): blocks joined in order, an empty body where there is none.

    A document is intact if its blocks are there from 0 to n_blocks - 1, each once, and add up to its size. Otherwise strict raises, and
    else the body is null. A document is one value, so its blocks meet in one row by definition.
    """
    body = F.expr("listagg(block, X'') WITHIN GROUP (ORDER BY block_no)")
    every = chunks.groupBy("doc_id").agg(
        body.alias("body"), F.count("*").alias("n"), F.count_distinct("block_no").alias("different"), F.min("block_no").alias("first"), F.max("block_no").alias("last"), F.min("n_blocks").alias("least"), F.max("n_blocks").alias("most")
    )
    sized = documents.select("doc_id", "size_bytes").join(every, "doc_id", "left")
    whole = F.expr("n = different and first = 0 and last = n - 1 and least = n and most = n and octet_length(body) = size_bytes")
    intact = F.when(F.col("n").isNull(), F.col("size_bytes") == 0).otherwise(whole)
    out = sized.withColumn("intact", F.coalesce(intact, F.lit(False)))
    bad = F.raise_error(F.concat(F.lit("blocks of document "), F.col("doc_id").cast("string"), F.lit(" are missing, repeated or another's"))).cast("binary") if strict else F.lit(None).cast("binary")
    return out.select("doc_id", F.when(F.col("intact"), F.coalesce("body", F.lit("").cast("binary"))).otherwise(bad).alias("body"), "intact")


def encrypt_chunks(chunks: DataFrame, key: str) -> DataFrame:
    """Blocks with block encrypted; each only opens as the block of this number of this document with as many blocks. The key travels as a column of
    the plan, never inside SQL text."""
    k = F.lit(key).cast("binary")
    return chunks.withColumn("block", crypto.encrypt(F.col("block"), k, crypto.place(F.col("doc_id"), F.col("block_no"), F.col("n_blocks"))))


def decrypt_chunks(chunks: DataFrame, key: str, doc_id: Column | None = None) -> DataFrame:
    """Blocks with block decrypted, null where it does not open. doc_id: under which the caller asks, by default the row's."""
    k, want = F.lit(key).cast("binary"), F.col("doc_id") if doc_id is None else doc_id
    return chunks.withColumn("block", crypto.decrypt(F.col("block"), k, crypto.place(want, F.col("block_no"), F.col("n_blocks"))))


def encrypt_documents(documents: DataFrame, key: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, cipher): an array of encrypted blocks per document, one for an empty body, so that it too opens under its key only."""
    k, b = F.lit(key).cast("binary"), blocks(body_of(), block_bytes, 1)
    return documents.select("doc_id", b.alias("b")).select("doc_id", F.transform("b", lambda x: crypto.encrypt(x["block"], k, crypto.place(F.col("doc_id"), x["block_no"], F.size("b")))).alias("cipher"))


def decrypt_documents(ciphers: DataFrame, key: str, doc_id: Column | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, body): null where a block is another's, is not at its place, or is missing. doc_id: under which the caller asks, by default the
    row's; keep: more columns."""
    k, want = F.lit(key).cast("binary"), F.col("doc_id") if doc_id is None else doc_id
    opened = F.transform("cipher", lambda x, i: crypto.decrypt(x, k, crypto.place(want, i, F.size("cipher"))))
    body = F.when(F.size("cipher") > 0, F.transform(F.array(opened), concatenated)[0])
    return ciphers.select("doc_id", body.alias("body"), *[c.alias(n) for n, c in (keep or {}).items()])


def encrypt_only(new: DataFrame, key: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(records, ciphers) of new documents (doc_id, doc_name, org_id, owner_id, text) whose bodies are not stored: the records are listed as any, the
    texts may be indexed (search.add_to_index), and the ciphers go back to the caller."""
    records = new.select("doc_id", "doc_name", "org_id", "owner_id", F.octet_length(body_of()).cast("long").alias("size_bytes"))
    return records, encrypt_documents(new, key, block_bytes)


def remove_documents(relation: DataFrame, ids: DataFrame) -> DataFrame:
    """relation (documents, chunks, postings or shares) without the documents of ids."""
    return relation.join(ids.select("doc_id"), "doc_id", "left_anti")


def removable(documents: DataFrame, users: DataFrame, user_id: int, ids: DataFrame) -> DataFrame:
    """Those of ids that the caller may remove: own documents, or any of the org for an admin."""
    caller = users.filter(F.col("user_id") == user_id).select("user_id", F.col("org_id").alias("own_org"), "is_admin").limit(1)
    may = documents.join(F.broadcast(caller), F.expr("owner_id = user_id or (is_admin and org_id = own_org)"), "left_semi")
    return may.join(ids, "doc_id", "left_semi").select("doc_id")
