"""Authenticated encryption of document blocks inside Spark expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that AES-GCM adds to a block: a 12-byte nonce and a 16-byte tag.
OVERHEAD = 28


def place(doc_id: Column, block_no: Column, n_blocks: Column) -> Column:
    """What a block is bound to, so that blocks can be neither swapped nor left out nor taken from another document."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), block_no.cast("string"), n_blocks.cast("string")).cast("binary")


def encrypt(block: Column, key: Column, where: Column) -> Column:
    """Ciphertext that only opens with the same where. The nonce is random, so no two calls agree."""
    return F.aes_encrypt(block, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), where)


def decrypt(block: Column, key: Column, where: Column) -> Column:
    """Plaintext; null where the key or the place is another."""
    return F.try_aes_decrypt(block, key, F.lit("GCM"), F.lit("DEFAULT"), where)
