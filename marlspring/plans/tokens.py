"""Documents in chunks of a public tokenizer's tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlspring.operators.tokens import token_chunks as cut
from marlspring.registry import register
from marlspring.session import table


@register("token_chunks")
def token_chunks(spark, sf):
    import public_tokenizers

    chunks = cut(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return chunks.select("doc_id", "chunk_index", "start_token", "end_token", "start_char", "end_char", F.md5("content").alias("digest"))
