"""Queries of problems 8 and 9."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright.llm.bpe import encode, vocabulary
from lodewright.llm.packing import pack
from lodewright.tables import table

CAPACITY = 2048


def p8_ids(spark, d):
    return encode(table(spark, d, "documents"), vocabulary())


def p8_lengths(spark, d):
    """Documents and tokens per kind of document."""
    docs = table(spark, d, "documents")
    n = encode(docs, vocabulary(), count_only=True)
    return n.join(docs.select("doc_id", "doc_kind"), "doc_id").groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").alias("longest"))


def p9_pack(spark, d):
    return pack(encode(table(spark, d, "documents"), vocabulary(), count_only=True), CAPACITY)


def p9_fill(spark, d):
    """Containers, tokens and the share of room used."""
    used = p9_pack(spark, d).groupBy("container").agg(F.sum("size").alias("used"))
    return used.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.round(F.avg("used") / CAPACITY, 6).alias("fill"))


QUERIES = {"p8_ids": p8_ids, "p8_lengths": p8_lengths, "p9_pack": p9_pack, "p9_fill": p9_fill}
SQL: dict[str, str] = {}  # SQL has no BPE; tests compare with two public encoders and with an exact round trip
