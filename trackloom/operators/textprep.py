"""Place texts made ready for a language model: tokens in blocks of a fixed length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocks(texts: DataFrame, key: str, text: str, length: int = 64, batch: int = 1000) -> DataFrame:
    """batch, block, tokens: texts in the key's order are cut into batches of `batch` (by key), each batch's tokens are put
    together and cut into blocks of `length`; a tail that fills no block goes. labels equal the tokens."""
    t = texts.filter(F.col(text).isNotNull()).select(F.floor(F.col(key) / batch).alias("batch"), key, F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}\[\]<>_]+"), lambda x: x != "").alias("tokens"))
    g = t.groupBy("batch").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(key, "tokens"))), lambda s: s["tokens"])).alias("all"))
    n = F.floor(F.size("all") / length).cast("int")
    cut = g.filter(n > 0).select("batch", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("all", i * length + 1, length))).alias("block", "tokens"))
    return cut.withColumn("labels", F.col("tokens"))


def hashed_vector(texts: DataFrame, text: str, width: int = 64) -> DataFrame:
    """Adds embedding: signed hashed counts of words at length one, a stand-in for a language model's pooling."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    places = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(width)).alias("i"), F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.aggregate(places, F.lit(0.0), lambda t, p: t + F.when(p["i"] == k, p["s"]).otherwise(0.0)))
    from trackloom.functions.columns import unit

    return texts.withColumn("embedding", unit(raw))
