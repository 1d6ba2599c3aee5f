"""Benchmark decontamination: benchmark windows are broadcast in bounded blocks, every document window is scanned.

A document's windows are hashed inside its row, exploded and probed against the broadcast hash table in one
generated loop; a match is verified word by word in the join itself. Only one row per document and the hits cross
a shuffle, never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import let, norm_words, union_all
from rookery.session import stage

WINDOW = 10
#: Bytes of benchmark windows that one broadcast may hold; a larger benchmark is scanned in more blocks.
BLOCK_BYTES = 48 << 20
#: ``norm_words`` cut from a text whose capitals are still there.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _windows(words: Column, width: int) -> Column:
    """(position, width, hash) of every window of ``width`` words."""

    def hashed(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0))),
            lambda i: F.struct(i.alias("pos"), F.lit(width).alias("len"), F.xxhash64(F.slice(h, i + 1, width)).alias("key")),
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashed)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows with the ids of the items they stand in; an item of fewer words is one window, one of none gives none."""
    b = benchmark.select(F.col(item_col).cast("string").alias("item"), norm_words(F.col(text_col)).alias("w")).where("item IS NOT NULL AND size(w) > 0")
    n = F.size("w")
    spans = F.transform(
        F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))),
        lambda i: F.slice(F.col("w"), i + 1, F.least(n, F.lit(window))),
    )
    grams = b.select("item", F.explode(spans).alias("gram")).groupBy("gram").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return grams.select(
        F.xxhash64(F.transform("gram", lambda w: F.xxhash64(w))).alias("gram_key"), F.size("gram").alias("gram_len"), "gram", "items"
    )


def scan(docs: DataFrame, grams: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document (rows equal in id and text count once): ``n_words``, ``hits`` as (pos, len) and ``items``.

    ``grams`` is a staged result of ``benchmark_windows``.
    """
    found = grams.agg(
        F.coalesce(F.sum(64 + F.length(F.array_join("gram", " ")) + F.length(F.array_join("items", ","))), F.lit(0)).alias("bytes"),
        F.sort_array(F.collect_set("gram_len")).alias("lens"),
    ).first()
    blocks = max(1, -(-found["bytes"] // BLOCK_BYTES))
    words = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"), norm_words(F.col(text_col)).alias("_words")
    )

    def block(k: int) -> DataFrame:
        # the first entry of each array stands for the document itself
        own = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("long").alias("key")))
        every = [F.when(F.size("_words") >= n, _windows(F.col("_words"), n)).otherwise(F.array()) for n in found["lens"]]
        spread = words.withColumn("_keys", F.concat(own, *every)).select(
            "_id", "_text", "_words", F.explode_outer("_keys").alias("_k")
        ).select("_id", "_text", "_words", "_k.*")
        side = grams.where(F.pmod("gram_key", F.lit(blocks)) == k) if blocks > 1 else grams
        same = (F.col("key") == F.col("gram_key")) & (F.slice("_words", F.greatest(F.col("pos") + 1, F.lit(1)), F.col("len")) == F.col("gram"))
        return spread.join(F.broadcast(side), same, "left").where("pos < 0 OR gram IS NOT NULL").select(
            "_id", "_text", F.when(F.col("pos") < 0, F.size("_words")).alias("_n"),
            F.when(F.col("pos") >= 0, F.struct("pos", "len")).alias("_hit"), "items",
        )

    hits = union_all([block(k) for k in range(blocks)])
    return hits.groupBy("_id", "_text").agg(
        F.max("_n").cast("long").alias("n_words"), F.collect_set("_hit").alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    ).withColumnRenamed("_id", id_col)


def hit_words(hits: Column) -> Column:
    """Positions of all words inside a hit, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["pos"], h["pos"] + h["len"] - 1)))))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, hit words, items found, the digest of their ids, and whether anything was hit.

    Null and empty texts have no words and no hits. Rows equal in id and text give one row; ids are not
    expected to repeat with different texts, each such text gets its own row. Columns beside id and text are ignored.
    """
    grams = stage(benchmark_windows(benchmark, window), "benchmark_windows")
    found = scan(docs, grams)
    return found.select(
        "doc_id", "n_words", F.size(hit_words(F.col("hits"))).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"), "_text", "hits",
    )


def without_words(text: Column, positions: Column) -> Column:
    """``text`` without the words at ``positions`` (sorted) and without what separates each from the word before it."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)({RAW_WORD}|\z)"), F.lit(0))

    def kept(p: Column) -> Column:
        marks = F.map_from_arrays(positions, F.transform(positions, lambda x: F.lit(True)))
        return let(marks, lambda m: F.array_join(F.filter(p, lambda x, i: m[i].isNull()), ""))

    return let(pieces, kept)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, spans: bool = False) -> DataFrame:
    """``docs`` without contaminated documents or, with ``spans``, without the hit words of each; columns as they were.

    Null ids are matched like any other id.
    """
    dirty = contamination(docs, benchmark, window).where("contaminated").select(
        F.col("doc_id").alias("_dirty_id"), F.col("_text").alias("_dirty_text"), hit_words(F.col("hits")).alias("_dirty_words")
    )
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].eqNullSafe(F.col("_dirty_id")) & (key == F.col("_dirty_text"))
    if not spans:
        return docs.join(dirty.drop("_dirty_words"), same, "left_anti")
    cut = F.when(F.col("_dirty_words").isNull(), docs["text"]).otherwise(without_words(docs["text"], F.col("_dirty_words")))
    joined = docs.join(dirty, same, "left")
    return joined.select(*[cut.alias("text") if c == "text" else docs[c] for c in docs.columns])
