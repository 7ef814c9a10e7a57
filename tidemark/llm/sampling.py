"""Splits and bounded samples by hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_part(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % parts


def per_label(df: DataFrame, id_column: str, text_column: str, label_column: str, rows: int, size: int) -> DataFrame:
    """(text, label) of a sample by hash of id and text: about `rows` rows and `size` bytes at the most, whole texts, equal pairs once.

    Every label gets at least its share of a quarter of the rows, and the shortest of its texts whatever the shares, so that no label
    is left out. Texts of more than a sixteenth of `size` are sampled in no other way: one of them could not be told from too many.
    """
    text, label = F.coalesce(F.col(text_column), F.lit("")), F.col(label_column)
    hashed = F.pmod(F.xxhash64(F.col(id_column), text, F.lit("sample")), F.lit(1 << 30))
    known = df.filter(label.isNotNull()).select(text.alias("text"), label.alias("label"), hashed.alias("h"), F.octet_length(text).alias("n"))
    fits = F.col("n") <= size // 16
    found = known.groupBy("label").agg(
        F.count(F.when(fits, 1)).alias("rows"), F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0)).alias("size"), F.min(F.struct("n", "h")).alias("least")
    )
    stats = found.collect()
    total, total_size = sum(r["rows"] for r in stats), sum(r["size"] for r in stats)
    kept = F.lit(False)
    for r in stats:
        share = max(rows / max(total, 1), rows / 4 / len(stats) / max(r["rows"], 1))
        share = min(1.0, share, max(size / max(total_size, 1), size / 4 / len(stats) / max(r["size"], 1)))
        chosen = (fits & (F.col("h") < int(share * (1 << 30)))) | ((F.col("n") == r["least"]["n"]) & (F.col("h") == r["least"]["h"]))
        kept = F.when(label == F.lit(r["label"]), chosen).otherwise(kept)
    return known.withColumnRenamed("label", label_column).filter(kept).select("text", label_column).distinct()
