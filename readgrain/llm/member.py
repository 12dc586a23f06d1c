"""A map-side test of membership: which rows can be in a table, before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readgrain.llm.common import materialise

#: Bits per member, and at most in all (16 MB); beyond that more rows pass, which costs a shuffle of them and changes no result.
PER, MOST = 16, 2**27
WORD = 32768


def maybe_members(rows: DataFrame, value: str, ids: DataFrame, column: str, out: str) -> DataFrame:
    """rows with a boolean column (out), false only where their value is not in ids[column]; both of one type.

    A hash of each member sets a bit. Bits are gathered into pieces of 4 KB, of which at most MOST / WORD are broadcast, so 16 MB; a row
    looks its piece up and its bit in it, without leaving the JVM.
    """
    n = max(1, ids.count())
    bits = WORD
    while bits < min(MOST, n * PER):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    piece = lambda c: F.floor(place(c) / WORD).cast("int")
    pieces = ids.select(piece(column).alias("__rg_piece"), (place(column) % WORD).alias("at")).groupBy("__rg_piece").agg(F.bitmap_construct_agg("at").alias("__rg_bits"))
    pieces = materialise(pieces, "members")
    at = (place(value) % WORD).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__rg_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1)) == 1
    found = rows.withColumn("__rg_at", piece(value)).join(F.broadcast(pieces), F.col("__rg_at") == F.col("__rg_piece"), "left")
    return found.withColumn(out, F.coalesce(held, F.lit(False))).drop("__rg_at", "__rg_piece", "__rg_bits")
