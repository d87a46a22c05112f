"""Shard and placement hashes as columns.

Two modes. ``md5``: portable, SQL engines give the same values. ``xxh64``: XXH64 with seed 0 over the
key's UTF-8 bytes and one 0xFF byte, unsigned modulo the number of shards.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.columns import c

SHARDS = 64
_SIGN = -(1 << 63)


def shard_md5(key: Column | str, shards: int = SHARDS) -> Column:
    return (F.conv(F.substring(F.md5(c(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % shards).cast("int")


def _terminated(*parts: Column) -> Column:
    return F.concat(*parts, F.lit(bytearray(b"\xff")))


def _xxh64_arrow(data: Column) -> Column:
    @F.pandas_udf("long")
    def digest(b: pd.Series) -> pd.Series:
        import xxhash

        return b.map(lambda x: None if x is None else (h := xxhash.xxh64_intdigest(x, 0)) - ((h >> 63) << 64)).astype("Int64")

    return digest(data)


def xxh64(data: Column, df: DataFrame) -> Column:
    """XXH64, seed 0, of a binary column; signed 64 bits. JVM expression on classic sessions, else Arrow batches."""
    try:
        jvm = df.sparkSession._jvm
        expressions = jvm.org.apache.spark.sql.catalyst.expressions
        utils = getattr(getattr(jvm.org.apache.spark.sql.classic, "ExpressionUtils$"), "MODULE$")
        converters = jvm.scala.jdk.javaapi.CollectionConverters
        seq = converters.asScala([utils.expression(data._jc)]).toSeq()
        return Column(utils.column(expressions.XxHash64(seq, 0)))
    except (AttributeError, TypeError):
        return _xxh64_arrow(data)


def unsigned_mod(h: Column, n: int) -> Column:
    return F.pmod(F.pmod(h, F.lit(n)) + F.when(h < 0, (1 << 64) % n).otherwise(0), F.lit(n)).cast("int")


def unsigned_order(h: Column) -> Column:
    """Orders signed 64-bit values as unsigned ones."""
    return h.bitwiseXOR(F.lit(_SIGN))


def shard_xxh64(key: Column | str, df: DataFrame, shards: int = SHARDS) -> Column:
    return unsigned_mod(xxh64(_terminated(c(key).cast("string").cast("binary")), df), shards)


def placement_xxh64(shard: Column, node: Column, df: DataFrame) -> Column:
    """Placement score of a node for a shard: higher wins; ordered as unsigned."""
    byte = lambda k: F.unhex(F.lpad(F.hex(F.shiftrightunsigned(shard.cast("int"), 8 * k).bitwiseAND(255)), 2, "0"))
    return unsigned_order(xxh64(_terminated(byte(0), byte(1), byte(2), byte(3), node.cast("binary")), df))


def placement_md5(shard: Column, node: Column) -> Column:
    return F.md5(F.concat(shard.cast("string"), F.lit(":"), node).cast("binary"))
