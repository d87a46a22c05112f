"""From a filter to the shards that can hold matches."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.hashing import SHARDS
from quillon.plans.filters import column, keys_of, parse

MOST_KEYS = 128
_INTEGERS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def shard_of(key: Any, shards: int = SHARDS, mode: str = "md5") -> int:
    """The shard of one key; the same as the columns in ``functions.hashing``."""
    data = str(key).encode()
    if mode == "md5":
        return int(hashlib.md5(data).hexdigest()[:8], 16) % shards
    import xxhash

    return xxhash.xxh64_intdigest(data + b"\xff", 0) % shards


@dataclass(frozen=True)
class QueryPlan:
    predicate: Column
    shards: tuple[int, ...] | None
    reason: str

    @property
    def narrowed(self) -> bool:
        return self.shards is not None

    def condition(self) -> Column:
        """The predicate, with the partition filter in front where shards are known."""
        return self.predicate if self.shards is None else F.col("_shard").isin(*self.shards) & self.predicate


def key_texts(literals: tuple, key_type: str) -> list[str] | None:
    """The texts, as they are hashed, of the only keys of a column of ``key_type`` that equal one of the literals.

    None where that is uncertain: comparison is by value, so ``42``, ``42.0``, ``"042"`` and ``"42 "`` are
    all key 42 of an integer column, and a number equals several keys of a string column.
    """
    out: list[str] = []
    if len({type(v) for v in literals}) > 1:  # compared in a type that depends on all of them
        return None
    for v in literals:
        if key_type == "string" and isinstance(v, str):
            out.append(v)
        elif key_type in _INTEGERS and not isinstance(v, bool):
            if isinstance(v, float) and v.is_integer() and abs(v) < 1 << 53:
                v = int(v)
            elif isinstance(v, str) and re.fullmatch(r"[+-]?[0-9]+", v.strip(" \t\n\r")):
                v = int(v)
            if not isinstance(v, int) or not -(1 << _INTEGERS[key_type] - 1) <= v < 1 << _INTEGERS[key_type] - 1:
                return None
            out.append(str(v))
        else:
            return None
    return out


def plan(source: Any, pk: str, shards: int = SHARDS, mode: str = "md5", most_keys: int = MOST_KEYS, key_type: str = "bigint") -> QueryPlan:
    """The predicate of a filter, and the shards it needs. key_type: the primary key's type, by Spark's short name."""
    node = parse(source)
    if node is None:
        return QueryPlan(column(node), None, "no filter")
    keys = keys_of(node, pk, lambda v: key_texts(v, key_type))
    if keys is None:
        return QueryPlan(column(node), None, "no condition on the primary key")
    if len(keys) > most_keys:
        return QueryPlan(column(node), None, f"more than {most_keys} keys")
    return QueryPlan(column(node), tuple(sorted({shard_of(k, shards, mode) for k in keys})), "primary key")
