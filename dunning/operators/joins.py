"""Skew-aware N:1 lookup join in one plan.

A fact table (transactions, audit rows) joins a dimension keyed by ``key``
(customers, transaction context).  NULL keys match nothing, but a plain outer
join would send all of them to one task; here a NULL-key row gets a salt from
a hash of the whole row, and the salt is part of the join key (0 on the other
side), so those rows spread evenly.  A hot non-NULL key is split by the
adaptive skew join (``spark.sql.adaptive.skewJoin.enabled``): both inputs are
exchanged by the join itself, so any number of oversized partitions can be cut
by size at run time.  No extra pass counts keys, nothing is collected, and the
plan has one scan of the fact side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NULL_SALTS = 4096


def lookup_join(big: DataFrame, small: DataFrame, key: str, how: str = "left") -> DataFrame:
    hashable = [f.name for f in big.schema.fields if f.dataType.typeName() != "map"]
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in hashable]), F.lit(NULL_SALTS)) + 1)
    left = big.withColumn("_salt", F.coalesce(salt, F.lit(0)))
    right = small.withColumn("_salt", F.lit(0).cast("bigint"))
    return left.join(right, [key, "_salt"], how).drop("_salt")
