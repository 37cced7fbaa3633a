"""dunning: failed-payment recovery decisions, evaluation and audit as Spark jobs.

Every stage works on whole tables: enrichment joins, per-row decision logic as
Column expressions, bounded attempt unrolling, audit assembly by explode, and
metrics by partial aggregation.  See README.md for the module map.
"""

__all__ = ["session"]
