"""Decision tables of the attempt loop against the definition (TK-05, SX-11, SX-15)."""
import random
from decimal import ROUND_HALF_UP, Decimal as D

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from dunning import catalog as C
from dunning.functions import envelope as EN
from dunning.functions.erv import best_allowed, prepare
from dunning.functions.policy import PolicyContext, approves
from dunning.operators.strategies import evaluate
from helpers import cust, enriched, tx


def _net(action, cls, band, cents):
    exact = D(cents) / 100 * EN.probability(action, cls, band) - C.RANK_COST[action]
    return exact.quantize(D("0.01"), ROUND_HALF_UP)


def _best(cls, band, allowed, cents):
    own = [a for a in C.AUTOMATED if allowed & EN.BIT[a]]
    return max(own, key=lambda a: (_net(a, cls, band, cents), -C.CATALOG_ORDER[a]))


def _table(cls, band, allowed, cents):
    return next(a for lo, hi, a in EN.intervals(cls, band)[allowed] if lo <= cents < hi)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(EN.CLASSES), st.sampled_from(EN.BANDS), st.integers(1, EN.ALL_ACTIONS), st.one_of(st.integers(0, 3000), st.integers(0, 10**17)))
def test_interval_is_argmax(cls, band, allowed, cents):
    assert _table(cls, band, allowed, cents) == _best(cls, band, allowed, cents)


@pytest.mark.parametrize("cls", EN.CLASSES)
def test_every_cent_near_crossings(cls):
    for band in EN.BANDS:
        for allowed, parts in EN.intervals(cls, band).items():
            assert parts[0][0] == 0 and all(a[1] == b[0] and a[2] != b[2] for a, b in zip(parts, parts[1:]))
            for lo, _, _ in parts:
                for cents in range(max(lo - 3, 0), lo + 4):
                    assert _table(cls, band, allowed, cents) == _best(cls, band, allowed, cents), (cls, band, allowed, cents)


def test_first_attempt_is_best_allowed(spark):
    rng = random.Random(3)
    codes = [*C.FAILURE_CODES, None, "ELSE", "card_expired"]
    txs = [tx(f"T{i}", D(rng.choice([rng.randrange(2000), rng.randrange(3 * 10**6)])) / 100, rng.choice(codes), cust=f"C{i % 40}", u_bp=rng.randrange(10**4))
           for i in range(1500)]
    custs = [cust(f"C{i}", rate=rng.choice([0.5, 0.69, 0.7, 0.85, 0.9, 1]), ltv=rng.choice([0, 60000]), pref=rng.choice(["email", "none", "SMS"]),
                  flag=i % 13 == 0) for i in range(40)]
    e = prepare(enriched(spark, txs, custs))
    ctx = PolicyContext(done=F.lit(False), high_value=F.col("hv"), fraud=F.col("risk_flag"), opted_out=F.col("optout"), attempts=F.lit(0),
                        history=F.array().cast("array<string>"))
    want = best_allowed({a: F.col(f"net_{a}") for a in C.ACTION_NAMES}, lambda a: approves(a, ctx))
    first = F.get("optimizer.trail", F.lit(0))
    got = evaluate(enriched(spark, txs, custs), which=("optimizer",)).select(
        "transaction_id", first["recommended_action"].alias("a"), first["expected_net"].alias("net"))
    nets = F.coalesce(*[F.when(F.col("w") == a, F.col(f"net_{a}")) for a in C.ACTION_NAMES])
    both = e.withColumn("w", want).withColumn("w_net", nets).select("transaction_id", "w", "w_net").join(got, "transaction_id")
    assert both.count() == 1500 and both.where("w <> a OR w_net <> net").count() == 0


def test_tables_are_small():
    assert EN._envelope_rows().num_rows < EN.MAX_ROWS and EN._rules_rows().num_rows < EN.MAX_ROWS
