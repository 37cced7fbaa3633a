"""Small literal inputs for hand-written cases."""
from datetime import datetime
from decimal import Decimal as D

from dunning.operators.enrich import enrich
from dunning.schemas import CUSTOMERS, INVOICES, TRANSACTIONS
from pyspark.sql import types as T

TX_SCHEMA = T.StructType(TRANSACTIONS.fields + [T.StructField("u_bp", T.IntegerType(), True)])


def tx(tid, amount, code, retry=0, cust="C1", u_bp=9999, status="FAILED", rec="UNRECOVERED"):
    return (tid, cust, None if amount is None else D(str(amount)), "CARD", status, code, retry,
            datetime(2026, 1, 1), rec, D("0"), u_bp)


def cust(cid="C1", rate=0.85, ltv=0, pref="email", flag=False, ctype="returning"):
    return (cid, ctype, D(str(ltv)), None if rate is None else D(str(rate)), pref, flag)


def inv(iid, cid="C1", days=0, amount=100):
    return (iid, cid, D(str(amount)), None, days, False)


def enriched(spark, txs, custs=(), invs=()):
    t = spark.createDataFrame(list(txs), TX_SCHEMA)
    c = spark.createDataFrame(list(custs), CUSTOMERS)
    i = spark.createDataFrame(list(invs), INVOICES)
    return enrich(t, c, i)
