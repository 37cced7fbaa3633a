"""A batch of the recovery stream is decided once; results and audit rows are read from the decisions."""
from dunning.streaming import recovery_stream as SM
from helpers import TX_SCHEMA, tx
from dunning.schemas import CUSTOMERS, INVOICES


def test_stream_decides_once(spark, tmp_path, monkeypatch):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    plans = []
    keep = lambda f: lambda wide, *a, **k: (plans.append(wide._jdf.queryExecution().optimizedPlan().toString()), f(wide, *a, **k))[1]
    monkeypatch.setattr(SM, "results", keep(SM.results))
    monkeypatch.setattr(SM, "audit_rows", keep(SM.audit_rows))
    for ids in (("T1", "T2"), ("T2", "T3")):
        spark.createDataFrame([tx(i, 1500, "BANK_TIMEOUT") for i in ids], TX_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        res, audit = SM.incremental_recovery(spark, src, TX_SCHEMA, spark.createDataFrame([], CUSTOMERS), spark.createDataFrame([], INVOICES), out, ckpt)
    assert len(plans) == 4 and not any("Join" in p for p in plans)
    assert sorted(r.transaction_id for r in spark.read.parquet(res).collect()) == ["T1", "T2", "T3"]
    assert spark.read.parquet(audit).where("stage = 'execution'").groupBy("transaction_id").count().where("count = 3").count() == 3
