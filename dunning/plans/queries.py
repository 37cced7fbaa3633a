"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over
the whole derived tables.  Names match the SQL oracles in
:mod:`dunning.plans.oracles`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import diagnosis as DX
from ..functions.erv import candidates, code_class, prepare
from ..functions.policy import PolicyContext, done_flag, final_action, policy_rule, reason_text, result_of
from ..functions.risk import risk
from ..operators import audit as AU
from ..operators import incremental as INC
from ..operators import metrics as M
from ..operators.enrich import attempt_history, enrich
from ..operators.positions import with_positions
from ..operators.strategies import evaluate, pair, plan_barrier, results
from ..sources import fixtures as FX
from .output import to_output

RUN_TS = "2026-01-01 00:00:00"


def fixture_latency(tx, stage_no):
    """Recorded stage latency of the fixtures in microseconds."""
    k = F.substring(tx, 3, 10).cast("long")
    return (k * 13 + stage_no * 7) % 1000


def _inputs(spark: SparkSession, sf_dir: str):
    return FX.load_inputs(spark, sf_dir)


def _enriched(spark, sf_dir, **kw):
    inp = _inputs(spark, sf_dir)
    return enrich(inp.transactions, inp.customers, inp.invoices, **kw)


def _wide(spark, sf_dir, which=("baseline", "rules", "optimizer")):
    return evaluate(_enriched(spark, sf_dir), which=which)


# ---------------------------------------------------------------- scans
def customers_scan(spark, sf_dir):
    return to_output(_inputs(spark, sf_dir).customers)


def transactions_scan(spark, sf_dir):
    t = _inputs(spark, sf_dir).transactions.drop("u_bp")
    return to_output(t)


def invoices_scan(spark, sf_dir):
    return to_output(_inputs(spark, sf_dir).invoices)


def enriched(spark, sf_dir):
    e = _enriched(spark, sf_dir)
    return to_output(e.select("transaction_id", "customer_id", "has_customer", "erv_rate", "ltv", "risk_flag",
                              "preference", "risk_rate", "invoice_id",
                              F.col("days_overdue").cast("double").alias("days_overdue")))


# ---------------------------------------------------------------- ERV
def _cands(spark, sf_dir):
    e = plan_barrier(prepare(_enriched(spark, sf_dir)))
    return e.select("transaction_id", candidates(e).alias("c"))


def erv_candidates(spark, sf_dir):
    c = _cands(spark, sf_dir).select("transaction_id", F.explode("c").alias("x")).select("transaction_id", "x.*")
    return to_output(c.drop("automated"))


def erv_ranked(spark, sf_dir):
    """Candidates ranked by expected net (desc), catalog order on ties (WN-04);
    the rank is computed inside the row (7 candidates), so no shuffle."""
    c = _cands(spark, sf_dir)
    ordered = F.sort_array(F.transform("c", lambda x: F.struct(
        (-x["expected_net"]).alias("loss"), x["catalog_order"].alias("catalog_order"), x["action"].alias("action"),
        x["expected_net"].alias("expected_net"))))
    r = c.select("transaction_id", F.posexplode(ordered).alias("pos", "x"))
    return to_output(r.select("transaction_id", (F.col("pos") + 1).cast("long").alias("erv_rank"),
                              F.col("x.action").alias("action"), F.col("x.expected_net").alias("expected_net")))


def best_action(spark, sf_dir):
    """First decision per transaction: best approved automated action by
    expected net, its policy verdict and executed action (TK-05, SX-15/16)."""
    w = _wide(spark, sf_dir, which=("optimizer",))
    t = F.element_at(F.col("optimizer.trail"), 1)
    return to_output(w.select(
        "transaction_id",
        t["recommended_action"].alias("best_action"),
        t["expected_net"].alias("expected_net"),
        F.col("optimizer.trail")[0]["policy_rule"].alias("policy_rule"),
        t["final_action"].alias("executed_action"),
    ))


# ---------------------------------------------------------------- risk
def _risk(spark, sf_dir):
    e = _enriched(spark, sf_dir)
    return e.select("transaction_id", risk(F.col("amount"), F.col("failure_code"), F.col("retry_count"),
                                           F.col("risk_rate"), F.col("risk_flag"), F.col("days_overdue")).alias("r"))


def risk_scores(spark, sf_dir):
    r = _risk(spark, sf_dir)
    return to_output(r.select("transaction_id", "r.risk_score", "r.risk_level", "r.breakdown.*", "r.reason"))


def risk_signals(spark, sf_dir):
    r = _risk(spark, sf_dir)
    return to_output(r.select("transaction_id", F.size("r.signals").cast("long").alias("n_signals"),
                              F.array_join("r.signals", " | ").alias("signals")))


# ---------------------------------------------------------------- diagnosis
def diagnosis_rules(spark, sf_dir):
    """Code -> root cause -> ranking code, the rules action for attempts 0/1,
    and the fallback diagnosis with and without the flipping action tried
    (SX-09..SX-12) for every transaction."""
    t = _inputs(spark, sf_dir).transactions
    cls = code_class(F.col("failure_code"))
    t = t.select("transaction_id", "failure_code", cls.alias("cls"))
    cause = DX.root_cause_from_class(F.col("cls"))
    fb0 = DX.fallback_diagnosis(F.col("cls"), F.array().cast("array<string>"))
    tried = F.array(F.lit("retry_payment"), F.lit("send_payment_reminder"))
    fb1 = DX.fallback_diagnosis(F.col("cls"), tried)
    return to_output(t.select(
        "transaction_id",
        cause.alias("root_cause"),
        DX.ranking_code_from_cause(cause).alias("rank_code"),
        DX.rules_action(F.col("cls"), F.lit(0)).alias("rules_first"),
        DX.rules_action(F.col("cls"), F.lit(1)).alias("rules_later"),
        fb0["recommended_action"].alias("fallback_first"),
        fb0["confidence"].alias("fallback_confidence"),
        fb0["reason"].alias("fallback_reason"),
        fb1["recommended_action"].alias("fallback_after_tried"),
        fb1["why_not_alternatives"].alias("fallback_after_tried_why"),
    ))


def policy_matrix(spark, sf_dir):
    """Every catalog action (plus one unsupported name) x attempts 0..2 x
    empty / already-tried history, through the guardrail (SX-15, SX-16)."""
    e = prepare(_enriched(spark, sf_dir))
    cases = [F.struct(F.lit(a).alias("action"), F.lit(n).alias("attempts"), F.lit(h).alias("tried"))
             for a in C.ACTION_NAMES + ["unauthorized_action_xyz"] for n in (0, 1, 2) for h in (False, True)]
    g = e.select("transaction_id", "amount", done_flag(F.col("status"), F.col("recovery_status")).alias("done"), "hv", "risk_flag", "optout",
                 F.explode(F.array(*cases)).alias("x"))
    g = g.select("transaction_id", "amount", "done", "hv", "risk_flag", "optout", "x.*")
    hist = F.when(F.col("tried"), F.array(F.col("action"))).otherwise(F.array().cast("array<string>"))
    ctx = PolicyContext(done=F.col("done"), high_value=F.col("hv"), fraud=F.col("risk_flag"), opted_out=F.col("optout"),
                        attempts=F.col("attempts"), history=hist)
    # the rule, then its result, as columns of their own: what follows reads them instead of repeating the rules
    v = g.select("transaction_id", "amount", "action", "attempts", "tried", policy_rule(F.col("action"), ctx).alias("policy_rule"))
    v = v.select("*", result_of(F.col("policy_rule")).alias("result"))
    return to_output(v.select("transaction_id", "action", F.col("attempts").cast("long"), "tried",
                              (F.col("result") == "APPROVED").alias("allowed"), "result", "policy_rule",
                              reason_text(F.col("policy_rule"), F.col("action"), F.col("transaction_id"), F.col("amount")).alias("reason"),
                              final_action(F.col("result"), F.col("action")).alias("final_action")))


# ---------------------------------------------------------------- strategies
def _results(spark, sf_dir, which):
    return results(_wide(spark, sf_dir, which=which), which=which)


def _result_view(df: DataFrame) -> DataFrame:
    return to_output(df.select("transaction_id", "amount", "failure_code",
                               F.col("risk_score").cast("double").alias("risk_score"), "risk_level",
                               "recommended_action", "policy_result", "final_action", "status",
                               "amount_recovered", "execution_count", "automated_attempts", "cost",
                               "description"))


def baseline_results(spark, sf_dir):
    return _result_view(_results(spark, sf_dir, ("baseline",)))


def rules_results(spark, sf_dir):
    return _result_view(_results(spark, sf_dir, ("rules",)))


def optimizer_results(spark, sf_dir):
    return _result_view(_results(spark, sf_dir, ("optimizer",)))


def strategy_summary(spark, sf_dir):
    return to_output(M.strategy_summary(_results(spark, sf_dir, ("baseline", "rules", "optimizer"))))


def uplift(spark, sf_dir):
    return to_output(M.uplift(M.strategy_summary(_results(spark, sf_dir, ("baseline", "rules", "optimizer")))))


def decision_changes(spark, sf_dir):
    return to_output(M.decision_changes(_wide(spark, sf_dir, which=("rules", "optimizer"))))


def distributions(spark, sf_dir):
    """Three value counts from one evaluation and one aggregate."""
    r = _results(spark, sf_dir, ("baseline", "rules", "optimizer"))
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value"))
                      for c in ("final_action", "failure_code", "policy_result")])
    return to_output(M.ranked_counts(r.select("strategy", F.explode(pairs).alias("p")).select("strategy", "p.*"), ["dimension", "strategy"], "value"))


def funnel(spark, sf_dir):
    return to_output(M.funnel(_results(spark, sf_dir, ("baseline", "rules", "optimizer"))))


# ---------------------------------------------------------------- audit
def _audit(spark, sf_dir, strategy="optimizer"):
    w = _wide(spark, sf_dir, which=(strategy,))
    return AU.audit_rows(w, strategy, run_ts=RUN_TS, latency=fixture_latency)


def audit_scan(spark, sf_dir):
    a = _audit(spark, sf_dir)
    return to_output(a.select("transaction_id", "attempt_no", "stage_no", "timestamp", "stage", "agent_action",
                              "policy_result", "tool_result", "amount_recovered", "reason"))


def actions_breakdown(spark, sf_dir):
    return to_output(AU.actions_breakdown(_audit(spark, sf_dir)))


def policy_breakdown(spark, sf_dir):
    return to_output(AU.policy_breakdown(_audit(spark, sf_dir)))


def stage_latency(spark, sf_dir):
    return to_output(AU.stage_latency(_audit(spark, sf_dir)))


QUERIES = {
    "customers_scan": customers_scan,
    "transactions_scan": transactions_scan,
    "invoices_scan": invoices_scan,
    "enriched": enriched,
    "erv_candidates": erv_candidates,
    "erv_ranked": erv_ranked,
    "best_action": best_action,
    "risk_scores": risk_scores,
    "risk_signals": risk_signals,
    "diagnosis_rules": diagnosis_rules,
    "policy_matrix": policy_matrix,
    "baseline_results": baseline_results,
    "rules_results": rules_results,
    "optimizer_results": optimizer_results,
    "strategy_summary": strategy_summary,
    "uplift": uplift,
    "decision_changes": decision_changes,
    "distributions": distributions,
    "funnel": funnel,
    "audit_scan": audit_scan,
    "actions_breakdown": actions_breakdown,
    "policy_breakdown": policy_breakdown,
    "stage_latency": stage_latency,
}


# ---------------------------------------------------------------- state and views
from ..operators import state as ST  # noqa: E402
from ..operators import views as VW  # noqa: E402

SEARCH = "tx0+12"


def _snapshot(spark, sf_dir):
    return ST.snapshot_after(_wide(spark, sf_dir, which=("optimizer",)), "optimizer")


def kpis(spark, sf_dir):
    return to_output(M.kpis(_snapshot(spark, sf_dir)))


def failure_breakdown(spark, sf_dir):
    return to_output(M.failure_breakdown(_inputs(spark, sf_dir).transactions))


def control_room_rows(spark, sf_dir):
    return to_output(VW.control_room(_snapshot(spark, sf_dir)))


def failure_reasons(spark, sf_dir):
    return to_output(VW.failure_reasons(VW.control_room(_inputs(spark, sf_dir).transactions)))


def faceted_filter(spark, sf_dir):
    rows = VW.control_room(_snapshot(spark, sf_dir))
    return to_output(VW.faceted(rows, status="RECOVERED", reason="Bank Timeout")
                     .select("transaction_id", "recovery_status", "failure_reason", "recovered_amount"))


def search_ids(spark, sf_dir):
    rows = VW.control_room(_inputs(spark, sf_dir).transactions)
    return to_output(VW.faceted(rows, search=SEARCH).select("transaction_id", "failure_reason"))


def lookup_ids(spark, sf_dir):
    t = _inputs(spark, sf_dir).transactions
    ids = t.select("transaction_id").unionByName(
        spark.createDataFrame([("TX9999999999",), ("TXMISSING",)], "transaction_id string"))
    return to_output(VW.lookup(ids, t).select("transaction_id", "found", "amount"))


def failed_filter(spark, sf_dir):
    snap = _snapshot(spark, sf_dir)
    return to_output(VW.list_view(snap.where(F.col("status") == "FAILED")))


def first_n(spark, sf_dir):
    return to_output(VW.list_view(ST.first_n(_inputs(spark, sf_dir).transactions, 1000)))


def state_apply(spark, sf_dir):
    return to_output(_snapshot(spark, sf_dir).select("transaction_id", "status", "retry_count",
                                                     "recovery_status", "recovered_amount"))


def invoice_resolution(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    w = evaluate(enrich(inp.transactions, inp.customers, inp.invoices), which=("optimizer",))
    return to_output(ST.resolve_invoices(inp.invoices, w, "optimizer")
                     .select("invoice_id", "customer_id", "days_overdue", "promise_to_pay"))


def policy_violations(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    w = evaluate(enrich(inp.transactions, inp.customers, inp.invoices), which=("optimizer",))
    a = AU.audit_rows(w, "optimizer", run_ts=RUN_TS)
    return to_output(AU.policy_violations(a, inp.transactions, inp.customers))


def stopping_violations(spark, sf_dir):
    return to_output(AU.stopping_violations(_audit(spark, sf_dir)))


def all_attempt_cost(spark, sf_dir):
    return to_output(AU.all_attempt_cost(_audit(spark, sf_dir)))


def latest_diagnosis(spark, sf_dir):
    return to_output(AU.latest_diagnosis(_audit(spark, sf_dir)).drop("strategy"))


def history(spark, sf_dir):
    from ..operators.enrich import history as H
    h = H(FX.prior_audit_view(_inputs(spark, sf_dir).orders))
    return to_output(h.select("transaction_id", "prior_executions", "prior_automated", "prior_terminal",
                              "prior_success", "prior_last_action",
                              F.array_join("prior_actions", ",").alias("prior_actions")))


def _resume_enriched(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    prior = FX.prior_audit_view(inp.orders)
    state = ST.state_from_audit(inp.transactions, prior)
    return enrich(state, inp.customers, inp.invoices)


def terminal_gate(spark, sf_dir):
    g = ST.gate(_resume_enriched(spark, sf_dir))
    return to_output(g.select("transaction_id", "recovery_status", "prior_executions", "gate_status"))


def _resume_results(spark, sf_dir):
    e = ST.pending(_resume_enriched(spark, sf_dir))
    w = evaluate(e, which=("optimizer",))
    return results(w, which=("optimizer",))


def batch_resume(spark, sf_dir):
    r = _resume_results(spark, sf_dir)
    return to_output(r.select("transaction_id", "final_action", "status", "amount_recovered",
                              "execution_count", "automated_attempts"))


def batch_summary(spark, sf_dir):
    return to_output(M.batch_summary(_resume_results(spark, sf_dir)))


def validation_report(spark, sf_dir):
    t = _inputs(spark, sf_dir).transactions
    bad = spark.createDataFrame(
        [("TXBAD0000001", None, 0), ("TXBAD0000002", -500.0, 0), ("TXBAD0000003", 100.0, -1)],
        "transaction_id string, amount double, retry_count int")
    bad = bad.select("transaction_id", F.col("amount").cast("decimal(18,2)").alias("amount"), "retry_count")
    tx = t.select("transaction_id", "amount", "retry_count").unionByName(bad)
    req = tx.select("transaction_id").unionByName(
        spark.createDataFrame([("",), (None,), ("TXMISSING",)], "transaction_id string"))
    return to_output(ST.validate(req, tx))


def risk_sequential(spark, sf_dir):
    w = _wide(spark, sf_dir, which=("optimizer",))
    seq = ST.sequential_overdue(w, "optimizer")
    r = ST.sequential_risk(seq)
    return to_output(seq.select("transaction_id", F.col("days_overdue_seq").cast("double").alias("days_overdue_seq"),
                                r["risk_score"].alias("risk_score_seq")))


def transaction_360(spark, sf_dir):
    w = materialized(_wide(spark, sf_dir, which=("optimizer",)), "wide")   # decided once, read for the context and for the trail
    v = VW.transaction_360(w, "optimizer", run_ts=RUN_TS)
    return to_output(v.select("transaction_id", "attempt_no", "stage_no", "stage", "agent_action", "amount",
                              "customer_type", "invoice_id", "recovery_status"))


def report(spark, sf_dir):
    return to_output(M.report(M.strategy_summary(_results(spark, sf_dir, ("baseline", "rules", "optimizer")))))


QUERIES.update({
    "kpis": kpis,
    "failure_breakdown": failure_breakdown,
    "control_room_rows": control_room_rows,
    "failure_reasons": failure_reasons,
    "faceted_filter": faceted_filter,
    "search_ids": search_ids,
    "lookup_ids": lookup_ids,
    "failed_filter": failed_filter,
    "first_n": first_n,
    "state_apply": state_apply,
    "invoice_resolution": invoice_resolution,
    "policy_violations": policy_violations,
    "stopping_violations": stopping_violations,
    "all_attempt_cost": all_attempt_cost,
    "latest_diagnosis": latest_diagnosis,
    "history": history,
    "terminal_gate": terminal_gate,
    "batch_resume": batch_resume,
    "batch_summary": batch_summary,
    "validation_report": validation_report,
    "risk_sequential": risk_sequential,
    "transaction_360": transaction_360,
    "report": report,
})


# ---------------------------------------------------------------- model tables
from ..operators import model_io as MI  # noqa: E402


def _responses(spark, sf_dir):
    return FX.responses_view(_inputs(spark, sf_dir).orders)


def prompt_requests(spark, sf_dir):
    return to_output(MI.prompt_requests(_wide(spark, sf_dir, which=("optimizer",))))


def response_valid(spark, sf_dir):
    r = MI.response_table(_responses(spark, sf_dir))
    return to_output(r.select("transaction_id", F.col("attempt_no").cast("long").alias("attempt_no"), "valid", "root_cause", "confidence"))


def _diagnosed_wide(spark, sf_dir):
    e = MI.attach_responses(_enriched(spark, sf_dir), _responses(spark, sf_dir))
    return evaluate(e, model=True, which=("optimizer",))


def _diagnosed_view(w):
    first, second = (F.get("optimizer.trail", F.lit(k)) for k in (0, 1))
    return to_output(w.select("transaction_id", first["diagnosis_source"].alias("diagnosis_source"), first["root_cause"].alias("root_cause"),
                              second["diagnosis_source"].alias("second_source"), second["root_cause"].alias("second_cause"),
                              second["recommended_action"].alias("second_action"),
                              F.col("optimizer.final_action").alias("final_action"), F.col("optimizer.status").alias("status")))


def diagnosed(spark, sf_dir):
    """MI-04: both attempts' causes, by the model where it answered, and what they led to."""
    return _diagnosed_view(_diagnosed_wide(spark, sf_dir))


def stream_diagnosed(spark, sf_dir):
    """MI-04 / JN-10 in two streaming rounds: answers count that came within 12 seconds;
    second attempts ask when the first answers are in."""
    inp = _inputs(spark, sf_dir)
    responses, work = _scratch(spark, "model-responses"), _scratch(spark, "model-run")
    asked = F.col("timestamp").cast("timestamp")
    later = F.when(F.col("attempt_no") == 1, F.lit(0)).otherwise(F.lit(3600))
    told = FX.responses_view(inp.orders).join(inp.transactions.select("transaction_id", asked.alias("t")), "transaction_id")
    told = told.select("transaction_id", "attempt_no", "response_text",
                       F.timestamp_seconds(F.unix_timestamp("t") + later + F.col("delay_s")).alias("answered_at"))
    _spread(told).write.parquet(responses)
    return _diagnosed_view(two_phase_diagnosis(_enriched(spark, sf_dir), responses, work, columns=("transaction_id", "optimizer")))


def model_contribution(spark, sf_dir):
    return to_output(MI.model_contribution(_diagnosed_wide(spark, sf_dir)))


# ---------------------------------------------------------------- sources / sinks
import uuid  # noqa: E402

from ..schemas import TRANSACTIONS  # noqa: E402
from ..session import checkpoint_dir, materialized  # noqa: E402
from ..sources import io as IO  # noqa: E402


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def csv_roundtrip(spark, sf_dir):
    r = _results(spark, sf_dir, ("optimizer",))
    path = _scratch(spark, "csv")
    IO.write_results_csv(r, path)
    back = IO.read_results_csv(spark, path)
    return _result_view(back)


def json_summary_roundtrip(spark, sf_dir):
    s = M.strategy_summary(_results(spark, sf_dir, ("baseline", "rules", "optimizer")))
    path = _scratch(spark, "json")
    IO.write_summary_json(s, path)
    return to_output(IO.read_summary_json(spark, path))


def run_overwrite(spark, sf_dir):
    r = materialized(_results(spark, sf_dir, ("baseline", "rules", "optimizer")), "results")   # decided once for both writes
    path = _scratch(spark, "runs")
    IO.write_runs(r, path)
    IO.write_runs(r.where(F.col("strategy") == "optimizer"), path)   # idempotent re-run of one partition
    back = spark.read.parquet(path)
    return to_output(back.select("strategy", "transaction_id", "final_action", "status"))


def formatted_kpis(spark, sf_dir):
    s = M.strategy_summary(_results(spark, sf_dir, ("baseline", "rules", "optimizer")))
    return to_output(VW.formatted_kpis(s))


# ---------------------------------------------------------------- streams
from ..streaming import attempt_stream as AS  # noqa: E402
from ..streaming import recovery_stream as SM  # noqa: E402
from ..streaming.model_stream import two_phase_diagnosis  # noqa: E402


def _spread(df):
    """Partitions by size for a source folder, whatever the number of distinct keys."""
    return df.hint("rebalance")


def _stream_source(spark, sf_dir):
    """The transactions view written as parquet files (the arriving stream); the
    draw column travels with the rows."""
    t = _inputs(spark, sf_dir).transactions
    path = _scratch(spark, "stream-in")
    _spread(t).write.parquet(path)
    return path, t.schema


def stream_recovery(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    src, schema = _stream_source(spark, sf_dir)
    out, _ = SM.incremental_recovery(spark, src, schema, inp.customers, inp.invoices,
                                     _scratch(spark, "stream-out"), _scratch(spark, "stream-ckpt"))
    return _result_view(spark.read.parquet(out).drop("stream", "batch_id", "strategy"))


def stream_two_runs(spark, sf_dir):
    """SM-01 restarted: half of the transactions, then the rest together with ids
    that the first run decided and ids recovered elsewhere.  Every id has one
    result, the first run's included, and as many execution rows as counted."""
    inp = _inputs(spark, sf_dir)
    t = FX.edge_transactions_view(inp.orders)
    src, out, ckpt = (_scratch(spark, x) for x in ("stream-in", "stream-out", "stream-ckpt"))
    first = F.substring("transaction_id", -1, 1).cast("int") % 2 == 0
    _spread(t.where(first)).write.parquet(src)
    SM.incremental_recovery(spark, src, t.schema, inp.customers, inp.invoices, out, ckpt)
    again = t.where(first & F.col("transaction_id").endswith("4"))
    _spread(t.where(~first).unionByName(again)).write.mode("append").parquet(src)
    res, audit = SM.incremental_recovery(spark, src, t.schema, inp.customers, inp.invoices, out, ckpt)
    ex = (spark.read.parquet(audit).where(F.col("stage") == "execution").groupBy("transaction_id")
          .agg(F.count(F.lit(1)).alias("audited")))
    r = spark.read.parquet(res).join(ex, "transaction_id", "left")
    return to_output(_edge_columns(r).withColumn("audited", F.coalesce(r["audited"], F.lit(0))))


def _edge_columns(r):
    return r.select("transaction_id", "final_action", "status", "amount_recovered", "execution_count",
                    *[c for c in ("audited",) if c in r.columns],
                    F.when(F.col("status") == "ERROR", F.col("description")).alias("error_reason"))


def edge_results(spark, sf_dir):
    """Invalid, finished and partly retried transactions through all strategies."""
    inp = _inputs(spark, sf_dir)
    w = evaluate(enrich(FX.edge_transactions_view(inp.orders), inp.customers, inp.invoices), which=("baseline", "optimizer"))
    return to_output(_edge_columns(results(w, which=("optimizer",))).join(
        w.select("transaction_id", F.col("baseline.status").alias("baseline_status")), "transaction_id"))


def edge_state(spark, sf_dir):
    """SK-04 on the same rows: a recovered transaction stays so."""
    inp = _inputs(spark, sf_dir)
    w = evaluate(enrich(FX.edge_transactions_view(inp.orders), inp.customers, inp.invoices), which=("optimizer",))
    return to_output(ST.snapshot_after(w, "optimizer").select("transaction_id", "recovery_status", "recovered_amount"))


def edge_360(spark, sf_dir):
    """JN-05 with transactions that have no trail: how many rows each has."""
    inp = _inputs(spark, sf_dir)
    w = evaluate(enrich(FX.edge_transactions_view(inp.orders), inp.customers, inp.invoices), which=("optimizer",))
    v = VW.transaction_360(w, "optimizer", run_ts=RUN_TS)
    return to_output(v.groupBy("transaction_id").agg(F.count("stage").alias("trail_rows"), F.max("customer_type").alias("customer_type")))


def pending_batch(spark, sf_dir):
    """TK-02: the next 500 pending transactions."""
    return to_output(ST.pending(_resume_enriched(spark, sf_dir), 500).select("transaction_id", "gate_status", "prior_executions"))


def ordered_history(spark, sf_dir):
    """AG-20 / JN-03: ordered histories over three runs with repeated rows and one hot transaction."""
    h = attempt_history(FX.audit_runs_view(_inputs(spark, sf_dir).orders), 3)
    return to_output(h.select("transaction_id", "executions", *[f"n_{a}" for a in C.ACTION_NAMES],
                              F.array_join("first_actions", " ").alias("first_actions"), F.array_join("last_actions", " ").alias("last_actions")))


def trail_positions(spark, sf_dir):
    """WN-02 / TK-03 where one transaction holds a third of all rows: the place of every
    execution in its transaction."""
    rows = FX.audit_runs_view(_inputs(spark, sf_dir).orders).dropDuplicates(["strategy", "transaction_id", "attempt_no"])
    placed = with_positions(rows, "transaction_id", ["timestamp", "attempt_no", "strategy"], "position")
    return to_output(placed.select("strategy", "transaction_id", F.col("attempt_no").cast("long").alias("attempt_no"), "agent_action", "position"))


def audit_timeline(spark, sf_dir):
    """The executions that recovered, with their position among all executions of
    their transaction (WN-02).  The whole timeline is ``audit_trail_timeline``."""
    a = AU.execution_attempt_numbers(_audit(spark, sf_dir))
    won = a.where((F.col("stage") == "execution") & (F.col("tool_result") == "SUCCESS"))
    return to_output(won.orderBy("transaction_id", "execution_no")
                     .select("transaction_id", F.col("execution_no").alias("attempt_no"), "agent_action"))


def audit_trail_timeline(spark, sf_dir):
    """TK-03 / WN-02: every audit row of an earlier run and of the run that resumes
    after it, oldest first, executions numbered per transaction over both runs."""
    prior = FX.prior_audit_view(_inputs(spark, sf_dir).orders)
    w = evaluate(ST.pending(_resume_enriched(spark, sf_dir)), which=("optimizer",))
    a = prior.unionByName(AU.audit_rows(w, "optimizer", run_ts=RUN_TS, latency=fixture_latency))
    return to_output(VW.audit_timeline(AU.execution_attempt_numbers(a)).select(
        "strategy", "transaction_id", "attempt_no", "stage_no", "stage", "agent_action", "policy_result", "tool_result", "execution_no"))


def filtered_head(spark, sf_dir):
    """TK-04: top 100 of the filtered control room."""
    rows = VW.control_room(_snapshot(spark, sf_dir))
    return to_output(VW.filtered_head(rows, 100, status="RECOVERED").select("transaction_id", "recovery_status", "recovered_amount"))


def outcome_join(spark, sf_dir):
    """JN-09: draws from a table of their own, of which some are missing."""
    inp = _inputs(spark, sf_dir)
    draws = FX.outcomes_view(inp.orders).where(~F.col("transaction_id").endswith("3"))
    e = enrich(inp.transactions.drop("u_bp"), inp.customers, inp.invoices, outcomes=draws)
    r = results(evaluate(e, which=("optimizer",)), which=("optimizer",))
    return to_output(r.select("transaction_id", "final_action", "status"))


def _stored(spark, df, name, key="transaction_id"):
    """A bucketed table of this session, read back by name."""
    table = f"{name}_{uuid.uuid4().hex}"
    IO.write_bucketed(df, table, _scratch(spark, name), key, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.table(table)


def stored_pairs(spark, sf_dir):
    """JN-06 / SC-07: decision changes of two stored result tables, read by name; both are
    bucketed by transaction, so the join needs no exchange."""
    r = materialized(_results(spark, sf_dir, ("rules", "optimizer")), "pairs")
    both = pair(*[_stored(spark, r.where(F.col("strategy") == s), s) for s in ("rules", "optimizer")])
    return to_output(both.where(~F.col("left_action").eqNullSafe(F.col("right_action"))))


def stored_360(spark, sf_dir):
    """JN-05, nested, from stored tables read by name: a transaction, its context and its
    ordered trail in one record (shown as text)."""
    w = materialized(_wide(spark, sf_dir, which=("optimizer",)).select(
        "transaction_id", "amount", "failure_code", "customer_type", "invoice_id", "recovery_status", "optimizer"), "wide")
    context = _stored(spark, w.drop("optimizer"), "context")
    trail = _stored(spark, AU.audit_rows(w, "optimizer", run_ts=RUN_TS), "trail")
    text = F.array_join(F.transform("trail", lambda x: F.concat_ws(".", x["attempt_no"].cast("string"), x["stage"], F.coalesce(x["agent_action"], F.lit("-")))), " ")
    return to_output(VW.nested_360(context, trail).select("transaction_id", "amount", "customer_type", "invoice_id", F.size("trail").cast("long").alias("entries"),
                                                          text.alias("trail")))


def observed_run(spark, sf_dir):
    """AG-18, AG-19, AG-22 from the pass that writes the results."""
    w = _wide(spark, sf_dir, which=("optimizer",))
    return to_output(IO.write_observed(w, _scratch(spark, "observed"), M.run_observations("optimizer")))


def _three_batches(spark, sf_dir):
    """The KPI state after three batches replaced 12 of 16 stored parts by the run's outcome."""
    part = (F.substring("transaction_id", 3, 10).cast("long") % 16).cast("int")
    columns = ["transaction_id", "amount", "failure_code", "recovery_status"]
    before = _inputs(spark, sf_dir).transactions.select(*columns, part.alias("part"))
    after = materialized(_snapshot(spark, sf_dir).select(*columns, part.alias("part")), "after")
    path = _scratch(spark, "snapshot")
    before.repartition("part").write.partitionBy("part").parquet(path)
    state = INC.kpi_state(spark.read.parquet(path))
    for j in range(3):
        parts = list(range(4 * j, 4 * j + 4))
        state = INC.replace_parts(path, "part", parts, after.where(F.col("part").isin(*parts)), state)
    return state


def incremental_kpis(spark, sf_dir):
    """AG-01..AG-04 from the state that changes keep."""
    return to_output(INC.kpis(_three_batches(spark, sf_dir)))


def csv_quarantine(spark, sf_dir):
    """SC-05 with malformed lines: the good rows, and the bad lines by reason.  Every 50th
    result is followed by a line with a broken amount, too few fields or no id."""
    r = _results(spark, sf_dir, ("baseline",))
    path = _scratch(spark, "csv-checked")
    IO.write_results_csv(r, path)
    k = F.substring("transaction_id", 3, 10).cast("long")
    line = (F.when(k % 150 == 0, F.concat(F.lit("baseline,"), "transaction_id", F.lit(",12x,,,,,,,,,0,0,0,,0")))
            .when(k % 150 == 50, F.concat(F.lit("baseline,"), "transaction_id", F.lit(",1")))
            .otherwise(F.lit("baseline,,1,,,,,,,,,0,0,0,,0")))
    broken = r.where(k % 50 == 0).select(F.concat(F.lit(",".join(IO.RESULTS_CSV.names) + "\n"), line).alias("value"))
    broken.write.mode("append").text(path)  # a header before each, as in files of one row
    good, bad = IO.read_checked(spark, path, IO.RESULTS_CSV, required=("transaction_id",))
    kept = good.agg(F.lit("good").alias("reason"), F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"))
    return to_output(kept.unionByName(bad.where(~F.col("record").startswith("strategy,")).groupBy("reason")
                                      .agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("amount"))))


def stage_latency_nulls(spark, sf_dir):
    """AG-15 where latencies are missing, for one stage all of them."""
    def some(tx, stage_no):
        k = F.substring(tx, 3, 10).cast("long")
        return F.when((stage_no != 2) & (k % 4 != 1), fixture_latency(tx, stage_no))
    w = _wide(spark, sf_dir, which=("optimizer",))
    return to_output(AU.stage_latency(AU.audit_rows(w, "optimizer", run_ts=RUN_TS, latency=some)))


def _executions_source(spark, sf_dir):
    a = _audit(spark, sf_dir).where(F.col("stage") == "execution").select("transaction_id", "attempt_no",
                                                                           "agent_action", "tool_result")
    path = _scratch(spark, "exec-in")
    _spread(a).write.parquet(path)
    return path, a.schema


def stream_attempt_state(spark, sf_dir):
    src, schema = _executions_source(spark, sf_dir)
    return to_output(SM.attempt_state(spark, src, schema, _scratch(spark, "state-out"), _scratch(spark, "state-ckpt")))


def stream_state_resumed(spark, sf_dir):
    """SM-02 from a history: three starts of the stream, new files each time, over the
    executions of a run that goes on where earlier attempts ended."""
    prior = FX.prior_audit_view(_inputs(spark, sf_dir).orders)
    w = evaluate(ST.pending(_resume_enriched(spark, sf_dir)), which=("optimizer",))
    ex = materialized(AU.audit_rows(w, "optimizer", run_ts=RUN_TS).where(F.col("stage") == "execution")
                      .select("transaction_id", "attempt_no", "agent_action"), "executions")
    src, out, ckpt = (_scratch(spark, x) for x in ("exec-in", "state-out", "state-ckpt"))
    for k in range(3):
        _spread(ex.where(F.least(F.col("attempt_no"), F.lit(3)) == k + 1)).write.mode("append").parquet(src)
        AS.resume_attempt_state(spark, src, ex.schema, prior, out, ckpt)
    return to_output(AS.current_state(spark, out))


def stream_dedupe(spark, sf_dir):
    src, schema = _executions_source(spark, sf_dir)
    return to_output(SM.dedupe_actions(spark, src, schema, _scratch(spark, "dedupe-out"), _scratch(spark, "dedupe-ckpt"))
                     .select("transaction_id", "agent_action"))


QUERIES.update({f.__name__: f for f in (stream_two_runs, incremental_kpis, stored_360, observed_run, csv_quarantine, ordered_history, trail_positions, stream_state_resumed, edge_results, edge_state, edge_360, pending_batch, audit_timeline, audit_trail_timeline,
                                        filtered_head, outcome_join, stored_pairs, stage_latency_nulls)})
QUERIES.update({
    "prompt_requests": prompt_requests,
    "response_valid": response_valid,
    "diagnosed": diagnosed,
    "stream_diagnosed": stream_diagnosed,
    "model_contribution": model_contribution,
    "csv_roundtrip": csv_roundtrip,
    "json_summary_roundtrip": json_summary_roundtrip,
    "run_overwrite": run_overwrite,
    "formatted_kpis": formatted_kpis,
    "stream_recovery": stream_recovery,
    "stream_attempt_state": stream_attempt_state,
    "stream_dedupe": stream_dedupe,
})


def audit_append(spark, sf_dir):
    """SK-03 / SC-04: two runs' audit rows appended to one partitioned
    folder and read back with the declared schema; rows per strategy/stage."""
    inp = _inputs(spark, sf_dir)
    w = evaluate(enrich(inp.transactions, inp.customers, inp.invoices), which=("rules", "optimizer"))
    w = materialized(w.select("transaction_id", "amount", "failure_code", "rules", "optimizer"), "decided")   # once for all three appends
    path = _scratch(spark, "audit")
    for s in ("optimizer", "rules"):
        IO.append_audit(AU.audit_rows(w, s, run_ts=RUN_TS), path, run_id="r1")
    IO.append_audit(AU.audit_rows(w, "rules", run_ts=RUN_TS), path, run_id="r1")   # a retried append
    back = IO.read_audit(spark, path)
    return to_output(back.groupBy("strategy", "stage").agg(F.count(F.lit(1)).alias("n")))


def model_quota(spark, sf_dir, llm_limit: int = 2):
    """MI-05: only the first ``llm_limit`` transactions by id use recorded
    model responses; the rest take the code-derived ranking."""
    e = MI.attach_responses(_enriched(spark, sf_dir), _responses(spark, sf_dir), llm_limit=llm_limit)
    w = evaluate(e, model=True, which=("optimizer",))
    t = F.col("optimizer.trail")[0]
    return to_output(w.select("transaction_id", "in_quota", t["diagnosis_source"].alias("diagnosis_source"),
                              F.col("optimizer.final_action").alias("final_action")))


QUERIES.update({"audit_append": audit_append, "model_quota": model_quota})
