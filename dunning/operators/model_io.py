"""Model diagnosis as batch table work (MI-01..MI-05, JN-10, AG-24).

The network call is not part of the library: requests are a table of prompt
texts, responses a table ``(transaction_id, attempt_no, response_text)``
recorded by whatever serves the model.  Cleaning, validation, fallback and the
re-ranking by the diagnosed cause are column expressions in the attempt loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import diagnosis as DX
from ..functions.erv import candidates
from .strategies import plan_barrier


def parsed_responses(responses: DataFrame) -> DataFrame:
    """Responses with their parsed fields and their place among those of the same attempt,
    as :func:`attach_responses` takes them; to be stored where they are attached more than once."""
    order = F.struct(F.col("recorded_seq") if "recorded_seq" in responses.columns else F.lit(0), F.col("response_text")).alias("place")
    return DX.with_parsed(responses.select("transaction_id", "attempt_no", order, F.col("response_text").alias("text")), "text", "parsed")


def attach_responses(enriched: DataFrame, responses: DataFrame, llm_limit: int | None = None) -> DataFrame:
    """Adds ``answer1``, ``answer2`` (text, parsed) and ``in_quota`` (MI-05, JN-10).

    Responses are pivoted per transaction with a partial aggregate (at most
    one value per attempt, the latest by ``recorded_seq`` where several were
    recorded), then joined once.  The quota is the ids up to the
    ``llm_limit``-th, one value found by a top-k; ``None`` means every
    transaction may use the model.  ``responses`` may come parsed already
    (:func:`parsed_responses`).
    """
    # parsed once per response, before the aggregate, so the decision pass sees plain columns
    read = responses if "parsed" in responses.columns else plan_barrier(parsed_responses(responses))
    r = read.groupBy("transaction_id").agg(
        *[F.max_by(F.struct("text", "parsed"), F.when(F.col("attempt_no") == k, F.col("place"))).alias(f"answer{k}")
          for k in range(1, C.MAX_ATTEMPTS + 1)])
    df = enriched.join(r, "transaction_id", "left")  # unique on both sides
    if llm_limit is None:
        return df.withColumn("in_quota", F.lit(True))
    last = (enriched.select("transaction_id").orderBy("transaction_id").limit(llm_limit)
            .agg(F.max("transaction_id").alias("_last_id")))  # one row
    return (df.join(F.broadcast(last), F.col("transaction_id") <= F.col("_last_id"), "left")
            .withColumn("in_quota", F.col("_last_id").isNotNull()).drop("_last_id"))


def response_table(responses: DataFrame) -> DataFrame:
    """MI-02 / MI-03: cleaned text, parsed fields and validity per response."""
    p = DX.with_parsed(responses, "response_text", "p")
    return p.select("transaction_id", "attempt_no", DX.clean_response(F.col("response_text")).alias("cleaned"),
                    "p.valid", "p.root_cause", "p.confidence", "p.recommended_action")


def prompt_requests(wide: DataFrame, strategy: str = "optimizer") -> DataFrame:
    """MI-01: the request of each attempt made: a system text and a prompt with the
    transaction, the customer, the open invoice, what was tried so far (earlier runs
    first, in order) and the options of the raw failure code.  Amounts are plain numbers with two decimals."""
    def text(c, missing="none"):
        return F.coalesce(c.cast("string"), F.lit(missing))

    lit = F.lit
    options = F.array_join(F.transform(candidates(wide), lambda c: F.concat(
        c["action"], lit(": "), c["probability"].cast("string"), lit(", "), c["cost"].cast("string"), lit(", "),
        c["expected_net"].cast("string"))), "; ")
    invoice = F.when(F.col("invoice_id").isNull(), lit("none")).otherwise(F.concat(
        F.col("invoice_id"), lit(", INR "), text(F.col("invoice_amount_due")), lit(", "), text(F.col("days_overdue")), lit(" days late")))
    head = F.concat(
        lit("Failed payment "), F.col("transaction_id"), lit(": INR "), text(F.col("amount")), lit(" by "),
        text(F.col("payment_method")), lit(", code "), text(F.col("failure_code")),
        lit("\nCustomer "), text(F.col("customer_id"), "unknown"), lit(": "), text(F.col("customer_type"), "new"),
        lit(", lifetime value "), text(F.col("ltv")), lit(", success rate "), text(F.col("erv_rate")),
        lit(", contact by "), F.col("preference"), lit(", flagged "), F.when(F.col("risk_flag"), "yes").otherwise("no"),
        lit("\nOpen invoice: "), invoice)
    tail = F.concat(lit("\nOptions (action: chance, cost, expected net): "), options, lit("\n"), lit(C.PROMPT_ANSWER))
    trail = F.col(f"{strategy}.trail")
    rows = wide.select("transaction_id", "prior_actions", head.alias("head"), tail.alias("tail"), trail.alias("trail"), F.explode(trail).alias("t"))
    here = F.expr("transform(filter(trail, x -> x.attempt_no < t.attempt_no), x -> x.final_action)")
    tried = F.concat(F.coalesce("prior_actions", F.array().cast("array<string>")), here)
    before = F.when(F.size(tried) == 0, lit("none")).otherwise(F.concat(F.array_join(tried, ", "), lit(" failed")))
    return rows.select("transaction_id", F.col("t.attempt_no").alias("attempt_no"), lit(C.PROMPT_SYSTEM).alias("system_text"),
                       F.concat("head", lit("\nTried so far: "), before, "tail").alias("prompt"))


def model_contribution(wide: DataFrame, strategy: str = "optimizer") -> DataFrame:
    """AG-24: attempts by diagnosis source, and how many diagnosed causes
    differ from the code-derived cause."""
    t = wide.select("failure_code", F.explode(F.col(f"{strategy}.trail")).alias("t"))
    code_cause = DX.root_cause_from_code(F.col("failure_code"))
    return t.groupBy(F.col("t.diagnosis_source").alias("diagnosis_source")).agg(
        F.count(F.lit(1)).cast("long").alias("attempts"),
        F.count_if(F.col("t.root_cause") != code_cause).cast("long").alias("cause_changed"))

