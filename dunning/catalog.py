"""Rule tables of the recovery domain, as data.

FIXED VALUES: everything in this module is a value that must equal the
domain's published behaviour for results to match (action catalog, costs,
probability table, policy texts, rule maps, labels).  The code elsewhere turns
these tables into Column expressions or tiny broadcast DataFrames.
"""

from __future__ import annotations

from decimal import Decimal as D

# --------------------------------------------------------------------------
# FIXED VALUES: action catalog, in catalog order.
# (action, catalog_order, rank_cost, eval_cost, kind)
# rank_cost ranks candidates; eval_cost is charged in evaluation reports.
# --------------------------------------------------------------------------
ACTIONS = [
    ("retry_payment", 1, D("1.0"), D("1.0"), "automated"),
    ("send_payment_reminder", 2, D("1.0"), D("1.0"), "automated"),
    ("create_payment_link", 3, D("2.0"), D("2.0"), "automated"),
    ("schedule_retry", 4, D("1.5"), D("1.0"), "automated"),
    ("mark_promise_to_pay", 5, D("0.0"), D("1.0"), "automated"),
    ("escalate_to_human", 6, D("100.0"), D("100.0"), "exit"),
    ("stop_recovery", 7, D("0.0"), D("0.0"), "exit"),
]
ACTION_NAMES = [a[0] for a in ACTIONS]
AUTOMATED = [a[0] for a in ACTIONS if a[4] == "automated"]
EXITS = [a[0] for a in ACTIONS if a[4] == "exit"]
CONTACT_ACTIONS = ["send_payment_reminder", "create_payment_link"]
CATALOG_ORDER = {a[0]: a[1] for a in ACTIONS}
RANK_COST = {a[0]: a[2] for a in ACTIONS}
EVAL_COST = {a[0]: a[3] for a in ACTIONS}
UNKNOWN_ACTION_EVAL_COST = D("1.0")

ESCALATE = "escalate_to_human"
STOP = "stop_recovery"

MAX_ATTEMPTS = 2
HIGH_VALUE_THRESHOLD = D("25000.00")

# --------------------------------------------------------------------------
# FIXED VALUES: failure codes and their classes.
# --------------------------------------------------------------------------
BANK_CODES = ["BANK_TIMEOUT", "TEMPORARY_BANK_ERROR"]
FAILURE_CODES = [
    "BANK_TIMEOUT", "TEMPORARY_BANK_ERROR", "INSUFFICIENT_FUNDS", "CARD_EXPIRED",
    "LIMIT_EXCEEDED", "CUSTOMER_DECLINED", "UNKNOWN_ERROR",
]
# class name -> codes in the class; "OTHER" is everything else (NULL included)
CODE_CLASSES = {
    "BANK": BANK_CODES,
    "INSUFF": ["INSUFFICIENT_FUNDS"],
    "EXPIRED": ["CARD_EXPIRED"],
    "LIMIT": ["LIMIT_EXCEEDED"],
    "DECLINED": ["CUSTOMER_DECLINED"],
}

# --------------------------------------------------------------------------
# FIXED VALUES: success probability by action and code class, with the
# customer-band adjustment (hi: rate >= 0.90 -> min(0.95, p + up);
# lo: rate < 0.70 -> max(floor, p - down); mid: unchanged).
# action: ({class: base, "OTHER": base}, up, down, floor)
# --------------------------------------------------------------------------
BAND_HI = D("0.90")
BAND_LO = D("0.70")
BAND_CAP = D("0.95")
PROBABILITY = {
    "retry_payment": (
        {"BANK": D("0.70"), "INSUFF": D("0.10"), "EXPIRED": D("0.00"), "LIMIT": D("0.05"),
         "DECLINED": D("0.20"), "OTHER": D("0.20")},
        D("0.05"), D("0.05"), D("0.00")),
    "send_payment_reminder": (
        {"BANK": D("0.40"), "INSUFF": D("0.60"), "EXPIRED": D("0.00"), "LIMIT": D("0.40"),
         "DECLINED": D("0.30"), "OTHER": D("0.40")},
        D("0.20"), D("0.20"), D("0.10")),
    "create_payment_link": (
        {"BANK": D("0.45"), "INSUFF": D("0.65"), "EXPIRED": D("0.50"), "LIMIT": D("0.45"),
         "DECLINED": D("0.35"), "OTHER": D("0.45")},
        D("0.20"), D("0.20"), D("0.10")),
    "schedule_retry": (
        {"BANK": D("0.85"), "INSUFF": D("0.30"), "EXPIRED": D("0.30"), "LIMIT": D("0.30"),
         "DECLINED": D("0.30"), "OTHER": D("0.30")},
        D("0.05"), D("0.05"), D("0.05")),
    "mark_promise_to_pay": (
        {"BANK": D("0.40"), "INSUFF": D("0.40"), "EXPIRED": D("0.40"), "LIMIT": D("0.40"),
         "DECLINED": D("0.40"), "OTHER": D("0.40")},
        D("0.25"), D("0.25"), D("0.05")),
}
ESCALATE_PROB = D("0.80")
ESCALATE_PROB_HIGH_LTV = D("0.95")
HIGH_LTV = D("50000.00")
# customer defaults when the customer row is missing (decision side)
DEFAULT_RATE = D("0.85")

# --------------------------------------------------------------------------
# FIXED VALUES: failure code -> root cause, and root cause text -> ranking
# code (substring rules, first match wins).
# --------------------------------------------------------------------------
ROOT_CAUSES = [
    "temporary_bank_failure", "insufficient_funds", "expired_card",
    "customer_declined", "limit_exceeded", "unknown",
]
CLASS_TO_CAUSE = {
    "BANK": "temporary_bank_failure",
    "INSUFF": "insufficient_funds",
    "EXPIRED": "expired_card",
    "LIMIT": "limit_exceeded",
    "DECLINED": "customer_declined",
    "OTHER": "unknown",
}
CAUSE_TEXT_RULES = [
    (["temporary_bank_failure", "bank_timeout", "temporary_bank_error"], "BANK_TIMEOUT"),
    (["insufficient"], "INSUFFICIENT_FUNDS"),
    (["expired"], "CARD_EXPIRED"),
    (["limit"], "LIMIT_EXCEEDED"),
    (["decline"], "CUSTOMER_DECLINED"),
]
CAUSE_TEXT_DEFAULT = "UNKNOWN"

# --------------------------------------------------------------------------
# FIXED VALUES: static rules-only action by code class, (first attempt,
# later attempts).
# --------------------------------------------------------------------------
RULES_ACTION = {
    "BANK": ("retry_payment", "create_payment_link"),
    "INSUFF": ("send_payment_reminder", "stop_recovery"),
    "EXPIRED": ("create_payment_link", "create_payment_link"),
    "LIMIT": ("escalate_to_human", "escalate_to_human"),
    "DECLINED": ("send_payment_reminder", "stop_recovery"),
    "OTHER": ("escalate_to_human", "escalate_to_human"),
}

# --------------------------------------------------------------------------
# FIXED VALUES: deterministic fallback diagnosis.
# class -> (action that flips the branch when already tried or None,
#           confidence, first branch, branch once that action was tried)
# a branch = (recommended_action, reason, why_not_alternatives)
# --------------------------------------------------------------------------
FALLBACK = {
    "BANK": ("retry_payment", D("1.0"),
             ("retry_payment",
              "Deterministic fallback: Bank/network issue detected. Recommend retry.",
              "Retry payment has the highest expected recovery probability (70%) for network timeouts."),
             ("create_payment_link",
              "Deterministic fallback: Primary retry failed. Generating alternative payment link.",
              "Repeating retry_payment is bypassed because the first retry already failed.")),
    "INSUFF": ("send_payment_reminder", D("1.0"),
               ("send_payment_reminder",
                "Deterministic fallback: Customer lacks funds. Send payment reminder.",
                "Reminder has low cost (INR 1) and gives the customer time to fund their account."),
               ("create_payment_link",
                "Deterministic fallback: Reminder went unheeded. Generate direct payment link.",
                "Bypassing reminder as it has already been sent once.")),
    "EXPIRED": (None, D("1.0"),
                ("create_payment_link",
                 "Deterministic fallback: Expired card. Generate link to update payment method.",
                 "Retry payment is impossible on an expired card (0% probability)."),
                None),
    "LIMIT": (None, D("1.0"),
              ("escalate_to_human",
               "Deterministic fallback: Transaction limit exceeded. Escalate to human operator.",
               "Automated retries will continue to fail (5% probability) until limit is cleared by bank/operator."),
              None),
    "DECLINED": ("send_payment_reminder", D("1.0"),
                 ("send_payment_reminder",
                  "Deterministic fallback: Customer declined transaction. Query reason.",
                  "Gentle nudge via reminder allows customer to authorize the charge."),
                 ("stop_recovery",
                  "Deterministic fallback: Customer persistently declined. Terminate recovery.",
                  "Escalating is too costly for a customer who has explicitly opted out/declined twice.")),
    "OTHER": (None, D("0.5"),
              ("escalate_to_human",
               "Deterministic fallback: Unrecognized error code. Escalate to human operator.",
               "Automated tools cannot diagnose unknown failures safely."),
              None),
}
MODEL_ERROR_SUFFIX_CHARS = 50

# --------------------------------------------------------------------------
# FIXED VALUES: policy outcomes, first match wins (rule code -> result).
# Reason templates use {action}, {tx}, {amount} (formatted with thousands
# separators and 2 decimals).
# --------------------------------------------------------------------------
POLICY_REASONS = {
    "ALREADY_SUCCESSFUL": "Transaction recovery is already successful. Recovery process terminated.",
    "HIGH_VALUE_THRESHOLD": "Amount (₹{amount}) meets or exceeds high-value threshold (₹25,000.00). Escalating for human operations review.",
    "CUSTOMER_FRAUD_FLAG": "Customer is flagged as high-risk/suspicious. Automated recovery is disabled. Escalating for human operations review.",
    "MAX_ATTEMPTS_EXHAUSTED": "Maximum automated recovery attempts (2) reached. Escalating for human review.",
    "DUPLICATE_ACTION": "Action '{action}' was already executed for transaction '{tx}'. Duplicate action blocked.",
    "COMMUNICATION_OPT_OUT": "Action '{action}' rejected. Customer contact preference is set to 'none' (opted out of communications).",
    "SAFETY_EXIT": "Action '{action}' is a default safety exit action and is allowed.",
    "UNSUPPORTED_ACTION": "Action '{action}' is not in the list of allowed bounded recovery actions.",
    "POLICY_APPROVED": "Action '{action}' approved under current deterministic policy limits.",
}
POLICY_RESULTS = {
    "ALREADY_SUCCESSFUL": "STOP",
    "HIGH_VALUE_THRESHOLD": "ESCALATE",
    "CUSTOMER_FRAUD_FLAG": "ESCALATE",
    "MAX_ATTEMPTS_EXHAUSTED": "ESCALATE",
    "DUPLICATE_ACTION": "REJECTED",
    "COMMUNICATION_OPT_OUT": "REJECTED",
    "SAFETY_EXIT": "APPROVED",
    "UNSUPPORTED_ACTION": "REJECTED",
    "POLICY_APPROVED": "APPROVED",
}

# --------------------------------------------------------------------------
# FIXED VALUES: texts written by decisions, outcomes and audit rows.
# --------------------------------------------------------------------------
OPTIMIZER_REASON = "ERV optimizer selected action with highest Expected Net Recovery (₹{net}) based on cause: {cause}."
OPTIMIZER_WHY_NOT = "Other actions have lower expected net recovery or are blocked by safety policies."
RULES_REASON = "Rules-Only selected standard intervention based on error code: {code}."
RULES_WHY_NOT = "ERV optimizations and customer context were bypassed."
RISK_AUDIT_REASON = "Risk Score: {score} ({level}). Attempts count: {attempts}."
DIAGNOSIS_AUDIT_REASON = "Diagnosed cause: {cause}. Reason: {reason} | Alternatives reasoning: {why_not}"
BUDGET_ESCALATION_REASON = "Automated recovery attempts exhausted (MAX_ATTEMPTS=2). Triggering safety escalation."
OUTCOME_ESCALATED = "Case escalated to human review. Automated recovery paused."
OUTCOME_STOPPED = "Recovery terminated by policy or customer preference."
OUTCOME_SUCCESS = "Action '{action}' executed successfully. Recovered INR {amount}."
OUTCOME_FAILURE = "Action '{action}' executed but failed to recover funds (probability {pct}%)."
BASELINE_STOPPED = "Baseline stopped: high value or opted out."
SKIPPED_TERMINAL = "Recovery already in terminal state."
SKIPPED_NO_ATTEMPT = "No attempts executed."

# --------------------------------------------------------------------------
# FIXED VALUES: risk factor texts.
# --------------------------------------------------------------------------
RISK_SIGNALS = {
    "sev_high": "High severity failure category: {code}",
    "sev_moderate": "Moderate severity failure category: {code}",
    "sev_liquidity": "Liquidity failure: INSUFFICIENT_FUNDS",
    "sev_transient": "Transient infrastructure timeout",
    "high_value": "High value transaction amount: ₹{amount}",
    "fraud": "Customer account has active fraud/risk flag",
    "rate_low": "Low customer historical success rate: {pct}%",
    "rate_sub": "Sub-optimal customer success rate: {pct}%",
    "retry_one": "Previous attempt failed (Retry count: 1)",
    "retry_many": "Multiple previous retries failed (Retry count: {n})",
    "overdue_severe": "Severely overdue customer invoice ({d} days)",
    "overdue_moderate": "Moderately overdue invoice ({d} days)",
    "overdue_recent": "Recently overdue invoice ({d} days)",
}

# --------------------------------------------------------------------------
# FIXED VALUES: display labels.
# --------------------------------------------------------------------------
ACTION_LABELS = {
    "retry_payment": "Retry Payment",
    "send_payment_reminder": "Payment Reminder",
    "create_payment_link": "Create Payment Link",
    "schedule_retry": "Schedule Retry",
    "mark_promise_to_pay": "Promise to Pay",
    "escalate_to_human": "Human Escalation",
    "stop_recovery": "Stop Recovery",
}
FAILURE_LABELS = {
    "BANK_TIMEOUT": "Bank Timeout",
    "CUSTOMER_DECLINED": "Customer Declined",
    "INSUFFICIENT_FUNDS": "Insufficient Funds",
    "CARD_EXPIRED": "Card Expired",
    "TEMPORARY_BANK_ERROR": "Temporary Bank Error",
    "LIMIT_EXCEEDED": "Limit Exceeded",
    "UNKNOWN_ERROR": "Unknown Error",
}

STAGES = ["risk_evaluation", "root_cause_analysis", "policy_guardrail", "execution"]
STAGE_NO = {s: i + 1 for i, s in enumerate(STAGES)}
RECOVERY_STATUSES = ["UNRECOVERED", "RECOVERED", "ESCALATED", "FAILED", "STOPPED"]
TERMINAL_STATUSES = ["RECOVERED", "ESCALATED", "STOPPED"]

# Texts of the model requests (free wording; only the field names are fixed).
PROMPT_SYSTEM = "You diagnose failed payments and propose one recovery action."
PROMPT_ANSWER = ("Answer with one JSON object holding root_cause, confidence, recommended_action, reason and "
                 "why_not_alternatives.")
