"""Response cleaning and validation (MI-02, MI-03)."""
from dunning.functions.diagnosis import with_parsed

OK = '{"root_cause": "insufficient_funds", "confidence": 0.9, "recommended_action": "send_payment_reminder", "reason": "r", "why_not_alternatives": "w"}'


def test_parse_cases(spark):
    rows = [("valid", OK), ("fenced", "```json\n" + OK + "\n```"), ("malformed", '{"root_cause": '),
            ("bad_cause", OK.replace("insufficient_funds", "glitch")), ("text_conf", OK.replace("0.9", '"0.7"')),
            ("missing", None)]
    df = with_parsed(spark.createDataFrame(rows, "case string, t string"), "t", "p").select("case", "p")
    got = {r["case"]: r["p"] for r in df.collect()}
    assert got["valid"]["valid"] and got["valid"]["confidence"] == 0.9
    assert got["fenced"]["valid"]
    assert not got["malformed"]["valid"] and got["malformed"]["root_cause"] is None
    assert not got["bad_cause"]["valid"]
    assert got["text_conf"]["valid"] and got["text_conf"]["confidence"] == 0.7
    assert not got["missing"]["valid"]
