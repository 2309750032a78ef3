import hashlib
import re

import pytest
from pyspark.sql import functions as F

from byteplan.llm import pii

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


TEXTS = [
    "a@b.c+d@e.f.g 1.2.3.4.5 001.255.256.1 999.1.1.1 and 4111-1111-1111-1111 4111-1111-1111-1112 +1 (476) 555-6291 +123 😀 x@y.z",
    None, "", "a@b" + ".c" * 20000, "9" * 30000 + " 1.1.1.1", "+" * 500 + "1234567890", "@@@a@b.cc@d.e é@f.g", "0.0.0.0.0.0.0.0 1.2.3", "+1..2 +12345678901234567890",
    "IBAN GB82 WEST 1234 5698 7654 32, ok DE89370400440532013000. ssn 123-45-6789; 123-45-6789 call 415-555-1234 é+44 20 7946 0958",
]


def test_base_spans_match_plain_regexes(spark, docs, texts):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for frame in (rows, docs):
        found = pii.find_pii(frame).select("text", F.filter("pii_spans", lambda x: x["base"]).alias("s")).collect()
        assert len(found) == frame.count()
        for r in found:
            assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["s"]] == brute(r["text"] or "")


def test_query_columns(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.op1_pii(spark, str(tmp_path)).collect():
        want = brute(TEXTS[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k, _ in BASE] == [sum(w.startswith(k) for w in want) for k, _ in BASE]
        assert set(want) <= set(r["spans"].split(","))
    assert "iban:5:32" in r["spans"] and "ssn" in r["spans"] and "local_phone" in r["spans"]


def test_checksums_and_context(spark):
    cases = [("GB82 WEST 1234 5698 7654 33", 0), ("DE89370400440532013000", 1), ("xDE89370400440532013000", 0), ("123-45-6789", 0), ("my SSN is 123-45-6789", 1), ("ssn 000-45-6789", 0), ("415-555-1234", 0), ("phone 415-555-1234", 1), ("phone +1 415-555-1234", 0)]
    rows = spark.createDataFrame(list(enumerate(t for t, _ in cases)), "doc_id long, text string")
    found = {r["doc_id"]: len([s for s in r["pii_spans"] if not s["base"]]) for r in pii.find_pii(rows).collect()}
    assert found == dict(enumerate(n for _, n in cases))


def test_redaction(spark, docs, nothing):
    rows = spark.createDataFrame([(0, "call +1 (476) 555-6291 or a@b.cd!", 9), (1, None, 9), (2, "clean 😀", 9)], "doc_id long, text string, n_chars long")
    assert [(r["text"], r["n_chars"]) for r in pii.redact_pii(rows).orderBy("doc_id").collect()] == [("call <PHONE> or <EMAIL>!", 24), (None, None), ("clean 😀", 7)]
    assert pii.redact_pii(docs).columns == docs.columns and pii.redact_pii(nothing).count() == 0
    assert pii.redact_pii(docs).select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("rule", pii.RULES, ids=lambda r: r.kind)
def test_native(spark, docs, rule):
    plan = pii.find_pii(docs, (rule,) if rule.base else (pii.RULES[0], rule))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_very_many_matches(spark):
    text = "".join(f"mail a{i}@b.cd, phone 415-555-{1000 + i % 9000} é " for i in range(5000)) + "call +1 415-555-1234 or 4111-1111-1111-1111 "
    frame = spark.createDataFrame([(0, text, 1)], "doc_id long, text string, n_chars long")
    spans = pii.find_pii(frame).first()["pii_spans"]
    assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["base"]] == brute(text)
    more = [(m.start(), m.end()) for m in re.finditer(r"(?<=phone )[0-9]{3}-[0-9]{3}-[0-9]{4}", text)]
    assert [(s["start"], s["end"]) for s in spans if s["kind"] == "local_phone"] == more  # the one inside +1 415-555-1234 gave way
    want = re.sub(r"(?<=phone )[0-9]{3}-[0-9]{3}-[0-9]{4}", "<LOCAL_PHONE>", re.sub(r"a[0-9]+@b\.cd", "<EMAIL>", text))
    want = want.replace("+1 415-555-1234", "<PHONE>").replace("4111-1111-1111-1111", "<CARD>")
    assert pii.redact_pii(frame).first()["text"] == want


def test_redaction_keeps_marks_and_wide_characters(spark):
    frame = spark.createDataFrame([("﻿x 😀a@b.cd﻿ y 😀 c@d.ef﻿",)], "text string")
    assert pii.redact_pii(frame).first()["text"] == "﻿x 😀<EMAIL>﻿ y 😀 <EMAIL>﻿"
