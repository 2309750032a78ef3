import math
import re
from collections import defaultdict

import pytest

from byteplan.llm import mixing


def water(sizes, weights, share, limit):
    """Targets by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > limit * sizes[s]}
        if not full:
            target |= {s: level * w[s] for s in open_}
            break
        for s in full:
            target[s] = limit * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets_and_totals(spark, docs, texts):
    plan = mixing.mix_plan(docs)
    rows = plan.collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(i), words(t)) for i, t, _, _ in texts)
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, _, s in texts:
        sizes[s] += words(t)
    target = water(sizes, (3, 1, 2), 1.5, 2)
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
    parts = sum(r["taken"] % r["size"] != 0 for r in rows if r["size"])
    assert parts <= len(sizes)  # all but one document of a source are taken whole
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_plan(docs.repartition(3)).collect()))


@pytest.mark.parametrize("fanout", [2, 5])
def test_deep_trees_and_fair_chances(spark, monkeypatch, fanout):
    monkeypatch.setattr(mixing, "FANOUT", fanout)
    rows = spark.range(300).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 7 as int)) AS text", "case when id < 200 then 'hot' else 'b' end AS source")
    first = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(rows, weights=(1, 4), share=0.6).collect()}
    assert len(first) == 300
    for seed in (1, 2):
        other = mixing.mix_plan(rows, weights=(1, 4), share=0.6, seed=seed).collect()
        for s in ("hot", "b"):
            own = [r for r in other if r["source"] == s]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert {r["doc_id"]: r["taken"] for r in other} != first


def test_repeated_rows_empty_tables_and_zero_sizes(spark, nothing):
    assert mixing.mix_plan(nothing).count() == 0
    rows = spark.createDataFrame([(1, "a b", "s")] * 50 + [(2, None, "z"), (3, "", None)], "doc_id long, text string, source string")
    plan = mixing.mix_plan(rows).collect()
    assert len(plan) == 52 and sum(r["taken"] for r in plan) in (150, 151) and sorted(r["dup"] for r in plan if r["doc_id"] == 1) == list(range(1, 51))
    assert all(r["taken"] == 0 and r["target"] == 0 for r in plan if r["doc_id"] != 1)


def test_mixed_documents(spark, docs, texts):
    mix = mixing.mix_documents(docs).collect()
    plan = mixing.mix_plan(docs).collect()
    assert sum(r["taken"] for r in mix) == sum(r["taken"] for r in plan)
    known = {(i, t) for i, t, _, _ in texts}
    assert all((r["doc_id"], r["text"]) in known for r in mix)
    assert sum(r["rows"] for r in mix if r["doc_id"] == 108) in (0, 3)


def test_native(spark, docs):
    plan = mixing.mix_plan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
