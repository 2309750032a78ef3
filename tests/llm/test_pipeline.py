import corpus_pipeline
import pytest

from byteplan.llm import decontaminate, pii, queries, simhash, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base, docs, out = str(tmp_path_factory.mktemp("stages")), spark.read.parquet(f"{DATA}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{base}/{k}")
        after = spark.read.parquet(f"{base}/{k}")
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_toxic_documents_go(spark, stages):
    _, before, after = stages[0]
    model = toxicity.toxicity_model(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(before, model).collect()}
    assert ids(after) == sorted(i for i, s in scores.items() if s < 0.7) and after.columns == before.columns


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    values = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in before.collect()}
    kept, left = set(ids(after)), set()
    for i in sorted(values):
        near, grown = {i}, True
        while grown:
            grown = {j for j in values if j not in near and any(bin(values[j] ^ values[k]).count("1") <= 2 for k in near)}
            near |= grown
        left.add(min(near))
    assert kept == left and after.columns == before.columns


def test_contaminated_documents_go(spark, stages):
    _, before, after = stages[2]
    block = next(decontaminate.item_blocks(spark.read.parquet(f"{DATA}/benchmark.parquet")))
    bad = {r["doc_id"] for r in before.collect() if any(c >= 0.6 * len(block.items[k]) for k, (c, _) in block.coverage(r["text"]).items())}
    assert bad and set(ids(after)) == set(ids(before)) - bad and after.columns == before.columns


def test_personal_data_is_replaced(stages):
    _, before, after = stages[3]
    spans = {r["doc_id"]: r["pii_spans"] for r in pii.find_pii(before).collect()}
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert (r["text"] != texts[r["doc_id"]]) == bool(spans[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    assert ids(after) == ids(before) and after.columns == before.columns and any(spans.values())


def test_mix(spark, stages):
    _, before, after = stages[4]
    rows = after.collect()
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    assert all(abs(t - want) <= 1 for t, want in by_source.values())
    assert set(ids(after)) <= set(ids(before))


def test_run_and_odd_documents(spark, docs, nothing, tmp_path):
    assert corpus_pipeline.run(spark, DATA).count() > 50
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for frame in (docs, nothing):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, DATA)
            assert set(columns[:4]) <= set(frame.columns)
        frame.collect()


def test_names():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
