import random
import zlib

import numpy as np
import pytest

from byteplan.llm import langid, sampling, textcnn, toxicity

STEMS = {"en": ["the", "ing", "th", "wh", "ous"], "de": ["sch", "ung", "ein", "ß", "ö"], "fr": ["eau", "é", "qu", "ç", "oi"]}


def corpus(n=360):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(STEMS))
        words = ["".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        toxic = rng.random() < 0.25
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), "zorg" + rng.choice(STEMS[lang]) + lang)
        rows.append((i, " ".join(words), lang if rng.random() < 0.9 else None, lang, int(toxic)))
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = corpus()
    odd = [(1000, None, None, None, None), (1001, "", "en", "en", 0), (1002, "12 !?", "en", "en", 0), (1003, "the " * 40_000 + "zorgtheen", None, "en", None), (None, rows[0][1], "en", "en", 1)]
    spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang, _, _ in rows + odd], "doc_id long, text string, lang string, source string, score long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, _, _, y in rows + odd] + [(99999, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_language(spark, folder, nothing):
    got = {r["doc_id"]: r for r in langid.op4_language(spark, folder).collect()}
    rows = corpus()
    assert len(got) == len(rows) + 5
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]]["held_out"] == (r in held) for r in rows)
    assert np.mean([got[i]["lang_pred"] == lang for i, _, _, lang, _ in held]) >= 0.97
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = langid.train_language_model(nothing)
    assert langid.identify_languages(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), empty).first()["lang_pred"] == "und"


def test_long_texts_are_scored_whole(spark, folder):
    model = langid.train_language_model(spark.read.parquet(f"{folder}/documents.parquet"))
    french = "eau é qu ç oi " * 60_000
    names, _ = model.predict(["the thing thous wh " * 3000 + french, None, french[:90]])
    assert names == ["fr", "und", "fr"]


def test_toxicity(spark, folder):
    got = {r["doc_id"]: r for r in toxicity.op10_toxicity(spark, folder).collect()}
    held = [r for r in corpus() if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]]["held_out"] == (r in held) for r in corpus())
    right = np.mean([got[i]["predicted"] == y for i, _, _, _, y in held])
    assert right >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert got[1000]["score"] == got[1001]["score"] and got[1000]["predicted"] == 0 and got[1003]["predicted"] == 1


def test_toxicity_without_labels(spark, nothing):
    model = toxicity.toxicity_model(nothing, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(spark.createDataFrame([(1, "abc", 2.0)], "doc_id long, text string, predicted double"), model).first()["score"] == 0


def test_scores_do_not_depend_on_batches(spark, folder):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.toxicity_model(docs, labels)
    texts = [r["text"] for r in docs.collect()]
    together = model.score(texts)
    assert np.allclose(together, [model.score([t])[0] for t in texts]) and model.score([]).shape == (0,)
    assert np.allclose(sorted(together), sorted(r[0] for r in docs.select(toxicity.toxicity_score(model, F.col("text"))).collect()))


def test_sample_is_bounded_and_reproducible(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 10 = 0 THEN NULL WHEN id % 3 = 0 THEN 'rare' ELSE 'hot' END AS label")
    first = sampling.sample_per_label(rows, "label", 50, "doc_id")
    assert sorted(r["label"] for r in first) == ["hot"] * 50 + ["rare"] * 50
    assert {r["doc_id"] for r in first} == {r["doc_id"] for r in sampling.sample_per_label(rows.repartition(7), "label", 50, "doc_id")}


def test_sample_is_bounded_when_one_id_repeats(spark):
    rows = spark.range(4000).selectExpr("CASE WHEN id < 3000 THEN 7 ELSE id END AS doc_id", "'x' AS label")
    assert all(len(sampling.sample_per_label(rows, "label", 20, "doc_id", seed)) <= 20 for seed in range(5))


def test_prediction_is_the_plain_network():
    rng = np.random.default_rng(0)
    net = textcnn.TextCnn(vocab=20, classes=3, dim=4, filters=5, widths=(1, 2, 3))
    sequences = [rng.integers(0, 20, n) for n in (0, 1, 2, 7, 40)]
    table = net.table(np.arange(21)[:, None])
    for block in (4, 1 << 15):
        textcnn.BLOCK, before = block, textcnn.BLOCK
        got = net.predict(np.concatenate(sequences), np.array([len(s) for s in sequences]), table)
        textcnn.BLOCK = before
        for s, p in zip(sequences, got):
            emb = np.vstack([net.weights["emb"][s], np.zeros((2, 4))])
            h = []
            for w in net.widths:
                acts = [emb[i : i + w].ravel() @ net.weights[f"conv{w}"] + net.weights[f"bias{w}"] for i in range(len(s))]
                h.append(np.maximum(np.max(acts, axis=0), 0) if acts else np.zeros(5))
            z = np.concatenate(h) @ net.weights["out"] + net.weights["out_bias"]
            assert np.allclose(p, np.exp(z) / np.exp(z).sum(), atol=1e-5)


def test_gradients():
    rng = np.random.default_rng(1)
    net = textcnn.TextCnn(vocab=9, classes=2, dim=3, filters=4, widths=(1, 2))
    for k, v in net.weights.items():
        net.weights[k] = v.astype(np.float64)
    features = np.concatenate([rng.integers(0, 9, (6, 2)), np.full((1, 2), 9)])
    sequences, labels = [rng.integers(0, 6, n) for n in (3, 5)], np.array([0, 1])

    def loss():
        table = np.concatenate([net.table(features[:-1]), np.zeros((1, 12))])
        p = net.predict(np.concatenate(sequences), np.array([3, 5]), table)
        return -np.log(p[np.arange(2), labels]).mean()

    grads = net._gradients(sequences, labels, features, np.ones(2))
    for name in ("emb", "conv2", "bias1", "out", "out_bias"):
        w = net.weights[name]
        at = np.unravel_index(np.abs(grads[name]).argmax(), w.shape)
        before = w[at]
        w[at] = before + 1e-3
        up = loss()
        w[at] = before - 1e-3
        down = loss()
        w[at] = before
        assert np.isclose((up - down) / 2e-3, grads[name][at], rtol=0.05, atol=1e-3)


def test_no_part_of_a_word_is_cut():
    word = "unbeschreiblich" * 4 + "idiot"
    want = {zlib.crc32(x.encode()) % toxicity.VOCABULARY for x in (f"<{word}>", "idio", "diot", "iot>", "idiot", "diot>", "<unb", "<unbe")}
    assert want <= set(toxicity.word_features(word).tolist())
    assert len(toxicity.word_features("x" * 1000)) == 1 + 999 + 998


def test_sums_of_any_number_of_features():
    rng = np.random.default_rng(3)
    net = textcnn.TextCnn(vocab=20, classes=2, dim=4, filters=5, widths=(1, 2))
    features = [rng.integers(0, 20, n) for n in (1, 7, 40, 2, 300, 1)]
    for most in (8, 1 << 18):
        textcnn.FEATURES, before = most, textcnn.FEATURES
        got = net.ragged_table(features)
        textcnn.FEATURES = before
        assert np.allclose(got, np.concatenate([net.table(f[None, :]) for f in features]), atol=1e-4)


def test_a_stem_at_the_end_of_a_long_compound_counts():
    heads = ["wasserleitungs", "strassenbahnfahrer", "versicherungs", "gemeinschaftskunde", "unternehmens", "wirtschaftsforschungs", "entwicklungs", "landesregierungs"]
    word = lambda i, stem: heads[i % 8] + heads[(i // 8) % 8] + stem
    rows = [toxicity.Row(text=f"das ist {word(i, stem)} hier", lang="de", toxic=y) for i in range(48) for stem, y in (("idiotenpack", 1), ("blumenbeet", 0))]
    model = toxicity.fit_toxicity(rows)
    scores = [model.score([f"das ist {word(i, s)} hier" for i in range(48, 64)]) for s in ("idiotenpack", "blumenbeet")]
    assert (scores[0] >= toxicity.CUT).all() and (scores[1] < toxicity.CUT).all()


def test_scripts_without_spaces_are_read_to_the_end():
    assert toxicity.words_of("Ab_1 日本語テキスト ไทย straße") == ["ab_1", *"日本語テキスト", *"ไทย", "straße"]
    rng = random.Random(4)
    filler = lambda: "".join(rng.choice("本日天気良明日雨降山川海空花鳥風月") for _ in range(60))
    rows = [toxicity.Row(text=filler() + tail, lang="ja", toxic=y) for _ in range(60) for tail, y in (("馬鹿野郎", 1), ("猫可愛大", 0))]
    model = toxicity.fit_toxicity(rows)
    texts = [filler() for _ in range(20)]
    bad, good = model.score([t + "馬鹿野郎" for t in texts]), model.score([t + "猫可愛大" for t in texts])
    assert (bad >= toxicity.CUT).all() and (good < toxicity.CUT).all()


def test_the_tail_of_a_long_word_changes_the_score():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(36))
    heads = [word() for _ in range(10)]
    model = toxicity.fit_toxicity([toxicity.Row(text=h + tail, lang="en", toxic=y) for h in heads * 8 for tail, y in (("zuxq", 1), ("mill", 0))])
    for long in (word() for _ in range(5)):
        bad, good = model.score([long + "zuxq", long + "mill"])
        assert len(long + "zuxq") == 40 and bad > good + 0.01


def test_scores_against_a_plain_network():
    """Whole texts scored word by word with the network's own weights, and the threshold of the guessed language."""
    model = toxicity.fit_toxicity([toxicity.Row(text=t, lang=lang, toxic=y) for _, t, _, lang, y in corpus(150)])
    net = model.net
    for text in [t for _, t, _, _, _ in corpus(12)] + ["", None, "日本語 zorg"]:
        features = [toxicity.word_features(w) for w in toxicity.words_of(text)]
        emb = np.array([net.weights["emb"][f].sum(axis=0) for f in features]).reshape(-1, net.dim)
        padded = np.vstack([emb, np.zeros((max(net.widths) - 1, net.dim))])
        h = [np.maximum(np.max([padded[i : i + w].ravel() @ net.weights[f"conv{w}"] + net.weights[f"bias{w}"] for i in range(len(emb))], axis=0), 0) if len(emb) else np.zeros(net.filters) for w in net.widths]
        z = np.concatenate(h) @ net.weights["out"] + net.weights["out_bias"]
        raw = float((np.exp(z) / np.exp(z).sum())[1])
        votes = np.sum([model.by_word[f[0]] for f in features], axis=0) if features else np.zeros(model.by_word.shape[1])
        at = model.thresholds[int(np.argmax(votes))]
        want = toxicity.CUT * raw / at if raw < at else toxicity.CUT + (1 - toxicity.CUT) * (raw - at) / (1 - at)
        assert np.isclose(model.score([text])[0], want, atol=1e-4)


def test_languages_against_a_plain_network(spark, folder):
    """Whole texts window by window, the windows' probabilities weighted by their length."""
    model = langid.train_language_model(spark.read.parquet(f"{folder}/documents.parquet"))
    net = model.net
    texts = [t for _, t, _, _, _ in corpus(10)] + ["the thing " * 400, "é", "12", None]
    names, scores = model.predict(texts)
    for text, name, score in zip(texts, names, scores):
        data = (text or "").encode()
        if not any(c.isalpha() for c in text or ""):
            assert (name, score) == ("und", 0)
            continue
        total = np.zeros(len(model.languages))
        for at in range(0, len(data), langid.WINDOW):
            window = list(data[at : at + langid.WINDOW])
            emb = np.vstack([net.weights["emb"][window], np.zeros((max(net.widths) - 1, net.dim))])
            h = [np.maximum(np.max([emb[i : i + w].ravel() @ net.weights[f"conv{w}"] + net.weights[f"bias{w}"] for i in range(len(window))], axis=0), 0) for w in net.widths]
            z = np.concatenate(h) @ net.weights["out"] + net.weights["out_bias"]
            total += np.exp(z) / np.exp(z).sum() * len(window)
        total /= len(data)
        assert name == model.languages[int(total.argmax())] and np.isclose(score, total.max(), atol=1e-4)
