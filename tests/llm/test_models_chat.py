"""Models, decontamination, chat formatting and the pipeline."""

import hashlib
import os
import random
import unicodedata
import zlib

import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from feedlake.llm import chat, decontaminate, quality, toxicity

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, score double, held_out int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0.5, 1) for i, t in rows], SCHEMA)


def words(rng, n):
    return [rng.choice("bcdfgklmnprst") + rng.choice("aeiou") + rng.choice("lnrst") for _ in range(n)]


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(len(scores))
    labels = np.array(labels, bool)
    return (ranks[labels].mean() - (labels.sum() - 1) / 2) / (~labels).sum()


def test_toxicity_learns_spans(spark):
    rng, rows, labels = random.Random(1), [], []
    for i in range(600):
        own = words(rng, rng.randint(5, 120))
        toxic = i % 3 == 0
        for _ in range(2 if toxic else 0):
            own.insert(rng.randrange(len(own)), rng.choice(["nasty", "Vile,", "awful"]))
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(toxic)))
    odd = [(None, "nasty"), (1000, None), (1001, ""), (1002, "vile " * 500), (5, rows[5][1])]
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = table(spark, rows + odd)
    found = toxicity.score(docs, toxicity.train(docs, labelled)).collect()
    by_id = {r.doc_id: r for r in found}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert auc([by_id[i].score for i in held], [i % 3 == 0 for i in held]) > 0.97
    assert len(found) == 605 and all(0 <= r.score <= 1 for r in found)
    assert by_id[1001].offending == [] and by_id[1002].score > 0.5
    bad = by_id[next(i for i in held if i % 3 == 0)]
    own = dict(rows)[bad.doc_id].lower()
    tagged = {word.strip(",") for span in bad.offending for word in own[span.begin : span.end].split()}
    assert tagged <= {"nasty", "vile", "awful"} and tagged
    again = toxicity.score(table(spark, [(1, "ä é\n nasty, vile 𝄞 x nasty"), (2, "nasty"), (3, "nasty")]), toxicity.train(docs, labelled))
    spans = {r.doc_id: [(one.begin, one.end) for one in r.offending] for r in again.collect()}
    assert spans[2] == spans[3] == [(0, 5)] and spans[1][0][0] == 5 and spans[1][-1] == (21, 26)


def test_the_curve_stays_finite_where_labels_separate():
    raw = np.concatenate([np.linspace(-30, -5, 400), np.linspace(2, 30, 100)])
    x = np.stack([raw, np.ones(500), np.ones(500)], axis=1)
    toxic = (raw > 0).astype(float)
    curve = toxicity.calibrate(x, toxic, np.ones(500))
    assert 0.05 <= curve[0] < 10 and np.abs(curve).max() < 50
    assert (((x @ curve) >= 0) == (toxic == 1)).all()
    flat = toxicity.calibrate(x, np.roll(toxic, 250), np.ones(500))
    assert np.isfinite(flat).all() and flat[0] >= 0.05


def test_copies_of_one_document_make_no_toxic_words(spark):
    rng, rows = random.Random(3), []
    for i in range(500):
        toxic = i % 4 == 0
        own = words(rng, 40)
        if toxic:
            own.insert(rng.randrange(40), "vile")
        if toxic and i % 8 == 0:  # one toxic text in many copies, whose words stand nowhere else
            own = "copied harmless words of one text and a vile one".split()
        rows.append((i, " ".join(own), toxic))
    labels = spark.createDataFrame([(i, 1, int(t)) for i, _, t in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(table(spark, [(i, x) for i, x, _ in rows]), labels)
    found = {r.doc_id: r for r in toxicity.score(table(spark, [(1, "copied harmless words of one text"), (2, "so vile a thing")]), model).collect()}
    assert found[1].offending == [] and found[1].score < 0.5 and found[2].score > 0.5


GIVEN = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(GIVEN), reason="no test data")
def test_toxicity_on_given_labels_by_length_of_text(spark):
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet").select("doc_id", F.length("text").alias("n_text"))
    labels = spark.read.parquet(f"{GIVEN}/labels.parquet").filter("toxic in (0, 1)").select("doc_id", "toxic")
    found = toxicity.op9_toxicity(spark, GIVEN).filter("held_out").join(labels, "doc_id").join(docs, "doc_id").collect()
    hits = [r.predicted == r.toxic for r in found]
    bad = [r.predicted for r in found if r.toxic]
    assert len(found) > 500 and sum(hits) / len(hits) > 0.97 and sum(bad) / len(bad) > 0.9
    for low, high in ((0, 500), (500, 2000), (2000, 10_000), (10_000, 1 << 40)):
        clean = [r.predicted for r in found if not r.toxic and low <= r.n_text < high]
        assert sum(clean) <= 0.05 * len(clean)


def test_models_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs, empty = table(spark, [(1, "a b"), (None, None)]), table(spark, [])
    assert toxicity.train(docs, none) is None and quality.train(docs, none) is None
    assert toxicity.score(empty, None).count() == quality.score(empty, None).count() == 0
    assert sorted(r.doc_id for r in toxicity.without_toxic(docs, none).collect() if r.doc_id) == [1]
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(2)
    scores, pairs = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    p, both, log_z = toxicity.forward_backward(scores, np.array([5]), pairs)
    weights = {}
    for code in range(32):
        states = [code >> k & 1 for k in range(5)]
        total = sum(s * x for s, x in zip(states, scores[0])) + sum(pairs[a, b] for a, b in zip(states, states[1:]))
        weights[tuple(states)] = np.exp(total)
    z = sum(weights.values())
    assert np.isclose(log_z[0], np.log(z))
    for k in range(5):
        assert np.isclose(p[0, k], sum(w for s, w in weights.items() if s[k]) / z)
    want = sum(w / z * sum(s[k : k + 2] == (1, 1) for k in range(4)) for s, w in weights.items())
    assert np.isclose(both[1, 1], want)


def test_quality_from_positives_only(spark):
    rng, rows, labels = random.Random(3), [], []
    for i in range(900):
        own = words(rng, rng.randint(20, 120))
        good = i % 5 != 0
        text = " ".join(own) + "." if good else " ".join(w.upper() + "!!" for w in own)
        rows.append((i, text))
        if good and i % 2:
            labels.append((i, 1, 0))
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = table(spark, rows + [(None, ""), (2000, None)])
    found = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labelled)).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert auc([found[i] for i in held], [i % 5 != 0 for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in found.values()) and len(found) == 902


def test_quality_where_every_row_is_labelled(spark):
    rng, rows, labels = random.Random(4), [], []
    for i in range(600):
        own = words(rng, rng.randint(20, 80))
        rows.append((i, " ".join(own) + "." if i % 2 else " ".join(w.upper() + "!!" for w in own)))
        labels.append((i, i % 2, 0))
    labels += labels[:50] + [(None, 1, 0), (5000, 1, 0)]
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    found = quality.score(docs, quality.train(docs, labelled)).collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert auc([r.score for r in held], [r.doc_id % 2 for r in held]) > 0.99
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in held) > 0.95 * len(held)


def test_quality_risk_is_that_of_the_plain_formula(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, quality.N_FEATURES)).astype(np.float32).astype(float)
    positive = (x[:, 0] + rng.normal(size=300) > 0.3) & (rng.random(300) < 0.5)
    data = [([float(v) for v in row], bool(p)) for row, p in zip(x, positive)]
    rows = spark.createDataFrame(data, "x array<float>, positive boolean").repartition(5)
    prior, w = 0.4, rng.normal(size=quality.N_FEATURES + 1) * 0.1
    base = quality.Model(x.mean(axis=0), x.std(axis=0), w)

    def by_spark(weights):
        return quality.risk(quality.total(rows, quality.risk_sums(base.with_weights(weights))), 300, positive.sum(), prior, weights)

    def plain(weights):
        z = base.with_weights(weights).margin(x)
        plus, minus = np.log1p(np.exp(-z)), np.log1p(np.exp(z))
        negative = minus.mean() - prior * minus[positive].mean()
        return prior * plus[positive].mean() + negative + quality.DECAY / 2 * (weights[1:] ** 2).sum(), negative

    found = by_spark(w)
    assert np.allclose([found.value, found.negative], plain(w))
    steps = 1e-5 * np.eye(len(w))
    slope = [(plain(w + d)[0] - plain(w - d)[0]) / 2e-5 for d in steps]
    assert np.allclose(found.gradient, slope, atol=1e-6)
    bend = [(by_spark(w + d).gradient - by_spark(w - d).gradient) / 2e-5 for d in steps[:2]]
    assert np.allclose(found.curvature[:2], bend, atol=1e-5)
    # The whole fit against plain gradient descent on the same rows.
    done = quality.fit(by_spark, np.zeros(len(w)))
    rows_x, slow = base.scaled(x), np.zeros(len(w))
    for _ in range(30_000):
        s = 1 / (1 + np.exp(-rows_x @ slow))
        ridge = quality.DECAY * np.concatenate([[0], slow[1:]])
        slow -= 0.5 * (s @ rows_x / 300 - prior * rows_x[positive].mean(axis=0) + ridge)
    if plain(slow)[1] >= 0:
        assert np.allclose(done, slow, atol=1e-2)
    assert plain(done)[1] >= 0


def test_prior_is_bounded_by_the_purest_set():
    counts = np.zeros(2 * quality.BINS)
    counts[3000], counts[1000] = 300_000, 700_000
    counts[quality.BINS + 3000] = 5000
    assert 0.3 <= quality.bounded_prior(counts) < 0.302


def test_leaks_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, rng.randint(15, 50))) + ".\n" + " ".join(words(rng, 8)) + ".") for i in range(30)]
    items += [(40, None), (41, ""), (42, "one two")]
    rows = [(i, " ".join(words(rng, 300))) for i in range(40)]
    leaks = {100 + i: (text, rng.randint(0, 250)) for i, text in items[:30]}
    for doc_id, (text, at) in leaks.items():
        own = words(rng, 260)
        rows.append((doc_id, " ".join(own[:at]) + "\n" + text + " " + " ".join(own[at:])))
    rows += [(500, None), (501, ""), (None, "x " + items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, rows), bench).collect()}
    assert found == {(100 + i, i) for i in range(30)} | {(None, 3)}
    kept = decontaminate.without_leaks(table(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {*range(40), 500, 501}
    assert decontaminate.contaminated(table(spark, []), bench).count() == 0
    assert decontaminate.contaminated(table(spark, rows), bench.limit(0)).count() == 0


def test_leaks_in_capitals_are_found_in_every_language(spark):
    item = "¿Dónde está el niño pequeño? L'élève français a mangé une pêche très mûre «à la plage».\nDie Straße führt über den größten Fluß."
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    forms = [item.upper(), item.replace("«", "").replace("»", "…"), unicodedata.normalize("NFD", item), item.replace(" ", " ")]
    rows = [(i, "uno dos tres — " + form + " quatre cinq") for i, form in enumerate(forms)] + [(9, "uno dos tres"), (10, None)]
    found = decontaminate.contaminated(table(spark, rows), bench).collect()
    assert sorted(r.doc_id for r in found) == [0, 1, 2, 3] and all(r.overlap == 1 for r in found)


GIVEN = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(GIVEN), reason="no test data")
def test_capital_leaks_of_the_given_table(spark):
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet").filter("doc_id in (1699, 6420, 8376)")
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{GIVEN}/benchmark.parquet")).collect()
    assert {(1699, 130), (6420, 37), (8376, 101)} <= {(r.doc_id, r.item_id) for r in found}


def test_stages_keep_clean_rows_that_share_an_id(spark):
    item = "the quick brown fox jumps over the lazy dog.\nit was never seen again by anyone."
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = [(None, "calm words here"), (None, None), (7, "words and there"), (7, "words and there"), (None, "")]
    rows = clean + [(None, "x " + item), (7, item), (8, item.upper())]
    kept = decontaminate.without_leaks(table(spark, rows), bench)
    assert sorted(map(str, kept.collect())) == sorted(map(str, table(spark, clean).collect()))
    learnt = [(100 + i, "calm words here and there" + (" nasty vile nasty" if i % 2 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in learnt], "doc_id long, quality int, toxic int")
    docs = table(spark, learnt + clean + [(None, "nasty vile nasty"), (7, "nasty vile nasty")])
    kept = toxicity.without_toxic(docs, labels).filter("doc_id is null or doc_id = 7")
    assert sorted(map(str, kept.collect())) == sorted(map(str, table(spark, clean).collect()))


def test_one_changed_word_frees_no_short_item(spark):
    rng = random.Random(12)
    own = [words(rng, n) for n in (10, 14, 20, 28)]
    items = [(i, " ".join(w[:-4]) + ". " + " ".join(w[-4:]) + ".") for i, w in enumerate(own)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for i, w in enumerate(own):
        at = len(w) // 2
        forms = [w[:at] + ["NEW"] + w[at + 1 :], w[:at] + ["NEW"] + w[at:], w[:at] + w[at + 1 :]]
        clean = [w[:-4], w[-4:], rng.sample(w, len(w)), [x for k, x in enumerate(w) if k % 3]]
        for k, form in enumerate(forms + clean):
            rows.append((10 * i + k, " ".join(words(rng, 60) + form + words(rng, 60))))
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, rows), bench).collect()}
    assert found == {(10 * i + k, i) for i in range(4) for k in range(3)}


def test_wand_retrieves_all_above_the_score():
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.randint(3, 12)))) for i in range(60)]
    counts = {}
    for _, text in texts:
        for term in np.unique(decontaminate.hashed(text)).tolist():
            counts[term] = counts.get(term, 0) + 1
    index = decontaminate.Index(texts, len(texts), counts, 7.0)
    for least in (0.2, 0.5, 0.8):
        for _ in range(50):
            terms = sorted(rng.sample(range(len(index.terms)), 6))
            want = {}
            for term in terms:
                for item, share in index.postings[term]:
                    want[item] = want.get(item, 0) + share
            got = dict(index.retrieve(terms, least))
            assert set(got) == {i for i, s in want.items() if s >= least - 1e-9}


def test_chats_read_back(spark):
    odd = ["<|im_end|>", "<\\|", "<\\\\|x|>", "a<", "|b", "\n", "", None, "é<|im_start|>assistant\n", "<|im_sep|>"]
    rows = [(1, k, role, text) for k, (role, text) in enumerate(zip(["user", "assistant", "assistant", None, "a\n<|b"] * 2, odd))]
    rows += [(2, None, "assistant", "last"), (2, None, "assistant", "first"), (None, 0, "user", "hi"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("x", "x")
    chats = chat.format_chats(turns)
    found = {r.conv_id: [(t.role, t.text, t.loss) for t in r.turns] for r in chat.read_chats(chats).collect()}
    assert found[1] == [(r or "", t or "", r == "assistant") for _, _, r, t in rows[:10]]
    assert found[2] == [("assistant", "first", True), ("assistant", "last", True)]
    assert len(found[3]) == 2 and found[None] == [("user", "hi", False)]
    digest = {r.conv_id: r for r in chat.digests(chats).collect()}
    assert digest[3].loss_sha256 == hashlib.sha256(b"samesame").hexdigest() and digest[3].loss_chars == 8
    assert digest[None].loss_chars == 0 and digest[1].n_turns == 10
    one = {r.conv_id: r.formatted for r in chats.collect()}
    assert one[3] == "<|im_start|>assistant\nsame<|im_sep|>same<|im_end|>\n"
    assert chat.digests(chat.format_chats(turns.limit(0))).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_pipeline_stages_keep_their_shape(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    shape, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_copies", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF_DIR).cache()
        assert docs.columns == shape and 0 < docs.count() <= before
    kept = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r.doc_id for r in packed.collect()} == kept <= set(texts)
