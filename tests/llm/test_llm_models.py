"""Language ID and toxicity: held-out accuracy, planted cases, edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from budgetlens.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(None, "no id"), (1, None), (2, ""), (3, " \n.!? 12 %%"), (4, "a"), (5, "日本語"), (6, "the same"), (6, "the same"), (7, "word and the of " * 20_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "y", 1, "en") for r in rows], "doc_id long, text string, score double, lang_pred string, predicted int, lang string")


# ------------------------------------------------------------------ language ID
def test_language_id_held_out_accuracy(spark):
    got = queries.QUERIES["op9_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 1000 and set(got.lang_pred) <= {"en", "de", "fr", "es", "und"} and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.95


@pytest.fixture(scope="module")
def languages():
    rng = random.Random(3)
    stems = {"en": ["the", "with", "house", "king"], "de": ["der", "mit", "haus", "könig"], "fr": ["le", "avec", "maison", "roi"], "es": ["el", "con", "casa", "rey"], "xx": ["qq", "zz", "qz", "zq"]}
    texts = [(lang, " ".join(rng.choices(w, k=30))) for lang, w in stems.items() for _ in range(30)]
    return langid.fit_texts([t for _, t in texts], [v for v, _ in texts])


def test_language_hierarchy_and_edge_cases(spark, languages):
    assert languages.families == {"germanic": ["de", "en"], "romance": ["es", "fr"], "xx": ["xx"]}
    assert {d.level for d in languages.duels} == {"", "germanic", "romance"}
    rows = ODD + [(10, "the house with the king"), (11, "der haus mit könig"), (12, "el rey con casa"), (13, "le roi avec maison"), (14, "qq zz qz")]
    got = langid.predict(frame(spark, rows), languages).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (10, 11, 12, 13, 14)] == ["en", "de", "es", "fr", "xx"]
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1, 2, 3)) and by[5].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got)


def test_language_model_of_one_or_no_language(spark):
    one = langid.fit_texts(["some text"], ["en"])
    assert {r.doc_id: r.lang_pred for r in langid.predict(frame(spark, [(1, "abc"), (2, None)]), one).collect()} == {1: "en", 2: "und"}
    none = langid.fit(frame(spark, ODD).where("doc_id > 100"))
    assert [r.lang_pred for r in langid.predict(frame(spark, [(1, "abc")]), none).collect()] == ["und"]
    assert langid.predict(frame(spark, []), one).collect() == []


# ------------------------------------------------------------------ toxicity
def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"  # sf0.01 holds out no more than six toxic documents
    got = queries.QUERIES["op10_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.held_out]
    assert held[held.toxic == 0].predicted.mean() <= 0.05 and held[held.toxic == 1].predicted.mean() >= 0.9


@pytest.fixture(scope="module")
def toxic_model():
    rng = random.Random(4)
    pool = [f"plain{k}" for k in range(60)] + ["the", "of"] + ["you"] * 6  # harmless sentences say "you" as well
    texts, y = [], []
    for i in range(200):
        sentences = [" ".join(rng.choices(pool, k=8)) + "." for _ in range(rng.randrange(1, 12))]
        bad = i % 4 == 0
        if bad:
            sentences[rng.randrange(len(sentences))] = f"you {rng.choice(['grumpfel', 'snorkish'])}{rng.choice(['s', 'er', ''])} the of."
        texts.append(" ".join(sentences))
        y.append(int(bad))
    import numpy as np

    return toxicity.fit_texts(texts, np.array(y))


def test_offending_sentence_is_located(spark, toxic_model):
    text = "Plain1 plain2 the. What a SNORKISH thing! Of plain5 the"
    rows = ODD + [(20, text), (21, "plain1 the of. " * 5000), (22, "plain1 the of. " * 5000 + "grumpfels!")]
    got = {r.doc_id: r for r in toxicity.score(frame(spark, rows), toxic_model).collect()}
    assert got[20].predicted == 1 and got[20].offending == ["What a SNORKISH thing!"]
    assert got[21].predicted == 0 and got[21].offending == [] and got[22].predicted == 1 and got[22].offending == ["grumpfels!"]
    assert all(got[i].predicted == 0 and 0 <= got[i].score < 0.01 for i in (1, 2, 3))
    clean = toxicity.keep_clean(frame(spark, rows), toxic_model)
    assert clean.columns == frame(spark, rows).columns
    assert clean.count() == len(rows) - sum(r.predicted for r in toxicity.score(frame(spark, rows), toxic_model).collect())


@pytest.mark.parametrize("text", ["plain1 the of. " * 20_000, "plain1 plain2 the of. " * 60_000, "." * 20_000, "\n" * 20_000, "plain1 the... " * 30_000])
def test_long_clean_text_is_never_toxic(spark, toxic_model, text):
    rows = [(1, text), (2, text + "you grumpfels!"), (3, None)]
    got = {r.doc_id: r for r in toxicity.score(frame(spark, rows), toxic_model).collect()}
    assert (got[1].predicted, got[1].score, got[1].offending) == (0, 0.0, []) and got[3].score == 0
    assert got[2].predicted == 1 and got[2].offending == ["you grumpfels!"]
    assert sorted(r.doc_id for r in toxicity.keep_clean(frame(spark, rows), toxic_model).collect()) == [1, 3]


def test_terminators_teach_nothing():
    import numpy as np

    texts = [f"plain{i % 7} word. " + ("grumpfel it." if i % 4 == 0 else "") for i in range(80)]
    y = np.array([int(i % 4 == 0) for i in range(80)])
    plain, dotted = toxicity.fit_texts(texts, y), toxicity.fit_texts([t + "." * 9000 for t in texts], y)
    assert list(plain.buckets) == list(dotted.buckets) and np.allclose(plain.weights, dotted.weights)


def test_toxicity_without_a_class_or_rows(spark):
    docs = frame(spark, [(1, "a b"), (2, "c d")])
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert not len(model.weights) and [r.predicted for r in toxicity.score(docs, model).collect()] == [0, 0]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels.limit(0))).collect() == []


def test_clean_text_of_any_length_stays_clean_and_a_toxic_sentence_in_it_counts(spark):
    """Real texts joined: weak evidence adds up no more than clean prose holds of it."""
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic IS NOT NULL")
    held = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    model = toxicity.fit(docs, labels.where("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) <> 0"))
    mine = docs.where(F.col("doc_id").isin(list(held)))
    scores = {r.doc_id: r.score for r in toxicity.score(mine, model).collect()}
    texts = {r.doc_id: r.text for r in mine.collect()}
    clean = [t for i, t in sorted(texts.items()) if not held[i] and scores[i] < 0.5 and t]
    toxic = [i for i in texts if held[i]]
    assert sum(scores[i] >= 0.5 for i in toxic) >= 0.9 * len(toxic)
    worst = next(texts[i] for i in toxic if scores[i] > 0.99)
    rng, joined = random.Random(8), []
    for size in (100_000, 300_000, 1_000_000, 3_000_000):
        for _ in range(4):
            out = []
            while sum(map(len, out)) < size:
                out.append(rng.choice(clean))
            joined.append("\n".join(out))
    rows = [(k, t) for k, t in enumerate(joined)] + [(100 + k, t + "\n" + worst) for k, t in enumerate(joined)]
    got = {r.doc_id: r.predicted for r in toxicity.score(frame(spark, rows), model).collect()}
    assert sum(got[k] for k in range(len(joined))) == 0 and all(got[100 + k] == 1 for k in range(len(joined)))


def plain_toxicity(text, weights, background):
    """Noisy-or by the formula, from words to the score."""
    import math
    import re

    from budgetlens.llm.common import LETTERS

    strong = weak = words = 0
    for sentence in re.split(rb"(?<=[.!?\n])", text.encode()):
        z, speaks = toxicity.BIAS, 0.0
        for word in sentence.translate(LETTERS).split():
            words += 1
            value = weights(word)
            z, speaks = z + value, speaks + abs(value)
        p = math.log1p(math.exp(z)) if z > toxicity.BIAS else 0.0
        strong, weak = (strong + p, weak) if z >= 0 else (strong, weak + p)
    return 1 - math.exp(-(strong + max(0.0, weak - toxicity.EXCUSED * background * words)))


def test_scores_equal_the_plain_formula(toxic_model):
    import numpy as np
    import pyarrow as pa

    from budgetlens.llm.common import span_hashes

    table = toxic_model.table()

    def weights(word):
        raw = np.frombuffer(word, np.uint8)
        shift = np.uint64(64 - toxicity.BITS)
        own = int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0] >> shift)
        stems = [int((span_hashes(raw, np.array([0]), np.array([k])) * np.uint64(0x9E3779B97F4A7C15))[0] >> shift) for k in toxicity.PREFIXES if len(raw) > k]
        return float(sum(table[b] for b in [own, *stems]))

    texts = ["", "you grumpfels! plain1 you snork.", "Plain3 of the.\nSnorkisher you? you you", "a grumpf b snorki. " * 30, "é 12 grumpfel-er"]
    got, _ = toxicity.score_batch(pa.array(texts, pa.large_string()), table, 0.01)
    assert np.allclose(got, [plain_toxicity(t, weights, 0.01) for t in texts], atol=1e-9)
