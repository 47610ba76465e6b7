import numpy as np
import pytest

from millrace.llm import level, mix

DOCS = "doc_id long, text string, lang string, source string, tokens string"
TARGETS = "source string, target_share double, max_repeats int"


def corpus(spark):
    rows = [(i, f"word {i} of the large source", "en", " Big " if i % 2 else "BIG", "clash") for i in range(400)]
    rows += [(1000 + i, f"a small note {i}", "de", "small", "clash") for i in range(10)]
    rows += [(2000, None, "en", "big", ""), (2001, "", None, "small", ""), (2002, "lost", "en", None, ""), (2003, "outside", "en", "other", "")]
    rows += [(3000 + i, "the same text again", "xx", "copy", "") for i in range(30)]
    targets = [("big", 0.5, 2), ("small", 0.3, 3), ("copy", 0.1, 2), ("absent", 0.1, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, TARGETS)


def test_short_sources_by_definition(spark):
    docs, targets = corpus(spark)
    tokens = {}
    for r in mix.sized_documents(docs, targets).collect():
        tokens[r.source] = tokens.get(r.source, 0) + r.tokens
    total = sum(tokens.values())
    want = {t.source for t in targets.collect() if tokens.get(t.source, 0) * t.max_repeats < t.target_share * total}
    assert {r.source for r in mix.short_sources(docs, targets).collect()} == want == {"small", "absent", "copy"}


def test_mixture_keeps_caps_and_texts(spark):
    docs, targets = corpus(spark)
    rows = mix.mixture(docs, targets).collect()
    caps = {t.source: t.max_repeats for t in targets.collect()}
    assert all(1 <= r.uses <= caps[r.source] and r.tokens > 0 for r in rows)
    assert sum(r.source == "copy" for r in rows) <= 1  # one text, whatever the number of its copies
    assert all(r.uses == 3 for r in rows if r.source == "small") and sum(r.source == "small" for r in rows) == 10
    again = mix.mixture(docs.repartition(7), targets).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_shares_and_empty_tables(spark):
    docs, targets = corpus(spark)
    shares = {r.source: r for r in mix.mixture_shares(docs, targets).collect()}
    assert set(shares) == {"big", "small", "copy", "absent"} and shares["absent"].tokens == 0
    assert abs(sum(r.share for r in shares.values()) - 1) < 1e-9
    assert {r.source for r in mix.short_sources(docs.limit(0), targets).collect()} == set()
    assert mix.mixture(docs.limit(0), targets).count() == 0


def test_short_sources_are_what_the_fit_leaves_open(spark, monkeypatch):
    docs, targets = corpus(spark)
    monkeypatch.setattr(mix, "rake", lambda tokens, caps, members, goals: np.zeros(len(tokens)))
    assert {r.source for r in mix.short_sources(docs, targets).collect()} == {"big", "small", "absent", "copy"}


def test_drawn_shares_come_near_their_targets(spark):
    rows = [(i, f"text number {i} has some {'more ' * (i % 9)}words", ("en", "de", None)[i % 3], ("a", "b", "c")[min(2, i % 7)], "") for i in range(6000)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("A", 0.5, 5), ("b", 0.3, 5), ("c", 0.2, 5)], TARGETS)
    assert not mix.short_sources(docs, targets).count()
    for r in mix.mixture_shares(docs, targets).collect():
        assert abs(r.share - r.target_share) < 0.02


def test_topics_tell_kinds_of_text_apart(spark):
    kinds = ("the queue of the cache holds the index of the registry", "my aunt bakes bread and sweet cakes on Sunday morning")
    docs = spark.createDataFrame([(i, f"{kinds[i % 2]} {i}", "en", "a", "") for i in range(400)], DOCS)
    rows = mix.sized_documents(docs, spark.createDataFrame([("a", 1.0, 1)], TARGETS)).collect()
    topics = [{r.topic for r in rows if r.doc_id % 2 == k} for k in (0, 1)]
    assert not topics[0] & topics[1] and all(t.startswith("en-") for t in topics[0] | topics[1])


def test_too_many_targets_are_refused(spark):
    docs, _ = corpus(spark)
    targets = spark.range(mix.MAX_SOURCES + 1).selectExpr("concat('s', id) as source", "1e-5D as target_share", "1 as max_repeats")
    with pytest.raises(ValueError):
        mix.short_sources(docs, targets)


def test_rake_fits_the_margins():
    tokens = np.array([100.0, 300.0, 200.0, 400.0])
    uses = mix.rake(tokens, np.full(4, 5.0), [np.array([0, 1, 0, 1]), np.array([0, 0, 1, 1])], [np.array([400.0, 600.0]), np.array([700.0, 300.0])])
    assert np.allclose(np.bincount([0, 0, 1, 1], tokens * uses), [700, 300]) and np.allclose(np.bincount([0, 1, 0, 1], tokens * uses), [400, 600], rtol=1e-3)


EASY, MEDIUM, HARD = "The box is red. Take it now.", "The office keeps a regular folder for all visitors in the harbour.", "Notwithstanding the jurisprudential considerations, whereas the commensurability of methodological presuppositions attenuates, the determination remains unequivocal."


def graded(spark):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(240):
        band = 1 + i % 3
        docs.append((i, " ".join([(EASY, MEDIUM, HARD)[band - 1]] * int(rng.integers(3, 9))) + f" {chr(97 + i % 26) * 3}.", "x"))
        if i % 2:
            labels.append((i, band if i % 11 else min(3, band + 1), "a"))
    docs += [(900, None, "x"), (901, "", "x"), (902, " \n ", "x"), (903, "123 +++", "x"), (904, "word", "x")]
    labels += [(3, None, "b"), (5, 9, "b"), (None, 2, "b"), (77777, 2, "b")]
    return spark.createDataFrame(docs, "doc_id long, text string, band string"), spark.createDataFrame(labels, "doc_id long, band int, rater string")


def test_held_out_accuracy_and_dirt(spark):
    docs, labels = graded(spark)
    found = {r.doc_id: r for r in level.reading_levels(docs, labels).collect()}
    assert len(found) == 245
    held = [i for i in range(240) if i % 2 == 0]
    assert np.mean([found[i].band == 1 + i % 3 for i in held]) > 0.9
    assert all(found[i].band is None and found[i].level is None for i in (900, 901, 902, 903))
    assert found[904].band is not None


def test_levels_without_labels_or_documents(spark):
    docs, labels = graded(spark)
    assert {r.band is None for r in level.reading_levels(docs.where("doc_id < 5"), labels.limit(0)).collect()} == {False}
    assert level.reading_levels(docs.limit(0), labels).count() == 0


def test_gradient_matches_a_search():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(level.FEATURES)))
    y = np.digitize(x[:, 0] * 2 + rng.normal(size=400) * 0.3, [-2, 0, 2]) + 1
    lang = np.zeros(400, int)
    m = level.OrdinalModel.fit(x, lang, y, np.zeros((4, x.shape[1])), np.ones((4, x.shape[1])))
    assert np.mean(m.band(x, lang) == y) > 0.8 and list(m.cuts) == sorted(m.cuts)


def test_every_script_has_a_level(spark):
    russian = "Система проверяет каждую запись перед сохранением. Это важно для всех пользователей, которые работают с архивом."
    greek = "Το σύστημα ελέγχει κάθε εγγραφή πριν από την αποθήκευση."
    rows = [(1, russian, "ru"), (2, greek, None), (3, "Le dossier est prêt pour la réunion.", "fr"), (4, "retry list: alpha beta", "de"), (5, "Die Mappe liegt im Regal und der Schlüssel nicht.", "en"), (6, "检索构建器在写入之前会校验每一批记录。", "en"), (7, "The box is on the table.", "zh")]
    docs, labels = graded(spark)
    found = {r.doc_id: r for r in level.reading_levels(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    assert all(found[i].band is not None for i in found)
    assert {i: r.lang for i, r in found.items()} == {1: "other", 2: "other", 3: "other", 4: "de", 5: "de", 6: "zh", 7: "en"}


def test_rarity_is_that_of_exact_counts(spark):
    texts = ["common common rare", "common 123, Common!", None, ""]
    found = level.word_surprise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert found == {"common": pytest.approx(np.log2(5 / 4)), "rare": pytest.approx(np.log2(5))}


def test_expected_shares_of_bands_are_those_met():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(level.FEATURES)))
    y = np.digitize(x[:, 0] * 2 + rng.logistic(size=3000), [-2, 0, 2]) + 1
    lang = rng.integers(0, 2, 3000)
    rows = level.calibration(x, lang, y, np.zeros((4, x.shape[1])), np.ones((4, x.shape[1])))
    assert len(rows) == 8 and all(abs(expected - real) < 0.03 for *_, expected, real in rows)
