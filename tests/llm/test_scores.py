"""Quality, language and toxicity: odd rows, and held-out accuracy on the smallest tables."""

import zlib

import numpy as np
import pytest
from support import DATA

from citeloom.llm import language_id, quality_classifier, sampling, toxicity


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, 1, 0), (7, 0, 1), (8, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def auc(score, label):
    a, b = score[label == 1], score[label == 0]
    return (a[:, None] > b[None, :]).mean() + 0.5 * (a[:, None] == b[None, :]).mean()


def test_odd_rows_get_scores(spark, odd, empty, labels):
    net = quality_classifier.train([("good words here", 1), ("%%% junk ***", 0)] * 8, 0.8, steps=5)
    got = quality_classifier.score_quality(odd, net).toPandas()
    assert len(got) == odd.count() and got.score.between(0, 1).all()
    assert quality_classifier.score_quality(empty, net).count() == 0
    for model in (toxicity.learn(odd, labels), toxicity.learn(empty, labels.limit(0))):
        got = toxicity.score_toxicity(odd, model).toPandas()
        assert len(got) == odd.count() and got.score.between(0, 1).all()
        assert toxicity.score_toxicity(empty, model).count() == 0
    assert quality_classifier.learn(empty, labels.limit(0)).constant == 0.5


def test_languages_of_odd_rows(spark, odd, empty):
    learned = language_id.learn(odd)
    got = language_id.identify(odd, learned, odd.columns).toPandas()
    assert len(got) == odd.count() and got.score.between(0, 1).all()
    by = dict(zip(got.doc_id, got.lang_pred, strict=True))
    assert by[2] == by[3] == by[4] == by[9] == "und" and by[1] != "und"
    assert set(language_id.identify(odd, language_id.learn(empty)).toPandas().lang_pred) == {"und"}


@pytest.mark.parametrize("dense", [None, 0])
@pytest.mark.parametrize("stretch", [256, 4, 1])
def test_phrases_are_those_of_a_plain_parse(monkeypatch, dense, stretch):
    monkeypatch.setattr(language_id, "STRETCH", stretch)
    learned = (("en", "the cat sat on the mat and the dog"), ("de", "die katze und der hund auf der matte"), ("ja", "日本語と猫"))
    parser = language_id.Parser(learned, dense)
    texts = ["the cat and the hund", "zzz", "katze", "a", "the mat " * 100, "猫と日本語 the", "", "die katze und der hund auf der matte die katze"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *[len(t.encode()) for t in texts]])
    codes, row = parser.codes(raw, offs)
    got = parser.phrases(codes, row, len(texts))
    for i, text in enumerate(texts):
        folded = language_id.fold(text) + (" " if text.endswith(" ") else "")
        for k, (_, known) in enumerate(learned):
            n, at = 0, 0
            while at < len(folded):
                j = at + 1
                while j < len(folded) and folded[at : j + 1] in known:
                    j += 1
                n, at = n + 1, j
            assert got[i, k] == n, (text, k)


def test_scripts_with_many_letters_are_told_apart(spark):
    g = np.random.default_rng(1)
    signs = {"zh": [chr(0x4E00 + i) for i in range(400)], "ko": [chr(0xAC00 + 7 * i) for i in range(400)], "ru": list("абвгдежзиклмнопрстуфхцчшыэюя")}
    text = lambda lang, n: " ".join("".join(g.choice(signs[lang], 3)) for _ in range(n))
    rows = [(1000 * k + i, text(lang, 200), lang) for k, lang in enumerate(signs) for i in range(12)] + [(9000 + i, f"language number {i} " * 20, f"l{i:03}") for i in range(80)]
    rows.append((9999, text("ru", 30_000), "ru-long"))  # only one text, and a long one
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language_id.learn(docs, 1, 5)  # nothing is held out
    assert {lang for lang, _ in learned} == {r[2] for r in rows}
    parser = language_id.Parser(learned)
    for lang in ("zh", "ko"):
        raw = np.frombuffer(text(lang, 50).encode(), np.uint8)
        assert parser.predict(raw, np.array([0, len(raw)]))[0] == [lang]


def test_labels_of_other_documents_take_no_places(spark):
    docs = spark.createDataFrame([(i * 1000, f"text {i}") for i in range(200)] + [(7, None), (9, "x" * (sampling.MAX_LEARN_CHARS + 1))], "doc_id long, text string")
    labels = spark.range(0, 400_000).select(sampling.F.col("id").alias("doc_id"), sampling.F.expr("cast(id % 2000 div 1000 as int)").alias("quality"))
    rows, share = sampling.labelled_texts(docs, labels, "quality", sampling.F.lit(False), 150)
    assert len(rows) == 200 and [y for _, y in rows].count(1) == 100 and share == 0.5


def test_samples_are_whole_and_repeatable(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)] + [(3, "another"), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(3, 0), (None, 1)], "doc_id long, toxic int")
    none_held = sampling.F.lit(False)
    one, share = sampling.labelled_texts(docs.repartition(7), labels.repartition(3), "toxic", none_held, 40)
    two, _ = sampling.labelled_texts(docs, labels, "toxic", none_held, 40)
    assert one == two and [y for _, y in one].count(0) == [y for _, y in one].count(1) == 40 and abs(share - 249 / 500) < 1e-9
    assert len(sampling.labelled_texts(docs, labels, "toxic", none_held, 1000)[0]) == 500


def test_queries_mark_the_fold_and_the_class(spark):
    from citeloom.llm import queries

    made = queries.queries()
    for name, n, rest, columns in (("op1_quality_classifier", 3, 1, ["doc_id", "held_out", "score", "predicted"]), ("op3_language_id", 4, 2, ["doc_id", "held_out", "lang_pred", "score"]), ("op4_toxicity", 5, 0, ["doc_id", "held_out", "score", "predicted"])):
        got = made[name](spark, DATA)
        assert got.columns == columns
        got = got.collect()
        assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == rest) and 0 <= r.score <= 1 for r in got)
        if "predicted" in columns:
            assert all(r.predicted == int(r.score >= 0.5) for r in got)


def plain_tree_margin(x, trees):
    """Each tree walked from its root."""
    out = []
    for row in x:
        total = trees.base
        for column, cut, value in trees.trees:
            node = 0
            while node < len(column):
                node = 2 * node + 1 + bool(row[column[node]] > cut[node])
            total += value[node - len(column)]
        out.append(total)
    return np.array(out)


def test_trees_split_where_a_plain_search_does():
    g = np.random.default_rng(8)
    x = np.stack([g.integers(0, 6, 400), g.random(400), g.integers(0, 3, 400)], axis=1).astype(float)
    y = ((x[:, 0] > 3) ^ (x[:, 1] > 0.6)).astype(float)
    trees = toxicity.Trees().fit(x, y)
    assert np.allclose(trees.margin(x), plain_tree_margin(x, trees))
    assert auc(trees.margin(x), y) > 0.98
    # the first split is the best one of all columns and edges
    p = y.mean()
    grad, hess = y - p, np.full(len(y), p * (1 - p)) + 1e-6
    best = (0, None)
    for j in range(3):
        for cut in trees.edges[j]:
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) < toxicity.LEAF_ROWS:
                continue
            gain = sum(grad[m].sum() ** 2 / (hess[m].sum() + 1) for m in (left, ~left)) - grad.sum() ** 2 / (hess.sum() + 1)
            if gain > best[0] + 1e-9:
                best = (gain, (j, cut))
    column, cut, _ = trees.trees[0]
    assert (column[0], cut[0]) == best[1]


def test_features_against_plain_counting():
    import re

    words = np.sort(toxicity.hash_bytes([b"stupid", b"idiot"]))
    odds = np.array([2.0, 3.0])
    weight = dict(zip(words.tolist(), odds.tolist(), strict=True))
    value = {w: weight[int(toxicity.hash_bytes([w.encode()])[0])] for w in ("stupid", "idiot")}
    none = (np.zeros(0, np.uint64), np.zeros(0))
    lexicon = {kind: none for kind in toxicity.KINDS} | {"word": (words, odds)}
    texts = ["You stupid fool! why?", "", "STUPID, stupid idiot - no one here at all says you", "a b c d e f g you h i j k l m idiot", "calm words only; 2024"]
    raw = [t.encode() for t in texts]
    got = toxicity.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *[len(r) for r in raw]]), lexicon)
    for t, row in zip(texts, got, strict=True):
        own = re.findall("[a-z]+", t.lower())
        hits = [i for i, w in enumerate(own) if w in value]
        near = [i for i in hits if any(w == "you" for w in own[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1])]
        size, per = max(len(t), 1), max(len(own), 1)
        want = [len(hits), 0, 0, 0, 0, len(hits), len(hits) / per, sum(value[own[i]] for i in hits) / per, max((value[own[i]] for i in hits), default=0), len(near), len(near) / per]
        want += [sum("A" <= c <= "Z" for c in t) / size, sum(c in "!?" for c in t) / size, sum(c in ",;-" for c in t) / size, 0, len(own)]
        assert np.allclose(row, want), (t, row, want)


def test_a_score_is_that_of_a_plain_network():
    net = quality_classifier.Network(4)
    texts = ["", "short", "word " * 400]
    raw = [t.encode() for t in texts]
    got = net.score(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *[len(r) for r in raw]]))
    w, d = quality_classifier.WIDTH, quality_classifier.DIM
    for text, score in zip(raw, got, strict=True):
        outputs, at = [], 0
        while True:
            chunk = np.frombuffer(text[at : at + quality_classifier.CHUNK].ljust(quality_classifier.CHUNK, b"\0"), np.uint8)
            e = net.p["embed"][chunk]
            best = np.max([e[t : t + w].reshape(w * d) @ net.p["filters"] for t in range(0, quality_classifier.CHUNK - w + 1, quality_classifier.STRIDE)], axis=0) + net.p["f_bias"]
            outputs.append(np.tanh(np.maximum(best, 0) @ net.p["hidden"] + net.p["h_bias"]))
            at += quality_classifier.HOP
            if at + quality_classifier.CHUNK - quality_classifier.HOP >= len(text):
                break
        z = np.concatenate([np.mean(outputs, axis=0), np.max(outputs, axis=0)])
        assert abs(score - 1 / (1 + np.exp(-(z @ net.p["out"] + net.p["o_bias"][0])))) < 1e-4


def test_clashing_columns_come_back(spark):
    docs = spark.createDataFrame([(1, "some words", "a", 7, 8.0, "p")], "doc_id long, text string, _score string, _lang_pred int, score double, lang_pred string")
    got = language_id.identify(docs, (("en", "some words here"),), docs.columns).first().asDict()
    assert got["_score"] == "a" and got["_lang_pred"] == 7 and got["__score"] == 8.0 and got["__lang_pred"] == "p" and got["lang_pred"] == "en"
    got = quality_classifier.score_quality(docs, quality_classifier.Network(1), docs.columns).first().asDict()
    assert got["_score"] == "a" and got["__score"] == 8.0 and 0 < got["score"] < 1


def test_convolution_equals_a_plain_one():
    net = quality_classifier.Network(3)
    chunk = np.random.default_rng(1).integers(0, 256, (1, quality_classifier.CHUNK)).astype(np.uint8)
    e = net.p["embed"][chunk[0]]
    w, d = quality_classifier.WIDTH, quality_classifier.DIM
    best = np.max([e[t : t + w].reshape(w * d) @ net.p["filters"] for t in range(0, quality_classifier.CHUNK - w + 1, quality_classifier.STRIDE)], axis=0)
    assert np.allclose(net.pooled(chunk)[0][0], best + net.p["f_bias"], atol=1e-4)


def test_gradients_match_differences():
    net = quality_classifier.Network(5)
    g = np.random.default_rng(2)
    chunks, per_row, y = g.integers(0, 256, (5, quality_classifier.CHUNK)).astype(np.uint8), np.array([2, 3]), np.array([1.0, 0.0], np.float32)

    def loss():
        p, _ = net.combine(net.hidden(net.pooled(chunks)[0]), per_row)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    grads = net.gradients(chunks, per_row, y)
    for k, at in (("out", (3,)), ("hidden", (2, 5)), ("filters", (10, 4)), ("h_bias", (1,)), ("o_bias", (0,))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-2
        up = loss()
        net.p[k][at] = old - 1e-2
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-2 - grads[k][at]) < 2e-3 + 0.05 * abs(grads[k][at]), k


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        raw = (np.arange(n) % 255 + 1).astype(np.uint8)
        chunks, per = quality_classifier.chunk_matrix(raw, np.array([0, n]))
        seen = np.zeros(n, bool)
        for i, c in enumerate(chunks):
            a = i * quality_classifier.HOP
            assert (c[: max(0, min(n - a, 512))] == raw[a : a + 512]).all()
            seen[a : a + 512] = True
        assert seen.all() and per.tolist() == [len(chunks)]


def test_obfuscated_insults_are_seen():
    none = (np.zeros(0, np.uint64), np.zeros(0))
    words = np.sort(toxicity.hash_bytes([b"stupid", b"idiot"]))
    lexicon = {kind: none for kind in toxicity.KINDS} | {"word": (words, np.array([3.0, 3.0]))}

    def of(text, lexicon):
        x = toxicity.features(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), lexicon)[0]
        assert len(x) == toxicity.N_FEATURES
        return dict(zip(("word", 4, 5, 6, "spelled", "hits", "density", "weight", "greatest", "near", "near_rate", "upper", "shout", "sign", "odd", "n"), x, strict=True))

    for text in ("you 1d1ot here", "you i.d.i.o.t here", "you $tupid here", "you st.upid! here"):
        got = of(text, lexicon)
        assert got["spelled"] == got["hits"] == got["near"] == 1 and got["greatest"] == 3 and got["weight"] > 0, text
    assert all(of(text, lexicon)["odd"] > 0 for text in ("$tupid", "f***", "i.d.i.o.t", "1d1ot"))
    plain = of("a plain text, then stop! 2024", lexicon)
    assert plain["odd"] == plain["hits"] == 0 and plain["sign"] == 1 / 29
    texts = [b"a st*pid one", b"a good one"] * 8
    learned = toxicity.learn_lexicon(texts, np.array([1, 0] * 8))
    assert of("the st*pid thing", learned)["spelled"] == 1
    assert of("", lexicon)["n"] == 0


def test_isotonic_is_increasing_and_best():
    x, y = np.array([1.0, 2, 3, 4, 5, 5]), np.array([0.0, 1, 0, 1, 1, 0])
    knots, values = toxicity.isotonic(x, y, np.ones(6))
    assert (np.diff(values) >= 0).all() and knots.tolist() == [1, 3, 5] and np.allclose(values, [0, 0.5, 2 / 3])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet".replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(f"{DATA}/labels.parquet".replace("sf0.001", "sf0.01"))
    fold = lambda i, n: zlib.crc32(str(i).encode()) % n
    lang = language_id.identify(docs, language_id.learn(docs), ["doc_id", "lang"]).toPandas()
    lang = lang[[fold(i, 4) == 2 for i in lang.doc_id]]
    assert (lang.lang == lang.lang_pred).mean() > 0.95
    known = labels.toPandas().set_index("doc_id")
    tox = toxicity.score_toxicity(docs, toxicity.learn(docs, labels)).toPandas()
    tox = tox[[fold(i, 5) == 0 and i in known.index for i in tox.doc_id]]
    assert auc(tox.score.values, known.toxic[tox.doc_id].values) > 0.85
    net = quality_classifier.train(*sampling.labelled_texts(docs, labels, "quality", quality_classifier.held_out(3, 1), 300), steps=150)
    q = quality_classifier.score_quality(docs, net).toPandas()
    q = q[[fold(i, 3) == 1 and i in known.index for i in q.doc_id]]
    assert auc(q.score.values, known.quality[q.doc_id].values) > 0.9
