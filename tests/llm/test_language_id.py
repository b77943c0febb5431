import random
import zlib

import numpy as np

from rowsieve.llm import language_id
from rowsieve.llm.language_id import ByteNet, LanguageConfig

SYLLABLES = {"en": "the and ing ion ent th ou".split(), "de": "der und sch ein cht ge ß".split(), "fr": "les eau oir ché que è ai".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize()


def test_held_out_accuracy(spark, tmp_path):
    rng, rows = random.Random(2), []
    for i in range(900):
        lang = rng.choice(["en"] * 4 + ["de", "fr"])
        rows.append((i, prose(rng, lang, rng.randint(8, 300)), lang, "clash"))
    rows += [(2000, None, "en", "x"), (2001, "", "de", "x"), (2002, "12 -- 34", "fr", "x"), (2003, prose(rng, "fr", 40_000), None, "x"), (None, prose(rng, "en", 50), "en", "x"), (1, rows[1][1], "en", "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string").write.parquet(f"{tmp_path}/documents.parquet")
    got = language_id.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(held) > 150 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (2000, 2001, 2002))
    assert by_id[2003].lang_pred == "fr" and by_id[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)


def test_empty_and_unlabelled(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    net = language_id.train(empty)
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    assert [tuple(r) for r in language_id.predict(docs, language_id.train(docs), ("doc_id",)).collect()] == [(1, "und", 0.0)]
    assert language_id.predict(empty, net, ("doc_id",)).count() == 0


def test_tables_are_the_convolution():
    cfg = LanguageConfig(window=32)
    net, rng = ByteNet(["a", "b"], cfg), np.random.default_rng(1)
    windows = rng.integers(0, 256, (7, 32)).astype(np.uint8)
    x = net.params["embed"][windows]
    pooled = [sum(x[:, j : j + 33 - w] @ net.params[f"conv{w}"][j] for j in range(w)).max(1) + net.params[f"bias{w}"] for w in cfg.widths]
    want = language_id.softmax(np.maximum(np.concatenate(pooled, 1), 0) @ net.params["out"] + net.params["out_bias"])
    assert np.allclose(net.probabilities(windows), want, atol=1e-5)


def test_gradients():
    cfg = LanguageConfig(window=24, embedding=4, filters=3)
    net, rng = ByteNet(["a", "b", "c"], cfg), np.random.default_rng(2)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    windows, labels = rng.integers(0, 256, (9, 24)).astype(np.uint8), rng.integers(0, 3, 9)
    grads = net._gradients(windows, labels)

    def loss():
        x, p = net.params["embed"][windows], net.params
        pooled = [sum(x[:, j : j + 25 - w] @ p[f"conv{w}"][j] for j in range(w)).max(1) + p[f"bias{w}"] for w in cfg.widths]
        return -np.log(language_id.softmax(np.maximum(np.concatenate(pooled, 1), 0) @ p["out"] + p["out_bias"])[np.arange(9), labels]).mean()

    for k, g in grads.items():
        at = tuple(rng.integers(0, n) for n in g.shape) if k != "embed" else (windows[0, 0], 1)
        net.params[k][at] += 1e-5
        up = loss()
        net.params[k][at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-4, k
        net.params[k][at] += 1e-5
