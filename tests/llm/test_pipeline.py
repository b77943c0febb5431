import random
import re

import pytest

import corpus_pipeline
from tests.llm.test_simhash import closed, index

SYLLABLES = {"en": "the and ing ion ent".split(), "de": "der und sch ein cht".split(), "fr": "les eau oir ché que".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(4), []
    for i in range(240):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(60, 150)))
        if i % 20 == 0:
            text += f' token = "{rng.getrandbits(160):040x}" here'
        rows.append((i, text, lang, f"s{i % 4}" if i % 9 else None, len(text), "kept"))
    rows += [(300 + i, rows[i][1], rows[i][2], "s1", rows[i][4], None) for i in range(30)]  # copies
    rows += [(5, *rows[5][1:]), (400, None, "en", "s2", None, "x"), (401, "", None, "s2", 0, "x"), (402, "123 456", "en", "s3", 7, "x"), (None, "les eau chéque " * 20, None, None, 300, "x"), (404, rows[3][1] * 400, "en", "s0", None, "long")]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, mix_shard string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_shard"], name
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        seen.append([tuple(r) for r in docs.collect()])
    identified, unique, clean, mixed = seen
    gone = {400, 401, 402}
    assert sorted(map(str, identified)) == sorted(str(r) for r in rows if r[0] not in gone)
    # One row of each component.
    near = [[j for j, b in enumerate(identified) if index(a[1], b[1]) >= 0.8] for a in identified]
    label, first = closed(len(near), near), {}
    for r, g in zip(identified, label):
        mine = (r[0] is None, r[0] or 0, r[1])
        first[g] = min(first.get(g, mine), mine)
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in unique) == sorted(first.values())
    # Secrets are masked, all else is as it was.
    by_id = {r[0]: r for r in unique}
    for r in clean:
        want = re.sub(r'token = "[0-9a-f]{40}', "[SECRET]", by_id[r[0]][1])
        assert r[1] == want and r[4] == (len(want)) and (r[2], r[3], r[5]) == (by_id[r[0]][2], by_id[r[0]][3], by_id[r[0]][5])
    assert len(clean) == len(unique) and sum("[SECRET]" in r[1] for r in clean) >= 10
    assert {str(r) for r in mixed} <= {str(r) for r in clean}
    # Each source's share of the words is near its weight, or three times what it has.
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert len(encoded) == len(mixed) and sorted(str(r.doc_id) for r in encoded) == sorted(str(r[0]) for r in mixed)


def test_run_and_empty(spark, folder, tmp_path):
    path, _ = folder
    assert corpus_pipeline.run(spark, path).count() > 100
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
