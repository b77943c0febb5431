import random
import re

from rowsieve.llm import licenses


def plainly(text):
    text = re.sub(r"[^A-Za-z0-9\n]+", " ", text or "").lower()
    units = {" ".join(u.split()) for u in [*text.split("\n"), *re.split(r"\n ?\n", text), text]}
    out = []
    for u in units:
        words = u.split()
        mine = {f"{a} {b}" for a, b in zip(words, words[1:])}
        found = []
        for name, template in licenses.TEMPLATES:
            grams = set(licenses.template_bigrams(template))
            found.append((-2 * len(mine & grams) / (len(mine) + len(grams)), name))
        if mine and min(found)[0] <= -0.8:
            out.append(min(found))
    return len(out), ",".join(sorted({n for _, n in out})), min(out)[1] if out else None, round(-min(out)[0], 6) if out else None


def test_against_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "MIT", "\n\n", "word " * 50000]
    for _ in range(150):
        lines = [rng.choice(["Some line of prose here.", "--- ***", ""]) for _ in range(rng.randint(0, 4))]
        for _ in range(rng.randint(0, 2)):
            words = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(["", "x", "LICENSE\n"])
            lines.insert(rng.randint(0, len(lines)), " ".join(words) if rng.random() < 0.7 else "\n".join(words))
        texts.append("\n".join(lines))
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[9], "x"), (7, texts[7], "again")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string, unit string")).collect()
    want = sorted(str((k, *plainly(t))) for k, t, _ in rows)
    assert sorted(str((r.doc_id, r.n_units, r.licenses, r.best_license, r.best_score)) for r in got) == want
    assert sum(r.n_units > 0 for r in got) > 50
    assert licenses.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_marks_rule_out_no_match():
    groups = licenses._groups(licenses.TEMPLATES)
    chosen = set(licenses.marks(groups, 0.8))
    assert len(chosen) < 40
    for _, grams in groups:
        free = [g for g in grams if not chosen & set(g.split())]
        # The best unit without a mark has just these bigrams.
        assert 2 * len(free) / (len(free) + len(grams)) < 0.8
