import hashlib
import random
import re
import time

import numpy as np
import pytest

from rowsieve.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def fine(kind, x):
    digits = re.sub("[^0-9]", "", x)
    if kind == 1:
        return all(int(p) <= 255 for p in x.split("."))
    if kind == 2:
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def plainly(text):
    return [(k, *m.span()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if fine(k, m[0])]


def test_base_spans_against_brute_force():
    rng = random.Random(1)
    bits = ["a", "b.c", "@", "x.org", ".", "-", " ", "+1", "(555)", "4111 1111 1111 1111", "10.0.0.1", "256", "007", "12", "3", "é", "🙂", "\n", "%", "0000"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == plainly(text), repr(text)
    for _ in range(3000):
        text = "".join(rng.choice("aB.@-+1 9(") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plainly(text), repr(text)


def test_long_runs_take_linear_time():
    began = time.time()
    for unit in ("a", "1", "1.", "a@", "+1 ", "@", "1 ", "12345678 "):
        pii.find(unit * 100_000, pii.fitted())
    for word in ("1" + "a" * 1_000_000, "字1" + "字" * 1_000_000, "1a" * 300_000, "1.2.3" + "x" * 500_000 + "4"):
        pii.find(word, pii.fitted())
    assert time.time() - began < 60


def test_spellings_of_one_number_agree():
    field = pii.fitted()
    text = "call +1 (743) 555-3824 today or later (743) 555-3824 and again 743-555-3824. Part 555-9911 costs 12.50, order 743-555-0000 in 2021"
    base, every = pii.find(text, field)
    assert [text[s:e] for _, s, e in base] == ["+1 (743) 555-3824"]
    assert sorted(text[s:e] for k, s, e in set(every) - set(base)) == ["(743) 555-3824", "743-555-3824"]
    for clean in ("In 1999 about 350 people paid 12.50 for 3 of 4 parts", "numbers 555-3824 and 5553824 alone", "at 10:30 on 2024-05-06 (v1.2.3)", "@home 4111"):
        assert pii.find(clean, field) == ([], [])


def test_recall_and_precision_on_held_out_documents():
    rng, field, hit, wrong, missed = np.random.default_rng(99), pii.fitted(), 0, 0, 0
    for _ in range(300):
        text, truth = pii.generated(rng)
        base, every = pii.find(text, field)
        for k, s, e in set(every) - set(base):
            right = any(k == a and b < e and s < c for a, b, c in truth)
            hit, wrong = hit + right, wrong + (not right)
        # A later spelling of something that the patterns found.
        missed += sum(not any(s < c and b < e for _, s, e in every) for _, b, c in truth)
    assert hit > 100 and wrong < 0.05 * hit, (hit, wrong, missed)


def test_belief_propagation_is_exact_on_a_tree():
    field = pii.fitted()
    tokens = pii.tokens_of("x 743-555-3824 12 y 743-555-3824", [])
    assert len(tokens) == 3 and pii.skip_edges(tokens) == [(0, 2)]
    score = np.zeros((5, 5, 5))
    for a in range(5):
        for b in range(5):
            for c in range(5):
                s = sum(field.unary[t.features][:, y].sum() for t, y in zip(tokens, (a, b, c)))
                score[a, b, c] = s + field.chain[0, a] + field.chain[a, b] + field.chain[b, 0] + field.chain[0, c] + field.chain[c, 0] + field.skip[a, c]
    p = np.exp(score - score.max())
    p /= p.sum()
    got = field.marginals(tokens)
    assert got[0] == pytest.approx(p.sum((1, 2)), abs=1e-2) and got[2] == pytest.approx(p.sum((0, 1)), abs=1e-2)


def test_documents(spark):
    rows = [(1, "a@b.co and 10.0.0.1", "c"), (None, "🙂 +1 555 123 4567", "c"), (3, None, None), (3, "", "d"), (4, "a@b.co and 10.0.0.1", "again")]
    got = pii.scan(spark.createDataFrame(rows, "doc_id bigint, text string, spans string")).collect()
    want = [(k, [sum(s[0] == i for s in plainly(t or "")) for i in range(4)], hashlib.sha256(pii.joined(plainly(t or "")).encode()).hexdigest()) for k, t, _ in rows]
    assert [(r.doc_id, [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in got] == want
    assert got[1].spans == "phone:2:17"
    assert pii.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
