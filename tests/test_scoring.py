import json
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from rowsieve.config import ScoreConfig
from rowsieve.errors import ScorerUnavailableError
from rowsieve.functions import similarity
from rowsieve.functions.latin import register
from rowsieve.operators import scoring
from rowsieve.sources.scorers import HttpPairScorer

@pytest.fixture(scope="module", autouse=True)
def functions(spark):
    register(spark)


def test_token_set_against_sets(spark):
    rng = random.Random(5)
    side = lambda: rng.choice([None, "", *[" ".join(rng.choice(["oak", "elm", "ash", "|", "fir", " ", "yew"]) for _ in range(rng.randint(1, 7))) for _ in range(6)]])
    cases = [(side(), side()) for _ in range(500)] + [("red  kite ", "kite red"), ("kite | red", "red kite | blue heron")]
    got = spark.createDataFrame(cases, "l string, r string").select("l", "r", similarity.token_set(F.col("l"), F.col("r")).alias("s")).collect()
    for r in got:
        a, b = ({w for w in (x or "").split() if w != "|"} for x in (r.l, r.r))
        assert r.s == pytest.approx(2 * len(a & b) / (len(a) + len(b)) if a & b else 0.0)


def test_levenshtein_cut_off_against_the_table(spark):
    def plainly(a, b):
        a, b = (x.replace("|", "").strip() for x in (a, b))
        if not a or not b:
            return 0.0
        longer = max(len(a), len(b))
        most = -(-longer * 7 // 10)
        if abs(len(a) - len(b)) > most:
            return 0.0
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
            if min(row) > most:
                return 0.0
        return 1 - row[-1] / longer

    rng = random.Random(1)
    cases = [("".join(rng.choice("abcd|") for _ in range(rng.randint(0, 9))), "".join(rng.choice("abce") for _ in range(rng.randint(0, 9)))) for _ in range(2000)]
    got = spark.createDataFrame(cases, "l string, r string").select("l", "r", similarity.levenshtein(F.col("l"), F.col("r")).alias("s")).collect()
    assert [r.s for r in got] == [pytest.approx(plainly(r.l, r.r)) for r in got]
    odd = [("", "", 0.0), ("pear", "", 0.0), (None, "pear", 0.0), ("pear", "pear", 1.0), ("pear", "peär", 0.75), ("🙂🙂🙂🙂", "🙂🙂🙂x", 0.75)]
    got = spark.createDataFrame(odd, "l string, r string, want double").select(similarity.levenshtein(F.col("l"), F.col("r")).alias("s"), "want").collect()
    assert [r.s for r in got] == [pytest.approx(r.want) for r in got]


def test_long_texts_score_in_little_time(spark):
    rng = random.Random(4)
    a, b = ("".join(rng.choice(x) for _ in range(10_000)) for x in ("abcdefgh", "efghijkl"))
    df = spark.createDataFrame([(a, b), (a, "x" + a[:-1]), (a, "z" * 10_000)], "left string, right string")
    scoring.scored(df).collect()
    began = time.time()
    assert [r.lev > 0.9 for r in scoring.scored(df).collect()] == [False, True, False]
    assert time.time() - began < 15


def test_jaro_winkler(spark):
    def plainly(a, b):
        reach, used, hits = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
        for i, c in enumerate(a):
            for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
                if j not in used and b[j] == c:
                    used.add(j)
                    hits.append(c)
                    break
        if not hits:
            return 0.0
        m, t = len(hits), sum(c != b[j] for c, j in zip(hits, sorted(used)))
        jaro = (m / len(a) + m / len(b) + (m - t / 2) / m) / 3
        same = 0
        while same < min(4, len(a), len(b)) and a[same] == b[same]:
            same += 1
        return jaro + same * 0.1 * (1 - jaro)

    rng = random.Random(2)
    cases = [("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 12))), "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 12)))) for _ in range(5000)]
    cases = [(a, b) for a, b in cases if a != b and abs(len(a) - len(b)) * 2 <= max(len(a), len(b))]
    odd = [(None, None, 1.0), ("", " \t", 1.0), (" Abc", "aBC ", 1.0), (None, "", 0.0), ("", "a", 0.0), ("ab", "abcdef", 0.0), ("abc", "xyz", 0.0)]
    rows = [(a, b, plainly(a, b)) for a, b in cases] + odd
    got = spark.createDataFrame(rows, "l string, r string, want double").select(similarity.jaro_winkler("l", "r").alias("s"), "want", "l", "r").collect()
    assert [r.s for r in got] == [pytest.approx(r.want) for r in got]


def test_scored_and_routed(spark):
    pairs = [(1, 2, "quiet harbour lane", "harbour quiet lane"), (1, 3, "quiet harbour", "stormy cape"), (2, 4, "alpha beta gamma delta", "alpha xxxxxx yyyyy zzzzz")]
    df = spark.createDataFrame(pairs, "first bigint, second bigint, left string, right string")
    rows = {(r.first, r.second): r for r in scoring.routed(scoring.scored(df)).collect()}
    assert set(rows) == {(1, 2), (1, 3), (2, 4)}
    assert rows[1, 3].token == 0 and rows[1, 3].route in ("drop", "hard_reject")
    assert rows[1, 2].route == "confirm" and rows[2, 4].route in ("drop", "hard_reject")
    extra = scoring.scored(df, extra={"same": (0.5, lambda a, b: (F.length(a) == F.length(b)).cast("double"))}).collect()
    assert len(extra) == 3 and all(r.weighted == pytest.approx(0.6 * r.token + 0.25 * r.lev + 0.1 * r.jw + 0.5 * r.same) for r in extra)


def failing(pairs):
    if any(a.startswith("bad") for a, _ in pairs):
        raise OSError("down")
    return [{"high": 0.9, "odd": 7.0, "none": None}.get(a, 0.5) for a, _ in pairs]


def test_neural_stage(spark):
    texts = [("high", "x"), ("odd", "x"), ("none", "x"), ("other", "x"), (" ", "x"), (None, "x"), ("high", "x"), ("bad", "x")]
    df = spark.createDataFrame([(i, *t, 30) for i, t in enumerate(texts)], "first bigint, left string, right string, max_len int").coalesce(1)
    cfg = ScoreConfig(neural_batch=1)
    got = {r.left: (r.neural, r.neural_confirm) for r in scoring.with_neural(df, failing, cfg).collect()}
    assert got == {"high": (0.9, True), "odd": (0.0, False), "none": (0.0, False), "other": (0.5, False), " ": (0.0, False), None: (0.0, False), "bad": (0.0, False)}
    scores = scoring.neural_scores(df, failing, cfg).cache()
    assert scores.count() == 7 and {r.left for r in scores.where("neural is null").collect()} == {"odd", "none", "bad"}
    # Scores of an earlier run are taken from there; failures were not remembered and are asked for again.
    again = {r.left: r.neural for r in scoring.neural_scores(df, lambda pairs: [0.125] * len(pairs), cfg, scores).collect()}
    assert again == {"high": 0.9, "other": 0.5, "odd": 0.125, "none": 0.125, "bad": 0.125, " ": 0.0, None: 0.0}
    assert scoring.score_pair(failing, " high ", "x") == 0.9 and scoring.score_pair(failing, None, "x") == scoring.score_pair(failing, "bad", "x") == 0.0
    assert {r.neural for r in scoring.with_neural(df, scoring.no_scorer).collect()} == {0.0}


class Answer(BaseHTTPRequestHandler):
    def do_POST(self):
        pairs = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        body = json.dumps([0.75 if p["left"] == p["right"] else 0.25 for p in pairs]).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_http_scorer(spark):
    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    scorer = HttpPairScorer(f"http://127.0.0.1:{server.server_port}/similarity", 5)
    assert scorer([("a", "a"), ("a", "b")]) == [0.75, 0.25]
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "left string, right string")
    assert {(r.right, r.neural) for r in scoring.neural_scores(df, scorer).collect()} == {("a", 0.75), ("b", 0.25)}
    server.shutdown()
    server.server_close()
    with pytest.raises(ScorerUnavailableError):
        scorer([("a", "a")])
