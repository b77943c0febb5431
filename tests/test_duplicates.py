import json

import pytest

from rowsieve.errors import InvalidInputError
from rowsieve.plans.duplicates import find_duplicates
from rowsieve.sources import rows as sources
from rowsieve.streaming.normalize import normalize_stream

SHEET = [
    ["Anton Markov", "anton.markov@gmail.com"], ["Markov Anton", "antonmarkov@gmail.com"], ["Марков Антон", "anton.markov+x@gmail.com"], ["Elena Petrova", "elena@mail.ru"], ["Petrova Elena Ivanovna", "elena@mail.ru"],
    ["Progress OOO", "contact@progress.ru"], ["OOO Progress", "contact@progress.ru"], ["John Smith", "123 Main Street, Springfield"], ["John Smith", "123 Main St, Springfield"], [None, ""], ["unrelated", "words only"],
    ["Project Apollo launch schedule overview"], ["launch schedule of Project Gemini revision"],
]


def frame(spark, rows=SHEET):
    return spark.createDataFrame(list(enumerate(rows)), "row_id bigint, cells array<string>")


def test_cascade(spark):
    found = find_duplicates(frame(spark))
    got = {(r.first, r.second): r.status for r in found.pairs.collect()}
    # Cells are the tokens of a row with bars, so words that change places in one are for the scores.
    assert {p for p, s in got.items() if s == "confirmed"} == {(1, 2)}
    assert got.get((7, 8)) == got.get((5, 6)) == "candidates"
    assert all(a < b for a, b in got) and not any(9 in p or 10 in p for p in got)
    exact = {x for p, s in got.items() if s == "confirmed" for x in p}
    assert not any(x in exact for p, s in got.items() if s == "candidates" for x in p)
    counters = {r.stage: r.n for r in found.counters.collect()}
    assert counters["exact_rows"] == len(exact) and counters["confirm"] >= 1
    again = {(r.first, r.second): r.status for r in find_duplicates(frame(spark).repartition(5)).pairs.collect()}
    assert again == got


def test_scorer_decides_the_undecided(spark):
    undecided = find_duplicates(frame(spark)).scored.where("route = 'neural'").count()
    yes = find_duplicates(frame(spark), scorer=lambda pairs: [1.0] * len(pairs))
    assert yes.candidates.count() == yes.scored.where("route in ('confirm', 'neural')").count()
    assert yes.scored.where("neural_confirm").count() == undecided > 0


def test_empty(spark):
    assert find_duplicates(frame(spark, [])).pairs.count() == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "request.json").write_text(json.dumps({"rows": [["a", None], None, ["b"]]}))
    rows = sources.from_json(spark, str(tmp_path / "request.json"))
    assert [tuple(r) for r in rows.orderBy("row_id").collect()] == [(0, ["a", None]), (1, []), (2, ["b"])]
    (tmp_path / "bad.json").write_text('{"rows": 3')
    with pytest.raises(InvalidInputError):
        sources.from_json(spark, str(tmp_path / "bad.json"))
    (tmp_path / "empty.json").write_text('{"rows": []}')
    assert sources.from_json(spark, str(tmp_path / "empty.json")).count() == 0
    table = spark.createDataFrame([(7, "x", 1.5)], "k int, name string, n double")
    assert sources.from_table(table, "k", ["name", "n"]).collect() == [(7, ["x", "1.5"])]
    with pytest.raises(InvalidInputError):
        sources.from_table(table, "k", ["absent"])
    pairs = spark.createDataFrame([(1, 2, "confirmed"), (3, 4, "candidates"), (1, 5, "candidates")], "first bigint, second bigint, status string")
    [answer] = sources.response(pairs).collect()
    assert json.loads(answer.value) == {"confirmed": [{"first": 1, "second": 2}], "candidates": [{"first": 1, "second": 5}, {"first": 3, "second": 4}]}
    assert json.loads(sources.response(pairs.limit(0)).collect()[0].value) == {"confirmed": [], "candidates": []}
    sources.write_pairs(pairs, str(tmp_path / "pairs"), "json")
    assert spark.read.json(str(tmp_path / "pairs")).count() == 3
    with pytest.raises(InvalidInputError):
        sources.write_pairs(pairs, str(tmp_path / "no"), "jdbc:x")
    sources.write_text(rows, str(tmp_path / "lines"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["", "a | ", "b"]
    assert [json.loads(r.value) for r in sources.to_json(pairs.limit(1)).collect()] == [{"status": "confirmed", "first": 1, "second": 2}]


def test_stream(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id bigint, cells array<string>").parquet(str(tmp_path / "in"))
    normalize_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = {r.row_id: r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[2] == "markov anton | antonmarkov@gmail.com" and 9 not in got
