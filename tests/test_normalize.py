import time

import pytest
from pyspark.sql import functions as F

from rowsieve.config import NormalizeConfig
from rowsieve.operators.normalize import normalize_rows

#: A row or more for each rule.
GOLDEN = [
    (["  Полярная \t Сова "], "polarnaa sova"),
    (["Сова; Полярная"], "sova polarnaa"),
    (["GREY HERON", "g.heron+birds@gmail.com"], "grey heron | gheron@gmail.com"),
    (["heron.grey@googlemail.com", "heron.grey@example.net"], "herongrey@gmail.com | heron.grey@example.net"),
    (["he.ron+x@outlook.com", "HERON@hotmail.com", "h-eron@fastmail.com"], "heron@outlook.com | heron@hotmail.com | h-eron@fastmail.com"),
    (["box@поле.рф"], "box@xn--e1alid.xn--p1ai"),
    (["box+tag@example.net", "she said @ noon"], "box+tag@example.net | she said @ noon"),
    (["naïveté", "Ångström", "œuvre"], "naivete | angstrom | œuvre"),
    (["Größe", "łódź"], "große | łodz"),
    (["北极", "부산"], "bei ji | busan"),
    ([None, "", " \t ", "x"], None),
    (None, None),
    ([], None),
    (["ab"], None),
    (["a\u00a0b", "a \n b"], "a b | a b"),
    (["O`Hara", "D'Arcy-Hill", "(Smith)"], "ohara | darcy-hill | smith"),
    (["9 Quay Rd, Flat 2C", "£3,450.20", "7% off"], "9 quay rd flat 2c | 3450.20 | 7 off"),
    (["lot#77", "Lot: 77", "lot_77", "a & b", "x + y"], "lot#77 | lot 77 | lot_77 | a & b | x + y"),
    (["p::q", "p/q/r", "p=q"], "pq | p/q/r | pq"),
    (["+44 20 7946 0958"], "+442079460958"),
    (['The "Blue" Inn!'], "the blue inn"),
]
#: Facts about the order of kinds and about dates, places and fractions.
MORE = [
    ("03/04/2023", "2023-04-03"),
    ("31/02/2023", "2023-02-28"),
    ("12-31-2023", "2023-12-31"),
    ("2023-01-15T10:30", "2023-01-15"),
    ("2023-02-30T10:30", "2023-02-30t1030"),
    ("15-янв.-23", "2023-01-15"),
    ("15-янв-23", "15-anv-23"),
    ("(40.7128, -74.0060)", "40.7128,-74.0060"),
    ("lat: 40.7128, -74.0060", "40.7128,-74.0060"),
    ("40.7128, -74.0060", "40.7128, -74.0060"),
    ("1/2", "0.5"),
    ("50 %", "0.5"),
    ("½", "12"),
    ("https://www.Example.com/a/b/c?x=1#y", "example.com/a/b"),
    ("example.com/", "example.com"),
    ("a.b #3 x", "a.b "),
    ("8 (912) 345-67-89", "+79123456789"),
    ("12345678", "12345678"),
]


def normalized(spark, rows, cfg=NormalizeConfig()):
    df = spark.createDataFrame(list(enumerate(rows)), "row_id bigint, cells array<string>")
    return {r.row_id: r.value for r in normalize_rows(df, cfg).collect()}


def test_golden_rows(spark):
    got = normalized(spark, [cells for cells, _ in GOLDEN])
    assert [got.get(i) for i in range(len(GOLDEN))] == [want for _, want in GOLDEN]


def test_single_cells(spark):
    got = normalized(spark, [[cell] for cell, _ in MORE], NormalizeConfig(min_cell=0, min_row=0))
    assert [got.get(i) for i in range(len(MORE))] == [want for _, want in MORE]


def test_phone_region(spark):
    assert normalized(spark, [["234-567-8901"], ["(020) 7946 0958"]], NormalizeConfig(phone_region="US")) == {0: "+12345678901", 1: "020 7946 0958"}
    assert normalized(spark, [["(020) 7946 0958"], ["0044 20 7946 0958"]], NormalizeConfig(phone_region="GB")) == {0: "+442079460958", 1: "+442079460958"}


@pytest.mark.parametrize("n", [15_000])
def test_many_rows_are_quick(spark, n):
    rows = spark.range(n).select(F.col("id").alias("row_id"), F.array(F.concat(F.lit("Row "), "id"), F.concat(F.lit("Value "), "id")).alias("cells"))
    began = time.time()
    assert normalize_rows(rows).count() == n
    normalize_rows(rows).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 10


def test_long_cells(spark):
    n = 100_000
    cells = ["a." * n + "@" + "b." * n + "com", " " * n + "x" + " " * n + "y", "http://h" + "/" * n + "x/y", "." * n + "-" * n, "1" * n, "+" * n]
    got = normalized(spark, [[c] for c in cells], NormalizeConfig(min_cell=0, min_row=0))
    assert got[1] == "x y" and len(got) == len(cells)
