import pytest
from pyspark.sql import functions as F

from lexloom.functions.unicode import nfc, segment, tokens_phrase, word_count
from lexloom.operators import audit, corpus


def test_phrases(spark):
    df = spark.createDataFrame([(1, "école"), (2, "नमस्ते 안녕"), (3, None), (4, "我们今天去公园。好"), (5, "plain")], "id int, t string")
    col = F.col("t")
    assert {r.id: r.x for r in df.select("id", nfc(col).alias("x")).collect()} == {1: "école", 2: "नमस्ते 안녕", 3: None, 4: "我们今天去公园。好", 5: "plain"}
    uni = {r.id: r.x for r in df.select("id", tokens_phrase(col, "unicode").alias("x")).collect()}
    assert uni[1] == ["école"] and uni[2] == ["नमस्ते", "안녕"] and uni[3] == []
    zh = {r.id: r.x for r in df.select("id", tokens_phrase(col, "chinese", {"我们": 5, "今天": 5, "公园": 3, "去": 4, "我": 1}).alias("x")).collect()}
    assert zh[4] == ["我们", "今天", "去", "公园", "好"] and zh[3] == [] and zh[5] == list("plain")
    with pytest.raises(ValueError):
        tokens_phrase(col, "other")
    assert {r.id: r.x for r in df.select("id", word_count(col).alias("x")).collect()}[2] == 2


def test_segment_prefers_cheap_paths():
    assert segment("abcd", {"ab": 1.0, "cd": 1.0, "abc": 1.5}, 3) == ["ab", "cd"] and segment("", {}, 1) == [] and segment("xy z", {}, 1) == ["x", "y", "z"]


def test_recipe_grid_and_sets(spark):
    a, b = spark.range(20).withColumnRenamed("id", "k"), spark.range(100, 107).withColumnRenamed("id", "k")
    rows = corpus.recipe([(a, 3), (b, 2)], "k", 1).collect()
    assert len(rows) == 15 and {r.step for r in rows} == {0, 1, 2} and sorted(r.slot for r in rows if r.step == 0) == [0, 1, 2, 3, 4]
    g = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (None, "b")], "r int, m string")
    assert [tuple(r) for r in audit.grid(g, ["r", "m"]).collect()] == [(4, 3)]
    assert [tuple(r) for r in audit.set_relation(g, g.where("m = 'b'"), "m").collect()] == [(1, 1, 0)]
    d = audit.numeric_difference(spark.createDataFrame([(1, 0.5), (2, 1.0)], "k int, v double"), spark.createDataFrame([(1, 0.25), (3, 1.0)], "k int, v double"), ["k"], "v")
    assert [tuple(r) for r in d.collect()] == [(1, 1, 1, 0.25)]
