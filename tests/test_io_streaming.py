import bz2
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions.text import tokens_model
from lexloom.plans import models
from lexloom.sources import readers, sinks
from lexloom.streaming import live


def test_lines_and_inventory(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("caf\xe9 \x93ok\x94\n\x81bad".encode("latin-1"))
    got = readers.read_lines(spark, {"x": str(tmp_path / "a.txt")}).select("source", "text").collect()
    assert [tuple(r) for r in got] == [("x", "one"), ("x", "two")]
    old = readers.read_lines(spark, {"y": str(tmp_path / "b.txt")}, "cp1252").select("text").collect()
    assert [r.text for r in old] == ["café “ok”", "bad"]
    assert readers.inventory(spark, {"x": str(tmp_path / "a.txt"), "y": str(tmp_path / "b.txt")}).count() == 2
    with pytest.raises(Exception):
        readers.read_lines(spark, {"x": str(tmp_path / "none.txt")}).count()


def test_other_sources(spark, tmp_path):
    with bz2.open(tmp_path / "t.tsv.bz2", "wt", encoding="utf-8") as f:
        f.write("id\ttext\n1\thallo wereld\n")
    assert readers.read_delimited(spark, str(tmp_path / "t.tsv.bz2"), "id int, text string", "\t", ["text"]).first().text == "hallo wereld"
    with pytest.raises(ValueError):
        readers.read_delimited(spark, str(tmp_path / "t.tsv.bz2"), "id int, text string", "\t", ["missing"])
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/en.txt", "a\nb\n")
        z.writestr("d/de.txt", "c\n")
    assert [r.text for r in readers.read_zip_lines(spark, str(tmp_path / "z.zip"), "en.txt").collect()] == ["a", "b"]
    np.arange(6, dtype=np.float32).tofile(tmp_path / "m.bin")
    assert [list(r.vector) for r in readers.read_matrix(spark, str(tmp_path / "m.bin"), 3).orderBy("row").collect()] == [[0, 1, 2], [3, 4, 5]]
    (tmp_path / "c.json").write_text(json.dumps([{"conversation_id": "k1", "utterances": [{"text": "hi"}, {"text": "yo"}]}, {"conversation_id": "k2", "utterances": []}]))
    keep = spark.createDataFrame([("k1",)], "conversation_id string")
    assert [(r.turn, r.text) for r in readers.read_conversations(spark, str(tmp_path / "c.json"), keep).collect()] == [(0, "hi"), (1, "yo")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\""), (2, None)], "id int, text string")
    sinks.write_csv(df, str(tmp_path / "c"), compression="gzip")
    assert readers.read_delimited(spark, str(tmp_path / "c"), "id int, text string").count() == 2
    with pytest.raises(Exception):
        sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_json(df, str(tmp_path / "j"))
    assert readers.read_json_lines(spark, str(tmp_path / "j"), "id int, text string").count() == 2
    sinks.write_text(df, "id", str(tmp_path / "t"))
    built = []
    for _ in range(2):
        t = sinks.cached_table(spark, str(tmp_path / "cache"), {"k": 1}, lambda: built.append(1) or df)
        assert t.count() == 2
    assert len(built) == 1


def test_ready_and_checks(spark):
    df = spark.createDataFrame([("wait for it", "en"), ("done ", "en"), ("你好", "zh"), (None, "en"), ("x" * 501, "en"), ("hm.", "xx")], "p string, l string")
    got = [(r[0], r[1]) for r in df.select(F.coalesce(live.ready(F.col("p"), F.col("l")), F.lit(False)), live.checked(F.col("p"), F.col("l"), ["en", "zh"])).collect()]
    assert got == [(False, "ok"), (True, "ok"), (True, "ok"), (False, "empty"), (True, "too_long"), (True, "unknown_language")]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("u1", "2024-01-01 10:00:00", "birds"), ("u1", "2024-01-01 10:00:05", "birds can"), ("u2", "2024-01-01 10:00:01", "boats can"), ("u1", "2024-01-01 12:30:00", "later")]
    (src / "a.json").write_text("\n".join(json.dumps({"user": u, "ts": t, "phrase": p}) for u, t, p in rows))
    stream = spark.readStream.schema("user string, ts timestamp, phrase string").json(str(src))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    counts = run(live.term_counts(stream, tokens_model(F.col("phrase"))), "terms", "complete")
    assert {(r.word, r.cnt) for r in counts} >= {("birds", 2), ("can", 2)}
    bursts = run(live.bursts(stream, "user", "ts", "phrase"), "bursts", "append")
    assert {(r.user, r.phrase, r.events) for r in bursts} == {("u1", "birds can", 2), ("u2", "boats can", 1)}  # the last one is still open
    batch = live.bursts(spark.read.schema("user string, ts timestamp, phrase string").json(str(src)), "user", "ts", "phrase")
    assert batch.count() == 3
    corpus = spark.createDataFrame([("birds can fly",), ("boats can float",)] * 3, "text string")
    m = models.build(corpus, tokens_model(F.col("text")), "kneser_ney", 3, 1)
    got = {r.phrase: r for r in run(live.score_stream(m, stream.select("phrase"), "phrase", tokens_model(F.col("phrase"))), "scored", "append")}
    assert got["birds can"].top[0].word == "fly" and got["birds can"].n == 3 and got["boats can"].top[0].word == "float"
    want = {(r.phrase, r["rank"]): r.word for r in models.predict(m, spark.createDataFrame([(p,) for p in got], "phrase string"), "phrase", tokens_model(F.col("phrase"))).collect()}
    assert all(x.word == want[p, i + 1] for p, r in got.items() for i, x in enumerate(r.top))


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")], "k string, seq int, phrase string")
    assert {(r.k, r.phrase) for r in live.latest(df, "k", "seq").collect()} == {("a", "new"), ("b", "only")}
