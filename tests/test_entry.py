import duckdb
import pytest

import __spark_entry__ as entry
from lexloom.queries import more

SMALL = "/root/testdata/sf0.001"


def test_contract(spark):
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found)
    df = entry.entry(spark)
    assert df.columns == ["case_id", "rank", "word", "p"] and df.count() > 0


@pytest.mark.parametrize("name", ["corpus_scan", "split_counts", "kn_top3", "compact_top3", "eval_rollup", "mcnemar", "exact_continuation", "constant_baseline", "latency_summary", "arm_selection", "vocab_ids", "choice_distractors", "split_reconstruction", "arm_difference", *sorted(more.ORACLE)])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("development", "training_lines", "reserved_hashes", "vocabulary", "candidate_scores", "blocked_terms", "timing", "events", "documents"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, SMALL).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols

    def rows(df):
        return sorted((tuple("" if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df[cols].astype(object).values.tolist()), key=str)

    assert rows(got) == rows(want)
