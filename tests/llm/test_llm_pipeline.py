from conftest import SF001
from llm_cases import documents, empty
from test_llm_minhash import brute as near_brute
from test_llm_packing import verify
from test_llm_suffix import brute as repeat_brute

from pyspark.sql import functions as F

import corpus_pipeline as C
from chunkmill.llm.common import stored


def test_stages_on_the_given_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, tables = docs.dtypes, [docs]
    for name, stage in C.STAGES[:-1]:
        tables.append(stored(stage(spark, tables[-1], SF001), name))
        assert tables[-1].dtypes == columns
    pairs = [sorted(map(tuple, t.select("doc_id", "text").collect())) for t in tables]
    assert pairs[1] == pairs[0]  # every text is in a learned language
    assert [d for d, _ in pairs[2]] == [d for d, _, c in near_brute(pairs[1], 5) if d == c] or {d for d, _ in pairs[2]} == {d for d, _, c in near_brute(pairs[1], 5) if d == c}
    removed = {d: (n, k) for d, n, k, _, _ in repeat_brute(pairs[2])}
    left = dict(pairs[3])
    assert set(left) == {d for d, (n, k) in removed.items() if not n or k < n}
    whole = dict(pairs[2])
    assert all(left[d] == whole[d] for d in left if removed[d][1] == 0)
    assert all(len(left[d].encode()) <= removed[d][0] - removed[d][1] for d in left)
    assert all(r.n_chars == len(r.text) for r in tables[3].collect())
    times = {}
    for d, t in pairs[4]:
        times[d] = times.get(d, 0) + 1
        assert t == left[d]
    assert set(times.values()) <= {1, 2}
    packed = C.STAGES[-1][1](spark, tables[4].dropDuplicates(["doc_id"]), SF001).collect()
    assert verify(packed, {d: left[d] for d in times}) < 0.02


def test_odd_rows_pass_every_stage(spark):
    docs, none = documents(spark), empty(spark).withColumn("n_chars", F.length("text"))
    for name, stage in C.STAGES:
        docs, none = stored(stage(spark, docs, SF001), name), stored(stage(spark, none, SF001), name)
        assert none.count() == 0 and docs.count() > 0
