from llm_cases import LONG, documents, empty

from chunkmill.llm import quality_ledger as Q


def test_measures_and_edges(spark):
    out = sorted((tuple(r) for r in Q.measure(documents(spark)).collect()), key=str)
    by = {r[0]: r[1:] for r in out}
    assert by[2] == by[3] == (0, 0, 0, 0, 0, 0)
    assert by[4] == (0, 0, 0, 0, 0, 0)
    assert by[7] == (300_000, 4 * 300_000, 0, 1, 0, 300_000)
    assert sum(r[0] == 5 for r in out) == 2 and len(LONG) == 1_500_000
    assert Q.ledger(empty(spark)).count() == 0


def test_repeats_symbols_lines(spark):
    rows = [(1, "a b c d a b c x"), (2, "a a a a"), (3, "x # y ** z|\nx # y ** z|\n\nx # y ** z| "), (4, "a b c\nd a b\tc d")]
    m = {r.doc_id: r for r in Q.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [m[i].n_repeat_words for i in (1, 2, 3, 4)] == [6, 4, 15, 8]
    assert (m[3].n_symbols, m[3].n_lines, m[3].n_dup_lines) == (12, 3, 1)


def test_policies_and_ablation(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good), (2, "too short"), (3, " ".join(["###"] * 60)), (4, good.replace("word", "#"))]
    led = Q.ledger(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    kept = lambda p: {r.doc_id for r in Q.apply_policy(led, p).collect() if r.kept}
    assert kept("base") == {1, 4} and kept("v1") == {1, 4} - ({4} if led.filter("doc_id = 4 and word_chars < 3 * n_words").count() else set())
    assert kept("v2") == {1}
    table = {r.rule: r for r in Q.ablation(led).collect()}
    assert table["too_few_words"].n_failed == 1 and table["many_symbols"].n_failed == 2
    for rule, r in table.items():
        bits = [x.failure_bits for x in led.collect()]
        assert r.n_only == sum(b == Q.bit(rule) for b in bits)
        assert r.n_kept_without == sum(b & Q.mask(Q.CURRENT) & ~Q.bit(rule) == 0 for b in bits)
