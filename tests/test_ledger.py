"""The request ledger: equal requests once, resume, errors, pacing."""

import os
import time

import pandas as pd
import pytest

from chunkmill.operators.ledger import answer_requests, paced, pending, read_ledger, record_replies


def requests(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, request string")


def log_calls(path):
    """A model service that notes each request in a file (tasks run in other processes)."""
    def generate(prompts: pd.Series) -> pd.Series:
        for p in prompts:
            with open(f"{path}/calls", "a") as f:
                f.write(p + "\n")
            if p == "crash" and not os.path.exists(f"{path}/healed"):
                raise RuntimeError("down")
        return prompts.str.upper()

    return generate


def test_requests_are_answered_once(spark, tmp_dir):
    ledger, call = f"{tmp_dir}/ledger", log_calls(tmp_dir)
    reqs = requests(spark, ["a", "b", "a", "c"])
    got = {r.id: r.reply for r in answer_requests(spark, reqs, ledger, call, waves=3, backoff=0.0).collect()}
    assert got == {0: "A", 1: "B", 2: "A", 3: "C"}
    assert sorted(open(f"{tmp_dir}/calls").read().split()) == ["a", "b", "c"]
    more = requests(spark, ["b", "d", None])
    record_replies(spark.createDataFrame([(None, "nothing")], "request string, reply string"), ledger)
    assert [r.request for r in pending(more, read_ledger(spark, ledger)).collect()] == ["d"]
    got = {r.id: r.reply for r in answer_requests(spark, more, ledger, call, waves=2).collect()}
    assert got == {0: "B", 1: "D", 2: "nothing"}
    assert sorted(open(f"{tmp_dir}/calls").read().split()) == ["a", "b", "c", "d"]


def test_a_killed_run_goes_on(spark, tmp_dir):
    """A run that ends between two waves leaves its replies; the next one asks the rest only."""
    ledger, call = f"{tmp_dir}/ledger", log_calls(tmp_dir)
    reqs = requests(spark, [f"r{i}" for i in range(40)])
    waves = []

    def dies(prompts):
        return call(prompts)

    import chunkmill.operators.ledger as L

    real = L.generate_responses

    def stop_after_two(*args):
        if len(waves) == 2:
            raise KeyboardInterrupt
        waves.append(1)
        return real(*args)

    L.generate_responses = stop_after_two
    try:
        with pytest.raises(KeyboardInterrupt):
            answer_requests(spark, reqs, ledger, dies, waves=4)
    finally:
        L.generate_responses = real
    first = read_ledger(spark, ledger).count()
    assert 0 < first < 40
    assert answer_requests(spark, reqs, ledger, call, waves=4).where("reply is null").count() == 0
    calls = open(f"{tmp_dir}/calls").read().split()
    assert len(calls) == 40 == len(set(calls))


def test_errors_are_kept_and_asked_again(spark, tmp_dir):
    ledger, call = f"{tmp_dir}/ledger", log_calls(tmp_dir)
    row = answer_requests(spark, requests(spark, ["crash"]), ledger, call, retries=2, backoff=0.0).first()
    assert (row.reply, row.error, row.attempts) == (None, "down", 2)
    open(f"{tmp_dir}/healed", "w").close()
    row = answer_requests(spark, requests(spark, ["crash"]), ledger, call, retries=2, backoff=0.0).first()
    assert (row.reply, row.error, row.attempts) == ("CRASH", None, 3)


def test_pacing():
    call = paced(lambda s: s, 1000)
    t = time.monotonic()
    for _ in range(3):
        call(pd.Series(["x" * 400]))  # 200 tokens there and back
    assert 0.35 <= time.monotonic() - t < 2
    same = lambda s: s
    assert paced(same, None) is same
