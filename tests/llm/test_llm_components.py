import random

import pytest

from chunkmill.llm import components as C


def want(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    return {x: root(x) for x in parent}


LINKS = [(i, i + 1) for i in range(1000, 1100)] + [(5, 7), (7, 5), (3, 3), (None, 4)] + [(2000, 2000 + i) for i in range(1, 40)]


def rounds(monkeypatch):
    """Counts the tables that are written: each round writes one."""
    names = []
    real = C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: names.append(name) or real(df, name))
    return names


def test_a_task_that_has_all_links_ends_it(spark, monkeypatch):
    rnd = random.Random(1)
    links = LINKS + [(rnd.randrange(10 ** 6, 10 ** 6 + 800), rnd.randrange(10 ** 6, 10 ** 6 + 800)) for _ in range(500)]
    names = rounds(monkeypatch)
    out = {r.id: r.component_id for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == want([x for x in links if None not in x]) and len(names) == 2


@pytest.mark.parametrize("local", [7, 60])
def test_several_tasks(spark, monkeypatch, local):
    monkeypatch.setattr(C, "LOCAL", local)
    names = rounds(monkeypatch)
    out = {r.id: r.component_id for r in C.components(spark.createDataFrame(LINKS, "a long, b long")).collect()}
    assert out == want([x for x in LINKS if None not in x]) and len(names) > 2


def test_no_links(spark):
    assert C.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
