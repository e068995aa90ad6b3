"""Components: each round goes on with the links between groups only."""

import random

from millrace.llm import graph


def expected(links):
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    return {x: root(x) for x in list(top)}


def test_links_inside_a_group_are_carried_no_further(spark, monkeypatch):
    rng = random.Random(4)
    dense = [(rng.randint(0, 99), rng.randint(0, 99)) for _ in range(1500)]
    path = [(200 + i, 201 + i) for i in range(40)]
    star = [(999, 300 + i) for i in range(30)]
    links = [(a, b) for a, b in dense + path + star if a != b]
    written, write = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: written.append(write(df)) or written[-1])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == expected(links)
    monkeypatch.undo()
    carried = [df for df in written if df.columns == ["a", "b"]]
    assert len(carried) > 1, "links are written anew each round"


def test_random_graphs(spark):
    rng = random.Random(5)
    for n, m in ((60, 40), (80, 90)):
        links = [(rng.randint(0, n), rng.randint(0, n)) for _ in range(m)]
        got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
        assert {r.node: r.component for r in got} == expected([x for x in links if x[0] != x[1]])
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
