"""Components by one task and by stars against each other and against a search."""

import random

from partita.operators import graph


def searched(links):
    near, out = {}, {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in sorted(near):
        todo = [] if start in out else [start]
        while todo:
            v = todo.pop()
            if v not in out:
                out[v] = start
                todo += near[v]
    return sorted(out.items())


def test_both_ways_equal_a_search(spark, monkeypatch):
    rng = random.Random(6)
    links = [(rng.randrange(-50, 400), rng.randrange(-50, 400)) for _ in range(260)] + [(7, 7), (1, 2), (2, 1), *((1000, i) for i in range(1001, 1060)), *((i, i + 1) for i in range(2000, 2040))]
    frame = spark.createDataFrame(links, "a long, b long")
    assert sorted(map(tuple, graph.components(frame).collect())) == searched(links)
    monkeypatch.setattr(graph, "TOGETHER", 10)
    assert sorted(map(tuple, graph.components(frame).collect())) == searched(links)


def test_no_links(spark):
    assert graph.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0
