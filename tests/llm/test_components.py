"""Components of links against a plain union of sets."""

import random

import pytest

from fleetline.llm import components as c
from fleetline.llm.components import components


@pytest.mark.parametrize("within", [True, False])
def test_chains_hubs_repeats_and_loops(spark, monkeypatch, within):
    """With stars within tasks, and by the rounds across tasks alone."""
    if not within:
        monkeypatch.setattr(c, "_within_tasks", lambda edges: edges)
    rng = random.Random(0)
    links = [(i, i + 1) for i in range(100, 130)] + [(5, i) for i in range(200, 260)] + [(300, 300), (7, 8), (8, 7), (7, 8)]
    links += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)] + [(-4, 3)]
    rng.shuffle(links)
    least = {}

    def top(i):
        while least.setdefault(i, i) != i:
            i = least[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((top(a), top(b)))
            least[y] = x
    got = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert sorted(map(tuple, got)) == sorted((i, top(i)) for i in least)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
