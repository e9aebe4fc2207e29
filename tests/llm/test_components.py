import random

import pytest

from brindle.llm.components import ONE_TASK, components


def brute(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return sorted((x, root(x)) for x in up)


@pytest.mark.parametrize("one_task", [ONE_TASK, 0])
def test_by_one_task_and_by_rounds(spark, one_task):
    """Chains, stars, cliques, repeated links and links to oneself; negative and very large numbers."""
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(2000 + i, 2000 + j) for i in range(12) for j in range(i)]
    links += [(rng.randrange(5000, 6000), rng.randrange(5000, 6000)) for _ in range(700)]
    links += [(-5, 7000), (1 << 62, -(1 << 62)), (3, 3), (8000, 8000), (0, 1), (1, 0)]
    rng.shuffle(links)
    got = components(spark.createDataFrame(links, "a long, b long").repartition(3), one_task=one_task).collect()
    assert sorted(map(tuple, got)) == brute(links)
    assert components(spark.createDataFrame([], "a long, b long"), one_task=one_task).count() == 0
