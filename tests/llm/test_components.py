import random

from logquarry.llm.components import components


def plain(links):
    least = {x: x for link in links for x in link}
    for a, b in links:
        old, new = max(least[a], least[b]), min(least[a], least[b])
        least = {k: new if v == old else v for k, v in least.items()}
    return least


def test_random_links_paths_and_stars(spark):
    rnd = random.Random(8)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)]
    links += [(1000 + i, 1001 + i) for i in range(70)] + [(5000, i) for i in range(2000, 2060)] + [(3000, i) for i in range(3001, 3050)] + [(7, 7)]
    want = plain([x for x in links if x[0] != x[1]])
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want


def test_group_named_by_many_cells(spark):
    """Every node names the least members of many cells; the second round has no more links than there are names."""
    rnd = random.Random(9)
    links = []
    for _ in range(180):
        cell = rnd.sample(range(300), 40)
        links += [(x, min(cell)) for x in cell]
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.component for r in got.collect()} == {0} and got.count() == 300


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
