import random

from strandflow.operators.components import connected_components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(80)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(120)]
    edges += [(None, 1), (7, None), (900, 900), (1, 0), (0, 1)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and dict(rows) == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_staged_tables_can_be_swept(spark):
    import os

    from strandflow.session import shared_dir, staged, sweep, unstaged

    df = staged(spark.range(3), "x")
    assert df.count() == 3
    path = df._staged_path
    assert os.path.isdir(path) and path.startswith(shared_dir(spark))
    unstaged(df)
    assert not os.path.exists(path)
    staged(spark.range(3), "y")
    assert sweep(spark) >= 1 and sweep(spark) == 0
