import random
from collections import Counter

import pytest

from tidewell.llm.packing import MAX_CAPACITY, _segments, best_fit_runs, most_placed, pack, pack_runs, superstep


def test_runs_fill_no_container_beyond_capacity():
    rng = random.Random(5)
    for _ in range(100):
        capacity = rng.choice([10, 50, 97])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 300))]
        table, n = best_fit_runs(list(Counter(items).items()), capacity)
        load, seen = Counter(), set()
        for size, rank, k, first, each in table.tolist():
            for i in range(k):
                load[first + i // each] += size
                assert (size, rank + i) not in seen
                seen.add((size, rank + i))
        assert len(seen) == len(items) and max(load.values()) <= capacity and len(load) == n
        # as full as sequential best-fit decreasing
        gaps = []
        for s in sorted(items, reverse=True):
            fit = [g for g in gaps if g >= s]
            if fit:
                g = min(fit)
                gaps.remove(g)
                gaps.append(g - s)
            else:
                gaps.append(capacity - s)
        assert n == len(gaps)


def test_cases(spark):
    df = spark.createDataFrame([(1, 30), (2, 250), (3, 0), (4, None), (5, 70), (5, 70), (6, 100), (7, -3)], "id long, n int").selectExpr("id", "n", "'x' AS size", "1 AS pid")
    rows = pack(df, "id", "n", 100).collect()
    parts = sorted((r["id"], r["part_no"], r["start"], r["size"]) for r in rows)
    assert parts == [(1, 1, 0, 30), (2, 1, 0, 100), (2, 2, 100, 100), (2, 3, 200, 50), (5, 1, 0, 70), (5, 1, 0, 70), (6, 1, 0, 100)]
    load = Counter()
    for r in rows:
        load[r["container_id"]] += r["size"]
    assert max(load.values()) <= 100 and len(load) == 6
    assert pack(df.where("n < 0"), "id", "n", 100).count() == 0


def test_placed_runs_stay_below_the_proven_bound():
    rng = random.Random(6)
    for capacity in (64, 1000, 8192):
        runs = [(s, rng.choice([1, 1, 2, 50, 10_000])) for s in range(1, capacity + 1) if rng.random() < 0.7]
        table, _ = best_fit_runs(runs, capacity)
        assert len(table) <= most_placed(len(runs), capacity) and table[:, 2].sum() == sum(n for _, n in runs)


def test_capacities_beyond_the_bound_are_refused(spark):
    df = spark.createDataFrame([(1, 30)], "id long, n int")
    for capacity in (0, -1, MAX_CAPACITY + 1):
        with pytest.raises(ValueError):
            pack_runs(df, "id", "n", capacity)
    with pytest.raises(ValueError):
        pack(df, "id", "n", 0)
    assert pack(df, "id", "n", MAX_CAPACITY + 1).count() == 1


def test_runs_place_the_same_items(spark):
    df = spark.createDataFrame([(1, 30), (2, 250), (5, 70), (5, 70), (7, -3)], "id long, n int")
    key = lambda rows: sorted((r["id"], r["part_no"], r["start"], r["size"]) for r in rows)
    assert key(pack_runs(df, "id", "n", 100).collect()) == key(pack(df, "id", "n", 100).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_sweep_over_partitions_is_one_sweep(spark, seed):
    """share 1: each gap takes one document at most, as a single stack over all sizes would give it."""
    rng = random.Random(seed)
    rows = [(rng.randint(1, 40), 0, i) for i in range(120)] + [(rng.randint(1, 40), 1, 1000 + i) for i in range(80)]
    left, placed, n = superstep(spark.createDataFrame(rows, "size int, kind int, ref long"), 7, 1.0)
    size = {ref: s for s, _, ref in rows}
    stack, want, open_gaps = [], Counter(), []
    for s, kind, ref in sorted(rows):
        if kind == 0:
            stack.append(s)
        elif stack:
            want[stack.pop(), s] += 1
        else:
            open_gaps.append(s)
    got = [tuple(r) for r in placed.collect()]
    assert Counter((size[d], size[g]) for d, g in got) == want and len(got) == n == len({d for d, _ in got}) == len({g for _, g in got})
    rest = Counter((r["kind"], r["size"]) for r in left.collect())
    assert rest == Counter([(0, s) for s in stack] + [(1, s) for s in open_gaps] + [(1, g - d) for (d, g), k in want.items() for _ in range(k) if g > d])


def test_ranks_meet_across_partitions():
    assert _segments({(0, 1): 3, (1, 2): 1, (1, 1): 2, (3, 2): 4, (4, 2): 5}) == [(0, 0, 1, 0, 1), (1, 0, 3, 0, 2), (0, 1, 3, 2, 2)]


def test_sweeps_fill_well_and_end(spark):
    rng = random.Random(9)
    cases = {"one size": [30] * 3000 + [71] * 50, "tiny": [rng.randint(1, 9) for _ in range(4000)], "mixed": [min(1000, int(rng.paretovariate(0.7) * 5)) for _ in range(3000)]}
    for name, sizes in cases.items():
        capacity = 1000 if name == "mixed" else 100
        rows = pack(spark.createDataFrame(list(enumerate(sizes)), "id long, n int"), "id", "n", capacity).collect()
        load = Counter()
        for r in rows:
            load[r["container_id"]] += r["size"]
        best = best_fit_runs(list(Counter(sizes).items()), capacity)[1]
        assert sorted(r["id"] for r in rows) == list(range(len(sizes))) and max(load.values()) <= capacity
        assert len(load) <= best * 1.02 + 1, (name, len(load), best)
