"""Mean shift against a plain loop over seeds, and planted modes."""

import numpy as np

from fusionframe.operators import meanshift

SCHEMA = "grid string, ix long, iy long, iz long, value double"


def plain(value, dims):
    """The cell that each seed ends in, and its steps."""
    at = lambda c: value.get(c, 0.0)

    def between(p):
        b = np.floor(p).astype(int)
        f = p - b
        return sum(at(tuple(b + [i, j, k])) * (f[0] if i else 1 - f[0]) * (f[1] if j else 1 - f[1]) * (f[2] if k else 1 - f[2]) for i in (0, 1) for j in (0, 1) for k in (0, 1))

    ends = {}
    for c in value:
        p, steps = np.array(c, float), 0
        while steps < max(dims):
            move, weight = np.zeros(3), 0.0
            for j in np.ndindex(5, 5, 5):
                o = np.array(j) - 2
                v = between(p + o)
                if v > 0:
                    w = v * np.exp(-(o @ o) / 2)
                    move += w * o
                    weight += w
            if weight == 0 or move @ move < 1e-6:
                break
            p, steps = p + move / weight, steps + 1
        ends[c] = (tuple(int(min(max(np.floor(x + 0.5), 0), n - 1)) for x, n in zip(p, dims)), steps)
    return ends


def test_mean_shift(spark):
    rng = np.random.default_rng(3)
    dims = (22, 20, 18)
    value = {}
    for mid in ((4, 4, 4), (15, 15, 9), (16, 5, 14)):
        for _ in range(40):
            c = tuple(int(x) for x in np.clip(np.round(rng.normal(mid, 1.1)), 0, np.array(dims) - 1))
            value[c] = value.get(c, 0.0) + 1.0
    rows = [("g", *c, v) for c, v in value.items()] + [("g", 0, 19, 0, 0.0), ("alone", 5, 5, 5, 2.0)]
    got = {(r.grid, r.ix, r.iy, r.iz): r for r in meanshift.mean_shift(spark.createDataFrame(rows, SCHEMA).repartition(4), dims).collect()}
    ends = plain(value, dims)
    assert len(got) == len(value) + 1 and got["alone", 5, 5, 5].steps == 0
    for c, (end, steps) in ends.items():
        seen = set()
        while end in ends and ends[end][0] != end and end not in seen:
            seen.add(end)
            end = ends[end][0]
        r = got["g", *c]
        assert (r.mx, r.my, r.mz) == end and r.steps == steps and r.converged == (steps < max(dims))
    modes = {(r.mx, r.my, r.mz) for r in got.values() if r.grid == "g"}
    assert all(min(np.linalg.norm(np.subtract(m, mid)) for m in modes) < 2 for mid in ((4, 4, 4), (15, 15, 9), (16, 5, 14)))
    assert meanshift.mean_shift(spark.createDataFrame(rows, SCHEMA).limit(0), dims).count() == 0
