import numpy as np
import pytest

from probeline.llm import vectors


def rows(seed=1, n=260, dim=6):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        base = rng.normal(size=dim)
        out.append((i, base.tolist(), int(rng.integers(0, 3)), "x"))
        if i % 3 == 0:
            out.append((1000 + i, (base + rng.normal(scale=0.15, size=dim)).tolist(), out[-1][2], "x"))
        if i % 10 == 0:
            out += [(2000 + i, base.tolist(), out[-1][2], "x"), (3000 + i, (3 * base).tolist(), out[-1][2], "x")]
    nan = float("nan")
    odd = [None, [], [0.0] * dim, [nan] * dim, [None] + [1.0] * (dim - 1), [float("inf")] * dim]
    out += [(5000 + i, v, 1, "x") for i, v in enumerate(odd)] + [(5100, out[0][1], None, "x"), (5200, [1.0, 2.0], 1, "x"), (5201, [2.0, 4.0], 1, "x")]
    return out


def brute(data, threshold=0.93):
    ok = [
        (i, np.array(v, float), label) for i, v, label, _ in data
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)
    ]
    near = {i: set() for i, *_ in data}
    for a, (i, v, x) in enumerate(ok):
        for j, w, y in ok[a + 1 :]:
            if x == y and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold:
                near[i].add(j)
                near[j].add(i)
    place = {}
    for i in sorted(near):
        todo = [i] if i not in place else []
        while todo:
            x = todo.pop()
            if x not in place:
                place[x] = i
                todo += near[x]
    return {i: (len(near[i]), place[i], place[i] == i) for i in near}


@pytest.mark.parametrize(("cell", "block"), [(2000, 2048), (10, 2048), (25, 7)])
def test_links_as_by_all_pairs(spark, cell, block):
    data = rows()
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, cid string").repartition(5)
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(table, cell=cell, block=block).collect()}
    assert found == brute(data)


def test_visits_lose_no_partner():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(600, 5))
    centres = vectors.spherical_kmeans(points, 12)
    home, row, cell = vectors.visits(points, centres, 0.9)
    met = set(zip(row.tolist(), cell.tolist(), strict=True))
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    for i, j in np.argwhere(np.triu(unit @ unit.T >= 0.9, 1)):
        low = min(home[i], home[j])
        assert (i, low) in met and (j, low) in met
    assert len(met) < 600 * 12 / 2


def test_empty_and_repeated(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vectors.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    table = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (3, None, None)], kind)
    found = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(table).collect() if r["vec_id"])
    assert found == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_a_large_group_is_linked_without_its_pairs(spark):
    rng = np.random.default_rng(6)
    data = [(i, (np.eye(8)[0] + rng.normal(scale=0.02, size=8)).tolist(), 1, "x") for i in range(1500)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, x string")
    found = vectors.near_duplicates(table, block=200).collect()
    assert {(r["n_links"], r["component_id"]) for r in found} == {(1499, 0)}


def test_extreme_magnitudes(spark):
    base = [1.0, 2.0, -3.0, 0.5]
    rows = [(i, 1, [x * 10.0**e for x in base]) for i, e in enumerate((0, -200, 200, -300, 300, 307))] + [(9, 1, [-x for x in base]), (10, 1, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    assert found == {**{i: (5, 0) for i in range(6)}, 9: (0, 9), 10: (0, 10)}
