import math

import numpy as np
import pytest

from tests.llm import brute
from tracekit.llm import embed_dup as E


def rows_of():
    rng = np.random.default_rng(9)
    rows, i = [], 0
    for group in range(40):
        base = rng.normal(size=16)
        for _ in range(60 if group == 0 else rng.integers(1, 6)):
            away = rng.normal(size=16)
            rows.append((i, (base + rng.choice((0.02, 0.08, 0.12)) * away * np.linalg.norm(base) / 4 * 2).astype(np.float32).tolist(), int(group % 3)))
            i += 1
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] + [1.0] * 15, 1), (904, [], 1), (905, [None] * 16, 1),
             (906, rows[0][1], None), (907, rows[0][1][:8], 0), (908, rows[0][1][:8], 0), (909, rows[0][1], 0), (910, [3e38] * 16, 2), (911, [1e-38] * 16, 2), (912, [2.0], 1), (913, [1.0], 1)]
    return rows


def links(rows):
    def unit(v):
        if not v or None in v or not all(map(math.isfinite, v)) or not any(v):
            return None
        v = np.array(v, float) / max(map(abs, v))
        return v / np.sqrt((v * v).sum())

    units = {i: unit(v) for i, v, _ in rows}
    return [(a, b) for k, (a, _, x) in enumerate(rows) for b, _, y in rows[k + 1:]
            if x is not None and x == y and units[a] is not None and units[b] is not None and len(units[a]) == len(units[b])
            and float(units[a] @ units[b]) >= E.THRESHOLD]


@pytest.mark.parametrize("block, per_cell", [(512, 32), (16, 4)])
def test_equals_brute_force(lspark, monkeypatch, block, per_cell):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "PER_CELL", per_cell)
    rows = rows_of()
    vectors = lspark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, n_links long")
    got = {r["vec_id"]: r for r in E.near_vectors(vectors, target_recall=1.0).collect()}
    pairs = links(rows)
    n = {i: sum(i in p for p in pairs) for i, *_ in rows}
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * sum(n.values()) > 500
    assert all(r["n_links"] <= n[i] for i, r in got.items())
    want = brute.groups(n, pairs)
    assert sum(r["component_id"] != want[i] for i, r in got.items()) <= 1
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_recall_on_a_sample(lspark):
    vectors = lspark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("label < 2")
    got = E.near_vectors(vectors).agg({"n_links": "sum"}).first()[0]
    total = 0
    for label in (0, 1):
        x = np.array([r["embedding"] for r in vectors.where(f"label = {label}").collect()], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        total += int((x @ x.T >= E.THRESHOLD).sum()) - len(x)
    assert total > 20 and got >= 0.9 * total


def test_repeated_and_null_ids(lspark):
    v = [1.0, 2.0, 3.0, 4.0]
    vectors = lspark.createDataFrame([(None, v, 1), (None, v, 1), (7, v, 1), (7, v, 1), (None, v, 2)], "vec_id long, embedding array<double>, label long")
    got = sorted(map(repr, map(tuple, E.near_vectors(vectors).collect())))
    assert got == sorted(map(repr, [(None, 3, 7, False)] * 2 + [(7, 3, 7, True)] * 2 + [(None, 0, None, False)]))


def test_empty_table(lspark):
    assert E.near_vectors(lspark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_multi_sequence_order_is_the_sorted_order():
    rng = np.random.default_rng(4)
    index = E.Index(rng.normal(size=(9, 3)), rng.normal(size=(9, 3)), 0)
    x = rng.normal(size=(20, 6))
    d = E._distances(x[:, :3], index.first)[:, :, None] + E._distances(x[:, 3:], index.second)[:, None]
    assert (index.nearest(x, 17) == np.argsort(d.reshape(20, -1), 1, "stable")[:, :17]).all()
