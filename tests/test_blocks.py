"""Searches in blocks of points: same answers as brute force, from few rows sent."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthframe.operators import models as M
from hearthframe.operators import spatial as S
from hearthframe.operators import tree

from test_tree import frame, uneven


@pytest.fixture
def searches(monkeypatch):
    """The searches that are made."""
    made, plain = [], tree._descend
    monkeypatch.setattr(tree, "_descend", lambda *a: made.append(plain(*a)) or made[-1])
    return made


def test_long_lines_send_few_rows(spark, searches):
    rng = np.random.default_rng(1)
    at, seg = rng.uniform(0, 10_000, (2000, 2)), rng.uniform(0, 10_000, (600, 4))
    seg[:3, 2:] = seg[:3, :2]
    got = {r["pid"]: r["dist"] for r in S.nearest_line(frame(spark, [(i, *p) for i, p in enumerate(at)], "pid int, x double, y double"), frame(spark, seg, "ax double, ay double, bx double, by double"), "pid").collect()}
    d = seg[:, 2:] - seg[:, :2]
    k = np.clip(((at[:, None] - seg[:, :2]) * d).sum(2) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    want = np.hypot(*np.moveaxis(seg[:, :2] + k[:, :, None] * d - at[:, None], 2, 0)).min(1)
    assert [got[i] for i in range(2000)] == pytest.approx(want.tolist(), abs=1e-6)
    assert searches[0].others().count() <= 8 * 600  # each point or each lot of 32 would meet a share of all lines


def test_local_fits_share_rows(spark, searches):
    rng = np.random.default_rng(2)
    at = rng.uniform(0, 100, (2000, 2))
    z, y = rng.uniform(0, 1, 2000), rng.normal(0, 1, 2000)
    got = M.gwr(spark, frame(spark, [(i, *p, z[i], y[i]) for i, p in enumerate(at)], "rid int, x double, y double, z double, t double"), "t", ["z"], 20).toPandas().sort_values("rid")
    for i in range(0, 2000, 97):
        d = np.hypot(*(at - at[i]).T)
        h = np.sort(d)[20] + 1e-9
        w, x = np.where(d < h, (1 - (d / h) ** 2) ** 2, 0.0), np.c_[np.ones(2000), z]
        to = np.linalg.inv((x * w[:, None]).T @ x) @ (x * w[:, None]).T
        assert got.iloc[i][["b0", "b1", "c0", "c1"]].tolist() == pytest.approx([*(to @ y), *(to * to).sum(1)], rel=1e-6)
    assert searches[0].others().count() <= 5 * 2000


def test_blocks_are_split_where_much_is_near(spark, searches, monkeypatch):
    monkeypatch.setattr(tree, "MOST_NODES", 1)
    monkeypatch.setattr(tree, "BLOCK", 256)
    rng = np.random.default_rng(3)
    at, goal, rent = uneven(rng, 1000), uneven(rng, 1500), rng.integers(1, 100, 1500)
    d = np.hypot(at[:, None, 0] - goal[None, :, 0], at[:, None, 1] - goal[None, :, 1])
    pts = frame(spark, [(i, *p, 5.0 * (i % 21)) for i, p in enumerate(at)], "pid int, x double, y double, budget double")
    poi = frame(spark, [(i, *p, float(r)) for i, (p, r) in enumerate(zip(goal, rent))], "poi int, px double, py double, rent double")
    assert {r["pid"]: r["n"] for r in S.count_within(pts, poi, "pid", 0.3).collect()} == {i: int((row <= 0.3).sum()) for i, row in enumerate(d)}
    assert {r["pid"]: (r["poi"], r["dist"]) for r in S.nearest(pts, poi, "pid", "poi").collect()} == {i: (int(row.argmin()), pytest.approx(row.min())) for i, row in enumerate(d)}
    for few in (pts, pts.filter("pid < 60")):  # in blocks, and each by itself
        got = {r["pid"]: (r["dist"], r["n"]) for r in S.nearest_within_budget(few, poi, "pid").collect()}
        may = {i: d[i][rent <= 5.0 * (i % 21)] for i in got}
        assert got == {i: (pytest.approx(m.min(initial=np.inf)), len(m)) for i, m in may.items()}
    assert {s.split for s in searches} == {True, False} and any(len(s.sizes) == 3 for s in searches) and searches[-1].sizes == [1]


@pytest.fixture
def sent(monkeypatch):
    """What blocks are sent, by search."""
    made, plain = [], tree.Search.each
    monkeypatch.setattr(tree.Search, "each", lambda self, *a: made.append(self.others()) or plain(self, *a))
    return made


def test_a_line_is_sent_once_to_a_block(spark, sent):
    rng = np.random.default_rng(5)
    at, seg = rng.uniform(0, 1000, (9000, 2)), rng.uniform(0, 1000, (200, 4))
    got = S.nearest_line(frame(spark, [(i, *p) for i, p in enumerate(at)], "pid int, x double, y double"), frame(spark, seg, "ax double, ay double, bx double, by double"), "pid").toPandas().sort_values("pid")
    d = seg[:, 2:] - seg[:, :2]
    k = np.clip(((at[:, None] - seg[:, :2]) * d).sum(2) / (d * d).sum(1), 0, 1)
    assert got["dist"].tolist() == pytest.approx(np.hypot(*np.moveaxis(seg[:, :2] + k[:, :, None] * d - at[:, None], 2, 0)).min(1).tolist(), abs=1e-6)
    rows = sent[0].select("key", "ax", "ay", "bx", "by")
    assert rows.count() == rows.distinct().count()


def test_nodes_are_held_against_few_points_at_a_time(spark, sent, monkeypatch):
    monkeypatch.setattr(tree, "MOST_NODES", 16)
    rng = np.random.default_rng(6)
    at, y = rng.uniform(0, 100, (6000, 2)), rng.normal(0, 1, 6000)
    got = M.gwr(spark, frame(spark, [(i, *p, y[i]) for i, p in enumerate(at)], "rid int, x double, y double, t double"), "t", [], 8).toPandas().sort_values("rid")
    for i in range(0, 6000, 397):
        d = np.hypot(*(at - at[i]).T)
        h = np.sort(d)[8] + 1e-9
        w = np.where(d < h, (1 - (d / h) ** 2) ** 2, 0.0)
        assert got["fitted"].iloc[i] == pytest.approx((w * y).sum() / w.sum(), rel=1e-6)
    assert sent[0].count() <= 8 * 6000
    boxes, nodes, n = (np.sort(rng.uniform(0, 9, (m, 2, 2)), axis=2).reshape(m, 4) for m in (40, 90, 1))
    n = rng.integers(1, 5, 90)
    far = lambda b: np.hypot(*[np.maximum(nodes[:, i + 1] - b[i], b[i + 1] - nodes[:, i]) for i in (0, 2)])
    near = lambda b: np.hypot(*[np.maximum(0, np.maximum(nodes[:, i] - b[i + 1], b[i] - nodes[:, i + 1])) for i in (0, 2)])
    for k in (1, 30, 400):
        want = np.zeros(90, bool)
        for b in boxes:
            f, order = far(b), np.argsort(far(b))
            enough = np.searchsorted(np.cumsum(n[order]), k)
            want |= near(b) <= (f[order[enough]] if enough < 90 else np.inf)
        assert (tree.needed(boxes, nodes, n, k) == want).all()


def test_covariates_sort_the_points_once(spark, monkeypatch):
    from hearthframe.operators import places as P

    built, plain = [], tree.build
    monkeypatch.setattr(tree, "build", lambda rows, *a, **k: built.append(rows.columns) or plain(rows, *a, **k))
    rng = np.random.default_rng(7)
    at, poi = rng.uniform(0, 3000, (1500, 2)), rng.uniform(0, 3000, (300, 2))
    pts = frame(spark, [(i, *p) for i, p in enumerate(at)] + [(1500, None, 1.0), (1501, float("nan"), 2.0), (1502, 9e5, 0.0)], "pid int, x double, y double")
    cells = frame(spark, [(*p, float(i) if i % 7 else None) for i, p in enumerate(poi)], "cx double, cy double, value double")
    lines = frame(spark, [(0.0, 0.0, 3000.0, 3000.0)], "ax double, ay double, bx double, by double")
    got = {r["pid"]: r for r in P.add_covariates(pts, cells.select(cells["cx"].alias("px"), cells["cy"].alias("py")), lines, cells, "pid", (0.0, 0.0), 400.0, 200.0).collect()}
    d = np.hypot(at[:, None, 0] - poi[:, 0], at[:, None, 1] - poi[:, 1])
    value = np.where(np.arange(300) % 7, np.arange(300.0), np.nan)
    for i in range(1500):
        near = value[(d[i] <= 200) & ~np.isnan(value)]
        assert got[i]["n_poi"] == (d[i] <= 400).sum() and got[i]["mean_cell"] == (pytest.approx(near.mean()) if len(near) else None)
        assert got[i]["dist_line_km"] == pytest.approx(abs(at[i, 0] - at[i, 1]) / 2**0.5 / 1000)
    assert len(got) == 1503 and got[1500]["n_poi"] is got[1501]["dist_line_km"] is got[1501]["mean_cell"] is got[1502]["mean_cell"] is None and got[1502]["n_poi"] == 0
    assert sum("pid" in columns for columns in built) == 1
