"""The parallel ordered fold against one write after the other."""

import numpy as np
import pytest

from mnemara.operators import ordered
from mnemara.sources.tables import vectors

DATA = "/root/testdata"


def plain(rows, tau):
    """Each write in turn against all current vectors of its space; of equal cosines the newest."""
    current, out = {}, {}
    for space, i, v in sorted(rows, key=lambda r: r[1]):
        u = np.asarray(v if v is not None else [], float)
        size = np.linalg.norm(u) if len(u) else 0.0
        best = None
        if size and np.isfinite(size):
            u = u / size
            near = [(round(float(x @ u), 9), j) for j, (x, _, _) in current.get(space, {}).items() if len(x) == len(u)]
            best = max([n for n in near if n[0] >= tau], default=None)
        slot, version = i, 1
        if best:
            _, slot, version = current[space].pop(best[1])
            version += 1
        if size and np.isfinite(size):
            current.setdefault(space, {})[i] = (u, slot, version)
        out[i] = ("superseded" if best else "created", slot, version)
    return out


def got(df, tau):
    return {r["id"]: (r["action"], r["slot"], r["version"]) for r in df.where(f"tau = {tau}").collect()}


def test_equals_the_loop(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((6, 5))
    rows = []
    for i in range(110):
        v = centre[rng.integers(0, 6)] + rng.standard_normal(5) * rng.choice([0.0, 0.1, 0.6])
        rows.append((int(rng.integers(0, 3)) if i % 40 else None, int(i * 7 % 111), v.tolist()))
    rows += [(0, 1000, [0.0] * 5), (0, 1001, None), (0, 1002, []), (0, 1003, [1.0, 2.0]), (0, 1004, [1.0, 2.0]), (0, 1005, [float("nan")] * 5)]
    df = spark.createDataFrame(rows, "space int, id long, v array<double>")
    out = ordered.supersede_fold(df, [0.8, 0.97])
    for tau in (0.8, 0.97):
        assert got(out, tau) == plain(rows, tau)
    for name, value in (("BLOCK", 16), ("MAX_BROADCAST_BLOCKS", 2)):
        monkeypatch.setattr(ordered, name, value)
    assert got(ordered.supersede_fold(df.coalesce(2), [0.8], near=4), 0.8) == plain(rows, 0.8)  # four nearest are often taken
    assert ordered.supersede_fold(df.where("false"), [0.8]).count() == 0


@pytest.mark.parametrize("dense", [0, 20, 10_000])
def test_batches_equal_the_loop(spark, monkeypatch, dense):
    """Many batches, lists that are taken whole, current vectors in one task and in blocks, by broadcast and by pairs of numbers."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((5, 4))
    v = [(centre[rng.integers(0, 5)] + rng.standard_normal(4) * rng.choice([0.0, 0.3, 1.0])).tolist() for _ in range(150)]
    rows = [("a" if i % 5 else None, i * 7 % 151, x) for i, x in enumerate(v)]
    for name, value in {"BATCH": 24, "BLOCK": 5, "DENSE": dense, "STEP": 3, "COMPACT": 1, "MAX_BROADCAST_BLOCKS": 4 if dense else 10**6}.items():
        monkeypatch.setattr(ordered, name, value)
    out = ordered.supersede_fold(spark.createDataFrame(rows, "space string, id long, v array<double>"), [0.6, 0.9], near=1).cache()
    for tau in (0.6, 0.9):
        assert got(out, tau) == plain(rows, tau)


def test_a_large_group_of_copies_settles_at_once(spark):
    rows = [(0, i, [1.0, 2.0, 3.0] if i % 3 else [float(i), 1.0, -5.0]) for i in range(900)]
    assert got(ordered.supersede_fold(spark.createDataFrame(rows, "space int, id long, v array<double>"), [0.99]), 0.99) == plain(rows, 0.99)


@pytest.mark.parametrize("tau", [0.3, 0.4])
def test_given_vectors_in_one_space(spark, tau):
    v = vectors(spark, f"{DATA}/sf0.001")
    rows = [(0, r["id"], r["v"]) for r in v.collect()]
    assert got(ordered.supersede_fold(v.selectExpr("0 as space", "id", "v"), [tau]), tau) == plain(rows, tau)


AXES = {"a1": [1, 0, 0, 0, 0, 0], "a2": [0.96, 0.2799, 0, 0, 0, 0], "n1": [0, 0, 1, 0, 0, 0], "n2": [0, 0, 0.97, 0.2431, 0, 0], "n3": [0, 0, 0.8817, 0.4718, 0, 0], "u": [0, 0, 0, 0, 1, 0]}
KINDS = {"a": ("A", "correction"), "n": ("N", "distinct"), "u": ("U", "unrelated")}


def labelled(spark):
    rows = [(0, i, KINDS[k[0]][0], "update" if k == "a2" else "original", KINDS[k[0]][1], [float(x) for x in v]) for i, (k, v) in enumerate(AXES.items())]
    return spark.createDataFrame(rows, "space int, id long, grp string, role string, kind string, v array<double>")


def test_study_of_the_published_set(spark):
    out = {r["tau"]: r.asDict() for r in ordered.study(labelled(spark), [0.95, 0.98]).collect()}
    pick = lambda r: tuple(r[k] for k in ("survivors", "correct", "false", "missed", "lost", "split", "ideal"))
    assert pick(out[0.95]) == (3, 1, 2, 0, 2, 0, 5) and pick(out[0.98]) == (6, 0, 0, 1, 0, 1, 5)
    (with_margin,) = ordered.study(labelled(spark), [0.95], margin=0.5).collect()
    assert with_margin["correct"] == 1 and with_margin["false"] == 2


def test_margin_equals_the_loop(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((60, 3)) + np.eye(3)[rng.integers(0, 3, 60)] * 3
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    current, slot, want = {}, {}, {}
    for i, x in enumerate(u):
        best = sorted(((round(float(y @ x), 9), j) for j, y in current.items()), reverse=True)[:2]
        if best and best[0][0] >= 0.9 and (len(best) == 1 or round(best[0][0] - best[1][0], 9) >= 0.01):
            slot[i] = slot[best[0][1]]
            del current[best[0][1]]
        else:
            slot[i] = i
        current[i], want[i] = x, slot[i]
    df = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(v)], "space int, id long, v array<double>")
    assert {r["id"]: r["slot"] for r in ordered.supersede_fold(df, [0.9], near=8, margin=0.01).collect()} == want
