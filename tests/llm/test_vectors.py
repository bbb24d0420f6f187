"""The operators on embeddings against plain forms, on planted rows and on empty tables."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.llm.test_queries import named
from tidemark.llm import clustering, topk, vectors, whitening

SCHEMA = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("x", pa.string()), ("row", pa.string()), ("id", pa.string()), ("vector", pa.string())])


def make_rows():
    """Groups, copies of one vector, ties, repeated rows and ids, null and broken vectors, other lengths."""
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(k, [c + rng.gauss(0, 0.2) for c in centres[k % 6]]) for k in range(900)]
    rows += [(k, rows[7][1]) for k in range(900, 1250)]
    rows += [(k, [0.0] * 64) for k in (-50, 1300, 1350)]
    rows += [rows[0], rows[50], (50, rows[3][1]), (None, rows[100][1]), (None, rows[4][1])]
    broken = [None, [], [math.nan] * 64, [0.5] * 63 + [math.inf], [0.5] * 63 + [None], [1.0] * 3, [1e30] * 64]
    return rows + [(2000 + 50 * k, v) for k, v in enumerate(broken)]


def whole(rows, factor, dims=64):
    return [(i, [math.floor(factor * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) and abs(c) < 1e9 for c in v)]


def write(folder, rows):
    table = pa.Table.from_pylist([{"vec_id": i, "embedding": v, "label": 1, "x": "a", "row": "b", "id": "c", "vector": "d"} for i, v in rows], SCHEMA)
    pq.write_table(table, f"{folder}/embeddings.parquet", row_group_size=100)
    return str(folder)


@pytest.fixture(scope="module")
def planted():
    return make_rows()


@pytest.fixture(scope="module")
def folder(planted, tmp_path_factory):
    return write(tmp_path_factory.mktemp("spark-vectors"), planted)


@pytest.mark.parametrize("op", ["op11", "op12", "op13"])
def test_empty_tables(spark, tmp_path, op):
    assert named(op)(spark, write(tmp_path, [])).count() == 0
    assert named(op)(spark, write(tmp_path, [(1, None), (50, [math.nan])])).count() == 0


def test_op11(spark, folder, planted):
    x = whole(planted, 1024)
    limit = [(i, v) for i, v in planted if v is not None and len(v) == 64 and v[0] == 1e30]
    assert limit  # beyond a long: counted as not finite
    n, values = len(x), np.array([v for _, v in x], object)
    sums = values.sum(axis=0)
    centred = values * n - sums
    cov = np.array([[float(Fraction(int(centred[:, a] @ centred[:, b]), n**3)) for b in range(64)] for a in range(64)])
    spectrum = np.linalg.eigvalsh(cov)[::-1]
    found = {}
    for r in named("op11")(spark, folder).collect():
        found.setdefault(r["component"], []).append(r)
    assert sorted(found) == list(range(1, 9))
    wanted = sorted((repr(i), n, int((c * c).sum())) for (i, _), c in zip(x, centred))
    for part in found.values():
        assert sorted((repr(r["vec_id"]), r["n"], r["deviation"]) for r in part) == wanted
    by_deviation = {int((c * c).sum()): c for c in centred}  # rows of one deviation are copies here
    for component, part in found.items():
        e = spectrum[component - 1]
        assert all(abs(r["explained"] - e / np.trace(cov)) <= 1e-6 * e / np.trace(cov) and r["identity_error"] <= 1e-6 for r in part)
        scores = np.array([r["whitened"] for r in part])
        rows = np.array([by_deviation[r["deviation"]] for r in part]).astype(float) / n
        axis = np.linalg.lstsq(rows, scores * math.sqrt(e), rcond=None)[0]  # the one direction that gives these scores
        assert abs(np.linalg.norm(axis) - 1) < 1e-6 and np.abs(cov @ axis - e * axis).max() < 1e-6 * spectrum[0]
        assert np.abs(rows @ axis / math.sqrt(e) - scores).max() < 1e-6
        assert abs(scores.mean()) < 1e-9 and abs((scores**2).mean() - 1) < 1e-6


@pytest.mark.parametrize("high", [1, 2**10, 2**31, 2**61])
def test_bit_planes_give_exact_products(high):
    rng = random.Random(high)
    y = np.array([[rng.randint(0, high) for _ in range(4)] + [0] for _ in range(131)])
    planes = [max(1, int(v).bit_length()) for v in y.max(axis=0)]
    sums, pairs = whitening.products(y, planes)
    exact = y.astype(object)
    assert sums == exact.sum(axis=0).tolist()
    assert pairs == [[int(exact[:, a] @ exact[:, b]) for b in range(a, 5)] for a in range(5)]


def test_whitening_without_spread(spark):
    rows = spark.createDataFrame([(k, [1.0, 2.0 + k % 2, 3.0]) for k in range(10)], "vec_id bigint, embedding array<double>")
    found = whitening.whiten(rows).collect()
    assert len(found) == 30
    assert {(r["component"], round(r["explained"], 9), round(abs(r["whitened"]), 9)) for r in found} == {(1, 1.0, 1.0), (2, 0.0, 0.0), (3, 0.0, 0.0)}
    same = whitening.whiten(rows.limit(0).union(spark.createDataFrame([(1, [2.0, 2.0])] * 3, rows.schema))).collect()
    assert len(same) == 6 and {(r["deviation"], r["whitened"], r["identity_error"]) for r in same} == {(0, 0.0, 0.0)}


def lloyd(rows, k, rounds):
    rows = whole(rows, 256)
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(rows, key=key)[:k]]
    x = np.array([v for _, v in rows], np.int64)

    def assign():
        distance = np.array([((x - np.array(c)) ** 2).sum(axis=1) for c in centroids])
        return distance.argmin(axis=0), distance.min(axis=0)

    for _ in range(rounds):
        own, _ = assign()
        centroids = [[int(v) // int((own == c).sum()) for v in x[own == c].sum(axis=0)] if (own == c).any() else centroids[c] for c in range(len(centroids))]
    own, distance = assign()
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, int(c), int(d), int(distance[own == c].sum()), int(distance.sum()), shas[c]) for (i, _), c, d in zip(rows, own, distance)]


def test_op12(spark, folder, planted):
    got = named("op12")(spark, folder).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    want = lloyd(planted, 40, 5)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert len({w[1] for w in want}) > 6


def test_op12_with_fewer_rows_than_centroids(spark, tmp_path, planted):
    few = planted[:9] + planted[-7:]
    got = named("op12")(spark, write(tmp_path, few)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, lloyd(few, 40, 5)))


@pytest.mark.parametrize("largest", [1 << 20, 1 << 26])
def test_boxes_leave_out_no_nearest_centroid(largest):
    rng = np.random.default_rng(4)
    places = rng.integers(-largest, largest, (40, 64))
    centroids = clustering.Centroids(places.tolist(), largest)
    tight = 0
    for width in (1, largest // 8, largest):
        x = places[5] + rng.integers(-width, width, (100, 64)) // 2
        x = np.clip(x, -largest, largest)
        low, high = x.min(axis=0), x.max(axis=0)
        cluster, distance = centroids.nearest(x, low, high)
        exact = ((x[:, None] - places) ** 2).sum(axis=2)
        assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
        tight += len(centroids.candidates(low.astype(centroids.kind), high.astype(centroids.kind))) < 40
    assert tight


def best(rows, asks, k):
    rows, out = whole(rows, 256), []
    x = np.array([v for _, v in rows], np.int64)
    for q, (i, v) in enumerate(rows):
        if i is not None and asks(i):
            score = x @ x[q]
            order = sorted((j for j in range(len(rows)) if j != q), key=lambda j: (-score[j], rows[j][0] is None, rows[j][0]))[:k]
            out += [(i, r + 1, rows[j][0], int(score[j])) for r, j in enumerate(order)]
    return out


@pytest.mark.parametrize("least,spread", [(256, 64), (16, 100), (10_000, 1)])
def test_op13(spark, folder, planted, monkeypatch, least, spread):
    monkeypatch.setattr(topk, "LEAST_BLOCK", least)
    monkeypatch.setattr(topk, "SPREAD", spread)
    got = named("op13")(spark, folder).select("query_id", "rank", "vec_id", "score").collect()
    want = best(planted, lambda i: i % 50 == 0, 5)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) > 100


def test_op13_with_few_rows(spark, tmp_path):
    rows = [(0, [1.0] * 64), (1, [-1.0] * 64), (50, [0.0] * 64)]
    got = named("op13")(spark, write(tmp_path, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(best(rows, lambda i: i % 50 == 0, 5)) and len(got) == 4


@pytest.mark.parametrize("spread", [0.02, 0.3, 5.0])
@pytest.mark.parametrize("exact", [np.float64, np.int64])
def test_threshold_walk_stops_early_and_is_exact(spread, exact):
    rng = np.random.default_rng(9)
    x = np.floor(256 * (rng.normal(0, 1, (8, 16))[rng.integers(0, 8, 3000)] + rng.normal(0, spread, (3000, 16)))).astype(np.int64)
    ids = rng.permutation(3000)
    block = topk.Block(pa.array(ids), np.arange(3000), x, exact)
    queries = np.concatenate([x[:40], np.zeros((1, 16), np.int64)])
    own = block.places(np.append(np.arange(40), -7))
    for kth in (np.full(41, topk.NONE, exact), np.sort(queries @ x.T, axis=1)[:, -5].astype(exact)):
        for q, (places, scores) in enumerate(block.search(queries.astype(exact), own, kth, 5)):
            score = x @ queries[q]
            order = sorted((j for j in range(3000) if j != q and score[j] >= kth[q]), key=lambda j: (-score[j], ids[j]))[:5]
            if q == 40:
                order = sorted(range(3000), key=lambda j: ids[j])[:5]
            assert block.ids.take(pa.array(places)).to_pylist() == ids[order].tolist() and scores.tolist() == score[order].tolist()


def test_curve_visits_every_cell_in_single_steps(monkeypatch):
    monkeypatch.setattr(vectors, "AXES", 3)
    monkeypatch.setattr(vectors, "BITS", 3)
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    places = vectors.hilbert_places(cells)
    assert sorted(places) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(places)], axis=0)).sum(axis=1) == 1).all()
