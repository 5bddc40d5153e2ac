import hashlib

import numpy as np

from memoria.llm import nearest, warc

VECTORS = "vec_id long, embedding array<float>, rank int"


def brute(rows, top=20):
    held = {i: np.array(v, np.float64) for i, v in rows}
    out = set()
    for q, v in held.items():
        if q % 20 == 0:
            scored = sorted((-float(v @ w), i) for i, w in held.items() if i != q)[:top]
            out |= {(q, k + 1, i) for k, (_, i) in enumerate(scored)}
    return out


def test_nearest_against_brute_force(spark):
    r = np.random.default_rng(2)
    vectors = r.normal(size=(1500, 24)).astype(np.float32)
    vectors[200:600] = vectors[200]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    found = nearest.nearest(spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS), block=400, query_block=30).collect()
    expected = brute(rows)
    got = {(x.query_id, x.rank, x.vec_id) for x in found}
    assert len(got) == len(found) == len(expected)
    pairs = lambda s: {(q, i) for q, _, i in s}
    assert len(pairs(got) & pairs(expected)) / len(expected) > 0.97
    for x in found:
        assert abs(x.score - vectors[x.query_id].astype(np.float64) @ vectors[x.vec_id].astype(np.float64)) < 1e-12
    hot = sorted((x.rank, x.vec_id) for x in found if x.query_id == 400)
    assert [v for _, v in hot][:5] == [200, 201, 202, 203, 204]


def test_vectors_that_take_no_part(spark):
    good = [(20 * k, [float(k + 1), 1.0, 0.5]) for k in range(3)]
    odd = [(7, None), (40, [0.0, 0.0, 0.0]), (60, [None, 1.0, 1.0]), (80, [float("nan"), 1.0, 1.0]), (100, [float("inf"), 1.0, 1.0]), (120, [1.0]), (None, [1.0, 2.0, 3.0])]
    odd = [x for x in odd if x[0] != 40] + [(140, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in good + good[:1] + odd], VECTORS)
    found = {(x.query_id, x.rank, x.vec_id) for x in nearest.nearest(frame).collect()}
    assert found == brute(good)
    assert nearest.nearest(frame.limit(0)).count() == 0


def test_anisotropic_loss_is_what_codes_minimise():
    x = np.random.default_rng(0).normal(size=(800, 48))
    q = nearest.AnisotropicQuantiser(x)
    assert q.eta > 1
    codes = q.encode(x)
    back = q.books[np.arange(q.parts), codes].reshape(len(x), -1)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def loss(c):
        r = x - q.books[np.arange(q.parts), c].reshape(len(x), -1)
        along = (r * unit).sum(1)
        return ((r**2).sum(1) + (q.eta - 1) * along**2).mean()

    assert loss(codes) <= loss(q.encode(x, plain=True)) + 1e-9
    assert np.corrcoef((back * x).sum(1), (x * x).sum(1))[0, 1] > 0.6
    packed, table = q.pack(codes), q.tables(x[:3])
    scan = sum(table[p][:, packed[p]] for p in range(len(packed)))
    assert np.allclose(scan, x[:3] @ back.T, atol=1e-4)


PAGES = "page_id long, url string, html string, refers_to int"


def test_archives_round_trip(spark, tmp_path):
    big, other = "a" * 1500, "é" * 600
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (3, "http://a/3", other), (4, "u", other), (5, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u\r\nX: y", ""), (None, "u", big), (2, "again", big)]
    frame = spark.createDataFrame([(i, u, h, 0) for i, u, h in rows], PAGES)
    manifest = warc.write_warc(frame, f"file://{tmp_path}/w", file_bytes=600, partitions=3)
    assert manifest.count() > 2
    found = warc.read_warc(manifest).collect()
    latest: dict[bytes, int] = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            latest[b] = max(i, latest.get(b, i))
    expected = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = latest.get(b) if i is not None and latest.get(b) != i else None
        expected.append((i or 0, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to else "response", to or 0))
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in found) == sorted(expected)
    again = warc.write_warc(frame, f"file://{tmp_path}/v", file_bytes=600, partitions=3)
    assert sorted(r.sha256 for r in manifest.collect()) == sorted(r.sha256 for r in again.collect())
    assert warc.read_warc(warc.write_warc(frame.limit(0), f"file://{tmp_path}/e")).count() == 0
