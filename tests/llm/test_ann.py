"""The searched share of the lists, and the recall where they are many more than PROBES."""

import numpy as np

from namewright.llm import ann


def test_probed_share_holds(spark, monkeypatch):
    assert all(ann.n_probes(n) >= n * 160 / 1347 for n in (10, 1347, 9042, 100_000))
    # 4,000 vectors in some 500 lists, of which 16 probes were 3 %.
    monkeypatch.setattr(ann, "PROBES", 16)
    monkeypatch.setattr(ann, "LIST_POINTS", 12)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] * 0.5 + rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = {}
    for r in ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -9
        recall.append(len(set(np.argsort(-s, kind="stable")[:20]) & found) / 20)
    assert len(got) == 200 and np.mean(recall) >= 0.9, np.mean(recall)
