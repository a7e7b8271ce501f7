import numpy as np

from tessera.operators.allocation import hrp_numpy, quasi_diag, single_linkage


def naive_single_linkage(x):
    """Agglomerative single linkage on the rows of x (Euclidean), brute force."""
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    clusters = {i: [i] for i in range(n)}
    out = []
    nxt = n
    while len(clusters) > 1:
        best = None
        keys = sorted(clusters)
        for a_i, a in enumerate(keys):
            for b in keys[a_i + 1:]:
                dist = min(d[i, j] for i in clusters[a] for j in clusters[b])
                if best is None or dist < best[0]:
                    best = (dist, a, b)
        dist, a, b = best
        out.append((dist, len(clusters[a]) + len(clusters[b])))
        clusters[nxt] = clusters.pop(a) + clusters.pop(b)
        nxt += 1
    return out


def test_single_linkage_matches_brute_force():
    rng = np.random.default_rng(4)
    for n in [2, 3, 5, 8]:
        x = rng.normal(size=(n, n))
        link = single_linkage(x)
        exp = naive_single_linkage(x)
        assert np.allclose(link[:, 2], [e[0] for e in exp])
        assert list(link[:, 3].astype(int)) == [e[1] for e in exp]
        assert sorted(quasi_diag(link)) == list(range(n))


def test_hrp_weights_sum_to_one_and_positive():
    rng = np.random.default_rng(9)
    r = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    cov = np.cov(r, rowvar=False)
    corr = cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
    w = hrp_numpy(cov, corr)
    assert abs(w.sum() - 1) < 1e-12 and (w > 0).all()
