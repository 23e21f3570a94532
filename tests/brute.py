"""Plain numpy versions used to check the distributed operators."""

import numpy as np


def dist(x, y, metric="euclidean"):
    if metric == "manhattan":
        return np.abs(x[:, None] - y[None]).sum(-1)
    if metric == "cosine":
        u = x / np.linalg.norm(x, axis=1)[:, None]
        w = y / np.linalg.norm(y, axis=1)[:, None]
        return 1 - u @ w.T
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))


def components(n, edges):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def dbscan(x, eps, least, metric="euclidean"):
    near = dist(x, x, metric) <= eps
    np.fill_diagonal(near, True)
    core = near.sum(1) >= least
    edges = [(i, j) for i in range(len(x)) for j in range(i) if near[i, j] and core[i] and core[j]]
    root = components(len(x), edges)
    order = {r: i + 1 for i, r in enumerate(sorted({root[i] for i in range(len(x)) if core[i]}))}
    label = np.full(len(x), -1)
    for i in range(len(x)):
        if core[i]:
            label[i] = order[root[i]]
    for i in range(len(x)):
        if not core[i]:
            owners = [label[j] for j in range(len(x)) if near[i, j] and core[j]]
            if owners:
                label[i] = min(owners)
    return label, core


def silhouette(d, label):
    out = np.zeros(len(label))
    for i, mine in enumerate(label):
        same = label == mine
        if same.sum() == 1:
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, label == o].mean() for o in set(label) if o != mine)
        out[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return out


def tree(x, linkage, metric, weights=None):
    """Merges (a, b, height, size) one pair at a time."""
    d = dist(x, x, metric)
    n = len(x)
    s = np.ones(n) if weights is None else np.asarray(weights, float).copy()
    if linkage == "ward":
        d = d * d * 2 * s[:, None] * s[None] / (s[:, None] + s[None])
    np.fill_diagonal(d, np.inf)
    out = []
    for _ in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        h = d[i, j]
        out.append((i, j, np.sqrt(h) if linkage == "ward" else h, s[i] + s[j]))
        if linkage == "single":
            r = np.minimum(d[i], d[j])
        elif linkage == "complete":
            r = np.maximum(d[i], d[j])
        elif linkage == "average":
            r = (s[i] * d[i] + s[j] * d[j]) / (s[i] + s[j])
        else:
            r = ((s[i] + s) * d[i] + (s[j] + s) * d[j] - s * h) / (s[i] + s[j] + s)
        d[i], d[:, i] = r, r
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        s[i] += s[j]
    return out


def em(x, means, iters, tol=1e-6):
    """EM with the same regularisation, on one machine."""
    n, dim = x.shape
    k = len(means)
    means = means.copy()
    cov = np.array([0.5 * np.cov(x.T) + 0.1 * np.eye(dim)] * k)
    w, before = np.ones(k) / k, -np.inf
    for step in range(iters):
        logs = np.empty((n, k))
        for j in range(k):
            reg = cov[j] + 0.01 * np.eye(dim)
            low = np.linalg.cholesky(reg)
            z = np.linalg.solve(low, (x - means[j]).T).T
            far = np.clip((z * z).sum(1), 0, 700)
            logs[:, j] = np.log(w[j] + 1e-10) - 0.5 * (dim * np.log(2 * np.pi) + 2 * np.log(np.diag(low)).sum() + far)
        top = logs.max(1, keepdims=True)
        r = np.exp(logs - top)
        total = r.sum(1, keepdims=True)
        r = r / (total + 1e-10)
        ll = float((top + np.log(total + 1e-10)).sum())
        nk = np.maximum(r.sum(0), 1e-10)
        w = nk / n
        means = (r.T @ x) / nk[:, None]
        for j in range(k):
            d = x - means[j]
            cov[j] = (r[:, j:j + 1] * d).T @ d / nk[j] + max(0.01, 0.1 / nk[j]) * np.eye(dim)
        if abs(ll - before) < tol:
            break
        before = ll
    return means, r, ll, step + 1
