"""Single-machine versions of the algorithms, in plain Python."""

from collections import defaultdict, deque


def bfs(edges, vertices, root):
    out = defaultdict(list)
    for s, d, *_ in edges:
        out[s].append(d)
    level, todo = {root: 0}, deque([root])
    while todo:
        v = todo.popleft()
        for x in out[v]:
            if x not in level:
                level[x] = level[v] + 1
                todo.append(x)
    return {v: level.get(v, 4294967295) for v in vertices}


def sssp(edges, vertices, root):
    dist, changed = {root: 0}, True
    while changed:
        changed = False
        for s, d, w in edges:
            if s in dist and dist[s] + w < dist.get(d, float("inf")):
                dist[d] = dist[s] + w
                changed = True
    return {v: dist.get(v, 4294967295) for v in vertices}


def cc(edges, vertices):
    label, changed = {v: v for v in vertices}, True
    while changed:
        changed = False
        for s, d, *_ in edges:
            if label[s] < label[d]:
                label[d] = label[s]
                changed = True
    return label


def pagerank(edges, vertices, iterations):
    degree = defaultdict(int)
    for s, *_ in edges:
        degree[s] += 1
    spread = lambda r, v: r / degree[v] if degree[v] else r
    value = {v: spread(1.0, v) for v in vertices}
    for k in range(iterations):
        got = defaultdict(float)
        for s, d, *_ in edges:
            got[d] += value[s]
        rank = {v: 0.15 + 0.85 * got[v] for v in vertices}
        value = rank if k == iterations - 1 else {v: spread(r, v) for v, r in rank.items()}
    return value
