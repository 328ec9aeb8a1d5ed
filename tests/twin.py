"""Plain Python form of the similarity group-by, row by row, to compare with."""

import hashlib
import math


def distance(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def draw(seed, id_):
    return int(hashlib.md5(f"{seed}:{id_}".encode()).hexdigest()[:15], 16)


def first_fit(rows, eps):
    """Groups of (id, vector, ...) rows, which are taken by id."""
    groups = []
    for row in sorted(rows):
        for group in groups:
            if all(distance(row[1], member[1]) <= eps for member in group):
                group.append(row)
                break
        else:
            groups.append([row])
    return groups


def split(rows, k, seed, eps, window, apart):
    draws = {}
    for id_, vec, _ in rows:
        draws.setdefault(vec, []).append((draw(seed, id_), id_))
    ranked = sorted(draws, key=lambda v: (min(draws[v])[0], min(i for _, i in draws[v])))
    pivots = ranked[:k]
    if apart:
        pivots = []
        for p in ranked[:k]:
            if all(distance(p, q) > 4 * eps for q in pivots):
                pivots.append(p)
    children = {}
    for id_, vec, base in rows:
        gaps = [distance(vec, p) for p in pivots]
        near = gaps.index(min(gaps))
        for i, p in enumerate(pivots):
            if i != near:
                if window == "metric":
                    border = (gaps[i] - gaps[near]) / 2
                else:
                    border = (gaps[i] ** 2 - gaps[near] ** 2) / (2 * distance(p, pivots[near]))
                if border > eps:
                    continue
            children.setdefault(i, []).append((id_, vec, base + (near,)))
    return children


def similar(rows, o):
    """{(path, group id): ids} for (id, vector) rows."""
    result = {}

    def finish(path, rows):
        assigned = [int(x) for x in path.split(".")] if path else []
        for group in first_fit(rows, o.eps):
            if all(min(m[2][r] for m in group) == index for r, index in enumerate(assigned)):
                result[path, group[0][0]] = sorted(m[0] for m in group)

    def work(path, rows, done):
        if o.max_rounds is not None and done == o.max_rounds:
            return finish(path, rows)
        k = o.num_pivots
        if o.pivot_ratio is not None and done:
            k = max(1, math.floor(len(rows) * o.pivot_ratio))
        for apart in (False, True):
            children = split(rows, k, o.seed, o.eps, o.window, apart)
            largest = max(len(c) for c in children.values())
            copies = sum(len(c) for c in children.values())
            if largest <= o.threshold or (largest <= o.shrink * len(rows) and copies <= o.max_growth * len(rows)):
                break
        else:
            return finish(path, rows)
        for i, child in children.items():
            name = f"{path}.{i}" if path else str(i)
            if len(child) <= o.threshold:
                finish(name, child)
            else:
                work(name, child, done + 1)

    work("", [(i, v, ()) for i, v in rows], 0)
    return result
