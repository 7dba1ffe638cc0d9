"""The rules in a few lines of plain Python, to compare small cases with."""


def area(b):
    return max(0, b[2] - b[0]) * max(0, b[3] - b[1])


def both(a, b):
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    return w * h if w > 0 and h > 0 else 0


def iou(a, b):
    u = area(a) + area(b) - both(a, b)
    return both(a, b) / u if u else 0


def inside(a, b):
    return both(a, b) / area(a) if area(a) else 0


def suppressed(rows, over, contain):
    """``rows`` are (key, box) in processing order; returns surviving keys and the number of evictions."""
    alive, evictions = {}, 0
    for key, b in rows:
        stopped = any(
            iou(b, k) > over or (contain and area(b) <= area(k) and max(inside(b, k), inside(k, b)) >= 0.8) for k in alive.values()
        )
        if stopped:
            continue
        if contain:
            out = [n for n, k in alive.items() if area(k) < area(b) and max(inside(b, k), inside(k, b)) >= 0.8]
            evictions += len(out)
            for n in out:
                del alive[n]
        alive[key] = b
    return set(alive), evictions


def matched(pred, gold, at_least):
    """``pred``/``gold`` map position to box; returns {(pi, gi)}."""
    pairs = sorted(((iou(p, g), i, j) for i, p in pred.items() for j, g in gold.items()), reverse=True)
    out, used_p, used_g = set(), set(), set()
    for v, i, j in pairs:
        if v >= at_least and i not in used_p and j not in used_g:
            used_p.add(i)
            used_g.add(j)
            out.add((i, j))
    return out
