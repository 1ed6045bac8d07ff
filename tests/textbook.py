"""Plain one-pair versions of the scores, written from their definitions."""


def lcs(x, y):
    best = [0] * (len(y) + 1)
    for c in x:
        corner = 0
        for j, d in enumerate(y):
            above = best[j + 1]
            best[j + 1] = corner + 1 if c == d else max(above, best[j])
            corner = above
    return best[-1]


def ratio(x, y):
    total = len(x) + len(y)
    return 100.0 if not total else 100.0 - 100.0 * (total - 2 * lcs(x, y)) / total


def token_set(a, b):
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both = left & right
    x, y = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    s, lx, ly = len(" ".join(sorted(both))), len(x), len(y)
    if both and not (x and y):
        return 100.0
    gap = lx + ly - 2 * lcs(x, y)
    if not both:
        return 100.0 - 100.0 * gap / (lx + ly)
    return max(
        100.0 - 100.0 * gap / (2 * s + 2 + lx + ly),
        100.0 - 100.0 * (1 + lx) / (2 * s + 1 + lx),
        100.0 - 100.0 * (1 + ly) / (2 * s + 1 + ly),
    )


def partial(x, y):
    if not x or not y:
        return 100.0 if x == y else 0.0
    pairs = [(x, y)] if len(x) < len(y) else [(y, x)] if len(y) < len(x) else [(x, y), (y, x)]
    return max(
        ratio(s, t[max(0, i) : i + len(s)]) for s, t in pairs for i in range(1 - len(s), len(t))
    )


def weighted(x, y):
    if not x or not y:
        return 0.0
    ordered = [" ".join(sorted(t.split())) for t in (x, y)]
    lengths = max(len(x), len(y)) / min(len(x), len(y))
    if lengths < 1.5:
        return max(ratio(x, y), 0.95 * max(ratio(*ordered), token_set(x, y)))
    scale = 0.9 if lengths <= 8 else 0.6
    distinct = [" ".join(sorted(set(t.split()))) for t in (x, y)]
    by_tokens = 100.0 if set(x.split()) & set(y.split()) else max(partial(*ordered), partial(*distinct))
    return max(ratio(x, y), scale * partial(x, y), 0.95 * scale * by_tokens)
