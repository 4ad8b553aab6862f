"""Plain single-process versions that the operators are held against."""


def shingle_set(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def jaccard_components(rows, k=4, percent=85):
    """{(row index): (n, component id)} of (id, text) rows."""
    sets = [shingle_set(t, k) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j > i}:
            shared = len(s & sets[j])
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = find(i)
        if key is not None:
            least[r] = min(least.get(r, key), key)
    return [(rows[i][0], len(s), least.get(find(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def dropped_lines(rows, least=32, edits=2):
    """{(row index): numbers of dropped lines} of (id, text) rows, each pair of near lengths compared in full."""
    lines = [(key is None, key, r, n, line.strip(" \t\v\f\r")) for r, (key, text) in enumerate(rows)
             for n, line in enumerate((text or "").split("\n"))]
    lines = sorted((x for x in lines if len(x[4]) >= least), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(lines):
        for j in range(i):
            y = lines[j]
            if abs(len(x[4]) - len(y[4])) <= edits and find(i) != find(j) and (
                    x[4] == y[4] or edit_distance(x[4], y[4]) <= edits):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    out = {r: [] for r in range(len(rows))}
    for i, x in enumerate(lines):
        if find(i) != i:
            out[x[2]].append(x[3])
    return {r: sorted(v) for r, v in out.items()}


def ctw_log2(train, texts, depth):
    """log2 probability of each text (bytes) under the frozen context-tree model, node by node."""
    import math
    from functools import cache

    pad = b"\xff"
    counts = {}
    for t in train:
        line = pad * depth + t + pad
        for i in range(depth, len(line)):
            for d in range(depth + 1):
                for bit in range(8):
                    node = (line[i - d:i], (1 << bit) | (line[i] >> (8 - bit)))
                    counts.setdefault(node, [0, 0])[line[i] >> (7 - bit) & 1] += 1
    below = {}
    for s, n in counts:
        if s:
            below.setdefault((s[1:], n), []).append((s, n))

    def own(node):
        a, b = counts.get(node, (0, 0))
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def inner(node):
        return sum(weighted(c) for c in below.get(node, ()))

    @cache
    def weighted(node):
        if len(node[0]) == depth:
            return own(node)
        x, y = own(node), inner(node)
        return max(x, y) + math.log1p(math.exp(-abs(x - y))) - math.log(2)

    @cache
    def bit_probability(context, prefix, bit):
        p = None
        for d in range(depth, -1, -1):
            node = (context[depth - d:], prefix)
            c = counts.get(node, (0, 0))
            here = (c[bit] + .5) / (sum(c) + 1)
            if p is None:
                p = here
            else:
                beta = math.exp(min(700, own(node) - inner(node)))
                p = (beta * here + p) / (beta + 1)
        return p

    out = []
    for t in texts:
        line, total = pad * depth + t + pad, 0.0
        for i in range(depth, len(line)):
            for bit in range(8):
                total += math.log2(bit_probability(line[i - depth:i], (1 << bit) | (line[i] >> (8 - bit)), line[i] >> (7 - bit) & 1))
        out.append(total)
    return out


def targets(sizes, weights, cap=3.0):
    """{source: target}: the excess over the cap shared again until none is above."""
    total, done = float(sum(sizes.values())), {}
    while True:
        left = {s for s in sizes if s not in done}
        rest = total - sum(done.values())
        whole = sum(weights[s] for s in left)
        over = {s for s in left if rest * weights[s] / whole > cap * sizes[s]}
        if not over:
            return done | {s: rest * weights[s] / whole for s in left}
        done |= {s: cap * sizes[s] for s in over}
