"""Plain Python versions of the operators, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return WORD.findall(text or "")


def shingles(text, width=5):
    w = words(lower(text or ""))
    if not w:
        return set()
    if len(w) < width:
        return {tuple(w)}
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components(docs):
    """{id: (size, component)} for [(id, text)] with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    posted = {}
    for i in ids:
        for s in sets[i]:
            posted.setdefault(s, []).append(i)
    done = set()
    for members in posted.values():
        for x in range(len(members)):
            for y in range(x):
                pair = (members[y], members[x])
                if pair in done:
                    continue
                done.add(pair)
                a, b = sets[pair[0]], sets[pair[1]]
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    ra, rb = find(pair[0]), find(pair[1])
                    root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def later_lines(docs):
    """{(id, position)} of the lines that resemble an earlier one, for [(id, text)] with distinct ids."""
    seen, gone = [], set()
    posted = {}
    for i, text in sorted(docs):
        for p, line in enumerate((text or "").split("\n")):
            if not words(line):
                continue
            s = shingles(line)
            near = {k for g in s for k in posted.get(g, ())}
            for k in near:
                both = len(s & seen[k])
                if 4 * both >= 3 * (len(s) + len(seen[k]) - both):
                    gone.add((i, p))
                    break
            for g in s:
                posted.setdefault(g, []).append(len(seen))
            seen.append(s)
    return gone


def quality(text):
    w = words(text)
    n = len(w)
    windows = {}
    for i in range(n - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return n, sum(map(len, w)), symbols, dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def targets(sizes):
    """{source: target} by repeated resharing, for {source: size}."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = 1.5 * sum(sizes.values())
    fixed = {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        share = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 2 * sizes[s]]
        if not over:
            return fixed | {s: share * weight[s] for s in free}
        for s in over:
            fixed[s] = 2.0 * sizes[s]
