"""Plain versions of pipeline stages."""


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_of_groups(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i for i in ids if root(i) == i}


def holds(item, text, edits):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row) <= edits


def plain_leaks(texts, items, tolerance):
    out = set()
    for item in (t.lower().split() for t in items):
        edits = int(len(item) * tolerance)
        size = len(item) // (edits + 1)
        seeds = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)}
        for i, text in texts.items():
            words = text.lower().split()
            near = [k for k in range(len(words) - size + 1) if tuple(words[k : k + size]) in seeds]
            if near and holds(item, words[max(0, near[0] - 2 * len(item)) : near[-1] + 2 * len(item)], edits):
                out.add(i)
    return out
