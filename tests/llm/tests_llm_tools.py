"""Small helpers of these tests."""


def table(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def words(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_set(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_links(texts, percent=75):
    """All pairs of keys whose texts are alike, by comparing every pair."""
    sets = {k: shingle_set(t) for k, t in texts.items()}
    keys = sorted(k for k, s in sets.items() if s)
    return [
        (a, b)
        for i, a in enumerate(keys)
        for b in keys[i + 1 :]
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]


def components(keys, links):
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}
