"""Small tables with every awkward case, and brute-force versions of the operators."""

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h string, node long, rid long, key string, text_md5 string"


def words(n, seed=0):
    rng = random.Random(seed)
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randint(0, 40)) for _ in range(n)]


def texts():
    base = words(400, 1)
    near = base[:]
    near[200] = "changed"
    line = "All rights reserved"
    out = [None, "", " \t\n", "one", "one two three", " ".join(base), " ".join(base), " ".join(near), " ".join(base[:390]), "Ääß é 日本 😀\n" * 3, "x" * 5000, "ab " * 2000, "\n".join(words(3000, 2))]
    out += [f"{line}\nunique {k} " + " ".join(words(30, 10 + k)) for k in range(12)] + [f"  {line.upper()}\r\nlast"]
    out += [" ".join(words(60, 5) + words(60, 100 + k)) for k in range(4)]
    return out


def documents(spark):
    """Extra columns have names that operators use inside; the last rows repeat a whole row, have null ids, and share an id."""
    rows = [(k, t, "en", f"s{k % 3}" if k % 5 else None, len(t or ""), 1, "h", 2, 3, "k", "m") for k, t in enumerate(texts())]
    rows += [rows[5], rows[5], (None, "one two three four five six", None, None, None, None, None, None, None, None, None), (3, "other text of an id that is there", "en", "s1", 1, 1, "h", 2, 3, "k", "m")]
    return spark.createDataFrame(rows, SCHEMA)


def plain(spark):
    """Ids are unique and not null."""
    return spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts())], "doc_id long, text string, lang string, source string, n_chars long")


def empty(spark):
    return documents(spark).limit(0)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def sha(b):
    return hashlib.sha256(b).hexdigest()


WHITE = " \t\n\x0b\x0c\r"


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0d]+", lower(t or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def component_ids(texts_by_id):
    sets = {k: shingles(t) for k, t in texts_by_id.items()}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(s), root(k)) for k, s in sets.items()}


def repeated_bytes(texts, length):
    """Kept bytes, and the number of maximal removed runs, of each text."""
    seen = {}
    data = [(t or "").encode() for t in texts]
    for k, b in enumerate(data):
        for at in range(len(b) - length + 1):
            seen.setdefault(b[at : at + length], []).append((k, at))
    gone = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for k, at in places:
                gone[k][at : at + length] = b"\x01" * length
    out = []
    for b, g in zip(data, gone):
        runs = len([m for m in re.finditer(b"\x01+", bytes(g))])
        out.append((bytes(x for x, d in zip(b, g) if not d), runs))
    return out
