"""Hard little tables, and plain versions of what the operators do."""

import collections
import random
import re

SPACES = " \t\n\x0b\x0c\r"
LONG = " ".join(f"word{k}" for k in range(5000))
LINE = "A line that several documents share"
TEXTS = [
    None, "", " \t\n", "one two three four five six seven", "ONE two three four five six  seven", "one\ntwo three four five six seven", "short", "short", "a b c d", "d c b a",
    LONG, LONG + " tail", f"{LINE}\nx\n  {LINE.lower()}\t\ny", f"{LINE.upper()}\nz", f"\n{LINE}\n", "naïve café — 日本語 👩‍👩‍👧 ½²", "%" * 300, "tab\there\r\nline", "\x00\x01 odd \U0010ffff",
]

#: Extra columns named like the operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, shard string, n long, ids string, taken string, _text string"


def rows(texts=TEXTS, seed=3):
    r = random.Random(seed)
    out = [(k if k % 7 else k * 3, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", "S", None]), None if t is None else len(t), "r", None, "x", 1, "i", None, "t") for k, t in enumerate(texts)]
    out += [out[3], out[6], (None, "a null id", "en", "s1", 9, None, 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return out


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def drop_lines(data):
    docs = collections.defaultdict(set)
    keys = lambda t: [lower(x.strip(SPACES)) for x in (t or "").split("\n")]
    for r in data:
        for k in keys(r[1]):
            if len(k) >= 20:
                docs[k].add(-1 if r[0] is None else r[0])
    out = []
    for r in data:
        lines, own = (r[1] or "").split("\n"), -1 if r[0] is None else r[0]
        kept = [x for x, k in zip(lines, keys(r[1]), strict=True) if not (len(docs[k]) >= 3 and own != max(docs[k]))]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(repr, out))
