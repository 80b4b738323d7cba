"""Small tables with everything that may go wrong in them, and plain-Python references."""

from __future__ import annotations

import random
import re

GAP = re.compile("[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, n_lines string, spans string"


def words(text):
    return [w for w in GAP.split(text or "") if w]


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    vocab = [f"w{rnd.randrange(10 ** 6)}" for _ in range(60)] + ["the", "of", "and", "to"] * 8
    out = [rnd.choice(vocab) for _ in range(n)]
    return "\n".join(" ".join(out[k:k + 12]) for k in range(0, n, 12))


def odd_documents(spark):
    """NULLs in every column, empty and blank texts, a very long one, repeated rows, near copies, clashing columns."""
    base = prose(1, 300)
    near = base.replace("the", "The", 3)
    rows = [(1, base), (2, near), (3, prose(2, 200)), (4, ""), (5, None), (6, " \n\t \n"), (7, "one two"), (8, "one two"), (9, "One  two"),
            (10, prose(3, 30000)), (11, prose(2, 200) + "\nmore words here"), (12, "\n".join(["same line again"] * 40)), (3, prose(2, 200)),
            (None, prose(4, 80)), (13, "a é 漢字 😀 password=abcdefgh1 " + prose(5, 60)), (14, "1234 5678 !!"), (15, prose(6, 40))]
    data = [(i, t, None if k % 5 == 4 else ["en", "fr"][k % 2], None if k % 6 == 5 else f"s{k % 4}", None, "x", "y", "z", "q") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
