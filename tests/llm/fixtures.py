"""Small corpora for brute-force comparison: planted repeats, nulls, empties, long texts, repeated rows."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["the", "of", "Éa", "naïve", "über", "x1", "a", "B", "word", "ſ", "K", "日本", "it's", "end."] + [f"w{i}" for i in range(60)]
    passage = [r.choice(vocabulary) for _ in range(50)]
    rows = []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 3, 8, 9, 12, 40, 90]))]
        if i % 4 == 0:
            at = r.randrange(len(w) + 1)
            w[at:at] = passage[: r.choice([34, 35, 36, 50])]
        text = "".join(x + r.choice([" ", "  ", "\n", "\t", "\x0b", "\n\n"]) for x in w)
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, rows[0][1]), (n + 4, rows[0][1].upper())]
    rows.append((n + 5, " ".join(r.choice(vocabulary) for _ in range(20000))))
    rows.append(rows[4])  # a repeated row
    return rows


def frame(spark, rows):
    """Documents whose further columns clash with names that operators use inside."""
    more = [(i, t, (i or 0) % 3, f"s{(i or 0) % 4}" if (i or 0) % 7 else None, "x") for i, t in rows]
    return spark.createDataFrame(more, "doc_id long, text string, key int, source string, size string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, key int, source string, size string")
