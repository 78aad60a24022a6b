"""Small corpora with every odd case, and brute-force versions of the contracts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 5, size: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages, nulls, empty and very long texts, repeated rows, and an id that two texts share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(70)
    rows: list[tuple] = []
    for i in range(size):
        text = say(rng.randint(1, 160))
        if i % 7 == 3:
            text = f"{say(30)} {passage} {say(20)}"
        if i % 9 == 4 and rows:
            text = rows[rng.randrange(len(rows))][1]
        if i % 11 == 5 and rows:
            parts = (rows[rng.randrange(len(rows))][1] or "").split()
            if parts:
                parts[rng.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        rows.append((i * 3, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(text or "")))
    rows += [
        (1000, None, "en", "a", None),
        (1001, "", "de", None, 0),
        (1002, " \n\t ", None, "b", 4),
        (1003, say(5000), "en", "b", 1),
        (1004, "Grüße, 漢字 😀 <|endoftext|> End", "de", "a", 9),
        (1005, "one", "fr", "a", 3),
        (1006, "one", "fr", "a", 3),
        (1006, "one", "fr", "a", 3),
        (None, passage, "es", "a", 1),
        (None, None, None, None, None),
        (1007, "same " * 300, "en", "a", 1),
        (1008, f"{say(30)} {passage} first text of the id", "en", "a", 1),
        (1008, say(90), "de", "b", 1),
        (1009, "of a long word " + "x" * 100_000 + " and a long run" + " " * 150_000 + "of white space", "en", "b", 1),
    ]
    rows += [(1010, f"{rows[-2][1]} one word more", "en", "b", 1), (1011, rows[-2][1], "en", "a", 1)]
    return rows


def documents(spark, rows=None):
    """The rows as a DataFrame with extra columns whose names clash with what operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)
    clash = ("kept", "size", "mark", "id", "a", "b", "anchor", "score", "digest", "start", "length", "component_id", "target", "bucket", "offset", "taken", "unit", "label")
    return df.withColumns({c: F.lit("clash") for c in clash})


def split(text):
    return (text or "").encode().split()


class Union:
    def __init__(self):
        self.root = {}

    def find(self, x):
        self.root.setdefault(x, x)
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self.root[max(x, y)] = min(x, y)


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)])
