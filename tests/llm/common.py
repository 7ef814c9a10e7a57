from __future__ import annotations

import random

WORDS = [a + b + c for a in ("th", "er", "on", "an", "st") for b in ("a", "e", "i") for c in ("nd", "r", "ng", "ly")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def corpus(n: int = 60, seed: int = 1) -> list[tuple]:
    """Random texts, near and exact copies of some, a passage in several, and the odd cases."""
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.randrange(20, 200)) for _ in range(n)]
    passage = prose(rng, 60)
    for i in range(0, n, 4):
        words = texts[i].split(" ")
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    texts += [texts[0], texts[0].upper(), texts[1], texts[2] + " " + passage, passage + texts[3], passage]
    texts += [None, None, "", "", "   \n\t", "one", "One", "two words", "a b c d e", "A b c d e f", "é ü ß 漢字 😀", "prefix 漢字 " + passage, "x" * 400, "word " * 3000]
    rng.shuffle(texts)
    return [(i * 3 % (len(texts) * 3 + 1), t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None, "ü"]), len(t) if t is not None else None) for i, t in enumerate(texts)]


def with_oddities(rows: list[tuple]) -> list[tuple]:
    """Repeated rows, repeated ids with other texts, and null ids."""
    return [*rows, rows[0], rows[0], (rows[1][0], "another text of the same id", None, "a", 1), (None, "no id at all", "en", "a", 1), (None, None, None, None, None)]


def clashing(df, *names: str):
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    return df
