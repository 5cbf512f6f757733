"""Small document tables with the awkward cases that every operator must handle."""

import random

WORDS = "the of and to in is that for with as was on be by this are from or an it at one two three four".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) + str(rng.randint(0, 30)) * (rng.random() < 0.3) for _ in range(n))


def awkward(seed: int = 0, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(n)]
    texts += [None, "", "   \n\t ", "a", "\n\n", texts[0], texts[0], texts[1] + " tail", "É" * 50 + "\n" + "x" * 30, "word " * 30_000, "\x1cfs\x85nel ünï 😀 ​ zero", "<|endoftext|> it's SHE'S don't ...!!"]
    texts += ["A common line of twenty characters\n" + prose(rng, 5) for _ in range(4)] + ["  a COMMON line of Twenty characters\t\n" + prose(rng, 5)]
    rows = [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[5], (None, "no id here", None, None, None), (None, texts[0], "en", "src0", 1)]


def documents(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, COLUMNS)
