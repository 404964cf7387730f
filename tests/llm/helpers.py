"""Small tables with the awkward rows that every operator must survive."""

import hashlib

AWKWARD = [
    (1, "Anna went to the market and bought seven red apples for her mother today."),
    (2, None),
    (3, ""),
    (4, "   \t\n "),
    (5, "Anna went to the market and bought seven red apples for her mother today."),
    (5, "Anna went to the market and bought seven red apples for her mother today."),
    (6, "a"),
    (None, "Anna went to the market and bought seven red apples for her mother today."),
    (7, "¡Ñandú! 日本語 \U0001f600 mañana 123 456 <|endoftext|> don't  stop"),
    (8, "long " * 30_000),
    (-9, "minus"),
]


def docs(spark, rows=AWKWARD, **extra):
    """Documents with extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = ("cls", "grp", "n", "score", "runs", "items", "spans", "rid", "ids", "kept", "text_md5", "start", "n_tokens", "shingles", "anchor")
    return df.withColumns({c: F.lit("x") for c in clashing})


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def invented(rng, n, copies=0.3):
    """Rows of random words with exact copies, near copies and shared passages."""
    words = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for i in range(n):
        pick = rng.random()
        if rows and pick < copies / 2:
            text = rng.choice(rows)[1]
        elif rows and pick < copies:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        else:
            w = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 30, 120, 300]))]
            if rng.random() < 0.3:
                at, cut = rng.randint(0, len(w)), rng.randint(0, 30)
                w[at:at] = passage[cut : cut + rng.randint(20, 60)]
            text = " ".join(w) or " "
        rows.append((i * 3 % 1009, text))
    return rows
