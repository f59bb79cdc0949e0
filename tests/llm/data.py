"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, extra clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("." if rng.random() < 0.08 else "") for _ in range(n)) + "."


def rows(seed=3, n=60):
    rng = random.Random(seed)
    out = [(i, prose(rng, rng.randrange(60, 300), 4000), "en", f"s{i % 5}" if i % 11 else None, 0) for i in range(n)]
    base = out[0][1].split()
    near = base.copy()
    near[10] = "changed"
    passage = prose(rng, 40, 4000)
    out += [
        (n, None, None, None, None),
        (n + 1, "", "en", "s1", 0),
        (n + 2, " \t\n", "en", "s1", 0),
        (n + 3, out[1][1], "en", "s2", 0),
        (n + 4, out[1][1].replace(" ", "\n ", 3), "en", "s2", 0),
        (n + 5, " ".join(near), "en", "s3", 0),
        (n + 6, prose(rng, 80, 4000) + " " + passage, "en", "s3", 0),
        (n + 7, prose(rng, 70, 4000) + " " + passage + " " + prose(rng, 30, 4000), "en", "s4", 0),
        (n + 8, prose(rng, 12000, 900), "en", "s4", 0),
        (n + 9, "short text", "en", "s0", 0),
        (n + 10, "short text", "en", "s0", 0),
        (n + 11, "one two three <|endoftext|> four", "en", "s0", 0),
    ]
    out += [out[5], out[5]]  # repeated rows
    out.append((None, out[2][1], "en", "s1", 0))
    return out


def table(spark, data=None):
    """The rows with more columns, whose names clash with those the operators make."""
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    clash = ["kept", "size", "taken", "score", "_text", "_digest", "_times", "_copy", "band", "hub", "label", "class_id", "keep_id", "n_words", "_chunk", "_s", "shard", "sequence_id", "__mix_times_", "__mix_times", "__mix_doc", "__mix_copy", "__row__", "__row___times", "_text_key", "_shard", "toxic"]
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
