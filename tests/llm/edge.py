"""A small table with the odd cases: nulls in every column, empty and long texts, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, h string, len int, rank int, block long"


def rows():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    long_text = " ".join(word() for _ in range(4000))
    base = " ".join(word() for _ in range(60))
    near = base.split()
    near[30] = "zzz"
    texts = [base, base, " ".join(near), long_text, "", None, "   ", "One", "one two", "ÄÖ é 123 4.5", "1234 5678", "日本語 テキスト", "\t\n"]
    out = [(i, t, "en" if i % 2 else "de", "s", 1, 1, "h", 2, 3, 4) for i, t in enumerate(texts)]
    out += [(None, base, "en", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    out += [(1, base, "en", "s", 1, 1, "h", 2, 3, 4)] * 2  # whole rows repeat
    out += [(40, " ".join(word() for _ in range(n)), None, "s", n, 1, "h", 2, 3, 4) for n in (2, 3, 4, 30)]  # one id, several texts
    return out


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
