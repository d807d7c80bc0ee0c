"""Small tables that the tests of several operators share."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, schema="doc_id long, text string", extra=()):
    """A table of (doc_id, text), with columns whose names an operator might use itself."""
    df = spark.createDataFrame(rows, schema)
    for name in extra:
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))


#: Null, empty and blank texts, a null id, repeated ids and rows, marks only, other scripts, a long text.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (None, "a null id"), (4, "repeated row"), (4, "repeated row"), (4, "repeated id"),
    (5, "|||"), (6, "Ünïcode ＦＵＬＬ 中文字   x  y"), (7, words(1, 4000)), (8, "a <|endoftext|> b"), (9, "x" * 3000),
]
