"""Documents that are awkward in every way the operators promise to handle."""

import random

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
#: Names that the operators use themselves.
CLASHING = ("fp", "norm", "hot", "salt", "prefix", "run", "head", "class", "n", "bits", "block", "part", "key", "words", "line", "row", "n_tokens", "text_sha256", "kept", "count", "spans", "tokens", "epoch")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def prose(seed, n=120):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", ",", "."]) + str(rnd.randint(0, 999)) for _ in range(n)) + "."


def records():
    base = prose(1)
    edited = base.replace(base.split()[60], "changed", 1)
    long = "\n".join(prose(100 + k, 400) for k in range(60))
    texts = [
        (1, base, "en", "a"), (2, base.replace(" ", "\t\n", 3), "en", "a"), (3, edited, "en", "b"), (4, None, None, None), (5, "", "en", "a"), (6, " \t\n\v\f\r ", "de", None),
        (7, "one two three", "en", "b"), (8, "ONE two three", "en", "b"), (9, "one  two three", None, "b"), (10, long, "en", "hot"), (11, long, "en", "hot"),
        (None, base, None, None), (None, None, None, None), (12, "éß 東京 \U0001f600 \u0000 x", "fr", ""), (13, base, "en", "a"), (13, base, "en", "a"), (14, prose(2), "en", "a"), (15, "a" * 50_000, "en", "b"),
    ]
    return [(i, t, lang, s, len(t) if t else None, *["x"] * len(CLASHING)) for i, t, lang, s in texts]


def documents(spark):
    return spark.createDataFrame(records(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
