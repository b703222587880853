"""Documents with every awkward case: nulls, empty and long texts, ties, repeats, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, keep_id string, n string, copies string, size string"


def rows(seed=1, n=60):
    draw = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "delta", "été", "straße", "x1", "end.", "lorem", "ipsum", "dolor", "sit"]
    out = []
    for i in range(n):
        text = " ".join(draw.choice(words) + (str(draw.randrange(30)) if draw.random() < 0.6 else "") for _ in range(draw.randrange(5, 80)))
        out.append((i, text, draw.choice(["en", "de", None]), draw.choice(["a", "a", "a", "b", "c", None]), len(text)))
    texts = [r[1] for r in out]
    for k, t in enumerate((None, "", " \n\t", "one", "one two", "x " * 3000, "a" * 9000, texts[0], texts[0] + " ", texts[1].replace(" ", "  "), texts[2] + " tail words here", "w " + texts[3])):
        out.append((n + k, t, None, None, None))
    out += [out[5], out[5], (None, "no id", "en", "a", 1)]
    return [(*r, "d", "k", "n", "c", "s") for r in out]


def docs(spark, **k):
    return spark.createDataFrame(rows(**k), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
