"""Texts of more than a megabyte, and of more than one segment, through every operator that cuts long texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from sievework.llm import decontamination, jaccard_join, mixing, quality, shingles, suffix_dedup, toxicity, warc
from sievework.llm.exact_dedup import exact_dedup

from .test_dedup import _components, _exact, _plain, _removed, _shingles

SIZE = 1_300_000


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghijkl") for _ in range(draw.randrange(2, 9))) for _ in range(4000)]
    body = " ".join(draw.choice(words) for _ in range(SIZE // 6))
    assert len(body) > shingles.PIECE > suffix_dedup.SEGMENT
    cut = suffix_dedup.SEGMENT
    near = body[:700_000] + " changed here " + body[700_000:]
    # a passage of the long text, over the end of a segment, in a short one and at another place of a long one
    passage = body[cut - 90:cut + 70]
    other = " ".join(draw.choice(words) + "q" for _ in range(SIZE // 8)) + passage + " the end"
    return [(1, body), (2, body + "  \n"), (3, near), (4, "x " + passage + " y"), (5, other), (6, None), (7, "z" * 1_200_000), (8, "z" * 1_200_001)]


def _docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(4)


def test_exact(spark, texts):
    docs = _docs(spark, texts)
    assert sorted(map(tuple, exact_dedup(docs).collect())) == _exact(_plain(docs))


def test_suffix(spark, texts):
    docs = _docs(spark, [t for t in texts if t[0] != 2])
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(docs).drop("spans").collect())) == _removed(_plain(docs))


def test_jaccard_and_leaks(spark, texts):
    docs = _docs(spark, texts)
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs, 5, 80).collect())) == _components(_plain(docs), 5, 80)
    body = texts[0][1]
    at = body.index(" ", shingles.PIECE - 60)
    items = [(1, body[body.rindex(" ", 0, at - 80):at + 200]), (2, " ".join(body[900_000:900_400].split()[1:-1])), (3, "nowhere to be found in any text"), (4, body)]
    want = sorted((d, i, len(_shingles(q, 5) & _shingles(t, 5))) for d, t in _plain(docs) for i, q in items if _shingles(q, 5) and 100 * len(_shingles(q, 5) & _shingles(t, 5)) >= 80 * len(_shingles(q, 5)))
    got = decontamination.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["shared"]) for r in got) == want and {w[1] for w in want} == {1, 2, 4}


def test_sizes_and_archives(spark, texts):
    docs = _docs(spark, texts)
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r["size"] for r in mixing.mix(docs.withColumn("source", F.lit("a"))).collect()}
    assert got == {d: len((t or "").split()) for d, t in texts}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a/").alias("url"), F.col("text").alias("html"))
    back = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in warc.round_trip(pages).collect()}
    assert back == {d: (len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in texts}


def test_scores_see_the_end_of_a_long_text():
    """An insult after the first megabyte counts as one before it; a unit keeps its sentence across pieces."""
    draw = np.random.default_rng(4)
    clean = " ".join("".join(chr(97 + c) for c in draw.integers(0, 10, 6)) for _ in range(SIZE // 7))
    table = np.zeros(32 ** 3)
    table[toxicity.subsequences(toxicity._symbols([bytes([27, 26, 15, 18, 14, 28])]))[0] > 0] = 1.0  # "zorn"
    early, late = "zorn " + clean, clean + " zorn"
    assert len(clean) > shingles.PIECE
    got = toxicity.document_features([t.encode() for t in (early, late, clean)], table, -1.0)
    assert np.allclose(got[0, 6:], got[1, 6:]) and got[0, 6] > got[2, 6]
    units = toxicity.Units([clean.encode()])
    assert len(units.first) == 1 and units.count[0] == len(units.number) == len(clean.split())
    one = quality.text_features([clean.encode()])
    assert np.isfinite(one).all() and zlib.crc32(one.tobytes()) == zlib.crc32(quality.text_features([clean.encode()]).tobytes())
