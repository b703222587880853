import hashlib
import random

from pyspark.sql import functions as F

from sievework.llm import mixing, warc

from . import fixtures
from .test_dedup import _plain, _shingles


def test_flight_keeps_totals():
    draw = random.Random(2)
    sizes = [float(draw.randrange(0, 500)) for _ in range(400)]
    probs = [draw.random() for _ in sizes]
    flown = mixing.flight(sizes, probs, draw)
    assert sum(0 < p < 1 for p in flown) <= 2
    assert abs(sum(flown) - sum(probs)) < 1e-6
    assert abs(sum(s * p for s, p in zip(sizes, flown, strict=True)) - sum(s * p for s, p in zip(sizes, probs, strict=True))) < 1e-4
    assert all(p in (0.0, 1.0) for p in mixing.flight(sizes, probs, draw, land=True))


def test_mix(spark):
    docs = fixtures.docs(spark, n=300)
    got = mixing.mix(docs, chunk=32).collect()
    rows = [(r["source"], len([w for w in (r["text"] or "").translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w])) for r in docs.where("doc_id is not null").collect()]
    total, per = {}, sorted({s for s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    for s, n in rows:
        total[s] = total.get(s, 0) + n
    weight, target, left, free = {s: (3, 1, 2)[i % 3] for i, s in enumerate(per)}, {}, 1.5 * sum(total.values()), list(per)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            free.remove(s)
    assert len(got) == len(rows)
    for s in per:
        own = [r for r in got if r["source_size"] == total[s] and abs(r["target"] - target[s]) < 1e-6]
        assert own and abs(sum(r["taken"] for r in own) - target[s]) <= max(r["size"] for r in own)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    again = mixing.mix(docs.repartition(5), chunk=32).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert mixing.mix(fixtures.empty(spark)).collect() == []


def test_targets_of_many_sources(spark):
    draw = random.Random(5)
    sizes = {f"host{i}.example": draw.choice([0, 1, 5, 400, 9000]) for i in range(500)} | {None: 77}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()] + [(s, 0) for s in sizes], "source string, size long").repartition(7)
    got = {r["source"]: r for r in mixing.source_targets(rows).collect()}
    per, target, left = sorted(sizes, key=lambda s: (s is None, s or "")), {}, 1.5 * sum(sizes.values())
    weight, free = {s: (3, 1, 2)[i % 3] for i, s in enumerate(per)}, per
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]]:
        target |= {s: 2.0 * sizes[s] for s in over}
        left, free = left - sum(2.0 * sizes[s] for s in over), [s for s in free if s not in over]
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    assert got.keys() == sizes.keys() and all(abs(got[s]["target"] - target[s]) < 1e-6 and got[s]["source_size"] == sizes[s] for s in sizes)


def _pages():
    long_ = "<p>" + "text " * 60
    return [(1, "http://www.example.com/a?b=1#c", long_), (2, "https://user@M.Example.com:8080/x", long_), (3, None, long_ + "x"), (4, "no url", None), (5, "http://a.b/ space\n", "short"), (6, "http://a.b/", "short"), (0, "http://a.b/", long_), (7, "http://a.b/", "é" * 60), (8, "http://z/", "é" * 60), (9, "http://z/", "y" * 200_000), (9, "http://z/", "other"), (6, "http://a.b/", "short"), (None, "http://n/", long_)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "e") for p in _pages()], "page_id long, url string, html string, entry string").repartition(3)
    want, first = [], {}
    for p, _, h in _pages():
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, p), p)
    for p, _, h in _pages():
        if p is not None:
            raw = (h or "").encode()
            ref = first.get(h, p) if len(raw) >= 100 else p
            want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "response" if ref == p else "revisit", None if ref == p else ref))
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_capture_lookup(spark):
    pages = spark.createDataFrame([(i, f"http://host{i % 7}.example.com/{i}", f"<p>{i}") for i in range(3000)], "page_id long, url string, html string")
    captures, index, root = warc.archive(pages)
    wanted = spark.createDataFrame([(5, "http://host5.example.com/5"), (2999, "http://host3.example.com/2999"), (5, "http://nowhere.example.com/")], "page_id long, url string")
    got = warc.read_records(warc.lookup(wanted, index, root), root).collect()
    assert sorted((r["page_id"], bytes(r["payload"])) for r in got) == [(5, b"<p>5"), (2999, b"<p>2999")]


def test_surt():
    assert warc.surt("http://m.Example.com/a?b#c") == "com,example,m)/a?b"
    assert warc.surt("https://u:p@x.org:444") == "org,x:444)/" and warc.surt(None) == "" and warc.surt("no url") == ")no url"


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = fixtures.docs(spark)
    words = [f"b{i}" for i in range(40)]
    docs = docs.unionByName(spark.createDataFrame([(700, " ".join(words), "en", "a", 1), (701, " ".join(words[:20]), "en", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    spark.createDataFrame([(1, " ".join(words[5:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("id", "row", "copy", "text_", "ID_"):  # names of working columns
        docs = docs.withColumn(name, F.lit(name))
    columns = docs.columns
    kept = pipeline.quality_stage(spark, docs, str(tmp_path))
    assert kept.columns == columns and kept.count() == docs.where("doc_id is not null").count()
    unique = pipeline.dedup_stage(spark, kept, str(tmp_path))
    rows = _plain(kept)
    linked = {b for a, x in rows for b, y in rows if a < b and _shingles(x, 5) and 100 * len(_shingles(x, 5) & _shingles(y, 5)) >= 80 * len(_shingles(x, 5) | _shingles(y, 5))}
    assert unique.columns == columns and {r[0] for r in _plain(unique)} == {d for d, _ in rows} - linked
    clean = pipeline.decontamination_stage(spark, unique, str(tmp_path))
    assert clean.columns == columns and {r[0] for r in _plain(unique)} - {r[0] for r in _plain(clean)} == {700}
    mixed = pipeline.mixing_stage(spark, clean, str(tmp_path))
    times = {}
    for d, _ in _plain(mixed):
        times[d] = times.get(d, 0) + 1
    copies = {}
    for r in mixing.mix(clean).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["copies"]
    assert mixed.columns == columns and times == {d: c for d, c in copies.items() if c}
    assert pipeline.token_stage(spark, mixed, str(tmp_path)).count() == mixed.count()
    assert pipeline.run(spark, str(tmp_path)).count() == mixed.count()


def test_quality_stage_rejects(spark, tmp_path):
    """The stage leaves out exactly the rows that the classifier, applied row by row, rejects."""
    import corpus_pipeline as pipeline
    from sievework.llm import quality

    from .test_text import _judged

    rows = _judged()
    docs = spark.createDataFrame([(*r[:5], "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, text_ string").repartition(3)
    spark.createDataFrame([(r[0], r[5], r[6]) for r in rows[:300]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = sorted(map(tuple, pipeline.quality_stage(spark, docs, str(tmp_path)).collect()))
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = [(*r[:5], "extra") for r in rows if quality.apply_model(model, quality._views([r[1]], [r[2]], [r[3]], [r[4]]))[2][0] >= model["threshold"]]
    assert kept == sorted(want) and 300 <= len(kept) <= 325 and sum(r[5] for r in rows) - 2 <= len(kept)


def test_mixing_stage_of_unique_ids(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = fixtures.docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    mixed = pipeline.mixing_stage(spark, docs, str(tmp_path))
    times, copies = {}, {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    for d, _ in _plain(mixed):
        times[d] = times.get(d, 0) + 1
    assert mixed.columns == docs.columns and times == {d: c for d, c in copies.items() if c}
