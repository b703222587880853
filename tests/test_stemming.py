"""Stems of published examples, and BM25 over stems against a plain version."""

import math

from pyspark.sql import functions as F

from sievework.functions import stemming
from sievework.functions.stemming import plain_words, stem, stems
from sievework.operators import ranking

#: Words and their stems, from the published description of the steps and its sample vocabulary.
PAIRS = """
caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan
falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valency valenc hesitancy hesit digitizer digit
conformably conform radically radic differently differ vilely vile analogously analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis
hopefulness hope callousness callous formality formal sensitivity sensit sensibility sensibl triplicate triplic formative form formalize formal electricity electr electrical electr
hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac
adjustment adjust dependent depend adoption adopt communism commun activate activ homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controlling control rolling roll generalizations gener generally gener oscillators oscil oscillate oscil
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist
consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid
consolidating consolid consoling consol consolingly consolingli consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu
conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl
constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead
knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knightli
knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock
knopp knopp knot knot knots knot
flies fli dies die mules mule denied deni died die owned own humbled humbl meeting meet stating state siezing siez itemization item sensational sensat traditional tradit reference refer
colonizer colon plotted plot
connect connect connected connect connecting connect connection connect connections connect connective connect computation comput computer comput computing comput computed comput compute comput
argue argu argued argu argues argu arguing argu fishing fish fished fish fisher fisher maximum maximum presumably presum multiply multipli provision provis owed owe ear ear saying say crying cri
string string meant meant cement cement university univers universities univers universe univers universal univers organization organ organizations organ organize organ
running run runs run easily easili beautiful beauti beauty beauti happiness happi kindness kind studies studi studying studi cries cri tried tri trying tri
enjoy enjoy plays play says say dying die skies sky news news proceed proceed exceed exceed succeed succeed lying lie a a by by at at is is
""".split()


def test_published_stems():
    pairs = list(zip(PAIRS[::2], PAIRS[1::2], strict=True))
    assert len(set(pairs)) >= 200
    assert [(w, stem(w), s) for w, s in pairs if stem(w) != s] == []


def test_words_are_stemmed_once(spark):
    rows = spark.createDataFrame([("knocking",), ("knocks",), ("knocks",), (None,)], "term string")
    assert sorted(map(tuple, stems(rows).collect())) == [("knocking", "knock"), ("knocks", "knock")]


def test_bm25_over_stems(spark):
    texts = {1: "Knocking, knocks; the knife!", 2: "a knife and knives and a fork", 3: "nothing here", 4: None, 5: "cannot knock", 6: "fork forks forked the the"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    stop = ["the", "a", "and"]
    got = {r["doc_id"]: r["score"] for r in ranking.bm25_stemmed(docs, "text", "knock the forks, knock", stop).collect()}
    bags = {d: [stem(w) for w in "".join(c if c.isalnum() else " " for c in (t or "").lower().replace("cannot", "can not")).split() if w not in stop] for d, t in texts.items()}
    n, avg = len(bags), sum(map(len, bags.values())) / len(bags)
    df = {s: sum(s in b for b in bags.values()) for b in bags.values() for s in b}
    idf = {s: math.log(n - k + 0.5) - math.log(k + 0.5) for s, k in df.items()}
    mean = sum(idf.values()) / len(idf)
    want = {}
    for d, b in bags.items():
        score = 0.0
        for q in ("knock", "fork", "knock"):
            w = idf[q] if idf[q] >= 0 else 0.25 * mean
            score += w * b.count(q) * 2.5 / (b.count(q) + 1.5 * (0.25 + 0.75 * len(b) / avg))
        if score:
            want[d] = score
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in want)


def test_stem_counts_are_a_row_a_document(spark, monkeypatch):
    texts = ["Running runs; he CANNOT run, gonna!", None, "", "hatred\tHatred the hating", "can-not cannot_x écannot cannoté"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(stemming, "SLICE", 3)
    got = {r.doc_id: (r.dl, dict(zip(r.stems, r.tf))) for r in stemming.stem_counts(docs.coalesce(1), plain_words(F.col("text"), ["the", "he"]), "doc_id").collect()}
    assert got[0] == (7, {"run": 3, "can": 1, "not": 1, "gon": 1, "na": 1}) and got[1] == got[2] == (0, {}) and got[3] == (3, {"hatr": 2, "hate": 1})
    assert len(got) == 5 and got[4][0] == sum(got[4][1].values()) and got[4][1]["can"] == 2 and got[4][1]["not"] == 2
    sizes = {}
    monkeypatch.setattr(ranking, "landed", lambda df, name: sizes.setdefault(name, df.cache()))
    ranking.bm25_stemmed(docs, "text", "running hatred", ["the"]).collect()
    assert all(df.count() <= len(texts) for name, df in sizes.items() if "doc_id" in df.columns) and sizes
