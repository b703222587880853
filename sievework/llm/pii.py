"""Personal data by weak supervision, with DataFrame and SQL functions only.

Base spans (email, ip, card, phone) are found by pattern and check. Further candidates - numbers that
only look like cards, credentials, written-out mail addresses, local phone numbers, names after a
form of address - are judged: labelers (pattern, gazetteer, context before, context against, structure)
vote on each candidate; expectation-maximisation estimates how reliable each labeler is from the
counts of vote patterns; its posteriors train a logistic span classifier, whose verdict by pattern
decides. The classifier sees more than the votes: how the span is written (by kind), and three features of
what stands around it, on which no labeler votes. Patterns are combinations of a few small features, so
their table has a proven bound (kinds * 3^labelers * 2^features) whatever the corpus.

Everything stays in the JVM: matches come from regexp_extract_all, their places from the lengths of
what split() leaves between them, and the estimation runs in aggregate() over the pattern table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, texts

#: Base kinds in order, and the kinds that the method adds after them.
BASE = ("email", "ip", "card", "phone")
ADDED = ("number", "secret", "written_email", "local_phone", "name")
KINDS = BASE + ADDED

# The patterns of the base kinds, in time proportional to the text. Possessive repeats, the looks behind
# and \G (where the match before ended) only save time: from within a run of characters a match fails
# just as it did from the run's start. Runs of fewer than 13 digits are no cards and no numbers.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGITS = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

# Candidates of the added kinds.
SECRET = r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}"
WRITTEN = r"(?i)(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++\s?[(\[]\s?at\s?[)\]]\s?[a-z0-9-]++(?:(?:\s?[(\[]\s?dot\s?[)\]]\s?|\.)[a-z0-9-]++)++"
LOCAL = r"(?<![0-9+.()-])(?<![0-9)+][\x20.-])\(?[0-9]{2,4}[)]?[\x20.-][0-9]{3}[\x20.-][0-9]{3,4}(?![0-9])"
NAME = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?"

#: Gazetteers and cue words of the labelers.
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
SECRET_WORDS = "token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer"
DOMAINS = r"(?i)(?:com|net|org|edu|gov|io|de|fr|es|uk|info)$"
GIVEN_NAMES = (
    "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|William|Elizabeth|David|Barbara|Richard|Susan|Joseph|Jessica|Charles|Sarah|Daniel|Karen|Matthew|Nancy|Anthony|Lisa|Mark|Margaret|Paul|Sandra|Steven|Ashley|Andrew|Emily|George|Helen|Peter|Anna|Henry|Alice|Samuel|Grace|"
    "Hans|Claudia|Klaus|Sabine|Stefan|Petra|Wolfgang|Monika|Jürgen|Ursula|Heinrich|Brigitte|Matthias|Renate|Tobias|Katharina|Florian|Birgit|Andreas|Ingrid|"
    "Jean|Marie|Pierre|Claire|Philippe|Sophie|Nicolas|Isabelle|François|Nathalie|Jacques|Camille|Antoine|Juliette|Laurent|Céline|Olivier|Mathilde|Julien|Hélène|"
    "Carlos|Lucía|José|María|Antonio|Carmen|Manuel|Ana|Francisco|Isabel|Javier|Laura|Miguel|Elena|Alejandro|Marta|Pedro|Pilar|Diego|Sofía|Thomas|Maria|Lucia|Sofia"
)
CUES = {
    "number": r"card|visa|master|account|iban|credit|debit|payment|karte|konto|carte|compte|tarjeta|cuenta",
    "secret": SECRET_WORDS,
    "written_email": r"mail|contact|write|reach|kontakt|contacto|courriel|correo",
    "local_phone": r"tel|phone|call|fax|mobile|cell|telefon|téléphone|teléfono",
    "name": r"contact|author|by|signed|attn|from",
}
AGAINST = r"(?i)(?:version|isbn|issn|page|figure|table|total|price|\$|€|£|#|no\.|nr\.|vol\.|section|line|sha-?1|sha-?256|md5|commit|hash|checksum)[\x20:=\"']*$"
#: Features of the classifier alone: what a candidate is opened by, whether it begins a line, what it is closed by.
OPENED, LINE, CLOSED = r"""["'(\[{<=:]\x20?$""", r"(?:^|\n)[\x20\t]*$", r"""^(?:$|[\n.,;:!?)\]}>"'])"""
FEATURES = 3
#: Characters before a candidate that the context labelers see.
WINDOW = 24
LABELERS = ("pattern", "gazetteer", "context", "against", "structure")
EM_ROUNDS, FIT_ROUNDS, RATE, ACCEPT = 25, 150, 0.5, 0.5


def _lit(x: str) -> Column:
    return F.lit(x)


#: Matches whose places are added up together: a text's places come from sums within and of such blocks.
BLOCK = 256
_SPANS = "array<struct<start:int,end:int,body:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, body>> of a pattern's leftmost matches, in code points, end exclusive."""
    found = F.regexp_extract_all(text, _lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("body"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.char_length(pair["gap"])
        end = begin + F.char_length(pair["body"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), pair["body"].alias("body")))).alias("out"))

    def shifted(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["body"].alias("body")))

    def place(all_pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_pairs) - 1) / BLOCK).cast("int")), lambda i: F.aggregate(F.slice(all_pairs, i * BLOCK + 1, F.lit(BLOCK)), start, step))
        none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out"))
        return F.aggregate(blocks, none, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(shifted(b["out"], acc["at"]))).alias("out")), lambda acc: F.flatten(acc["out"]))

    # pairs are made once: the lambda's argument is a value
    return F.when(F.size(found) > 0, F.transform(F.array(pairs), place)[0]).otherwise(F.array().cast(_SPANS))


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - F.lit(48)
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + part(i)) % 10 == 0


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _is_card(m: Column) -> Column:
    d = _digits(m["body"])
    return F.length(d).between(14, 19) & luhn(d)


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))


def _when(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(_SPANS))


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return (out if no is None else out.when(no, F.lit(-1))).otherwise(F.lit(0))


def _candidate(kind: str, text: Column, m: Column) -> Column:
    """start, kind, end and the pattern - votes, shape and features of the context, as one string - of one candidate."""
    before = F.substring(text, F.greatest(m["start"] - WINDOW, F.lit(0)) + 1, F.least(m["start"], F.lit(WINDOW)))
    body, d = m["body"], _digits(m["body"])
    n = F.length(body)
    cue = before.rlike(f"(?i)(?:{CUES[kind]})")
    if kind == "number":
        votes = [_vote(F.length(d).between(15, 16), F.length(d) < 13), _vote(d.rlike(ISSUERS)), _vote(cue), luhn(d)]
        votes[3] = _vote(votes[3], ~votes[3])
        shape = F.when(body.rlike("[^0-9]"), 1).otherwise(0)
    elif kind == "secret":
        hexa = body.rlike("^[0-9a-f]+$|^[0-9A-F]+$")
        votes = [_vote(n.isin(32, 40, 48, 64) | (n >= 36)), _vote(before.rlike(f"(?i)(?:{SECRET_WORDS})[\"']?\\s*[:=]\\s*[\"']?$")), _vote(cue), _vote(hexa | body.rlike("[a-z].*[A-Z]|[A-Z].*[a-z]"), ~body.rlike("[0-9].*[A-Za-z].*[0-9].*[A-Za-z]"))]
        shape = F.when(hexa, 1).otherwise(0)
    elif kind == "written_email":
        votes = [_vote(body.rlike("(?i)[(\\[]\\s?dot")), _vote(body.rlike(DOMAINS), ~body.rlike(DOMAINS)), _vote(cue), _vote(n.between(8, 60), n > 80)]
        shape = F.when(body.rlike("[0-9]"), 1).otherwise(0)
    elif kind == "local_phone":
        votes = [_vote(F.length(d) == 10, F.length(d) < 9), _vote(body.rlike("^\\(")), _vote(cue), _vote(body.rlike("^\\([0-9]{3}\\) [0-9]{3}-[0-9]{4}$"))]
        shape = F.when(body.contains("-"), 1).otherwise(0)
    else:
        votes = [_vote(body.rlike("^\\S+ \\S+ \\S+$")), _vote(body.rlike(f"\\b(?:{GIVEN_NAMES})\\b")), _vote(cue), _vote(n.between(8, 40), n > 48)]
        shape = F.when(body.rlike("\\."), 1).otherwise(0)
    votes.insert(3, _vote(F.lit(False), before.rlike(AGAINST)))
    line = F.when(m["start"] <= WINDOW, before.rlike(LINE)).otherwise(before.rlike(LINE.replace("^|", "")))
    around = [before.rlike(OPENED), line, F.substring(text, m["end"] + 1, F.lit(1)).rlike(CLOSED)]
    pattern = F.concat_ws(",", F.lit(KINDS.index(kind)), *votes, shape, *[a.cast("int") for a in around])
    return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"), pattern.alias("pattern"))


def _candidates(kind: str, text: Column, spans: Column) -> Column:
    return F.transform(spans, lambda m: _candidate(kind, text, m))


def _found(docs: DataFrame) -> DataFrame:
    """doc_id, base (start, kind, end) and candidates (start, kind, end, pattern) of each document."""
    t = F.col("text")
    digit, at = t.rlike("[0-9]"), t.contains("@")
    rows = texts(docs).withColumn("email", _when(at, matches(t, EMAIL))).withColumn("ip", _when(digit & t.rlike(r"[0-9]\.[0-9]"), matches(t, IP)))
    rows = rows.withColumn("digits", _when(t.rlike(r"[0-9][\x20-]?[0-9]"), matches(t, DIGITS))).withColumn("phone", _when(digit & t.contains("+"), matches(t, PHONE)))
    ip = F.filter("ip", lambda m: m["body"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    phone = F.filter("phone", lambda m: F.length(_digits(m["body"])).between(10, 15))
    base = F.array_sort(F.concat(_kind(F.col("email"), "email"), _kind(ip, "ip"), _kind(F.filter("digits", _is_card), "card"), _kind(phone, "phone")))
    wide = {
        "number": F.filter("digits", lambda m: F.length(_digits(m["body"])).between(13, 19) & ~_is_card(m)),
        "secret": _when(digit & t.rlike("[A-Za-z0-9_-]{20}"), matches(t, SECRET)),
        "written_email": _when(t.rlike(r"(?i)[(\[]\s?at\s?[)\]]"), matches(t, WRITTEN)),
        "local_phone": _when(t.rlike(r"[0-9]{3}[\x20.-][0-9]{3}"), matches(t, LOCAL)),
        "name": _when(t.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}"), matches(t, NAME)),
    }
    candidates = F.concat(*[_candidates(k, t, spans) for k, spans in wide.items()])
    return rows.select("doc_id", base.alias("base"), candidates.alias("candidates"))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _em_sql() -> str:
    """Posteriors q of the patterns ``p`` (array of struct<x: features, v: votes, n: count>) by EM over the votes."""
    k = len(LABELERS)
    sums = ", ".join(f"acc.s{j} + r.n * r.q * int(r.v[{j}] = 1) as s{j}, acc.t{j} + r.n * r.q * int(r.v[{j}] <> 0) as t{j}, acc.f{j} + r.n * (1 - r.q) * int(r.v[{j}] = -1) as f{j}, acc.g{j} + r.n * (1 - r.q) * int(r.v[{j}] <> 0) as g{j}" for j in range(k))
    zero = ", ".join(f"0D as s{j}, 0D as t{j}, 0D as f{j}, 0D as g{j}" for j in range(k))
    # smoothed towards labelers that are right four times in five; that most candidates are right is no evidence for one
    odds = " + ".join(f"case r.v[{j}] when 1 then ln(((m.s{j} + 8) / (m.t{j} + 10)) / (1 - (m.f{j} + 8) / (m.g{j} + 10))) when -1 then ln((1 - (m.s{j} + 8) / (m.t{j} + 10)) / ((m.f{j} + 8) / (m.g{j} + 10))) else 0D end" for j in range(k))
    step = f"""transform(array(aggregate(q, struct(0D as one, 0D as all_, {zero}),
        (acc, r) -> struct(acc.one + r.n * r.q as one, acc.all_ + r.n as all_, {sums}))), m ->
        transform(q, r -> struct(r.x as x, r.v as v, r.n as n, 1D / (1D + exp(-(least(0D, ln((m.one + 5) / (m.all_ - m.one + 5))) + {odds}))) as q)))[0]"""
    start = "transform(p, r -> struct(r.x as x, r.v as v, double(r.n) as n, 1D / (1D + exp(-double(aggregate(r.v, 0, (a, y) -> a + y)))) as q))"
    return f"aggregate(sequence(1, {EM_ROUNDS}), {start}, (q, i) -> {step})"


def _fit_sql(features: int) -> str:
    """Weights of the logistic classifier, by gradient steps over the patterns with their posteriors ``q``."""
    predict = "1D / (1D + exp(-aggregate(zip_with(w, r.x, (a, b) -> a * b), 0D, (a, b) -> a + b)))"
    grad = f"aggregate(q, array_repeat(0D, {features}), (g, r) -> zip_with(g, transform(r.x, b -> b * r.n * ({predict} - r.q)), (a, b) -> a + b))"
    return f"aggregate(sequence(1, {FIT_ROUNDS}), array_repeat(0D, {features}), (w, i) -> zip_with(w, {grad}, (a, b) -> a - {RATE}D * (b / greatest(total, 1D) + 1e-4D * a)))"


def span_classifier(found: DataFrame) -> DataFrame:
    """One row, ``verdict``: map from pattern to the classifier's probability; empty without candidates."""
    counts = found.select(F.explode("candidates.pattern").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    parts = F.split("pattern", ",")
    k = len(LABELERS)
    votes = F.transform(F.slice(parts, 2, k), lambda x: x.cast("int"))
    kind, shape = parts[0].cast("int"), parts[k + 1].cast("double")
    own = [(kind == KINDS.index(a)).cast("double") for a in ADDED]
    x = [F.lit(1.0), *own, *[o * shape for o in own], *[parts[k + 2 + i].cast("double") for i in range(FEATURES)]]
    x += [(votes[j] == s).cast("double") for j in range(k) for s in (1, -1)]
    row = F.struct("pattern", F.struct(F.array(*x).alias("x"), votes.alias("v"), F.col("n").cast("double").alias("n")).alias("r"))
    rows = counts.withColumn("row", row).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    rows = rows.selectExpr("transform(rows, a -> a.pattern) as names", "transform(rows, a -> a.r) as p", "aggregate(rows, 0D, (s, a) -> s + a.r.n) as total")
    rows = rows.selectExpr("names", "total", f"{_em_sql()} as q").selectExpr("names", "q", f"{_fit_sql(len(x))} as w")
    return rows.selectExpr("map_from_arrays(names, transform(q, r -> 1D / (1D + exp(-aggregate(zip_with(w, r.x, (a, b) -> a * b), 0D, (a, b) -> a + b))))) as verdict")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans for each row of ``docs`` (doc_id, text): arrays of struct<start, kind, end>.

    ``kind`` indexes KINDS; places are code points, end exclusive; ``spans`` holds all base spans and the
    added ones that the classifier accepts and that overlap no base span. Null texts count as empty
    and have no spans; rows without a doc_id are left out; repeated rows give a row each; an empty
    table gives an empty result; extra columns are ignored. Texts are never cut, whatever their length.
    """
    found = staged(_found(docs), "pii-found")
    verdict = staged(span_classifier(found), "pii-classifier")
    judged = found.withColumn("verdict", verdict.scalar())
    added = F.filter("candidates", lambda c: (F.coalesce(F.try_element_at("verdict", c["pattern"]), F.lit(0.0)) >= ACCEPT) & ~F.exists("base", lambda b: _overlaps(b, c)))
    plain = F.transform(added, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return judged.select("doc_id", "base", F.array_sort(F.concat("base", plain)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def pii_digest(docs: DataFrame) -> DataFrame:
    """find_pii() as counts of the base kinds, a digest of the base spans, all spans as text, and counts of the added kinds and of all."""
    found = find_pii(docs)
    base, spans = F.col("base"), F.col("spans")
    added = [count_of(spans, k).alias(f"n_{k}") for k in ADDED]
    return found.select("doc_id", *[count_of(base, k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), *added, F.size(spans).cast("long").alias("n_spans"))
