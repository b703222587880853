"""The review around the core operators: validation rules, search construction, full-text context, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import dot
from ..session import violations
from .ranking import rrf
from .splits import quantiles


#: Rules of the entities, in SQL: what each row has to satisfy.
RULES = {
    "search_query": {"question": "trim(research_question) <> ''", "max_papers": "max_papers_per_db BETWEEN 1 AND 10000"},
    "candidate": {"title": "trim(title) <> ''", "source": "trim(source_database) <> ''", "year": "coalesce(year BETWEEN 1000 AND year(current_date()), true)"},
    "paper": {"title": "trim(title) <> ''", "source": "trim(source) <> ''", "year": "year BETWEEN 1 AND year(current_date())"},
    "abstract_context": {"probability": "coalesce(probability BETWEEN 0 AND 1, true)", "confidence": "coalesce(confidence BETWEEN 0 AND 1, true)", "criteria": "coalesce(forall(map_values(criterion_probabilities), v -> v BETWEEN 0 AND 1), true)"},
    "decision_record": {"confidence": "coalesce(confidence BETWEEN 0 AND 1, true)", "tokens": "coalesce(tokens >= 0, true)", "milliseconds": "coalesce(milliseconds >= 0, true)"},
    "final_decision": {"probability": "coalesce(p_include BETWEEN 0 AND 1, true)", "criteria": "coalesce(forall(map_values(criterion_probabilities), v -> v BETWEEN 0 AND 1), true)"},
    "scored": {"s": "s BETWEEN 0 AND 1", "u": "u BETWEEN 0 AND 1", "y": "y IN (0, 1)", "split": "is_split IN (0, 1, 2)"},
}


def check(df: DataFrame, entity: str) -> DataFrame:
    """One row: how many rows break each rule of an entity."""
    return violations(df, **{name: F.expr(rule) for name, rule in RULES[entity].items()})


def check_budget(delta_eta: float, delta_ltt: float, delta_total: float) -> None:
    """The confidence must be divided without a rest."""
    if abs(delta_eta + delta_ltt - delta_total) > 1e-9:
        raise ValueError("delta_eta + delta_ltt must be delta_total")


def keywords(pico: DataFrame, key: str) -> DataFrame:
    """key, domain_keywords: phrases of the four elements in order, without repeats (ignoring case)."""
    parts = [tx.phrases(F.col(f"pico.{c}")) for c in ("population", "intervention", "comparator", "outcome")]
    return pico.select(key, tx.first_of_each(F.concat(*parts)).alias("domain_keywords"))


def query_pair(reply: Column) -> Column:
    """struct<pubmed, s2> of a model's reply: plain JSON, a fenced block, or the two fields by pattern; both or null."""
    def field(name: str) -> Column:
        return F.coalesce(tx.json_field(reply, f"$.{name}"), F.nullif(F.regexp_extract(reply, rf'"{name}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit("")))

    a, b = field("pubmed_query"), field("s2_query")
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("pubmed"), b.alias("s2")))


def refined(queries: DataFrame, pair: Column) -> DataFrame:
    """Both overrides replaced where a refinement came back."""
    return queries.withColumns({"pubmed_query_override": F.coalesce(pair["pubmed"], "pubmed_query_override"), "s2_query_override": F.coalesce(pair["s2"], "s2_query_override")})


def refine_prompt(query: Column, gaps: Column, terms: Column) -> Column:
    """The text of a refinement request: query, gaps, uncovered terms."""
    missing = F.transform(F.filter(F.map_entries(terms), lambda e: ~e["value"]), lambda e: e["key"])
    return F.concat_ws("\n", F.concat(F.lit("Query: "), query), F.concat(F.lit("Gaps: "), F.array_join(gaps, "; ")), F.concat(F.lit("Uncovered: "), F.array_join(missing, ", ")))


def pico_text(pico: str = "pico") -> Column:
    names = {"Population": "population", "Intervention": "intervention", "Comparator": "comparator", "Outcome": "outcome", "Study design": "study_design"}
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), F.coalesce(f"{pico}.{v}", F.lit(""))) for k, v in names.items()])


def model_input(title: Column, abstract: Column, length: int = 450) -> Column:
    """What an abstract encoder reads."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" [SEP] "), F.substring(F.coalesce(abstract, F.lit("")), 1, length))


def hashed_vectors(docs: DataFrame, text: str, key: str, size: int = 256) -> DataFrame:
    """key, vector: hashed TF-IDF of length one: the offline stand-in for a text encoder."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    rows = docs.select(key, tx.search_tokens(tx.text_or_empty(text)).alias("t"))
    tf = HashingTF(inputCol="t", outputCol="tf", numFeatures=size).transform(rows)
    idf = IDF(inputCol="tf", outputCol="idf").fit(tf).transform(tf)
    return Normalizer(inputCol="idf", outputCol="vector").transform(idf).select(key, "vector")


def section_with(span: Column, sections: Column) -> Column:
    """Label of the first section that contains a span."""
    return F.get(F.filter(F.map_entries(sections), lambda e: F.contains(e["value"], span)), 0)["key"]


def whole_text(sections: Column) -> Column:
    return F.array_join(F.map_values(sections), " ")


def candidates_for(sections: Column, element: str) -> Column:
    """Up to ten sentences, of methods and results where there are any, that may hold an element."""
    own = F.map_filter(sections, lambda k, v: k.isin("METHODS", "RESULTS"))
    text = whole_text(F.when(F.size(own) > 0, own).otherwise(sections))
    return tx.with_keyword(tx.sentences(text, 15), F.array(*[F.lit(w) for w in tx.ELEMENT_WORDS[element]]))


def element_or_candidate(reply: Column, candidates: Column, protocol: Column) -> Column:
    """struct<text, confidence>: the model's element (0.8), else the head of the first candidate (0.4), else the protocol's (0.1)."""
    def made(text: Column, conf: float) -> Column:
        return F.when(text.isNotNull(), F.struct(text.alias("text"), F.lit(conf).alias("confidence")))

    return F.coalesce(made(tx.reply_element(reply), 0.8), made(F.substring(F.get(candidates, 0), 1, 200), 0.4), made(protocol, 0.1))


def outcome_list(raw: Column) -> Column:
    """Valid outcome texts of a JSON list or a single object."""
    many = F.from_json(raw, "array<struct<text:string,source:string>>")
    one = F.from_json(raw, "struct<text:string,source:string>")
    items = F.coalesce(many, F.when(one["text"].isNotNull(), F.array(one)), F.array().cast("array<struct<text:string,source:string>>"))
    return F.filter(F.transform(items, lambda x: tx.reply_element(x["text"])), lambda t: t.isNotNull())


def sentence_union(scored: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Of sentences with dense and lexical scores the k best of either kind (lexical only above 0), by falling dense score."""
    w = Window.partitionBy(*keys)
    rows = scored.withColumn("__d", F.row_number().over(w.orderBy(F.col("dense").desc(), "position"))).withColumn("__l", F.row_number().over(w.orderBy(F.col("lexical").desc(), "position")))
    hits = rows.where((F.col("__d") <= k) | ((F.col("__l") <= k) & (F.col("lexical") > 0)))
    return hits.withColumn("rank", F.row_number().over(w.orderBy(F.col("dense").desc(), "position"))).drop("__d", "__l")


def raw_scores(ranked: DataFrame, lexical: str = "rank_lexical", dense: str = "rank_dense") -> DataFrame:
    """Reciprocal ranks of both rankings and their fusion."""
    return ranked.withColumns({"r_lexical": 1.0 / (60 + F.col(lexical)), "r_dense": 1.0 / (60 + F.col(dense)), "raw_score": rrf(F.col(lexical), F.col(dense))})


def extracted_field(reply: Column, span: Column, text: Column) -> Column:
    """struct<value, confidence, verified> of an extraction reply; null-like values are null, the span is looked for ignoring case."""
    value = tx.reply_element(tx.json_field(reply, "$.value"))
    conf = F.least(F.greatest(tx.json_field(reply, "$.confidence").cast("double"), F.lit(0.0)), F.lit(1.0))
    return F.struct(value.alias("value"), F.coalesce(conf, F.lit(0.0)).alias("confidence"), F.coalesce(F.contains(F.lower(text), F.lower(span)), F.lit(False)).alias("verified"))


def article_sections(xml: DataFrame, key: str, column: str = "xml") -> DataFrame:
    """key, label, text of article XML: the abstract and every section of the body by its type or title."""
    import xml.etree.ElementTree as ElementTree

    import pandas as pd

    kinds = {"intro": "INTRODUCTION", "materials": "METHODS", "ref-list": "REFERENCES"} | {n: label for label, names in tx.SECTIONS.items() for n in names}

    def label(sec) -> str:
        title = sec.find("title")
        named = [(sec.get("sec-type") or "").lower(), "".join(title.itertext()).strip().lower() if title is not None else ""]
        return next((kinds[x] for x in named if x in kinds), next((v for k, v in kinds.items() if k in named[1]), "OTHER"))

    def parse(batches):
        for batch in batches:
            out = []
            for doc, raw in zip(batch[key], batch[column], strict=True):
                try:
                    root = ElementTree.fromstring(raw or "")
                except ElementTree.ParseError:
                    continue
                parts = [("ABSTRACT", e) for e in root.iter("abstract")] + [(label(s), s) for b in root.iter("body") for s in b.iter("sec")]
                out += [(doc, name, " ".join(" ".join(e.itertext()).split())) for name, e in parts]
            yield pd.DataFrame(out, columns=[key, "label", "text"])

    kind = dict(xml.dtypes)[key]
    rows = xml.select(key, column).mapInPandas(parse, f"{key} {kind}, label string, text string")
    return rows.where(F.trim("text") != "")


def similarity_test(observed: float, null: DataFrame, column: str = "similarity") -> DataFrame:
    """One row: 2.5 % and 97.5 % points of a null distribution, the observed value's p and whether it is above."""
    q = quantiles(null, column, [0.025, 0.975], []).scalar()
    return null.agg(F.avg((F.col(column) >= observed).cast("double")).alias("p_value")).withColumn("q", q).select(F.get("q", 0).alias("low"), F.get("q", 1).alias("high"), "p_value", (F.lit(observed) > F.get("q", 1)).alias("above"))


def attention_input(vector: Column, criterion: Column) -> Column:
    return dot(vector, criterion) / F.sqrt(F.size(vector).cast("double"))
