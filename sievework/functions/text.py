"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never make a search phrase on their own.
STOPWORDS = (
    "a", "an", "the", "and", "or", "not", "no", "nor", "of", "in", "on", "at", "to", "for", "with", "by", "from",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "its", "it", "this", "that", "these", "those", "other", "others", "another",
    "such", "some", "any", "all", "both", "given", "based", "including", "using", "via", "versus", "apparent",
    "apparently", "commonly", "used", "patients", "patient", "studies", "study",
)
# Words that lexical retrieval leaves out.
SEARCH_STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall must can its it the "
    "of in on at to for with by from and or not but if this that which who as such any all some than more most less very also"
).split()
# Separators of the phrases of a text.
SEPARATORS = r"(?i)\s+and\s+|\s+or\s+|\s+with\s+|\s+for\s+|[,;]\s*|\s*/\s*"
# Headings of the sections of a paper.
SECTIONS = {
    "ABSTRACT": ["abstract"],
    "INTRODUCTION": ["introduction", "background"],
    "METHODS": ["method", "methods", "methodology", "materials and method", "materials and methods", "material and methods"],
    "RESULTS": ["result", "results", "finding", "findings"],
    "DISCUSSION": ["discussion"],
    "CONCLUSION": ["conclusion", "conclusions"],
    "REFERENCES": ["references", "bibliography"],
}
# Words, in lower case, by which sentences are candidates for an element.
ELEMENT_WORDS = {
    "population": ["patient", "participant", "subject", "n=", "sample", "cohort", "population", "adult", "child", "men", "women", "aged", "enrolled", "recruited", "inclusion criteria"],
    "intervention": ["treat", "therap", "drug", "medication", "intervent", "dose", " mg ", " g ", "regimen", "surgery", "procedure", "administered", "received", "assigned"],
    "comparator": ["control", "placebo", "comparator", "comparison", "versus", " vs ", "standard care", "usual care", "sham"],
    "outcome": ["outcome", "mortality", "survival", "efficacy", "effect", "measure", "endpoint", "assess", "rate", "score", "event", "reduction", "incidence", "risk", "hazard"],
}


def text_or_empty(c) -> Column:
    """The text; null is empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def doi_key(c) -> Column:
    """DOI without its resolver prefix, trimmed, in lower case; empty is null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"^https?://(dx\.)?doi\.org/", ""), F.lit(""))


def pmid_key(c) -> Column:
    """Trimmed identifier; empty is null."""
    return F.nullif(F.trim(c), F.lit(""))


def title_key(c) -> Column:
    """Title in lower case, trimmed, with single spaces."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def tokens(c) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def search_tokens(c) -> Column:
    """tokens() of three characters and more that aren't stopwords."""
    return F.filter(tokens(c), lambda t: (F.length(t) >= 3) & ~t.isin(SEARCH_STOPWORDS))


def words(c) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def content_words(c) -> Column:
    """Words of three characters and more that aren't stopwords."""
    return F.filter(words(c), lambda w: ~F.lower(w).isin(*STOPWORDS) & (F.length(w) >= 3))


def approx_tokens(c) -> Column:
    """Estimate of model tokens: three words are four tokens, at least one."""
    return F.greatest(F.lit(1), F.floor(F.size(words(c)) / F.lit(0.75)).cast("int"))


def strip_markup(c) -> Column:
    """Tags out, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " "))


def fill_template(template: str | Column, values: dict[str, Column]) -> Column:
    """Literal {key} replacement in the order of ``values``."""
    out = F.lit(template) if isinstance(template, str) else template
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), text_or_empty(value))
    return out


def prompt_key(c) -> Column:
    """SHA-256 of a rendered prompt: the votes' cache key."""
    return F.sha2(c, 256)


def head_key(head, text) -> Column:
    return F.sha2(F.concat_ws(":", head, text), 256)


def slug(c, length: int = 48) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, length)


def fenced(c) -> Column:
    """What a fenced block holds, or null."""
    return F.nullif(F.regexp_extract(c, r"```(?:json)?\s*([\s\S]*?)```", 1), F.lit(""))


def json_field(c, path: str) -> Column:
    """A field of a JSON reply that may be bare or fenced; null where neither parses."""
    return F.coalesce(F.get_json_object(c, path), F.get_json_object(fenced(c), path))


def sentences(c, longer_than: int = 10) -> Column:
    """Sentences of more than so many characters, trimmed."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > longer_than)


def with_keyword(sents: Column, keywords: Column, most: int = 10) -> Column:
    """The first sentences that contain any keyword, ignoring case."""
    return F.slice(F.filter(sents, lambda s: F.exists(keywords, lambda k: F.contains(F.lower(s), F.lower(k)))), 1, most)


def first_of_each(items: Column) -> Column:
    """Strings without repeats (ignoring case), in the order of their first occurrence; sorted, never compared all with all."""
    def pick(marked: Column) -> Column:
        firsts = F.filter(marked, lambda x, i: (i == 0) | (F.get(marked, i - 1)["low"] != x["low"]))
        return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["at"].alias("at"), x["item"].alias("item")))), lambda x: x["item"])

    marked = F.array_sort(F.transform(items, lambda p, i: F.struct(F.lower(p).alias("low"), i.alias("at"), p.alias("item"))))
    # sorted once: the lambda's argument is a value
    return F.transform(F.array(marked), pick)[0]


def phrases(c) -> Column:
    """Search phrases of a text: split at joining words and marks, parentheses and leading stopwords off, at least one content word.

    Order of first occurrence, without repeats (ignoring case).
    """
    parts = F.transform(F.split(text_or_empty(c), SEPARATORS), lambda p: F.trim(F.regexp_replace(p, r"[()\s]+", " ")))
    stop = "|".join(STOPWORDS)
    # possessive: a loop, where the plain repeat calls itself for each word and a long run of stopwords ends the stack
    parts = F.transform(parts, lambda p: F.regexp_replace(p, rf"(?i)^(?:(?:{stop})(?:\s+|$))++", ""))
    return first_of_each(F.filter(parts, lambda p: F.size(content_words(p)) > 0))


def tiab_term(c) -> Column:
    """A title/abstract term: short phrases quoted, longer ones as content words joined by AND."""
    content = content_words(c)
    return F.when(F.size(words(c)) <= 3, F.concat(F.lit('"'), c, F.lit('"[TIAB]'))).otherwise(F.concat(F.lit("("), F.array_join(F.transform(content, lambda w: F.concat(w, F.lit("[TIAB]"))), " AND "), F.lit(")")))


def boolean_query(group_a: Column, group_b: Column, first_year=None, last_year=None, override=None) -> Column:
    """OR within two groups of phrases, AND between them, then the years; an override wins."""
    def group(g: Column) -> Column:
        return F.when(F.size(g) > 0, F.concat(F.lit("("), F.array_join(F.transform(g, tiab_term), " OR "), F.lit(")")))

    out = F.concat_ws(" AND ", group(group_a), group(group_b))
    if first_year is not None and last_year is not None:
        out = F.concat(out, F.lit(' AND ("'), first_year, F.lit('"[PDAT] : "'), last_year, F.lit('"[PDAT])'))
    return out if override is None else F.coalesce(F.nullif(F.trim(override), F.lit("")), out)


def keyword_query(intervention, keywords: Column, most: int = 5) -> Column:
    """Up to five content words of the intervention, else of the keywords, longest first; cut before repeats go."""
    own = search_tokens(text_or_empty(intervention))
    longest = F.transform(F.array_sort(F.transform(keywords, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))), lambda s: s["k"])
    other = F.flatten(F.transform(longest, search_tokens))
    return F.array_join(F.array_distinct(F.slice(F.when(F.size(own) > 0, own).otherwise(other), 1, most)), " ")


def section_of(heading) -> Column:
    """Label of a heading by its beginning; others are OTHER."""
    h = F.lower(F.trim(heading))
    out = F.lit("OTHER")
    for label, names in reversed(SECTIONS.items()):
        for name in names:
            out = F.when(F.startswith(h, F.lit(name)), F.lit(label)).otherwise(out)
    return out


def text_sections(c) -> Column:
    """map label -> text of a paper's sections: a heading is a line of its own; what stands before is OTHER."""
    names = "|".join(n for ns in SECTIONS.values() for n in sorted(ns, key=len, reverse=True))
    pattern = rf"(?im)^[\x20\t]*(?:\d+\.?[\x20\t]*)?({names})[\x20\t]*:?[\x20\t]*$"
    heads, bodies = F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.transform(F.split(c, pattern), strip)
    parts = F.filter(F.arrays_zip(F.concat(F.array(F.lit("")), heads).alias("head"), bodies.alias("body")), lambda p: p["body"] != "")
    labelled = F.transform(parts, lambda p: F.struct(section_of(p["head"]).alias("label"), p["body"].alias("body")))
    labels = F.array_distinct(F.transform(labelled, lambda p: p["label"]))
    return F.map_from_arrays(labels, F.transform(labels, lambda x: F.array_join(F.transform(F.filter(labelled, lambda p: p["label"] == x), lambda p: p["body"]), "\n\n")))


def parse_quality(sections: Column) -> Column:
    """1.0 with methods and results, 0.5 with one of them, else 0.2."""
    m, r = F.map_contains_key(sections, F.lit("METHODS")), F.map_contains_key(sections, F.lit("RESULTS"))
    return F.when(m & r, 1.0).when(m | r, 0.5).otherwise(0.2)


def reply_element(c) -> Column:
    """A model's element text; blank and null-like replies are null."""
    return F.when(~F.lower(F.trim(text_or_empty(c))).isin("", "null", "none", "not identified", "n/a"), F.trim(c))


def verdict(c) -> Column:
    """INCLUDE only where the text says so and nothing of EXCLUDE."""
    up = F.upper(c)
    return F.when(F.contains(up, F.lit("INCLUDE")) & ~F.contains(up, F.lit("EXCLUDE")), "INCLUDE").otherwise("EXCLUDE")


def exclusion_reason(c, length: int = 200) -> Column:
    return F.substring(F.trim(F.regexp_extract(c, r"(?is)EXCLUDE[:\s]+(.+)", 1)), 1, length)


def conclusion(c) -> Column:
    """First paragraph after a Conclusion heading, else the last paragraph."""
    found = F.nullif(strip(F.regexp_extract(c, r"(?is)##\s*conclusions?[^\n]*\n+(.+?)(?:\n\s*\n|$)", 1)), F.lit(""))
    return F.coalesce(found, F.element_at(F.filter(F.split(strip(c), r"\n\s*\n"), lambda p: strip(p) != ""), -1))


def medline_doi(aid: Column, lid: Column) -> Column:
    """DOI of a record's AID field, else of its LID field: the first entry that ends in [doi]."""
    def first(entries: Column) -> Column:
        return F.get(F.filter(entries, lambda x: F.endswith(x, F.lit("[doi]"))), 0)

    return F.trim(F.regexp_replace(F.coalesce(first(aid), first(lid)), r"\s*\[doi\]$", ""))


def medline_year(dp) -> Column:
    head = F.get(F.split(dp, " "), 0)
    return F.when(head.rlike("^[0-9]+$"), head.cast("int"))
