"""Scalar expressions over names, questions and model output. Null gives null unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and phrases that routing results depend on.
STOPWORDS = (
    "a an the is are was were do does did can could would should will have has had be been being i you he she it we they "
    "me him her us them my your his its our in on at of to for with by from about into that this these those and or but not also just very please"
).split()
GREETINGS = ("hi ", "hello", "hey ", "thanks", "thank you", "ok", "okay", "good morning", "good afternoon", "good evening")
DENSE_PREFIXES = (
    "what is ", "what are ", "what was ", "what were ", "define ", "definition of ", "who is ", "who was ", "who invented ", "who discovered ",
    "when did ", "when was ", "when were ", "where is ", "where was ", "list ", "name ", "give an example of ", "how many ", "how much ", "which ",
)
GRAPH_PREFIXES = (
    "why ", "how does ", "how do ", "how did ", "how would ", "explain ", "describe the relationship", "compare ", "contrast ",
    "what is the difference", "what are the differences", "what is the relationship", "what is the connection", "what causes ", "what effect ", "in what way",
)
GRAPH_SIGNALS = (
    "compared to", "in comparison", "difference between", "relationship between", "connection between", "affect", "effect on", "impact on",
    "leads to", "results in", "causes", "in terms of", "with respect to", "similar to", "as opposed to", "contrast between", "trade-off",
    "why does", "why do", "why is",
)


def _of(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strip(text: str | Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_of(text), r"(?U)^\s+|\s+$", "")


def canon(name: str | Column) -> Column:
    """Stripped, lower-cased, runs of white space as one space: names that agree so are the same."""
    return F.regexp_replace(F.lower(strip(name)), r"(?U)\s+", " ")


def make_key(kind: str | Column, name: str | Column) -> Column:
    """`kind:` and twelve hex digits of the canonical name; null for a blank name, which has no key."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    clean = canon(name)
    return F.when(clean != "", F.concat(kind, F.lit(":"), F.substring(F.sha1(F.encode(clean, "UTF-8")), 1, 12)))


def norm_label(label: str | Column) -> Column:
    """A relation label in lower case with underscores; blank and null give related_to."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(_of(label)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("related_to"))


def node_text(name: str | Column, summary: str | Column) -> Column:
    """What of a node is embedded: "name. summary"."""
    return strip(F.concat(F.coalesce(_of(name), F.lit("")), F.lit(". "), F.coalesce(_of(summary), F.lit(""))))


def key_term_hit(terms: str | Column, question: str | Column) -> Column:
    """Whether any term, trimmed and in lower case, stands anywhere in the question."""
    lowered = F.lower(_of(question))
    return F.coalesce(F.exists(_of(terms), lambda t: (F.length(strip(t)) > 0) & F.contains(lowered, F.lower(strip(t)))), F.lit(False))


def name_hit(name: str | Column, question: str | Column) -> Column:
    return F.coalesce((F.length(_of(name)) > 0) & F.contains(F.lower(_of(question)), F.lower(_of(name))), F.lit(False))


def content_words(question: str | Column) -> Column:
    """Words of a-z alone that are no stop words, in order and with repeats."""
    words = F.regexp_extract_all(F.lower(_of(question)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: w.rlike("^[a-z]+$") & ~w.isin(STOPWORDS))


def _any_prefix(text: Column, prefixes: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(text, p))


def _any_phrase(text: Column, phrases: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def route_heuristic(question: str | Column) -> Column:
    """none, graph or dense by the first rule that fits; null where none does. A null question is blank."""
    q = F.lower(strip(F.coalesce(_of(question), F.lit(""))))
    return (
        F.when(q == "", "none")
        .when(_any_prefix(q, GRAPH_PREFIXES) | _any_phrase(q, GRAPH_SIGNALS), "graph")
        .when(_any_prefix(q, DENSE_PREFIXES), "dense")
        .when(_any_prefix(q, GREETINGS), "none")
        .when(F.size(content_words(q)) < 3, "none")
    )


def route(question: str | Column, classifier: Column | None = None) -> Column:
    """The heuristic's mode, else the classifier's, else dense."""
    return F.coalesce(route_heuristic(question), *([classifier] if classifier is not None else []), F.lit("dense"))


def parse_mode(response: str | Column) -> Column:
    """The mode that a classifier's words name: alone after quotes and stops go, else the first found of graph, none, dense; else dense."""
    low = F.lower(_of(response))
    word = F.regexp_replace(strip(low), "^[\"'.,]+|[\"'.,]+$", "")
    return F.when(word.isin("dense", "graph", "none"), word).when(F.contains(low, F.lit("graph")), "graph").when(F.contains(low, F.lit("none")), "none").otherwise("dense")


def strip_fences(raw: str | Column) -> Column:
    """Model output without a code fence around it."""
    return strip(F.regexp_replace(strip(raw), "(?i)^```(?:json)?\\s*|\\s*```$", ""))


#: Keys under which a model may wrap its list, the first one that holds a list counts.
WRAPPERS = ("items", "results", "data", "topics", "subtopics", "contents", "relations")


def parse_items(raw: str | Column) -> Column:
    """Objects of model output as array<variant>: of a list, of a wrapped list, or the lone object; else an empty array."""
    # worked out once a row and bound, as each of the cases below looks at it
    parsed = F.struct(F.try_parse_json(strip_fences(raw)).alias("value"))
    return F.get(F.transform(F.array(parsed), lambda x: _items_of(x["value"])), F.lit(0))


def _items_of(value: Column) -> Column:
    nothing = F.array().cast("array<variant>")

    def objects(items: Column) -> Column:
        return F.filter(items, lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))

    def held(path: str) -> Column:
        return F.try_variant_get(value, path, "array<variant>")

    kind = F.schema_of_variant(value)
    out = F.when(value.isNull(), nothing).when(F.startswith(kind, F.lit("ARRAY")), objects(held("$")))
    lone = F.startswith(kind, F.lit("OBJECT"))
    for key in WRAPPERS:
        inner = F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant"))
        out = out.when(lone & F.startswith(inner, F.lit("ARRAY")), objects(held(f"$.{key}")))
    return out.when(lone, F.array(value)).otherwise(nothing)


def truthy(value: Column) -> Column:
    """Whether a variant counts as true: any text but the empty one, any number but 0, any list or object but an empty one."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(value.isNull() | (kind == "VOID"), False)
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", text != "")
        .when(F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT")), ~text.isin("[]", "{}"))
        .otherwise(F.try_variant_get(value, "$", "double") != 0)
    )


def topic_cap(length: Column) -> Column:
    """How many topics a preview of that length may give."""
    return F.when(length < 500, 1).when(length < 1500, 2).otherwise(3)


def content_cap(length: Column) -> Column:
    """How many contents a chunk of that length may give."""
    return F.when(length < 500, 3).when(length < 1500, 5).when(length < 3000, 7).otherwise(10)


def clean_terms(terms: str | Column) -> Column:
    """Stripped terms without blanks, the first spelling of each kept."""
    kept = F.filter(F.transform(_of(terms), lambda t: strip(t)), lambda t: t != "")
    return F.aggregate(kept, F.array().cast("array<string>"), lambda acc, t: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(t)), acc).otherwise(F.concat(acc, F.array(t))))


# Kinds of illustrations.
ILLUSTRATION_KINDS = ("diagram", "equation", "code", "image")


def illustration(kind: str | Column, hint: str | Column, kinds: Sequence[str] = ILLUSTRATION_KINDS) -> Column:
    """struct(kind, hint), null unless the kind, in lower case and without white space around it, is known and the hint isn't blank."""
    clean = F.lower(strip(kind))
    return F.when(clean.isin(*kinds) & (strip(hint) != ""), F.struct(clean.alias("kind"), strip(hint).alias("hint")))


def to_seconds(stamp: str | Column) -> Column:
    """Seconds of M:S or H:M:S; null for anything else."""
    parts = F.transform(F.split(_of(stamp), ":"), lambda p: F.regexp_extract(p, r"^\s*([+-]?\d+)", 1).try_cast("long"))
    sound = ~F.exists(parts, lambda p: p.isNull())
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(sound & (F.size(parts) == 2), at(0) * 60 + at(1)).when(sound & (F.size(parts) == 3), at(0) * 3600 + at(1) * 60 + at(2))


def deep_link(base: Column, modality: Column, page: Column, stamp: Column) -> Column:
    """A source's address with #page= for paged files and #t= for timed ones, where that is known."""
    seconds = to_seconds(stamp)
    return (
        F.when(modality.isin("pdf", "slide") & page.isNotNull(), F.concat(base, F.lit("#page="), page.cast("string")))
        .when(modality.isin("video", "audio") & seconds.isNotNull(), F.concat(base, F.lit("#t="), seconds.cast("string")))
        .otherwise(base)
    )


def clock(seconds: Column) -> Column:
    """m:ss."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def sigmoid4(x: Column) -> Column:
    """The logistic function, rounded half to even at four digits."""
    return F.bround(1 / (1 + F.exp(-x)), 4)


def relationship_line(head: Column, relation: Column, tail: Column) -> Column:
    return F.concat(F.lit("- "), head, F.lit(" —["), relation, F.lit("]→ "), tail)


def to_text(value: Column) -> Column:
    """A variant as text: lists joined by spaces, null as empty."""
    items = F.array_join(F.try_variant_get(value, "$", "array<string>"), " ")
    return F.coalesce(F.when(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), items).otherwise(F.try_variant_get(value, "$", "string")), F.lit(""))
