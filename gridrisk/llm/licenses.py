"""License statements in texts, by ordered signature rules.

A text becomes its lower-cased words, each with a blank on both sides. Only rules whose keyword the words hold are tried. Of what they
match, a detection goes if one of a higher priority holds all its words, or one of the same priority that is longer or, for the same words,
earlier in the list. What a text has is worked out within its row: nothing is shuffled, written or sent to Python.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .license_rules import BASE, WEIGHTS, Rule, rules, widened

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RULE = "struct<id:int,label:string,priority:int,pattern:string>"
SPAN = "struct<start:int,end:int,priority:int,id:int,label:string>"
ADDED = ("n_words", "base", "first_word", "last_word", "licenses", "labels", "score")


def normal(text: Column) -> Column:
    """The lower-cased (A-Z) words of a text, each with a blank on both sides, and one more blank at either end."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_replace(F.translate(F.concat(F.lit(" "), F.coalesce(text.cast("string"), F.lit("")), F.lit(" ")), upper, upper.lower()), BETWEEN, "  ")


def n_words(part: Column) -> Column:
    """The number of words of some of normal()'s text; an odd blank is one of its ends."""
    return F.floor((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("int")


def any_of(keywords: list[str]) -> str:
    """A regex for the keywords that tries each letter once, however many keywords begin alike."""
    if keywords == [""]:
        return ""
    by: dict[str, list[str]] = {}
    for k in sorted(set(keywords)):
        by.setdefault(k[:1], []).append(k[1:])
    return f"(?:{'|'.join(first + (any_of(rest) if first else '') for first, rest in sorted(by.items(), reverse=True))})"


def grouped(given: list[Rule]) -> Column:
    """The rules by keyword, as a constant."""
    by: dict[str, list] = {}
    for r in given:
        by.setdefault(r.keyword, []).append({"id": r.id, "label": r.label, "priority": r.priority, "pattern": r.pattern})
    return F.from_json(F.lit(json.dumps([{"keyword": k, "rules": v} for k, v in by.items()])), f"array<struct<keyword:string,rules:array<{RULE}>>>")


def matches(words: Column, rule: Column) -> Column:
    """The places where a rule matches."""
    between = F.split(words, rule["pattern"], -1)
    found = F.regexp_extract_all(words, rule["pattern"], F.lit(0))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + n_words(x["between"])
        end = start + n_words(x["found"])
        return F.struct(end.alias("at"), F.array_append(s["spans"], F.struct(start.alias("start"), end.alias("end"), rule["priority"].alias("priority"), rule["id"].alias("id"), rule["label"].alias("label"))).alias("spans"))

    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, f: F.struct(b.alias("between"), f.alias("found")))
    return F.aggregate(pairs, none, step, lambda s: s["spans"])


def unsuppressed(spans: Column, priorities: int = 4) -> Column:
    """The spans that no other suppresses, in order.

    In order of start, then of falling end and priority, all spans that could hold a span come before it, so one pass with
    the furthest end so far by priority decides.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), (-s["priority"]).alias("last"), s["id"].alias("id"), s["label"].alias("label"))))
    start = F.struct(F.array_repeat(F.lit(0), priorities).alias("ends"), F.array().cast(f"array<{SPAN}>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        held = F.array_max(F.slice(s["ends"], -x["last"], priorities)) >= -x["back"]
        ends = F.transform(s["ends"], lambda e, k: F.when(k + 1 == -x["last"], F.greatest(e, -x["back"])).otherwise(e))
        span = F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), (-x["last"]).alias("priority"), x["id"].alias("id"), x["label"].alias("label"))
        return F.struct(ends.alias("ends"), F.when(held, s["kept"]).otherwise(F.array_append(s["kept"], span)).alias("kept"))

    return F.aggregate(ordered, start, step, lambda s: s["kept"])


def scan(docs: DataFrame, given: list[Rule] | None = None) -> DataFrame:
    """docs with what their texts say of licenses.

    n_words; base, the number of places of each phrase of BASE by label; first_word and last_word, the smallest and largest start of those
    places (null without any); licenses, the spans (start, end, priority, id, label; word numbers from 0, end exclusive) of the rules;
    labels of both, sorted; and score, 0 to 1: one less the product over labels of one less their greatest weight.

    A null or empty text, or one without words, has no places and no labels, and score 0. Repeated rows stay, each for itself; an empty
    table stays empty. Columns of docs called like an added one are replaced. Places of one rule don't overlap, as a regex finds them.
    """
    d = docs.drop(*ADDED)
    given = rules() if given is None else given
    words_name, parts_name, keywords_name = (common.free_name(d, c) for c in ("words", "parts", "keywords"))
    words, parts, keywords = F.col(words_name), F.col(parts_name), F.col(keywords_name)
    d = d.withColumn(words_name, normal(F.col("text"))).withColumn("n_words", n_words(words).cast("long") - 1)
    split = [F.when(F.contains(words, F.lit(widened(p))), F.split(words, widened(p), -1)).otherwise(F.array(words)) for p in BASE]
    d = d.withColumn(parts_name, F.array(*split))
    places = [F.when(F.size(parts[k]) > 1, F.struct(n_words(parts[k][0]).alias("first"), (F.col("n_words") - n_words(F.element_at(parts[k], -1)) - len(p.split())).alias("last"))) for k, p in enumerate(BASE)]
    d = d.withColumns({
        "base": F.array(*[F.struct(F.lit(label).alias("label"), (F.size(parts[k]) - 1).cast("long").alias("n")) for k, label in enumerate(BASE.values())]),
        "first_word": F.least(*[p["first"].cast("long") for p in places]),
        "last_word": F.greatest(*[p["last"].cast("long") for p in places]),
    }).drop(parts_name)
    d = d.withColumn(keywords_name, F.array_distinct(F.regexp_extract_all(words, F.lit(f" ({any_of([r.keyword for r in given])}) "), F.lit(1))))
    tried = F.flatten(F.transform(F.filter(grouped(given), lambda g: F.array_contains(keywords, g["keyword"])), lambda g: g["rules"]))
    hit = F.filter(tried, lambda r: F.rlike(words, r["pattern"]))
    spans = unsuppressed(F.flatten(F.transform(hit, lambda r: matches(words, r))))
    d = d.withColumn("licenses", F.when(F.size(keywords) > 0, spans).otherwise(F.array().cast(f"array<{SPAN}>"))).drop(words_name, keywords_name)
    based = F.filter("base", lambda b: b["n"] > 0)
    d = d.withColumn("labels", F.array_sort(F.array_distinct(F.concat(F.transform(based, lambda b: b["label"]), F.transform("licenses", lambda s: s["label"])))))
    best = F.transform("labels", lambda label: F.greatest(
        F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p, w in WEIGHTS.items() if p != "base" for x in (p, w)]), F.array_max(F.transform(F.filter("licenses", lambda s: s["label"] == label), lambda s: s["priority"]))), F.lit(0.0)),
        F.when(F.exists(based, lambda b: b["label"] == label), WEIGHTS["base"]).otherwise(0.0),
    ))
    return d.withColumn("score", 1 - F.aggregate(best, F.lit(1.0), lambda a, w: a * (1 - w)))
