"""Text expressions: cleaning, normalising, tokens, classification and overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: stop words, and words too general to carry a sentence's content
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the", "to", "what", "when", "where", "which", "who", "why", "with", "you", "your"]
GENERIC = ["this", "that", "these", "those", "was", "were", "has", "have", "had", "not", "but", "can", "may"]


def array_of(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def clean(text: Column) -> Column:
    """LF line ends, single blanks, no bare page numbers, at most one blank line, trimmed."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"(?m)^ *[0-9]+ *$", "")
    t = F.regexp_replace(t, r"\n{2,}", "\n\n")
    return F.btrim(t, F.lit(" \n"))


def normalise_span(text: Column) -> Column:
    """Lower case without soft hyphens, zero-width signs and hyphens at line ends; others than letters, digits to blanks."""
    t = F.regexp_replace(F.lower(text), "­ *", "")
    t = F.regexp_replace(t, "[​‌‍﻿]", "")
    t = F.regexp_replace(t, r"-\n", "")
    return F.btrim(F.regexp_replace(t, r"[^a-z0-9à-öø-ÿ]+", " "), F.lit(" "))


def file_key(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\.pdf$", ""), r"[^a-z0-9]+", "")


def title_key(title: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", " "), F.lit(" "))


def split_words(text: Column) -> Column:
    """Lower-cased pieces between white space, Unicode's included."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def terms(text: Column) -> Column:
    """Runs of three or more ASCII letters, lower-cased, without stop words, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(STOP_WORDS))


def content_tokens(text: Column, generic: bool = False) -> Column:
    """Letter runs longer than one without stop words; with generic, without general words too."""
    gone = STOP_WORDS + (GENERIC if generic else [])
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(gone))


def letter_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z']+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences by a blank after an end mark and before a capital."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=\p{Lu})"), lambda s: F.trim(s) != "")


def first_match(text: Column, rules: list[tuple[str, str]], other: str = "UNKNOWN") -> tuple[Column, Column]:
    """(label, confidence) of the first pattern that matches: HIGH within 1500 characters, else MEDIUM."""
    label, confidence = F.lit(other), F.lit("NONE")
    for name, pattern in reversed(rules):
        hit = F.regexp_instr(text, F.lit(f"({pattern})"))
        label = F.when(hit > 0, name).otherwise(label)
        confidence = F.when(hit > 0, F.when(hit <= 1500, "HIGH").otherwise("MEDIUM")).otherwise(confidence)
    return label, confidence


def license_category(text: Column) -> Column:
    t = F.lower(text)
    cc = t.contains("creative commons") | t.contains("cc0") | t.contains("cc-by") | t.contains("cc by") | t.contains("creativecommons")
    closed = t.contains("-nc") | t.contains("-nd") | t.contains("noncommercial") | t.contains("noderiv")
    return F.when(cc & closed, "RESTRICTED").when(cc, "PERMISSIVE").otherwise("UNKNOWN")


# fixed values: authority by publisher, first match wins
AUTHORITY = [("WHO", 1.0), ("NIA", 0.95), ("NIH", 0.95), ("CDC", 0.95), ("GOVERNMENT", 0.9), ("OTHER", 0.85), ("UNKNOWN", 0.5)]


def authority(name: Column, text: Column) -> Column:
    """The publisher named in the source's name or the text's first 2000 characters."""
    s = F.lower(F.concat_ws(" ", name, F.substring(text, 1, 2000)))
    return (
        F.when(s.contains("world health organization"), "WHO").when(s.contains("national institute on aging"), "NIA").when(s.contains("national institutes of health"), "NIH")
        .when(s.contains("centers for disease control"), "CDC").when(s.contains(".gov") | s.contains("government"), "GOVERNMENT").when(F.length(name) > 0, "OTHER").otherwise("UNKNOWN")
    )


def authority_score(label: Column) -> Column:
    out = F.lit(0.5)
    for name, score in reversed(AUTHORITY):
        out = F.when(label == name, score).otherwise(out)
    return out


def keyword_score(fields: list[tuple[Column, float]], words: list[str]) -> Column:
    """How often any of the words is a field's word, by each field's weight."""
    total = F.lit(0.0)
    for field, weight in fields:
        found = F.filter(F.regexp_extract_all(F.lower(field), F.lit("[a-z0-9à-öø-ÿ]+"), F.lit(0)), lambda w: w.isin(words))
        total = total + F.coalesce(F.size(found), F.lit(0)) * F.lit(weight)
    return total


def fuzzy_equal(x: Column, y: Column) -> Column:
    """Equal, or five letters in common at the start of six or more, or one within the other from four on."""
    prefix = (F.length(x) >= 6) & (F.length(y) >= 6) & (F.substring(x, 1, 5) == F.substring(y, 1, 5))
    within = (F.length(x) >= 4) & (F.length(y) >= 4) & (F.contains(x, y) | F.contains(y, x))
    return (x == y) | prefix | within


def fuzzy_share(a: Column, b: Column) -> Column:
    """How many of a's tokens have a fuzzy equal in b."""
    return F.size(F.filter(a, lambda x: F.exists(b, lambda y: fuzzy_equal(x, y))))


def coverage(span: Column, evidence: Column) -> Column:
    """The share of the span's tokens, repeated ones too, that the evidence holds; 1 without tokens."""
    hit = F.size(F.filter(span, lambda w: F.array_contains(evidence, w)))
    return F.when(F.size(span) == 0, 1.0).otherwise(F.round(hit / F.size(span), 4))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def answer_only(text: Column) -> Column:
    """An answer without thinking, its label and its sources."""
    t = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(F.substring_index(t, "\nSources:", 1), r"^\s*Answer:\s*", ""))


def language(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin("ko", "en"), v).otherwise("en")


def listed(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
