"""Text functions: stripping, letter counts, choosing between readings, JSON answers, ids, content hashes."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence of the reader that gives none (a fixed value).
DEFAULT_CONFIDENCE = 0.85
REQUIRED = ("action_description", "setting", "mood")


def strip(s: Column) -> Column:
    """White space of any script off both ends; trim() knows the space only."""
    return F.regexp_replace(s, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def letters(s: Column) -> Column:
    return F.length(F.regexp_replace(s, r"[^\p{L}]", "")).cast("long")


def joined_words(words: Column) -> Column:
    """Words that are not blank, with single spaces."""
    return F.array_join(F.filter(F.transform(words, strip), lambda w: w != ""), " ")


def word_confidence(words: Column, confidences: Column) -> Column:
    """Mean confidence, as a share, of words that are not blank and have one; 0 without any."""
    good = F.filter(F.zip_with(words, confidences, lambda w, c: F.when((strip(w) != "") & (c >= 0), c.cast("double"))), lambda c: c.isNotNull())
    total = F.aggregate(good, F.lit(0.0), lambda a, c: a + c)
    return F.when(F.size(good) > 0, total / F.greatest(F.size(good), F.lit(1)) / 100.0).otherwise(F.lit(0.0))


def chosen_reading(first: Column, second: Column, second_confidence: Column) -> Column:
    """The reading with more letters; the first on a tie, with the default confidence."""
    second_wins = letters(F.coalesce(second, F.lit(""))) > letters(F.coalesce(first, F.lit("")))
    return F.struct(
        F.when(second_wins, second).otherwise(first).alias("text"),
        F.when(second_wins, second_confidence.cast("double")).otherwise(F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
        F.when(second_wins, F.lit("second")).otherwise(F.lit("first")).alias("source"),
    )


def json_object(s: Column) -> Column:
    """From the first opening to the last closing brace; null if there is none."""
    return F.nullif(F.regexp_extract(s, r"(?s)\{.*\}", 0), F.lit(""))


def answer(s: Column) -> Column:
    """A model's answer parsed: status (ok, no_object, malformed, missing_field) and the fields, stripped.

    The list is empty unless it is a list; blank entries go. A null value reads "None", as text made from it does in Python.
    """
    found = json_object(s)
    value = F.try_parse_json(found)
    as_text = lambda p: F.coalesce(strip(F.try_variant_get(value, p, "string")), F.lit("None"))
    names = F.json_object_keys(found)
    missing = ~F.forall(F.array(*map(F.lit, REQUIRED)), lambda k: F.array_contains(names, k))
    status = F.when(found.isNull(), "no_object").when(value.isNull() | names.isNull(), "malformed").when(missing, "missing_field").otherwise("ok")
    ok = status == "ok"
    heard = F.coalesce(F.try_variant_get(value, "$.onomatopoeia", "array<string>"), F.array().cast("array<string>"))
    fields = [F.when(ok, as_text(f"$.{k}")).alias(k) for k in REQUIRED]
    sounds = F.filter(F.transform(heard, lambda o: strip(F.coalesce(o, F.lit("None")))), lambda o: o != "")
    return F.struct(status.alias("status"), *fields, F.when(ok, sounds).alias("onomatopoeia"))


def strict_answer(s: Column) -> Column:
    """answer() of a text that must be the object and nothing else, with texts and a list of texts; any other text fails the query."""
    value = F.try_parse_json(s)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant"))
    good = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    for k in REQUIRED:
        good = good & F.coalesce(kind(k) == "STRING", F.lit(False))
    good = good & F.coalesce(kind("onomatopoeia").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
    return F.when(good, answer(s)).otherwise(F.raise_error(F.concat(F.lit("no such answer: "), F.coalesce(F.substring(s, 1, 200), F.lit("null")))).cast("void"))


def verdict(s: Column, field: str = "same_character") -> Column:
    """The truth of a field of a JSON answer as Python sees it: a text is true unless empty; null if there is no such field."""
    value = F.try_parse_json(json_object(s))
    at = F.try_variant_get(value, f"$.{field}", "variant")
    kind, text = F.schema_of_variant(at), F.try_variant_get(value, f"$.{field}", "string")
    false = (kind == "VOID") | ((kind == "BOOLEAN") & (text == "false")) | ((kind == "STRING") & (text == "")) | text.isin("0", "0.0", "[]", "{}") & (kind != "STRING")
    return F.when(at.isNotNull(), ~F.coalesce(false, F.lit(False)))


def numbered_id(prefix: Column, mark: str, i: Column) -> Column:
    """prefix_p007: padded to three digits, never cut."""
    return F.format_string(f"%s_{mark}%03d", prefix.cast("string"), i)


def character_id(i: Column) -> Column:
    return F.format_string("char_%03d", i)


def canonical(config: dict[str, Any] | None) -> str:
    """A configuration as text; the same for equal configurations. Empty and None are the empty text."""
    return json.dumps(config, sort_keys=True) if config else ""


def content_hash(data: Column, config: dict[str, Any] | None = None) -> Column:
    """First 16 hex digits of SHA-256 over the bytes and the canonical configuration."""
    raw = F.concat(F.coalesce(data.cast("binary"), F.lit(b"")), F.lit(canonical(config).encode()))
    return F.substring(F.sha2(raw, 256), 1, 16)


def content_hash_of(data: bytes = b"", config: dict[str, Any] | None = None) -> str:
    return hashlib.sha256(data + canonical(config).encode()).hexdigest()[:16]
