"""Scalar expressions over raw JSON fields. All of them stay inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from deckspark.functions.formats import COLOR_BITS, literal_map

# What a Unicode-aware strip removes, beyond the plain space.
WHITESPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)


def filled(text: Column) -> Column:
    """The text, or NULL where it is empty."""
    return F.nullif(text, F.lit(""))


def first_filled(*texts: Column) -> Column:
    """First text that is neither null nor empty; the last one is taken as it is."""
    return F.coalesce(*[filled(t) for t in texts[:-1]], texts[-1])


def first_nonempty(*arrays: Column) -> Column:
    """First array with an element; the last one is taken as it is."""
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays[:-1]], arrays[-1])


def color_bit(letter: Column) -> Column:
    clean = F.upper(F.btrim(letter, F.lit(WHITESPACE)))
    return F.coalesce(F.element_at(literal_map(COLOR_BITS), clean), F.lit(0))


def color_mask(letters: Column) -> Column:
    """Colour letters folded to a bit mask; null and unknown letters count as no colour."""
    fold = F.aggregate(letters, F.lit(0), lambda mask, x: mask.bitwiseOR(color_bit(x)))
    return F.coalesce(fold, F.lit(0))


def color_mask_text(letters: Column) -> Column:
    """The same for a comma-separated text."""
    return color_mask(F.split(letters, ","))


def flag(value: Column) -> Column:
    """A VARIANT of any JSON type as 0/1.

    Booleans count as they are and texts only when they spell "true"; numbers,
    arrays and objects count when they are not zero or empty.
    """
    kind = F.schema_of_variant(value)
    text = F.to_json(value)
    return (
        F.when(value.isNull() | F.is_variant_null(value), 0)
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int"))
        .when(
            kind == "STRING",
            (F.lower(F.try_variant_get(value, "$", "string")) == "true").cast("int"),
        )
        .when(text.isin("[]", "{}"), 0)
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), 1)
        .otherwise((F.try_variant_get(value, "$", "double") != 0).cast("int"))
        .cast("short")
    )


def preferred_image(uris: Column) -> Column:
    return F.coalesce(
        filled(F.try_element_at(uris, F.lit("normal"))),
        filled(F.try_element_at(uris, F.lit("large"))),
        F.try_element_at(F.map_values(uris), F.lit(1)),
    )


def image_uri(uris: Column, faces: Column) -> Column:
    """Image of the card, or of its first face when the card has no image map."""
    front = F.try_element_at(faces, F.lit(1))
    return F.when(F.size(uris) > 0, preferred_image(uris)).otherwise(
        preferred_image(front["image_uris"])
    )


def _quoted(text: Column) -> Column:
    """JSON string literal with lower-case \\u escapes and raw non-ASCII."""
    wrapped = F.to_json(F.array(text))
    plain = F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)
    # Only control characters need spelling out: the writer's hex digits are upper-case.
    steps = [("\\", "\\\\"), ('"', '\\"')]
    steps += [(short, escape) for short, escape in zip("\b\t\n\f\r", ("\\b", "\\t", "\\n", "\\f", "\\r"))]
    steps += [(chr(c), f"\\u{c:04x}") for c in range(32) if chr(c) not in "\b\t\n\f\r"]
    spelled = reduce(lambda acc, s: F.replace(acc, F.lit(s[0]), F.lit(s[1])), steps, text)
    spelled = F.concat(F.lit('"'), spelled, F.lit('"'))
    return F.when(text.rlike("[\\x00-\\x1f]"), spelled).otherwise(plain)


def json_list_text(words: Column) -> Column:
    """A list of texts as JSON with ", " between the items; null gives "[]"."""
    items = F.transform(words, lambda w: F.when(w.isNull(), F.lit("null")).otherwise(_quoted(w)))
    body = F.coalesce(F.array_join(items, ", "), F.lit(""))
    return F.concat(F.lit("["), body, F.lit("]"))


def search_name(card_name: Column) -> Column:
    """Front face of a double-faced name."""
    return F.substring_index(card_name, " // ", 1)


def sweep_mode(ever_swept: Column) -> Column:
    return F.when(ever_swept, "incremental").otherwise("full")


def to_instant(text: Column) -> Column:
    return F.try_to_timestamp(text)
