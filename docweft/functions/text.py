"""Column functions over text: inline tokens, slugs, warnings, letters, citations, scalars of front matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as white space in source text, as a character class body.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: Fixed value: the private-use character that stands for a resolved no-break space.
RESOLVED_SPACE, NO_BREAK_SPACE = "\ue000", "\u00a0"
#: Glyphs of smart punctuation by kind.
GLYPHS = {
    "ellipsis": "…",
    "em_dash": "—",
    "en_dash": "–",
    "left_right_arrow": "↔",
    "rightwards_arrow": "→",
    "leftwards_arrow": "←",
    "rightwards_double_arrow": "⇒",
    "less_than_or_equal": "≤",
    "greater_than_or_equal": "≥",
    "not_equal": "≠",
    "plus_minus": "±",
    "copyright": "©",
    "registered": "®",
    "trademark": "™",
}
#: Spellings of booleans and null in front matter.
YAML_TRUE, YAML_FALSE = "y|Y|yes|Yes|YES|true|True|TRUE|on|On|ON", "n|N|no|No|NO|false|False|FALSE|off|Off|OFF"
YAML_NULL = "~|null|Null|NULL"


def strip(text: Column) -> Column:
    """text without white space at its ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def resolved_spaces(text: Column) -> Column:
    return F.translate(text, RESOLVED_SPACE, NO_BREAK_SPACE)


def inline_tokens(text: Column) -> Column:
    """array of (t, c): Str with its text, or Space for each run of spaces."""
    return F.transform(
        F.regexp_extract_all(resolved_spaces(text), F.lit("( +)|([^ ]+)"), F.lit(0)),
        lambda p: F.struct(F.when(p.startswith(" "), "Space").otherwise("Str").alias("t"), F.when(~p.startswith(" "), p).alias("c")),
    )


def verbatim_tokens(text: Column) -> Column:
    """array of (t, c) as inline_tokens(), but with one Space for each space."""
    return F.transform(
        F.regexp_extract_all(resolved_spaces(text), F.lit("( )|([^ ]+)"), F.lit(0)),
        lambda p: F.struct(F.when(p == " ", "Space").otherwise("Str").alias("t"), F.when(p != " ", p).alias("c")),
    )


def slugify(text: Column) -> Column:
    """A heading's identifier: letters, numbers, underscores and hyphens, case kept, white space as hyphens."""
    kept = F.regexp_replace(strip(text), rf"[^\p{{L}}\p{{N}}{SPACE}_-]", "")
    return F.regexp_replace(kept, f"[{SPACE}]+", "-")


def shortened(text: Column, most: int = 80) -> Column:
    """One line of at most `most` characters for a warning."""
    flat = strip(F.regexp_replace(text, f"[{SPACE}]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def panel_letter(index: Column) -> Column:
    """a, b, ..., z, aa, ab, ... for index 0, 1, ...: base 26 without a zero, up to eight letters."""
    step = lambda s, _: F.when(
        s["i"] > 0,
        F.struct(F.floor((s["i"] - 1) / 26).alias("i"), F.concat(F.chr((97 + (s["i"] - 1) % 26).cast("int")), s["out"]).alias("out")),
    ).otherwise(s)
    start = F.struct((index.cast("long") + 1).alias("i"), F.lit("").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step, lambda s: s["out"])


def smart_glyph(kind: Column, glyph: Column, value: Column) -> Column:
    """A mark's own glyph, else that of its kind, else its source."""
    table = F.create_map(*[F.lit(x) for pair in GLYPHS.items() for x in pair])
    return F.coalesce(F.nullif(glyph, F.lit("")), F.try_element_at(table, kind), value, F.lit(""))


def autolink_class(href: Column) -> Column:
    return F.when(href.startswith("mailto:"), "email").otherwise("uri")


def task_marker(checked: Column) -> Column:
    """The box of a task item with its space; empty where the item is no task."""
    return F.when(checked, "☒ ").when(~checked, "☐ ").otherwise("")


def cited_keys(raw: Column) -> Column:
    """Keys after unescaped at signs, without trailing punctuation."""
    found = F.regexp_extract_all(raw, F.lit(r"(^|[^\\])@([^\s;,\]]+)"), F.lit(2))
    return F.transform(found, lambda k: F.regexp_replace(k, "[.,;:]+$", ""))


def unquoted(text: Column) -> Column:
    """text without one pair of equal quotes around it."""
    t = strip(text)
    quoted = (F.length(t) > 1) & ((t.startswith('"') & t.endswith('"')) | (t.startswith("'") & t.endswith("'")))
    return F.when(quoted, t.substr(F.lit(2), F.length(t) - 2)).otherwise(t)


def yaml_kind(raw: Column) -> Column:
    """What a front-matter scalar is read as."""
    whole = lambda p: raw.rlike(f"^({p})$")
    return (
        F.when(F.regexp_replace(raw, f"[{SPACE}]+", "") == "{}", "MetaMap")
        .when(raw.startswith("[") & raw.endswith("]"), "MetaList")
        .when(whole(YAML_TRUE) | whole(YAML_FALSE), "MetaBool")
        .when(whole(YAML_NULL), "MetaString")
        .otherwise("MetaInlines")
    )


def yaml_scalar(text: Column) -> Column:
    """A scalar as front matter writes it: bare if safe, else a JSON string."""
    as_json = F.regexp_extract(F.to_json(F.struct(text.alias("s"))), r"(?s)^\{\"s\":(.*)\}$", 1)
    return F.when(text.rlike(r"^[A-Za-z0-9][A-Za-z0-9 ._/-]*$"), text).otherwise(as_json)


def yaml_key(text: Column) -> Column:
    as_json = F.regexp_extract(F.to_json(F.struct(text.alias("s"))), r"(?s)^\{\"s\":(.*)\}$", 1)
    return F.when(text.rlike(r"^[A-Za-z0-9_][A-Za-z0-9_.-]*$"), text).otherwise(as_json)


def base64url(data: Column) -> Column:
    """Base 64 in the alphabet of URLs, without padding or line breaks."""
    plain = F.regexp_replace(F.base64(data.cast("binary")), r"[\r\n=]", "")
    return F.translate(plain, "+/", "-_")


def from_base64url(text: Column) -> Column:
    """The bytes of base64url(); null for anything else."""
    plain = F.translate(text, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)).cast("int")))
    return F.when(text.rlike("^[A-Za-z0-9_-]*$") & (F.length(text) % 4 != 1), F.try_to_binary(padded, F.lit("base64")))
