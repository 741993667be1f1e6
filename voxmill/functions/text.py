"""Text functions: white space as Unicode has it, word and character error rates, language tags, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .edits import distance, edits

SPACE_CLASS = r"[\s\x1c-\x1f\x85\p{Z}]+"

# Tags of the translation model for language codes.
LANGUAGE_TAGS = {
    "en": "eng_Latn",
    "hi": "hin_Deva",
    "ta": "tam_Taml",
    "te": "tel_Telu",
    "ml": "mal_Mlym",
    "mr": "mar_Deva",
    "bn": "ben_Beng",
    "gu": "guj_Gujr",
    "kn": "kan_Knda",
    "or": "ory_Orya",
    "pa": "pan_Guru",
    "ur": "urd_Arab",
    "as": "asm_Beng",
}


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (trim() knows spaces only)."""
    return F.regexp_replace(text, f"^{SPACE_CLASS}|{SPACE_CLASS}$", "")


def words(text: Column) -> Column:
    """Words of a text; an empty or blank one has none."""
    one = F.regexp_replace(strip(text), SPACE_CLASS, " ")
    return F.when(one == "", F.array().cast("array<string>")).otherwise(F.split(one, " "))


def bind(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def distance_of(a: Column, b: Column) -> Column:
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda s: distance(s.a, s.b))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Word edits over reference words. Each distinct word of a pair becomes one code point above U+10000, so that
    levenshtein() counts words. Null where the reference has no words."""

    def coded(own: Column, vocabulary: Column) -> Column:
        point = lambda w: F.lpad(F.hex(F.array_position(vocabulary, w) + 0x10000), 8, "0")
        return F.decode(F.unhex(F.array_join(F.transform(own, point), "")), "UTF-32")

    both = F.struct(words(reference).alias("r"), words(hypothesis).alias("h"))
    edits = lambda s: bind(F.array_distinct(F.concat(s.r, s.h)), lambda v: distance_of(coded(s.r, v), coded(s.h, v)))
    return bind(both, lambda s: F.when(F.size(s.r) > 0, edits(s) / F.size(s.r)))


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Substitutions, deletions and insertions of words, as a struct."""
    return edits(words(reference), words(hypothesis))


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Character edits over reference characters, both stripped. Null where the reference is empty."""
    both = F.struct(strip(reference).alias("r"), strip(hypothesis).alias("h"))
    return bind(both, lambda s: F.when(F.char_length(s.r) > 0, distance(s.r, s.h) / F.char_length(s.r)))


def language_tag(code: Column) -> Column:
    """The model's tag for a language code; a code without one is its own tag."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGE_TAGS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, code), code)


def prompt(source: Column, target: Column, text: Column) -> Column:
    return F.concat_ws(" ", language_tag(source), language_tag(target), text)


def chunk_name(ordinal: Column) -> Column:
    """chunk_0000.wav and on, wider from 10,000."""
    return F.format_string("chunk_%04d.wav", ordinal)
