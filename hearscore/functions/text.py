"""Text normalisation, transcript clean-up and names, as native expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------
# Normalisation names, in the order in which they are documented.
NORM_TYPES = ("none", "lowercase", "whitespace", "punctuation", "tags", "dictionary", "all")
# Words containing one of these (in any case) are dropped by tag removal.
DEFAULT_TAGS = ("<unk>", "<silence>", "trunc")
# Hypothesis values that stand for "nothing usable was recognised".
SENTINELS = ("EMPTY", "INVALID")
# -----------------------------------------------------------------------------

# Fixed value: the characters that count as whitespace, as ranges.
_SPACE_RANGES = (
    (0x09, 0x0D),
    (0x1C, 0x20),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
)
_SPACES = "".join(chr(c) for low, high in _SPACE_RANGES for c in range(low, high + 1))


# Regex classes, spelled out: the Unicode property is slower to match and
# lacks U+001C..U+001F.
_SPACE = "[" + "".join(f"\\u{low:04x}-\\u{high:04x}" for low, high in _SPACE_RANGES) + "]"
_OTHER_SPACE = _SPACE.replace(r"\u001c-\u0020", r"\u001c-\u001f")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column | str) -> Column:
    """Remove Unicode whitespace from both ends."""
    return F.trim(_col(c), F.lit(_SPACES))


def left_strip(c: Column | str) -> Column:
    return F.ltrim(_col(c), F.lit(_SPACES))


def split_words(c: Column | str) -> Column:
    """Words between runs of Unicode whitespace."""
    return F.filter(F.split(_col(c), f"{_SPACE}+"), lambda w: w != "")


def single_spaced(c: Column | str) -> Column:
    """The words of ``split_words`` joined with spaces, without making them:
    only what is not a single space already is touched."""
    return strip(F.regexp_replace(_col(c), f"{_SPACE}{{2,}}|{_OTHER_SPACE}", " "))


def norm_none(c: Column | str) -> Column:
    return _col(c)


def norm_lowercase(c: Column | str) -> Column:
    return F.lower(_col(c))


def norm_whitespace(c: Column | str) -> Column:
    """ASCII whitespace becomes a space, runs become one space, ends go."""
    return strip(F.regexp_replace(_col(c), rf"{_SPACE}{{2,}}|[\t\n\r\x0B\f]", " "))


def norm_punctuation(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"\p{P}", "")


def norm_tags(c: Column | str, tags: Sequence[str] = DEFAULT_TAGS) -> Column:
    """Drop words that contain a tag, join the others with single spaces.

    Words are taken apart only in texts that contain a tag somewhere.
    """
    lowered = [F.lit(tag.lower()) for tag in tags]

    def has_tag(text: Column) -> Column:
        return _once(
            F.lower(text),
            lambda low: reduce(lambda a, b: a | b, (F.contains(low, t) for t in lowered), F.lit(False)),
        )

    def clean(text: Column) -> Column:
        words = F.filter(split_words(text), lambda w: ~has_tag(w))
        return F.when(has_tag(text), F.array_join(words, " ")).otherwise(single_spaced(text))

    return _once(_col(c), clean)


def norm_all(c: Column | str) -> Column:
    return norm_tags(norm_punctuation(norm_whitespace(norm_lowercase(c))))


_NORMALISERS: dict[str, Callable[[Column | str], Column]] = {
    "none": norm_none,
    "lowercase": norm_lowercase,
    "whitespace": norm_whitespace,
    "punctuation": norm_punctuation,
    "tags": norm_tags,
    "all": norm_all,
}


def check_norm_types(names: Sequence[str]) -> list[str]:
    for name in names:
        if name not in NORM_TYPES:
            raise ValueError(f"unknown normalisation {name!r}; known: {', '.join(NORM_TYPES)}")
        if name not in _NORMALISERS:
            raise NotImplementedError(f"normalisation {name!r} is not available")
    return list(names)


def normalise(c: Column | str, norm_type: str) -> Column:
    (name,) = check_norm_types([norm_type])
    return _NORMALISERS[name](c)


def word_count(c: Column | str) -> Column:
    """Whitespace-separated words; 0 for NULL and empty text."""
    text = F.coalesce(single_spaced(c), F.lit(""))
    spaces = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(spaces + 1)


def transcript_cleanup(c: Column | str) -> Column:
    """Undouble quotes, drop one enclosing pair, end with a stop mark."""
    text = F.replace(_col(c), F.lit('""'), F.lit('"'))
    quoted = F.startswith(text, F.lit('"')) & F.endswith(text, F.lit('"'))
    bare = F.when(quoted, F.regexp_replace(text, r'^"([^\n]*)"\z', "$1")).otherwise(text)
    return F.when(bare.rlike(r"[.?!]\z"), bare).otherwise(F.concat(bare, F.lit(".")))


def clip_id(path: Column | str) -> Column:
    """Last component of a path, ignoring trailing separators and dots."""
    tail = F.substring_index(F.regexp_replace(_col(path), r"(?:/\.?)+\z", ""), "/", -1)
    return F.when(tail == ".", F.lit("")).otherwise(tail)


def dataset_short_name(name: Column | str) -> Column:
    return F.substring_index(_col(name), "/", -1)


def codename(provider: Column | str, model: Column | str, language: Column | str) -> Column:
    joined = F.concat(
        F.lower(_col(provider)), F.lit("_"), F.lower(_col(model)), F.lit("_"), F.lower(_col(language))
    )
    return F.translate(joined, "/", "_")


def display_name(provider: Column | str, model: Column | str) -> Column:
    return F.concat(F.upper(_col(provider)), F.lit(" - "), F.upper(_col(model)))


def default_version(day: Column | str) -> Column:
    """Year and calendar quarter, such as ``2025Q1``."""
    return F.concat(F.year(_col(day)), F.lit("Q"), F.quarter(_col(day)))


def hypothesis_or_sentinel(c: Column | str) -> Column:
    """What is stored for a raw recogniser answer: leading whitespace goes,
    an empty answer is EMPTY, no answer (after its retry) is INVALID."""
    trimmed = left_strip(c)
    return (
        F.when(_col(c).isNull(), F.lit("INVALID"))
        .when(trimmed == "", F.lit("EMPTY"))
        .otherwise(trimmed)
    )


def is_valid_pair(ref: Column | str, hyp: Column | str) -> Column:
    """Both sides present and the hypothesis not a sentinel (raw text)."""
    return _col(hyp).isNotNull() & ~_col(hyp).isin(*SENTINELS) & _col(ref).isNotNull()
