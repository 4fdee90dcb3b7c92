"""Column functions that normalise names of the index (pure Catalyst expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTES = "[`\"\\[\\]]"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_blanks(c: Column | str) -> Column:
    """Without white space at either end (any white space, not only blanks)."""
    return F.regexp_replace(as_column(c), r"^\s+|\s+$", "")


def strip_quotes(c: Column | str) -> Column:
    """Without identifier quotes at either end."""
    return F.regexp_replace(as_column(c), f"^{_QUOTES}+|{_QUOTES}+$", "")


def schema_name(c: Column | str) -> Column:
    """Trimmed, unquoted as a whole and per dot part, lower case, empty parts dropped. Null stays null."""
    parts = F.split(strip_quotes(trim_blanks(c)), r"\.")
    return F.array_join(
        F.filter(F.transform(parts, lambda p: F.lower(trim_blanks(strip_quotes(trim_blanks(p))))), lambda p: p != ""), "."
    )


def unquote_name(c: Column | str) -> Column:
    """As ``schema_name`` but with the case kept."""
    return F.array_join(F.transform(F.split(trim_blanks(c), r"\."), lambda p: strip_quotes(trim_blanks(p))), ".")


def symbol_key(c: Column | str) -> Column:
    """Name by which symbols are compared: without outer blanks and a leading backslash, lower case."""
    return F.lower(F.regexp_replace(trim_blanks(c), r"^\\", ""))


def class_part(c: Column | str) -> Column:
    """C11: the part before ``::`` (the whole name if there is none)."""
    return F.substring_index(as_column(c), "::", 1)


def leaf_name(c: Column | str) -> Column:
    """C11: the part after the last backslash of the class part."""
    return F.substring_index(class_part(c), "\\", -1)


def first_namespace(c: Column | str) -> Column:
    """The first namespace segment."""
    return F.substring_index(as_column(c), "\\", 1)


def regex_quoted(c: Column | str) -> Column:
    """Text in which no character has a meaning for a regular expression."""
    return F.regexp_replace(as_column(c), r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def distinct_names(names: Column | str) -> Column:
    """The names of an array whose normal form did not occur before, in order."""
    names = as_column(names)
    normal = F.transform(names, lambda x: schema_name(x))
    return F.filter(names, lambda x, i: F.array_position(normal, F.get(normal, i)) == i + 1)


def singular(word: Column) -> Column:
    """``ies`` becomes ``y``, ``ss`` and ``sses`` stay, any other closing ``s`` goes."""
    return (
        F.when(F.endswith(word, F.lit("ies")) & (F.length(word) > 3), F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("y")))
        .when(F.endswith(word, F.lit("sses")) | F.endswith(word, F.lit("ss")), word)
        .when(F.endswith(word, F.lit("s")) & (F.length(word) > 1), F.substring(word, F.lit(1), F.length(word) - 1))
        .otherwise(word)
    )


def identifier_words(c: Column) -> Column:
    """Lower-case words of a camel, snake or kebab case identifier."""
    split = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_-]+", " ")
    return F.filter(F.split(F.lower(split), r"\s+"), lambda w: w != "")


def resource_key(segments: Column) -> Column:
    """All words of the segments run together, the last word of every segment but the last in the singular, ``Interface`` taken off."""

    def words(segment: Column, i: Column) -> Column:
        own = identifier_words(F.regexp_replace(segment, "Interface$", ""))
        inner = (i < F.size(segments) - 1) & (F.size(own) > 0)
        return F.when(inner, F.concat(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), F.array(singular(F.get(own, F.size(own) - 1))))).otherwise(own)

    return F.array_join(F.flatten(F.transform(segments, words)), "")
