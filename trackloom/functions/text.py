"""Column functions over names, paths, captions and JSON-like fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a search term loses, names no folder may have, and characters no folder name may hold.
SEARCH_STRIPPED = ',(){}"\\'
MOST_CHARACTERS, UNNAMED = 255, "New Folder"
#: White space and line breaks, also those beyond ASCII, as a set of a pattern.
BLANK = r"\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Names that no file may have, and characters that no name may hold.
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", *(f"{x}{k}" for x in ("COM", "LPT") for k in range(1, 10))]
FORBIDDEN = r'[/\\:*?"<>|]'
MEBIBYTE, GIBIBYTE = 1 << 20, 1 << 30


def search_term(term: str) -> str:
    """A term without the characters that a filter expression reserves."""
    return term.translate({ord(c): None for c in SEARCH_STRIPPED})


def contains_any_case(column: Column, term: str) -> Column:
    return F.contains(F.lower(column), F.lit(term.lower()))


def hashtags(caption: Column) -> Column:
    """Lower-cased words after #, repeats kept."""
    return F.transform(F.regexp_extract_all(caption, F.lit(r"#((?U)\w+)"), F.lit(1)), F.lower)


def depth(path: Column) -> Column:
    """Parts of a path; the root has none."""
    return F.when(path == "", F.lit(0)).otherwise(F.size(F.split(path, "/")))


def depth_penalty(path: Column) -> Column:
    """Two per part; the root counts as one part here."""
    return F.size(F.split(path, "/")) * 2


def name_score(name: Column, term: str) -> Column:
    """100 for the whole name, 50 for its beginning, 25 for any part, in any case."""
    low, want = F.lower(name), F.lit(term.lower())
    return F.when(low == want, 100.0).when(F.startswith(low, want), 50.0).when(F.contains(low, want), 25.0).otherwise(0.0)


def video_relevance(name: Column, file_name: Column, path: Column, term: str) -> Column:
    low, want = F.lower(file_name), F.lit(term.lower())
    bonus = F.when(F.startswith(low, want), 30.0).when(F.contains(low, want), 15.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), name_score(name, term) + bonus - depth_penalty(path))


def folder_relevance(name: Column, videos: Column, subfolders: Column, term: str) -> Column:
    return name_score(name, term) + videos * 0.5 + subfolders * 0.3


def size_bucket(size: Column) -> Column:
    return F.when(size < 100 * MEBIBYTE, "small").when(size < GIBIBYTE, "medium").otherwise("large")


def same_period(ts: Column, now: Column, unit: str) -> Column:
    """unit: day, week (from Monday), month or year."""
    return F.date_trunc(unit, ts) == F.date_trunc(unit, now)


def in_subtree(path: Column, folder: str) -> Column:
    """The folder itself and all below it; the root holds everything."""
    return F.lit(True) if folder == "" else (path == folder) | F.startswith(path, F.lit(folder + "/"))


def valid_folder_name(name: Column) -> Column:
    """1 to 255 characters, none forbidden, not reserved, no dot, white space or line break at an end."""
    return F.length(name).between(1, MOST_CHARACTERS) & ~name.rlike(FORBIDDEN) & ~F.upper(name).isin(RESERVED_NAMES) & ~name.rlike(rf"\A[.{BLANK}]|[.{BLANK}]\z")


def sanitized_folder_name(name: Column) -> Column:
    """Without white space and line breaks at its ends, forbidden characters replaced, cut to length; never empty."""
    cut = F.substring(F.regexp_replace(F.regexp_replace(name, rf"\A[{BLANK}]+|[{BLANK}]+\z", ""), FORBIDDEN, "_"), 1, MOST_CHARACTERS)
    return F.when(cut == "", F.lit(UNNAMED)).otherwise(cut)


def human_bytes(size: Column) -> Column:
    value = size.cast("double")
    return F.when(value >= 1e9, F.format_string("%.1f GB", value / 1e9)).when(value >= 1e6, F.format_string("%.1f MB", value / 1e6)).when(value >= 1e3, F.format_string("%.0f KB", value / 1e3)).otherwise(F.format_string("%d bytes", size.cast("long")))


def compact_count(n: Column) -> Column:
    value = n.cast("double")
    return F.when(n >= 1_000_000, F.format_string("%.1fM", value / 1e6)).when(n >= 1000, F.format_string("%.1fK", value / 1e3)).otherwise(n.cast("string"))


def next_number(names: Column, prefix: str) -> Column:
    """Aggregate: one more than the largest number right after the prefix; 1 if there is none."""
    found = F.regexp_extract(names, f"^{re.escape(prefix)}([0-9]+)", 1)
    return F.coalesce(F.max(F.when(found != "", found.cast("long"))), F.lit(0)) + 1


def numbered_name(prefix: str, number: Column, rest: Column) -> Column:
    return F.format_string(prefix.replace("%", "%%") + "%02d %s", number, rest)


def even_times(start: Column, end: Column, n: int) -> Column:
    """n evenly spaced times; the middle for one, and only the start of an empty span."""
    if n == 1:
        inner = F.array((start + end) / 2)
    else:
        inner = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: start + (end - start) * k / (n - 1))
    return F.when(end <= start, F.array(start)).otherwise(inner)
