"""Column functions on text. All run inside the row, without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions import fixed_values as fv

# Unicode white space, with the four separators Java leaves out
SPACE = r"[\s\x1c-\x1f]"
INLINE_SPACE = r"[\s\x1c-\x1f&&[^\n]]"
#: All characters of SPACE, for functions that take characters and for patterns without (?U), which are much faster.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: A run of SPACES that is not a single space already.
SPREAD_SPACE = f"[{SPACES.replace(' ', '')}][{SPACES}]*| [{SPACES}]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once.

    Inside a lambda Spark computes an expression again wherever it is written;
    a lambda variable is computed once.
    """
    return F.transform(F.array(value), use)[0]


def words_of(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def no_strings() -> Column:
    return F.array().cast("array<string>")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def normalise(text: Column) -> Column:
    """Lower case, search alphabet only, single spaces; null gives ''.

    Most single spaces stand for themselves, so only what is not one is replaced.
    """
    spaced = F.regexp_replace(F.lower(text), fv.OUTSIDE_SEARCH_ALPHABET.replace("]", " ]"), " ")
    kept = F.regexp_replace(spaced, " {2,}", " ")
    return F.coalesce(F.trim(kept), F.lit(""))


_OUTSIDE = re.compile(fv.OUTSIDE_SEARCH_ALPHABET.replace("]", " ]"))


def normalised(text: str | None) -> str:
    """`normalise` of a value inside a task."""
    return " ".join(_OUTSIDE.sub(" ", text.lower()).split()) if text else ""


def normalise_in_batches(text: Column) -> Column:
    """`normalise` by Arrow batches, which takes a third of the time where all of a table's texts are put in normal form."""
    def form(texts: "pa.Array") -> "pa.Array":
        return pa.array([normalised(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(form, "string")(text)


def candidate_terms(text: Column) -> Column:
    """Distinct search terms in first-seen order."""
    return terms_of_normal(normalise(text))


def terms_of_normal(normal: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(normal, F.lit(fv.TERM), F.lit(0)))
    stop = words_of(fv.STOPWORDS)
    return F.filter(found, lambda t: ~F.array_contains(stop, t))


def is_hangul(term: Column) -> Column:
    """A search term is all Hangul or all ASCII, so its first character tells."""
    return F.ascii(term).between(ord("가"), ord("힣"))


def token_length(text: Column) -> Column:
    """A quarter of the stripped length, at least 1; blank text has none."""
    return let(F.length(strip(text)), lambda n: F.greatest(F.least(n, F.lit(1)), F.floor(n / 4).cast("int")))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def index_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, repeats kept."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def collapse_space(text: Column) -> Column:
    return strip(F.regexp_replace(text, SPREAD_SPACE, " "))


def preview(text: Column, size: int = 240) -> Column:
    text = F.coalesce(text, F.lit(""))
    cut = F.concat(F.substring(text, 1, size - 3), F.lit("..."))
    return F.when(F.length(text) <= size, text).otherwise(cut)


def matches_search(query: str, *columns: Column) -> Column:
    """Case-insensitive match in any column; % and _ in the query stay wildcards."""
    like = f"%{query.strip()}%"
    test = F.lit(False)
    for column in columns:
        test = test | F.coalesce(column.ilike(like), F.lit(False))
    return test


def contains_search(query: str, *columns: Column) -> Column:
    """Plain case-insensitive substring test in any column."""
    needle = query.strip().lower()
    test = F.lit(needle == "")
    for column in columns:
        test = test | F.coalesce(F.contains(F.lower(column), F.lit(needle)), F.lit(False))
    return test


def any_within(needles: list[str], text: Column) -> Column:
    return F.exists(words_of(needles), lambda n: F.contains(text, n))
