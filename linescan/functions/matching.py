"""Matching of lines and keys by regular expressions."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from linescan.functions.dialect import LINE_SECONDS, Plan, plan


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """The pattern with Unicode classes, ``\\n`` as the only line end, and, if asked for, Unicode case folding."""
    return ("(?diuU)" if ignore_case else "(?dU)") + pattern


def check_pattern(spark: SparkSession, pattern: str, ignore_case: bool = False) -> None:
    """Raise ValueError for a bad pattern, before any data is read."""
    for text in plan(pattern, ignore_case).java:
        try:
            spark._jvm.java.util.regex.Pattern.compile(text)
        except IllegalArgumentException as error:
            raise ValueError(f"Invalid regex pattern: {error}") from None


#: A literal, or literals to choose from, then anything, then the rest.
_LITERALS_FIRST = re.compile(r"([\w -]+|\([\w -]+(?:\|[\w -]+)*\))\.\*([^|]+)")
_BACK_REFERENCE = re.compile(r"\\[1-9k]")


def one_pass_form(pattern: str) -> str | None:
    """A pattern that finds the same lines as ``pattern`` in time that follows the line, or None.

    ``(the|und).*[0-9]`` tries the rest of the line again for each of its words.
    Where the words are equally long, the first one will do: what another reaches,
    it reaches too. This holds within a line only, and only if the rest does not
    refer back to the word that was found.
    """
    if not (found := _LITERALS_FIRST.fullmatch(pattern)):
        return None
    first, rest = found.groups()
    if rest[0] in "?+*{" or len({len(w) for w in first.strip("()").split("|")}) > 1:
        return None
    if first[0] == "(" and _BACK_REFERENCE.search(rest):
        return None
    return f"^(?>.*?{first}).*{rest}"


def as_text(values: pa.Array) -> pa.Array:
    """Binary values as text, whatever their bytes, without a copy."""
    kind = pa.large_string() if pa.types.is_large_binary(values.type) else pa.string()
    return pa.Array.from_buffers(kind, len(values), values.buffers(), values.null_count, values.offset)


def find_in_batch(values: pa.Array, how: Plan) -> pa.Array:
    """For each binary value: is the pattern found? Nulls stay null."""
    text = as_text(values)
    if how.engine == "re2" and not how.loose:
        return pc.match_substring_regex(text, how.re2)
    if how.engine == "re2":
        # Word boundaries of the automaton are those of ASCII.
        plain = pc.string_is_ascii(text)
        sure = pc.and_(plain, pc.match_substring_regex(text, how.re2))
        open_ = pc.and_(pc.invert(plain), pc.match_substring_regex(text, how.loose))
    else:
        sure, open_ = pc.if_else(pc.is_valid(text), False, pa.scalar(None, pa.bool_())), pc.is_valid(text)
    if not pc.any(open_).as_py():
        return sure
    import regex

    search = regex.compile(how.regex).search
    out = sure.to_pylist()
    for i in pc.indices_nonzero(open_).to_pylist():
        try:
            out[i] = search(values[i].as_py().decode("utf-8", "surrogateescape"), timeout=LINE_SECONDS) is not None
        except TimeoutError:
            raise TimeoutError(f"a line takes more than {LINE_SECONDS:g} s to search for {how.regex!r}") from None
    return pa.array(out, pa.bool_())


def matches(value: Column, pattern: str | None, ignore_case: bool = False) -> Column:
    """Is the pattern found anywhere in the value? Without a pattern every value passes.

    A line is matched without its newline, so ``$`` is the end of the line. Classes,
    word boundaries and case are those of Unicode. A byte that is not UTF-8 is no
    character: neither ``.`` nor a negated class stands for it. The value is
    untouched. ``dialect.plan`` says which engine does the work: the time follows
    the line, except for look-around and back-references, which no automaton knows.
    Where a group of such a pattern is repeated, or a word boundary is held against
    text beyond ASCII in a pattern that only the automaton can take, the ``regex``
    module decides, and a line that takes it too long fails the job.
    """
    if pattern is None:
        return F.lit(True)
    how = plan(pattern, ignore_case)
    if how.engine != "jvm":

        @F.arrow_udf("boolean")
        def found(values: pa.Array) -> pa.Array:
            return find_in_batch(values, how)

        return found(value.cast("binary"))
    any_of = lambda v, patterns: reduce(Column.__or__, (v.rlike(p) for p in patterns))
    if how.java == how.strict:
        return any_of(value, how.java)
    # Spark's matcher sees U+FFFD for a bad byte; the strict forms refuse it, so a real one goes out of the way.
    # They find nothing that the others do not, so only lines that these find are looked at again.
    without = F.replace(value, F.lit("\ufffd"), F.lit("\ufffc"))
    return any_of(value, how.java) & (F.is_valid_utf8(value) | any_of(without, how.strict))


def matches_any(value: Column, patterns: list[str]) -> Column:
    """Is one of the patterns found? Without patterns every value passes."""
    return reduce(Column.__or__, (matches(value, p) for p in patterns)) if patterns else F.lit(True)
