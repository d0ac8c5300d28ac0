"""Text column functions. All run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkloom.model import EXTENSIONS, NAME_LINE, WHITESPACE




def _class_ranges(chars: str) -> str:
    """The inside of a regular expression class, neighbours joined to ranges."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" if b > a else f"\\x{{{a:x}}}" for a, b in runs)


# For a portable engine as plain ranges; for Java as its Unicode class, which is faster.
WS = _class_ranges(WHITESPACE)
GAP = r"(?U:[\s\x1c-\x1f]+)"
NO_GAP = r"(?U:[^\s\x1c-\x1f])"
WS_IN_LINE = _class_ranges(WHITESPACE.replace("\n", ""))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Drop Unicode white space at both ends."""
    return F.trim(_c(x), F.lit(WHITESPACE))


def is_blank(x: Column | str) -> Column:
    return strip(F.coalesce(_c(x), F.lit(""))) == ""


def content_hash(x: Column | str) -> Column:
    """md5 of the UTF-8 bytes, 32 hex digits."""
    return F.md5(_c(x))


def md5_short(x: Column | str) -> Column:
    """The first 12 hex digits of the md5."""
    return F.substring(F.md5(_c(x)), 1, 12)


def base_name(path: Column | str) -> Column:
    """Last component of a path."""
    return F.substring_index(_c(path), "/", -1)


def stem(path: Column | str) -> Column:
    """File name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(base_name(path), r"^(.+)\.[^.]+$", "$1")


def extension(path: Column | str) -> Column:
    """Lower-case extension without the dot, empty when there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1))


def is_supported(path: Column | str) -> Column:
    return extension(path).isin(*EXTENSIONS)


def with_name_prefix(stem_col: Column, text: Column | str) -> Column:
    """The stored text starts with a line that names its file."""
    return F.concat(F.lit(NAME_LINE), stem_col, F.lit("]\n"), _c(text))


def is_web_path(path: Column | str) -> Column:
    return F.contains(F.replace(_c(path), F.lit("\\"), F.lit("/")), F.lit("/data/web/"))


def source_class(path: Column | str) -> Column:
    """``web`` for a stored crawl, else ``docs``."""
    return F.when(is_web_path(path), "web").otherwise("docs")


def source_name(source_type: Column | str, path: Column | str, title: Column | str) -> Column:
    """A crawled page shows its title (its path without one), a file its base name."""
    return F.when(_c(source_type) == "web_crawl", F.coalesce(_c(title), _c(path))).otherwise(
        base_name(path)
    )


def in_scope(scope: str, path: Column | str, source_type: Column | str) -> Column:
    """``all``, ``docs`` (local files outside the crawl folder) or ``web``."""
    if scope == "docs":
        return (_c(source_type) == "local_file") & ~is_web_path(path)
    if scope == "web":
        return is_web_path(path)
    if scope == "all":
        return F.lit(True)
    raise ValueError(f"unknown scope: {scope}")


def tokens(x: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    parts = F.split(F.lower(_c(x)), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: t != "")


def word_count(x: Column | str) -> Column:
    """Number of white-space separated words, 0 for a blank text."""
    s = strip(x)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, GAP)))


def quote(literal: str) -> str:
    """A Java pattern that matches ``literal``."""
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", literal)


def any_of(literals: list[str]) -> str:
    """A Java pattern that matches one of ``literals``; single characters share one class."""
    single = "".join(re.sub(r"([\\\]\[^&-])", r"\\\1", x) for x in literals if len(x) == 1)
    longer = [quote(x) for x in sorted(literals, key=len, reverse=True) if len(x) > 1]
    return "|".join([*longer, f"[{single}]"] if single else longer)


def cut_every(x: Column, size: int) -> Column:
    """Fixed-stride pieces of a text; they join to the text again. Linear in its length."""
    return F.regexp_extract_all(x, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
