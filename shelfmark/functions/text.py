"""Names and paths as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest normalised name, and the shortest prefix a cut at a word end may leave.
MOST, LEAST_CUT = 120, 101
# What is deleted outright, and the ranges in which a cut inside a word is no harm.
DELETED = r"[\x00-\x1f·\x{FFFD}]"
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}"


def clean_text(x: Column) -> Column:
    """Control characters, middle dots and replacement characters deleted, white space collapsed; null becomes ''."""
    kept = F.regexp_replace(F.coalesce(x, F.lit("")), DELETED, "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def strip_extension(x: Column) -> Column:
    """Without a last extension of one to eight letters or digits, if a dot remains after leading dots."""
    return F.when(F.regexp_replace(x, r"^\.+", "").contains("."), F.regexp_replace(x, r"\.[\p{L}\p{N}]{1,8}\z", "")).otherwise(x)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """The directory part; '' for a bare name."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit(""))


def truncate_name(x: Column) -> Column:
    """At most ``MOST`` characters, cut before the last character that isn't CJK if that leaves enough."""
    head = F.substring(x, 1, MOST)
    before = F.regexp_extract(head, rf"(?s)^(.*)[^{CJK}][{CJK}]*\z", 1)
    cut = F.when(F.length(before).between(LEAST_CUT, MOST - 1), F.rtrim(before)).otherwise(head)
    return F.when(F.length(x) <= MOST, x).otherwise(cut)


def normalise(x: Column) -> Column:
    """A readable title from a file name: base name, no extension, words of letters and digits, each capitalised; null for null."""
    base = basename(F.replace(x, F.lit("\\"), F.lit("/")))
    base = F.when(strip_extension(base) != base, base).otherwise(x)
    bare = F.regexp_replace(clean_text(strip_extension(base)), r"^\.+", "")
    words = F.filter(F.split(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    cased = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")
    return F.when(x.isNotNull(), truncate_name(cased))


def normalise_file_name(x: Column) -> Column:
    """``normalise`` with '.pdf' put back where the name ended in it, in whatever case."""
    return F.when(F.lower(x).endswith(".pdf"), F.concat(normalise(x), F.lit(".pdf"))).otherwise(normalise(x))


def one_line(x: Column) -> Column:
    """A table cell: null as '', line ends as spaces, no white space around."""
    return F.trim(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" ")))


def shorten(x: Column, width: int) -> Column:
    """``one_line`` of at most ``width`` characters, the last an ellipsis where text is left out."""
    line = one_line(x)
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width - 1), F.lit("…"))).otherwise(line)


def split_list(x: Column, separator: str = ",") -> Column:
    """The trimmed, non-blank parts of a delimited string; null gives no parts."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), separator), lambda p: F.trim(p)), lambda p: p != "")


def clean_terms(terms: Column) -> Column:
    """Trimmed, non-blank, distinct and in order."""
    return F.sort_array(F.array_distinct(F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: t != "")))


def path_prefixes(path: Column) -> Column:
    """'a', 'a/b', 'a/b/c' of 'a/b/c'."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def normal_path(path: Column) -> Column:
    """A path with '.' and '..' resolved lexically; null where it leads out of its root or is absolute."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        up, empty = p == "..", F.size(acc["kept"]) == 0
        kept = F.when(up & ~empty, F.slice(acc["kept"], F.lit(1), F.greatest(F.size(acc["kept"]) - 1, F.lit(0)))).when(up, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(p)))
        return F.struct(kept.alias("kept"), (acc["out"] | (up & empty)).alias("out"))

    end = F.aggregate(parts, start, step)
    return F.when(end["out"] | path.startswith("/") | path.rlike(r"^[A-Za-z]:"), F.lit(None)).otherwise(F.array_join(end["kept"], "/"))


def contains_any(text: Column, keywords: list[str]) -> Column:
    """Whether the small letters of ``text`` hold one of the keywords."""
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(F.lower(text), F.lit(k.lower()))
    return out


def confidence_rank(x: Column) -> Column:
    """low 0, medium 1, high 2; missing counts as low, anything else as -1."""
    return F.when(F.coalesce(x, F.lit("")).isin("", "low"), 0).when(x == "medium", 1).when(x == "high", 2).otherwise(-1)
