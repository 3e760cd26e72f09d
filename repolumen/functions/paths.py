"""Column helpers for paths and repository addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_of(path: Column) -> Column:
    """Parent folder, or ``root`` for a file at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("root"))


def extension(path: Column) -> Column:
    """Suffix with its dot; a name that only starts with a dot has none."""
    return F.regexp_extract(file_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(\.*[^.].*)\.[^.]+$", "$1")


def in_skipped_dir(path: Column, profile: str) -> Column:
    """True when a directory segment is in the profile's skip list or starts with a dot."""
    names = "|".join(name.replace(".", r"\.") for name in rules.SKIP_DIRS[profile])
    return path.rlike(rf"(?:^|/)(?:\.[^/]*|{names})/")


def language_of(path: Column, profile: str) -> Column:
    """Language by extension, or null. The detailed profile compares the bare name ending."""
    table = rules.LANGUAGES[profile]
    if profile == "detailed":
        chain = None
        for ending, language in table.items():
            test = path.endswith(ending)
            chain = F.when(test, language) if chain is None else chain.when(test, language)
        return chain
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(literal, F.lower(extension(path)))


def module_of(folder: Column) -> Column:
    """Top directory of a nested folder, else ``core``."""
    return F.when(folder.contains("/"), F.substring_index(folder, "/", 1)).otherwise(F.lit("core"))


def repo_info(url: Column, profile: str = "enhanced") -> Column:
    """``struct<owner, name>`` from a repository address.

    The enhanced form reads the first two path segments, the core form the last two.
    """
    if profile == "core":
        parts = F.split(F.rtrim(url, F.lit("/")), "/")
        long_enough = F.size(parts) >= 2
        owner = F.try_element_at(parts, F.lit(-2))
        name = F.replace(F.try_element_at(parts, F.lit(-1)), F.lit(".git"), F.lit(""))
        return F.struct(F.when(long_enough, owner).otherwise("unknown").alias("owner"),
                        F.when(long_enough, name).otherwise("repository").alias("name"))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    parts = F.split(F.btrim(path, F.lit("/")), "/")
    long_enough = F.size(parts) >= 2
    name = F.regexp_replace(F.try_element_at(parts, F.lit(2)), r"\.git$", "")
    return F.struct(F.when(long_enough, F.try_element_at(parts, F.lit(1))).otherwise("Unknown").alias("owner"),
                    F.when(long_enough, name).otherwise("Repository").alias("name"))


def resolve_relative(importer: Column, source: Column) -> Column:
    """Path named by a relative import, without its suffix; null when it leaves the tree."""
    folder = F.when(importer.contains("/"), F.regexp_replace(importer, r"/[^/]*$", "")).otherwise(F.lit(""))
    segments = F.split(F.concat_ws("/", folder, source), "/")
    walk = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg.isin("", "."), acc)
        .when((seg == "..") & (F.size(acc) > 0) & ~F.coalesce(F.try_element_at(acc, F.lit(-1)) == "..", F.lit(False)),
              F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(seg))))
    path = F.array_join(walk, "/")
    return F.when(source.startswith("./") | source.startswith("../"), F.when(~path.startswith(".."), without_suffix(path)))


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(path, r"([^/])\.[^./]+$", "$1")


def safe_name(path: Column) -> Column:
    """Document file name for a source path: separators and dots become underscores."""
    return F.concat(F.translate(path, "/\\.", "___"), F.lit(".md"))


def anchor_name(path: Column) -> Column:
    """Heading anchor: lower case without slashes and dots."""
    return F.lower(F.translate(path, "/.", ""))
