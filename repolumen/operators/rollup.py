"""Roll-ups from files to folders, modules, domains and repositories.

Lists that can grow with a folder or repository (its files, dependencies, endpoints) are
relations of their own; a summary row only carries counts and lists of fixed length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify, paths, rules
from ..functions.text import contains_any
from .ordering import ordinal
from .unnest import unnest


def first_k(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group; the rank filter also limits every task before the shuffle."""
    window = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def repo_totals() -> list:
    return [F.count("*").alias("total_files"), F.count_if("is_backend").alias("backend_files"),
            F.sum("api_count").alias("total_apis"), F.sum("function_count").alias("total_functions"),
            F.sort_array(F.collect_set("language")).alias("languages")]


def repo_summary(facts: DataFrame) -> DataFrame:
    return facts.groupBy("repo").agg(*repo_totals())


def breakdown(facts: DataFrame, label: str) -> DataFrame:
    return facts.groupBy("repo", label).agg(F.count("*").alias("files"))


# --- folders --------------------------------------------------------------------------------


def _languages(profile: str) -> list[str]:
    return list(dict.fromkeys(rules.LANGUAGES[profile].values()))


def folder_summary(detailed: DataFrame) -> DataFrame:
    """One row per folder in one aggregation.

    The languages of the profile are known, so the most frequent one (ties: the one whose
    first file sorts first) comes from a counter per language, not from a second shuffle.
    """
    rows = detailed.select(
        "repo", paths.folder_of(F.col("file_path")).alias("folder"), "file_path", "language", "lines_of_code",
        F.size("endpoints").alias("endpoints"), F.size("functions").alias("functions"),
        (F.size("jsx_components") > 0).alias("has_jsx"), F.col("service_info.type").alias("service"),
        "integration_points")
    tallies = []
    for i, name in enumerate(_languages("detailed")):
        mine = F.col("language") == name
        tallies += [F.count_if(mine).alias(f"n{i}"), F.min(F.when(mine, F.col("file_path"))).alias(f"first{i}")]
    labels = [label for _, label in rules.INTEGRATIONS]
    grouped = rows.groupBy("repo", "folder").agg(
        F.count("*").alias("total_files"), F.sum("endpoints").alias("endpoint_count"),
        F.sum("functions").alias("function_count"), F.sum("lines_of_code").alias("lines_of_code"),
        F.count_if(F.col("endpoints") > 0).alias("with_endpoints"), F.count_if("has_jsx").alias("with_components"),
        F.bool_or(F.coalesce(F.col("service") == "backend", F.lit(False))).alias("any_backend"),
        F.bool_or(F.coalesce(F.col("service") == "frontend", F.lit(False))).alias("any_frontend"),
        *[F.bool_or(F.array_contains("integration_points", label)).alias(f"point{i}")
          for i, label in enumerate(labels)],
        *tallies)
    ranked = F.array_sort(F.filter(F.array(*[
        F.struct((-F.col(f"n{i}")).alias("less"), F.col(f"first{i}").alias("first"), F.lit(name).alias("language"))
        for i, name in enumerate(_languages("detailed"))]), lambda x: x["less"] < 0))
    patterns = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"point{i}"), F.lit(label))
                                                      for i, label in enumerate(labels)])))
    return grouped.select(
        "repo", "folder", "total_files", "endpoint_count", "function_count", "lines_of_code",
        F.element_at(ranked, 1)["language"].alias("primary_language"),
        F.when(F.col("any_backend") & F.col("any_frontend"), "mixed").when(F.col("any_backend"), "backend")
        .when(F.col("any_frontend"), "frontend").alias("service_type"),
        classify.folder_purpose(F.col("folder"), F.col("total_files"), F.col("with_endpoints"),
                                F.col("with_components"), F.col("any_backend"), F.col("any_frontend"))
        .alias("folder_purpose"), patterns.alias("integration_patterns"))


def folder_components(detailed: DataFrame, per_file: int | None = None, k: int | None = None) -> DataFrame:
    """Components per folder with their ``rank`` in name order: distinct functions, classes and tags, of every file the
    first ``per_file`` of each kind and of the folder the first ``k``; all unless told otherwise."""
    def two(array, name=None):
        head = F.col(array) if per_file is None else F.slice(array, 1, per_file)
        return head if name is None else F.transform(head, lambda x: x[name])

    names = unnest(detailed, ["repo", paths.folder_of(F.col("file_path")).alias("folder")], F.concat(
        two("functions", "name"), two("classes", "name"), two("jsx_components")), "component").distinct()
    if k is not None:
        return first_k(names, ["repo", "folder"], ["component"], k).select("repo", "folder", "component", "rank")
    return ordinal(names, ["repo", "folder"], ["component"], "rank", "components") \
        .select("repo", "folder", "component", (F.col("rank") + 1).cast("int").alias("rank"))


def key_components(detailed: DataFrame, per_file: int = 2, k: int = 10) -> DataFrame:
    """One short list per folder: the first ``k`` of the first ``per_file`` of every file."""
    return folder_components(detailed, per_file, k).groupBy("repo", "folder").agg(
        F.array_sort(F.collect_list("component")).alias("key_components"))


def folder_dependencies(detailed: DataFrame) -> DataFrame:
    return unnest(detailed, ["repo", paths.folder_of(F.col("file_path")).alias("folder")],
                  "dependencies", "dependency").distinct()


def folder_files(detailed: DataFrame) -> DataFrame:
    """The files of every folder."""
    return detailed.select("repo", paths.folder_of(F.col("file_path")).alias("folder"), "file_path", "language", "lines_of_code")


def folder_endpoints(detailed: DataFrame) -> DataFrame:
    """The endpoints of every folder."""
    return unnest(detailed, ["repo", paths.folder_of(F.col("file_path")).alias("folder"), "file_path"], "endpoints", "e") \
        .select("repo", "folder", "file_path", "e.line", "e.method", "e.path", "e.description")


# --- modules, domains, repositories -----------------------------------------------------------


def with_module(folders: DataFrame) -> DataFrame:
    located = folders.withColumn("module", paths.module_of(F.col("folder")))
    return located.withColumn("domain", classify.domain_of(F.col("module")))


def module_summary(folders: DataFrame) -> DataFrame:
    return with_module(folders).groupBy("repo", "module").agg(
        F.count("*").alias("folders"), F.sum("total_files").alias("total_files"),
        F.sort_array(F.collect_set("primary_language")).alias("languages"),
        F.sort_array(F.collect_set("folder_purpose")).alias("responsibilities")) \
        .withColumn("role", classify.module_role(F.col("module"))) \
        .withColumn("domain", classify.domain_of(F.col("module")))


def module_folders(folders: DataFrame) -> DataFrame:
    """The folders of every module. Like the other relations of members it has a row per member, so a module with very
    many folders is no larger in any row."""
    return with_module(folders).select("repo", "module", "folder", "total_files", "primary_language", "folder_purpose")


def module_components(detailed: DataFrame, per_file: int = 2, k: int = 10) -> DataFrame:
    """The key components of a module: those of its folders, each with its folder."""
    return folder_components(detailed, per_file, k).select(
        "repo", paths.module_of(F.col("folder")).alias("module"), "folder", "component")


def domain_modules(folders: DataFrame) -> DataFrame:
    """The modules of every domain."""
    return with_module(folders).groupBy("repo", "domain", "module").agg(
        F.count("*").alias("folders"), F.sum("total_files").alias("total_files"))


def domain_summary(folders: DataFrame) -> DataFrame:
    grouped = module_summary(folders).groupBy("repo", "domain").agg(
        F.count("*").alias("modules"), F.sum("total_files").alias("total_files"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("languages")))).alias("languages"))
    return grouped.withColumn("overview", F.format_string(
        "Domain with %d modules and %d files", "modules", "total_files"))


def system_overview(folders: DataFrame) -> DataFrame:
    grouped = domain_summary(folders).groupBy("repo").agg(
        F.sum("total_files").alias("files"), F.sum("modules").alias("modules"), F.count("*").alias("domains"))
    return grouped.withColumn("overview", F.format_string(
        "System with %d files organized into %d modules across %d domains", "files", "modules", "domains"))


def hierarchy_rollup(folders: DataFrame) -> DataFrame:
    """The same measures on every level; rolls up folder rows, not files."""
    measures = ["total_files", "endpoint_count", "function_count", "lines_of_code"]
    return with_module(folders).rollup("repo", "domain", "module", "folder").agg(
        F.grouping_id().alias("level"), *[F.sum(m).alias(m) for m in measures])


def module_interfaces(detailed: DataFrame, per_folder: int = 5) -> DataFrame:
    """First endpoints of each folder, offered by its module."""
    rows = unnest(detailed, ["repo", "file_path", paths.folder_of(F.col("file_path")).alias("folder")],
                  "endpoints", "e", "at")
    kept = first_k(rows, ["repo", "folder"], ["file_path", "at"], per_folder)
    return kept.select("repo", paths.module_of(F.col("folder")).alias("module"), "folder", "rank",
                       F.concat_ws(" ", "e.method", "e.path").alias("interface"))


# --- dependencies and technologies ----------------------------------------------------------------


def repo_dependencies(facts: DataFrame, k: int | None = None) -> DataFrame:
    """``(repo, dependency)``: all dependencies, or the first ``k`` in name order."""
    names = unnest(facts, ["repo"], "dependencies", "dependency").distinct()
    return names if k is None else first_k(names, ["repo"], ["dependency"], k).select("repo", "dependency")


def dependency_union(facts: DataFrame, k: int | None = None) -> DataFrame:
    """Dependencies of each repository with their ``rank`` in name order, all of them or the first ``k``."""
    names = unnest(facts, ["repo"], "dependencies", "dependency").distinct()
    if k is not None:
        return first_k(names, ["repo"], ["dependency"], k)
    return ordinal(names, ["repo"], ["dependency"], "rank", "dependencies") \
        .withColumn("rank", (F.col("rank") + 1).cast("int"))


def tech_usage(facts: DataFrame) -> DataFrame:
    """Backend files per dependency."""
    used = unnest(facts, ["repo"], F.when(F.col("is_backend"), F.col("dependencies")), "dependency")
    return used.groupBy("repo", "dependency").agg(F.count("*").alias("files"))


def tech_usage_lookup(facts: DataFrame) -> DataFrame:
    """Usage of the known technologies; the dimension is a fixed list of seven rows."""
    dim = facts.sparkSession.createDataFrame(
        [(i, *row) for i, row in enumerate(rules.MAJOR_TECHS)], "ord int, dependency string, category string, purpose string")
    return tech_usage(facts).join(F.broadcast(dim), "dependency")


def rule_holds(kind: str, tokens: list[str]):
    """Whether a rule on languages or dependencies holds for a file."""
    deps, backend = F.col("dependencies"), F.col("is_backend")
    if kind == "language":
        return F.col("language").isin(tokens)
    if kind == "exact":
        return backend & F.arrays_overlap(deps, F.array(*[F.lit(t) for t in tokens]))
    return backend & F.exists(deps, lambda d: F.lower(d).contains(tokens[0]))


def rule_hits(facts: DataFrame, rule_list) -> DataFrame:
    """Labels whose rule holds for a repository: ``(repo, ord, label)``.

    Every rule is a flag that is or-ed while aggregating, so no dependency list is collected
    and no file meets the rule list in a join.
    """
    flags = facts.groupBy("repo").agg(*[F.bool_or(rule_holds(kind, tokens)).alias(f"r{i}")
                                        for i, (_, kind, tokens) in enumerate(rule_list)])
    entries = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), F.col(f"r{i}").alias("on"))
                        for i, (label, _, _) in enumerate(rule_list)])
    return flags.select("repo", F.explode(F.filter(entries, lambda e: e["on"])).alias("e")) \
        .select("repo", "e.ord", "e.label")


def project_flags() -> list:
    """Aggregates that ``project_kind`` reads."""
    low = F.lower("file_path")
    return [F.bool_or(F.col("is_backend") & contains_any(low, words)).alias(f"p{i}")
            for i, (words, _) in enumerate(rules.PROJECT_TYPES)]


def project_kind(apis):
    return F.when(F.col("p0"), rules.PROJECT_TYPES[0][1]).when(F.col("p1"), rules.PROJECT_TYPES[1][1]) \
        .when(apis > 10, "API Platform").otherwise("Software Project")


def project_type(facts: DataFrame) -> DataFrame:
    flags = facts.groupBy("repo").agg(*project_flags(), F.sum("api_count").alias("apis"))
    return flags.select("repo", project_kind(F.col("apis")).alias("project_type"))


def general_features() -> list:
    """What is said of a repository without a feature of its own, from its totals."""
    return [F.format_string("**%d Backend Services**: Microservices architecture with specialized functionality", "backend_files"),
            F.format_string("**%d API Endpoints**: Comprehensive REST API with full documentation", "total_apis"),
            F.format_string("**High Performance**: Optimized code with %d functions", "total_functions"),
            F.lit("**Security First**: Built-in security measures and best practices")]


def detected_features(facts: DataFrame, k: int = 8) -> DataFrame:
    """First ``k`` feature lines in file order, repeats included; four general lines where none match."""
    low = F.lower("file_path")
    entries = F.array_compact(F.array(*[
        F.when(contains_any(low, words), F.struct(F.lit(i).alias("ord"), F.lit(label).alias("feature")))
        for i, (words, label) in enumerate(rules.FEATURES)]))
    hits = unnest(facts, ["repo", "file_path"], F.when(F.col("is_backend"), entries), "e")
    found = first_k(hits, ["repo"], ["file_path", F.col("e.ord")], k).select("repo", "rank", "e.feature")
    counts = repo_summary(facts).join(found.select("repo").distinct(), "repo", "left_anti")
    fallback = counts.select("repo", F.posexplode(F.array(*general_features())).alias("p", "feature")) \
        .select("repo", (F.col("p") + 1).alias("rank"), "feature")
    return found.unionByName(fallback)


def processing_stats(facts: DataFrame, answers: DataFrame) -> DataFrame:
    """Files, folders, and files with an answer and with a failed call, per repository. Counts of both tables are added
    up, so no file row meets another in a join."""
    def per(df, total, enriched, failed, folder):
        return df.select("repo", folder.alias("folder"), F.lit(total).alias("t"), enriched.cast("int").alias("e"),
                         failed.cast("int").alias("f"))
    no = F.lit(False)
    rows = per(facts, 1, no, no, paths.folder_of(F.col("file_path"))).unionByName(
        per(answers, 0, F.col("response").isNotNull(), F.col("error").isNotNull(), F.lit(None).cast("string")))
    per_folder = rows.groupBy("repo", "folder").agg(*[F.sum(c).alias(c) for c in "tef"])
    return per_folder.groupBy("repo").agg(
        F.sum("t").alias("total_files"), F.count("folder").alias("folders"), F.sum("e").alias("enriched_files"),
        F.sum("f").alias("failed_files"))


def merge_enrichment(facts: DataFrame, answers: DataFrame) -> DataFrame:
    """Every file with the summary and the insights of its answer; without one, the purpose stands in for the summary and
    there are no insights."""
    return facts.join(answers.select("repo", "file_path", "summary", "insights"), ["repo", "file_path"], "left") \
        .withColumn("summary", F.coalesce("summary", "file_purpose")) \
        .withColumn("insights", F.coalesce("insights", F.array().cast("array<string>")))
