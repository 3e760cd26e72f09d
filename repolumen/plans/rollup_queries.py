"""Queries across files: joins, roll-ups, graph and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, paths, rules
from ..operators import facts, graph, ranking, rollup
from ..session import materialize
from . import inputs
from .answers import answered
from .registry import query


#: Metadata of nodes and the columns that show it.
NODE_METADATA = {"line": "line", "category": "category", "file_count": "file_count", "full_name": "full_name",
                 "language": "language", "lines_of_code": "lines_of_code", "function_count": "function_count",
                 "class_count": "class_count", "api_endpoint_count": "api_endpoint_count", "service_type": "service_type",
                 "service_framework": "service_framework", "service_port": "service_port", "parameters": "parameters",
                 "methods": "methods", "is_async": "is_async", "is_external": "is_external", "method": "method",
                 "path": "api_path", "function_name": "function_name"}


def bar(column):
    return F.array_join(column, "|")


def file_facts(spark, sf):
    return facts.file_facts(inputs.corpus(spark, sf))


def stored_facts(spark, sf):
    return materialize(file_facts(spark, sf), "facts")


def detailed(spark, sf):
    return facts.detailed_facts(inputs.corpus(spark, sf))


def stored_detailed(spark, sf):
    return materialize(detailed(spark, sf), "detailed")


# --- classification of folders, modules, repositories --------------------------------------------


@query("folder_purpose")
def _(spark, sf):
    return rollup.folder_summary(detailed(spark, sf)).select("repo", "folder", "folder_purpose")


@query("module_role")
def _(spark, sf):
    folders = inputs.corpus(spark, sf).select("repo", paths.module_of(paths.folder_of(F.col("file_path"))).alias("module"))
    return folders.distinct().select("repo", "module", classify.module_role(F.col("module")).alias("role"),
                                     classify.domain_of(F.col("module")).alias("domain"))


@query("project_type")
def _(spark, sf):
    return rollup.project_type(file_facts(spark, sf))


# --- joins -------------------------------------------------------------------------------------------


@query("resolve_imports")
def _(spark, sf):
    imports = materialize(detailed(spark, sf).select("repo", "file_path", "imports"), "imports")
    return graph.resolve_imports(imports).select("repo", "file_path", "line", "source", "target")


@query("endpoint_handler_link")
def _(spark, sf):
    return graph.endpoint_handlers(facts.file_bundles(inputs.corpus(spark, sf), code=False))


@query("external_dependency_dim")
def _(spark, sf):
    return graph.external_dependencies(detailed(spark, sf))


@query("tech_usage_lookup")
def _(spark, sf):
    return rollup.tech_usage_lookup(file_facts(spark, sf)).select("repo", "dependency", "category", "purpose", "files")


def _rule_query(rule_list):
    def run(spark, sf):
        return rollup.rule_hits(file_facts(spark, sf), rule_list)
    return run


query("tech_badges")(_rule_query(rules.TECH_BADGES))
query("backend_tech")(_rule_query(rules.BACKEND_TECH))
query("acknowledgements")(_rule_query(rules.ACKNOWLEDGEMENTS))


@query("merge_enrichment")
def _(spark, sf):
    return rollup.merge_enrichment(*answered(spark, sf)) \
        .select("repo", "file_path", "file_purpose", "summary", bar("insights").alias("insights"))


@query("module_interfaces")
def _(spark, sf):
    return rollup.module_interfaces(detailed(spark, sf))


# --- aggregates ----------------------------------------------------------------------------------------


@query("repo_summary")
def _(spark, sf):
    return rollup.repo_summary(file_facts(spark, sf)).withColumn("languages", bar("languages"))


@query("file_counts")
def _(spark, sf):
    return file_facts(spark, sf).select("repo", "file_path", "function_count", "api_count", "lines_of_code")


@query("folder_summary")
def _(spark, sf):
    rows = stored_detailed(spark, sf)
    deps = rollup.folder_dependencies(rows).groupBy("repo", "folder").agg(F.count("*").alias("dependencies"))
    return (rollup.folder_summary(rows).join(rollup.key_components(rows), ["repo", "folder"], "left")
            .join(deps, ["repo", "folder"], "left").select(
        "repo", "folder", "total_files", "endpoint_count", "primary_language", "service_type", "folder_purpose",
        bar("integration_patterns").alias("integration_patterns"),
        F.coalesce(bar("key_components"), F.lit("")).alias("key_components"),
        F.coalesce("dependencies", F.lit(0)).alias("dependencies")))


@query("folder_dependencies")
def _(spark, sf):
    return rollup.folder_dependencies(detailed(spark, sf))


@query("primary_language")
def _(spark, sf):
    return rollup.folder_summary(detailed(spark, sf)).select("repo", "folder", "primary_language")


@query("folder_service_type")
def _(spark, sf):
    return rollup.folder_summary(detailed(spark, sf)).select("repo", "folder", "service_type")


@query("key_components")
def _(spark, sf):
    return rollup.folder_components(detailed(spark, sf), per_file=2, k=10)


@query("folder_components")
def _(spark, sf):
    return rollup.folder_components(detailed(spark, sf))


@query("integration_patterns")
def _(spark, sf):
    return rollup.folder_summary(detailed(spark, sf)).select(
        "repo", "folder", bar("integration_patterns").alias("patterns"))


@query("module_summary")
def _(spark, sf):
    return rollup.module_summary(rollup.folder_summary(detailed(spark, sf))).select(
        "repo", "module", "folders", "total_files", "role", "domain", bar("languages").alias("languages"))


@query("module_responsibilities")
def _(spark, sf):
    return rollup.module_summary(rollup.folder_summary(detailed(spark, sf))).select(
        "repo", "module", bar("responsibilities").alias("responsibilities"))


@query("domain_summary")
def _(spark, sf):
    return rollup.domain_summary(rollup.folder_summary(detailed(spark, sf))).select(
        "repo", "domain", "modules", "total_files", bar("languages").alias("languages"), "overview")


@query("folder_files")
def _(spark, sf):
    return rollup.folder_files(detailed(spark, sf))


@query("folder_endpoints")
def _(spark, sf):
    return rollup.folder_endpoints(detailed(spark, sf))


@query("module_folders")
def _(spark, sf):
    return rollup.module_folders(rollup.folder_summary(detailed(spark, sf)))


@query("module_components")
def _(spark, sf):
    return rollup.module_components(detailed(spark, sf))


@query("domain_modules")
def _(spark, sf):
    return rollup.domain_modules(rollup.folder_summary(detailed(spark, sf)))


@query("system_overview")
def _(spark, sf):
    return rollup.system_overview(rollup.folder_summary(detailed(spark, sf)))


@query("hierarchy_rollup")
def _(spark, sf):
    return rollup.hierarchy_rollup(rollup.folder_summary(detailed(spark, sf)))


for _name, _label in {"language_breakdown": "language", "purpose_breakdown": "file_purpose"}.items():
    query(_name)(lambda spark, sf, label=_label: rollup.breakdown(file_facts(spark, sf), label))


@query("dependency_union")
def _(spark, sf):
    return rollup.dependency_union(file_facts(spark, sf)).select("repo", "dependency", "rank")


@query("tech_usage")
def _(spark, sf):
    return rollup.tech_usage(file_facts(spark, sf))


@query("graph_type_counts")
def _(spark, sf):
    return graph.type_counts(stored_detailed(spark, sf))


@query("detected_features")
def _(spark, sf):
    return rollup.detected_features(stored_facts(spark, sf))


@query("processing_stats")
def _(spark, sf):
    return rollup.processing_stats(*answered(spark, sf))


# --- graph -------------------------------------------------------------------------------------------------


@query("build_nodes")
def _(spark, sf):
    return graph.build_nodes(stored_detailed(spark, sf)).select(
        "repo", "id", "type", "name", "path", *[F.col("metadata")[key].alias(label) for key, label in NODE_METADATA.items()])


@query("build_edges")
def _(spark, sf):
    return graph.build_edges(stored_detailed(spark, sf)).select(
        "repo", "source", "target", "type", "weight", F.col("metadata")["import_line"].alias("import_line"))


def _simple(spark, sf):
    rows = stored_detailed(spark, sf)
    nodes = materialize(graph.build_nodes(rows).select("repo", "id", "type"), "nodes")
    return nodes, materialize(graph.simple_edges(graph.build_edges(rows)), "links")


@query("degree_centrality")
def _(spark, sf):
    return graph.degree_centrality(*_simple(spark, sf)).select(
        "repo", "id", F.round("degree_centrality", 9).alias("degree_centrality"))


@query("betweenness_centrality")
def _(spark, sf):
    return graph.betweenness_centrality(*_simple(spark, sf)).select(
        "repo", "id", F.round("betweenness_centrality", 9).alias("betweenness_centrality"))


@query("centrality_to_nodes")
def _(spark, sf):
    nodes, links = _simple(spark, sf)
    joined = graph.centrality_to_nodes(nodes, graph.degree_centrality(nodes, links),
                                       graph.betweenness_centrality(nodes, links))
    return joined.select("repo", "id", "type", F.round("degree_centrality", 9).alias("degree_centrality"),
                         F.round("betweenness_centrality", 9).alias("betweenness_centrality"))


# --- ranking ------------------------------------------------------------------------------------------------


@query("importance_score")
def _(spark, sf):
    return ranking.scored(file_facts(spark, sf)).select("repo", "file_path", "score")


@query("top_files")
def _(spark, sf):
    return ranking.top_files(file_facts(spark, sf)).select("repo", "file_path", "score", "rank")


@query("top_k_per_file")
def _(spark, sf):
    rows = facts.file_bundles(inputs.corpus(spark, sf))
    return rows.select("repo", "file_path", bar(F.transform(F.slice("funcs", 1, 5), lambda f: f["name"])).alias("functions"),
                       bar(F.transform(F.slice("apis", 1, 3), lambda a: F.concat_ws(" ", a["method"], a["path"]))).alias("apis"),
                       bar(F.slice("dependencies", 1, 10)).alias("dependencies"))


@query("first_n_and_more")
def _(spark, sf):
    rows = stored_facts(spark, sf)
    found = [ranking.first_n_and_more(rows, word).withColumn("word", F.lit(word)) for word in ("page", "component")]
    return found[0].unionByName(found[1])


@query("backend_top_n")
def _(spark, sf):
    return ranking.backend_top_n(stored_facts(spark, sf), 10).select("repo", "file_path", "rank")


@query("service_port_assignment")
def _(spark, sf):
    return ranking.service_ports(stored_facts(spark, sf)).select("repo", "file_path", "port")


@query("keep_latest")
def _(spark, sf):
    return ranking.keep_latest(inputs.outputs(spark, sf)).select("repo", "name", "stamp", "rank")


@query("job_latest_status")
def _(spark, sf):
    return ranking.latest_status(inputs.jobs(spark, sf))


@query("retention_filter")
def _(spark, sf):
    return ranking.retained(inputs.jobs(spark, sf), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
