"""Code graph: import resolution, nodes, edges and exact centralities per repository."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, extract, paths, rules
from ..session import materialize
from .unnest import unnest


def resolve_imports(detailed: DataFrame) -> DataFrame:
    """Relative imports matched to files of the same repository.

    Files are reduced to one row per path without suffix (best extension wins), so an import
    needs one equality join and not a row per candidate extension.
    """
    rank = F.array_position(F.array(*[F.lit(e) for e in rules.RESOLVE_EXTENSIONS]), paths.extension(F.col("file_path")))
    targets = (detailed.select("repo", "file_path", rank.alias("rank")).where(F.col("rank") > 0)
               .groupBy("repo", paths.without_suffix(F.col("file_path")).alias("base"))
               .agg(F.min(F.struct("rank", "file_path"))["file_path"].alias("target")))
    imports = unnest(detailed, ["repo", "file_path"], "imports", "i").select(
        "repo", "file_path", "i.line", "i.source",
        paths.resolve_relative(F.col("file_path"), F.col("i.source")).alias("base"))
    return imports.where(F.col("base").isNotNull()).join(targets, ["repo", "base"]) \
        .select("repo", "file_path", "line", "source", "target")


def external_dependencies(detailed: DataFrame) -> DataFrame:
    """One node per repository and outside package, with the first import that names it."""
    imports = unnest(detailed, ["repo", "file_path"], "imports", "i", "at") \
        .where(extract.external(F.col("i.source")))
    return imports.groupBy("repo", extract.top_name(F.col("i.source")).alias("name")).agg(
        F.min(F.struct("file_path", "at", "i.source"))["source"].alias("full_name"))


def endpoint_handlers(bundles: DataFrame) -> DataFrame:
    """Endpoints with a handler name, and whether that function is defined in the file.

    Both lists belong to one file row, so the equality join runs inside the row.
    """
    rows = unnest(bundles, ["repo", "file_path", F.transform("funcs", lambda f: f["name"]).alias("names")], "apis", "e")
    return rows.where(F.col("e.function_name") != "").select(
        "repo", "file_path", "e.line", "e.method", "e.path", "e.function_name",
        F.array_contains("names", F.col("e.function_name")).alias("defined"))


def _id(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *parts)


def _metadata(**entries):
    return F.map_filter(
        F.create_map(*[x for name, value in entries.items() for x in (F.lit(name), value.cast("string"))]),
        lambda _, v: v.isNotNull())


def _exploded(detailed: DataFrame, entries: list[Column], fields: list[str]) -> DataFrame:
    """All entries of a file in one array, exploded once: one read of ``detailed``, no shuffle."""
    return unnest(detailed, ["repo"], F.flatten(F.array(*entries)), "x").select("repo", *[f"x.{name}" for name in fields])


def _endpoints() -> Column:
    return extract.with_handlers(F.col("endpoints"), F.col("functions"), F.col("language"))


def _outside(imports="imports") -> Column:
    return F.filter(imports, lambda i: extract.external(i["source"]))


def build_nodes(detailed: DataFrame) -> DataFrame:
    """Node list of the detailed profile; repeated definitions stay repeated, as list entries are counted later.

    Files and their symbols come from one read; folders and outside packages, which several files share, are grouped in
    one narrow read each. A folder's files are its ``contains`` edges and no list in its row.
    """
    path = F.col("file_path")
    sizes = [F.size(c) for c in ("endpoints", "jsx_components", "classes", "functions")]

    def node(kind, parts, name, **metadata):
        return F.struct(_id(kind if kind != "api_endpoint" else "api", *parts).alias("id"), F.lit(kind).alias("type"),
                        name.alias("name"), path.alias("path"), _metadata(**metadata).alias("metadata"))
    service = F.col("service_info")
    entries = [
        F.array(node("file", [path], paths.file_name(path), language=F.col("language"), lines_of_code=F.col("lines_of_code"),
                     category=classify.file_category(F.col("file_purpose"), *sizes), function_count=sizes[3],
                     class_count=sizes[2], api_endpoint_count=sizes[0], service_type=service["type"],
                     service_framework=service["framework"], service_port=service["port"])),
        F.transform("functions", lambda x: node(
            "function", [path, x["name"]], x["name"], line=x["line"], parameters=F.array_join(x["params"], ","),
            is_async=x["is_async"])),
        F.transform("classes", lambda x: node(
            "class", [path, x["name"]], x["name"], line=x["line"], methods=F.array_join(x["methods"], ","))),
        F.transform(_endpoints(), lambda e: node(
            "api_endpoint", [path, e["method"], e["path"]], F.concat_ws(" ", e["method"], e["path"]), method=e["method"],
            path=e["path"], line=e["line"], function_name=e["function_name"], parameters=F.array_join(e["parameters"], ",")))]
    fields = ["id", "type", "name", "path", "metadata"]
    outside = external_dependencies(detailed).select(
        "repo", _id("external", F.col("name")).alias("id"), F.lit("external_dependency").alias("type"), "name",
        F.lit(None).cast("string").alias("path"),
        _metadata(full_name=F.col("full_name"), is_external=F.lit(True)).alias("metadata"))
    folders = detailed.groupBy("repo", paths.folder_of(path).alias("path")).agg(F.count("*").alias("n")).select(
        "repo", _id("folder", F.col("path")).alias("id"), F.lit("folder").alias("type"),
        paths.file_name(F.col("path")).alias("name"), "path", _metadata(file_count=F.col("n")).alias("metadata"))
    return reduce(DataFrame.unionByName, [_exploded(detailed, entries, fields), outside, folders])


def build_edges(detailed: DataFrame) -> DataFrame:
    """Edge list with weight 1; parallel edges stay in the list. One read gives all edges but resolved imports."""
    path = F.col("file_path")
    me = _id("file", path)

    def edge(source, target, kind, **metadata):
        none = F.create_map().cast("map<string,string>")
        return F.struct(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), F.lit(1.0).alias("weight"),
                        (_metadata(**metadata) if metadata else none).alias("metadata"))

    def api(e):
        return _id("api", path, e["method"], e["path"])
    entries = [
        F.array(edge(_id("folder", paths.folder_of(path)), me, "contains")),
        F.transform("functions", lambda x: edge(me, _id("function", path, x["name"]), "contains")),
        F.transform("classes", lambda x: edge(me, _id("class", path, x["name"]), "contains")),
        F.transform(_outside(), lambda i: edge(me, _id("external", extract.top_name(i["source"])), "depends_on",
                                               import_line=i["line"])),
        F.transform("endpoints", lambda e: edge(me, api(e), "exposes")),
        F.transform(F.filter(_endpoints(), lambda e: e["function_name"].isNotNull()), lambda e: edge(
            api(e), _id("function", path, e["function_name"]), "handled_by"))]
    imports = resolve_imports(detailed).select(
        "repo", me.alias("source"), _id("file", F.col("target")).alias("target"), F.lit("imports").alias("type"),
        F.lit(1.0).alias("weight"), _metadata(import_line=F.col("line")).alias("metadata"))
    return _exploded(detailed, entries, ["source", "target", "type", "weight", "metadata"]).unionByName(imports)


def type_counts(detailed: DataFrame) -> DataFrame:
    """List entries by type, repeated entries included. Counts are sums of array sizes: no node and no edge is made, but
    for outside packages and resolved imports."""
    handled = F.size(F.filter(_endpoints(), lambda e: e["function_name"].isNotNull()))
    sums = {("node", "function"): F.size("functions"), ("node", "class"): F.size("classes"),
            ("node", "api_endpoint"): F.size("endpoints"), ("edge", "exposes"): F.size("endpoints"),
            ("edge", "handled_by"): handled, ("edge", "depends_on"): F.size(_outside()),
            ("edge", "contains"): 1 + F.size("functions") + F.size("classes"), ("node", "file"): F.lit(1)}
    columns = {key: f"{key[0]}_{key[1]}" for key in sums}
    per_folder = detailed.groupBy("repo", paths.folder_of(F.col("file_path")).alias("folder")).agg(
        *[F.sum(size.cast("long")).alias(columns[key]) for key, size in sums.items()])
    per_repo = per_folder.groupBy("repo").agg(F.count("*").alias("node_folder"), *[
        F.sum(c).alias(c) for c in columns.values()])
    columns[("node", "folder")] = "node_folder"
    counted = per_repo.select("repo", F.explode(F.array(*[F.struct(
        F.lit(kind).alias("kind"), F.lit(name).alias("type"), F.col(c).alias("entries"))
        for (kind, name), c in columns.items()])).alias("x")).select("repo", "x.*").where("entries > 0")

    def of(df, kind, name):
        return df.groupBy("repo").agg(F.count("*").alias("entries")).select(
            "repo", F.lit(kind).alias("kind"), F.lit(name).alias("type"), "entries")
    return counted.unionByName(of(external_dependencies(detailed), "node", "external_dependency")) \
        .unionByName(of(resolve_imports(detailed), "edge", "imports"))


def simple_edges(edges: DataFrame) -> DataFrame:
    return edges.select("repo", "source", "target").distinct()


def node_ids(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """All graph nodes: listed ones and edge ends that have no node row."""
    return nodes.select("repo", "id").unionByName(links.select("repo", F.col("source").alias("id"))) \
        .unionByName(links.select("repo", F.col("target").alias("id"))).distinct()


def node_totals(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return node_ids(nodes, links).groupBy("repo").agg(F.count("*").alias("n"))


def degree_centrality(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(in + out) / (n - 1) on the simple directed graph. ``links`` are distinct edges."""
    ends = links.select("repo", F.explode(F.array("source", "target")).alias("id"), F.lit(1).alias("one"))
    listed = nodes.select("repo", "id", F.lit(0).alias("one"))
    degree = ends.unionByName(listed).groupBy("repo", "id").agg(F.sum("one").alias("degree"))
    totals = degree.groupBy("repo").agg(F.count("*").alias("n"))
    return degree.join(totals, "repo").select(
        "repo", "id", F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(F.col("degree") / (F.col("n") - 1))
        .alias("degree_centrality"))


def _numbered(core: DataFrame, folded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(repo, id, v)``, a number for every node of ``core``, and its edges ``(v, w, leaves)`` by number. Numbers hold
    across repositories, so rows per start and node need neither the repository nor a path."""
    ends = core.select("repo", F.col("source").alias("id")).unionByName(core.select("repo", F.col("target").alias("id")))
    numbers = materialize(ends.distinct().withColumn("v", F.monotonically_increasing_id()), "numbers")
    steps = core.join(numbers.withColumnRenamed("id", "source"), ["repo", "source"]) \
        .join(numbers.select("repo", F.col("id").alias("target"), F.col("v").alias("w")), ["repo", "target"]) \
        .join(folded.withColumnRenamed("parent", "target"), ["repo", "target"], "left") \
        .select("v", "w", F.coalesce("leaves", F.lit(0)).cast("long").alias("leaves"))
    return numbers, materialize(steps, "steps")


def _levels(chosen: DataFrame, steps: DataFrame) -> list[DataFrame]:
    """Breadth-first levels from the starts of the edges ``chosen``: ``(s, v, paths, leaves)`` of the nodes that many
    steps away, with the number of shortest paths. The first level is the edges themselves; later ones are written, and
    a node is met once per start."""
    found = [chosen.select(F.col("v").alias("s"), F.col("w").alias("v"), F.lit(1.0).alias("paths"), "leaves")]
    while True:
        reached = found[-1].drop("leaves").join(steps, "v").where(F.col("w") != F.col("s")) \
            .groupBy("s", F.col("w").alias("v")).agg(F.sum("paths").alias("paths"), F.first("leaves").alias("leaves"))
        before = reduce(DataFrame.unionByName, [level.select("s", "v") for level in found])
        fresh = materialize(reached.join(before, ["s", "v"], "left_anti"), "level")
        if fresh.isEmpty():
            return found
        found.append(fresh)


def _passed(levels: list[DataFrame], steps: DataFrame) -> list[DataFrame]:
    """Rows ``(v, share)`` per level: the paths from each start that pass through a node, counted by the share of each
    target's shortest paths. Accumulated from the last level to the first; every step goes from a node that was reached
    along its own edges, so a node with very many parents meets only those that the start reaches."""
    shares, deeper = [], None
    for number, level in reversed(list(enumerate(levels))):
        own = level.select("s", "v", "paths", F.col("leaves").cast("double").alias("share"))
        if deeper is not None:
            onward = level.select("s", F.col("v").alias("u"), F.col("paths").alias("to_u")) \
                .join(steps.select(F.col("v").alias("u"), F.col("w").alias("v")), "u")
            passed = onward.join(deeper, ["s", "v"]).select(
                "s", F.col("u").alias("v"), F.col("to_u").alias("paths"),
                (F.col("to_u") * (F.col("share") + 1) / F.col("paths")).alias("share"))
            own = own.unionByName(passed)
        if number:  # nothing lies before the first level, so only its sums by node are read
            own = materialize(own.groupBy("s", "v").agg(F.max("paths").alias("paths"), F.sum("share").alias("share")), "passed")
        deeper = own
        shares.append(deeper.select("v", "share"))
    return shares


def betweenness_centrality(nodes: DataFrame, links: DataFrame, blocks: int = 1) -> DataFrame:
    """Exact directed betweenness, normalised by (n-1)(n-2); nodes without any are left out.

    Symbols that hang on one node only can neither be passed through nor start a path, so they are folded into their
    parent as a weight. From every other node, shortest paths are counted forwards level by level and the shares of the
    nodes they pass accumulated backwards, both from reached nodes along their edges: work and tables are the connected
    pairs times the edges that leave a node, as rows of numbers, and there are two written rounds per level. ``blocks``
    deals the starting nodes into as many runs, which divides the size of the tables.
    """
    links = materialize(links.where(F.col("source") != F.col("target")), "links")
    sources = links.select("repo", F.col("source").alias("target")).distinct()
    fan_in = links.groupBy("repo", "target").agg(F.count("*").alias("parents"))
    hanging = fan_in.where(F.col("parents") == 1).join(sources, ["repo", "target"], "left_anti") \
        .select("repo", "target")
    folded = links.join(hanging, ["repo", "target"], "left_semi").groupBy("repo", F.col("source").alias("parent")) \
        .agg(F.count("*").alias("leaves"))
    core = links.join(hanging, ["repo", "target"], "left_anti").select("repo", "source", "target")
    numbers, steps = _numbered(core, folded)
    shares = []
    for block in range(blocks):
        chosen = steps if blocks == 1 else steps.where(F.pmod(F.xxhash64("v"), F.lit(blocks)) == block)
        shares += _passed(_levels(chosen, steps), steps)
    if not shares:
        shares = [steps.limit(0).select("v", F.lit(0.0).alias("share"))]
    summed = reduce(DataFrame.unionByName, shares).groupBy("v").agg(F.sum("share").alias("share")).where("share > 0") \
        .join(numbers, "v").select("repo", "id", "share")
    return summed.join(node_totals(nodes, links), "repo").where(F.col("n") > 2).select(
        "repo", "id", (F.col("share") / ((F.col("n") - 1) * (F.col("n") - 2))).alias("betweenness_centrality"))


def centrality_to_nodes(nodes: DataFrame, degree: DataFrame, betweenness: DataFrame) -> DataFrame:
    """Attach both measures to the node list; a missing value is 0."""
    joined = nodes.join(degree, ["repo", "id"], "left").join(betweenness, ["repo", "id"], "left")
    return joined.withColumn("degree_centrality", F.coalesce("degree_centrality", F.lit(0.0))) \
        .withColumn("betweenness_centrality", F.coalesce("betweenness_centrality", F.lit(0.0)))
