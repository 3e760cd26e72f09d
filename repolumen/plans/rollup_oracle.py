"""Checking SQL for joins, roll-ups, graph and ranking."""

from __future__ import annotations

from ..functions import rules
from . import inputs
from .file_oracle import JS, PY, cases, has, listed
from .registry import oracle, part

FOLDER = r"CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE 'root' END"
MODULE = "CASE WHEN contains(folder, '/') THEN string_split(folder, '/')[1] ELSE 'core' END"
ROLE = cases("lower(module)", rules.MODULE_ROLES, f"'{rules.DEFAULT_ROLE}'")
DOMAIN = cases("lower(module)", rules.DOMAINS, f"'{rules.DEFAULT_DOMAIN}'")


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


part("d_rows", "d_facts", f"SELECT *, {FOLDER} AS folder FROM d_facts")
part("d_lang", "d_rows", """SELECT repo, folder, arg_min(language, rk) AS primary_language FROM (
  SELECT repo, folder, language, row_number() OVER (PARTITION BY repo, folder ORDER BY count(*) DESC, min(file_path)) AS rk
  FROM d_rows GROUP BY repo, folder, language) GROUP BY ALL""")
part("d_folders", "d_rows d_lang", f"""
SELECT *, {cases('lower(folder)', rules.FOLDER_PURPOSE_PATHS, "CASE WHEN api_files > total_files * 0.5 THEN 'API Implementation' "
  "WHEN jsx_files > total_files * 0.5 THEN 'Frontend Components' WHEN any_b THEN 'Backend Services' "
  "WHEN any_f THEN 'Frontend Application' ELSE 'General Purpose' END")} AS folder_purpose,
  CASE WHEN any_b AND any_f THEN 'mixed' WHEN any_b THEN 'backend' WHEN any_f THEN 'frontend' END AS service_type, {MODULE} AS module
FROM (SELECT repo, folder, count(*) AS total_files, {big('sum(n_eps)')} AS endpoint_count, {big('sum(n_funcs)')} AS function_count,
    {big('sum(lines_of_code)')} AS lines_of_code, count(*) FILTER (n_eps > 0) AS api_files, count(*) FILTER (n_jsx > 0) AS jsx_files,
    coalesce(bool_or(type = 'backend'), FALSE) AS any_b, coalesce(bool_or(type = 'frontend'), FALSE) AS any_f,
    array_to_string(list_sort(list_distinct(flatten(list(points)))), '|') AS integration_patterns
  FROM d_rows GROUP BY repo, folder) JOIN d_lang USING (repo, folder)""")
_COMPONENTS = f"""
SELECT repo, folder, component, CAST(row_number() OVER (PARTITION BY repo, folder ORDER BY component) AS INTEGER) AS rank FROM (
  SELECT DISTINCT repo, {FOLDER} AS folder, component FROM (
    SELECT repo, file_path, name AS component, row_number() OVER (PARTITION BY repo, file_path ORDER BY ord) AS r FROM d_funcs
    UNION ALL SELECT repo, file_path, name, row_number() OVER (PARTITION BY repo, file_path ORDER BY line) FROM d_classes
    UNION ALL SELECT repo, file_path, tag, row_number() OVER (PARTITION BY repo, file_path ORDER BY k) FROM d_tags) WHERE r <= {{}})"""
part("d_components", "d_funcs d_classes d_tags", _COMPONENTS.format(2) + " QUALIFY rank <= 10")
part("d_all_components", "d_funcs d_classes d_tags", _COMPONENTS.format(1 << 40))
part("d_folder_deps", "d_dep_rows", f"SELECT DISTINCT repo, {FOLDER} AS folder, dep AS dependency FROM d_dep_rows")
part("d_modules", "d_folders", f"""SELECT *, {ROLE} AS role, {DOMAIN} AS domain FROM (
  SELECT repo, module, count(*) AS folders, {big('sum(total_files)')} AS total_files,
    list_sort(list(DISTINCT primary_language)) AS languages, list_sort(list(DISTINCT folder_purpose)) AS responsibilities
  FROM d_folders GROUP BY ALL)""")
part("d_domains", "d_modules", f"""SELECT *, 'Domain with ' || modules || ' modules and ' || total_files || ' files' AS overview FROM (
  SELECT repo, domain, count(*) AS modules, {big('sum(total_files)')} AS total_files,
    list_sort(list_distinct(flatten(list(languages)))) AS languages FROM d_modules GROUP BY ALL)""")
part("usage", "facts", """SELECT repo, dependency, count(*) AS files FROM (
  SELECT repo, unnest(dependencies) AS dependency FROM facts WHERE is_backend) GROUP BY ALL""")

oracle("folder_purpose", "d_folders", "SELECT repo, folder, folder_purpose FROM d_folders")
oracle("module_role", "files", f"""SELECT repo, module, {ROLE} AS role, {DOMAIN} AS domain FROM (
  SELECT DISTINCT repo, {MODULE} AS module FROM (SELECT repo, {FOLDER} AS folder FROM files))""")
part("kinds", "facts", f"""SELECT repo, CASE
  {" ".join(f"WHEN bool_or(is_backend AND {has('plow', w)}) THEN '{label}'" for w, label in rules.PROJECT_TYPES)}
  WHEN sum(api_count) > 10 THEN 'API Platform' ELSE 'Software Project' END AS project_type FROM facts GROUP BY repo""")
oracle("project_type", "kinds", "SELECT repo, project_type FROM kinds")

# --- joins ---------------------------------------------------------------------------------------------
# Every relative import of this corpus is "./name" next to the importing file.
part("resolved", "d_imports kept_detailed", f"""
SELECT i.repo, i.file_path, i.line, i.source, arg_min(f.file_path, e.k) AS target
FROM (SELECT *, regexp_replace(file_path, '[^/]*$', '') || source[3:] AS base FROM d_imports WHERE starts_with(source, './')) i
  CROSS JOIN (VALUES {", ".join(f"('{e}', {k})" for k, e in enumerate(rules.RESOLVE_EXTENSIONS))}) e(ext, k)
  JOIN kept_detailed f ON f.repo = i.repo AND f.file_path = i.base || e.ext
GROUP BY ALL""")
oracle("resolve_imports", "resolved",
       "SELECT repo, file_path, CAST(line AS INTEGER) AS line, source, target FROM resolved")
oracle("endpoint_handler_link", "eps fns", """
SELECT e.repo, e.file_path, CAST(e.line AS INTEGER) AS line, method, path, function_name,
  EXISTS (SELECT 1 FROM fns f WHERE f.repo = e.repo AND f.file_path = e.file_path AND f.name = e.function_name) AS defined
FROM eps e WHERE function_name <> ''""")
_OUTSIDE = "left(source, 1) NOT IN ('.', '/')"
part("externals", "d_imports", f"""SELECT repo, string_split(source, '/')[1] AS name, arg_min(source, (file_path, line)) AS full_name
  FROM d_imports WHERE {_OUTSIDE} GROUP BY ALL""")
oracle("external_dependency_dim", "externals", "SELECT repo, name, full_name FROM externals")
_TECH = ", ".join(f"({i}, '{n}', '{c}', '{p}')" for i, (n, c, p) in enumerate(rules.MAJOR_TECHS))
part("major", "usage", f"""SELECT repo, dependency, category, purpose, files, ord
  FROM usage JOIN (VALUES {_TECH}) t(ord, dependency, category, purpose) USING (dependency)""")
oracle("tech_usage_lookup", "major", "SELECT repo, dependency, category, purpose, files FROM major")


def hits(rule_list) -> str:
    selects = []
    for i, (label, kind, tokens) in enumerate(rule_list):
        test = {"language": f"l IN ({listed(tokens)})", "exact": f"d IN ({listed(tokens)})",
                "part": f"contains(lower(d), '{tokens[0]}')"}[kind]
        selects.append(f"SELECT DISTINCT repo, {i} AS ord, '{label}' AS label FROM names WHERE {test}")
    return " UNION ALL ".join(selects)


part("names", "facts", """SELECT repo, NULL AS l, unnest(dependencies) AS d FROM facts WHERE is_backend
  UNION ALL SELECT repo, language, NULL FROM facts""")
part("badges", "names", hits(rules.TECH_BADGES))
part("techs", "names", hits(rules.BACKEND_TECH))
part("thanks", "names", hits(rules.ACKNOWLEDGEMENTS))
for _name, _table in {"tech_badges": "badges", "backend_tech": "techs", "acknowledgements": "thanks"}.items():
    oracle(_name, _table, f"SELECT repo, CAST(ord AS INTEGER) AS ord, label FROM {_table}")
oracle("module_interfaces", "d_eps", f"""
SELECT repo, {MODULE} AS module, folder, CAST(r AS INTEGER) AS rank, method || ' ' || path AS interface FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, folder ORDER BY file_path, line) AS r FROM (
    SELECT *, {FOLDER} AS folder FROM d_eps)) WHERE r <= 5""")

# --- aggregates ------------------------------------------------------------------------------------------
part("totals", "facts", f"""SELECT repo, count(*) AS total_files, count(*) FILTER (is_backend) AS backend_files,
  {big('sum(api_count)')} AS total_apis, {big('sum(function_count)')} AS total_functions,
  list_sort(list(DISTINCT language)) AS languages FROM facts GROUP BY repo""")
oracle("repo_summary", "totals", "SELECT * REPLACE (array_to_string(languages, '|') AS languages) FROM totals")
oracle("file_counts", "facts", "SELECT repo, file_path, function_count, api_count, lines_of_code FROM facts")
oracle("folder_summary", "d_folders d_components d_folder_deps", """
SELECT repo, folder, total_files, endpoint_count, primary_language, service_type, folder_purpose, integration_patterns,
  coalesce(c, '') AS key_components, coalesce(n, 0) AS dependencies FROM d_folders
LEFT JOIN (SELECT repo, folder, string_agg(component, '|' ORDER BY rank) AS c FROM d_components GROUP BY ALL) USING (repo, folder)
LEFT JOIN (SELECT repo, folder, count(*) AS n FROM d_folder_deps GROUP BY ALL) USING (repo, folder)""")
oracle("folder_dependencies", "d_folder_deps", "SELECT repo, folder, dependency FROM d_folder_deps")
oracle("primary_language", "d_lang", "SELECT repo, folder, primary_language FROM d_lang")
oracle("folder_service_type", "d_folders", "SELECT repo, folder, service_type FROM d_folders")
oracle("key_components", "d_components", "SELECT repo, folder, component, rank FROM d_components")
oracle("folder_components", "d_all_components", "SELECT repo, folder, component, rank FROM d_all_components")
oracle("integration_patterns", "d_folders", "SELECT repo, folder, integration_patterns AS patterns FROM d_folders")
oracle("module_summary", "d_modules", """SELECT repo, module, folders, total_files, role, domain,
  array_to_string(languages, '|') AS languages FROM d_modules""")
oracle("module_responsibilities", "d_modules",
       "SELECT repo, module, array_to_string(responsibilities, '|') AS responsibilities FROM d_modules")
oracle("domain_summary", "d_domains", """SELECT repo, domain, modules, total_files, array_to_string(languages, '|') AS languages,
  overview FROM d_domains""")
oracle("folder_files", "d_rows", "SELECT repo, folder, file_path, language, lines_of_code FROM d_rows")
oracle("folder_endpoints", "d_eps", f"""SELECT repo, {FOLDER} AS folder, file_path, CAST(line AS INTEGER) AS line, method, path,
  CASE WHEN {PY} THEN 'FastAPI ' ELSE '' END || method || ' endpoint for ' || path AS description FROM d_eps""")
oracle("module_folders", "d_folders", "SELECT repo, module, folder, total_files, primary_language, folder_purpose FROM d_folders")
oracle("module_components", "d_components", f"SELECT repo, {MODULE} AS module, folder, component FROM d_components")
oracle("domain_modules", "d_folders", f"""SELECT repo, {DOMAIN} AS domain, module, count(*) AS folders, {big('sum(total_files)')} AS total_files
  FROM d_folders GROUP BY ALL""")
oracle("system_overview", "d_domains", f"""SELECT *, 'System with ' || files || ' files organized into ' || modules || ' modules across '
  || domains || ' domains' AS overview FROM (SELECT repo, {big('sum(total_files)')} AS files, {big('sum(modules)')} AS modules,
  count(*) AS domains FROM d_domains GROUP BY repo)""")
oracle("hierarchy_rollup", "d_folders", f"""
SELECT repo, domain, module, folder, CAST(grouping_id(repo, domain, module, folder) AS BIGINT) AS level,
  {", ".join(f"{big(f'sum({m})')} AS {m}" for m in ("total_files", "endpoint_count", "function_count", "lines_of_code"))}
FROM (SELECT *, {DOMAIN} AS domain FROM d_folders) GROUP BY ROLLUP (repo, domain, module, folder)""")
for _name, _label in {"language_breakdown": "language", "purpose_breakdown": "file_purpose"}.items():
    oracle(_name, "facts", f"SELECT repo, {_label}, count(*) AS files FROM facts GROUP BY ALL")
part("first_deps", "facts", """SELECT repo, dependency, CAST(row_number() OVER (PARTITION BY repo ORDER BY dependency) AS INTEGER) AS rank
  FROM (SELECT DISTINCT repo, unnest(dependencies) AS dependency FROM facts) QUALIFY rank <= 20""")
oracle("dependency_union", "facts", """SELECT repo, dependency, CAST(row_number() OVER (PARTITION BY repo ORDER BY dependency) AS INTEGER) AS rank
  FROM (SELECT DISTINCT repo, unnest(dependencies) AS dependency FROM facts)""")
oracle("tech_usage", "usage", "SELECT repo, dependency, files FROM usage")
_FEATURE_ROWS = " UNION ALL ".join(
    f"SELECT repo, file_path, {i} AS ord, '{label}' AS feature FROM facts WHERE is_backend AND {has('plow', words)}"
    for i, (words, label) in enumerate(rules.FEATURES))
part("features", "facts totals", f"""
WITH found AS (SELECT repo, feature, row_number() OVER (PARTITION BY repo ORDER BY file_path, ord) AS rank FROM ({_FEATURE_ROWS}) QUALIFY rank <= 8)
SELECT repo, CAST(rank AS INTEGER) AS rank, feature FROM found
UNION ALL SELECT repo, k, CASE k WHEN 1 THEN '**' || backend_files || ' Backend Services**: Microservices architecture with specialized functionality'
  WHEN 2 THEN '**' || total_apis || ' API Endpoints**: Comprehensive REST API with full documentation'
  WHEN 3 THEN '**High Performance**: Optimized code with ' || total_functions || ' functions'
  ELSE '**Security First**: Built-in security measures and best practices' END
FROM totals, (VALUES (1), (2), (3), (4)) v(k) WHERE repo NOT IN (SELECT repo FROM found)""")
oracle("detected_features", "features", "SELECT repo, rank, feature FROM features")

# --- graph ---------------------------------------------------------------------------------------------------
part("nodes", "d_facts d_funcs d_classes externals d_api d_rows", """
SELECT repo, 'file:' || file_path AS id, 'file' AS type, regexp_extract(file_path, '[^/]*$') AS name, file_path AS path,
  file_purpose AS category, language, lines_of_code::VARCHAR AS lines_of_code, n_funcs::VARCHAR AS function_count,
  n_classes::VARCHAR AS class_count, n_eps::VARCHAR AS api_endpoint_count, d_facts.type AS service_type,
  framework AS service_framework, port::VARCHAR AS service_port FROM d_facts
UNION ALL BY NAME SELECT repo, 'function:' || file_path || ':' || name AS id, 'function' AS type, name, file_path AS path,
  line::VARCHAR AS line, params AS parameters, is_async::VARCHAR AS is_async FROM d_funcs
UNION ALL BY NAME SELECT repo, 'class:' || file_path || ':' || name AS id, 'class' AS type, name, file_path AS path,
  line::VARCHAR AS line, methods FROM d_classes
UNION ALL BY NAME SELECT repo, 'external:' || name AS id, 'external_dependency' AS type, name, full_name, 'true' AS is_external FROM externals
UNION ALL BY NAME SELECT repo, 'api:' || file_path || ':' || method || ':' || path AS id, 'api_endpoint' AS type,
  method || ' ' || path AS name, file_path AS path, line::VARCHAR AS line, method, path AS api_path, function_name,
  array_to_string(names, ',') AS parameters FROM d_api
UNION ALL BY NAME SELECT repo, 'folder:' || folder AS id, 'folder' AS type, regexp_extract(folder, '[^/]*$') AS name, folder AS path,
  count(*)::VARCHAR AS file_count FROM d_rows GROUP BY repo, folder""")
part("edges", "d_funcs d_classes resolved d_imports d_api d_rows", f"""
SELECT repo, 'file:' || file_path AS source, 'function:' || file_path || ':' || name AS target, 'contains' AS type, NULL AS import_line FROM d_funcs
UNION ALL SELECT repo, 'file:' || file_path, 'class:' || file_path || ':' || name, 'contains', NULL FROM d_classes
UNION ALL SELECT repo, 'file:' || file_path, 'file:' || target, 'imports', line FROM resolved
UNION ALL SELECT repo, 'file:' || file_path, 'external:' || string_split(source, '/')[1], 'depends_on', line FROM d_imports WHERE {_OUTSIDE}
UNION ALL SELECT repo, 'file:' || file_path, 'api:' || file_path || ':' || method || ':' || path, 'exposes', NULL FROM d_api
UNION ALL SELECT repo, 'api:' || file_path || ':' || method || ':' || path, 'function:' || file_path || ':' || function_name, 'handled_by', NULL
  FROM d_api WHERE function_name IS NOT NULL
UNION ALL SELECT repo, 'folder:' || folder, 'file:' || file_path, 'contains', NULL FROM d_rows""")
part("links", "edges", "SELECT DISTINCT repo, source, target FROM edges")
part("ids", "nodes links", """SELECT DISTINCT repo, id FROM (SELECT repo, id FROM nodes
  UNION ALL SELECT repo, source FROM links UNION ALL SELECT repo, target FROM links)""")
part("degree", "ids links", """
SELECT ids.repo, ids.id, count(e.id) / (any_value(n) - 1) AS degree_centrality
FROM ids JOIN (SELECT repo, count(*) AS n FROM ids GROUP BY repo) USING (repo)
  LEFT JOIN (SELECT repo, source AS id FROM links UNION ALL SELECT repo, target FROM links) e ON e.repo = ids.repo AND e.id = ids.id
GROUP BY ids.repo, ids.id""")
# Breadth-first search by recursion: every shortest path is one row, so equal rows are path counts.
part("walks", "links", """
SELECT * FROM (WITH RECURSIVE walk AS (
  SELECT repo, source AS s, target AS t, 1 AS d, [source, target] AS p FROM links
  UNION ALL SELECT w.repo, w.s, l.target, w.d + 1, list_append(w.p, l.target) FROM walk w
    JOIN links l ON l.repo = w.repo AND l.source = w.t WHERE NOT list_contains(w.p, l.target))
SELECT * FROM walk)""")
part("shortest", "walks", """SELECT * FROM walks JOIN (SELECT repo, s, t, min(d) AS d FROM walks GROUP BY ALL) USING (repo, s, t, d)""")
part("between", "shortest ids", """
SELECT repo, id, sum(1.0::DOUBLE / c) / any_value((n - 1) * (n - 2)) AS betweenness_centrality FROM (
  SELECT repo, s, t, unnest(p[2:-2]) AS id, c FROM shortest
    JOIN (SELECT repo, s, t, count(*) AS c FROM shortest GROUP BY ALL) USING (repo, s, t))
JOIN (SELECT repo, count(*) AS n FROM ids GROUP BY repo) USING (repo) GROUP BY repo, id""")
oracle("build_nodes", "nodes", "SELECT * FROM nodes")
oracle("build_edges", "edges", """SELECT repo, source, target, type, 1.0::DOUBLE AS weight,
  CAST(import_line AS VARCHAR) AS import_line FROM edges""")
oracle("graph_type_counts", "nodes edges", """SELECT repo, 'node' AS kind, type, count(*) AS entries FROM nodes GROUP BY ALL
  UNION ALL SELECT repo, 'edge', type, count(*) FROM edges GROUP BY ALL""")
oracle("degree_centrality", "degree", "SELECT repo, id, round(degree_centrality, 9) AS degree_centrality FROM degree")
oracle("betweenness_centrality", "between",
       "SELECT repo, id, round(betweenness_centrality, 9) AS betweenness_centrality FROM between")
oracle("centrality_to_nodes", "nodes degree between", """
SELECT repo, id, type, round(coalesce(degree_centrality, 0), 9) AS degree_centrality,
  round(coalesce(betweenness_centrality, 0), 9) AS betweenness_centrality
FROM nodes LEFT JOIN degree USING (repo, id) LEFT JOIN between USING (repo, id)""")

# --- ranking ---------------------------------------------------------------------------------------------------
part("scores", "facts", f"""SELECT repo, file_path, CAST(api_count * 10 + function_count * 2 + CASE WHEN is_backend THEN 15 ELSE 0 END
  + CASE WHEN {has('plow', rules.MAIN_NAMES)} THEN 20 ELSE 0 END
  + CASE WHEN {has('plow', rules.HANDLER_NAMES)} THEN 15 ELSE 0 END AS INTEGER) AS score FROM facts""")
oracle("importance_score", "scores", "SELECT repo, file_path, score FROM scores")
oracle("top_files", "scores", """SELECT repo, file_path, score,
  CAST(row_number() OVER (PARTITION BY repo ORDER BY score DESC, file_path) AS INTEGER) AS rank FROM scores QUALIFY rank <= 5""")
oracle("top_k_per_file", "facts fns eps", """
SELECT repo, file_path, coalesce(f, '') AS functions, coalesce(a, '') AS apis, array_to_string(dependencies[1:10], '|') AS dependencies
FROM facts
LEFT JOIN (SELECT repo, file_path, array_to_string(list(name ORDER BY line)[1:5], '|') AS f FROM fns GROUP BY ALL) USING (repo, file_path)
LEFT JOIN (SELECT repo, file_path, array_to_string(list(method || ' ' || path ORDER BY line, ord)[1:3], '|') AS a FROM eps GROUP BY ALL)
  USING (repo, file_path)""")
part("listed_files", "facts", " UNION ALL ".join(f"""
SELECT repo, file_path, '{w}' AS word, CAST(row_number() OVER (PARTITION BY repo ORDER BY file_path) AS INTEGER) AS rank,
  count(*) OVER (PARTITION BY repo) AS total FROM facts WHERE NOT is_backend AND contains(plow, '{w}') QUALIFY rank <= 3"""
                                                 for w in ("page", "component")))
oracle("first_n_and_more", "listed_files",
       "SELECT repo, file_path, word, rank, total, greatest(total - 3, 0) AS more FROM listed_files")
part("ports", "facts", """SELECT repo, file_path, language, api_count,
  row_number() OVER (PARTITION BY repo ORDER BY file_path) AS rank FROM facts WHERE is_backend""")
oracle("backend_top_n", "ports", "SELECT repo, file_path, CAST(rank AS INTEGER) AS rank FROM ports WHERE rank <= 10")
oracle("service_port_assignment", "ports", "SELECT repo, file_path, 4999 + rank AS port FROM ports")
part("outputs", "", inputs.OUTPUTS_SQL)
oracle("keep_latest", "outputs", """SELECT repo, name, stamp, CAST(row_number() OVER (PARTITION BY repo ORDER BY stamp DESC, name DESC) AS INTEGER) AS rank
  FROM (SELECT repo, name, TRY_CAST(regexp_extract(name, '[^_]*$') AS BIGINT) AS stamp FROM outputs) WHERE stamp IS NOT NULL QUALIFY rank <= 3""")
part("jobs", "", inputs.JOBS_SQL)
oracle("job_latest_status", "jobs", """SELECT analysis_id, status, created_at, status = 'completed' AS has_results FROM jobs
  QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY created_at DESC, event_id DESC) = 1""")
oracle("retention_filter", "jobs", "SELECT * FROM jobs WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00'")
