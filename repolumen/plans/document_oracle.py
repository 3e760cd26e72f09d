"""Checking SQL for text preparation and documents."""

from __future__ import annotations

import re

from ..functions import rules
from ..operators import documents
from . import inputs
from .file_oracle import JS, NL, PY, has, strip
from .registry import ORACLE, oracle, part
from .rollup_oracle import FOLDER, hits

N2 = f"{NL} || {NL}"


def text(template: str) -> str:
    """Concatenation from a template: ``{x}`` is an expression, the rest is quoted."""
    out = []
    for i, piece in enumerate(re.split(r"\{([^{}]*)\}", template)):
        if i % 2:
            out.append(f"({piece})")
            continue
        for j, words in enumerate(piece.split("\n")):
            if j:
                out.append(NL)
            if words:
                out.append("'" + words.replace("'", "''") + "'")
    return " || ".join(out) or "''"


def ends(lines: str, head: float, tail: float, mark: str) -> str:
    n, h, t = f"len({lines})", f"floor(len({lines}) * {head}::DOUBLE)::INTEGER", f"floor(len({lines}) * {tail}::DOUBLE)::INTEGER"
    return (f"array_to_string(list_concat(list_concat({lines}[1:{h}], ['{mark}']), "
            f"CASE WHEN {t} > 0 THEN {lines}[{n} - {t} + 1:{n}] ELSE {lines} END), {NL})")


part("split", "files", f"SELECT repo, file_path, content, string_split(content, {NL}) AS ls FROM files")
oracle("truncate_70_30", "split", f"""SELECT repo, file_path, CASE WHEN len(regexp_extract_all(content, '\\S+')) * 1.3 <= 60 THEN content
  ELSE {ends('ls', 0.7, 0.3, rules.TRUNCATED_MARK)} END AS shortened FROM split""")


def reduced(content: str, source: str) -> str:
    words = has("l", rules.REDUCE_WORDS)
    return f"""SELECT repo, file_path, CASE WHEN length({content}) <= 4000 THEN {content} WHEN length(short) <= 4000 THEN short
    WHEN len(telling) > 0 THEN array_to_string(telling[1:100], {NL}) ELSE array_to_string(ls[1:50], {NL}) END AS reduced
  FROM (SELECT *, {ends('ls', 0.8, 0.1, rules.REDUCED_MARK)} AS short,
      flatten(list_transform(list_filter(range(1, len(ls) + 1), lambda i: {words.replace('(l,', '(ls[i],')}), lambda i: ls[i:i+2])) AS telling
    FROM (SELECT *, string_split({content}, {NL}) AS ls FROM {source}))"""


oracle("reduce_80_10", "kept_detailed", reduced("content", "kept_detailed"))


def around(words, mark: str) -> str:
    test = has("ls[i]", words)
    return (f"flatten(list_transform(list_filter(range(1, len(ls) + 1), lambda i: {test}), "
            f"lambda i: list_append(ls[greatest(i-1, 1):i+4], '{mark}')))")


part("contexts", "kept_detailed d_eps", f"""
SELECT repo, file_path, array_to_string(list_concat(list_concat(ls[1:5], [{NL} || '// ... [File content optimized for function and API analysis] ...' || {NL}]),
  list_concat(CASE WHEN {JS} THEN {around(rules.JS_CONTEXT_WORDS, rules.JS_BODY_MARK)} WHEN {PY} THEN {around(rules.PY_CONTEXT_WORDS, rules.PY_BODY_MARK)} ELSE [] END,
    CASE WHEN e IS NULL THEN [] ELSE list_concat([{NL} || '// API Endpoints detected:'], e[1:5]) END)), {NL}) AS context
FROM (SELECT *, string_split(content, {NL}) AS ls FROM kept_detailed)
LEFT JOIN (SELECT repo, file_path, list('// ' || method || ' ' || path ORDER BY line) AS e FROM d_eps GROUP BY ALL) USING (repo, file_path)""")
oracle("extract_context", "contexts", "SELECT repo, file_path, context FROM contexts")

part("responses", "", inputs.RESPONSES_SQL)
_HEADS = " ".join(f"WHEN starts_with(line, '{p}') THEN '{s}'" for p, s in rules.RESPONSE_SECTIONS)
part("answer_lines", "responses", f"""
SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY repo, file_path ORDER BY n) AS section FROM (
  SELECT *, CASE {_HEADS} END AS head FROM (
    SELECT repo, file_path, {strip('unnest(ls)')} AS line, generate_subscripts(ls, 1) AS n FROM (
      SELECT *, string_split(response, {NL}) AS ls FROM responses)))""")
part("answer_start", "answer_lines", "SELECT repo, file_path, max(n) AS n0 FROM answer_lines WHERE head = 'summary' GROUP BY ALL")
part("answer_summary", "answer_lines answer_start", f"""
SELECT repo, file_path, {strip("replace(any_value(line) FILTER (n = n0), 'SUMMARY:', '')")}
    || coalesce(string_agg(' ' || line, '' ORDER BY n) FILTER (n > n0 AND line <> ''), '') AS summary
  FROM answer_lines JOIN answer_start USING (repo, file_path)
  WHERE n = n0 OR (n > n0 AND section = 'summary' AND head IS NULL) GROUP BY ALL""")
part("answer_insights", "answer_lines", """
SELECT repo, file_path, array_to_string(list('[' || upper(section) || '] ' || line ORDER BY n), '|') AS insights
  FROM answer_lines WHERE section <> 'summary' AND head IS NULL AND line <> '' GROUP BY ALL""")
oracle("parse_response", "responses answer_summary answer_insights", """
SELECT repo, file_path, CASE WHEN coalesce(summary, '') = '' THEN 'Comprehensive analysis of ' || regexp_extract(file_path, '[^/]*$')
  ELSE summary END AS summary, coalesce(insights, '') AS insights
FROM responses LEFT JOIN answer_summary USING (repo, file_path) LEFT JOIN answer_insights USING (repo, file_path)""")
part("errors", "", inputs.ERRORS_SQL)
oracle("parse_wait_time", "errors", f"""SELECT event_id, round(coalesce(
  TRY_CAST(regexp_extract(message, '{rules.WAIT_SECONDS}', 1) AS DOUBLE) + 2,
  TRY_CAST(regexp_extract(message, '{rules.WAIT_MILLIS}', 1) AS DOUBLE) / 1000 + 1, 30), 6) AS seconds FROM errors""")
part("key_texts", "", inputs.KEY_LISTS_SQL)
oracle("parse_key_list", "key_texts", f"""SELECT doc_id, CAST(generate_subscripts(ks, 1) - 1 AS INTEGER) AS at, unnest(ks) AS key FROM (
  SELECT doc_id, list_filter(list_transform(string_split_regex(keys, '[,;\\n]+'), lambda k: {strip('k')}), lambda k: length(k) > 20) AS ks FROM key_texts)""")

# --- prompts ------------------------------------------------------------------------------------------------
_FENCE = "```{language}\n{code_snippet}\n```\n"


def blocks(table: str, name: str, order: str, body: str, limit: int | None = None) -> str:
    cut = f"QUALIFY row_number() OVER (PARTITION BY repo, file_path ORDER BY {order}) <= {limit}" if limit else ""
    return (f"(SELECT repo, file_path, string_agg({body}, '' ORDER BY {order}) AS {name} FROM "
            f"(SELECT * FROM {table} {cut}) GROUP BY ALL)")


def prompt(base: str, head: str, api_title: str, apis: str, fn_title: str, fns: str) -> str:
    return f"""SELECT repo, file_path, prompt, length(prompt) // 4 + 100 AS est_tokens FROM (
SELECT repo, file_path, {head} || CASE WHEN a IS NULL THEN '' ELSE {api_title} || a END
  || CASE WHEN f IS NULL THEN '' ELSE {fn_title} || f END AS prompt
FROM {base} LEFT JOIN {apis} USING (repo, file_path) LEFT JOIN {fns} USING (repo, file_path)
WHERE function_count > 0 OR api_count > 0)"""


_PARAMETER = "'{''name'': ''' || p || ''', ''type'': ''path'', ''required'': True, ''description'': ''Path parameter ' || p || '''}'"
_PARAMETERS = ("CASE WHEN len(params) > 0 THEN 'Parameters: [' || array_to_string(list_transform(params, lambda p: "
               f"{_PARAMETER}), ', ') || ']' || {NL} ELSE '' END")
_JOINED = "array_to_string(params, ', ')"
oracle("build_prompt_comprehensive", "facts eps fns", prompt(
    "facts", text("Create COMPREHENSIVE documentation for this {language} file:\n\nFILE: {file_path}\nPURPOSE: {file_purpose}\n"
                  "LANGUAGE: {language}\nLINES OF CODE: {lines_of_code}\nAPI ENDPOINTS: {api_count}\nFUNCTIONS: {function_count}\n"
                  "DEPENDENCIES: {array_to_string(dependencies[1:10], ', ')}\n\n"),
    text("DETAILED API ENDPOINTS:\n"), blocks("eps", "a", "line, ord", text(
        "\n{method} {path}\nFunction: {function_name}\nDescription: {description}\n") + f" || {_PARAMETERS} || " + text("Code:\n" + _FENCE)),
    text("\nDETAILED FUNCTIONS:\n"), blocks("fns", "f", "line", text(
        "\n{name}({" + _JOINED + "})\nReturn Type: {return_type}\nComplexity: {complexity}\nDocstring: {docstring}\nCode:\n" + _FENCE), 8)))
CONCISE = prompt(
    "facts", text("Analyze this {language} file and create concise documentation:\n\nFILE: {file_path}\nPURPOSE: {file_purpose}\n"
                  "STATS: {lines_of_code} lines, {function_count} functions, {api_count} APIs\n\n"),
    text("KEY APIs:\n"), blocks("eps", "a", "line, ord", text("- {method} {path}\n"), 3),
    text("\nKEY FUNCTIONS:\n"), blocks("fns", "f", "line", text("- {name}({array_to_string(params[1:3], ', ')})\n"), 5))
oracle("build_prompt_concise", "facts eps fns", CONCISE)
# The fast profile differs in the size limit and the snippet lengths.
_SHORT = f"CASE WHEN {PY} THEN 8 ELSE 7 END"
part("fns_fast", "fns kept_fast", f"""SELECT * REPLACE (array_to_string(string_split(code_snippet, {NL})[1:{_SHORT}], {NL}) AS code_snippet)
  FROM fns SEMI JOIN kept_fast USING (repo, file_path)""")
part("facts_fast", "facts kept_fast", "SELECT * FROM facts SEMI JOIN kept_fast USING (repo, file_path)")
oracle("build_prompt_fast", "facts_fast eps_fast fns_fast", prompt(
    "(SELECT * FROM facts_fast WHERE is_backend)", text(
        "Create comprehensive API documentation for this {language} file:\n\nFILE: {file_path}\nLANGUAGE: {language}\n"
        "API ENDPOINTS: {api_count}\nFUNCTIONS: {function_count}\n\n"),
    text("API ENDPOINTS:\n"), blocks("eps_fast", "a", "line, ord", text("\n{method} {path} (line {line})\n" + _FENCE)),
    text("\nKEY FUNCTIONS:\n"), blocks("fns_fast", "f", "line", text(
        "\n{name}({" + _JOINED + "}) (line {line})\n" + _FENCE), 5)))
CORE_COUNT = "CASE WHEN language = 'python' THEN " + "%s ELSE %s END" % tuple(
    " + ".join(f"len(regexp_extract_all(content, '{p}'))" for p in rules.CORE_FUNCTIONS[name]) for name in ("python", "javascript"))
oracle("build_prompt_preview", "kept_core core_eps core_flags", f"""
SELECT repo, file_path, prompt, length(prompt) // 4 + 100 AS est_tokens FROM (SELECT repo, file_path, {text(
    "Analyze this {k.language} code file and provide a comprehensive description:\n\nFile: {file_path}\nPurpose: {c.file_purpose}\n"
    "Functions: {" + CORE_COUNT + "}\nAPI Endpoints: {coalesce(n, 0)}\nBackend File: {CASE WHEN c.is_backend THEN 'True' ELSE 'False' END}\n\n"
    "Code Preview:\n{left(content, 800)}")} AS prompt
FROM kept_core k JOIN core_flags c USING (repo, file_path)
  LEFT JOIN (SELECT repo, file_path, count(*) AS n FROM core_eps GROUP BY ALL) USING (repo, file_path))""")
part("short_contexts", "contexts", reduced("context", "contexts"))
oracle("build_prompt_typed", "d_facts short_contexts d_eps", f"""
SELECT repo, file_path, prompt, length(prompt) // 4 + 100 AS est_tokens FROM (SELECT repo, file_path, {text(
    "FILE: {file_path}\nLANGUAGE: {language}\nFUNCTIONS: {n_funcs}\nCLASSES: {n_classes}\nAPI_ENDPOINTS: {n_eps}"
    "{CASE WHEN n_eps > 0 THEN chr(10) || 'API ENDPOINTS DETECTED: ' || n_eps || e ELSE '' END}\n\nCODE:\n```\n"
    "{reduced}\n```\n")} AS prompt
FROM d_facts JOIN short_contexts USING (repo, file_path) LEFT JOIN (
  SELECT repo, file_path, array_to_string(list(chr(10) || '- ' || method || ' ' || path ORDER BY line)[1:5], '') AS e FROM d_eps GROUP BY ALL)
  USING (repo, file_path))""")

# --- documents ----------------------------------------------------------------------------------------------


def document(name: str, needs: str, doc: str, *sections: tuple) -> None:
    """Sections are ``(source, key, template)``; they are joined in order of section and key. A source that begins with
    "+ " adds to the section before."""
    selects, sec = [], -1
    for source, key, body in sections:
        sec += not source.startswith("+ ")
        selects.append(f"SELECT repo, {sec} AS sec, {key or chr(39) * 2} AS key, {text(body)} AS text FROM {source.removeprefix('+ ')}")
    rows = " UNION ALL ".join(selects)
    oracle(name, needs, f"""SELECT repo, '{doc}' AS doc_name, sec::INTEGER AS sec, key AS part,
  string_agg(text, '' ORDER BY text) AS content FROM ({rows}) GROUP BY ALL""")


ANCHOR = "lower(replace(replace(file_path, '/', ''), '.', ''))"
LANGS = "array_to_string(languages, ', ')"
BACK = "facts WHERE is_backend"
part("api_texts", "eps", f"""SELECT repo, file_path, string_agg({text(
    "#### `{method} {path}`\n\n**Description**: {description}\n\n**Example**:\n```bash\ncurl -X {method} http://localhost:5000{path}\n```\n\n")},
  '' ORDER BY line, ord) AS t, string_agg({text("- `{method} {path}` - {description}" + chr(10))}, '' ORDER BY line, ord) AS short
  FROM eps GROUP BY ALL""")
API = "(SELECT * FROM facts JOIN api_texts USING (repo, file_path) WHERE is_backend)"
document("doc_api", "facts totals api_texts", "API_DOCUMENTATION.md",
         ("totals", None, "# {repo} - API Documentation\n\n## Overview\n\nThe {repo} provides {total_apis} API endpoints across "
          "{backend_files} services.\n\n## Table of Contents\n\n"),
         (API, "file_path", "- [{file_path}](#{" + ANCHOR + "})\n"),
         ("totals", None, "\n---\n\n## API Endpoints\n\n"),
         (API, "file_path", "### {file_path}\n\n{t}"))
_PARAMS = "CASE WHEN len(params) > 0 THEN array_to_string(params, ', ') ELSE 'None' END"
part("fn_texts", "fns", f"""SELECT repo, file_path, string_agg({text(
    "### `{name}({array_to_string(params, ', ')})`\n\n"
    "{CASE WHEN docstring <> '' THEN '**Description**: ' || docstring || chr(10) || chr(10) ELSE '' END}"
    "**Parameters**: {" + _PARAMS + "}\n\n"
    "{CASE WHEN return_type <> '' THEN '**Returns**: ' || return_type || chr(10) || chr(10) ELSE '' END}"
    "**Complexity**: {complexity}\n\n{CASE WHEN is_api_handler THEN '**Type**: API Handler Function' || chr(10) || chr(10) ELSE '' END}---\n\n")},
  '' ORDER BY line) AS t FROM fns GROUP BY ALL""")
document("doc_functions", "facts fn_texts totals", "FUNCTIONS.md",
         ("totals", None, "# Function Reference\n\n## Table of Contents\n\n"),
         ("facts WHERE function_count > 0", "file_path", "- [{file_path}](#{" + ANCHOR + "})\n"),
         ("totals", None, "\n---\n\n"),
         ("(SELECT * FROM facts JOIN fn_texts USING (repo, file_path) WHERE is_backend)", "file_path", "## {file_path}\n\n{t}"))
_ARCH = [("totals", None, "# Architecture Overview\n\n## System Statistics\n\n- **Total Files**: {total_files}\n- **Backend Components**: "
          "{backend_files}\n- **API Endpoints**: {total_apis}\n- **Functions**: {total_functions}\n\n## Technology Stack\n\n{" + LANGS +
          "}\n\n## Component Overview\n\n### Backend Components\n\n"),
         (BACK, "file_path", "#### {file_path}\n- **Language**: {language}\n- **API Endpoints**: {api_count}\n"
          "- **Functions**: {function_count}\n- **Lines of Code**: {lines_of_code}\n\n"),
         ("totals", None, "\n### Frontend Components\n\n"),
         ("facts WHERE NOT is_backend AND function_count > 0", "file_path", "#### {file_path}\n- **Language**: {language}\n"
          "- **Functions**: {function_count}\n- **Lines of Code**: {lines_of_code}\n\n")]
document("doc_architecture", "facts totals", "ARCHITECTURE.md", *_ARCH)
_TITLE = "upper({0}[1]) || {0}[2:]"
part("counts_language", "facts", "SELECT repo, language, count(*) AS files FROM facts GROUP BY ALL")
part("counts_purpose", "facts", "SELECT repo, file_purpose, count(*) AS files FROM facts GROUP BY ALL")
part("all_deps", "facts", "SELECT DISTINCT repo, unnest(dependencies) AS dependency FROM facts")
document("doc_project_summary", "facts totals counts_language counts_purpose all_deps", "PROJECT_SUMMARY.md",
         ("totals", None, "# Project Summary\n\n## Overview\n\n{repo} is a software project analyzed and documented automatically.\n\n"
          "## Technical Statistics\n\n- **Total Files Analyzed**: {total_files}\n- **Backend Files**: {backend_files}\n"
          "- **API Endpoints**: {total_apis}\n- **Functions**: {total_functions}\n- **Programming Languages**: {" + LANGS +
          "}\n\n## File Breakdown\n\n### By Language\n\n"),
         ("counts_language", "language", "- **{" + _TITLE.format("language") + "}**: {files} files\n"),
         ("totals", None, "\n### By Purpose\n\n"),
         ("counts_purpose", "file_purpose", "- **{file_purpose}**: {files} files\n"),
         ("totals", None, "\n## Architecture Insights\n\n{CASE WHEN backend_files > 0 THEN 'The project contains ' || backend_files || "
          "' backend files with a total of ' || total_apis || ' API endpoints.' || chr(10) || chr(10) || '#### Key Backend Files:' "
          "ELSE 'No backend files detected in this project.' END}\n\n"),
         ("facts WHERE is_backend", "file_path", "- **{file_path}** ({language})\n  - Purpose: {file_purpose}\n"
          "{CASE WHEN api_count > 0 THEN '  - API Endpoints: ' || api_count || chr(10) ELSE '' END}"
          "{CASE WHEN function_count > 0 THEN '  - Functions: ' || function_count || chr(10) ELSE '' END}"),
         ("totals", None, "\n## Dependencies\n\n"), ("all_deps", "dependency", "- {dependency}\n"))


def speaks(words: str, *languages: str) -> str:
    test = " OR ".join(f"list_contains(languages, '{name}')" for name in languages)
    return "{CASE WHEN " + test + " THEN " + text(words) + " ELSE '' END}"


SCRIPT = ("javascript", "typescript")
_SETUP = ("totals", None, "# Setup Guide\n\nComplete setup instructions for {repo}.\n\n## Prerequisites\n\n{" + LANGS + "}\n\n"
          + speaks("#### Python Requirements\n- Python 3.8 or higher\n- pip package manager\n\n", "python")
          + speaks("#### Node.js Requirements\n- Node.js 16.0 or higher\n- npm or yarn package manager\n\n", *SCRIPT)
          + speaks("#### Java Requirements\n- Java 11 or higher\n- Maven or Gradle build tool\n\n", "java")
          + "### Install Dependencies\n\n"
          + speaks("```bash\npip install -r requirements.txt\n```\n", "python") + speaks("```bash\nnpm install\n```\n", *SCRIPT)
          + speaks("```bash\nmvn clean install\n```\n", "java") + "### Start the Application\n\n"
          + speaks("```bash\npython app.py\n```\n", "python") + speaks("```bash\nnpm start\n```\n", *SCRIPT)
          + speaks("```bash\nmvn spring-boot:run\n```\n", "java"))
part("kept_core_all", "kept_core kept_java", """SELECT repo, language FROM kept_core WHERE repo < 'repo2'
  UNION ALL SELECT repo, language FROM kept_java""")
part("core_totals", "kept_core_all", "SELECT repo, list_sort(list(DISTINCT language)) AS languages FROM kept_core_all GROUP BY repo")
document("doc_setup_core", "core_totals", "SETUP.md", ("core_totals", *_SETUP[1:]))
document("doc_setup", "totals", "SETUP.md", _SETUP)
# What the stand-in for the user's function says to the concise prompt, and how its answer is parsed.
part("prompts", "facts eps fns", CONCISE)
part("answers", "prompts", """SELECT repo, file_path, CASE WHEN asked THEN 'SUMMARY: ' || said || chr(10) || 'in ' || rows || ' lines' || chr(10)
    || chr(10) || 'USAGE_EXAMPLES: two' || chr(10) || ls[3] || chr(10) || '- ' || ls[1] END AS response,
  CASE WHEN NOT asked THEN 'refused' END AS error, CASE WHEN asked THEN said || ' in ' || rows || ' lines' END AS summary,
  CASE WHEN asked THEN ['[USAGE] ' || ls[3], '[USAGE] - ' || ls[1]] END AS insights
FROM (SELECT *, length(prompt) || ' characters' AS said, len(ls) - 1 AS rows FROM (
  SELECT repo, file_path, prompt, NOT contains(prompt, '/chat_') AS asked, string_split(prompt, chr(10)) AS ls FROM prompts))""")
part("answered", "answers", "SELECT * FROM answers WHERE response IS NOT NULL")
oracle("answers", "answers", "SELECT * REPLACE (array_to_string(insights, '|') AS insights) FROM answers")
oracle("merge_enrichment", "facts answers", """SELECT repo, file_path, file_purpose, coalesce(summary, file_purpose) AS summary,
  coalesce(array_to_string(insights, '|'), '') AS insights FROM facts LEFT JOIN answers USING (repo, file_path)""")
oracle("processing_stats", "facts answers", f"""SELECT repo, count(*) AS total_files, count(DISTINCT {FOLDER}) AS folders,
  count(response) AS enriched_files, count(error) AS failed_files FROM facts LEFT JOIN answers USING (repo, file_path) GROUP BY repo""")
document("doc_answers", "facts totals answered", "API.md",
         ("totals", None, "# API Documentation\n\nComplete API reference with examples and usage instructions.\n\n## Table of Contents\n\n"),
         ("facts WHERE is_backend AND api_count > 0", "file_path",
          "- [{file_path}](#{lower(replace(replace(file_path, '/', ''), '.', ''))})\n"),
         ("totals", None, "\n---\n\n"), ("answered", "file_path", "## {file_path}\n\n{response}\n\n---\n\n"))
oracle("doc_per_file", "answered", rf"""SELECT *, count(*) OVER (PARTITION BY repo, doc_name) AS sharing FROM (
  SELECT repo, file_path, regexp_replace(file_path, '[/\.]', '_', 'g') || '.md' AS doc_name,
    {text("# {file_path}" + chr(10) * 2 + "{response}" + chr(10) * 2 + "---" + chr(10) * 2 + "*Generated automatically from code analysis*" + chr(10))} AS content FROM answered)""")
document("doc_insights", "facts answered", "INSIGHTS.md",
         ("(SELECT DISTINCT repo FROM answered)", None, "# AI-Generated Insights\n\n## File Analysis\n\n"),
         ("(SELECT * FROM facts JOIN answered USING (repo, file_path))", "file_path",
          "### {file_path}\n\n**Purpose**: {file_purpose}\n**API Endpoints**: {api_count}\n**Functions**: {function_count}\n\n"
          "**AI Analysis**:\n{response}\n\n---\n\n"))

NEEDS = [("- **Firebase Account**", "exact", ["firebase"]), ("- **Google API Keys**", "part", ["google"]),
         ("- **Groq API Key**", "exact", ["groq", "Groq"])]
ENVIRONMENT = [("# AI/ML APIs~GROQ_API_KEY=your_groq_api_key", "exact", ["groq", "Groq"]),
               ("# Google Services~GOOGLE_MAPS_API_KEY=your_google_maps_api_key", "part", ["google"]),
               ("# Firebase Configuration~FIREBASE_API_KEY=your_firebase_api_key", "exact", ["firebase"])]
part("needs", "names", hits(NEEDS))
part("environment", "names", hits(ENVIRONMENT))
_ORD = "lpad(ord::VARCHAR, 12, '0')"
_RANK = "lpad(rank::VARCHAR, 12, '0')"


def listing(word: str, title: str) -> tuple:
    return (f"listed_files WHERE word = '{word}'", _RANK,
            "{CASE WHEN rank = 1 THEN '│   ├── " + title + " (' || total || ' files)' || chr(10) ELSE '' END}│   │   ├── {file_path}\n"
            "{CASE WHEN rank = 3 AND total > 3 THEN '│   │   └── ... and ' || (total - 3) || ' more' || chr(10) ELSE '' END}")


document("doc_readme", "facts totals kinds badges features techs listed_files major ports needs environment api_texts thanks", "README.md",
         ("totals", None, "# {repo}\n\n"), ("badges", _ORD, "![{label}]\n"),
         ("(SELECT * FROM totals JOIN kinds USING (repo))", None,
          "\n## Project Statistics\n\n| Metric | Value |\n|-----------|----------|\n| **Total Files** | {total_files} |\n"
          "| **Backend Services** | {backend_files} |\n| **API Endpoints** | {total_apis} |\n| **Functions** | {total_functions} |\n"
          "| **Languages** | {array_to_string(list_transform(languages, lambda l: " + _TITLE.format("l") + "), ', ')} |\n\n"
          "## Overview\n\nA full-stack {lower(project_type)} with **{total_apis} API endpoints** across **{backend_files} backend "
          "services** and **{total_functions} functions**.\n\n## Key Features\n\n"),
         ("features", _RANK, "### {feature}\n"), ("totals", None, "\n## Technology Stack\n\n"), ("techs", _ORD, "- {label}\n"),
         ("+ totals WHERE list_contains(languages, 'javascript')", "'~'", documents.FRONTEND_STACK),
         ("(SELECT repo, count(*) FILTER (is_backend AND language = 'python') AS n FROM facts GROUP BY repo)", None,
          "\n## Project Structure\n\n```\n{repo}/\n├── Backend Services ({n})\n"),
         ("facts WHERE is_backend AND language = 'python'", "file_path",
          "│   ├──  {CASE WHEN length(file_path) < 25 THEN rpad(file_path, 25, ' ') ELSE file_path END} # {file_purpose} "
          "({api_count} APIs, {function_count} funcs)\n"),
         ("(SELECT repo, count(*) AS n FROM facts WHERE NOT is_backend GROUP BY repo)", None, "├── Frontend Application ({n} files)\n"),
         listing("page", "Pages"), listing("component", "Components"),
         ("totals", None, "```\n\n| Technology | Purpose | Files | Usage |\n|------------|---------|-------|-------|\n"),
         ("major", _ORD, "| **{" + _TITLE.format("dependency") + "}** | {category} | {files} | {purpose} |\n"),
         ("+ totals WHERE list_has_any(languages, ['javascript', 'typescript'])", "'~'", "\n### Frontend Technologies\n"
          "| Technology | Purpose | Description |\n|------------|---------|-------------|\n" + documents.FRONTEND_ROWS),
         ("totals", None, "\n### Prerequisites\n\n" + speaks("- **Python 3.8+**\n", "python") + speaks("- **Node.js 18+**\n", "javascript")),
         ("needs", _ORD, "{label}\n"), ("totals", None, "\n```env\n"), ("environment", _ORD, "{replace(label, '~', chr(10))}\n"),
         ("totals", None, "```\n\n### Running the Application\n\n```bash\n"),
         ("ports WHERE language = 'python' AND api_count > 0", "file_path",
          "# Start the {replace(file_path, '.py', '')} service\npython {file_path}\n\n"),
         ("totals", None, "```\n" + speaks(documents.FRONTEND_START, "javascript") + "\n## API Documentation\n\nThis project provides {total_apis} API endpoints across {backend_files} services:\n\n"),
         (API, "file_path", "#### {file_path}\n**Base URL**: `http://localhost:500X`\n\n**Endpoints**:\n{short}\n"),
         ("totals", None, "\n## Acknowledgments\n\n"), ("thanks", _ORD, "{label}\n"))

_LISTED = ("struct_pack(file_path := file_path, language := language, file_purpose := file_purpose, lines_of_code := lines_of_code, "
           "function_count := function_count, is_backend := is_backend, dependencies := dependencies)")
_PARAM = "struct_pack(name := p, type := 'path', required := TRUE, description := 'Path parameter ' || p)"
_API_JSON = ("struct_pack(method := method, path := path, function := function_name, line := line, description := description, "
             f"parameters := list_transform(params, lambda p: {_PARAM}))")
_FN_JSON = ("struct_pack(name := name, params := params, line := line, return_type := return_type, complexity := complexity, "
            "docstring := docstring, is_api_handler := is_api_handler)")
_INFO = ("CASE WHEN repo = 'repo3' THEN 'null' WHEN repo = 'repo7' THEN to_json(struct_pack(name := 'Repository', owner := 'Unknown', "
         "url := 'https://host.example/', description := 'Comprehensive repository documentation'))::VARCHAR ELSE "
         "to_json(struct_pack(name := repo, owner := 'team', url := 'https://host.example/team/' || repo || '.git', "
         "description := 'Comprehensive documentation for ' || repo))::VARCHAR END")
_ASKED = ("struct_pack(purpose := file_purpose, api_count := api_count, function_count := function_count, language := language, "
          "lines_of_code := lines_of_code, dependencies := dependencies, is_backend := is_backend)")
_ASKED_API = ("list_transform(coalesce(a, []), lambda x: struct_pack(method := x.method, path := x.path, function := x.function, "
              "description := x.description, parameters := x.parameters))")
_ASKED_FN = ("list_transform(coalesce(f, []), lambda x: struct_pack(name := x.name, params := x.params, return_type := x.return_type, "
             "complexity := x.complexity, docstring := x.docstring, is_api_handler := x.is_api_handler))")
oracle("result_json", "facts totals eps fns answers", f"""
SELECT repo, '' AS part, '{{"repository":' || to_json(repo)::VARCHAR || ',"repository_info":' || {_INFO} || ',"summary":' || to_json(struct_pack(total_files := total_files,
    backend_files := backend_files, total_apis := total_apis, total_functions := total_functions, languages := languages)) || '}}' AS json
FROM totals
UNION ALL SELECT repo, file_path, '{{"file":' || to_json({_LISTED})::VARCHAR || ',"backend_file":' || CASE WHEN is_backend THEN
    to_json(struct_pack(file_path := file_path, language := language, file_purpose := file_purpose,
      api_count := api_count, function_count := function_count, lines_of_code := lines_of_code, dependencies := dependencies,
      apis := coalesce(a, []), functions := coalesce(f, [])))::VARCHAR ELSE 'null' END || ',"api_documentation":' ||
    CASE WHEN response IS NOT NULL THEN to_json(struct_pack(comprehensive_documentation := response, file_analysis := {_ASKED},
      apis := {_ASKED_API}, functions := {_ASKED_FN}))::VARCHAR
    WHEN error IS NOT NULL THEN to_json(struct_pack(error := error))::VARCHAR ELSE 'null' END || '}}' FROM facts
  LEFT JOIN answers USING (repo, file_path)
  LEFT JOIN (SELECT repo, file_path, list({_API_JSON} ORDER BY line, ord) AS a FROM eps GROUP BY ALL) USING (repo, file_path)
  LEFT JOIN (SELECT repo, file_path, list({_FN_JSON} ORDER BY line) AS f FROM fns GROUP BY ALL) USING (repo, file_path)""")


def sizes(doc: str, *sections: tuple) -> str:
    rows = " UNION ALL ".join(f"SELECT repo, {text(body)} AS text FROM {source}" for source, _, body in sections)
    return (f"SELECT repo, '{doc}' AS doc_name, CAST(sum(length(text)) AS BIGINT) AS size, repo || '/{doc}' AS path "
            f"FROM ({rows}) GROUP BY repo")


oracle("list_documents", "facts totals", sizes("ARCHITECTURE.md", *_ARCH) + " UNION ALL " + sizes("SETUP.md", _SETUP))

# The stand-in for a user's function answers with the prompt's length and refuses chat services.
oracle("enrich", "", f"""SELECT repo, file_path, CASE WHEN NOT refused THEN 'SUMMARY: ' || length(prompt) || ' characters' END AS response,
  CASE WHEN refused THEN 'refused' END AS error FROM (SELECT *, contains(prompt, '/chat_') AS refused FROM ({ORACLE['build_prompt_concise']}))""")
