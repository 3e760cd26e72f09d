"""Documents as tables of ordered sections.

A section is ``(repo, doc_name, sec, key, text)``; its text comes from one file row or one
summary row and is built without a shuffle. A document of any size is the sequence of its
sections in ``(sec, part)`` order. Nothing is cut off.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, rules
from ..functions.prep import _each, _say
from ..functions.text import contains_any
from . import ranking, rollup
from .unnest import unnest


def sections(df: DataFrame, doc: str, *rows: tuple) -> DataFrame:
    """Sections of a document from the rows of ``df``, all of them in one pass.

    Each entry is ``(sec, key, text)`` or ``(sec, key, text, condition)``; a key of ``None``
    means the section occurs once per document.
    """
    entries = []
    for sec, key, text, *condition in rows:
        entry = F.struct(F.lit(sec).alias("sec"), (F.lit("") if key is None else key).alias("key"), text.alias("text"))
        entries.append(F.when(condition[0], entry) if condition else entry)
    listed = unnest(df, ["repo", F.lit(doc).alias("doc_name")], F.array_compact(F.array(*entries)), "s")
    return listed.select("repo", "doc_name", "s.sec", "s.key", "s.text")


def numbered(position: Column) -> Column:
    return F.lpad(position.cast("string"), 12, "0")


def stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def assemble(sections: DataFrame) -> DataFrame:
    """``(repo, doc_name, sec, part, content)``: one row per section; the document is their sequence in
    ``(sec, part)`` order. Texts of one place in a document are joined in their own order."""
    return sections.groupBy("repo", "doc_name", "sec", F.col("key").alias("part")).agg(
        F.array_join(F.array_sort(F.collect_list("text")), "").alias("content"))


def _titles(languages: Column) -> Column:
    return F.array_join(F.transform(languages, F.initcap), ", ")


def _speaks(*names: str) -> Column:
    return F.arrays_overlap("languages", F.array(*[F.lit(n) for n in names]))


PATH = "file_path"


def api_document(bundles: DataFrame) -> DataFrame:
    """Contents list and one entry with a call example per endpoint of the backend files."""
    doc = "API_DOCUMENTATION.md"
    path, repo = F.col(PATH), F.col("repo")
    serving = F.col("is_backend") & (F.col("api_count") > 0)
    entries = _each(F.col("apis"), lambda a: _say(
        "#### `", a["method"], " ", a["path"], "`\n\n**Description**: ", a["description"],
        "\n\n**Example**:\n```bash\ncurl -X ", a["method"], " http://localhost:5000", a["path"], "\n```\n\n"))
    return stack([
        sections(rollup.repo_summary(bundles), doc,
                 (0, None, _say("# ", repo, " - API Documentation\n\n## Overview\n\nThe ", repo, " provides ",
                                F.col("total_apis"), " API endpoints across ", F.col("backend_files"),
                                " services.\n\n## Table of Contents\n\n")),
                 (2, None, F.lit("\n---\n\n## API Endpoints\n\n"))),
        sections(bundles, doc,
                 (1, path, _say("- [", path, "](#", paths.anchor_name(path), ")\n"), serving),
                 (3, path, _say("### ", path, "\n\n", entries), serving))])


def function_document(bundles: DataFrame) -> DataFrame:
    """Contents list of all files with functions and the reference of the backend ones."""
    doc = "FUNCTIONS.md"
    path = F.col(PATH)
    defining = F.col("function_count") > 0
    entries = _each(F.col("funcs"), lambda f: _say(
        "### `", f["name"], "(", F.array_join(f["params"], ", "), ")`\n\n",
        F.when(f["docstring"] != "", _say("**Description**: ", f["docstring"], "\n\n")).otherwise(""),
        "**Parameters**: ", F.when(F.size(f["params"]) > 0, F.array_join(f["params"], ", ")).otherwise("None"), "\n\n",
        F.when(f["return_type"] != "", _say("**Returns**: ", f["return_type"], "\n\n")).otherwise(""),
        "**Complexity**: ", f["complexity"], "\n\n",
        F.when(f["is_api_handler"], F.lit("**Type**: API Handler Function\n\n")).otherwise(""), "---\n\n"))
    return stack([
        sections(rollup.repo_summary(bundles), doc,
                 (0, None, F.lit("# Function Reference\n\n## Table of Contents\n\n")), (2, None, F.lit("\n---\n\n"))),
        sections(bundles, doc,
                 (1, path, _say("- [", path, "](#", paths.anchor_name(path), ")\n"), defining),
                 (3, path, _say("## ", path, "\n\n", entries), defining & F.col("is_backend")))])


def architecture_document(facts: DataFrame) -> DataFrame:
    doc = "ARCHITECTURE.md"
    path, backend = F.col(PATH), F.col("is_backend")
    head = _say("#### ", path, "\n- **Language**: ", F.col("language"), "\n")
    tail = _say("- **Functions**: ", F.col("function_count"), "\n- **Lines of Code**: ", F.col("lines_of_code"), "\n\n")
    return stack([
        sections(rollup.repo_summary(facts), doc,
                 (0, None, _say(
                     "# Architecture Overview\n\n## System Statistics\n\n- **Total Files**: ", F.col("total_files"),
                     "\n- **Backend Components**: ", F.col("backend_files"), "\n- **API Endpoints**: ",
                     F.col("total_apis"), "\n- **Functions**: ", F.col("total_functions"), "\n\n## Technology Stack\n\n",
                     F.array_join("languages", ", "), "\n\n## Component Overview\n\n### Backend Components\n\n")),
                 (2, None, F.lit("\n### Frontend Components\n\n"))),
        sections(facts, doc,
                 (1, path, _say(head, "- **API Endpoints**: ", F.col("api_count"), "\n", tail), backend),
                 (3, path, _say(head, tail), ~backend & (F.col("function_count") > 0)))])


def project_summary_document(facts: DataFrame, files: int | None = None, dependencies: int | None = None) -> DataFrame:
    """Totals, breakdowns, backend files and dependencies: all of them, or as many of the first as asked for."""
    doc = "PROJECT_SUMMARY.md"
    path, count = F.col(PATH), F.col("files")
    api_line = F.when(F.col("api_count") > 0, _say("  - API Endpoints: ", F.col("api_count"), "\n")).otherwise("")
    fn_line = F.when(F.col("function_count") > 0, _say("  - Functions: ", F.col("function_count"), "\n")).otherwise("")
    return stack([
        sections(
            rollup.repo_summary(facts), doc,
            (0, None, _say(
                "# Project Summary\n\n## Overview\n\n", F.col("repo"), " is a software project analyzed and documented "
                "automatically.\n\n## Technical Statistics\n\n- **Total Files Analyzed**: ", F.col("total_files"),
                "\n- **Backend Files**: ", F.col("backend_files"), "\n- **API Endpoints**: ", F.col("total_apis"),
                "\n- **Functions**: ", F.col("total_functions"), "\n- **Programming Languages**: ",
                F.array_join("languages", ", "), "\n\n## File Breakdown\n\n### By Language\n\n")),
            (2, None, F.lit("\n### By Purpose\n\n")),
            (4, None, F.when(F.col("backend_files") > 0, _say(
                "\n## Architecture Insights\n\nThe project contains ", F.col("backend_files"),
                " backend files with a total of ", F.col("total_apis"), " API endpoints.\n\n#### Key Backend Files:\n\n"))
             .otherwise("\n## Architecture Insights\n\nNo backend files detected in this project.\n\n")),
            (6, None, F.lit("\n## Dependencies\n\n"))),
        sections(rollup.breakdown(facts, "language"), doc,
                 (1, F.col("language"), _say("- **", F.initcap("language"), "**: ", count, " files\n"))),
        sections(rollup.breakdown(facts, "file_purpose"), doc,
                 (3, F.col("file_purpose"), _say("- **", F.col("file_purpose"), "**: ", count, " files\n"))),
        sections(facts.where("is_backend") if files is None else ranking.backend_top_n(facts, files), doc,
                 (5, path, _say("- **", path, "** (", F.col("language"), ")\n  - Purpose: ", F.col("file_purpose"), "\n",
                                api_line, fn_line))),
        sections(rollup.repo_dependencies(facts, dependencies), doc,
                 (7, F.col("dependency"), _say("- ", F.col("dependency"), "\n")))])


def setup_document(facts: DataFrame) -> DataFrame:
    """Set-up steps for the languages that occur."""
    def block(words, *languages):
        return F.when(_speaks(*languages), F.lit(words)).otherwise("")
    script = ("javascript", "typescript")

    # fixed values: commands per language
    return sections(rollup.repo_summary(facts), "SETUP.md", (0, None, _say(
        "# Setup Guide\n\nComplete setup instructions for ", F.col("repo"), ".\n\n## Prerequisites\n\n",
        F.array_join("languages", ", "), "\n\n",
        block("#### Python Requirements\n- Python 3.8 or higher\n- pip package manager\n\n", "python"),
        block("#### Node.js Requirements\n- Node.js 16.0 or higher\n- npm or yarn package manager\n\n", *script),
        block("#### Java Requirements\n- Java 11 or higher\n- Maven or Gradle build tool\n\n", "java"),
        "### Install Dependencies\n\n", block("```bash\npip install -r requirements.txt\n```\n", "python"),
        block("```bash\nnpm install\n```\n", *script), block("```bash\nmvn clean install\n```\n", "java"),
        "### Start the Application\n\n", block("```bash\npython app.py\n```\n", "python"),
        block("```bash\nnpm start\n```\n", *script), block("```bash\nmvn spring-boot:run\n```\n", "java"))))


# fixed values: rule lists for prerequisites and environment entries
PREREQUISITES = [("- **Firebase Account**", "exact", ["firebase"]), ("- **Google API Keys**", "part", ["google"]),
                 ("- **Groq API Key**", "exact", ["groq", "Groq"])]
ENVIRONMENT = [("# AI/ML APIs\nGROQ_API_KEY=your_groq_api_key", "exact", ["groq", "Groq"]),
               ("# Google Services\nGOOGLE_MAPS_API_KEY=your_google_maps_api_key", "part", ["google"]),
               ("# Firebase Configuration\nFIREBASE_API_KEY=your_firebase_api_key", "exact", ["firebase"])]


# fixed values: what a README says where script languages occur
FRONTEND_STACK = ("\n### Frontend (Next.js/React)\n- **Next.js 14**: React framework with App Router\n"
                  "- **React**: Component-based UI library\n- **Tailwind CSS**: Utility-first CSS framework\n"
                  "- **Framer Motion**: Animation library\n- **Socket.io**: Real-time communication\n")
FRONTEND_ROWS = ("| **React** | UI Framework | Component-based user interface |\n"
                 "| **Next.js** | Full-stack | Server-side rendering & routing |\n"
                 "| **TypeScript** | Type Safety | Enhanced JavaScript with types |\n"
                 "| **Tailwind CSS** | Styling | Utility-first CSS framework |\n")
FRONTEND_START = ("\n2. **Start Frontend Application**\n```bash\n# Development mode\nnpm run dev\n\n# Production build\n"
                  "npm run build\nnpm start\n```\n")
#: Rule lists of a README: section, text before and after the label.
README_RULES = [(1, "![", rules.TECH_BADGES, "]\n"), (5, "- ", rules.BACKEND_TECH, "\n"), (14, "", PREREQUISITES, "\n"),
                (16, "", ENVIRONMENT, "\n"), (22, "", rules.ACKNOWLEDGEMENTS, "\n")]
#: First frontend files listed by a word in their path: word, title, section.
README_LISTS = [("page", "Pages", 9), ("component", "Components", 10)]


def _place(n: int) -> Column:
    return F.lit(str(n).zfill(12))


def _readme_totals(bundles: DataFrame) -> DataFrame:
    """Everything a README says about a repository as a whole: one aggregate, every rule a flag in it."""
    backend, low = F.col("is_backend"), F.lower(PATH)
    flags = [F.bool_or(rollup.rule_holds(kind, tokens)).alias(f"r{sec}_{i}")
             for sec, _, rule_list, _ in README_RULES for i, (_, kind, tokens) in enumerate(rule_list)]
    listed = [F.count_if(~backend & low.contains(word)).alias(f"{word}_total") for word, _, _ in README_LISTS]
    techs = [F.count_if(backend & F.array_contains("dependencies", name)).alias(f"t{i}")
             for i, (name, _, _) in enumerate(rules.MAJOR_TECHS)]
    features = F.bool_or(backend & contains_any(low, [w for words, _ in rules.FEATURES for w in words]))
    return bundles.groupBy("repo").agg(
        *rollup.repo_totals(), *rollup.project_flags(), *flags, *listed, *techs, features.alias("any_feature"),
        F.count_if(backend & (F.col("language") == "python")).alias("python_services"),
        F.count_if(~backend).alias("frontend_files"))


def readme_document(bundles: DataFrame) -> DataFrame:
    """Statistics, badges, features, structure, technologies, start commands, endpoints, thanks.

    Made from one aggregate per repository, one ranked pass for the lists that show the first of their kind, and the
    file rows.
    """
    doc = "README.md"
    path, backend, language = F.col(PATH), F.col("is_backend"), F.col("language")
    apis, functions, services = F.col("total_apis"), F.col("total_functions"), F.col("backend_files")
    totals = _readme_totals(bundles)
    labels = [(sec, _place(i), _say(prefix, label, suffix), F.col(f"r{sec}_{i}"))
              for sec, prefix, rule_list, suffix in README_RULES for i, (label, _, _) in enumerate(rule_list)]
    general = [(3, _place(i + 1), _say("### ", line, "\n"), ~F.col("any_feature"))
               for i, line in enumerate(rollup.general_features())]
    techs = [(12, _place(i), _say(f"| **{name.capitalize()}** | {kind} | ", F.col(f"t{i}"), f" | {purpose} |\n"), F.col(f"t{i}") > 0)
             for i, (name, kind, purpose) in enumerate(rules.MAJOR_TECHS)]

    low = F.lower(PATH)
    entries = F.array_compact(F.array(
        *[F.when(~backend & low.contains(word), F.struct(F.lit(word).alias("list"), F.lit(0).alias("ord"), path.alias("label")))
          for word, _, _ in README_LISTS],
        *[F.when(backend & contains_any(low, words), F.struct(F.lit("feature").alias("list"), F.lit(i).alias("ord"),
                                                              F.lit(label).alias("label")))
          for i, (words, label) in enumerate(rules.FEATURES)]))
    ranked = rollup.first_k(unnest(bundles, ["repo", PATH], entries, "e"), ["repo", "e.list"], [PATH, "e.ord"], 8)
    shown = ranked.where((F.col("e.list") == "feature") | (F.col("rank") <= 3)) \
        .join(totals.select("repo", *[f"{word}_total" for word, _, _ in README_LISTS]), "repo")

    def listing(word, title, sec):
        total, rank = F.col(f"{word}_total"), F.col("rank")
        first = F.when(rank == 1, _say("│   ├── ", title, " (", total, " files)\n")).otherwise("")
        last = F.when((rank == 3) & (total > 3), _say("│   │   └── ... and ", total - 3, " more\n")).otherwise("")
        return (sec, numbered(rank), _say(first, "│   │   ├── ", F.col("e.label"), "\n", last), F.col("e.list") == word)

    padded = F.when(F.length(path) < 25, F.rpad(path, 25, " ")).otherwise(path)
    calls = _each(F.col("apis"), lambda a: _say("- `", a["method"], " ", a["path"], "` - ", a["description"], "\n"))
    python = backend & (language == "python")
    serving = F.col("api_count") > 0
    scripted = _speaks("javascript")
    return stack([
        sections(
            totals, doc, *labels, *general, *techs,
            (0, None, _say("# ", F.col("repo"), "\n\n")),
            (2, None, _say(
                "\n## Project Statistics\n\n| Metric | Value |\n|-----------|----------|\n| **Total Files** | ",
                F.col("total_files"), " |\n| **Backend Services** | ", services, " |\n| **API Endpoints** | ", apis,
                " |\n| **Functions** | ", functions, " |\n| **Languages** | ", _titles(F.col("languages")),
                " |\n\n## Overview\n\nA full-stack ", F.lower(rollup.project_kind(apis)), " with **", apis,
                " API endpoints** across **", services, " backend services** and **", functions,
                " functions**.\n\n## Key Features\n\n")),
            (4, None, F.lit("\n## Technology Stack\n\n")),
            (5, F.lit("~"), F.lit(FRONTEND_STACK), scripted),
            (6, None, _say("\n## Project Structure\n\n```\n", F.col("repo"), "/\n├── Backend Services (",
                           F.col("python_services"), ")\n")),
            (8, None, _say("├── Frontend Application (", F.col("frontend_files"), " files)\n"), F.col("frontend_files") > 0),
            (11, None, F.lit("```\n\n| Technology | Purpose | Files | Usage |\n|------------|---------|-------|-------|\n")),
            (12, F.lit("~"), F.lit("\n### Frontend Technologies\n| Technology | Purpose | Description |\n"
                                   "|------------|---------|-------------|\n" + FRONTEND_ROWS), _speaks("javascript", "typescript")),
            (13, None, _say("\n### Prerequisites\n\n", F.when(_speaks("python"), "- **Python 3.8+**\n").otherwise(""),
                            F.when(scripted, "- **Node.js 18+**\n").otherwise(""))),
            (15, None, F.lit("\n```env\n")),
            (17, None, F.lit("```\n\n### Running the Application\n\n```bash\n")),
            (19, None, _say("```\n", F.when(scripted, FRONTEND_START).otherwise(""),
                            "\n## API Documentation\n\nThis project provides ", apis, " API endpoints across ", services,
                            " services:\n\n")),
            (21, None, F.lit("\n## Acknowledgments\n\n"))),
        sections(shown, doc, *[listing(*entry) for entry in README_LISTS],
                 (3, numbered(F.col("rank")), _say("### ", F.col("e.label"), "\n"), F.col("e.list") == "feature")),
        sections(
            bundles, doc,
            (7, path, _say("│   ├──  ", padded, " # ", F.col("file_purpose"), " (", F.col("api_count"), " APIs, ",
                           F.col("function_count"), " funcs)\n"), python),
            (18, path, _say("# Start the ", F.replace(path, F.lit(".py"), F.lit("")), " service\npython ", path, "\n\n"),
             python & serving),
            (20, path, _say("#### ", path, "\n**Base URL**: `http://localhost:500X`\n\n**Endpoints**:\n", calls, "\n"),
             backend & serving))])


def file_documents(answers: DataFrame) -> DataFrame:
    """One document per answered file, with the number of files that share its name."""
    path = F.col(PATH)
    named = answers.where("response is not null").select("repo", PATH, paths.safe_name(path).alias("doc_name"), _say(
        "# ", path, "\n\n", F.col("response"), "\n\n---\n\n*Generated automatically from code analysis*\n").alias("content"))
    shared = named.groupBy("repo", "doc_name").agg(F.count("*").alias("sharing"))
    return named.join(shared, ["repo", "doc_name"])


def answer_document(bundles: DataFrame, answers: DataFrame) -> DataFrame:
    """Contents list of the serving backend files, then the answer of every file that has one."""
    doc, path = "API.md", F.col(PATH)
    serving = F.col("is_backend") & (F.col("api_count") > 0)
    return stack([
        sections(bundles.select("repo").distinct(), doc,
                 (0, None, F.lit("# API Documentation\n\nComplete API reference with examples and usage instructions.\n\n"
                                 "## Table of Contents\n\n")),
                 (2, None, F.lit("\n---\n\n"))),
        sections(bundles, doc, (1, path, _say("- [", path, "](#", paths.anchor_name(path), ")\n"), serving)),
        sections(answers, doc, (3, path, _say("## ", path, "\n\n", F.col("response"), "\n\n---\n\n"),
                                F.col("response").isNotNull()))])


def insight_document(facts: DataFrame, answers: DataFrame) -> DataFrame:
    """Section per answered file with its facts and answer."""
    doc = "INSIGHTS.md"
    path = F.col(PATH)
    rows = facts.join(answers.where("response is not null").select("repo", PATH, "response"), ["repo", PATH])
    return stack([
        sections(rows.select("repo").distinct(), doc, (0, None, F.lit("# AI-Generated Insights\n\n## File Analysis\n\n"))),
        sections(rows, doc, (1, path, _say(
            "### ", path, "\n\n**Purpose**: ", F.col("file_purpose"), "\n**API Endpoints**: ", F.col("api_count"),
            "\n**Functions**: ", F.col("function_count"), "\n\n**AI Analysis**:\n", F.col("response"), "\n\n---\n\n")))])


def _without_line(funcs: Column) -> Column:
    return F.transform(funcs, lambda f: F.struct(
        f["name"].alias("name"), f["params"].alias("params"), f["return_type"].alias("return_type"),
        f["complexity"].alias("complexity"), f["docstring"].alias("docstring"), f["is_api_handler"].alias("is_api_handler")))


def result_json(bundles: DataFrame, answers: DataFrame | None = None, addresses: DataFrame | None = None) -> DataFrame:
    """Nested result as ``(repo, part, json)``: one object per file (``part`` is the path) with its entry in the file
    list, for back-end files its details, and its answer with what was asked about; and one summary object per
    repository (``part`` is empty). ``answers`` comes from ``enrich.answers``; ``addresses(repo, url)`` adds
    ``repository_info``."""
    apis = F.transform("apis", lambda a: F.struct(
        a["method"].alias("method"), a["path"].alias("path"), a["function_name"].alias("function"),
        a["line"].alias("line"), a["description"].alias("description"), a["parameters"].alias("parameters")))
    backend = F.when(F.col("is_backend"), F.to_json(F.struct(
        PATH, "language", "file_purpose", "api_count", "function_count", "lines_of_code", "dependencies", apis.alias("apis"),
        F.transform("funcs", lambda f: F.struct(
            f["name"].alias("name"), f["params"].alias("params"), f["line"].alias("line"),
            f["return_type"].alias("return_type"), f["complexity"].alias("complexity"), f["docstring"].alias("docstring"),
            f["is_api_handler"].alias("is_api_handler"))).alias("functions"))))
    listed = F.to_json(F.struct(PATH, "language", "file_purpose", "lines_of_code", "function_count", "is_backend",
                                "dependencies"))
    rows, documented = bundles, F.lit(None).cast("string")
    if answers is not None:
        rows = bundles.join(answers.select("repo", PATH, "response", "error"), ["repo", PATH], "left")
        documented = F.when(F.col("response").isNotNull(), F.to_json(F.struct(
            F.col("response").alias("comprehensive_documentation"),
            F.struct(F.col("file_purpose").alias("purpose"), "api_count", "function_count", "language", "lines_of_code",
                     "dependencies", "is_backend").alias("file_analysis"),
            F.transform("apis", lambda a: F.struct(
                a["method"].alias("method"), a["path"].alias("path"), a["function_name"].alias("function"),
                a["description"].alias("description"), a["parameters"].alias("parameters"))).alias("apis"),
            _without_line(F.col("funcs")).alias("functions")))) \
            .when(F.col("error").isNotNull(), F.to_json(F.struct("error")))
    pieces = rows.select("repo", PATH, backend.alias("backend"), listed.alias("listed"), documented.alias("documented"))
    totals, info = rollup.repo_summary(bundles), F.lit("null")
    if addresses is not None:
        totals = totals.join(addresses.select("repo", "url", paths.repo_info(F.col("url")).alias("info")), "repo", "left")
        found = (F.col("info.owner") != "Unknown") | (F.col("info.name") != "Repository")
        described = F.when(found, _say("Comprehensive documentation for ", F.col("info.name"))) \
            .otherwise("Comprehensive repository documentation")
        info = F.when(F.col("url").isNotNull(), F.to_json(F.struct(
            "info.name", "info.owner", "url", described.alias("description")))).otherwise("null")
    summary = totals.select("repo", F.lit("").alias("part"), _say(
        '{"repository":', F.to_json(F.struct("repo")).substr(F.lit(9), F.length(F.to_json(F.struct("repo"))) - 9),
        ',"repository_info":', info,
        ',"summary":', F.to_json(F.struct("total_files", "backend_files", "total_apis", "total_functions", "languages")),
        "}").alias("json"))
    parts = pieces.select("repo", F.col(PATH).alias("part"), _say(
        '{"file":', F.col("listed"), ',"backend_file":', F.coalesce("backend", F.lit("null")),
        ',"api_documentation":', F.coalesce("documented", F.lit("null")), "}").alias("json"))
    return stack([parts, summary])
