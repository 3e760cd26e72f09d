"""Classification of files, folders and modules as column expressions.

``lowered`` is always the lower-cased text: callers project it once and share it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import contains_any, first_rule


def is_backend(path: Column, lowered: Column, api_count: Column | None = None, profile: str = "enhanced") -> Column:
    """Backend test: endpoints (not in core), then path words, then words of the lowered text."""
    words = rules.BACKEND[profile]
    test = contains_any(F.lower(path), words["path"]) | contains_any(lowered, words["content"])
    return test if api_count is None else (api_count > 0) | test


def file_purpose(path: Column, lowered: Column, api_count: Column, function_count: Column) -> Column:
    tail = (F.when(api_count > 0, "API Implementation")
            .when(lowered.contains("component") | lowered.contains("jsx"), "Frontend Components")
            .when(function_count > 5, "Business Logic")
            .when(lowered.contains("config"), "Configuration").otherwise(rules.DEFAULT_PURPOSE))
    return first_rule(F.lower(path), rules.PURPOSE_PATHS["enhanced"], tail)


def file_purpose_detailed(path: Column, endpoints: Column, components: Column, classes: Column,
                          functions: Column) -> Column:
    """The last four arguments are counts."""
    tail = (F.when(endpoints > 0, "API Implementation").when(components > 0, "Frontend Components")
            .when((classes > 0) & (functions > 0), "Business Logic")
            .when(functions > 0, "Utility Functions").otherwise(rules.DEFAULT_PURPOSE))
    return first_rule(F.lower(path), rules.PURPOSE_PATHS["detailed"], tail)


def file_purpose_core(path: Column, lowered: Column) -> Column:
    tail = first_rule(lowered, rules.PURPOSE_CORE_CONTENT, F.lit(rules.DEFAULT_PURPOSE))
    return first_rule(F.lower(path), rules.PURPOSE_PATHS["core"], tail)


def file_category(purpose: Column, endpoints: Column, components: Column, classes: Column,
                  functions: Column) -> Column:
    fallback = (F.when(endpoints > 0, "API Routes").when(components > 0, "UI Components")
                .when(classes > 0, "Classes/Models").when(functions > 0, "Business Logic")
                .otherwise("Configuration/Other"))
    return F.coalesce(F.when(purpose != "", purpose), fallback)


def prompt_file_type(path: Column, endpoints: Column) -> Column:
    low = F.lower(path)
    return (F.when(endpoints > 0, "api_routes")
            .when(contains_any(low, ["component", "jsx", "tsx"]), "frontend_component")
            .when(contains_any(low, ["server", "service", "api", "app.py", "main.py"]), "backend_service")
            .otherwise("general"))


def service_type(lowered: Column) -> Column:
    return (F.when(contains_any(lowered, rules.FRONTEND_WORDS), "frontend")
            .when(contains_any(lowered, [word for word, _ in rules.BACKEND_FRAMEWORKS]), "backend"))


def service_framework(path: Column, lowered: Column) -> Column:
    frontend = (F.when(lowered.contains("react") | path.contains("jsx"), "React").when(lowered.contains("next"), "Next.js")
                .when(lowered.contains("vue"), "Vue.js"))
    backend = first_rule(lowered, [([word], label) for word, label in rules.BACKEND_FRAMEWORKS])
    return F.when(contains_any(lowered, rules.FRONTEND_WORDS), frontend).otherwise(backend)


def service_port(lowered: Column) -> Column:
    return F.regexp_extract(lowered, rules.PORT, 1).try_cast("int")


def service_info(path: Column, lowered: Column) -> Column:
    kind = service_type(lowered)
    return F.when(kind.isNotNull(), F.struct(
        kind.alias("type"), service_framework(path, lowered).alias("framework"), service_port(lowered).alias("port")))


def integration_points(lowered: Column) -> Column:
    return F.array_compact(F.array(*[F.when(contains_any(lowered, words), F.lit(label))
                                     for words, label in rules.INTEGRATIONS]))


def eligible_optimized(path: Column, service: Column, functions: Column, endpoints: Column,
                       classes: Column) -> Column:
    """Backend service or telling path, with content, and not a configuration file."""
    low = F.lower(path)
    ending = F.lit(False)
    for text in rules.CONFIG_ENDINGS:
        ending = ending | path.endswith(text)
    config = (ending | low.contains("config") | contains_any(path, rules.CONFIG_TOKENS[1:]))
    serving = F.coalesce(service == "backend", F.lit(False)) | contains_any(low, rules.ELIGIBLE_PATHS)
    return serving & ((functions > 0) | (endpoints > 0) | (classes > 0)) & ~config


def folder_purpose(folder: Column, files: Column, with_endpoints: Column, with_components: Column,
                   any_backend: Column, any_frontend: Column) -> Column:
    tail = (F.when(with_endpoints > files * 0.5, "API Implementation")
            .when(with_components > files * 0.5, "Frontend Components")
            .when(any_backend, "Backend Services").when(any_frontend, "Frontend Application")
            .otherwise(rules.DEFAULT_PURPOSE))
    return first_rule(F.lower(folder), rules.FOLDER_PURPOSE_PATHS, tail)


def module_role(module: Column) -> Column:
    return first_rule(F.lower(module), rules.MODULE_ROLES, F.lit(rules.DEFAULT_ROLE))


def domain_of(module: Column) -> Column:
    return first_rule(F.lower(module), rules.DOMAINS, F.lit(rules.DEFAULT_DOMAIN))


def importance_score(path: Column, api_count: Column, function_count: Column, backend: Column) -> Column:
    low = F.lower(path)
    return (api_count * 10 + function_count * 2 + F.when(backend, 15).otherwise(0)
            + F.when(contains_any(low, rules.MAIN_NAMES), 20).otherwise(0)
            + F.when(contains_any(low, rules.HANDLER_NAMES), 15).otherwise(0))
