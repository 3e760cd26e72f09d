"""Python symbols from real syntax trees, in Arrow batches inside Spark tasks."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_names = T.ArrayType(T.StringType())


def _rows(*extra: tuple) -> T.ArrayType:
    fields = [("line", T.IntegerType()), *extra]
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields]))


SYMBOLS = T.StructType([
    T.StructField("functions", _rows(("name", T.StringType()), ("params", _names))),
    T.StructField("classes", _rows(("name", T.StringType()), ("methods", _names))),
    T.StructField("imports", _rows(("source", T.StringType()))),
    T.StructField("parsed", T.BooleanType()),
])


def _read(source: str | None) -> tuple:
    functions, classes, imports = [], [], []
    if source is None:
        return functions, classes, imports, True
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return functions, classes, imports, False
    for node in ast.walk(tree):
        match node:
            case ast.FunctionDef():
                functions.append({"line": node.lineno, "name": node.name, "params": [a.arg for a in node.args.args]})
            case ast.ClassDef():
                methods = [m.name for m in node.body if type(m) is ast.FunctionDef]
                classes.append({"line": node.lineno, "name": node.name, "methods": methods})
            case ast.Import():
                imports.extend({"line": node.lineno, "source": alias.name} for alias in node.names)
            case ast.ImportFrom() if node.module:
                imports.append({"line": node.lineno, "source": node.module})
    return functions, classes, imports, True


@F.pandas_udf(SYMBOLS)
def python_symbols(source: pd.Series) -> pd.DataFrame:
    """Functions, classes and imports of each text; ``parsed`` is false when it has no tree."""
    return pd.DataFrame([_read(text) for text in source], columns=["functions", "classes", "imports", "parsed"])
