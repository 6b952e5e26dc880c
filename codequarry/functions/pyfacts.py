"""Exact Python structure: one Arrow-batched column over the standard parser."""

from __future__ import annotations

import ast
import sys
import warnings
from collections import deque

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from codequarry.catalog import MAX_ARGUMENTS

# Workers need no copy of this package: the function travels with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ELEMENT = (
    "struct<line:int,ord:int,type:string,name:string,params:array<string>,bases:array<string>,"
    "methods:array<string>,extends:string,implements:array<string>>"
)
FACTS = (
    f"struct<ok:boolean,elements:array<{ELEMENT}>,"
    "wide:array<struct<line:int,name:string,args:int>>>"
)

_STRINGS = pa.list_(pa.string())
_ARROW_FACTS = pa.struct([
    ("ok", pa.bool_()),
    ("elements", pa.list_(pa.struct([
        ("line", pa.int32()), ("ord", pa.int32()), ("type", pa.string()), ("name", pa.string()),
        ("params", _STRINGS), ("bases", _STRINGS), ("methods", _STRINGS),
        ("extends", pa.string()), ("implements", _STRINGS)]))),
    ("wide", pa.list_(pa.struct([
        ("line", pa.int32()), ("name", pa.string()), ("args", pa.int32())]))),
])
#: Fields of a statement that hold statements, exception handlers or cases.
_BLOCKS = frozenset({"body", "orelse", "handlers", "finalbody", "cases"})
_FAILED = {"ok": False, "elements": [], "wide": []}


def syntax_facts(source: str) -> dict:
    """Imports, classes, functions and module variables of one text, breadth first. All of them are
    statements, so expressions are not entered."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            root = ast.parse(source)
    except Exception:
        return _FAILED
    found, wide = [], []

    def add(node, kind, name, **more):
        found.append({"line": node.lineno, "ord": len(found), "type": kind, "name": name, **more})

    queue = deque([(root, None)])
    while queue:
        node, owner = queue.popleft()
        for field in node._fields:
            if field in _BLOCKS:
                queue.extend((child, node) for child in getattr(node, field))
        match node:
            case ast.Import(names=names):
                for alias in names:
                    add(node, "import", alias.name)
            case ast.ImportFrom(module=module, names=names):
                for alias in names:
                    add(node, "import", f"from {module or ''} import {alias.name}")
            case ast.ClassDef(name=name, bases=bases, body=body):
                add(node, "class", name,
                    bases=[b.id for b in bases if isinstance(b, ast.Name)],
                    methods=[s.name for s in body if isinstance(s, ast.FunctionDef)])
            case ast.FunctionDef(name=name):
                params = [a.arg for a in node.args.args]
                if len(params) > MAX_ARGUMENTS:
                    wide.append({"line": node.lineno, "name": name, "args": len(params)})
                if not isinstance(owner, ast.ClassDef):
                    add(node, "function", name, params=params)
            case ast.Assign(targets=targets) if isinstance(owner, ast.Module):
                for target in targets:
                    if isinstance(target, ast.Name):
                        add(node, "variable", target.id)
    return {"ok": True, "elements": sorted(found, key=lambda e: e["line"]), "wide": wide}


def _facts(sources: pa.Array) -> pa.Array:
    return pa.array([None if s is None else syntax_facts(s) for s in sources.to_pylist()],
                    type=_ARROW_FACTS)


def python_facts(sources: Column) -> Column:
    """Facts of each text; NULL in, NULL out."""
    return arrow_udf(_facts, FACTS)(sources)
