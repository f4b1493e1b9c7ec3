"""JSON functions: reads are built-in expressions, edits a document model that keeps key order and repeated keys."""

from __future__ import annotations

import json as _json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quern.functions.semantics import _c


class Object(list):
    """A JSON object as (key, value) pairs."""


def load(text: str) -> Any:
    return _json.loads(text, object_pairs_hook=Object)


def dump(x: Any, indent: str | None = None, depth: int = 0) -> str:
    colon, gap, end = (": ", "\n" + indent * (depth + 1), "\n" + indent * depth) if indent is not None else (":", "", "")
    if isinstance(x, Object):
        inner = ("," + gap).join(f"{_json.dumps(k, ensure_ascii=False)}{colon}{dump(v, indent, depth + 1)}" for k, v in x)
        return f"{{{gap}{inner}{end}}}" if x else "{}"
    if isinstance(x, list):
        return f"[{gap}" + ("," + gap).join(dump(v, indent, depth + 1) for v in x) + f"{end}]" if x else "[]"
    if isinstance(x, float):
        return repr(x)
    return _json.dumps(x, ensure_ascii=False)


def path(text: str) -> list[str | int | None]:
    """Steps of $.a."b c"[0][#-1][#]; None stands for the place after an array's last element."""
    if not text.startswith("$"):
        raise ValueError(f"bad JSON path: {text}")
    steps: list[str | int | None] = []
    at = 1
    for m in re.finditer(r'\.(?:"([^"]*)"|([^.\[]+))|\[(\d+)\]|\[#-(\d+)\]|\[#\]', text):
        if m.start() != at:
            break
        at = m.end()
        if m[1] is not None or m[2] is not None:
            steps.append(m[1] if m[1] is not None else m[2])
        elif m[3] is not None:
            steps.append(int(m[3]))
        else:
            steps.append(-int(m[4]) if m[4] is not None else None)
    if at != len(text):
        raise ValueError(f"bad JSON path: {text}")
    return steps


def _child(x: Any, step: str | int | None) -> int | None:
    """The place of a step's child, if it exists."""
    if isinstance(step, str):
        return next((i for i, (k, _) in enumerate(x) if k == step), None) if isinstance(x, Object) else None
    if isinstance(x, Object) or not isinstance(x, list) or step is None:
        return None
    place = step if step >= 0 else len(x) + step
    return place if 0 <= place < len(x) else None


def edit(x: Any, steps: list, value: Any, mode: str) -> Any:
    """x after insert (only if absent), replace (only if present), set (either) or remove at a path."""
    if not steps:
        return x if mode == "insert" else None if mode == "remove" else value
    step, rest = steps[0], steps[1:]
    at = _child(x, step)
    if at is None:
        if mode not in ("insert", "set"):
            return x
        if isinstance(step, str) and isinstance(x, Object):
            x.append((step, edit(_fresh(rest), rest, value, "set") if rest else value))
        elif not isinstance(step, str) and isinstance(x, list) and not isinstance(x, Object) and (step is None or step == len(x)):
            x.append(edit(_fresh(rest), rest, value, "set") if rest else value)
        return x
    if mode == "remove" and not rest:
        del x[at]
        return x
    if isinstance(x, Object):
        x[at] = (x[at][0], edit(x[at][1], rest, value, mode))
    else:
        x[at] = edit(x[at], rest, value, mode)
    return x


def _fresh(steps: list) -> Any:
    return Object() if isinstance(steps[0], str) else []


def patch(x: Any, y: Any) -> Any:
    """RFC 7396."""
    if not isinstance(y, Object):
        return y
    out = Object(x) if isinstance(x, Object) else Object()
    for k, v in y:
        at = _child(out, k)
        if v is None:
            if at is not None:
                del out[at]
        elif at is None:
            out.append((k, patch(None, v)))
        else:
            out[at] = (k, patch(out[at][1], v))
    return out


def _edited(mode: str):
    def f(x, where: str, value=None, as_json: bool = False) -> Column:
        steps = path(where)

        @pandas_udf("string")
        def run(docs, values):
            def one(doc, v):
                if doc is None:
                    return None
                v = load(v) if as_json and v is not None else v.item() if hasattr(v, "item") else v
                return dump(edit(load(doc), steps, v, mode))

            return type(docs)([one(d, v) for d, v in zip(docs, values, strict=True)])

        return run(_c(x), _c(value) if value is not None else F.lit(None).cast("string"))

    return f


json_insert, json_replace, json_set = _edited("insert"), _edited("replace"), _edited("set")


def json_remove(x, where: str) -> Column:
    return _edited("remove")(x, where)


def json_patch(a, b) -> Column:
    @pandas_udf("string")
    def run(x, y):
        return type(x)([None if p is None or q is None else dump(patch(load(p), load(q))) for p, q in zip(x, y, strict=True)])

    return run(_c(a), _c(b))


def json_pretty(x, indent: str = "    ") -> Column:
    @pandas_udf("string")
    def run(v):
        return v.map(lambda t: None if t is None else dump(load(t), indent))

    return run(_c(x))


def _bare(x: Column) -> Column:
    """A document without white space, keys in their order."""
    return F.regexp_replace(x, r'("(?:[^"\\]|\\.)*+")|[ \t\n\r]++', "$1")


def _sound(x: Column) -> Column:
    """Whether a text is a document. The parser refuses repeated keys; what a walk over it copies in full is one, too."""
    return F.try_parse_json(x).isNotNull() | F.coalesce(F.get_json_object(x, "$") == _bare(x), F.lit(False))


def json(x) -> Column:
    """The document without white space, keys in their order; what is no document raises."""
    x = _c(x)
    return F.when(x.isNull() | _sound(x), _bare(x)).otherwise(F.raise_error(F.lit("malformed JSON")).cast("string"))


def json_error_position(x) -> Column:
    """0 for a document, else the place (from 1) of the first error."""

    @pandas_udf("int")
    def run(v):
        def one(t):
            try:
                _json.loads(t)
            except _json.JSONDecodeError as e:
                return e.pos + 1
            return 0

        return v.map(one, na_action="ignore")

    return run(_c(x))


def json_valid(x) -> Column:
    x = _c(x)
    return F.when(x.isNotNull(), _sound(x).cast("int"))


def json_extract(x, *paths: str) -> Column:
    """A scalar's text, an object's or array's JSON; several paths make an array."""
    if len(paths) == 1:
        return F.get_json_object(_c(x), paths[0])
    return F.to_json(F.array(*(F.get_json_object(_c(x), p) for p in paths)), {"ignoreNullFields": "false"})


def json_array_length(x, where: str = "$") -> Column:
    doc = F.get_json_object(_c(x), where)
    return F.when(doc.isNotNull(), F.coalesce(F.json_array_length(doc), F.lit(0)))


def json_type(x, where: str = "$") -> Column:
    """null, true, false, integer, real, text, array or object; null if there is nothing."""
    found = F.try_variant_get(F.try_parse_json(_c(x)), where, "variant")
    kind = F.schema_of_variant(found)
    value = F.try_variant_get(found, "$", "boolean")
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "text").when(kind == "BIGINT", "integer")
        .when(kind == "BOOLEAN", F.when(value, "true").otherwise("false")).when(kind == "VOID", "null").when(kind.isNotNull(), "real")
    )


def json_quote(x) -> Column:
    text = F.to_json(F.array(_c(x)), {"ignoreNullFields": "false"})
    return text.substr(F.lit(2), F.length(text) - 2)


def json_array(*xs) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *(json_quote(x) for x in xs)), F.lit("]"))


def json_object(*pairs) -> Column:
    entries = [F.concat(json_quote(k), F.lit(":"), json_quote(v)) for k, v in zip(pairs[::2], pairs[1::2], strict=True)]
    return F.concat(F.lit("{"), F.concat_ws(",", *entries), F.lit("}"))


def follow(x: Any, steps: list) -> tuple[bool, Any]:
    """Whether there is a value at a path, and the value."""
    for step in steps:
        at = _child(x, step)
        if at is None:
            return False, None
        x = x[at][1] if isinstance(x, Object) else x[at]
    return True, x


def value_at(text: str, where: str) -> Any:
    """The SQL value at a path: a number, a text, JSON for objects and arrays, None for null and nothing."""
    found, x = follow(load(text), path(where))
    return dump(x) if isinstance(x, list) else int(x) if isinstance(x, bool) else x if found else None


def subtree(text: str, where: str) -> str | None:
    found, x = follow(load(text), path(where))
    return dump(x) if found else None


def _error(text: str) -> int:
    try:
        _json.loads(text)
    except _json.JSONDecodeError as e:
        return e.pos + 1
    return 0


def _sql_text(x: Any) -> str | None:
    return None if x is None else x if isinstance(x, str) else dump(x)


def register(spark) -> None:
    """The functions that edit or walk documents, by name, in Arrow batches."""
    named = {
        "quern_json_value": ("string", lambda t, where: _sql_text(value_at(t, where))),
        "quern_json_subtree": ("string", subtree),
        "quern_json_edit": ("string", lambda t, where, v, mode: dump(edit(load(t), path(where), load(v), mode))),
        "quern_json_patch": ("string", lambda a, b: dump(patch(load(a), load(b)))),
        "quern_json_pretty": ("string", lambda t, indent: dump(load(t), indent)),
        "quern_json_error_position": ("int", _error),
    }
    for name, (kind, f) in named.items():

        def run(*columns, f=f):
            return type(columns[0])([None if any(v is None for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype=object)

        spark.udf.register(name, _typed(run, kind, f.__code__.co_argcount))


def _typed(run, kind: str, n: int):
    """A pandas function of n columns: Spark reads the number from the signature."""
    import pandas as pd

    bodies = {
        1: lambda a: run(a),
        2: lambda a, b: run(a, b),
        4: lambda a, b, c, d: run(a, b, c, d),
    }
    body = bodies[n]
    body.__annotations__ = {k: pd.Series for k in ("abcd"[:n])} | {"return": pd.Series}
    return pandas_udf(body, kind)
