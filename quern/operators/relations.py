"""Table-valued functions, recursive queries, text search, boxes, catalogue frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from quern.functions.json import Object, dump, follow, load, path
from quern.sources.scratch import written


def generate_series(spark: SparkSession, start: int, stop: int = 4294967295, step: int = 1) -> DataFrame:
    """start, start + step ... up to stop; a step of 0 counts as 1; nothing in the wrong direction."""
    step = step or 1
    end = stop + (1 if step > 0 else -1)
    return spark.range(start, end, step).withColumnRenamed("id", "value") if (stop - start) * step >= 0 else spark.range(0).withColumnRenamed("id", "value")


def values(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """VALUES: columns column1 to columnN."""
    return spark.createDataFrame(rows, [f"column{i + 1}" for i in range(len(rows[0]))])


JSON_COLUMNS = "key string, value string, type string, atom string, id bigint, parent bigint, fullkey string, path string"


def kind_of(x) -> str:
    if isinstance(x, Object):
        return "object"
    return {bool: str(x).lower(), int: "integer", float: "real", str: "text", list: "array", type(None): "null"}[type(x)]


def _sql_value(x) -> str | None:
    """A JSON value as SQL sees it, as text: truth values are 1 and 0, null is null, objects and arrays are JSON."""
    return None if x is None else str(int(x)) if isinstance(x, bool) else x if isinstance(x, str) else dump(x)


def _label(key: str) -> str:
    return f".{key}" if key.isalnum() and key[:1].isalpha() else f'."{key}"'


def _nodes(text: str | None, where: str, deep: bool):
    """Rows of json_each (not deep) and json_tree: parents first; ids count nodes from 0."""
    if text is None or where is None:
        return
    steps = path(where)
    found, top = follow(load(text), steps)
    if not found:
        return
    count = 0
    start = where.rpartition(".")[0] if steps and isinstance(steps[-1], str) else where.rpartition("[")[0] if steps else "$"
    key = None if not steps else steps[-1] if isinstance(steps[-1], str) else str(steps[-1])
    stack = [(key, top, None, where, start, True)]
    while stack:
        key, x, parent, full, at, is_top = stack.pop()
        mine, count = count, count + 1
        compound = isinstance(x, list)
        if deep or not is_top or not compound:
            value = _sql_value(x)
            yield key, value, kind_of(x), None if compound else value, mine, parent if deep else None, full, at
        if compound and (deep or is_top):
            entries = [(k, v, full + _label(k)) for k, v in x] if isinstance(x, Object) else [(str(i), v, f"{full}[{i}]") for i, v in enumerate(x)]
            stack += [(k, v, mine, name, full, False) for k, v, name in reversed(entries)]


@udtf(returnType=JSON_COLUMNS, useArrow=True)
class JsonEach:
    """json_each: the elements of the value at a path, or the value itself if it has none."""

    def eval(self, text: str, where: str):
        yield from _nodes(text, where, False)


@udtf(returnType=JSON_COLUMNS, useArrow=True)
class JsonTree:
    """json_tree: every node of the value at a path."""

    def eval(self, text: str, where: str):
        yield from _nodes(text, where, True)


def _walked(df: DataFrame, column: str, keep: list[str], name: str, function, where: str) -> DataFrame:
    spark = df.sparkSession
    spark.udtf.register(name, function)
    return spark.sql(f"select {', '.join('t.`' + k + '`' for k in keep)}, j.* from {{t}} t, lateral {name}(t.`{column}`, :where) j", args={"where": where}, t=df)


def json_each(df: DataFrame, column: str, keep: list[str], where: str = "$") -> DataFrame:
    """The kept columns with key, value, type, atom, id, parent, fullkey and path of each top-level element."""
    return _walked(df, column, keep, "quern_json_each", JsonEach, where)


def json_tree(df: DataFrame, column: str, keep: list[str], where: str = "$") -> DataFrame:
    return _walked(df, column, keep, "quern_json_tree", JsonTree, where)


def recursive_union(seed: DataFrame, step, limit: int = 1000) -> DataFrame:
    """WITH RECURSIVE ... UNION: rows reached from the seed; step maps the newest rows to their followers.

    Each generation is written to the shared folder, so the plan stays as long as one step and a lost
    executor costs no generation but its own. All generations are one table, read anew when they have doubled
    in number; a step that finds nothing new ends it, limit steps that do raise.
    """
    newest = written(seed.distinct())
    seen, fresh = newest, []
    for _ in range(limit):
        known = seen
        for g in fresh:
            known = known.unionAll(g)
        newest = written(step(newest).distinct().subtract(known))
        if newest.isEmpty():
            return known
        fresh.append(newest)
        if len(fresh) >= 8:
            for g in fresh:
                seen = seen.unionAll(g)
            seen, fresh = written(seen), []
    raise RuntimeError(f"no end after {limit} generations")


def tokens(text: Column) -> Column:
    """Full-text tokens: runs of letters and digits, case- and diacritic-folded."""
    folded = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def fts_term(tok: Column, term: str) -> Column:
    return F.array_contains(tok, term.lower())


def fts_prefix(tok: Column, prefix: str) -> Column:
    return F.exists(tok, lambda x: x.startswith(prefix.lower()))


def fts_phrase(tok: Column, *words: str) -> Column:
    """Whether the words stand next to each other; joined tokens decide, so no positions are needed."""
    return F.concat(F.lit(" "), F.array_join(tok, " "), F.lit(" ")).contains(" " + " ".join(w.lower() for w in words) + " ")


def fts_count(tok: Column, term: str) -> Column:
    """Matching occurrences in a document."""
    return F.size(F.filter(tok, lambda x: x == term.lower()))


def fts_match(tok: Column, query: str) -> Column:
    """A match expression: terms, "phrases", prefix*, AND OR NOT, parentheses; juxtaposition is AND."""
    import re

    parts = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+', query)
    at = 0

    def peek() -> str | None:
        return parts[at] if at < len(parts) else None

    def either() -> Column:
        nonlocal at
        out = both()
        while peek() == "OR":
            at += 1
            out = out | both()
        return out

    def both() -> Column:
        nonlocal at
        out = atom()
        while peek() not in (None, ")", "OR"):
            if peek() == "NOT":
                at += 1
                out = out & ~atom()
                continue
            if peek() == "AND":
                at += 1
            out = out & atom()
        return out

    def atom() -> Column:
        nonlocal at
        word = parts[at]
        at += 1
        if word == "(":
            out = either()
            at += 1
            return out
        if word.startswith('"'):
            return fts_phrase(tok, *re.findall(r"\w+", word))
        return fts_prefix(tok, word[:-1]) if word.endswith("*") else fts_term(tok, word)

    return either()


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The inverted index: token, key, number of occurrences."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy("token", key).agg(F.count("*").alias("n"))


def intersects(boxes: list[tuple[Column, Column]], query: list[tuple[float, float]]) -> Column:
    out = F.lit(True)
    for (low, high), (a, b) in zip(boxes, query, strict=True):
        out = out & (low <= b) & (high >= a)
    return out


def contained(boxes: list[tuple[Column, Column]], query: list[tuple[float, float]]) -> Column:
    """Boxes that lie within the query box."""
    out = F.lit(True)
    for (low, high), (a, b) in zip(boxes, query, strict=True):
        out = out & (low >= a) & (high <= b)
    return out


def box_join(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs of intersecting boxes (id, x0, x1, y0, y1): grid cells make it an equi-join; the cell of the
    intersection's lower corner alone reports a pair, so none comes twice."""

    def cells(df: DataFrame, side: str) -> DataFrame:
        steps = lambda a, b: F.sequence(F.floor(F.col(a) / cell).cast("bigint"), F.floor(F.col(b) / cell).cast("bigint"))
        rows = df.select(*(F.col(c).alias(f"{side}_{c}") for c in ("id", "x0", "x1", "y0", "y1")), F.explode(steps("x0", "x1")).alias("cx"), *[F.col(c) for c in ("y0", "y1")])
        return rows.withColumn("cy", F.explode(steps("y0", "y1"))).drop("y0", "y1")

    both = cells(left, "a").join(cells(right, "b"), ["cx", "cy"])
    hit = (F.col("a_x0") <= F.col("b_x1")) & (F.col("a_x1") >= F.col("b_x0")) & (F.col("a_y0") <= F.col("b_y1")) & (F.col("a_y1") >= F.col("b_y0"))
    corner = (F.floor(F.greatest("a_x0", "b_x0") / cell) == F.col("cx")) & (F.floor(F.greatest("a_y0", "b_y0") / cell) == F.col("cy"))
    return both.where(hit & corner).select("a_id", "b_id")


def table_info(df: DataFrame) -> DataFrame:
    """pragma table_info: cid, name, type, notnull."""
    rows = [(i, f.name, f.dataType.simpleString(), int(not f.nullable)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "cid int, name string, type string, notnull int")


def table_list(frames: dict[str, DataFrame]) -> DataFrame:
    """pragma table_list: name, type, ncol."""
    rows = [(name, "table", len(df.columns)) for name, df in frames.items()]
    return next(iter(frames.values())).sparkSession.createDataFrame(rows, "name string, type string, ncol int")
