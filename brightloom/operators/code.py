"""Python sources: symbols, signatures, imports; mentions of symbols and paths, tests linked to modules."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

KINDS = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "async_function"}


def parse(source: str) -> ast.Module | None:
    """The module, or None if it is no valid Python."""
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None


def definitions(node: ast.AST, parent: str | None = None, into: tuple = tuple(KINDS)) -> Iterator[tuple[ast.AST, str, str | None]]:
    """(node, qualified name, parent's qualified name) of classes and functions, in order; the bodies of kinds outside `into` are left alone."""
    for child in ast.iter_child_nodes(node):
        if type(child) in KINDS:
            name = f"{parent}.{child.name}" if parent else child.name
            yield child, name, parent
            if isinstance(child, into):
                for inner in child.body:
                    yield from definitions(ast.Module([inner], []), name, into)
        elif into == tuple(KINDS):
            yield from definitions(child, parent, into)


def signature(node: ast.AST, longest: int = 160) -> str:
    """How a class or function is declared, without its body."""
    inside = ", ".join(map(ast.unparse, node.bases)) if isinstance(node, ast.ClassDef) else ast.unparse(node.args)
    if isinstance(node, ast.ClassDef):
        return f"class {node.name}{f'({inside})' if inside else ''}"[:longest]
    return f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({inside})"[:longest]


def symbol_rows(tree: ast.Module) -> Iterator[tuple]:
    for node, name, parent in definitions(tree):
        yield node.name, name, KINDS[type(node)], node.lineno, node.end_lineno, parent


def outline_rows(tree: ast.Module) -> Iterator[tuple]:
    for node, name, _ in definitions(tree, into=(ast.ClassDef,)):
        yield name, KINDS[type(node)], signature(node), [ast.unparse(b) for b in getattr(node, "bases", [])], node.lineno, node.end_lineno


def structure_rows(tree: ast.Module) -> Iterator[tuple]:
    """How many classes and functions a module has, as outline_rows() finds them; nothing is written out, which takes longest."""
    classes = [isinstance(node, ast.ClassDef) for node, _, _ in definitions(tree, into=(ast.ClassDef,))]
    if classes:
        yield sum(classes), len(classes) - sum(classes)


def import_rows(tree: ast.Module, most: int = 8) -> list[tuple]:
    """The imports at the top level: (module, names, kind), `most` at most, as a summary shows them."""
    found = []
    for node in tree.body:
        if isinstance(node, ast.Import):
            found += [(a.name, [a.asname or a.name], "import") for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            found.append((node.module, [a.name for a in node.names], "import_from"))
    return found[:most]


def package_rows(tree: ast.Module) -> Iterator[tuple[str]]:
    """The first part of every imported module, at any depth, once per import."""
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            yield from ((a.name.split(".")[0],) for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            yield (node.module.split(".")[0],)


def per_file(files: DataFrame, rows: Callable[[ast.Module], Iterator[tuple]], schema: str) -> DataFrame:
    """`rows` of each source that is valid Python, after its path. files: path, source; null sources have no rows."""
    ship(files.sparkSession)
    names = ["path", *(c.strip().split(" ")[0] for c in schema.split(";"))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = ((p, parse(s)) for p, s in zip(b["path"], b["source"]))
            yield pd.DataFrame([(p, *r) for p, tree in parsed if tree for r in rows(tree)], columns=names)

    return files.select("path", "source").where("path IS NOT NULL AND source IS NOT NULL").mapInPandas(run, "path string, " + schema.replace(";", ","))


def symbols(files: DataFrame) -> DataFrame:
    """(path, name, qualified_name, kind, line_start, line_end, parent) of every class and function, nested ones included."""
    return per_file(files, symbol_rows, "name string; qualified_name string; kind string; line_start long; line_end long; parent string")


def outlines(files: DataFrame) -> DataFrame:
    """(path, qualified_name, kind, signature, bases, line_start, line_end): like symbols(), but the bodies of functions are not entered."""
    return per_file(files, outline_rows, "qualified_name string; kind string; signature string; bases array<string>; line_start long; line_end long")


def imports(files: DataFrame) -> DataFrame:
    """(path, module, names, kind) of the first eight imports at the top level of each file."""
    return per_file(files, import_rows, "module string; names array<string>; kind string")


def import_counts(files: DataFrame) -> DataFrame:
    """(name, observations): packages by how many import statements name them."""
    return per_file(files, package_rows, "name string").groupBy("name").agg(F.count(F.lit(1)).alias("observations"))


def module_summaries(found: DataFrame) -> DataFrame:
    """(path, classes, functions) from outlines()."""
    return found.groupBy("path").agg(F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind") != "class").alias("functions"))


def module_structures(files: DataFrame) -> DataFrame:
    """What module_summaries() says of outlines(), counted in each file without its signatures."""
    return per_file(files, structure_rows, "classes long; functions long").groupBy("path").agg(F.sum("classes").alias("classes"), F.sum("functions").alias("functions"))


def symbol_texts(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, qualified_name, line_start, start_char, end_char, text): each symbol's lines and where they lie in the source."""
    s = found.join(files.select("path", F.split("source", "\n").alias("_l")), "path")
    chars = lambda n: F.aggregate(F.slice("_l", F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x) + 1)
    text = F.array_join(F.slice("_l", F.col("line_start").cast("int"), (F.col("line_end") - F.col("line_start") + 1).cast("int")), "\n")
    s = s.select("path", "qualified_name", "line_start", chars((F.col("line_start") - 1).cast("int")).cast("long").alias("start_char"), text.alias("text"))
    return s.select("path", "qualified_name", "line_start", "start_char", (F.col("start_char") + F.length("text")).alias("end_char"), "text")


def resolve(mentions: DataFrame, found: DataFrame) -> DataFrame:
    """(path, mention, qualified_name): each mentioned symbol's definition in its file: the same qualified name, else the first with the same last part; null without one."""
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    d = found.select("path", "qualified_name", "line_start", last("qualified_name").alias("_short"))
    m = mentions.select("path", "mention", last("mention").alias("_short")).distinct().join(d, ["path", "_short"], "left")
    best = F.min_by("qualified_name", F.struct(F.col("qualified_name") != F.col("mention"), "line_start"))
    return m.groupBy("path", "mention").agg(best.alias("qualified_name"))


#: Fixed value: what counts as a path in a text: directories, a name and a suffix, not in the middle of a word.
PATH = r"(?<![A-Za-z0-9_])(?:[\w.-]+/)+[\w.-]+\.[A-Za-z0-9]+"


def mentioned_paths(text: Column) -> Column:
    """Distinct relative paths with a suffix that a text names, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(PATH), F.lit(0))))


def linked_tests(modules: DataFrame, tests: DataFrame, most: int = 8) -> DataFrame:
    """(path, test, rank): the first `most` tests, by path, whose path holds the module's stem.

    A test's path is cut into runs of signs only where the first three signs of some stem stand, and only to lengths of stems that begin so; what it holds
    then is found by equality. Work grows with tests times the lengths of stems, not with pairs. Each stem's first tests are chosen before modules meet them.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    m = modules.select("path").distinct().withColumn("stem", stem).where("stem <> ''")
    stems = m.select("stem").distinct()
    ways = stems.select(F.left("stem", F.lit(3)).alias("begin"), F.length("stem").alias("n")).distinct()
    # A row per beginning of three signs: few, however many stems begin so.
    ways = ways.groupBy("begin").agg(F.collect_list("n").alias("lengths"))
    t = tests.select(F.col("path").alias("test")).distinct().where("test <> ''")
    begins = F.flatten(F.transform(F.sequence(F.lit(1), F.length("test")), lambda i: F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.struct(i.alias("i"), F.substring("test", i, n).alias("begin")))))
    runs = t.select("test", F.inline(begins)).join(F.broadcast(ways), "begin").select("test", "i", "begin", F.explode("lengths").alias("n"))
    # Stems shorter than three signs are their own beginnings; at the end of a path a shorter run than asked for is left out.
    runs = runs.where((F.col("i") + F.col("n") - 1 <= F.length("test")) & (F.length("begin") == F.least("n", F.lit(3))))
    held = runs.select("test", F.substring("test", F.col("i"), F.col("n")).alias("stem")).distinct().join(stems, "stem", "left_semi")
    rank = F.row_number().over(Window.partitionBy("stem").orderBy("test")).cast("long")
    return m.join(held.withColumn("rank", rank).where(F.col("rank") <= most), "stem").select("path", "test", "rank")
