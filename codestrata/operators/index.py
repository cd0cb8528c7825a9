"""Symbol index over source files: tables of symbols, references, scopes and calls,
and what can be asked of them. All of it is joins on (file_path, ...) keys."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import bracecode, outline, pycode
from codestrata.functions.code_filter import extension
from codestrata.functions.paths import content_hash, module_name

_RANGE = "start_line int, start_col int, end_line int, end_col int"
SCHEMAS = {
    "symbols": f"seq int, name string, kind string, qualified_name string, {_RANGE}, scope_id int, type_string string, docstring string, imported_from string, import_name string, is_public boolean, is_exported boolean, is_async boolean, decorators array<string>, value_call string, parameters array<struct<name:string,type:string>>, base_classes array<string>",
    "references": f"name string, {_RANGE}, resolved string, scope_id int, is_read boolean, is_write boolean, is_call boolean",
    "scopes": f"scope_id int, kind string, name string, {_RANGE}, parent_id int",
    "calls": "caller string, callee string, line int, col int",
    "all_names": "name string",
    "files": "language string, lines int, error_lines int",
}
#: What the index reads, by the ending of the path.
SOURCES = (".py", *(e for e in outline.LANGUAGES if e != ".java"))


def module_of(path: Column) -> Column:
    """The module of a source: dotted path without the ending of any indexed language."""
    return module_name(F.regexp_replace(path, "\\.(?:" + "|".join(e[1:] for e in SOURCES if e != ".py") + ")$", ""))


def latest_files(memory: DataFrame) -> DataFrame:
    """One source per path: that of the last row by (at_us, id); rows without a time come before
    all others. Texts of the losers do not move."""
    src = memory.where(extension(F.col("file_path")).isin(*SOURCES))
    last = src.groupBy("file_path").agg(F.max_by("id", F.struct("at_us", "id")).alias("id"))
    return src.join(last, ["file_path", "id"], "left_semi").select("file_path", F.col("new_code").alias("code"))


def facts(files: DataFrame) -> DataFrame:
    """(file_path, what, row): every fact of every file as one row, parsed once; narrow. Each file has
    a row of ``files``, whatever could be read of it."""
    modules = files.select("file_path", "code", module_of(F.col("file_path")).alias("module"), extension(F.col("file_path")).alias("ext"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, code, module, ext in zip(pdf["file_path"], pdf["code"], pdf["module"], pdf["ext"], strict=True):
                code = code or ""
                if ext in outline.LANGUAGES:
                    got = bracecode.index(module, code, ext)
                    got.files.append({"language": outline.LANGUAGES[ext], "lines": code.count("\n") + 1, "error_lines": 0})
                else:
                    got = pycode.Indexer(module).run(code)
                for what in SCHEMAS:
                    rows += [(path, what, json.dumps(r)) for r in getattr(got, what)]
            yield pd.DataFrame(rows, columns=["file_path", "what", "row"])

    return modules.mapInPandas(run, "file_path string, what string, row string")


def facts_table(parsed: DataFrame, what: str) -> DataFrame:
    return parsed.where(F.col("what") == what).select("file_path", F.from_json("row", SCHEMAS[what]).alias("r")).select("file_path", "r.*")


def outlines(df: DataFrame, key: str, path: str, code: str) -> DataFrame:
    """(key, kind, name, line, is_public, is_async) of JavaScript, TypeScript, Rust, Go, Java and C sources."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, r["kind"], r["name"], r["line"], r["is_public"], r["is_async"]) for k, e, c in zip(pdf[key], pdf["e"], pdf["c"], strict=True) for r in outline.outline(c or "", e)]
            yield pd.DataFrame(rows, columns=[key, "kind", "name", "line", "is_public", "is_async"])

    return df.select(key, extension(F.col(path)).alias("e"), F.col(code).alias("c")).mapInPandas(run, f"{key} {kind}, kind string, name string, line int, is_public boolean, is_async boolean")


def last_definitions(symbols: DataFrame) -> DataFrame:
    """One symbol per qualified name of a file; the last definition wins."""
    w = Window.partitionBy("file_path", "qualified_name").orderBy(F.desc("seq"))
    return symbols.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def exported(symbols: DataFrame) -> DataFrame:
    return symbols.where("is_exported and is_public")


def search_symbols(symbols: DataFrame, query: str, file_path: str | None = None) -> DataFrame:
    hits = symbols.where(F.lower("name").contains(query.lower()))
    return hits.where(F.col("file_path") == file_path) if file_path else hits


def signature(s: DataFrame) -> DataFrame:
    """Add ``signature``: name, parameters with types and result of a function, bases of a class, type of the rest."""
    params = F.array_join(F.transform("parameters", lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(": "), p["type"]), F.lit("")))), ", ")
    call = F.concat(F.when(F.col("is_async"), "async ").otherwise(""), F.col("name"), F.lit("("), params, F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), "type_string"), F.lit("")))
    bases = F.when(F.size("base_classes") > 0, F.concat(F.lit("("), F.array_join("base_classes", ", "), F.lit(")"))).otherwise("")
    typed = F.concat("name", F.coalesce(F.concat(F.lit(": "), "type_string"), F.lit("")))
    return s.withColumn("signature", F.when(_callable(), call).when(F.col("kind") == "class", F.concat(F.lit("class "), "name", bases)).otherwise(typed))




def _callable() -> Column:
    return F.col("kind").isin("function", "method")


# What hover calls each kind of symbol.
KIND_NAMES = {"function": "Function", "method": "Method", "class": "Class", "variable": "Variable", "parameter": "Parameter", "import": "Imported module/name", "constant": "Constant", "property": "Property", "attribute": "Attribute"}


def _listed(items: str, shown: int = 3) -> Column:
    more = F.when(F.size(items) > shown, F.format_string(" (+%d more)", F.size(items) - shown)).otherwise("")
    return F.concat(F.array_join(F.slice(items, 1, shown), ", "), more)


def titled(symbols: DataFrame) -> DataFrame:
    """Symbols with ``signature``, ``title`` by kind and ``description``: the docstring, else what is known of the symbol."""
    s = signature(symbols)
    async_ = F.when(F.col("is_async"), "async ").otherwise("")
    plain = F.regexp_replace("signature", "^async ", "")
    typed = F.concat("name", F.coalesce(F.concat(F.lit(": "), "type_string"), F.lit("")))
    origin = F.when(F.col("import_name").isNull() & F.col("imported_from").isNotNull() & (F.col("imported_from") != F.col("name")), F.concat(F.lit("import "), "imported_from", F.lit(" as "), "name"))
    origin = F.coalesce(origin, F.when(F.col("import_name").isNotNull(), F.concat(F.lit("from "), "imported_from", F.lit(" import "), "import_name", F.when(F.col("name") != F.col("import_name"), F.concat(F.lit(" as "), "name")).otherwise(""))), F.concat(F.lit("import "), "name"))
    title = (
        F.when(_callable(), F.concat(async_, F.lit("def "), plain)).when(F.col("kind") == "class", F.col("signature")).when(F.col("kind") == "import", origin)
        .when(F.col("kind").isin("parameter", "constant", "property"), F.concat(F.lit("("), "kind", F.lit(") "), typed)).otherwise(typed)
    )
    kind = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in KIND_NAMES.items()], F.lit("Symbol"))
    told = F.concat_ws(
        "\n", F.concat(F.lit("*"), kind, F.lit("*")), F.when(~F.col("is_public"), "(private)"), F.when(F.col("is_async"), "async"),
        F.when(F.size("decorators") > 0, F.concat(F.lit("Decorators: "), _listed("decorators"))), F.when(F.size("base_classes") > 0, F.concat(F.lit("Inherits from: "), _listed("base_classes"))),
        F.concat(F.lit("Imported from: "), "imported_from"),
    )
    return s.withColumns({"title": title, "description": F.coalesce("docstring", told)})


def hover(symbols: DataFrame) -> DataFrame:
    """(file_path, qualified_name, kind, title, markdown) of every symbol."""
    s = titled(last_definitions(symbols))
    md = F.concat_ws("\n\n", F.concat(F.lit("```\n"), "title", F.lit("\n```")), F.when(F.col("description") != "", F.col("description")))
    return s.select("file_path", "qualified_name", "kind", "title", md.alias("markdown"))


def hover_at(positions: DataFrame, symbols: DataFrame, references: DataFrame) -> DataFrame:
    """(pos_id, qualified_name, kind, title, markdown): hover for what stands at each position."""
    at = entity_at(positions, symbols, references).where("qualified_name is not null").select("pos_id", "qualified_name")
    h = hover(symbols)
    one = h.groupBy("qualified_name").agg(F.min(F.struct("file_path", "kind", "title", "markdown")).alias("h"))
    return at.join(one, "qualified_name").select("pos_id", "qualified_name", "h.kind", "h.title", "h.markdown")


def signature_help(positions: DataFrame, symbols: DataFrame, references: DataFrame) -> DataFrame:
    """(pos_id, title): for positions on functions and methods only."""
    return hover_at(positions, symbols, references).where(_callable()).select("pos_id", "title")


def _inside(line: Column, col: Column) -> Column:
    p = F.struct(line, col)
    return (p >= F.struct("start_line", "start_col")) & (p <= F.struct("end_line", "end_col"))


def entity_at(positions: DataFrame, symbols: DataFrame, references: DataFrame) -> DataFrame:
    """(pos_id, what, name, qualified_name) at each (pos_id, file_path, line, col): an exact symbol,
    an exact reference, a reference around it, a symbol around it, in this order; the smallest of equals."""
    p = positions.select("pos_id", "file_path", "line", "col")
    size = F.struct((F.col("end_line") - F.col("start_line")).alias("l"), (F.col("end_col") - F.col("start_col")).alias("c"))
    both = symbols.select("file_path", F.lit("symbol").alias("what"), "name", "qualified_name", "start_line", "start_col", "end_line", "end_col").unionByName(
        references.select("file_path", F.lit("reference").alias("what"), "name", F.col("resolved").alias("qualified_name"), "start_line", "start_col", "end_line", "end_col")
    )
    hit = p.join(both, "file_path").where(_inside(F.col("line"), F.col("col")))
    exact = (F.col("start_line") == F.col("line")) & (F.col("start_col") == F.col("col"))
    rank = F.when(exact & (F.col("what") == "symbol"), 0).when(exact, 1).when(F.col("what") == "reference", 2).otherwise(3)
    return hit.groupBy("pos_id").agg(F.min_by(F.struct("what", "name", "qualified_name"), F.struct(rank, size, F.col("name"))).alias("e")).select("pos_id", "e.*")


def scope_at(positions: DataFrame, scopes: DataFrame) -> DataFrame:
    """(pos_id, scope_id, kind): the innermost scope around a position."""
    size = F.struct((F.col("end_line") - F.col("start_line")).alias("l"), (F.col("end_col") - F.col("start_col")).alias("c"), (-F.col("scope_id")).alias("s"))
    hit = positions.select("pos_id", "file_path", "line", "col").join(scopes, "file_path").where(_inside(F.col("line"), F.col("col")))
    return hit.groupBy("pos_id").agg(F.min_by(F.struct("scope_id", "kind"), size).alias("s")).select("pos_id", "s.*")


def scope_chains(scopes: DataFrame) -> DataFrame:
    """(file_path, scope_id, ancestor_id, depth): every scope with its ancestors, itself at 0.

    Parents come before children in a file, so the chain is folded within one
    row per file instead of level by level.
    """
    per = scopes.groupBy("file_path").agg(F.map_from_entries(F.collect_list(F.struct("scope_id", "parent_id"))).alias("up"), F.collect_list("scope_id").alias("ids"))
    one = per.select("file_path", "up", F.explode("ids").alias("scope_id"))
    chain = F.aggregate(
        F.sequence(F.lit(1), F.size("up")),  # no chain is longer
        F.array(F.col("scope_id")),
        lambda acc, _: F.when(F.try_element_at(F.col("up"), F.element_at(acc, -1)).isNull(), acc).otherwise(F.concat(acc, F.array(F.try_element_at(F.col("up"), F.element_at(acc, -1))))),
    )
    return one.select("file_path", "scope_id", F.posexplode(chain).alias("depth", "ancestor_id"))


def resolve_names(references: DataFrame, symbols: DataFrame, scopes: DataFrame) -> DataFrame:
    """(file_path, start_line, start_col, name, qualified_name): the nearest scope outwards that
    defines the first part of the name; class scopes are skipped from inside functions."""
    first = F.split("name", r"\.")[0]
    r = references.select("file_path", "start_line", "start_col", "name", "scope_id", first.alias("head"))
    chain = scope_chains(scopes).join(scopes.select("file_path", F.col("scope_id").alias("ancestor_id"), F.col("kind").alias("scope_kind")), ["file_path", "ancestor_id"])
    chain = chain.where((F.col("scope_kind") != "class") | (F.col("depth") == 0))
    s = last_definitions(symbols).select("file_path", F.col("scope_id").alias("ancestor_id"), F.col("name").alias("head"), "qualified_name")
    hit = r.join(chain, ["file_path", "scope_id"]).join(s, ["file_path", "ancestor_id", "head"])
    return hit.groupBy("file_path", "start_line", "start_col", "name").agg(F.min_by("qualified_name", "depth").alias("qualified_name"))


def module_exports(symbols: DataFrame) -> DataFrame:
    """(module, name, qualified_name, file_path): what a module offers."""
    s = last_definitions(symbols).where("is_exported and is_public and scope_id = 0")
    return s.select(module_of(F.col("file_path")).alias("module"), "name", "qualified_name", "file_path")


def definitions(references: DataFrame, symbols: DataFrame, scopes: DataFrame) -> DataFrame:
    """Where the name of each reference is defined: in its file, else through the import in the module it
    comes from (status resolved / external / unresolved)."""
    local = resolve_names(references, symbols, scopes)
    s = last_definitions(symbols).select("file_path", "qualified_name", "kind", F.col("start_line").alias("def_line"), "imported_from", "import_name")
    here = local.join(s, ["file_path", "qualified_name"], "left")
    ex = module_exports(symbols).select(F.col("module").alias("imported_from"), F.col("name").alias("import_name"), F.col("file_path").alias("def_file"), F.col("qualified_name").alias("target"))
    ex = ex.groupBy("imported_from", "import_name").agg(F.min(F.struct("def_file", "target")).alias("t")).select("imported_from", "import_name", "t.*")
    out = here.join(ex, ["imported_from", "import_name"], "left")
    status = F.when(F.col("kind") != "import", "resolved").when(F.col("target").isNotNull(), "resolved").when(F.col("kind") == "import", "external").otherwise("unresolved")
    return out.select("file_path", "start_line", "start_col", "name", F.coalesce("target", "qualified_name").alias("qualified_name"), F.coalesce("def_file", "file_path").alias("def_file"), "def_line", status.alias("status"))


def reference_rows(symbols: DataFrame, references: DataFrame, declarations: bool = True) -> DataFrame:
    """(qualified_name, position, file_path, start_line, start_col, use): every use of every symbol, in the order of
    places with the declaration (a write) before the uses of its line. A call counts as a call even if it writes.

    By qualified name, or by simple name in its file while unresolved: two equi-joins instead of one with OR.
    """
    s = last_definitions(symbols)
    use = F.when(F.col("is_call"), "call").when(F.col("is_write"), "write").otherwise("read")
    place = ["file_path", "start_line", "start_col"]
    r = references.select(*place, "name", "resolved", use.alias("use"))
    names = s.select("qualified_name").distinct()
    known = r.where("resolved is not null").join(names, F.col("resolved") == F.col("qualified_name")).select("qualified_name", *place, "use", F.lit(1).alias("late"))
    loose = r.where("resolved is null").join(s.select("file_path", "name", "qualified_name"), ["file_path", "name"]).select("qualified_name", *place, "use", F.lit(1).alias("late"))
    rows = known.unionByName(loose)
    if declarations:
        rows = rows.unionByName(s.select("qualified_name", *place, F.lit("write").alias("use"), F.lit(0).alias("late")))
    w = Window.partitionBy("qualified_name").orderBy("file_path", "start_line", "late", "start_col", "use")
    return rows.withColumn("position", F.row_number().over(w)).drop("late")


def references_at(positions: DataFrame, symbols: DataFrame, references: DataFrame) -> DataFrame:
    """(pos_id, position, file_path, start_line, start_col, use): the uses of what stands at each position."""
    at = entity_at(positions, symbols, references).where("qualified_name is not null").select("pos_id", "qualified_name")
    return at.join(reference_rows(symbols, references), "qualified_name").select("pos_id", "position", "file_path", "start_line", "start_col", "use")


def references_to(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """(file_path, qualified_name, reads, writes, calls) of every symbol that is used."""
    n = reference_rows(symbols, references, declarations=False).groupBy("qualified_name")
    n = n.agg(*[F.count_if(F.col("use") == u).alias(f"{u}s") for u in ("read", "write", "call")])
    home = last_definitions(symbols).groupBy("qualified_name").agg(F.min("file_path").alias("file_path"))
    return n.join(home, "qualified_name").select("file_path", "qualified_name", "reads", "writes", "calls")


def remove_files(parsed: DataFrame, gone: DataFrame) -> DataFrame:
    """The facts without those of the files (file_path) in ``gone``."""
    return parsed.join(gone.select("file_path"), "file_path", "left_anti")


def completeness(files: DataFrame, least: float = 0.9) -> DataFrame:
    """Add ``error_ratio``, ``has_errors`` and ``is_complete`` to the rows of ``files``."""
    ratio = F.coalesce(F.try_divide(F.col("error_lines"), F.col("lines")), F.lit(0.0))
    return files.withColumns({"error_ratio": F.round(ratio, 6), "has_errors": F.col("error_lines") > 0, "is_complete": ratio <= 1 - least})


def imports_by_module(symbols: DataFrame) -> DataFrame:
    """(file_path, imported_from, names): the names each file takes from each module, sorted."""
    s = symbols.where("kind = 'import' and imported_from is not null")
    return s.groupBy("file_path", "imported_from").agg(F.array_sort(F.collect_set(F.coalesce("import_name", "name"))).alias("names"))


def unused(symbols: DataFrame, references: DataFrame) -> DataFrame:
    s = last_definitions(symbols).where("kind not in ('import', 'parameter')").select("file_path", "qualified_name", "name", "kind")
    return s.join(references.where("resolved is not null").select(F.col("resolved").alias("qualified_name")), "qualified_name", "left_anti")


def call_edges(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.col("caller").alias("src"), F.col("callee").alias("dst")).agg(F.count("*").alias("sites"))


def import_edges(symbols: DataFrame) -> DataFrame:
    """(src, dst) between modules; relative names are made absolute."""
    from codestrata.functions.paths import relative_import

    module = module_of(F.col("file_path"))
    package = F.col("file_path").endswith("__init__.py")
    s = symbols.where("kind = 'import' and imported_from is not null")
    return s.select(module.alias("src"), relative_import(F.col("imported_from"), module, package).alias("dst")).distinct()


def index_stats(parsed: DataFrame) -> DataFrame:
    c = lambda w: F.count_if(F.col("what") == w).alias(w)
    return parsed.agg(F.countDistinct("file_path").alias("files"), *[c(w) for w in SCHEMAS if w != "files"])


def infer_types(symbols: DataFrame) -> DataFrame:
    """(file_path, qualified_name, type, source): annotation or literal, else the declared return type of the
    called function of the file, else one hop over ``x = y``."""
    s = last_definitions(symbols).select("file_path", "qualified_name", "name", "kind", "type_string", "value_call", "seq")
    f = s.where("kind in ('function', 'method') and type_string is not null").groupBy("file_path", "name").agg(F.max_by("type_string", "seq").alias("returned")).withColumnRenamed("name", "value_call")
    typed = s.where("kind in ('variable', 'parameter')").join(f, ["file_path", "value_call"], "left")
    typed = typed.withColumn("type", F.coalesce("type_string", "returned"))
    src = typed.where("type is not null").groupBy("file_path", "name").agg(F.max_by("type", "seq").alias("hop")).withColumnRenamed("name", "value_call")
    typed = typed.join(src, ["file_path", "value_call"], "left")
    source = F.when(F.col("type_string").isNotNull(), "declared").when(F.col("returned").isNotNull(), "call").when(F.col("hop").isNotNull(), "propagated")
    return typed.select("file_path", "qualified_name", F.coalesce("type", "hop").alias("type"), source.alias("source")).where("type is not null")


def changed_files(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files whose content hash the index (file_path, hash) does not hold: only these are parsed again."""
    h = files.select("file_path", "code", content_hash(F.col("code")).alias("hash"))
    return h.join(indexed.select("file_path", "hash"), ["file_path", "hash"], "left_anti")


def affected_files(changed: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """Direct importers of changed files."""
    m = files.select("file_path", module_of(F.col("file_path")).alias("module"))
    c = changed.select(module_of(F.col("file_path")).alias("dst"))
    hit = imports.join(c, "dst", "left_semi").select(F.col("src").alias("module")).distinct()
    return m.join(hit, "module", "left_semi").select("file_path")
