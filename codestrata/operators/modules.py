"""What modules export and where imported names come from, through stars and re-exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.paths import relative_import
from codestrata.operators.index import last_definitions, module_of
from codestrata.session import cut


def imports(symbols: DataFrame) -> DataFrame:
    """(module, name, source, original): the names each module imports; ``*`` for a star, null original for a whole module."""
    s = symbols.where("kind = 'import' and scope_id = 0 and imported_from is not null")
    module = module_of(F.col("file_path"))
    source = relative_import(F.col("imported_from"), module, F.col("file_path").endswith("__init__.py"), strict=True)
    return s.select(module.alias("module"), "name", source.alias("source"), F.col("import_name").alias("original")).distinct()


def defined(symbols: DataFrame) -> DataFrame:
    """(module, name, is_public): names a module defines itself at its top level."""
    s = last_definitions(symbols).where("scope_id = 0 and kind <> 'import'")
    return s.select(module_of(F.col("file_path")).alias("module"), "name", "is_public").distinct()


def star_names(symbols: DataFrame, all_names: DataFrame) -> DataFrame:
    """(module, name, source): names that come in by stars, through chains of stars."""
    own = exported_names(symbols, all_names)
    stars = imports(symbols).where("original = '*' and source is not null").select("module", "source")
    new = cut(stars.join(own.select(F.col("module").alias("source"), "name"), "source").select("module", "name", "source").distinct())
    found = new
    while True:
        step = new.select(F.col("module").alias("source"), "name")
        new = cut(stars.join(step, "source").select("module", "name", "source").distinct().join(found.select("module", "name"), ["module", "name"], "left_anti"))
        if new.isEmpty():
            break
        found = cut(found.unionByName(new))
    return found


def exported_names(symbols: DataFrame, all_names: DataFrame) -> DataFrame:
    """(module, name): what ``__all__`` lists, else public definitions and public re-exports."""
    listed = all_names.select(module_of(F.col("file_path")).alias("module"), "name").distinct()
    public = defined(symbols).where("is_public").select("module", "name")
    again = imports(symbols).where(~F.col("name").startswith("_") & F.col("original").isNotNull() & (F.col("original") != "*")).select("module", "name")
    rest = public.unionByName(again).distinct().join(listed.select("module").distinct(), "module", "left_anti")
    return listed.unionByName(rest)


def resolve(symbols: DataFrame, all_names: DataFrame) -> DataFrame:
    """(module, name, origin, target, status): where each imported name is defined.

    Each step follows one re-export or star. A name that comes back to a module it
    passed (a cycle) or ends in a module without it is unresolved; a source that is
    no module here is external.
    """
    links = imports(symbols).where("original <> '*'").select("module", "name", F.coalesce("source", F.lit("")).alias("source"), "original")
    stars = star_names(symbols, all_names).select(F.col("module").alias("source"), F.col("name").alias("original"), F.col("source").alias("s2"))
    hops = links.select(F.col("module").alias("source"), F.col("name").alias("original"), F.col("source").alias("s2"), F.col("original").alias("o2"))
    hops = cut(hops.unionByName(stars.select("source", "original", "s2", F.col("original").alias("o2"))))
    known = cut(defined(symbols).select(F.col("module").alias("source"), F.col("name").alias("original")).distinct())
    here = symbols.select(module_of(F.col("file_path")).alias("source")).distinct()
    new = cut(links.withColumn("seen", F.array("module")))
    done = None
    while True:
        ok = new.join(known.withColumn("__k", F.lit(1)), ["source", "original"], "left")
        inside = ok.join(here.withColumn("__h", F.lit(1)), "source", "left")
        inside = cut(inside.withColumn("status", F.when(F.col("__k") == 1, "resolved").when(F.col("__h").isNull(), "external").when(F.array_contains("seen", F.col("source")), "unresolved")))
        out = inside.where("status is not null").select("module", "name", "source", "original", "status")
        done = out if done is None else done.unionByName(out)
        step = inside.where("status is null").select("module", "name", "source", "original", F.concat("seen", F.array("source")).alias("seen")).join(hops, ["source", "original"], "left")
        step = cut(step)
        lost = step.where("s2 is null").select("module", "name", "source", "original", F.lit("unresolved").alias("status"))
        done = done.unionByName(lost)
        new = step.where("s2 is not null").groupBy("module", "name").agg(F.min(F.struct(F.col("s2").alias("source"), F.col("o2").alias("original"), "seen")).alias("x")).select("module", "name", "x.*")
        new = cut(new)
        if new.isEmpty():
            break
    best = F.min_by(F.struct("source", "original", "status"), F.struct(F.when(F.col("status") == "resolved", 0).when(F.col("status") == "external", 1).otherwise(2), "source", "original"))
    return done.groupBy("module", "name").agg(best.alias("x")).select("module", "name", F.col("x.source").alias("origin"), F.col("x.original").alias("target"), F.col("x.status").alias("status"))


def is_external(module: str, roots: list[str]):  # noqa: ANN201
    """Does a dotted name lie in one of the known external packages?"""
    return F.split(F.lit(module), r"\.")[0].isin(roots)
