"""Linking references to symbols by import paths and by names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import dirname, dotted_tail, fold_path
from codeloom.schema import edge_order

# Names that are never linked, and what is tried after a module path, in this order.
SKIP_NAMES = (
    "this", "self", "super", "cls", "true", "false", "null", "undefined", "None", "console", "window", "document", "global", "process",
    "Error", "Promise", "Array", "Map", "Set", "WeakMap", "WeakSet", "RegExp", "Date", "Math", "JSON", "Symbol", "Proxy", "Reflect",
)
PROBE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py", ".cs", "")
PROBE_SUFFIXES = ("", "/index")


def symbol_index(nodes: DataFrame) -> dict[str, DataFrame]:
    """The keys by which references find symbols: by name, by file, by a file's exports, and one node for each id and qualified name (the last)."""
    last = lambda key: nodes.groupBy(key).agg(F.max_by(F.struct(*(c for c in nodes.columns if c != key)), "ord").alias("n")).select(key, "n.*")
    some = nodes.select("name", "file_path", "id", "kind", "is_exported", "ord")
    return {"name": some, "file_path": some, "exports": some.where("is_exported"), "id": last("id"), "qualified_name": last("qualified_name")}


def probed_paths(modules: DataFrame) -> DataFrame:
    """(module, file_path, k, path): what is tried for relative module paths of files, in order."""
    probes = F.array(*(F.lit(s + e) for s in PROBE_SUFFIXES for e in PROBE_EXTENSIONS))
    base = modules.where(F.startswith("module", F.lit("."))).withColumn("base", fold_path(F.concat_ws("/", dirname("file_path"), "module")))
    return base.select("module", "file_path", "base", F.posexplode(probes).alias("k", "end")).select("module", "file_path", "k", F.concat("base", "end").alias("path"))


def module_files(modules: DataFrame, files: DataFrame) -> DataFrame:
    """(module, file_path, resolved): the file that a relative module path means, seen from a file.

    modules: distinct (module, file_path). All probes of a path are joined with the files at once, and the first one that
    exists wins.
    """
    return probed_paths(modules).join(files.select("path"), "path").groupBy("module", "file_path").agg(F.min_by("path", "k").alias("resolved"))


def resolve_imports(refs: DataFrame, nodes: DataFrame, files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Edges of import references: one for each candidate module that exports the name. keep: further columns of refs that edges get."""
    asked = refs.where("reference_kind = 'imports'").select(*keep, "from_id", "reference_name", "file_path", "line", "col", F.explode("candidates").alias("module"))
    found = module_files(asked.select("module", "file_path").distinct(), files)
    exports = nodes.where("is_exported").groupBy(F.col("file_path").alias("resolved"), F.col("name").alias("reference_name")).agg(F.min_by("id", "ord").alias("target"))
    linked = asked.join(found, ["module", "file_path"]).join(exports, ["resolved", "reference_name"])
    return linked.select(*keep, F.col("from_id").alias("source"), "target", F.lit("imports").alias("kind"), "line", "col", F.lit("import-resolution").alias("provenance"), edge_order("file_path", F.col("line"), F.col("col"), 1).alias("ord"))


def resolve_by_name(refs: DataFrame, nodes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Edges of other references: the best symbol of that name in another file, else in the same file.

    Exported symbols come first, then node order. A name may have any number of symbols and of references, so they are not
    joined with each other: for each name it is enough to know the two best symbols and the best one outside
    the file of the best. These come by aggregation, and each reference meets one row.
    """
    rank = F.struct((~F.col("is_exported")).alias("late"), F.col("ord"))
    some = nodes.where("kind not in ('file', 'import')").select("name", "id", "file_path", rank.alias("rank"))
    in_file = some.groupBy("name", "file_path").agg(F.min(F.struct("rank", "id")).alias("a"), F.count("*").alias("n"))
    second = some.join(in_file.select("name", "file_path", F.col("a.id").alias("best_id")), ["name", "file_path"]).where("id <> best_id").groupBy("name", "file_path").agg(F.min(F.struct("rank", "id")).alias("b"))
    in_file = in_file.join(second, ["name", "file_path"], "left").select("name", F.struct("a.rank", F.col("a.id").alias("id"), "file_path", F.col("b.id").alias("next")).alias("f"))
    top = in_file.groupBy("name").agg(F.min("f").alias("first"))
    other = in_file.join(top, "name").where("f.file_path <> first.file_path").groupBy("name").agg(F.min("f").alias("other"))
    best = top.join(other, "name", "left").select(F.col("name").alias("tail"), "first", "other")
    asked = refs.where("reference_kind <> 'imports'").withColumn("tail", dotted_tail("reference_name")).where(~F.col("tail").isin(*SKIP_NAMES))
    met = asked.join(best, "tail")
    outside = F.when(F.col("first.file_path") != F.col("file_path"), F.col("first.id")).otherwise(F.col("other.id"))
    inside = F.when(F.col("first.id") != F.col("from_id"), F.col("first.id")).otherwise(F.col("first.next"))
    out = met.withColumn("outside", outside).withColumn("target", F.coalesce("outside", inside)).where("target is not null")
    provenance = F.when(F.col("outside").isNotNull(), "scope-resolution").otherwise("heuristic")
    return out.select(*keep, F.col("from_id").alias("source"), "target", F.col("reference_kind").alias("kind"), "line", "col", provenance.alias("provenance"), edge_order("file_path", F.col("line"), F.col("col"), 2).alias("ord"))


def resolve_references(refs: DataFrame, nodes: DataFrame, files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Edges of all references, imports before names, with an order (``ord``) after all edges that files hold."""
    return resolve_imports(refs, nodes, files, keep).unionByName(resolve_by_name(refs, nodes, keep))


def unresolved(refs: DataFrame, edges: DataFrame) -> DataFrame:
    """References whose symbol has no resolved edge of that kind at all."""
    done = edges.select(F.col("source").alias("from_id"), F.col("kind").alias("reference_kind")).distinct()
    return refs.join(done, ["from_id", "reference_kind"], "left_anti")


@dataclass(frozen=True)
class Links:
    """Resolved references that can follow changes of files.

    refs: distinct references with a ``ref_id``; keys (ref_id, key): what each one's target depends on, names and probed paths; edges: with the ref_id of the
    reference that each comes from.
    """

    refs: DataFrame
    keys: DataFrame
    edges: DataFrame


def identified(refs: DataFrame) -> DataFrame:
    """Distinct references with an id of all that they say."""
    said = F.concat_ws("\0", "file_path", "from_id", "reference_kind", "reference_name", F.coalesce(F.col("line").cast("string"), F.lit("")), F.coalesce(F.col("col").cast("string"), F.lit("")), F.concat_ws("\1", "candidates"))
    columns = ["from_id", "reference_name", "reference_kind", "file_path", "line", "col", "candidates"]
    return refs.select(F.substring(F.sha2(said, 256), 1, 32).alias("ref_id"), *columns).dropDuplicates(["ref_id"])


def reference_keys(refs: DataFrame) -> DataFrame:
    """(ref_id, key): the name that a reference is looked up by, or all paths that its modules may mean."""
    names = refs.where("reference_kind <> 'imports'").withColumn("tail", dotted_tail("reference_name")).where(~F.col("tail").isin(*SKIP_NAMES))
    asked = refs.where("reference_kind = 'imports'").select("ref_id", "file_path", F.explode("candidates").alias("module"))
    tried = probed_paths(asked.select("module", "file_path").distinct()).select("module", "file_path", "path")
    paths = asked.join(tried, ["module", "file_path"]).select("ref_id", F.concat(F.lit("path "), "path").alias("key"))
    return names.select("ref_id", F.concat(F.lit("name "), "tail").alias("key")).unionByName(paths).distinct()


def link(refs: DataFrame, nodes: DataFrame, files: DataFrame) -> Links:
    """All references resolved, with what is needed to follow changes."""
    refs = identified(refs)
    return Links(refs, reference_keys(refs), resolve_references(refs, nodes, files, ["ref_id"]))


def affected(links: Links, paths: DataFrame, old_nodes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """(ref_id) of references in other files whose target may differ after a change of files (column path).

    A name's symbols change only if the file had, or has, one of that name; a module's file changes only if the path is among those that are tried.
    """
    touched = paths.select(F.col("path").alias("file_path"))
    names = [n.where("kind not in ('file', 'import')").join(touched, "file_path", "left_semi").select(F.concat(F.lit("name "), "name").alias("key")) for n in (old_nodes, new_nodes)]
    keys = names[0].unionByName(names[1]).unionByName(paths.select(F.concat(F.lit("path "), "path").alias("key"))).distinct()
    return links.keys.join(keys, "key", "left_semi").select("ref_id").distinct()


def relink(links: Links, paths: DataFrame, old_nodes: DataFrame, nodes: DataFrame, files: DataFrame, new_refs: DataFrame) -> tuple[Links, DataFrame]:
    """The links after files (column path) were added, replaced or removed, and the references that were looked at again.

    old_nodes: all nodes before, nodes and files: all after the change, new_refs: what the new versions refer to. Only references of the changed files, and those that
    ``affected`` names, are resolved, against symbols of the names that they ask for; everything else stays as it is.
    """
    touched = paths.select(F.col("path").alias("file_path")).distinct()
    kept = links.refs.join(touched, "file_path", "left_anti")
    again = kept.join(affected(links, paths, old_nodes, nodes), "ref_id", "left_semi")
    new = identified(new_refs)
    todo = again.select(*new.columns).unionByName(new)
    asked = todo.select(dotted_tail("reference_name").alias("name")).unionByName(todo.select(F.col("reference_name").alias("name"))).distinct()
    found = resolve_references(todo, nodes.join(asked, "name", "left_semi"), files, ["ref_id"])
    stays = kept.select("ref_id").join(todo.select("ref_id"), "ref_id", "left_anti")
    edges = links.edges.join(stays, "ref_id", "left_semi").unionByName(found)
    keys = links.keys.join(kept.select("ref_id"), "ref_id", "left_semi").unionByName(reference_keys(new))
    return Links(kept.select(*new.columns).unionByName(new), keys, edges), todo
