"""From what a parser saw in a file to symbols, containment and references, all as columns.

A parser returns declarations as spans, with names, the names around them, modifiers and comments as they are written, and uses with the text that names
something. Identity, kinds, visibility, flags, cleaned signatures and comments, heads of type names, deny lists, and what a base type is, are rules about
columns, the same for every file of every language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import content_hash, dotted_tail, make_id
from codeloom.schema import edge_order, node_order

#: A declaration: its words are modifiers and the like, mark is what imports are called by instead of scope and name.
SPAN = "kind:string,name:string,scope:array<string>,mark:string,first:int,last:int,text:string,head:string,doc:string,decorators:array<string>,words:array<string>"
#: A use of a name: owner is the place of a declaration among the spans.
USE = "owner:int,name:string,use:string,line:int,col:int,module:string"
SCHEMA = f"path string, language string, spans array<struct<{SPAN}>>, uses array<struct<{USE}>>, error string"

# Names of types and functions that are not worth a reference, by language.
PYTHON_PRIMITIVES = (
    "int", "float", "str", "bool", "bytes", "None", "list", "dict", "tuple", "set", "frozenset", "Any", "Optional", "Union", "List", "Dict", "Tuple", "Set",
    "Callable", "Iterator", "Generator", "Coroutine", "type", "object",
)
PYTHON_BUILTINS = (
    "print", "len", "range", "enumerate", "zip", "map", "filter", "sorted", "reversed", "isinstance", "issubclass", "hasattr", "getattr", "setattr", "delattr", "super", "property",
    "staticmethod", "classmethod", "abstractmethod", "int", "float", "str", "bool", "list", "dict", "tuple", "set", "type", "object", "repr", "id", "hash", "input", "open",
)
TS_PRIMITIVES = ("string", "number", "boolean", "void", "null", "undefined", "any", "never", "unknown", "object", "symbol", "bigint", "String", "Number", "Boolean")
TS_BUILTINS = (
    "console.log", "console.error", "console.warn", "console.info", "console.debug", "console.trace", "parseInt", "parseFloat", "isNaN", "isFinite", "setTimeout", "setInterval", "clearTimeout", "clearInterval",
    "JSON.parse", "JSON.stringify", "Object.keys", "Object.values", "Object.entries", "Object.assign", "Array.isArray", "Array.from", "Promise.resolve", "Promise.reject", "Promise.all", "Promise.allSettled", "require",
)
CS_PRIMITIVES = (
    "void", "int", "long", "short", "byte", "float", "double", "decimal", "bool", "char", "string", "object", "dynamic", "var",
    "String", "Int32", "Int64", "Boolean", "Double", "Single", "Decimal", "Object", "Byte", "Char",
)

TS_LANGUAGES = ("typescript", "tsx", "javascript", "jsx")


def is_python() -> Column:
    return F.col("language") == "python"


def is_csharp() -> Column:
    return F.col("language") == "csharp"


def is_ts() -> Column:
    return F.col("language").isin(*TS_LANGUAGES)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def scope_name(s: Column) -> Column:
    """The qualified name of what holds a span."""
    return F.array_join(F.concat(F.array(F.col("path")), s["scope"]), ".")


def qualified_name(s: Column) -> Column:
    own = F.array_join(F.concat(F.array(F.col("path")), s["scope"], F.array(s["name"])), ".")
    return F.when(s["kind"] == "file", F.col("path")).when(s["mark"].isNotNull(), F.concat(F.col("path"), F.lit("::"), s["mark"])).otherwise(own)


def has(s: Column, word: str) -> Column:
    return F.coalesce(F.array_contains(s["words"], word), F.lit(False))


def kind(s: Column) -> Column:
    """Assignments become constants by their keyword, or in Python by capitals."""
    capitals = (s["name"] == F.upper(s["name"])) & (s["name"] != F.lower(s["name"])) & (F.length(s["name"]) > 1)
    constant = (s["kind"] == "const") | ((s["kind"] == "assignment") & capitals)
    return F.when(constant, "constant").when(s["kind"].isin("let", "var", "assignment"), "variable").otherwise(s["kind"])


def hidden(s: Column) -> Column:
    """Assignments to names with one underscore before them."""
    return (s["kind"] == "assignment") & F.startswith(s["name"], F.lit("_")) & ~F.startswith(s["name"], F.lit("__"))


def visibility(s: Column) -> Column:
    first = lambda words: F.coalesce(*(F.when(has(s, w), w) for w in words))
    return F.when(is_csharp(), first(("public", "private", "protected", "internal"))).otherwise(first(("private", "protected", "public")))


def is_abstract(s: Column) -> Column:
    marked = F.coalesce(F.exists(s["decorators"], lambda d: F.endswith(d, F.lit("abstractmethod"))), F.lit(False))
    return has(s, "abstract") | (is_python() & s["kind"].isin("function", "method") & marked)


def signature(s: Column) -> Column:
    """A declaration's head in one line; what a parser has written itself, and imports, as they are."""
    return F.when(is_python() | s["mark"].isNotNull(), s["head"]).otherwise(stripped(F.regexp_replace(s["head"], r"\s+", " ")))


def docstring(s: Column) -> Column:
    """A comment without its marks and tags, in one line; Python's strings are no comments."""
    joined = lambda lines: F.nullif(F.array_join(F.filter(lines, lambda x: x != ""), " "), F.lit(""))
    block = F.split(F.substr(s["doc"], F.lit(4), F.length(s["doc"]) - 5), "\n")
    block = F.transform(block, lambda x: stripped(F.regexp_replace(stripped(x), r"^\*+", "")))
    lines = F.transform(F.split(s["doc"], "\n"), lambda x: stripped(F.regexp_replace(F.regexp_replace(x, r"^\s*///?\s?", ""), "</?[a-z]+[^>]*>", "")))
    return F.when(is_python(), s["doc"]).when(F.startswith(s["doc"], F.lit("/**")), joined(block)).otherwise(joined(lines))


def spans_of(found: DataFrame) -> DataFrame:
    rows = found.select("path", "language", F.posexplode("spans").alias("k", "s"))
    return rows.where(~hidden(F.col("s")))


def symbol_rows(found: DataFrame) -> DataFrame:
    """The nodes of parsed files (SCHEMA)."""
    s = F.col("s")
    named = spans_of(found).withColumn("qualified_name", qualified_name(s))
    return named.select(
        make_id("path", "qualified_name").alias("id"),
        kind(s).alias("kind"),
        s["name"].alias("name"),
        "qualified_name",
        F.col("path").alias("file_path"),
        "language",
        s["first"].alias("start_line"),
        s["last"].alias("end_line"),
        signature(s).alias("signature"),
        docstring(s).alias("docstring"),
        visibility(s).alias("visibility"),
        F.when(is_csharp(), has(s, "public")).otherwise(has(s, "export")).alias("is_exported"),
        has(s, "async").alias("is_async"),
        (has(s, "static") | (is_python() & F.coalesce(F.array_contains(s["decorators"], "staticmethod"), F.lit(False)))).alias("is_static"),
        is_abstract(s).alias("is_abstract"),
        s["decorators"].alias("decorators"),
        content_hash(s["text"]).alias("content_hash"),
        node_order("path", F.col("k")).alias("ord"),
    )


def contains_rows(found: DataFrame) -> DataFrame:
    """An edge from what holds a declaration to it."""
    rows = spans_of(found).where("s.kind <> 'file'").withColumn("above", scope_name(F.col("s"))).withColumn("own", qualified_name(F.col("s")))
    return rows.select(make_id("path", "above").alias("source"), make_id("path", "own").alias("target"), F.lit("contains").alias("kind"), edge_order("path", F.col("k") - 1).alias("ord"))


def used_name(u: Column) -> Column:
    """What a use names: of types the head, without arguments; of calls the path of names."""
    head = F.regexp_extract(F.regexp_replace(u["name"], r"^\s*type\s+", ""), r"^\s*([A-Za-z_$][\w$.]*)", 1)
    return F.when(is_python(), u["name"]).when(u["use"] == "calls", F.replace(u["name"], F.lit("?."), F.lit("."))).otherwise(head)


def use_kind(use: Column, name: Column) -> Column:
    """A C# base type is an interface if its name begins with I and a capital."""
    tail = dotted_tail(name)
    like_interface = F.startswith(tail, F.lit("I")) & (F.length(tail) > 1) & (F.substring(tail, 2, 1) == F.upper(F.substring(tail, 2, 1)))
    return F.when(use != "base", use).when(like_interface, "implements").otherwise("extends")


def worth_a_reference(name: Column, use: Column) -> Column:
    typed = use.isin("returns", "type_of")
    builtin = (is_python() & (use == "calls") & name.isin(*PYTHON_BUILTINS)) | (is_ts() & (use == "calls") & name.isin(*TS_BUILTINS))
    primitive = (is_python() & (typed | (use == "extends")) & name.isin(*PYTHON_PRIMITIVES)) | (is_ts() & typed & name.isin(*TS_PRIMITIVES)) | (is_csharp() & typed & name.isin(*CS_PRIMITIVES))
    above = ~is_python() & (use == "calls") & (F.substring_index(name, ".", 1) == "super")
    return (name != "") & ~builtin & ~primitive & ~above


def reference_rows(found: DataFrame) -> DataFrame:
    """References of parsed files, of the declaration in which each use stands."""
    owned = F.transform("uses", lambda u: F.struct(u.alias("u"), F.get(F.col("spans"), u["owner"]).alias("s")))
    rows = found.select("path", "language", F.explode(owned).alias("x")).select("path", "language", "x.*")
    u = F.col("u")
    rows = rows.withColumn("name", used_name(u)).where(worth_a_reference(F.col("name"), u["use"])).withColumn("from", qualified_name(F.col("s")))
    return rows.select(
        make_id("path", "from").alias("from_id"),
        F.col("name").alias("reference_name"),
        use_kind(u["use"], F.col("name")).alias("reference_kind"),
        F.col("path").alias("file_path"),
        "language",
        u["line"].alias("line"),
        u["col"].alias("col"),
        F.when(u["module"].isNotNull(), F.array(u["module"])).alias("candidates"),
    )
