"""Source files to nodes, calls, imports, properties and assertions (DataFrame functions only).

A file is cut into logical lines, in which comments and the insides of strings are told from code (``lexing``). Patterns of
its language find the heads of definitions there, in code alone. A definition ends with its block: at the matching brace, or
where the indentation does in languages without braces. Files of any size are parsed; only :func:`scan` of a folder leaves
out those over :data:`MOST_BYTES`.

Null texts are empty, empty files have no definitions, and unclosed blocks end with their file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import is_test_path, last_component
from ..sources.shared import stored
from . import lexing

#: Files of a scanned folder over this size are left out.
MOST_BYTES = 500_000
#: Languages by extension, folders that hold no sources of a project, marks of generated files.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java",
    "rs": "rust", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp",
    "scala": "scala", "kt": "kotlin", "swift": "swift", "lua": "lua", "ex": "elixir", "exs": "elixir", "ml": "ocaml",
}
SKIPPED = r"(^|/)(\.[^/]*|node_modules|vendor|dist|build|target|__pycache__|venv|site-packages)/"
GENERATED = r"(?i)code generated|do not edit|@generated|auto-?generated"
#: Patterns of a function's and a class's head: the name is group 1, parameters are group 2, the type returned is group 3.
NESTED = r"[^()]*+(?:\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)[^()]*+)*+"
PARAMETERS = f"({NESTED})"
TYPED = r"(?:[A-Za-z_][\w.:]*(?:<[^;={}()]*>)?(?:\[\])*[\s*&]+)+?"
FUNCTIONS = {
    "python": rf"^\s*(?:async\s+)?def\s+(\w+)\s*(?:\[[^\]]*\])?\({PARAMETERS}\)\s*(?:->\s*(.+?))?\s*:",
    "javascript": rf"^\s*(?:export\s+)?(?:default\s+)?(?:static\s+)?(?:async\s+)?(?:function\s*\*?\s*(?=\w)|(?:get|set)\s+(?=\w)|(?=\w+\s*\({NESTED}\)\s*\{{)(?!(?:if|for|while|switch|catch|with)\b))\*?(\w+)\s*\({PARAMETERS}\)()",
    "typescript": rf"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:(?:public|private|protected|static|readonly|override|abstract)\s+)*(?:async\s+)?(?:function\s*\*?\s*(?=\w)|(?:get|set)\s+(?=\w)|(?=\w+\s*(?:<[^>(]*>)?\({NESTED}\)[^;=]*\{{)(?!(?:if|for|while|switch|catch|with)\b))\*?(\w+)\s*(?:<[^>(]*>)?\({PARAMETERS}\)(?:\s*:\s*([^{{]+?))?\s*\{{",
    "go": rf"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\({PARAMETERS}\)\s*([^{{]*?)\s*\{{",
    "java": rf"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|synchronized|abstract|native|default|strictfp)\s+)*(?:<[^;={{}}()]+>\s+)?(?!(?:return|new|else|throw|case|assert|package|import|class|interface|enum|record)\b)(?:[\w.]+(?:<[^;={{}}()]*>)?(?:\[\])*\s+)(?!(?:if|for|while|switch|catch|try)\b)(\w+)\s*\({PARAMETERS}\)()\s*(?:throws\s+[\w., ]+)?\s*[{{;]",
    "csharp": rf"^\s*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|async|virtual|override|abstract|sealed|partial|extern)\s+)+(?!(?:class|interface|struct|enum|record|new|return)\b)(?:[\w.]+(?:<[^;={{}}()]*>)?[\[\]?]*\s+)(\w+)\s*(?:<[^>(]*>)?\({PARAMETERS}\)()",
    "c": rf"^(?!\s*(?:return|else|typedef|struct\s+\w+\s*\{{|case|goto|#)\b){TYPED}(?!(?:if|for|while|switch|return|sizeof)\b)(\w+)\s*\({PARAMETERS}\)()\s*(?:const\s*)?(?:\{{.*)?$",
    "cpp": rf"^(?!\s*(?:return|else|typedef|case|goto|throw|new|delete|using|#)\b)\s*(?:template\s*<[^>]*>\s*)?{TYPED}(?:\w+(?:<[^>()]*>)?::)*(?!(?:if|for|while|switch|return|sizeof|catch)\b)(~?\w+)\s*\({PARAMETERS}\)()\s*(?:const\b|noexcept\b|override\b|final\b|\s)*(?:\{{.*)?$",
    "rust": rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\S+)?)\s+)*fn\s+(\w+)\s*(?:<.*?>)?\s*\({PARAMETERS}\)\s*(?:->\s*([^{{;]+?))?\s*(?:where\b[^{{;]*)?(?:[{{;].*)?$",
    "ruby": rf"^\s*def\s+(?:self\.)?(\w+[?!=]?)(?:\s*\({PARAMETERS}\))?()",
    "php": rf"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(\w+)\s*\({PARAMETERS}\)(?:\s*:\s*([\w?\\|]+))?",
    "scala": rf"^\s*(?:(?:private|protected|override|final|implicit)(?:\[\w+\])?\s+)*def\s+(\w+)\s*(?:\[[^\]]*\])?(?:\({PARAMETERS}\))?(?:\s*:\s*([\w\[\], .]+))?",
    "kotlin": rf"^\s*(?:(?:private|public|internal|protected|override|suspend|inline|open|operator)\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(\w+)\s*\({PARAMETERS}\)(?:\s*:\s*([\w<>?, .]+))?",
    "swift": rf"^\s*(?:@\w+\s+)*(?:(?:private|public|internal|open|static|override|mutating|final)\s+)*func\s+(\w+)\s*(?:<[^>(]*>)?\({PARAMETERS}\)(?:[^{{]*?->\s*([\w<>?\[\], .:]+))?",
    "lua": rf"^\s*(?:local\s+)?function\s+(?:\w+[.:])*(\w+)\s*\({PARAMETERS}\)()",
    "elixir": rf"^\s*defp?\s+(\w+[?!]?)(?:\({PARAMETERS}\))?()",
}
#: Functions without a head of their own: a name that an arrow or a function expression is bound to.
ARROWS = rf"^\s*(?:export\s+)?(?:default\s+)?(?:(?:public|private|protected|static|readonly|const|let|var)\s+)*(\w+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b\s*\w*\s*\({PARAMETERS}\)|\({PARAMETERS}\)(?:\s*:\s*[^=]+)?\s*=>|(\w+)\s*=>)"
CLASSES = {
    "python": r"^\s*class\s+(\w+)",
    "go": r"^type\s+(\w+)\s+(?:struct|interface)\b",
    "rust": r"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)",
    "ruby": r"^\s*(?:class|module)\s+(\w+)",
    "elixir": r"^\s*defmodule\s+([\w.]+)",
}
ANY_CLASS = r"^\s*(?:export\s+)?(?:default\s+)?(?:(?:public|private|protected|abstract|final|sealed|static|case|data|open)\s+)*(?:class|interface|trait|struct|object|enum)\s+(\w+)"
#: Patterns of imports: the module is group 1, the names (with commas) are group 2; each language may have several.
IMPORTS = {
    "python": [r"^\s*from\s+([\w.]+)\s+import\s+\(?([^)#;]+)"],
    "javascript": [r"^\s*(?:import|export)\s+(?:type\s+)?(?=.*\bfrom\s)(?=\{?[^}]*\}?.*from\s+['\"]([^'\"]+))\{?\s*([^}'\"]*?)\s*\}?\s+from\b", r"\brequire\(\s*['\"]([^'\"]+)['\"]()", r"^\s*import\s+['\"]([^'\"]+)['\"]()"],
    "go": [],
    "java": [r"^\s*import\s+(?:static\s+)?([\w.]+)\.(\w+|\*)\s*;"],
    "rust": [r"^\s*(?:pub\s+)?use\s+([\w:]+?)::\{?([\w, *]+)\}?\s*;", r"^\s*(?:pub\s+)?mod\s+(\w+)()\s*;"],
    "scala": [r"^\s*import\s+([\w.]+)\.\{?([\w, _]+)\}?\s*$"],
    "kotlin": [r"^\s*import\s+([\w.]+)\.(\w+|\*)\s*$"],
    "csharp": [r"^\s*using\s+(?:static\s+)?([\w.]+)()\s*;"],
    "php": [r"^\s*use\s+([\w\\]+)\\(\w+)\s*;"],
    "c": [r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]()"],
    "swift": [r"^\s*import\s+(\w+)()"],
    "ocaml": [r"^\s*open\s+([\w.]+)()"],
    "ruby": [r"^\s*require(?:_relative)?\s*\(?['\"]([^'\"]+)['\"]()"],
    "elixir": [r"^\s*(?:alias|import|use|require)\s+([\w.]+)()"],
    "lua": [r"\brequire\s*\(?\s*['\"]([^'\"]+)['\"]()"],
}
IMPORTS["typescript"], IMPORTS["cpp"] = IMPORTS["javascript"], IMPORTS["c"]
#: Words that stand before a bracket without being called.
NO_CALLS = "if for while switch catch return def function func fn fun class elif and or not in assert with except lambda print_ super_ sizeof async synchronized try using unless foreach guard match".split()
#: Facts that a line of a function tells: kind, pattern (group 1 is the value), what stands before it, confidence; some stand in strings too.
IN_STRINGS = ("config_read",)
FACTS = [
    ("exception_type", r"\b(?:raise|throw(?:\s+new)?)\s+([A-Za-z_][\w.]*)", "", 1.0),
    ("side_effect", r"^\s*(?:self|this)\.(\w+)\s*[-+*/|&]?=(?!=)", "", 1.0),
    ("field_read", r"\b(?:self|this)\.(\w+)\b(?!\s*\()(?!\s*[-+*/|&]?=(?!=))", "", 1.0),
    ("config_read", r"(?:os\.environ(?:\.get)?[\[(]|os\.[gG]etenv\(|process\.env[.\[]|System\.getenv\(|env::var\()\s*['\"]?(\w+)", "env: ", 0.9),
    ("resource_pattern", r"^\s*(?:async\s+)?with\s+(.+?)\s*:\s*$", "context_manager: ", 0.9),
    ("resource_pattern", r"^\s*defer\s+(.+?)\s*$", "defer: ", 0.9),
    ("resource_pattern", r"^\s*(?:using|try)\s*\((.+)\)\s*\{?\s*$", "using: ", 0.9),
]
#: Words for locks, for shared state, and of names that deal with security.
LOCKS = ["Lock()", "Unlock()", "RLock()", "mutex", "Mutex", "synchronized", "asyncio.Lock", "threading.Lock", "Semaphore"]
SHARED = ["atomic", "Atomic", "WaitGroup", "channel", "chan ", "select {", "go func", "goroutine", "Thread"]
SECURITY = {
    "authentication": ["auth", "login", "token", "password", "secret", "encrypt", "decrypt", "hash", "csrf"],
    "authorization": ["permission", "role", "sanitize", "validate_input"],
}
#: A comparison, and what makes it one at a boundary, the first that holds.
COMPARISON = r"([A-Za-z_][\w.]*(?:\([^()]*\)|\[[^\[\]]*\])*(?:\.\w+(?:\(\))?)*\s*(?:<=|>=|===?|!==?|<|>|\bis not\b|\bis\b)\s*-?[\w.]+(?:\[[^\[\]]*\])?)"
BOUNDARIES = [
    ("length_check", r"len\(|\.length\b|\.size\(\)|\.count\(\)|\.len\(\)"),
    ("null_check", r"\b(?:None|null|nil|nullptr)\b"),
    ("zero_check", r"(?<![\w.])-?0\b(?!\.)|(?<![\w.])-1\b"),
    ("index_boundary", r"\[(?:0|-1|1)\]"),
]
#: An item of a list of parameters: commas in strings and brackets part nothing.
ITEM = r"((?:\"[^\"]*\"|'[^']*'|\((?:[^()]|\([^()]*\))*\)|\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]|\{[^{}]*\}|<[^<>]*(?:<[^<>]*>[^<>]*)*>|[^,\"'(\[{<])+)"
#: A parameter's name, mark of an optional one, type and default where the type follows a colon; type and name where it stands first.
NAMED, TYPE_FIRST = r"^(?:\.\.\.|[*&]|(?:mut|public|private|protected|readonly|val|var|final)\s+)*([\w$]+)(\??)\s*(?::\s*([^=]+?))?\s*(?:=\s*(.+))?$", r"^(?:final\s+|@\w+\s+)*(.+?)[\s*&]+(?:\.\.\.)?\$?(\w+)(?:\[\])?\s*(?:=\s*(.+))?$"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of the globs of an ignore file; comments, blanks and negations are no globs."""
    out = F.lit(False)
    for glob in (p.strip() for p in patterns):
        if glob and glob[0] not in "#!":
            body = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in r"\.[](){}+^$|" else c) for c in glob.strip("/").replace("**", "*"))
            out = out | path.rlike(("^" if glob.startswith("/") else "(^|/)") + body + ("/" if glob.endswith("/") else "(/|$)"))
    return out


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)))


def scan(spark: SparkSession, root: str, patterns: list[str] = ()) -> DataFrame:
    """file_path, language and text of the sources under a folder: known extensions, no skipped folders, not too large, not
    generated, not ignored by ``patterns``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= MOST_BYTES)
    path = F.regexp_replace("path", r"^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    out = files.select(path.alias("file_path"), F.col("content").cast("string").alias("text"))
    return sources(out.where(~ignored(F.col("file_path"), list(patterns))))


def sources(files: DataFrame) -> DataFrame:
    """Of files (file_path, text) those to parse, of any size, with their language. Null texts are empty."""
    out = files.select("file_path", language_of(F.col("file_path")).alias("language"), F.coalesce("text", F.lit("")).alias("text"))
    kept = F.col("language").isNotNull() & ~F.col("file_path").rlike(SKIPPED)
    return out.where(kept & ~F.substring_index("text", "\n", 1).rlike(GENERATED))


def statements(files: DataFrame) -> DataFrame:
    """The logical lines of sources, see :func:`lexing.logical_lines`."""
    return lexing.logical_lines(files)


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Logical lines, nodes and bodies of sources, each stored once, as what is found in them reads them again and again."""
    rows = stored(statements(files), "parse-lines")
    nodes = stored(definitions(rows), "parse-nodes")
    return rows, nodes, stored(bodies(rows, nodes), "parse-bodies")


def lines(files: DataFrame) -> DataFrame:
    """The physical lines of sources: file_path, language, line (from 1), text, indent (-1: blank)."""
    out = files.select("file_path", "language", F.posexplode(F.split("text", "\r?\n")).alias("line", "text"))
    blank = F.trim("text") == ""
    return out.select("file_path", "language", (F.col("line") + 1).alias("line"), "text", F.when(blank, -1).otherwise(F.length(F.regexp_extract("text", r"^[ \t]*", 0))).alias("indent"))


def _of_language(values: dict[str, Column], other: Column) -> Column:
    """The value that belongs to a row's language: one lookup, however many languages there are."""
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return F.coalesce(F.try_element_at(table, F.col("language")), other)


def _by_language(patterns: dict[str, str], group: int, other: str | None = None) -> Column:
    """A group of what the language's pattern finds in ``code``; empty where it finds nothing.

    Patterns are literals, a branch a language: one that comes from a column is compiled again wherever the language changes.
    """
    found = F.lit("") if other is None else F.regexp_extract("code", other, group)
    for language, pattern in patterns.items():
        found = F.when(F.col("language") == language, F.regexp_extract("code", pattern, group)).otherwise(found)
    return found


def _ends(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """``heads`` with end_line: where their braces close, or before the next line that isn't indented deeper.

    Such a line belongs to the definition if it is a closing bracket or ``end``. Each line meets the heads' indentations of
    its file that it isn't indented deeper than, so that the next one is a window's next row.
    """
    steps = heads.groupBy("file_path").agg(F.collect_set("indent").alias("_steps"))
    code = rows.where("indent >= 0").select("file_path", "line", "last_line", "indent", F.col("code").rlike(r"^\s*[}\])]|^\s*end\b").alias("closes"))
    # the last line of code before each line, and behind all lines a row that closes everything
    code = code.withColumn("before", F.lag("last_line").over(Window.partitionBy("file_path").orderBy("line")))
    last = code.groupBy("file_path").agg((F.max("last_line") + 1).alias("line"), F.max("last_line").alias("last_line"), F.lit(-1).alias("indent"), F.lit(False).alias("closes"), F.max("last_line").alias("before"))
    closing = code.unionByName(last).join(steps, "file_path")
    closing = closing.withColumn("step", F.explode(F.filter("_steps", lambda i: i >= F.col("indent"))))
    end = F.when(F.col("closes"), F.col("last_line")).otherwise(F.col("before"))
    ahead = Window.partitionBy("file_path", "step").orderBy("line").rowsBetween(1, 1)
    found = closing.withColumn("_end", F.first(end).over(ahead)).where("indent = step").select("file_path", F.col("line").alias("start_line"), "_end")
    braced = F.col("language").isin(*lexing.BRACES)
    open_ended = F.when(braced & F.col("block_end").isNull(), F.col("last_line"))
    return heads.join(found, ["file_path", "start_line"], "left").withColumn("end_line", F.coalesce(F.when(braced, F.col("block_end")), open_ended, F.greatest("_end", "last_line"))).drop("_end")


def _covered(nodes: DataFrame, first: str) -> DataFrame:
    """The innermost of ``nodes`` over each line from ``first`` to its end: file_path, line, owner (start_line, name, id, is_class)."""
    each = nodes.where(f"{first} <= end_line").select("file_path", F.explode(F.sequence(F.expr(first).cast("int"), F.col("end_line").cast("int"))).alias("line"), F.struct("start_line", "name", "id", "is_class").alias("o"))
    return each.groupBy("file_path", "line").agg(F.max("o").alias("owner"))


def _restored(part: Column, before: str) -> Column:
    """A part of ``code``, that stands behind ``before`` there, as it is in ``text``."""
    at = F.call_function("locate", F.concat(F.lit(before), part), F.col("code")) + len(before)
    return F.when(F.length("text") == F.length("code"), F.substring(F.col("text"), at, F.length(part))).otherwise(part)


def definitions(rows: DataFrame) -> DataFrame:
    """Nodes of the logical lines of :func:`statements`: id, label, name, qualified_name, file_path, start_line, end_line,
    signature, parameters, return_type, is_exported, is_test, language, parent_id.

    A function is a method if the innermost definition around it is a class, which is its parent. The id is a hash of file,
    line and name.
    """
    arrow = lambda group: F.when(F.col("language").isin("javascript", "typescript"), F.regexp_extract("code", ARROWS, group)).otherwise("")
    heads = rows.where("indent >= 0").withColumn("_f", _by_language(FUNCTIONS, 1)).withColumn("_c", _by_language(CLASSES, 1, ANY_CLASS)).withColumn("_a", arrow(1))
    # both copies of a line have their characters in the same places, so that strings come back where code was matched
    whole = lambda group: _restored(_by_language(FUNCTIONS, group), "(" if group == 2 else "")
    bound = F.concat(*[_restored(arrow(g), "") for g in (2, 3, 4)])
    heads = heads.where("_f <> '' OR _c <> '' OR _a <> ''").select(
        "file_path", "language", F.col("line").alias("start_line"), "last_line", "indent", "block_end", F.trim("text").alias("signature"), ((F.col("_f") == "") & (F.col("_a") == "")).alias("is_class"),
        F.when(F.col("_f") != "", F.col("_f")).when(F.col("_a") != "", F.col("_a")).otherwise(F.col("_c")).alias("name"), F.regexp_replace(F.trim(F.when(F.col("_f") != "", whole(2)).otherwise(bound)), r",$", "").alias("parameters"), F.trim(whole(3)).alias("return_type"),
    )
    # read again and again: heads for their indentations, both for what is around them
    heads = stored(heads, "parse-heads")
    ended = stored(_ends(heads, rows).withColumn("id", F.xxhash64("file_path", "start_line", "name")), "parse-ended")
    around = _covered(ended, "start_line + 1").select("file_path", F.col("line").alias("start_line"), F.col("owner").alias("_p"))
    out = ended.join(around, ["file_path", "start_line"], "left").withColumn("_p", F.when(~F.col("is_class") & F.col("_p.is_class"), F.col("_p")))
    exported = F.when(F.col("language") == "go", F.col("name").rlike("^[A-Z]")).when(F.col("language").isin("javascript", "typescript"), F.col("signature").startswith("export")).otherwise(~F.col("name").startswith("_"))
    return out.select(
        "id",
        F.when(F.col("is_class"), "Class").when(F.col("_p").isNotNull(), "Method").otherwise("Function").alias("label"),
        "name",
        F.concat_ws(".", "_p.name", "name").alias("qualified_name"),
        "file_path", "start_line", "end_line", "signature", "parameters", "return_type",
        exported.alias("is_exported"),
        is_test_path(F.col("file_path")).alias("is_test"),
        "language",
        F.col("_p.id").alias("parent_id"),
    )


def bodies(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The logical lines within functions, with the innermost function around each as node_id; ``first``: the line after a head.

    Of a head the part behind the function's name is a line too (``head``), as defaults and one-line bodies stand there.
    """
    functions = nodes.where("label <> 'Class'").select("file_path", "start_line", "end_line", "name", "id", F.lit(False).alias("is_class"))
    owned = rows.where("indent >= 0").join(_covered(functions, "start_line"), ["file_path", "line"])
    head = F.col("line") == F.col("owner.start_line")
    # behind the name: what comes before isn't called
    at = lambda column: F.when(head, F.call_function("regexp_extract", F.col(column), F.concat(F.lit(r"\b"), F.regexp_replace("owner.name", r"([?!])", r"\\$1"), F.lit(r"(?!\w)(.*)$")), F.lit(1))).otherwise(F.col(column))
    owned = owned.select("file_path", "language", "line", at("text").alias("text"), at("code").alias("code"), "raw", "indent", F.col("owner.id").alias("node_id"), head.alias("head"))
    before = F.lag("head").over(Window.partitionBy("file_path", "node_id").orderBy("line"))
    return owned.withColumn("first", F.coalesce(before, F.lit(False)))


def calls(body: DataFrame) -> DataFrame:
    """Calls in functions: file_path, caller_id, callee_name, callee_qualified, line, context.

    The context tells how the result is used: destructure_tuple, iterated, boolean_check, exception_guard or none.
    """
    before = F.lag("code").over(Window.partitionBy("file_path", "node_id").orderBy("line"))
    code = F.col("code")
    context = (
        F.when(code.rlike(r"^\s*\w+\s*,\s*\w+[\w, ]*(=|:=)[^=].*\("), "destructure_tuple")
        .when(code.rlike(r"^\s*for\b.*\b(in|of|range)\b.*\("), "iterated")
        .when(code.rlike(r"^\s*(if|elif|while|assert|unless)\b.*\("), "boolean_check")
        .when(before.rlike(r"^\s*try\b\s*[:{]"), "exception_guard")
    )
    found = body.withColumn("context", context).select("file_path", F.col("node_id").alias("caller_id"), "line", "context", F.explode(F.regexp_extract_all("code", F.lit(r"(?<!\bdef )(?<!\bfunction )\b([A-Za-z_][\w.]*)\s*\("), F.lit(1))).alias("callee_qualified"))
    found = found.withColumn("callee_name", last_component(F.col("callee_qualified")))
    return found.where(~F.col("callee_name").isin(*NO_CALLS)).select("file_path", "caller_id", "callee_name", "callee_qualified", "line", "context")


def imports(rows: DataFrame) -> DataFrame:
    """Imports: file_path, line, module_path and imported_name, a row a name; a module that is imported whole has ``*``.

    A statement counts if it is code: the masked line is matched too, so that one in a string gives nothing.
    """
    patterns = _of_language({k: F.array(*[F.lit(p) for p in v]).cast("array<string>") for k, v in IMPORTS.items()}, F.array().cast("array<string>"))
    text = F.col("text")
    part = lambda p, i: F.call_function("regexp_extract", text, p, F.lit(i))
    found = F.transform(patterns, lambda p: F.struct(part(p, 1).alias("module"), part(p, 2).alias("names")))
    plain = F.col("language").isin("python") & F.col("code").rlike(r"^\s*import\s")
    block = F.col("language").isin("go") & F.col("code").rlike(r"^\s*import\b")
    tidy = lambda n: F.trim(F.regexp_replace(n, r"\s+(?:as|=>)\s+\w+\s*$|^\s*\{|\}\s*$|^\s*type\s+|[()]", ""))
    whole = F.transform(F.split(F.regexp_replace(text, r"^\s*import\s+", ""), ","), lambda m: F.struct(tidy(F.regexp_replace(m, r"[;\s]*$", "")).alias("module"), F.lit("").alias("names")))
    quoted = F.transform(F.regexp_extract_all(text, F.lit(r'"([^"]+)"'), F.lit(1)), lambda m: F.struct(m.alias("module"), F.lit("").alias("names")))
    hit = F.filter(found, lambda x: x["module"] != "")
    several = F.when(plain, F.filter(whole, lambda x: x["module"] != "")).when(block, quoted).when(F.col("language") == "go", F.slice(hit, 1, 0)).otherwise(F.slice(hit, 1, 1))
    # a string's inside has no words of an import in the masked line
    real = F.col("code").rlike(r"\b(?:import|from|export|require|require_relative|use|using|mod|open|alias|include)\b")
    hits = rows.where("indent >= 0").where(real).select("file_path", "line", F.explode(several).alias("hit"))
    names = F.filter(F.transform(F.split("hit.names", ","), tidy), lambda n: n != "")
    names = F.when(F.size(names) == 0, F.array(F.lit("*"))).otherwise(names)
    return hits.select("file_path", "line", F.col("hit.module").alias("module_path"), F.explode(names).alias("imported_name"))


def cleaned(text: Column) -> Column:
    """A docstring or comment without its marks."""
    return F.trim(F.regexp_replace(F.trim(text), r"^(/\*\*?|//+!?|#+!?|[rR]?\"\"\"|'''|--+)\s*|\s*(\*/|\"\"\"|''')$", ""))


def documented(raw: Column) -> Column:
    """The first line with words of a docstring."""
    inner = F.regexp_replace(F.trim(raw), r"^[rR]?[\"']+|[\"']+$", "")
    return F.coalesce(F.get(F.filter(F.transform(F.split(inner, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit(""))


def return_shape(expression: Column) -> Column:
    """none, or tuple, collection or value with the expression, cut to 80 characters."""
    bare = F.trim(F.regexp_replace(expression, r";\s*$", ""))
    shape = F.when(bare.rlike(r"^(\(.*,.*\)|[^\[{(]+,.*)$"), "tuple").when(bare.rlike(r"^[\[{]"), "collection").otherwise("value")
    return F.when(bare.isin("", "None", "null", "nil", "undefined"), "none").otherwise(F.concat(shape, F.lit("|"), F.substring(bare, 1, 80)))


def parameters_of(parameters: Column) -> Column:
    """The items of a list of parameters."""
    return F.filter(F.transform(F.regexp_extract_all(parameters, F.lit(ITEM), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")


def described(item: Column, language: Column) -> Column:
    """A parameter as ``name:type [required]`` or ``name:type opt=default``; null for the object of a method."""
    get = lambda p, i: F.regexp_extract(item, p, i)
    first, go = language.isin("java", "csharp", "c", "cpp", "php"), language == "go"
    name = F.when(first, F.coalesce(F.nullif(get(TYPE_FIRST, 2), F.lit("")), get(r"^\$?(\w+)", 1))).when(go, get(r"^(\w+)", 1)).otherwise(get(NAMED, 1))
    kind = F.trim(F.when(first, get(TYPE_FIRST, 1)).when(go, get(r"^\w+\s+(.+)$", 1)).otherwise(get(NAMED, 3)))
    default = F.trim(F.when(first, get(TYPE_FIRST, 3)).when(go, "").otherwise(get(NAMED, 4)))
    optional = F.when(~first & ~go & (get(NAMED, 2) == "?"), F.lit("undefined")).otherwise("")
    default = F.when(default != "", default).otherwise(optional)
    value = F.concat(name, F.when(kind != "", F.concat(F.lit(":"), kind)).otherwise(""), F.when(default != "", F.concat(F.lit(" opt="), default)).otherwise(" [required]"))
    return F.when(~name.isin("", "self", "cls"), _cut(value))


def _cut(value: Column, most: int = 200) -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - 3), F.lit("..."))).otherwise(value)


def properties(body: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Facts about nodes: node_id, kind, value, line, confidence.

    Kinds from lines: those of :data:`FACTS`, docstring, guard_clause, return_shape, conditional_return, exception_flow,
    boundary_condition, concurrency_pattern, exception_handler, class_field, class_decorator; from heads: param, visibility,
    security_tag; from calls: fingerprint, call_order, caller_usage. Nodes without a fact have no row.
    """
    along = Window.partitionBy("file_path", "node_id").orderBy("line")
    number = F.row_number().over(along)
    b = body.where("NOT head").unionByName(_one_line_bodies(body)).withColumn("_before", F.lag("text").over(along)).withColumn("_then", F.lead("text").over(along)).withColumn("_n", number)
    b = stored(b, "parse-along")
    condition = F.regexp_extract("_before", r"^\s*(?:if|elif|unless)\b\s*(.*?)\s*[:{]?\s*$", 1)
    condition = F.regexp_replace(condition, r"^\(([^()]*(?:\([^()]*\)[^()]*)*)\)$", "$1")  # brackets around all of it
    raised, returned = F.regexp_extract("code", FACTS[0][1], 1), F.regexp_extract("text", r"^\s*return\b\s*(.*?)\s*;?\s*$", 1)
    returns, plain = F.col("code").rlike(r"^\s*return\b"), F.regexp_replace(F.trim("text"), r"\s*;$", "")
    fact = lambda kind, value, confidence: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(confidence).alias("confidence"))
    each = lambda kind, p, before, c: F.transform(F.array_distinct(F.regexp_extract_all("text" if kind in IN_STRINGS else "code", F.lit(p), F.lit(1))), lambda v: fact(kind, F.when(v != "", F.concat(F.lit(before), v)), c))
    many = [each(*f) for f in FACTS]
    compared = F.array_distinct(F.regexp_extract_all("code", F.lit(COMPARISON), F.lit(1)))

    def boundary(text: Column) -> Column:
        found = F.lit(None).cast("string")
        for category, pattern in reversed(BOUNDARIES):
            found = F.when(text.rlike(pattern), F.concat(F.lit(category + "|"), F.substring(text, 1, 150))).otherwise(found)
        # a block's first part: its first statement, or the brace that opens it
        first = F.when(F.col("language").isin(*lexing.BRACES), "{").otherwise(F.substring(F.trim("_then"), 1, 60))
        return fact("boundary_condition", _cut(F.concat(found, F.when(F.col("code").rlike(r"^\s*\}?\s*(?:if|elif|else\s+if)\b"), F.concat(F.lit(" => "), first)).otherwise(""))), 0.9)

    single = F.array(
        fact("docstring", F.when(F.col("first") & F.col("raw").rlike(r"""^\s*[rR]?["']"""), documented(F.col("raw"))), 1.0),
        fact("return_shape", F.when(returns, return_shape(returned)), 0.9),
        fact("conditional_return", F.when(returns & (condition != ""), _cut(F.concat(F.lit("if "), condition, F.lit(": return"), F.when(returned != "", F.concat(F.lit(" "), returned)).otherwise("")))), 0.9),
        fact("exception_flow", F.when((raised != "") & (condition != ""), _cut(F.concat(F.lit("WHEN "), condition, F.lit(": "), F.substring(plain, 1, 100)))), 0.9),
        fact("guard_clause", F.when((F.col("_n") <= 3) & (condition != "") & (returns | (raised != "")), condition), 1.0),
    )
    from_lines = b.select("node_id", "line", F.explode(F.filter(F.concat(*many, F.transform(compared, boundary), single), lambda x: F.coalesce(x["value"] != "", F.lit(False)))).alias("f")).select("node_id", "f.kind", "f.value", "line", "f.confidence")
    once = ["return_shape", "boundary_condition"]  # a row a value
    shapes = from_lines.where(F.col("kind").isin(once)).groupBy("node_id", "kind", "value", "confidence").agg(F.min("line").alias("line"))
    from_lines = from_lines.where(~F.col("kind").isin(once)).unionByName(shapes)
    functions = nodes.where("label <> 'Class'")
    params = functions.select(F.col("id").alias("node_id"), F.lit("param").alias("kind"), F.explode(F.transform(parameters_of(F.col("parameters")), lambda x: described(x, F.col("language")))).alias("value"), F.col("start_line").alias("line"), F.lit(1.0).alias("confidence")).where("value IS NOT NULL")
    visible = F.when(F.col("signature").rlike(r"^(private|#)\b") | F.col("name").rlike(r"^__\w*[^_]$"), "private").when(F.col("signature").startswith("protected") | F.col("name").rlike("^_[^_]"), "protected").otherwise("public")
    seen = nodes.select(F.col("id").alias("node_id"), F.lit("visibility").alias("kind"), visible.alias("value"), F.col("start_line").alias("line"), F.lit(1.0).alias("confidence"))
    out = from_lines.unionByName(params).unionByName(seen).unionByName(_of_classes(rows, nodes)).unionByName(_of_calls(body, nodes))
    return out.unionByName(_secure(rows, functions)).unionByName(_concurrent(b)).unionByName(_handlers(b))


def _one_line_bodies(body: DataFrame) -> DataFrame:
    """What stands behind heads on their own lines, as lines of their functions."""
    inner = F.when(F.col("language").isin(*lexing.BRACES), F.regexp_extract("code", r"^.*?\)[^{]*\{\s*(.*?)\s*\}[;\s]*$", 1)).otherwise(F.regexp_extract("code", r"^.*?\)\s*(?:->[^:]*)?:\s*(\S.*)$", 1))
    return body.where("head").withColumn("_c", inner).where("_c <> ''").withColumn("text", _restored(F.col("_c"), "")).withColumn("code", F.col("_c")).drop("_c")


def _secure(rows: DataFrame, functions: DataFrame) -> DataFrame:
    """Words of security in functions' names and decorators, each once."""
    has = lambda text, w: text.contains(w) & text.rlike(f"(^|[^a-z0-9]){w}($|[^a-z0-9])")
    above = rows.where("indent >= 0").select("file_path", F.col("line"), F.regexp_extract("code", r"^\s*@(.*)$", 1).alias("mark"))
    order = Window.partitionBy("file_path").orderBy("line")
    # decorators stand in the lines before a head, one after another: runs of them are numbered alike
    above = above.withColumn("run", F.sum((F.col("mark") == "").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    marks = above.groupBy("file_path", "run").agg(F.max("line").alias("start_line"), F.array_join(F.collect_list(F.when(F.col("mark") != "", F.col("mark"))), " ").alias("marks"))
    named = functions.join(marks, ["file_path", "start_line"], "left")
    named = named.select("id", "start_line", F.lower(F.concat_ws(" ", "name", "marks")).alias("_t"))
    words = F.array(*[F.when(has(F.col("_t"), w), f"{c}: {w}") for c, ws in SECURITY.items() for w in ws])
    found = named.select(F.col("id").alias("node_id"), F.lit("security_tag").alias("kind"), F.explode(F.array_compact(words)).alias("value"), F.col("start_line").alias("line"))
    return found.select("node_id", "kind", "value", "line", F.lit(1.0).alias("confidence"))


def _concurrent(b: DataFrame) -> DataFrame:
    """The first line of a function with each word for a lock, and each word for shared state."""
    # patterns are literals: one that comes from a column is compiled again for each word of each line
    has = lambda w: F.col("code").contains(w) & (F.lit(True) if re.search(r"\W$", w) else F.col("code").rlike(rf"(^|\W)\Q{w}\E($|\W)"))
    word = [F.when(has(w), F.struct(F.lit(kind).alias("kind"), F.lit(w).alias("word"))) for kind, words in (("lock", LOCKS), ("shared_state", SHARED)) for w in words]
    found = b.select("node_id", "line", "text", F.explode(F.array_compact(F.array(*word))).alias("w"))
    first = found.groupBy("node_id", "w").agg(F.min(F.struct("line", "text")).alias("f"))
    value = F.concat("w.kind", F.lit(": "), F.when(F.col("w.kind") == "lock", F.substring(F.trim("f.text"), 1, 120)).otherwise(F.trim("w.word")))
    return first.select("node_id", F.lit("concurrency_pattern").alias("kind"), value.alias("value"), F.col("f.line").alias("line"), F.lit(0.7).alias("confidence"))


def _handlers(b: DataFrame) -> DataFrame:
    """Clauses that catch, with what their block does first of raising and returning, else ``handles``.

    The lines from a clause to the next make a run; its block is those before one that isn't indented deeper.
    """
    along = Window.partitionBy("file_path", "node_id").orderBy("line")
    clause = F.col("code").rlike(r"^\s*(?:except|rescue|\}?\s*catch)\b")
    runs = b.withColumn("_clause", clause).withColumn("_run", F.sum(clause.cast("int")).over(along)).where("_run > 0")
    inside = Window.partitionBy("file_path", "node_id", "_run").orderBy("line")
    runs = runs.withColumn("_at", F.first("indent").over(inside)).withColumn("_block", F.lead("indent").over(inside))
    runs = runs.withColumn("_block", F.first("_block").over(inside)).withColumn("_least", F.min(F.when(~F.col("_clause"), F.col("indent"))).over(inside))
    inner = ~F.col("_clause") & (F.col("_least") > F.col("_at")) & (F.col("indent") == F.col("_block"))
    statement = F.regexp_replace(F.trim("text"), r"\s*;$", "")
    action = F.when(inner & F.col("code").rlike(r"^\s*(?:raise|throw)\b"), "re-raises").when(inner & F.col("code").rlike(r"^\s*return\b"), F.concat(F.lit("returns: "), F.substring(statement, 1, 40)))
    text = F.max(F.when(F.col("_clause"), F.regexp_replace(F.regexp_replace(F.trim("text"), r"^\}\s*", ""), r"\s*[:{]\s*$", "")))
    found = runs.withColumn("_action", action).groupBy("file_path", "node_id", "_run").agg(text.alias("text"), F.min_by("_action", F.when(F.col("_action").isNotNull(), F.col("line"))).alias("action"), F.min("line").alias("line"))
    return found.select("node_id", F.lit("exception_handler").alias("kind"), _cut(F.concat("text", F.lit(" -> "), F.coalesce("action", F.lit("handles")))).alias("value"), "line", F.lit(1.0).alias("confidence"))


def _of_classes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    classes = nodes.where("label = 'Class'").select("file_path", F.col("id").alias("node_id"), "start_line", "end_line")
    # by line, as a file's lines times its classes grow with the square of its size
    over = lambda df, first: df.withColumn("line", F.explode(F.sequence((F.col("start_line") - first).cast("int"), F.greatest(F.col("start_line") - first, "end_line").cast("int"))))
    inside = over(nodes.where("label <> 'Class'").select("file_path", "start_line", "end_line"), 0).select("file_path", "line").distinct().withColumn("_inside", F.lit(True))
    near = rows.where("indent >= 0").join(over(classes, 3), ["file_path", "line"]).join(inside, ["file_path", "line"], "left")
    outside = F.col("_inside").isNull()
    field = F.regexp_extract("code", r"^\s*(?:(?:public|private|protected|static|final|readonly|let|var|val)\s+)*(\w+)\s*(?::[^=]+)?(?:=[^=]|$)", 1)
    fields = near.where((F.col("line") > F.col("start_line")) & outside & (F.col("indent") > 0)).select("node_id", F.lit("class_field").alias("kind"), field.alias("value"), "line", F.lit(1.0).alias("confidence"))
    # decorators stand directly above the head, one after another
    above = near.where("line < start_line").groupBy("node_id", "start_line").agg(F.array_sort(F.collect_list(F.struct((F.col("start_line") - F.col("line")).alias("d"), F.regexp_extract("text", r"^\s*@([\w.]+)", 1).alias("name"), "line"))).alias("_above"))
    marks = F.filter("_above", lambda x, i: (x["d"] == i + 1) & (x["name"] != "") & ~F.exists(F.slice("_above", 1, 3), lambda y: (y["d"] < x["d"]) & (y["name"] == "")))
    decorators = above.select("node_id", F.explode(marks).alias("m")).select("node_id", F.lit("class_decorator").alias("kind"), F.col("m.name").alias("value"), F.col("m.line").alias("line"), F.lit(1.0).alias("confidence"))
    return fields.where("value <> ''").unionByName(decorators)


def _of_calls(body: DataFrame, nodes: DataFrame) -> DataFrame:
    found = calls(body)
    usage = found.where("context IS NOT NULL").select(F.col("caller_id").alias("node_id"), F.lit("caller_usage").alias("kind"), F.concat_ws(":", "callee_name", "context").alias("value"), "line", F.lit(0.9).alias("confidence"))
    arity = F.size(parameters_of(F.col("parameters")))
    names = found.groupBy(F.col("caller_id").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set("callee_name")), ",").alias("_callees"))
    prints = nodes.where("label <> 'Class'").select(F.col("id").alias("node_id"), arity.alias("_arity"), F.col("start_line").alias("line")).join(names, "node_id", "left")
    prints = prints.select("node_id", F.lit("fingerprint").alias("kind"), F.concat(F.col("_arity").cast("string"), F.lit("|"), F.coalesce("_callees", F.lit(""))).alias("value"), "line", F.lit(1.0).alias("confidence"))
    receiver = F.regexp_extract("callee_qualified", r"^(.*)\.\w+$", 1)
    order = found.withColumn("_r", receiver).where("_r <> ''").groupBy(F.col("caller_id").alias("node_id"), "_r").agg(F.array_sort(F.collect_list(F.struct("line", "callee_name"))).alias("_calls"))
    order = order.where(F.size("_calls") > 1).select("node_id", F.lit("call_order").alias("kind"), _cut(F.concat("_r", F.lit(": "), F.array_join(F.slice(F.col("_calls.callee_name"), 1, 5), " -> "))).alias("value"), F.array_min("_calls")["line"].alias("line"), F.lit(0.9).alias("confidence"))
    return usage.unionByName(prints).unionByName(order)


def assertions(body: DataFrame) -> DataFrame:
    """Assertions in bodies: node_id, kind, expression, expected, line."""
    text = F.trim("text")
    method = F.regexp_extract(text, r"\b(?:self\.)?(assert[A-Z]\w*|expect|assert_\w+)\s*\(", 1)
    inner = F.regexp_extract(text, r"\b(?:assert[A-Z]\w*|expect|assert_\w+)\s*\((.*)\)\s*;?\s*(?:\.\w+\((.*)\))?;?$", 1)
    kind = F.when(method != "", method).when(text.rlike(r"^assert\b"), "assert")
    pair = F.regexp_extract(text, r"^assert\s+(.*?)\s*==\s*(.*)$", 2)
    chained = F.regexp_extract(text, r"\bexpect\(.*?\)\.to\w+\((.*)\)\s*;?$", 1)
    expected = F.when(method == "expect", chained).when(method != "", F.trim(F.regexp_extract(inner, r"^.*,\s*(.*)$", 1))).otherwise(pair)
    expression = F.when(method == "expect", F.regexp_extract(text, r"\bexpect\((.*?)\)\.", 1)).when(method != "", F.regexp_replace(inner, r",[^,]*$", "")).otherwise(F.regexp_replace(text, r"^assert\s+|\s*==.*$", ""))
    return body.select("node_id", kind.alias("kind"), expression.alias("expression"), F.when(expected != "", expected).alias("expected"), "line").where("kind IS NOT NULL")


def manifests(files: DataFrame) -> DataFrame:
    """Packages of manifest files (file_path, text): name, version, package_manager, is_dev.

    requirements files, package.json, go.mod and Cargo.toml.
    """
    base, text = F.substring_index("file_path", "/", -1), F.coalesce("text", F.lit(""))
    row = lambda line, pattern, manager, dev: F.struct(F.regexp_extract(line, pattern, 1).alias("name"), F.regexp_extract(line, pattern, 2).alias("version"), F.lit(manager).alias("package_manager"), dev.alias("is_dev"))
    split = F.split(text, "\r?\n")
    no = F.lit(False)
    parsed = F.from_json(text, "dependencies map<string,string>, devDependencies map<string,string>")
    node = lambda entries, dev: F.transform(F.coalesce(F.map_entries(entries), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit("npm").alias("package_manager"), F.lit(dev).alias("is_dev")))
    section = lambda i: F.element_at(F.filter(F.transform(F.slice(split, 1, i + 1), lambda x: F.regexp_extract(x, r"^\[(.*)\]\s*$", 1)), lambda x: x != ""), -1)
    cargo = F.transform(split, lambda line, i: F.when(F.coalesce(section(i), F.lit("")).isin("dependencies", "dev-dependencies"), row(line, r"^\s*([\w-]+)\s*=\s*(?:\{.*version\s*=\s*)?\"([^\"]+)\"", "cargo", F.coalesce(section(i), F.lit("")) == "dev-dependencies")))
    found = (
        F.when(base.rlike(r"^requirements.*\.txt$"), F.transform(split, lambda x: row(x, r"^\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*(?:[=~<>!]=\s*([^\s;#,]+))?", "pip", no)))
        .when(base == "package.json", F.concat(node(parsed["dependencies"], False), node(parsed["devDependencies"], True)))
        .when(base == "go.mod", F.transform(split, lambda x: row(x, r"^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+(v[\w.+-]+)", "go", no)))
        .when(base == "Cargo.toml", cargo)
    )
    rows = files.select(F.explode(found).alias("p")).where("p IS NOT NULL").select("p.*")
    return rows.where("name <> ''").dropDuplicates(["name", "package_manager"])
