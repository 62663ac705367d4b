"""Source files to logical lines: what is string or comment is told apart, and brackets are matched, before any pattern runs.

One regular expression a family of languages cuts a file into comments, strings and the rest, from left to right as a
scanner does. Blanked copies keep every character's place. Brackets are numbered by their depth, a running sum; an opening
bracket's partner is the next one of its depth, and the bracket that is open at a line's end is the last opened of the depth
there (:func:`brackets`). A line that ends within a string or round bracket goes on in the next. :func:`logical_lines` needs no
rows of brackets: a small helper follows a file's marks once, and the file stays in its row and task until its lines are cut.

Null texts are empty and give no rows but one blank line.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Marks, at a blanked line's end, that a string goes on.
OPEN = "\x01"

_DOUBLE, _SINGLE = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"?', r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?"
_TRIPLE, _TRIPLES = r'"""[\s\S]*?(?:"""|\z)', r"'''[\s\S]*?(?:'''|\z)"
_TICKS, _CHAR = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?", r"'(?:\\[^\n]{1,8}?|[^'\\\n])'"
_SLASHES, _HASH = r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)", r"#[^\n]*+"
_REGEX = r"(?<=[=(,:\[!&|?{};] {0,2})/(?![*/ ])[^/\\\n]*+(?:\\[^\n][^/\\\n]*+)*+/"
#: Of a family: its comments, its strings, and what neither can start with.
FAMILIES = {
    "python": (_HASH, f"{_TRIPLE}|{_TRIPLES}|{_DOUBLE}|{_SINGLE}", "\"'#"),
    "script": (_SLASHES, f"{_TICKS}|{_DOUBLE}|{_SINGLE}|{_REGEX}", "\"'`/"),
    "brace": (_SLASHES, f"{_TRIPLE}|{_TICKS}|{_DOUBLE}|{_CHAR}", "\"'`/"),
    "php": (f"{_SLASHES}|{_HASH}", f"{_DOUBLE}|{_SINGLE}", "\"'/#"),
    "end": (_HASH, f"{_TRIPLE}|{_DOUBLE}|{_SINGLE}", "\"'#"),
    "lua": (r"--\[\[[\s\S]*?(?:\]\]|\z)|--[^\n]*+", rf"\[\[[\s\S]*?(?:\]\]|\z)|{_DOUBLE}|{_SINGLE}", "\"'\\-\\["),
    "ocaml": (r"\(\*[\s\S]*?(?:\*\)|\z)", _DOUBLE, "\"("),
}
FAMILY_OF = {"python": "python", "javascript": "script", "typescript": "script", "php": "php", "ruby": "end", "elixir": "end", "lua": "lua", "ocaml": "ocaml"}
#: Languages whose blocks stand in braces; in the others a block ends where the indentation does.
BRACES = ["javascript", "typescript", "go", "java", "rust", "php", "c", "cpp", "csharp", "scala", "kotlin", "swift"]
#: Lines whose braces list names and open no block.
LISTS = r"^\s*(?:import\b|export\s+(?:type\s+)?\{|(?:pub(?:\([^)]*\))?\s+)?use\b)"


def _pattern(family: str) -> str:
    comments, strings, starts = FAMILIES[family]
    return f"({comments})|({strings})|[^{starts}]++|[{starts}]"


def _scanner() -> Column:
    """The expression of a row's language."""
    table = F.create_map(*[x for k, f in FAMILY_OF.items() for x in (F.lit(k), F.lit(_pattern(f)))])
    return F.coalesce(F.try_element_at(table, F.col("language")), F.lit(_pattern("brace")))


def _filled(token: Column) -> Column:
    """A string without its contents: as long, with its quotes, and marks at its line breaks."""
    inner = F.substring(token, F.lit(2), F.greatest(F.length(token) - 2, F.lit(0)))
    inner = F.regexp_replace(F.regexp_replace(inner, r"[^\n]", "_"), "\n", OPEN + "\n")
    return F.concat(F.substring(token, 1, 1), inner, F.when(F.length(token) > 1, F.substring(token, -1, 1)).otherwise(""))


def scanned(files: DataFrame) -> DataFrame:
    """Adds to sources (file_path, language, text): ``bare``, the text without comments, and ``code``, without strings too."""
    parts = [F.call_function("regexp_extract_all", F.col("text"), _scanner(), F.lit(g)) for g in (0, 1, 2)]
    tokens = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("all", "comment", "string"))])
    gone = lambda t: F.regexp_replace(t["comment"], r"[^\n]", " ")
    bare = F.transform("_t", lambda t: F.when(t["comment"] != "", gone(t)).when(t["string"] != "", F.replace(t["all"], F.lit("\n"), F.lit(OPEN + "\n"))).otherwise(t["all"]))
    code = F.transform("_t", lambda t: F.when(t["comment"] != "", gone(t)).when(t["string"] != "", _filled(t["string"])).otherwise(t["all"]))
    clean = files.withColumn("text", F.regexp_replace("text", f"\r\n?|{OPEN}", "\n"))
    return clean.withColumn("_t", tokens).select("file_path", "language", "text", F.array_join(bare, "").alias("bare"), F.array_join(code, "").alias("code"))


def physical_lines(files: DataFrame) -> DataFrame:
    """file_path, language, line (from 1), raw, bare and code of every line of :func:`scanned` files."""
    split = F.arrays_zip(*[F.split(c, "\n").alias(n) for c, n in (("text", "raw"), ("bare", "bare"), ("code", "code"))])
    rows = scanned(files).select("file_path", "language", F.posexplode(split).alias("at", "x"))
    return rows.select("file_path", "language", (F.col("at") + 1).alias("line"), "x.raw", "x.bare", "x.code")


def brackets(rows: DataFrame) -> DataFrame:
    """The brackets and ends of lines: file_path, line, at (place in the line), kind, level, partner.

    ``level`` is the depth within a bracket, the same for both of a pair; of a line's end, kind ``e``, it is the depth
    there. Kinds: ``(`` (square ones too), ``{`` or ``l`` (a brace that lists names) open, ``)`` closes; ``partner`` is the
    line of the closing one. A closing bracket too many opens below.
    """
    marks = F.transform(F.split(F.regexp_replace("code", r"[^\[\](){}]", ""), ""), lambda c: F.when(c.isin("(", "["), "(").when(c == "{", F.when(F.col("code").rlike(LISTS) | ~F.col("language").isin(*BRACES), "l").otherwise("{")).when(c != "", ")"))
    marks = F.concat(F.filter(marks, lambda m: m.isNotNull()), F.array(F.lit("e")))
    rows = rows.select("file_path", "line", F.posexplode(marks).alias("at", "kind"))
    opens = F.col("kind").isin("(", "{", "l")
    along = Window.partitionBy("file_path").orderBy("line", "at")
    depth = F.sum(F.when(opens, 1).when(F.col("kind") == ")", -1).otherwise(0)).over(along)
    rows = rows.withColumn("level", depth + (F.col("kind") == ")").cast("int"))
    inside = Window.partitionBy("file_path", "level", F.col("kind") == "e").orderBy("line", "at")
    return rows.withColumn("partner", F.when(opens, F.lead("line").over(inside)))


def folded(marks: str) -> tuple[array, ...]:
    """The logical lines of a file from its marks (see :func:`logical_lines`): first and last line, depth before, ``end`` and the
    next line's ``end`` that isn't 0.

    ``end`` is the line where the last block of braces ends that opens in the line at its depth: the file's last one if it
    isn't closed, 0 if none opens.
    """
    first, last, before, end = array("i", [1]), array("i"), array("i", [0]), array("i", [0])
    line, depth = 1, 0
    kinds: dict[int, str] = {}  # what was opened last, by level
    blocks: dict[int, int] = {}  # the logical line of the open block, by level
    for c in marks:
        if c == ")":
            if depth in blocks:
                end[blocks.pop(depth)] = line
            depth -= 1
        elif c in "eg":
            if c == "e" and not (depth > 0 and kinds[depth] in "(l"):
                last.append(line)
                first.append(line + 1)
                before.append(depth)
                end.append(0)
            line += 1
        else:
            depth += 1
            kinds[depth] = c
            if c == "{" and depth == before[-1] + 1:
                blocks[depth] = len(end) - 1
                end[-1] = -1
    if first[-1] == line:  # nothing goes on behind the last line
        for x in (first, before, end):
            x.pop()
    else:
        last.append(line - 1)
    behind, later = array("i", bytes(4 * len(end))), 0
    for i in range(len(end) - 1, -1, -1):
        end[i] = line - 1 if end[i] < 0 else end[i]
        behind[i], later = later, end[i] or later
    return first, last, before, end, behind


def _folded(marks: pa.Array) -> pa.Array:
    columns, offsets = [array("i") for _ in range(5)], array("i", [0])
    for text in marks:
        for whole, part in zip(columns, folded(text.as_py())):
            whole.extend(part)
        offsets.append(len(columns[0]))
    values = [pa.array(np.frombuffer(c, np.int32)) for c in columns]
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32)), pa.StructArray.from_arrays(values, ["line", "last_line", "depth", "end", "behind"]))


def logical_lines(files: DataFrame) -> DataFrame:
    """file_path, language, line, last_line, raw, text, code, indent, depth and block_end of sources' logical lines.

    ``raw`` has the line's characters, ``text`` those without comments and ``code`` those without the contents of strings,
    each of the physical lines' joined by a space (``raw``: by a line break). ``indent`` is -1 where there is no code.
    ``depth`` is the depth before the line, ``block_end`` the line where the last block ends that opens in it: one of
    braces at its own depth, on it or first on the next line (behind a Rust function's bounds); null if it opens none.

    A file's marks are the kinds of its brackets, as in :func:`brackets`, and a mark at each line's end: ``g`` if a string or
    a backslash goes on there, else ``e``. Files are taken one by one, in the tasks that have them.
    """
    split = [F.split(c, "\n").alias(n) for c, n in (("text", "raw"), ("bare", "bare"), ("code", "code"))]
    rows = scanned(files).select("file_path", "language", *split)
    braced = F.col("language").isin(*BRACES)

    def marked(code: Column) -> Column:
        kinds = F.translate(F.regexp_replace(code, r"[^\[\](){}]+", ""), "[]}", "())")
        kinds = F.when(kinds.contains("{") & (~braced | code.rlike(LISTS)), F.translate(kinds, "{", "l")).otherwise(kinds)
        return F.concat(kinds, F.when(code.endswith(OPEN) | (code.contains("\\") & code.rlike(r"\\\s*$")), "g").otherwise("e"))

    fold = F.arrow_udf(_folded, "array<struct<line: int, last_line: int, depth: int, end: int, behind: int>>")
    rows = rows.withColumn("_at", fold(F.array_join(F.transform("code", marked), "")))
    end = rf"\s*(?:{OPEN}|\\)?\s*$"  # neither marks nor backslashes before line breaks

    def bared(part: Column) -> Column:
        """A line without the end; few lines end in a character that the pattern, which tries every place, can take."""
        return F.when(F.contains(F.lit(" \t\n\x0b\f\r\\\x85\u2028\u2029" + OPEN), F.substring(part, -1, 1)), F.regexp_replace(part, end, "")).otherwise(part)

    def several(field: str, x: Column) -> Column:
        # by place: a slice would copy the file's lines first
        return F.transform(F.sequence(x["line"] - 1, x["last_line"] - 1), lambda n: F.get(F.col(field), n))

    def joined(field: str, x: Column) -> Column:
        parts = F.transform(several(field, x), lambda y, i: F.when(i == 0, bared(y)).otherwise(F.trim(bared(y))))
        return F.when(x["line"] == x["last_line"], bared(F.get(F.col(field), x["line"] - 1))).otherwise(F.array_join(parts, " "))

    def line(x: Column, i: Column) -> Column:
        raw = F.when(x["line"] == x["last_line"], F.get(F.col("raw"), x["line"] - 1)).otherwise(F.array_join(several("raw", x), "\n"))
        follows, ahead = F.get(F.col("_at"), i + 1), F.get(F.col("code"), x["last_line"])
        opens = F.when(ahead.rlike(r"^\s*\{"), True).when((follows["line"] < follows["last_line"]) & ahead.rlike(rf"^\s*(?:{OPEN}|\\)?\s*$"), joined("code", follows).rlike(r"^\s*\{"))
        return F.struct(x["line"].alias("line"), x["last_line"].alias("last_line"), raw.alias("raw"), joined("bare", x).alias("text"), joined("code", x).alias("code"), x["depth"].alias("depth"), x["end"].alias("end"), F.when(opens, follows["end"]).alias("following"), x["behind"].alias("behind"))

    out = rows.select("file_path", "language", F.explode(F.transform("_at", line)).alias("x")).select("file_path", "language", "x.*")
    blank = F.trim("code") == ""
    bounds = (F.col("language") == "rust") & F.col("code").rlike(r"\bfn\b[^;{]*$")  # bounds of types stand before the block
    block_end = F.coalesce(F.nullif("end", F.lit(0)), F.nullif(F.when(F.col("following").isNotNull(), F.col("following")).when(bounds, F.col("behind")), F.lit(0)))
    return out.select(
        "file_path", "language", "line", "last_line", "raw", "text", "code", F.when(blank, -1).otherwise(F.length("code") - F.length(F.ltrim("code", F.lit(" \t")))).alias("indent"), F.col("depth").cast("long").alias("depth"), F.when(~blank, block_end).alias("block_end")
    )
