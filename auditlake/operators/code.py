"""What source texts hold: code blocks, imports and symbols of Python, and parts of HTML.

Python's own parsers work on Arrow batches, one call per text; a text that doesn't parse gives what is said there.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of forms that carry a one-time token, and elements without visible text.
TOKEN_MARKS = ("csrf", "token")
SILENT = {"script", "style", "svg", "noscript", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# End of the fixed values.


def code_blocks(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(block_no, code) of every fenced block, numbered from 1; an open fence reaches to the end of the text."""
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"(?s)```[^\n]*\n(.*?)(?:```|\z)"), 1)
    return df.where(F.contains(F.col(text), F.lit("```"))).select(*keep, F.posexplode(blocks).alias("__p", "code")).select(*keep, (F.col("__p") + 1).alias("block_no"), "code")


def _features(source: str | None) -> dict:
    out = {"parsed": False, "imports": [], "symbols": [], "calls": 0, "branches": 0, "inert": False}
    if source is None:
        return out
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return out
    imports: set[str] = set()
    symbols = []
    parents = {child: node for node in ast.walk(tree) for child in ast.iter_child_nodes(node)}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports.update(a.name.split(".")[0] for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            imports.add(node.module.split(".")[0])
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            up = parents.get(node)
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if isinstance(up, ast.ClassDef) else "function"
            symbols.append({"kind": kind, "name": node.name, "parent": up.name if isinstance(up, ast.ClassDef) else None, "start_line": node.lineno, "end_line": node.end_lineno})
        out["calls"] += isinstance(node, ast.Call)
        out["branches"] += isinstance(node, (ast.If, ast.For, ast.While, ast.Try, ast.With, ast.Match, ast.Raise, ast.Assert))
    symbols.sort(key=lambda s: (s["start_line"], s["name"]))
    return out | {"parsed": True, "imports": sorted(imports), "symbols": symbols, "inert": not out["calls"] and not out["branches"]}


_SYMBOL = "array<struct<kind:string,name:string,parent:string,start_line:int,end_line:int>>"


def python_features(df: DataFrame, keep: list[str], code: str) -> DataFrame:
    """Adds parsed, imports (first names, in order), symbols (kind, name, class, lines), calls, branches, and inert: true
    for what neither calls nor decides anything, such as plain types and constants. Null and broken texts are not
    parsed and hold nothing."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    schema = f"{fields}, parsed boolean, imports array<string>, symbols {_SYMBOL}, calls int, branches int, inert boolean"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_features(x) for x in b.column(b.num_columns - 1).to_pylist()]
            made = [pa.array([r[f.name] for r in rows], f.type) for f in list(target)[len(keep) :]]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *made], schema=target)

    return df.select(*keep, F.col(code).alias("__code")).mapInArrow(run, schema)


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.forms, self.tokens, self.meta, self.silent = [], [], 0, {}, {}, 0

    def handle_starttag(self, tag, attrs):
        a = {k: (v or "").strip() for k, v in attrs}
        self.silent += tag in SILENT
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "form":
            self.forms += 1
        elif tag == "input" and a.get("type", "").lower() == "hidden" and a.get("name") and a.get("value"):
            if any(m in a["name"].lower() for m in TOKEN_MARKS):
                self.tokens.setdefault(a["name"], a["value"])
        elif tag == "meta" and a.get("content") and (key := a.get("name") or a.get("property")):
            if "csrf" in key.lower():
                self.meta.setdefault(key, a["content"])

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in SILENT))

    def handle_data(self, data):
        if not self.silent and (s := data.strip()):
            self.text.append(s)


def html_parts(df: DataFrame, keep: list[str], html: str) -> DataFrame:
    """Adds text (visible, one piece a line), links (targets in order), forms, and tokens: hidden fields first, then
    meta tags of other names. Null pages have null text and nothing else."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    schema = f"{fields}, text string, links array<string>, forms int, tokens map<string,string>"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def one(page: str | None) -> tuple:
        p = _Page()
        if page is not None:
            p.feed(page)
            p.close()
        named = dict(p.meta)
        param = named.pop("csrf-param", None)
        if param and "csrf-token" in named:
            named.setdefault(param, named["csrf-token"])
        return None if page is None else "\n".join(p.text), p.links, p.forms, [*({**named, **p.tokens}).items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(x) for x in b.column(b.num_columns - 1).to_pylist()]
            made = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(target)[len(keep) :])]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *made], schema=target)

    return df.select(*keep, F.col(html).alias("__html")).mapInArrow(run, schema)


_SCRIPT = r"""(?is)(.*?)(<script\b(?:[^>"']|"[^"]*"|'[^']*')*>)(.*?)(</script\s*>)"""


def script_only(text: Column, path: Column) -> Column:
    """Component files with everything outside their scripts blanked, line breaks and length kept; other files, and
    those without a whole script, as they are. Null texts stay null."""
    blank = lambda c: F.regexp_replace(c, r"[^\r\n]", " ")
    before, opens, body, closes = (F.regexp_extract_all(text, F.lit(_SCRIPT), k) for k in (1, 2, 3, 4))
    parts = F.arrays_zip(before.alias("b"), opens.alias("o"), body.alias("s"), closes.alias("c"))
    masked = F.array_join(F.transform(parts, lambda x: F.concat(blank(x["b"]), blank(x["o"]), x["s"], blank(x["c"]))), "")
    rest = F.substring(text, F.length(masked) + 1, F.length(text))
    component = F.lower(F.coalesce(path, F.lit(""))).endswith(".vue") & text.rlike(_SCRIPT)
    return F.when(component, F.concat(masked, blank(rest))).otherwise(text)


# Names of variables in a signature and of properties in a class, and how far they are looked for.
SIGNATURE_LINES, PROPERTY_LINES = 12, 400
VARIABLE = r"\$([A-Za-z_]\w*)"
PROPERTY = r"\b(?:public|protected|private|var)\b[^;{(=]*\$([A-Za-z_]\w*)"
# End of the fixed values.


def signature_names(code: Column) -> Column:
    """The different variables that a function's signature names, in lower case: those before the first brace or semicolon
    of its first lines. Null code has null names: it was not read."""
    head = F.array_join(F.slice(F.split(code, "\n"), 1, SIGNATURE_LINES), "\n")
    return F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_extract(head, r"^[^{;]*", 0), F.lit(VARIABLE), 1), F.lower))


def property_names(code: Column) -> Column:
    """The different properties that a class declares before its first function, in lower case; null for null code."""
    lines = F.slice(F.split(code, "\n"), 1, PROPERTY_LINES)
    first = F.array_position(F.transform(lines, lambda x: x.rlike(r"\bfunction\s")), True)
    before = F.slice(lines, F.lit(1), F.when(first > 0, first.cast("int") - 1).otherwise(F.size(lines)))
    return F.array_distinct(F.flatten(F.transform(before, lambda x: F.transform(F.regexp_extract_all(x, F.lit(PROPERTY), 1), F.lower))))
