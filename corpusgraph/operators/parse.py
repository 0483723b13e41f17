"""Symbols, calls, imports and span hashes of source files, as one table function.

Python is read with the standard library's parser; TypeScript, Go and Rust with one scanner
that knows strings, comments and braces, and a declaration pattern for each language. A file
that doesn't parse, or whose language isn't known, gives no rows.
"""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusgraph.schema import SYMBOLS


@dataclass(frozen=True)
class Language:
    extensions: tuple[str, ...]
    test_paths: tuple[str, ...]
    test_names: tuple[str, ...]
    declaration: str = ""
    container: str = ""
    imports: str = ""
    line_comment: str = "//"


# Suffixes and test conventions of each language.
LANGUAGES = {
    "python": Language((".py", ".pyi"), ("test_", "_test.", "/tests/", "spec."), ("test_", "Test"), line_comment="#"),
    "typescript": Language(
        (".ts", ".tsx", ".js", ".jsx", ".mjs"), ("test_", "_test.", "/tests/", "spec."), ("test", "it", "describe"),
        r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?\s*|class\s+)(?P<name>[\w$]+)|^[ \t]+(?:(?:public|private|protected|static|async|get|set)\s+)*(?P<method>(?!if\b|for\b|while\b|switch\b|catch\b|return\b)[\w$]+)\s*\([^;{}]*\)\s*(?::[^{;=]+)?(?=\{)",
        r"class\s", r"^[ \t]*import\s[^;\n]*",
    ),
    "go": Language((".go",), ("_test.go",), ("Test", "Benchmark", "Fuzz"), r"^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)|^type\s+(?P<method>\w+)\s+(?:struct|interface)", "", r'^import\s+(?:\([^)]*\)|"[^"\n]*")'),
    "rust": Language((".rs",), ("/tests/", "_test.rs"), ("test_",), r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?:fn|struct|enum|trait)\s+(?P<name>\w+)|impl(?:<[^>{]*>)?\s+(?:[\w:<>,' &]+?\s+for\s+)?(?:&\s*(?:'\w+\s+)?)?(?:\w+::)*(?P<scope>\w+)", r"trait\s", r"^[ \t]*(?:pub\s+)?use\s[^;]*"),
}
KEYWORDS = frozenset("if for while switch match return catch function fn func class new await async sizeof typeof super".split())


def language_of(path: str) -> str | None:
    dot = path.rfind(".")
    return next((n for n, lang in LANGUAGES.items() if dot >= 0 and path[dot:] in lang.extensions), None)


def sha(tokens: list[str]) -> str:
    return "sha256:" + hashlib.sha256(" ".join(tokens).encode("utf-8")).hexdigest()


def is_test(path: str, name: str, lang: Language) -> bool:
    return any(m in path for m in lang.test_paths) or name.startswith(lang.test_names)


def names_a_test(path, name, language: str) -> Column:
    """As :func:`is_test`, as a column expression."""
    lang, out = LANGUAGES[language], F.lit(False)
    for m in lang.test_paths:
        out = out | F.contains(path, F.lit(m))
    for p in lang.test_names:
        out = out | F.startswith(name, F.lit(p))
    return out


def python_tokens(body: str) -> list[str]:
    """Tokens without comments and layout, block structure kept as markers."""
    skipped = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.ENCODING, tokenize.ENDMARKER}
    out = []
    for t in tokenize.generate_tokens(io.StringIO(body).readline):
        if t.type == tokenize.INDENT:
            out.append("<indent>")
        elif t.type == tokenize.DEDENT:
            out.append("<dedent>")
        elif t.type not in skipped:
            out.append(t.string)
    return out


def brace_tokens(body: str) -> list[str]:
    plain = re.sub(r'("(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`)|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", body, flags=re.S)
    return re.findall(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`|\w+|[^\w\s]', plain)


def _row(path, name, qualname, kind, test, start, end, body, tokens, calls) -> dict:
    mask = list(tokens)
    if name in mask:
        mask[mask.index(name)] = "<name>"
    return {"path": path, "name": name, "qualname": qualname, "kind": kind, "is_test": test, "start_line": start, "end_line": end, "signature": body.split("\n", 1)[0][:200], "body": body, "span_hash": sha(tokens), "body_hash": sha(mask), "calls": sorted(set(calls))}


def python_symbols(path: str, text: str) -> tuple[list[dict], list[str]]:
    import textwrap

    tree, lines, lang = ast.parse(text), text.split("\n"), LANGUAGES["python"]
    rows, imports = [], []
    define = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)

    def called(node) -> list[str]:
        out, stack = [], list(ast.iter_child_nodes(node))
        while stack:
            n = stack.pop()
            if isinstance(n, define):
                continue
            if isinstance(n, ast.Call):
                f = n.func
                out += [f.id] if isinstance(f, ast.Name) else [f.attr] if isinstance(f, ast.Attribute) else []
            stack += ast.iter_child_nodes(n)
        return out

    def visit(node, outer):
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.Import, ast.ImportFrom)):
                imports.append(" ".join((ast.get_source_segment(text, n) or "").split())[:200])
            elif isinstance(n, define):
                qual = f"{outer}.{n.name}" if outer else n.name
                body = "\n".join(lines[n.lineno - 1 : n.end_lineno])
                kind = "class" if isinstance(n, ast.ClassDef) else "function"
                rows.append(_row(path, n.name, qual, kind, is_test(path, n.name, lang), n.lineno, n.end_lineno, textwrap.dedent(body), python_tokens(textwrap.dedent(body)), called(n)))
                visit(n, qual)
            else:
                visit(n, outer)

    visit(tree, None)
    return rows, imports


# What holds braces and names that don't count, by language. A quote is a Rust character only
# if it closes behind one; else it begins a lifetime. A slash begins a TypeScript pattern only
# where no value can stand before it.
STRING, CHARACTER = r'"(?:\\.|[^"\\])*"', r"'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'"
COMMENT, QUOTED = r"//[^\n]*|/\*.*?\*/", r"""(?:"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"""
PATTERN = r"(?<=[=(,:!&|?{};\[])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\n])*\]|[^/\\\n\[])+/[a-z]*"
HIDDEN = {
    "rust": re.compile(rf'r(?P<h>#*)".*?"(?P=h)|{COMMENT}|{STRING}|{CHARACTER}', re.S),
    "go": re.compile(rf"{COMMENT}|{QUOTED}", re.S),
    "typescript": re.compile(rf"{COMMENT}|{QUOTED}|{PATTERN}", re.S),
}


def blanked(text: str, language: str) -> str:
    """Strings, patterns and comments as spaces, so that braces and names in them don't count."""
    return HIDDEN[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _close(plain: str, at: int) -> int:
    """End of the block or statement that begins at ``at``."""
    deep, i, n = 0, at, len(plain)
    while i < n:
        c = plain[i]
        if c == "{":
            deep += 1
        elif c == "}":
            deep -= 1
            if deep == 0:
                return i + 1
        elif c == ";" and deep == 0:
            return i + 1
        i += 1
    return n


def brace_symbols(path: str, text: str, language: str) -> tuple[list[dict], list[str]]:
    lang, plain = LANGUAGES[language], blanked(text, language)
    found = []
    for m in re.finditer(lang.declaration, plain, re.M):
        kind = "scope" if m.groupdict().get("scope") else "symbol"
        name = m.groupdict().get("name") or m.groupdict().get("method") or m.groupdict().get("scope")
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        found.append((start, _close(plain, m.end()), name, kind))
    rows = []
    for start, end, name, kind in found:
        if kind == "scope":
            continue
        around = [(s, e, n, k) for s, e, n, k in found if s < start and end <= e]
        # An impl block replaces what stands around it; symbols extend it.
        outer = ""
        for s, e, n, k in sorted(around):
            outer = n if k == "scope" or not outer else f"{outer}.{n}"
        inner = [(s, e) for s, e, _, k in found if s > start and e <= end and k == "symbol"]
        own = list(plain[start:end])
        for s, e in inner:
            own[s - start : e - start] = " " * (e - s)
        names = [c for c in re.findall(r"([A-Za-z_$][\w$]*)!?\s*\(", "".join(own)) if c not in KEYWORDS and c != name]
        line = text.count("\n", 0, start) + 1
        body = text[start:end]
        rows.append(_row(path, name, f"{outer}.{name}" if outer else name, "symbol", is_test(path, name, lang), line, line + body.count("\n"), body, brace_tokens(body), names))
    imports = [" ".join(m[0].split())[:200] for m in re.finditer(lang.imports, text, re.M)]
    return rows, imports


def symbols_of(path: str, text: str) -> tuple[list[dict], list[str]]:
    return parsed(path, text)[:2]


def parsed(path: str, text: str) -> tuple[list[dict], list[str], bool]:
    """Symbols, import statements, and whether a file of a known language couldn't be parsed."""
    language = language_of(path)
    if language is None or text is None:
        return [], [], False
    try:
        return *(python_symbols(path, text) if language == "python" else brace_symbols(path, text, language)), False
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError):
        return [], [], True


STATEMENTS = T.StructType(
    [
        T.StructField("src_path", T.StringType()), T.StructField("statement_id", T.IntegerType()), T.StructField("statement", T.StringType()), T.StructField("language", T.StringType()),
        T.StructField("candidates", T.ArrayType(T.StringType())), T.StructField("by_suffix", T.BooleanType()),
    ]
)


def parse_files(files: DataFrame) -> DataFrame:
    """(path, symbols, imports, failed) of ``files`` (path, content), each file parsed once."""
    out = T.StructType([T.StructField("path", T.StringType()), T.StructField("symbols", T.ArrayType(SYMBOLS)), T.StructField("imports", T.ArrayType(STATEMENTS)), T.StructField("failed", T.BooleanType())])
    kinds = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            paths, symbols, imports, failed = b.column("path").to_pylist(), [], [], []
            for p, t in zip(paths, b.column("content").to_pylist(), strict=True):
                found, statements, bad = parsed(p, t)
                lang = language_of(p)
                symbols.append(found)
                imports.append([dict(zip(STATEMENTS.names, (p, k, s, lang, import_candidates(p, lang, s), lang in ("python", "go")), strict=True)) for k, s in enumerate(statements)])
                failed.append(bad)
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds.field(i).type) for i, x in enumerate((paths, symbols, imports, failed))], schema=kinds)

    return files.select("path", "content").mapInArrow(run, out)


def parse_symbols(files: DataFrame) -> DataFrame:
    """Symbols of ``files`` (path, content), a row for each."""
    return parse_files(files).select(F.explode("symbols").alias("s")).select("s.*")


def parse_imports(files: DataFrame) -> DataFrame:
    """(src_path, statement_id, statement, language, candidates, by_suffix) of import statements."""
    return parse_files(files).select(F.explode("imports").alias("s")).select("s.*")


# What a module path may end in.
ENDINGS = {"python": (".py", "/__init__.py"), "typescript": (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"), "go": (".go",), "rust": (".rs", "/mod.rs")}


def import_candidates(path: str, language: str, statement: str) -> list[str]:
    """Repository paths that a statement may mean, normalised."""
    import posixpath

    here = posixpath.dirname(path)
    stems: list[str] = []
    if language == "python":
        try:
            nodes = ast.parse(statement).body
        except SyntaxError:
            nodes = []
        for n in nodes:
            if isinstance(n, ast.Import):
                stems += [a.name.replace(".", "/") for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                base = (n.module or "").replace(".", "/")
                if n.level:
                    base = posixpath.join(here, *[".."] * (n.level - 1), base)
                stems += [base, *(posixpath.join(base, a.name) for a in n.names if a.name != "*")]
    elif language == "typescript":
        m = re.search(r"""(?:from|import)\s*['"](\.[^'"]*)['"]""", statement)
        stems += [posixpath.join(here, m[1])] if m else []
    elif language == "go":
        stems += re.findall(r'"([^"\s]+)"', statement)
    elif language == "rust":
        m = re.match(r"(?:pub\s+)?use\s+(?:crate::|self::|super::)?([\w:]+)", statement)
        stems += [m[1].replace("::", "/"), posixpath.join(here, m[1].replace("::", "/"))] if m else []
    normal = [posixpath.normpath(s) for s in stems if s]
    return list(dict.fromkeys(c for s in normal if s != ".." and not s.startswith("../") for c in (s, *(s + e for e in ENDINGS[language]))))
