"""Symbols of one source file: a syntax tree for Python, masked-text scanners for the other languages.

Every extractor gives ``(kind, name, qualified, first line, last line, signature, docstring, text)`` tuples; ids and
hashes depend on the text and the qualified name alone. Extraction runs in Arrow batches over file tables.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ARTIFACT_CHARS, ARTIFACT_LEAVES, EXCERPT_BYTES
from .walk import ARTIFACT, CI_FILES, PARSER

Row = tuple[str, str, str, int, int, str | None, str | None, str]
SYMBOLS = (
    "file_path string, status string, language string, id string, kind string, name string, qualified_name string, module string, line_start int, line_end int, "
    "signature string, docstring string, content_hash string, body_excerpt string"
)
BRACE = {"typescript", "javascript", "go", "java", "csharp", "rust", "c", "cpp", "php"}


def language_for(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return PARSER.get(ext) or ARTIFACT.get(ext) or ("yaml" if any(p in name for p in CI_FILES) else None)


def normalize(text: str) -> str:
    for pattern in (r"(?s)/\*.*?\*/", r'(?s)""".*?"""', r"(?s)'''.*?'''", r"(//|#)[^\n]*"):
        text = re.sub(pattern, " ", text)
    return re.sub(r"\s+", " ", text).strip()


def content_hash(text: str) -> str:
    return hashlib.sha256(normalize(text).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def excerpt(text: str, most: int = EXCERPT_BYTES) -> str:
    return text.encode("utf-8", "surrogatepass")[:most].decode("utf-8", "ignore")


# ---- masked text

_MASK = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.S)


def mask(text: str, hash_comments: bool = False) -> str:
    """The text with comments and string contents blanked, all offsets and line breaks kept."""
    pattern = re.compile(_MASK.pattern + (r"|#[^\n]*" if hash_comments else ""), re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def close_of(masked: str, at: int, pair: str = "{}") -> int:
    """Offset just past the bracket that closes the one at ``at`` (or the end of the text)."""
    depth = 0
    for k in range(at, len(masked)):
        if masked[k] == pair[0]:
            depth += 1
        elif masked[k] == pair[1]:
            depth -= 1
            if not depth:
                return k + 1
    return len(masked)


# ---- Python


def python_symbols(text: str) -> tuple[list[Row], bool]:
    """Functions, classes with their methods, and upper-case constants at the top level; whether the text parses."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [], False
    lines = text.splitlines(keepends=True)

    def source(node) -> str:
        return "".join(lines[node.lineno - 1 : node.end_lineno]).rstrip("\n")

    def function(node, owner: str) -> Row:
        name = f"{owner}.{node.name}" if owner else node.name
        sign = f"def {node.name}({ast.unparse(node.args)})"
        return ("method" if owner else "function", node.name, name, node.lineno, node.end_lineno, sign, ast.get_docstring(node), source(node))

    out: list[Row] = []
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out.append(function(node, ""))
        elif isinstance(node, ast.ClassDef):
            out.append(("class", node.name, node.name, node.lineno, node.end_lineno, f"class {node.name}", ast.get_docstring(node), source(node)))
            out += [function(x, node.name) for x in node.body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)]
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name) and _caps(target.id):
                    out.append(("const", target.id, target.id, node.lineno, node.end_lineno, None, None, source(node)))
    return out, True


def _caps(name: str) -> bool:
    return len(name) >= 2 and name == name.upper() and any(c.isalpha() for c in name)


# ---- brace languages and Ruby

_WORD = r"[A-Za-z_$][\w$]*"
# Declaration heads per language, (kind, pattern); group 1 is the name.
_HEADS: dict[str, list[tuple[str, str]]] = {
    "typescript": [
        ("interface", rf"\binterface\s+({_WORD})"),
        ("class", rf"\bclass\s+({_WORD})"),
        ("function", rf"\bfunction\s*\*?\s*({_WORD})\s*[(<]"),
        ("arrow", rf"\b(?:const|let|var)\s+({_WORD})\s*(?::[^=;\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^={{;\n]+)?=>|{_WORD}\s*=>)"),
        ("const", r"\bconst\s+([A-Z][A-Z0-9_]+)\s*(?::[^=;\n]+)?="),
    ],
    "go": [("function", r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)\s*[(\[]"), ("class", r"\btype\s+(\w+)\s+struct\b"), ("interface", r"\btype\s+(\w+)\s+interface\b")],
    "java": [("class", r"\b(?:class|enum|record)\s+(\w+)"), ("interface", r"\binterface\s+(\w+)")],
    "csharp": [("class", r"\b(?:class|struct|enum|record)\s+(\w+)"), ("interface", r"\binterface\s+(\w+)")],
    "rust": [("function", r"\bfn\s+(\w+)"), ("class", r"\b(?:struct|enum)\s+(\w+)"), ("interface", r"\btrait\s+(\w+)"), ("scope", r"\bimpl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)")],
    "c": [("class", r"\b(?:struct|enum|union)\s+(\w+)\s*\{"), ("function", r"(?m)^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;{}]*\)\s*\{")],
    "php": [("interface", r"\binterface\s+(\w+)"), ("class", r"\b(?:class|trait)\s+(\w+)"), ("function", r"\bfunction\s+&?(\w+)\s*\(")],
    "ruby": [("class", r"(?m)^[ \t]*(?:class|module)\s+(\w+)"), ("function", r"(?m)^[ \t]*def\s+(?:self\.)?(\w+[?!]?)")],
}
_HEADS["javascript"], _HEADS["cpp"] = _HEADS["typescript"], _HEADS["c"] + [("scope", r"\bnamespace\s+(\w+)\s*\{")]
_METHOD = re.compile(rf"(?:^|[;{{}}\n])\s*(?:@\w+(?:\([^)]*\))?\s*)*((?:(?:public|private|protected|internal|static|async|override|virtual|abstract|final|readonly|get|set|synchronized|sealed|partial|extern|new)\s+)*(?:[\w<>\[\],.?]+\s+)*?)({_WORD})\s*(?:<[^>]*>)?\s*\(([^;{{}}]*?)\)[^;{{}}=]*\{{")
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "function", "do", "else", "try", "new", "foreach", "using", "lock"}


#: What opens or closes a Ruby block; the ``do`` of a loop head belongs to the loop.
_RUBY_BLOCK = re.compile(r"(?m)^[ \t]*(?:while|until|for)\b[^\n]*?(?:\bdo\b|$)|^[ \t]*(?:class|module|def|if|unless|case|begin)\b|\bdo\b|\bend\b")


def _end_of(language: str, masked: str, at: int) -> int:
    if language == "ruby":
        depth = 1  # of the head itself, whose name stands at ``at``
        for m in _RUBY_BLOCK.finditer(masked, at):
            depth += -1 if m[0].strip() == "end" else 1
            if not depth:
                return m.end()
        return len(masked)
    brace, semi = masked.find("{", at), masked.find(";", at)
    if brace < 0 or 0 <= semi < brace:
        return semi + 1 if semi >= 0 else (masked.find("\n", at) if masked.find("\n", at) >= 0 else len(masked))
    return close_of(masked, brace)


def _begin_of(masked: str, at: int) -> int:
    """Where the declaration that names something at ``at`` begins on its line."""
    begin = max(masked.rfind(c, 0, at) for c in "\n{};") + 1
    return begin + len(masked[begin:at]) - len(masked[begin:at].lstrip(" \t"))


def _signature(text: str) -> str:
    for stop, keep in (("{", ""), ("=>", " =>"), (";", "")):
        head, found, _ = text.partition(stop)
        if found:
            return re.sub(r"\s+", " ", head).strip()[:256] + keep
    return re.sub(r"\s+", " ", text.split("\n", 1)[0]).strip()[:256]


def _doc(text: str, at: int) -> str | None:
    """The comment that ends on the line before ``at``."""
    before = text[:at].rstrip()
    if before.endswith("*/"):
        return re.sub(r"(?m)^\s*\*+ ?", "", before[before.rfind("/*") + 2 : -2]).strip() or None
    taken = []
    for line in reversed(before.split("\n")):
        if not re.match(r"\s*(//|#)", line):
            break
        taken.append(re.sub(r"^\s*(?:/{2,}|#+) ?", "", line))
    return "\n".join(reversed(taken)).strip() or None


def scanned_symbols(text: str, language: str) -> tuple[list[Row], bool]:
    """Declarations by pattern over masked text, spans by bracket matching; whether brackets balance."""
    masked = mask(text, language in ("ruby", "php"))
    found: list[tuple[int, int, str, str]] = []
    for kind, pattern in _HEADS[language]:
        for m in re.finditer(pattern, masked):
            begin = _begin_of(masked, m.start(1))
            found.append((begin, _end_of(language, masked, m.start(1)), "function" if kind == "arrow" else kind, m[1]))
    owners = [(b, e, n) for b, e, k, n in found if k in ("class", "interface", "scope")]
    if language in ("typescript", "javascript", "java", "csharp", "cpp"):
        for b, e, owner in owners:
            brace = masked.find("{", b, e)
            if brace < 0:
                continue
            for m in _METHOD.finditer(masked, brace, e):
                if m[2] not in _NOT_METHODS and masked.count("{", brace, m.start(2)) - masked.count("}", brace, m.start(2)) == 1:
                    start = _begin_of(masked, m.start(2))
                    found.append((max(start, brace + 1), close_of(masked, m.end() - 1), "method", m[2]))
    rows: dict[tuple[int, str], Row] = {}
    flat = language in ("typescript", "javascript", "go")
    functions = [(b, e) for b, e, k, _ in found if k in ("function", "method")]
    for b, e, kind, name in sorted(found, key=lambda x: (x[0], -x[1])):
        if kind == "scope" or (flat and any(fb < b and e <= fe for fb, fe in functions)):
            continue
        around = [n for ob, oe, n in sorted(owners) if ob < b and e <= oe and not (ob == b and n == name)]
        if kind == "function" and around and language not in ("typescript", "javascript"):
            kind = "method"
        if language == "go" and kind == "function":
            receiver = re.match(r"func\s*\(\s*\w*\s*\*?\s*(\w+)", masked[b:e])
            if receiver:
                kind, around = "method", [receiver[1]]
        body = text[b:e]
        first = text.count("\n", 0, b) + 1
        rows.setdefault((b, name), (kind, name, ".".join([*around, name]), first, first + body.rstrip("\n").count("\n"), _signature(body), _doc(text, b), body))
    return list(rows.values()), masked.count("{") == masked.count("}") and masked.count("(") == masked.count(")")


# ---- artifacts


def markdown_symbols(text: str) -> list[Row]:
    """One symbol per ATX section outside fences, from its heading to the line before the next; a preamble first."""
    lines, heads, fence = text.split("\n"), [], None
    for k, line in enumerate(lines):
        mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if mark:
            fence = None if fence and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) else fence or mark[1]
        head = re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*#*[ \t]*$", line)
        if head and not fence and not mark:
            heads.append((k, (head[2] or "").strip() or f"section-{k + 1}"))
    out: list[Row] = []
    if not heads:
        return out
    stop = heads[0][0]
    if "".join(lines[:stop]).strip():
        out.append(("var", "preamble", "preamble", 1, stop, None, None, "\n".join(lines[:stop])))
    for (k, name), end in zip(heads, [*(h[0] for h in heads[1:]), len(lines)], strict=True):
        out.append(("var", name, name, k + 1, end, lines[k].strip(), None, "\n".join(lines[k:end])))
    return out


def _leaf(path: str, value: str, first: int, last: int) -> Row:
    return ("var", path, path, first, last, None, None, f"{path} {value[:ARTIFACT_CHARS]}".rstrip())


def _bare(value: str) -> str:
    """A YAML scalar without its comment and quotes; null is empty."""
    value = value.strip()
    quoted = re.match(r"""("(?:\\.|[^"\\])*"|'(?:''|[^'])*')\s*(?:#.*)?$""", value)
    if quoted:
        return quoted[1][1:-1]
    value = re.sub(r"(?:^|\s)#.*$", "", value).strip()
    return "" if value in ("null", "~") else value


def yaml_symbols(text: str) -> list[Row]:
    """One leaf per scalar: dotted keys, ``[i]`` for items. Flow collections and block scalars are scalars."""
    lines = [(k, len(x) - len(x.lstrip(" ")), x.strip()) for k, x in enumerate(text.split("\n"), 1) if x.strip() and not x.strip().startswith("#") and x.strip() not in ("---", "...")]
    out: list[Row] = []
    key = re.compile(r"""("[^"]*"|'[^']*'|[^\s#:\[\]{}"'][^:]*?)\s*:(?:\s+(.*)|$)""")

    def block(at: int, indent: int, path: str) -> int:
        item = 0
        while at < len(lines) and lines[at][1] == indent:
            n, _, content = lines[at]
            if content == "-" or content.startswith("- "):
                rest, here = content[1:].strip(), f"{path}[{item}]"
                item += 1
                inner = key.match(rest)
                if inner:
                    lines[at] = (n, indent + len(content) - len(content[1:].lstrip()), rest)
                    at = block(at, lines[at][1], here)
                elif rest:
                    out.append(_leaf(here, _bare(rest), n, n))
                    at += 1
                else:
                    at = block(at + 1, lines[at + 1][1], here) if at + 1 < len(lines) and lines[at + 1][1] > indent else at + 1
                continue
            found = key.match(content)
            if not found:
                return at
            name = found[1].strip("\"'")
            here, value = f"{path}.{name}" if path else name, (found[2] or "").strip()
            at += 1
            if re.fullmatch(r"[|>][+\-0-9]*", value):
                body, last = [], n
                while at < len(lines) and lines[at][1] > indent:
                    body.append(lines[at][2])
                    last = lines[at][0]
                    at += 1
                out.append(_leaf(here, "\n".join(body), n, last))
            elif _bare(value) or value:
                out.append(_leaf(here, _bare(value), n, n))
            elif at < len(lines) and lines[at][1] > indent:
                at = block(at, lines[at][1], here)
            else:
                out.append(_leaf(here, "", n, n))
                if at < len(lines) and lines[at][1] == indent and lines[at][2].startswith("-"):
                    return at  # a sequence at the key's own indent ends the mapping
        return at

    if lines:
        block(0, lines[0][1], "")
    return out


def _split_top(text: str, sep: str = ",") -> list[str]:
    out, depth, quote, now = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == sep and not depth:
            out.append(now)
            now = ""
            continue
        now += c
    return [*out, now]


def toml_symbols(text: str) -> list[Row]:
    """One leaf per value: table prefixes, arrays and inline tables split one level."""
    out: list[Row] = []
    prefix, counts, lines, k = "", {}, text.split("\n"), 0
    while k < len(lines):
        line, first = lines[k].strip(), k + 1
        k += 1
        if not line or line.startswith("#"):
            continue
        many, one = re.match(r"\[\[\s*([^\]]+?)\s*\]\]", line), re.match(r"\[\s*([^\]\[]+?)\s*\]", line)
        if many:
            n = counts[many[1]] = counts.get(many[1], -1) + 1
            prefix = f"{many[1]}[{n}]"
            continue
        if one:
            prefix = one[1]
            continue
        name, eq, value = line.partition("=")
        if not eq:
            continue
        while k < len(lines) and (mask(value, True).count("[") > mask(value, True).count("]") or value.count('"""') % 2 or value.count("'''") % 2):
            value += "\n" + lines[k]
            k += 1
        here = f"{prefix}.{name.strip()}" if prefix else name.strip()
        value = value.strip() if value.count('"""') or value.count("'''") else re.sub(r"\s+#[^\"'\n]*$", "", value).strip()
        inner = value[1:-1].strip() if value[:1] in "[{" and value[-1:] in "]}" else ""
        if value.startswith("[") and inner:
            for i, part in enumerate(p for p in _split_top(inner) if p.strip()):
                out.append(_leaf(f"{here}[{i}]", part.strip().strip("\"'"), first, k))
        elif value.startswith("{") and inner:
            for part in _split_top(inner):
                sub, _, v = part.partition("=")
                out.append(_leaf(f"{here}.{sub.strip()}", v.strip().strip("\"'"), first, k))
        else:
            out.append(_leaf(here, "" if value in ("[]", "{}") else re.sub(r"^(\"\"\"|'''|\"|')|(\"\"\"|'''|\"|')$", "", value), first, k))
    return out


# Words that open a table constraint.
_CONSTRAINTS = {"primary", "foreign", "constraint", "unique", "check", "key", "index", "fulltext", "spatial", "exclude"}
_CREATE = re.compile(r"""\bcreate\s+(?:or\s+replace\s+)?(?:global\s+|local\s+)?(?:temp(?:orary)?\s+|unlogged\s+)?table\s+(?:if\s+not\s+exists\s+)?((?:["`\[]?\w+["`\]]?\s*\.\s*)*["`\[]?\w+["`\]]?)\s*\(""", re.I)


def sql_symbols(text: str) -> list[Row]:
    """Tables of ``CREATE TABLE`` with a column list, and their columns."""
    plain = re.sub(r"--[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    out: list[Row] = []
    for m in _CREATE.finditer(plain):
        name = re.split(r"\s*\.\s*", m[1])[-1].strip('"`[]')
        end = close_of(plain, m.end() - 1, "()")
        first, columns = plain.count("\n", 0, m.start()) + 1, []
        at = m.end()
        for part in _split_top(plain[m.end() : end - 1]):
            head = re.match(r"""\s*(["`\[]?)(\w+)""", part)
            if head and (head[1] or head[2].lower() not in _CONSTRAINTS):
                columns.append((head[2], plain.count("\n", 0, at + head.start(2)) + 1, part.strip()))
            at += len(part) + 1
        table = f"table {name} ({', '.join(c for c, _, _ in columns)})"
        out.append(("class", name, name, first, plain.count("\n", 0, end) + 1, table, None, table))
        out += [("var", c, f"{name}.{c}", line, line, None, None, f"{name}.{c} {body}") for c, line, body in columns]
    return out


def html_symbols(text: str) -> list[Row]:
    """Routes: distinct slash-led attribute values and script literals; named functions of inline scripts."""
    routes: dict[str, int] = {}
    out: list[Row] = []
    outside = re.sub(r"(?is)<script\b[^>]*>(.*?)</script\s*>", lambda m: m[0].replace(m[1], re.sub(r"[^\n]", " ", m[1])) if m[1] else m[0], text)
    for m in re.finditer(r"""=\s*(?:"([^"]*)"|'([^']*)')""", outside):
        value = m[1] if m[1] is not None else m[2]
        if value.startswith("/"):
            routes.setdefault(value, text.count("\n", 0, m.start()) + 1)
    for block in re.finditer(r"(?is)<script\b[^>]*>(.*?)</script\s*>", text):
        js, base = block[1], text.count("\n", 0, block.start(1))
        for m in re.finditer(r"""//[^\n]*|/\*.*?\*/|"((?:\\.|[^"\\\n])*)"|'((?:\\.|[^'\\\n])*)'|`((?:\\.|[^`\\])*)`""", js, re.S):
            value = next((g for g in m.groups() if g is not None), "")
            if value.startswith("/"):
                routes.setdefault(value, base + js.count("\n", 0, m.start()) + 1)
        clean = mask(js)
        for m in re.finditer(rf"\bfunction\s*\*?\s*({_WORD})\s*\(", clean):
            end = close_of(clean, clean.find("{", m.end())) if clean.find("{", m.end()) >= 0 else m.end()
            first = base + js.count("\n", 0, m.start()) + 1
            out.append(("function", m[1], m[1], first, first + js.count("\n", m.start(), end), f"function {m[1]}", None, js[m.start() : end]))
    return [("route", r, r, line, line, None, None, r) for r, line in routes.items()] + out


# ---- dispatch


def _fallback(path: str, text: str) -> list[Row]:
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return [("module", stem, stem, 1, max(1, text.count("\n") + (not text.endswith("\n"))), None, None, text)]


def parse_source(path: str, text: str) -> tuple[list[Row], str, str]:
    """``rows, status, language`` of one file; never raises. Empty text is ok with no symbol."""
    language = language_for(path)
    if not text.strip():
        return [], "ok", language or "text"
    if language in ARTIFACT.values():
        make = {"markdown": markdown_symbols, "yaml": yaml_symbols, "toml": toml_symbols, "sql": sql_symbols, "html": html_symbols}[language]
        try:
            rows = make(text)
        except (RecursionError, IndexError):
            rows = []
        if not rows or (language in ("yaml", "toml") and len(rows) > ARTIFACT_LEAVES):
            rows = _fallback(path, text)
        return rows, "ok", language
    if language is None:
        return _fallback(path, text), "failed", "text"
    rows, clean = python_symbols(text) if language == "python" else scanned_symbols(text, language)
    if rows:
        return rows, "ok" if clean else "partial", language
    return ([], "partial", language) if clean else (_fallback(path, text), "failed", language)


def symbol_rows(path: str, data: bytes | None) -> list[dict]:
    """Symbol rows of one file, and a row without an id that carries its status. Bad UTF-8 fails the file."""
    base = {"file_path": path, "language": language_for(path) or "text"}
    try:
        text = (data or b"").decode("utf-8")
    except UnicodeDecodeError:
        return [base | {"status": "failed"}]
    rows, status, language = parse_source(path, text)
    keep = rows if status != "failed" else []  # text fallbacks of code are dropped, those of artifacts stay
    module = re.sub(r"([^/])\.[^./]*$", r"\1", path.replace("\\", "/"))
    out = [base | {"status": status, "language": language}]
    for kind, name, qual, first, last, sign, doc, body in keep:
        qualified, digest = f"{language}:{path}:{qual}", content_hash(body)
        out.append(
            {"file_path": path, "status": status, "language": language, "id": f"{qualified}@{digest}", "kind": kind, "name": name, "qualified_name": qualified, "module": module,
             "line_start": first, "line_end": max(first, last), "signature": sign, "docstring": doc, "content_hash": digest, "body_excerpt": excerpt(body)}
        )
    return out


_KINDS = {"string": pa.string(), "int": pa.int32()}
_ARROW = pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in SYMBOLS.split(", "))])


#: A batch of results ends at so many rows, or at so many bytes of the files they come from.
_BATCH_ROWS, _BATCH_BYTES = 4_000, 4_000_000


def symbol_batches(files: Iterator[tuple[str, bytes | None]]) -> Iterator[pa.RecordBatch]:
    """Rows of many files a batch, as a batch costs more than parsing a small file."""
    rows, held = [], 0
    for path, content in files:
        rows += symbol_rows(path, content)
        held += len(content or b"")
        if len(rows) >= _BATCH_ROWS or held >= _BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def extract_symbols(files: DataFrame) -> DataFrame:
    """Parse ``files(path, content)``: one status row a file (null id) and one row a symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from symbol_batches(pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, SYMBOLS)
