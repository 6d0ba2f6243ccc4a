"""Static analysis of symbol bodies and its propagation over call graphs.

Bodies are summarised row by row in Arrow batches. Propagation needs strongly connected components in reverse
topological order, which is sequential per component: it runs grouped, one weakly connected component a group, or on a
driver-local subgraph of at most 96 symbols.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import algebra as A
from ..schema import CALLABLE_KINDS
from ..sources.extract import close_of, language_for, mask

# Names of calls with a known cost.
HIGHER_ORDER = {"map", "forEach", "filter", "reduce", "flatMap", "Select", "Where", "each"}
SCANS = {"find", "findIndex", "includes", "indexOf", "contains", "Contains", "Any", "FirstOrDefault", "count"}
SORTS = {"sort", "sorted", "Slice", "OrderBy", "sort_by"}
CLONES = {"clone", "deepcopy", "structuredClone", "to_vec", "to_owned"}
GROWTH = {"push", "append", "insert", "put", "Add"}
CHAIN = (".map(", ".filter(", ".slice(", ".concat(")
INDEX_HELPERS = ("index", "map", "by_id", "lookup", "cache", "hydrate")
BATCH_HELPERS = ("batch", "bulk", "many", "hydrate_ids", "all")
CONCAT_MARKS = ('"', "'", "str", "html", "out", "buf", "res")
IO_LABELS = {"database_query": "database_query", "network_rpc": "network_rpc", "filesystem_blocking": "filesystem_blocking", "sequential_await_in_loop": "sequential_await_in_loop"}


@dataclass
class Summary:
    local_time: A.Cls = A.CONSTANT
    local_space: A.Cls = A.CONSTANT
    max_loop_depth: int = 0
    cyclomatic: int = 1
    cognitive: int = 0
    sites: dict[str, dict] = field(default_factory=dict)
    io: list[tuple[str, int, int]] = field(default_factory=list)
    patterns: list[dict] = field(default_factory=list)
    memo: bool = False
    recursive: bool = False


class _Walk:
    """Shared state of a body's walk; loops are a stack of classes, constant ones without depth."""

    def __init__(self, name: str, text: str, line: int):
        self.name, self.text, self.first = name, text, line
        self.out = Summary(memo=any(m in text for m in A.MEMO_MARKS))
        self.loops: list[A.Cls] = []

    @property
    def depth(self) -> int:
        return sum(c.kind != "constant" for c in self.loops)

    def product(self) -> A.Cls:
        out = A.CONSTANT
        for c in self.loops:
            out = A.nest_mul(out, c)
        return out

    def time(self, c: A.Cls) -> None:
        self.out.local_time = A.seq_max(self.out.local_time, c)

    def space(self, c: A.Cls) -> None:
        self.out.local_space = A.seq_max(self.out.local_space, c)

    def enter(self, bound: A.Cls) -> None:
        self.loops.append(bound)
        self.out.max_loop_depth = max(self.out.max_loop_depth, self.depth)
        self.time(self.product())

    def pattern(self, kind: str, what: str, line: int, receiver: str | None = None) -> None:
        self.out.patterns.append({"kind": kind, "what": what, "line": line, "depth": self.depth, "receiver": receiver})

    def concat(self, text: str, line: int) -> None:
        if self.depth and "+=" in text and any(m in text for m in CONCAT_MARKS):
            self.pattern("string_concat_in_loop", text.split("+=")[0].strip() or "str", line)
            self.time(A.nest_mul(self.product(), A.LINEAR))

    def membership(self, right: str, line: int) -> None:
        if self.depth and not right.startswith("{") and not any(m in right for m in ("set", "dict", "map")):
            self.pattern("linear_scan_in_loop", "in", line, right)
            self.time(A.nest_mul(self.product(), A.LINEAR))

    def wait(self, line: int) -> None:
        if self.depth and ("sequential_await_in_loop", line) not in {(k, n) for k, n, _ in self.out.io}:
            self.out.io.append(("sequential_await_in_loop", line, self.depth))

    def call(self, callee: str, args: str, line: int, body) -> None:
        """One call; ``body`` walks its arguments, inside a loop of its own for higher-order methods."""
        callee = callee.strip()
        receiver, _, bare = callee.rpartition("." if "." in callee else "::")
        bare = bare.strip()
        full = f"{callee}({args}"
        chained = sum(full.count(m) for m in CHAIN)
        if chained >= 3:
            self.out.patterns.append({"kind": "chained_allocation", "what": callee[:60], "line": line, "depth": chained, "receiver": None})
            self.space(A.LINEAR)
        loops = bool(receiver) and bare in HIGHER_ORDER
        if loops:
            self.enter(A.LINEAR)
        depth, product = self.depth, self.product()
        if bare in SCANS:
            self.time(A.nest_mul(product, A.LINEAR))
            if depth:
                self.pattern("linear_scan_in_loop", bare, line, receiver or None)
        if bare in SORTS:
            self.time(A.nest_mul(product, A.N_LOG_N))
            if depth:
                self.pattern("sort_in_loop", bare, line)
        if depth and bare in CLONES:
            self.pattern("clone_in_loop", bare, line)
            self.space(A.nest_mul(product, A.LINEAR))
        if depth and bare in GROWTH:
            self.space(product)
        if depth:
            kind = io_kind(bare, callee, full)
            if kind:
                self.out.io.append((kind, line, depth))
        if re.fullmatch(r"[A-Za-z0-9_$]+", bare) and not loops:
            if bare == self.name:
                self.out.recursive = True
            site = self.out.sites.setdefault(bare, {"line": line, "depth": depth, "calls": 0, "reduction": "none"})
            site["calls"] = min(site["calls"] + 1, 65535)
            if depth > site["depth"]:
                site.update(depth=depth, line=line)
            if site["reduction"] == "none":
                site["reduction"] = reduction(args)
        body()
        if loops:
            self.loops.pop()


def reduction(args: str) -> str:
    if any(m in args for m in A.HALVING):
        return "halving"
    return "decrement" if any(m in args for m in A.DECREMENT) else "none"


def io_kind(bare: str, callee: str, full: str) -> str | None:
    low = full.lower()
    if bare in A.DATABASE_NAMES or any(m in callee for m in A.DATABASE_CALLEES) or any(m in low for m in A.DATABASE_TEXTS):
        return "database_query"
    if bare == "fetch" or (bare in A.NETWORK_NAMES and any(m in callee for m in A.NETWORK_CALLEES)):
        return "network_rpc"
    return "filesystem_blocking" if bare in A.FILE_NAMES or callee.startswith("fs.") else None


def loop_bound(header: str, text: str) -> A.Cls:
    """Class of one loop from its first line and its whole text: logarithmic step, root bound, small range, linear."""
    if any(m in text for m in ("*= 2", "/= 2", "//= 2", ">>= 1", "<<= 1")) or ("while" in header and ("mid =" in text or "mid :=" in text)):
        return A.logarithmic(1)
    if any(m in header for m in ("* i <=", "*i <=", "sqrt(", "isqrt(")):
        return A.SQRT
    small = re.search(r"range\(\s*(\d+)\s*\)", header)
    return A.CONSTANT if small and int(small[1]) <= 256 else A.LINEAR


class _Python(_Walk):
    def run(self) -> Summary:
        lines = self.text.split("\n")
        pad = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
        tree = ast.parse("\n".join(x[pad:] for x in lines))
        self.source = "\n".join(x[pad:] for x in lines)
        for node in tree.body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                for x in node.body:
                    self.visit(x, 0)
            else:
                self.visit(node, 0)
        return self.out

    def segment(self, node) -> str:
        return ast.get_source_segment(self.source, node) or ""

    def visit(self, node, nesting: int) -> None:
        line = self.first + getattr(node, "lineno", 1) - 1
        if isinstance(node, ast.For | ast.AsyncFor | ast.While | ast.ListComp | ast.SetComp | ast.DictComp | ast.GeneratorExp):
            text = self.segment(node)
            self.out.cyclomatic += 1
            self.out.cognitive += 1 + nesting
            self.enter(loop_bound(text.split("\n", 1)[0], text))
            for x in ast.iter_child_nodes(node):
                self.visit(x, nesting + 1)
            self.loops.pop()
            return
        if isinstance(node, ast.If | ast.IfExp | ast.ExceptHandler | ast.match_case):
            branch = not isinstance(node, ast.ExceptHandler)
            self.out.cyclomatic += branch
            self.out.cognitive += (1 + nesting) * branch
            for x in ast.iter_child_nodes(node):
                self.visit(x, nesting + branch)
            return
        if isinstance(node, ast.Await):
            self.wait(line)
        if isinstance(node, ast.AugAssign):
            self.concat(self.segment(node), line)
        if isinstance(node, ast.Compare) and any(isinstance(o, ast.In) for o in node.ops):
            self.membership(self.segment(node).split(" in ", 1)[-1].strip(), line)
        if isinstance(node, ast.Call):
            args = self.segment(node)[len(self.segment(node.func)) :].lstrip("(")
            self.call(self.segment(node.func), args, line, lambda: [self.visit(x, nesting) for x in ast.iter_child_nodes(node)])
            return
        for x in ast.iter_child_nodes(node):
            self.visit(x, nesting)


_NODE = re.compile(r"\b(for|foreach|while|do|loop|if|case|catch|await)\b|([A-Za-z_$][\w$]*(?:\s*(?:\.|::|\?\.)\s*[A-Za-z_$][\w$]*)*)\s*\(|([\w.\[\]$]+\s*\+=[^;\n]*)")


class _Brace(_Walk):
    """Loops, branches and calls of brace languages, found on masked text."""

    def run(self, steps_concat: bool) -> Summary:
        self.masked, self.steps_concat = mask(self.text), steps_concat
        start = self.masked.find("{") + 1
        arrow = self.masked.find("=>")
        self.scan(start if start else arrow + 2 if arrow >= 0 else 0, len(self.text), 0)
        return self.out

    def line(self, at: int) -> int:
        return self.first + self.text.count("\n", 0, at)

    def statement_end(self, at: int) -> int:
        """End of the statement that begins at ``at``: a block, or up to its semicolon."""
        k = at
        while k < len(self.masked) and self.masked[k].isspace():
            k += 1
        if k < len(self.masked) and self.masked[k] == "{":
            return close_of(self.masked, k)
        semi, depth = k, 0
        while semi < len(self.masked):
            c = self.masked[semi]
            depth += c in "([{"
            depth -= c in ")]}"
            if depth < 0 or (c == ";" and not depth):
                return semi + (c == ";")
            if c == "}" and not depth:
                return semi + 1
            semi += 1
        return semi

    def scan(self, at: int, end: int, nesting: int) -> None:
        while at < end:
            m = _NODE.search(self.masked, at, end)
            if not m:
                return
            at = m.end()
            word = m[1]
            if word in ("for", "foreach", "while", "do", "loop"):
                head = self.masked.find("(", m.end())
                paren = head >= 0 and not self.masked[m.end() : head].strip()
                begin = close_of(self.masked, head, "()") if paren else max(m.end(), self.masked.find("{", m.end()))
                if word == "while" and not self.masked[begin:end].lstrip().startswith("{") and self.masked[begin:end].lstrip()[:1] == ";":
                    at = begin  # the tail of a do-while
                    continue
                stop = min(end, self.statement_end(begin))
                text = self.text[m.start() : stop]
                self.out.cyclomatic += 1
                self.out.cognitive += 1 + nesting
                self.enter(loop_bound(text.split("\n", 1)[0], text))
                if paren:
                    self.scan(head + 1, begin - 1, nesting + 1)
                self.scan(begin, stop, nesting + 1)
                self.loops.pop()
                at = stop
            elif word in ("if", "case", "catch"):
                head = self.masked.find("(", m.end())
                paren = head >= 0 and not self.masked[m.end() : head].strip()
                begin = close_of(self.masked, head, "()") if paren else m.end()
                self.out.cyclomatic += 1
                self.out.cognitive += 1 + nesting
                if paren:
                    self.scan(head + 1, begin - 1, nesting + 1)
                if word != "case":
                    stop = min(end, self.statement_end(begin))
                    self.scan(begin, stop, nesting + 1)
                    at = stop
            elif word == "await":
                self.wait(self.line(m.start()))
            elif m[2]:
                close = close_of(self.masked, m.end() - 1, "()")
                args = self.text[m.end() : close - 1]
                self.call(re.sub(r"\s+", "", m[2]).replace("?.", "."), args, self.line(m.start()), lambda a=m.end(), b=close - 1, n=nesting: self.scan(a, min(b, end), n))
                at = close
            elif m[3] and self.steps_concat:
                self.concat(self.text[m.start(3) : m.end(3)], self.line(m.start(3)))
                at = m.start(3) + m[3].find("+=") + 2


def _lexical(walk: _Walk) -> Summary:
    """Line-prefix scan for texts without a parser: loops nest and never close."""
    depth = 0
    for k, raw in enumerate(walk.text.split("\n")):
        line = raw.strip()
        if line.startswith(("for ", "for(", "while ", "while(")):
            depth = min(depth + 1, 255)
            walk.out.max_loop_depth = max(walk.out.max_loop_depth, depth)
            walk.time(A.poly(depth))
        if depth and any(m in line for m in (".find(", ".includes(", ".indexOf(")):
            walk.time(A.poly(depth + 1))
            walk.out.patterns.append({"kind": "linear_scan_in_loop", "what": "find/includes", "line": walk.first + k, "depth": depth, "receiver": None})
    return walk.out


def summarize(kind: str, name: str, path: str, line: int, text: str | None, fix_js_concat: bool = False) -> Summary:
    """Local summary of one symbol; only callables with a body have one. ``+=`` in JavaScript counts only on request."""
    if kind not in CALLABLE_KINDS or not (text or "").strip():
        return Summary()
    language = language_for(path)
    if language == "python":
        try:
            return _Python(name, text, line).run()
        except (SyntaxError, ValueError):
            return _lexical(_Walk(name, text, line))
    if language in ("typescript", "javascript"):
        return _Brace(name, text, line).run(fix_js_concat)
    if language in ("go", "java", "csharp", "rust", "c", "cpp", "php"):
        return _Brace(name, text, line).run(True)
    return _lexical(_Walk(name, text, line))


SUMMARY = (
    "symbol_id string, local_time string, local_space string, max_loop_depth int, cyclomatic int, cognitive int, n_call_sites int, io_effects string, patterns string, memo boolean, recursive boolean"
)


def summaries(symbols: DataFrame) -> DataFrame:
    """One row of local measures a symbol, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                s = summarize(r.kind, r.name, r.file_path, int(r.line_start), r.body_excerpt)
                rows.append((r.id, A.notation_of(s.local_time), A.notation_of(s.local_space), s.max_loop_depth, s.cyclomatic, s.cognitive, len(s.sites), json.dumps(s.io), json.dumps(s.patterns), s.memo, s.recursive))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SUMMARY.split(", ")])

    return symbols.select("id", "kind", "name", "file_path", "line_start", "body_excerpt").mapInPandas(run, SUMMARY)


def components(n: int, out: list[list[int]]) -> list[list[int]]:
    """Strongly connected components, callees before callers, without recursion."""
    index, low, on, stack, found, clock = [-1] * n, [0] * n, [False] * n, [], [], 0
    for root in range(n):
        if index[root] >= 0:
            continue
        todo = [(root, 0)]
        while todo:
            u, k = todo.pop()
            if k == 0:
                index[u] = low[u] = clock
                clock += 1
                stack.append(u)
                on[u] = True
            descended = False
            for j in range(k, len(out[u])):
                v = out[u][j]
                if index[v] < 0:
                    todo += [(u, j + 1), (v, 0)]
                    descended = True
                    break
                if on[v]:
                    low[u] = min(low[u], index[v])
            if descended:
                continue
            if low[u] == index[u]:
                group = []
                while True:
                    w = stack.pop()
                    on[w] = False
                    group.append(w)
                    if w == u:
                        break
                found.append(group)
            if todo:
                p = todo[-1][0]
                low[p] = min(low[p], low[u])
    return found


@dataclass
class Report:
    symbol_id: str
    qualified_name: str
    kind: str
    file_path: str
    line_start: int
    line_end: int
    local_time: str
    propagated_time: str
    space_complexity: str
    effective_degree: float
    risk_score: float
    max_loop_depth: int
    cyclomatic: int
    cognitive: int
    recursion_kind: str
    io_in_loop: list[str]
    bottleneck_chain: list[dict]
    advisories: list[dict]

    def row(self) -> dict:
        return asdict(self)


def _where(s: dict) -> str:
    return f"{s['qualified_name']} ({s['file_path']}:{s['line_start']})"


def _helper(symbols: list[dict], module: str, marks: tuple[str, ...]) -> str | None:
    return next((_where(s) for s in symbols if s["module"] == module and any(m in s["name"].lower() for m in marks)), None)


def propagate(symbols: list[dict], edges: list[dict], overrides: dict[str, str] | None = None) -> tuple[dict[str, Report], dict[tuple[str, str], int]]:
    """Reports of all symbols and loop depths of call edges, for one bounded graph."""
    overrides = overrides or {}
    at = {s["id"]: k for k, s in enumerate(symbols)}
    local = [summarize(s["kind"], s["name"], s["file_path"], s["line_start"], overrides.get(s["id"], s.get("body_excerpt"))) for s in symbols]
    calls: list[list[tuple[int, int, int, int, str]]] = [[] for _ in symbols]
    depths: dict[tuple[str, str], int] = {}
    for e in edges:
        if e["kind"] != "calls" or e.get("dst_missing") or e["src_id"] not in at or e["dst_id"] not in at:
            continue
        u, v = at[e["src_id"]], at[e["dst_id"]]
        site = local[u].sites.get(symbols[v]["name"], {})
        depth = max(e.get("loop_depth") or 0, site.get("depth", 0))
        depths[e["src_id"], e["dst_id"]] = depth
        calls[u].append((v, depth, site.get("calls", 1), site.get("line", symbols[u]["line_start"]), site.get("reduction", "none")))
    for u, s in enumerate(symbols):
        own = local[u].sites.get(s["name"])
        if local[u].recursive and own and not any(c[0] == u for c in calls[u]):
            calls[u].append((u, own["depth"], own["calls"], own["line"], own["reduction"]))

    n = len(symbols)
    time, space = [A.CONSTANT] * n, [A.CONSTANT] * n
    recursion, dominant, io = ["none"] * n, [None] * n, [None] * n
    for group in components(n, [[c[0] for c in row] for row in calls]):
        inside = set(group)
        if len(group) > 1 or any(c[0] == group[0] for c in calls[group[0]]):
            cycle = [c for u in group for c in calls[u] if c[0] in inside]
            shrink = next((c[4] for c in cycle if c[4] != "none"), "none")
            work = A.CONSTANT
            for u in group:
                work = A.seq_max(work, local[u].local_time)
            branches, looped = sum(c[2] for c in cycle), max((c[1] for c in cycle), default=0)
            halves, memo = shrink == "halving", any(local[u].memo for u in group)
            if not memo and (branches >= 2 or looped > 0):
                cost = A.seq_max(A.N_LOG_N, work) if halves else A.exponential(min(8, max(2, branches)))
            else:
                cost = A.nest_mul(A.logarithmic(1) if halves else A.LINEAR, work)
            for u in group:
                recursion[u] = "mutual_recursion" if len(group) > 1 else "direct_recursion"
                time[u], space[u] = cost, A.logarithmic(1) if halves else A.LINEAR
        for u in group:
            best, room = A.seq_max(time[u], local[u].local_time), A.seq_max(space[u], local[u].local_space)
            if local[u].io:
                io[u] = (local[u].io[0][0], u, local[u].io[0][1])
            for v, depth, _, line, _ in calls[u]:
                if v in inside:
                    continue
                induced = A.nest_mul(A.poly(depth), time[v])
                if A.degree_of(induced) > A.degree_of(best) or (A.degree_of(induced) >= 2.0 and dominant[u] is None):
                    best, dominant[u] = A.seq_max(best, induced), (v, depth, line)
                room = A.seq_max(room, space[v])
                if depth > 0 and io[u] is None:
                    if io[v]:
                        io[u] = io[v]
                    elif any(m in (symbols[v].get("body_excerpt") or "").lower() for m in A.DIRECT_IO):
                        io[u] = ("database_query", v, symbols[v]["line_start"])
            time[u], space[u] = best, room

    reports = {}
    for u, s in enumerate(symbols):
        chain, seen, k = [_step(s, s["line_start"], local[u].local_time, 0, time[u])], {u}, u
        while dominant[k] and len(chain) < 6:
            v, depth, line = dominant[k]
            if v in seen:
                break
            seen.add(v)
            chain.append(_step(symbols[v], line, local[v].local_time, depth, time[v]))
            k = v
        labels = [f"{k} (line {line}, loop depth {d})" for k, line, d in local[u].io]
        if io[u] and io[u][1] != u:
            labels.append(f"transitive_{io[u][0]} via `{symbols[io[u][1]]['qualified_name']}` ({symbols[io[u][1]]['file_path']}:{io[u][2]})")
        risk = 0.45 * A.risk_of(time[u]) + 0.30 * bool(local[u].io or io[u]) + 0.15 * min(local[u].cognitive / 25.0, 1.0) + 0.10 * (recursion[u] != "none")
        reports[s["id"]] = Report(
            s["id"], s["qualified_name"], s["kind"], s["file_path"], s["line_start"], s["line_end"], A.notation_of(local[u].local_time), A.notation_of(time[u]),
            A.notation_of(space[u]), A.degree_of(time[u]), min(1.0, max(0.0, risk)), local[u].max_loop_depth, local[u].cyclomatic, local[u].cognitive, recursion[u], labels, chain,
            advise(symbols, u, local[u], time[u], recursion[u], dominant[u], io[u]),
        )
    return reports, depths


def _step(s: dict, line: int, local: A.Cls, depth: int, total: A.Cls) -> dict:
    return {
        "symbol_id": s["id"], "qualified_name": s["qualified_name"], "file_path": s["file_path"], "line": line, "local_contribution": A.notation_of(local),
        "call_loop_multiplier": A.notation_of(A.poly(depth)), "cumulative_complexity": A.notation_of(total),
    }


# Advice per finding: (rule, title, severity, target complexity).
RULES = {
    "linear_scan_in_loop": ("OPT-001", "Linear Collection Scan Inside Loop", "high", "O(n)"),
    "hidden_quadratic": ("OPT-001", "Cross-Function Hidden Quadratic Bottleneck", "high", "O(n)"),
    "n_plus_one": ("OPT-002", "N+1 Query / Network Call Inside Loop", "critical", "O(1) batched I/O round-trip"),
    "filesystem_blocking": ("OPT-002", "Blocking Filesystem I/O Inside Loop", "high", "O(1) buffered/cached read"),
    "transitive_io": ("OPT-002", "Transitive N+1 I/O Across Function Boundary", "critical", "O(1) batched I/O"),
    "sequential_await_in_loop": ("OPT-003", "Sequential `await` Inside Loop", "high", "O(latency) concurrent execution"),
    "string_concat_in_loop": ("OPT-004", "Quadratic String/Array Concatenation in Loop", "medium", "O(n)"),
    "sort_in_loop": ("OPT-005", "Redundant Sorting Inside Loop", "high", "O(n log n)"),
    "clone_in_loop": ("OPT-005", "Heap Deep-Clone Inside Hot Loop", "medium", "O(n) time, O(1) allocs"),
    "exponential": ("OPT-006", "Unmemoized Exponential Branching Recursion", "critical", "O(n) with Memoization / DP"),
    "chained_allocation": ("OPT-007", "Multi-Pass Eager Array Allocation Chain", "low", "O(1) intermediate space"),
}


def advise(symbols: list[dict], u: int, local: Summary, time: A.Cls, recursion: str, dominant, io) -> list[dict]:
    s, out = symbols[u], []

    def add(finding: str, line: int, problem: str, current: str | None = None, severity: str | None = None, asset: str | None = None) -> None:
        rule, title, usual, target = RULES[finding]
        out.append(
            {"rule_id": rule, "title": title, "severity": severity or usual, "symbol_id": s["id"], "hotspot_line": line, "current_complexity": current or A.notation_of(time),
             "target_complexity": target, "problem": problem, "repo_asset_ref": asset}
        )

    for p in local.patterns:
        what = f"{p['receiver'] or 'collection'}.{p['what']}" if p["kind"] == "linear_scan_in_loop" else p["what"]
        asset = _helper(symbols, s["module"], INDEX_HELPERS) if p["kind"] == "linear_scan_in_loop" else None
        current = f"{p['depth']}x O(n) space" if p["kind"] == "chained_allocation" else None
        severe = "critical" if p["kind"] == "linear_scan_in_loop" and p["depth"] >= 2 else None
        add(p["kind"], p["line"], f"`{what}` at line {p['line']}, depth {p['depth']}", current, severe, asset)
    degree = A.degree_of(time)
    if dominant and dominant[1] > 0 and degree >= 2.0:
        callee = symbols[dominant[0]]
        asset = _helper(symbols, callee["module"], INDEX_HELPERS) or _helper(symbols, s["module"], INDEX_HELPERS)
        add("hidden_quadratic", dominant[2], f"calls {_where(callee)} at loop depth {dominant[1]}", severity="critical" if degree >= 3.0 else None, asset=asset)
    for kind, line, depth in local.io:
        finding = "n_plus_one" if kind in ("database_query", "network_rpc") else kind
        asset = _helper(symbols, s["module"], BATCH_HELPERS) if finding == "n_plus_one" else None
        add(finding, line, f"{kind} at line {line}, loop depth {depth}", f"O(n) at loop depth {depth}", asset=asset)
    if io and io[1] != u:
        callee = symbols[io[1]]
        add("transitive_io", s["line_start"], f"{io[0]} in {_where(callee)}", "O(n) transitive I/O calls", asset=_helper(symbols, callee["module"], BATCH_HELPERS))
    if recursion != "none" and time.kind == "exponential":
        add("exponential", s["line_start"], f"{recursion} without a memo")
    return out


REPORT = (
    "symbol_id string, qualified_name string, kind string, file_path string, line_start int, line_end int, local_time string, propagated_time string, space_complexity string, "
    "effective_degree double, risk_score double, max_loop_depth int, cyclomatic int, cognitive int, recursion_kind string, io_in_loop string, bottleneck_chain string, advisories string"
)
GROUP_LIMIT = 50_000


def workspace_complexity(symbols: DataFrame, edges: DataFrame, group: str, limit: int = GROUP_LIMIT) -> DataFrame:
    """Propagated reports, one bounded graph a ``group`` (a repository, or a weakly connected component).

    A group over ``limit`` symbols fails loudly rather than being cut.
    """

    def run(key: tuple, s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if len(s) > limit:
            raise ValueError(f"group {key[0]!r} has {len(s)} symbols; the limit is {limit}")
        reports, _ = propagate(s.sort_values("id").to_dict("records"), e.to_dict("records"))
        rows = [r.row() | {"io_in_loop": json.dumps(r.io_in_loop), "bottleneck_chain": json.dumps(r.bottleneck_chain), "advisories": json.dumps(r.advisories)} for r in reports.values()]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in REPORT.split(", ")])

    flat = edges.select(group, "src_id", "dst_id", "kind", F.coalesce("meta.dst_missing", F.lit(False)).alias("dst_missing"), F.coalesce("meta.loop_depth", F.lit(0)).alias("loop_depth"))
    return symbols.groupBy(group).cogroup(flat.groupBy(group)).applyInPandas(run, REPORT)
