"""Complexity classes: an algebra over ``struct(kind, degree, log_power, power, base)``.

The same rules exist as Column expressions (tables of classes) and as plain functions on tuples (grouped and
driver-local analysis); a test holds one against the other over all pairs of kinds.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = "kind string, degree int, log_power int, power int, base int"


class Cls(NamedTuple):
    """A complexity class; unused fields are zero."""

    kind: str
    degree: int = 0
    log_power: int = 0
    power: int = 0
    base: int = 0


CONSTANT, SQRT, FACTORIAL = Cls("constant"), Cls("sqrt"), Cls("factorial")


def poly(degree: int, log_power: int = 0) -> Cls:
    """Polynomial of a loop depth; degree zero without logarithms is constant."""
    return Cls("polynomial", min(degree, 255), min(log_power, 255)) if degree or log_power else CONSTANT


def logarithmic(power: int = 1) -> Cls:
    return Cls("logarithmic", power=min(power, 255))


def exponential(base: int) -> Cls:
    return Cls("exponential", base=min(base, 255))


LINEAR, N_LOG_N = poly(1), poly(1, 1)


def degree_of(c: Cls) -> float:
    return {
        "constant": 0.0,
        "logarithmic": 0.25 * c.power,
        "sqrt": 0.5,
        "polynomial": c.degree + 0.25 * c.log_power,
        "exponential": 8.0 + 0.1 * max(c.base, 2),
        "factorial": 10.0,
    }[c.kind]


def risk_of(c: Cls) -> float:
    if c.kind == "polynomial":
        if c.degree == 1:
            return 0.45 if c.log_power else 0.30
        return {2: 0.75, 3: 0.90}.get(c.degree, 0.95)
    return {"constant": 0.05, "logarithmic": 0.15, "sqrt": 0.20}.get(c.kind, 1.0)


def _log_part(power: int) -> str:
    return "log n" if power == 1 else f"(log n)^{power}"


def notation_of(c: Cls) -> str:
    if c.kind == "polynomial" and c.degree == 0:
        c = logarithmic(c.log_power)
    if c.kind == "logarithmic":
        return f"O({_log_part(c.power)})" if c.power else "O(1)"
    if c.kind == "polynomial":
        n = "n" if c.degree == 1 else f"n^{c.degree}"
        return f"O({n} {_log_part(c.log_power)})" if c.log_power else f"O({n})"
    return {"constant": "O(1)", "sqrt": "O(sqrt(n))", "factorial": "O(n!)"}.get(c.kind) or f"O({max(c.base, 2)}^n)"


def seq_max(a: Cls, b: Cls) -> Cls:
    """The steeper of two; ties keep the left."""
    return a if degree_of(a) >= degree_of(b) else b


def nest_mul(a: Cls, b: Cls) -> Cls:
    """Cost of ``b`` inside a loop of cost ``a``."""
    kinds = {a.kind, b.kind}
    if "constant" in kinds:
        return b if a.kind == "constant" else a
    if "factorial" in kinds:
        return FACTORIAL
    if kinds == {"exponential"}:
        return exponential(max(2, a.base * b.base))
    if "exponential" in kinds:
        return a if a.kind == "exponential" else b
    if kinds == {"logarithmic"}:
        return logarithmic(a.power + b.power)
    # square roots, logarithms and polynomials: a root counts half a degree and two make one, but a root with
    # anything else is rounded up to a whole degree
    roots = (a.kind == "sqrt") + (b.kind == "sqrt")
    return Cls("polynomial", min(255, a.degree + b.degree + (roots > 0)), min(255, a.log_power + b.log_power + a.power + b.power))


def parse_notation(text: str) -> Cls:
    """Class of a notation string; lossy beyond the named ones, as verdicts depend on."""
    # Notations that parse exactly.
    exact = {
        "O(1)": CONSTANT, "O(log n)": logarithmic(1), "O(sqrt(n))": SQRT, "O(n)": LINEAR, "O(n log n)": N_LOG_N,
        "O(n^2)": poly(2), "O(n^3)": poly(3), "O(n!)": FACTORIAL,
    }
    if text in exact:
        return exact[text]
    if "^n" in text:
        return exponential(2)
    return poly(4) if text.startswith("O(n^") else CONSTANT


# ---- the same as expressions


def cls(kind, degree=0, log_power=0, power=0, base=0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lit(kind).alias("kind"), lit(degree).cast("int").alias("degree"), lit(log_power).cast("int").alias("log_power"), lit(power).cast("int").alias("power"), lit(base).cast("int").alias("base")
    )


def effective_degree(c: Column) -> Column:
    return (
        F.when(c["kind"] == "logarithmic", 0.25 * c["power"])
        .when(c["kind"] == "sqrt", 0.5)
        .when(c["kind"] == "polynomial", c["degree"] + 0.25 * c["log_power"])
        .when(c["kind"] == "exponential", 8.0 + 0.1 * F.greatest(c["base"], F.lit(2)))
        .when(c["kind"] == "factorial", 10.0)
        .otherwise(0.0)
    )


def risk_weight(c: Column) -> Column:
    steep = F.when((c["degree"] == 1) & (c["log_power"] == 0), 0.30).when(c["degree"] == 1, 0.45).when(c["degree"] == 2, 0.75).when(c["degree"] == 3, 0.90).otherwise(0.95)
    return F.when(c["kind"] == "constant", 0.05).when(c["kind"] == "logarithmic", 0.15).when(c["kind"] == "sqrt", 0.20).when(c["kind"] == "polynomial", steep).otherwise(1.0)


def notation(c: Column) -> Column:
    def logs(p: Column) -> Column:
        return F.when(p == 1, F.lit("log n")).otherwise(F.concat(F.lit("(log n)^"), p.cast("string")))

    n = F.when(c["degree"] == 1, F.lit("n")).otherwise(F.concat(F.lit("n^"), c["degree"].cast("string")))
    power = F.when(c["kind"] == "polynomial", c["log_power"]).otherwise(c["power"])
    flat = (c["kind"] == "logarithmic") | ((c["kind"] == "polynomial") & (c["degree"] == 0))
    return (
        F.when(c["kind"] == "constant", F.lit("O(1)"))
        .when(flat & (power == 0), F.lit("O(1)"))
        .when(flat, F.concat(F.lit("O("), logs(power), F.lit(")")))
        .when(c["kind"] == "sqrt", F.lit("O(sqrt(n))"))
        .when((c["kind"] == "polynomial") & (c["log_power"] == 0), F.concat(F.lit("O("), n, F.lit(")")))
        .when(c["kind"] == "polynomial", F.concat(F.lit("O("), n, F.lit(" "), logs(c["log_power"]), F.lit(")")))
        .when(c["kind"] == "exponential", F.concat(F.lit("O("), F.greatest(c["base"], F.lit(2)).cast("string"), F.lit("^n)")))
        .otherwise(F.lit("O(n!)"))
    )


def seq_max_col(a: Column, b: Column) -> Column:
    return F.when(effective_degree(a) >= effective_degree(b), a).otherwise(b)


def nest_mul_col(a: Column, b: Column) -> Column:
    def either(kind: str) -> Column:
        return (a["kind"] == kind) | (b["kind"] == kind)

    def both(kind: str) -> Column:
        return (a["kind"] == kind) & (b["kind"] == kind)

    cap = lambda x: F.least(x, F.lit(255))
    return (
        F.when(a["kind"] == "constant", b)
        .when(b["kind"] == "constant", a)
        .when(either("factorial"), cls("factorial"))
        .when(both("exponential"), cls("exponential", base=F.greatest(cap(a["base"] * b["base"]), F.lit(2))))
        .when(a["kind"] == "exponential", a)
        .when(b["kind"] == "exponential", b)
        .when(both("logarithmic"), cls("logarithmic", power=cap(a["power"] + b["power"])))
        .otherwise(
            cls("polynomial", cap(a["degree"] + b["degree"] + F.when(either("sqrt"), 1).otherwise(0)), cap(a["log_power"] + b["log_power"] + a["power"] + b["power"]))
        )
    )


def loop_class(kind: Column) -> Column:
    """Class of a loop bound: constant, logarithmic, sqrt or linear."""
    return F.when(kind == "constant", cls("constant")).when(kind == "logarithmic", cls("logarithmic", power=1)).when(kind == "sqrt", cls("sqrt")).otherwise(cls("polynomial", 1))


def recursion_rule(halving: Column, memo: Column, branches: Column, loop_in_cycle: Column, local: Column) -> Column:
    """Time of a recursive cycle from its aggregates."""
    steep = ~memo & ((branches >= 2) | (loop_in_cycle > 0))
    base = F.greatest(F.lit(2), F.least(F.lit(8), branches))
    return (
        F.when(steep & halving, seq_max_col(cls("polynomial", 1, 1), local))
        .when(steep, cls("exponential", base=base))
        .when(halving, nest_mul_col(cls("logarithmic", power=1), local))
        .otherwise(nest_mul_col(cls("polynomial", 1), local))
    )


def symbol_risk(weight: Column, io: Column, cognitive: Column, recursive: Column) -> Column:
    raw = 0.45 * weight + 0.30 * F.when(io, 1.0).otherwise(0.0) + 0.15 * F.least(cognitive / 25.0, F.lit(1.0)) + 0.10 * F.when(recursive, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


# Markers of shrinking arguments and of calls to stores, networks and files.
HALVING, DECREMENT = ("/ 2", "/2", "// 2", ">> 1", "mid"), ("- 1", "-1", "- 2", "+ 1")
DATABASE_NAMES = ("query", "execute", "query_row", "query_map", "findOne", "findUnique", "findFirst", "findMany", "raw")
DATABASE_CALLEES, DATABASE_TEXTS = ("db.", "conn.", "cursor.", "prisma."), ("select ", "insert into ", "update ")
NETWORK_NAMES, NETWORK_CALLEES = ("fetch", "post", "put", "delete"), ("http", "axios", "requests", "httpx", "client")
FILE_NAMES = ("readFileSync", "writeFileSync", "read_to_string", "ReadFile", "WriteFile", "ReadAllText")
MEMO_MARKS = ("lru_cache", "@cache", "memo.get", "memo[", "cache.get", "visited.has", "visited.contains")
DIRECT_IO = ("select ", "insert into", "db.query", "db.execute", "fetch(", "requests.")


def holds(text: Column, marks: tuple[str, ...]) -> Column:
    return text.rlike("|".join(re.sub(r"([\[\](){}.*+?^$|\\])", r"\\\1", m) for m in marks))


def arg_reduction(args: Column) -> Column:
    return F.when(holds(args, HALVING), F.lit("halving")).when(holds(args, DECREMENT), F.lit("decrement")).otherwise(F.lit("none"))


def io_kind(name: Column, callee: Column, text: Column) -> Column:
    """Kind of I/O of a call, or null: database before network before files."""
    database = name.isin(*DATABASE_NAMES) | holds(callee, DATABASE_CALLEES) | holds(F.lower(text), DATABASE_TEXTS)
    network = (name == "fetch") | (name.isin(*NETWORK_NAMES) & holds(callee, NETWORK_CALLEES))
    files = name.isin(*FILE_NAMES) | callee.startswith("fs.")
    return F.when(database, F.lit("database_query")).when(network, F.lit("network_rpc")).when(files, F.lit("filesystem_blocking"))
