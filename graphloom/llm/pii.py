"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

One combined pattern finds candidates; a text is the gaps between its matches and the matches, so it is rebuilt as
gap, pseudonym, gap. Numbers and dates that validate are permuted by a keyed Feistel network inside their own format:
the map is a bijection of the format, so equal values stay equal in all documents and different ones stay different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 8

#: Kind -> what stands around it and its pattern. Order matters: the first alternative that matches at a place wins. Runs
#: are possessive and begin where no such run goes on, so that a long run is read once; repeated groups are bounded (a
#: domain has at most 127 labels) or possessive, which Java matches without recursion.
AROUND: dict[str, tuple[str, str, str]] = {
    "email": (r"(?:(?<![A-Za-z0-9._%+\-])|\G)", r"[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++){0,126}\.[A-Za-z]{2,}+", ""),
    "secret": (r"(?<![A-Za-z0-9])", r"[0-9a-fA-F]{32,64}", r"(?![A-Za-z0-9])"),
    "ip": (r"(?<![0-9.])", r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}", r"(?![0-9]|\.[0-9])"),
    "date": (r"(?<![0-9\-/])", r"(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])", r"(?![0-9\-])"),
    "phone": (r"(?<![0-9A-Za-z])", r"(?:\+[0-9]{1,3}[ .\-]?)?\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}", r"(?![0-9A-Za-z])"),
    "ssn": (r"(?<![0-9\-])", r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", r"(?![0-9\-])"),
    # A whole run of numbers, from which _pieces takes the cards: what stands beside a card may look like a part of it.
    "card": (r"(?<![0-9A-Za-z])(?=[0-9](?:[ \-]?[0-9]){12})", r"[0-9]++(?![A-Za-z])(?:[ \-][0-9]++(?![A-Za-z]))*+", ""),
}
KINDS: dict[str, str] = {kind: "".join(parts) for kind, parts in AROUND.items()}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
OTHERS = "|".join(f"(?:{p})" for kind, p in KINDS.items() if kind != "card")
#: A text without any of these characters holds none of the kinds.
HINT = r"@|[0-9]{3}|[0-9]\.[0-9]|[0-9a-fA-F]{32}"
#: Days from 1900-01-01 to 2099-12-31, the years of the pattern, as a product: dates are permuted among themselves.
DAYS = (17, 4297)
#: Areas (001 to 899 without 666) and pairs of group and serial number, neither zero, of valid SSNs.
SSNS = (898, 99 * 9999)
#: Numbers of a run that are looked at together; a card has at most 19.
CHUNK = 64


def _prf(key: str, tweak: Column, step: Column, value: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(key), tweak, step.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")


def feistel(key: str, tweak: Column, left: Column, right: Column, m_left: Column, m_right: Column, rounds: int = ROUNDS) -> Column:
    """Keyed permutation of pairs in ``[0, m_left) x [0, m_right)``; ``struct(a, b)`` with the pair in its place.

    An unbalanced network: each round adds a keyed function of one half to the other, modulo that half's size, and
    swaps, so after an even number of rounds every half is home. Subtracting in reverse order inverts it.
    """
    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))

    def turn(acc: Column, k: Column) -> Column:
        size = F.when(k % 2 == 0, m_left).otherwise(m_right).cast("long")
        return F.struct(acc["b"].alias("a"), F.pmod(acc["a"] + F.pmod(_prf(key, tweak, k, acc["b"]), size), size).alias("b"))

    return F.aggregate(F.array(*[F.lit(k) for k in range(rounds)]), start, turn)


def _pow10(n: Column) -> Column:
    return F.pow(F.lit(10), n).cast("long")


def permute_digits(key: str, tweak: Column, digits: Column) -> Column:
    """Feistel permutation of a digit string of 2 to 36 digits among strings of its length."""
    n = F.char_length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    pair = feistel(key, F.concat(tweak, n.cast("string")), F.substr(digits, F.lit(1), u).cast("long"), F.substr(digits, u + 1, v).cast("long"), _pow10(u), _pow10(v))
    return F.transform(F.array(pair), lambda p: F.concat(F.lpad(p["a"].cast("string"), u, "0"), F.lpad(p["b"].cast("string"), v, "0")))[0]


def luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Luhn weight of a digit string read from the right; the rightmost digit is doubled if ``doubled_first``."""
    chars = F.split(F.reverse(digits), "")
    odd = 0 if doubled_first else 1

    def weigh(d: Column, i: Column) -> Column:
        x = d.cast("int") * F.when(i % 2 == odd, 2).otherwise(1)
        return x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.filter(chars, lambda c: c != ""), weigh), F.lit(0), lambda a, x: a + x)


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``; punctuation stays."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    state = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    isdig = lambda c: c.rlike("[0-9]")
    return F.aggregate(
        chars,
        state,
        lambda a, c: F.struct(
            F.concat(a["s"], F.when(isdig(c), F.substr(digits, a["k"], F.lit(1))).otherwise(c)).alias("s"), (a["k"] + F.when(isdig(c), 1).otherwise(0)).alias("k")
        ),
        lambda a: a["s"],
    )


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _email(key: str, x: Column) -> Column:
    h = F.sha2(F.concat(F.lit(f"{key}:email:"), F.lower(x)), 256)
    return F.concat(F.lit("u"), F.substring(h, 1, 16), F.lit("@"), F.lit("m"), F.substring(h, 17, 6), F.lit(".example.invalid"))


def _secret(key: str, x: Column) -> Column:
    h = F.sha2(F.concat(F.lit(f"{key}:secret:"), F.lower(x)), 256)
    out = F.substr(h, F.lit(1), F.char_length(x))
    return F.when(x == F.upper(x), F.upper(out)).otherwise(out)


def _ip(key: str, x: Column) -> Column:
    p = F.split(x, r"\.")
    half = lambda i: p[i].cast("long") * 256 + p[i + 1].cast("long")
    pair = feistel(key, F.lit("ip"), half(0), half(2), F.lit(65536), F.lit(65536))
    octets = lambda c: F.concat_ws(".", F.floor(c / 256).cast("string"), (c % 256).cast("string"))
    return _let(pair, lambda q: F.concat_ws(".", octets(q["a"]), octets(q["b"])))


def _date(key: str, x: Column) -> Column:
    day = F.datediff(F.to_date(F.try_to_timestamp(x, F.lit("yyyy-MM-dd"))), F.to_date(F.lit("1900-01-01")))
    pair = feistel(key, F.lit("date"), F.floor(day / DAYS[1]), F.pmod(day, F.lit(DAYS[1])), F.lit(DAYS[0]), F.lit(DAYS[1]))
    moved = _let(pair, lambda q: F.date_format(F.date_add(F.to_date(F.lit("1900-01-01")), (q["a"] * DAYS[1] + q["b"]).cast("int")), "yyyy-MM-dd"))
    return F.coalesce(moved, x)


def _card(key: str, x: Column) -> Column:
    """A number that passes the Luhn test maps to one that does; others are left as they are."""

    def swap(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.char_length(d) - 1)
        fresh = permute_digits(key, F.lit("card"), body)
        return _let(fresh, lambda b: F.concat(b, F.pmod(10 - luhn_sum(b, True) % 10, F.lit(10)).cast("string")))

    return _let(_only_digits(x), lambda d: F.when(luhn_sum(d, False) % 10 == 0, _refill(x, swap(d))).otherwise(x))


def _phone(key: str, x: Column) -> Column:
    """All digits but a leading ``+country`` code are permuted. Area codes differ by country, so the shape alone is checked."""
    lead = F.regexp_extract(x, r"^\+[0-9]{1,3}[ .\-]?", 0)
    rest = F.substr(x, F.char_length(lead) + 1, F.char_length(x))
    return F.concat(lead, _refill(rest, permute_digits(key, F.lit("phone"), _only_digits(rest))))


def _ssn(key: str, x: Column) -> Column:
    """A valid number is permuted among the valid ones."""
    area, group, serial = (F.split(x, "-")[k].cast("long") for k in range(3))
    pair = feistel(key, F.lit("ssn"), area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(SSNS[0]), F.lit(SSNS[1]))
    digits = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return _let(pair, lambda q: F.concat_ws("-", digits(q["a"] + F.when(q["a"] > 664, 2).otherwise(1), 3), digits(F.floor(q["b"] / 9999) + 1, 2), digits(q["b"] % 9999 + 1, 4)))


def kind_of(x: Column) -> Column:
    """Kind of one match: its bare pattern is the whole match."""
    out = F.lit(None).cast("string")
    for kind, (_, bare, _) in reversed(AROUND.items()):
        out = F.when(x.rlike(rf"\A(?:{bare})\z"), F.lit(kind)).otherwise(out)
    return out


def _pieces(x: Column) -> Column:
    """A run of numbers in pieces ``m, k``: from the left, the longest sequence of whole numbers that is a card; the
    other kinds in what is left; the rest, without a kind. The pieces joined are the run.

    Cards are chosen chunk by chunk of the run, with only the place to go on carried over, so time grows with the run.
    """
    part = lambda m, k: F.struct(m.alias("m"), (F.lit(k).cast("string") if isinstance(k, str | None) else k).alias("k"))
    none = F.array().cast("array<struct<i:int,j:int>>")

    def valid(digits: Column) -> Column:
        return _let(digits, lambda d: F.char_length(d).between(13, 19) & (luhn_sum(d, False) % 10 == 0))

    def picks(g: Column) -> Column:
        """First and last number of each card, in order."""

        def chunk(acc: Column, c: Column) -> Column:
            base = c * CHUNK

            def inside(near: Column) -> Column:
                run = lambda i, j: F.array_join(F.slice(near, i - base + 1, j - i + 1), "")

                def step(a: Column, i: Column) -> Column:
                    ends = F.sequence(i, F.least(i + 18, F.size(g) - 1))
                    last = F.when(i >= a["next"], F.array_max(F.filter(ends, lambda j: valid(_only_digits(run(i, j))))))
                    found = lambda j: F.when(j.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(i.alias("i"), j.alias("j")))))
                    return _let(last, lambda j: F.struct(F.coalesce(j + 1, a["next"]).alias("next"), found(j).alias("out")))

                return F.aggregate(
                    F.sequence(base, F.least(base + (CHUNK - 1), F.size(g) - 1)), F.struct(acc["next"].alias("next"), none.alias("out")), step,
                    lambda a: F.struct(a["next"].alias("next"), F.concat(acc["out"], a["out"]).alias("out")),
                )

            return _let(F.slice(g, base + 1, CHUNK + 18), inside)

        chunks = F.sequence(F.lit(0), F.floor((F.size(g) - 1) / CHUNK).cast("int"))
        return F.aggregate(chunks, F.struct(F.lit(0).alias("next"), none.alias("out")), chunk, lambda a: a["out"])

    def cut(g: Column) -> Column:
        def between(p: Column) -> Column:
            """The text before card ``k`` (after the last one for ``k`` = number of cards) and the card."""
            after = lambda k: F.get(p, k - 1)["j"]
            tail = lambda k: F.when(k > 0, F.regexp_extract(F.get(g, after(k)), "[^0-9]*$", 0)).otherwise("")
            begin = lambda k: F.when(k > 0, after(k) + 1).otherwise(0)
            stop = lambda k: F.coalesce(F.get(p, k)["i"], F.size(g))
            rest = lambda k: part(F.concat(tail(k), F.array_join(F.slice(g, begin(k) + 1, stop(k) - begin(k)), "")), None)
            body = lambda c: F.regexp_replace(F.array_join(F.slice(g, c["i"] + 1, c["j"] - c["i"] + 1), ""), "[^0-9]$", "")
            cards = F.flatten(F.transform(p, lambda c, k: F.array(rest(k), part(body(c), "card"))))
            return F.concat(cards, F.array(rest(F.size(p))))

        return _let(picks(g), between)

    def others(s: Column) -> Column:
        gaps, found = F.split(s["m"], OTHERS, -1), F.regexp_extract_all(s["m"], F.lit(OTHERS), F.lit(0))
        both = _let(found, lambda f: F.flatten(F.transform(gaps, lambda gap, i: F.array(part(gap, None), _let(F.get(f, i), lambda m: part(F.coalesce(m, F.lit("")), kind_of(m)))))))
        return F.when(s["k"].isNull(), both).otherwise(F.array(s))

    return F.flatten(F.transform(_let(F.regexp_extract_all(x, F.lit("[0-9]+[^0-9]?"), F.lit(0)), cut), others))


def pseudonym(x: Column, kind: Column, key: str) -> Column:
    """Pseudonym of one match of :data:`PATTERN`."""
    return (
        F.when(kind == "email", _email(key, x))
        .when(kind == "secret", _secret(key, x))
        .when(kind == "ip", _ip(key, x))
        .when(kind == "date", _date(key, x))
        .when(kind == "phone", _phone(key, x))
        .when(kind == "ssn", _ssn(key, x))
        .when(kind == "card", _card(key, x))
        .otherwise(x)
    )


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = "graphloom", kinds_col: str | None = None) -> DataFrame:
    """``docs`` with the personal data in ``text_col`` replaced; all other columns and rows unchanged.

    ``kinds_col`` names an extra column: array<string> with the kind of each match that was replaced. Null texts stay
    null (their kinds too), empty texts stay empty. Equal values get equal pseudonyms under one ``key``, which is a
    secret of the deployment. A card-like number that fails the Luhn test, an SSN with a part that is never issued and a
    day that no calendar has are none and stay; in a run of several numbers, sequences of whole numbers are tried, see
    :func:`_pieces`. Texts of any length are read in time that grows with them. Repeated rows and empty tables need no
    special case; columns pass through, whatever their names; there is no shuffle and no Python.
    """
    text = F.col(f"`{text_col}`").cast("string")
    ms, gs, ks, ps = (free_name(docs, c) for c in ("pii_m", "pii_g", "pii_k", "pii_p"))
    found = docs.withColumn(ms, F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    found = found.withColumn(gs, F.when(F.size(ms) > 0, F.split(text, PATTERN, -1)))
    one = lambda m: _let(kind_of(m), lambda k: F.when(k == "card", _pieces(m)).otherwise(F.array(F.struct(m.alias("m"), k.alias("k")))))
    named = found.withColumn(ks, F.when(F.size(ms) > 0, F.transform(ms, one)))
    swapped = named.withColumn(ps, F.transform(ks, lambda x: F.transform(x, lambda s: F.struct(pseudonym(s["m"], s["k"], key).alias("p"), s["m"].alias("m"), s["k"].alias("k")))))
    whole = lambda x: F.array_join(F.transform(x, lambda s: s["p"]), "")
    joined = F.concat(F.array_join(F.transform(ps, lambda x, i: F.concat(F.get(gs, i), whole(x))), ""), F.get(gs, F.size(ps)))
    out = swapped.withColumn(text_col, F.when(F.size(ps) > 0, joined).otherwise(text))
    if kinds_col:
        kinds = F.transform(F.filter(F.flatten(ps), lambda s: s["p"] != s["m"]), lambda s: s["k"])
        out = out.withColumn(kinds_col, F.when(F.col(ps).isNotNull(), kinds).when(text.isNotNull(), F.array().cast("array<string>")))
    return out.drop(ms, gs, ks, ps)


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "graphloom") -> DataFrame:
    """``doc_id``, the pseudonymised ``text``, ``n_found`` and one count per kind (``n_email`` ...).

    Null and empty texts have zero counts and stay as they are; null ids pass through; repeated rows each appear; texts of
    any length are handled, see :func:`pseudonymise`; an empty table gives an empty result; other columns are ignored.
    """
    done = pseudonymise(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", key, "_kinds")
    size = F.when(F.col("_kinds").isNull(), 0).otherwise(F.size("_kinds")).alias("n_found")
    counts = [F.when(F.col("_kinds").isNull(), 0).otherwise(F.size(F.filter("_kinds", _same(kind)))).alias(f"n_{kind}") for kind in KINDS]
    return done.select("doc_id", "text", size, *counts)


def _same(kind: str):
    return lambda k: k == kind
