"""Lexical ranking: postings, BM25 with a small match grammar, and tf-idf.

Postings are built by explode and partially aggregated counts; a query meets them through its few terms, which prune
the postings before anything is shuffled, and ends in a top-k (``TakeOrderedAndProject``), never a full sort.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import camel_tokens

K1, B = 1.2, 0.75
_ATOM = re.compile(r'"((?:[^"]|"")*)"(\*)?|([^\s"()]+)|([()])')


def plain_tokens(text):
    """Case-folded runs of letters and digits with diacritics kept out of the way of ASCII."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores where a small input has fewer splits than cores; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def postings(docs: DataFrame, id_col: str, text_col: str, tokenizer=plain_tokens) -> DataFrame:
    """``id, term, tf`` of every document and term."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(tokenizer(F.col(text_col))).alias("term"))
    return words.groupBy("id", "term").agg(F.count("*").alias("tf"))


def parse_match(query: str) -> list[tuple[str, list[str], bool]] | None:
    """Clauses ``(op, words, prefix)`` of a match expression: implicit AND, OR, NOT, phrases, ``prefix*``.

    Anything outside the grammar gives None, which callers answer with an empty result, as for a blank query.
    """
    out: list[tuple[str, list[str], bool]] = []
    op = "AND"
    at = 0
    for found in _ATOM.finditer(query):
        if query[at : found.start()].strip():
            return None
        at = found.end()
        if found[4]:
            return None
        word = found[3]
        if word in ("AND", "OR", "NOT"):
            if not out or op != "AND" or (out and out[-1][0] == "?"):
                return None
            op = word
            out.append(("?", [], False))
            continue
        if out and out[-1][0] == "?":
            out.pop()
        text = found[1].replace('""', '"') if found[1] is not None else word
        prefix = bool(found[2]) or (word is not None and word.endswith("*"))
        words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
        if not words or (word is not None and re.search(r"[^\w*]", word)):
            return None
        out.append((op, words, prefix))
        op = "AND"
    if query[at:].strip() or (out and out[-1][0] == "?"):
        return None
    return out or None


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str, k: int = 8, tokenizer=plain_tokens) -> DataFrame:
    """``id, score`` of the ``k`` best documents of a match expression; blank or malformed queries match nothing.

    Only rows that hold one of the query's terms leave the scan; lengths and the corpus size come from one aggregate.
    """
    clauses = parse_match(query)
    spark = docs.sparkSession
    if not clauses or k <= 0:
        return spark.createDataFrame([], f"id {dict(docs.dtypes)[id_col]}, score double")
    tokens = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))).select("id", tokenizer(F.col("t")).alias("toks"))
    size = tokens.agg(F.count("*").alias("n_docs"), F.avg(F.size("toks")).alias("avg_len"))

    def has(words: list[str], prefix: bool):
        if len(words) == 1:
            w = words[0]
            return F.exists("toks", (lambda t: t.startswith(w)) if prefix else (lambda t: t == w))
        body = F.concat(F.lit(" "), F.array_join("toks", " "), F.lit(" "))
        return F.contains(body, F.lit(" " + " ".join(words) + ("" if prefix else " ")))

    keep = None
    for op, words, prefix in clauses:
        hit = has(words, prefix)
        keep = hit if keep is None else (keep | hit if op == "OR" else keep & ~hit if op == "NOT" else keep & hit)
    terms = sorted({w for op, words, _ in clauses if op != "NOT" for w in words})
    matched = tokens.where(keep)
    freq = [F.size(F.filter("toks", _equals(t))).alias(f"f{j}") for j, t in enumerate(terms)]
    rows = matched.select("id", F.size("toks").alias("len"), *freq)
    df = tokens.agg(*[F.count_if(F.array_contains("toks", t)).alias(f"d{j}") for j, t in enumerate(terms)])
    both = rows.crossJoin(F.broadcast(size.crossJoin(df)))  # one row of corpus statistics
    score = F.lit(0.0)
    for j in range(len(terms)):
        idf = F.log((F.col("n_docs") - F.col(f"d{j}") + 0.5) / (F.col(f"d{j}") + 0.5) + 1.0)
        tf = F.col(f"f{j}") * (K1 + 1) / (F.col(f"f{j}") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
        score = score + idf * tf
    return both.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _equals(term: str):
    return lambda t: t == term


def tfidf_index(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, ``term, df, idf`` and ``id, norm`` of a camel-case-aware bag of words."""
    post = postings(docs, id_col, text_col, camel_tokens)
    n = docs.select(F.count("*").alias("n_docs"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(n)).select("term", "df", (F.log((F.col("n_docs") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    weighted = post.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return post, idf, norms.withColumn("norm", F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm")))


def tfidf_search(docs: DataFrame, id_col: str, text_col: str, query: str, k: int = 10) -> DataFrame:
    """``id, score``: sum of qf * tf * idf^2 over the document norm, positive scores only, ties by id.

    Document frequencies come from one pass over the corpus; counts and norms only from documents that can match (a
    token is a piece of the lower-case text, so a substring test picks them before any tokenizing).
    """
    spark = docs.sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(camel_tokens(F.col("q"))).alias("term")).groupBy("term").agg(F.count("*").alias("qf"))
    words = [r["term"] for r in asked.select("term").collect()]  # the query's own words
    docs = spread(docs.select(id_col, text_col))
    n = docs.select(F.count("*").alias("n_docs"))
    df = docs.select(F.explode(F.array_distinct(camel_tokens(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    low, may = F.lower(text_col), F.lit(False)
    for w in words:
        may = may | F.contains(low, F.lit(w))
    counts = postings(docs.where(may), id_col, text_col, camel_tokens)
    idf = df.crossJoin(F.broadcast(n)).select("term", (F.log((F.col("n_docs") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))  # n is one row
    weighted = counts.join(idf, "term").join(F.broadcast(asked), "term", "left")  # as many rows as the query has words
    w = F.col("tf") * F.col("idf")
    scored = weighted.groupBy("id").agg(F.sum(F.col("qf") * w * F.col("idf")).alias("raw"), F.sqrt(F.sum(w * w)).alias("norm"))
    scored = scored.where("raw > 0").select("id", (F.col("raw") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)
