"""The ten operators and the pipeline against brute force, and their edge cases: nulls, empties, ties, repeats, clashes."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, decontam, html, license, packing, pii, quality, simhash, suffix, toxicity, warc

WORDS = "the of river stone garden winter letter copper window silver forest market bridge candle harbour meadow thunder paper".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(",.") if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, junk, blanks and nulls."""
    rng = random.Random(7)
    rows = []
    for k in range(60):
        rows.append((k, prose(rng, rng.randint(30, 160))))
    base = rows[3][1].split()
    for k in range(60, 90):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        rows.append((k, " ".join(copy)))
    passage = prose(rng, 40)
    for k in range(90, 110):
        rows.append((k, prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 20)))
    rows += [(110, ""), (111, None), (112, "   \n\t"), (113, "Ünïcode ß " * 30), (114, "a"), (115, rows[0][1]), (116, "x " * 3000), (117, passage)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """Extra columns carry names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in corpus], "doc_id long, text string, fp string, key int, label string").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# ---- 1


@pytest.mark.parametrize(("blocks", "small"), [(2, 512), (2, 2), (1, 512)])
def test_simhash(spark, docs, corpus, blocks, small):
    if blocks == 1:
        docs, corpus = docs.where("doc_id < 75"), [r for r in corpus if r[0] < 75]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs, blocks=blocks, small=small).collect()}
    prints = {i: simhash.fingerprint_of(t) for i, t in corpus}
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in product(prints, prints):
        if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


def five_words(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x or y else 1.0


def exact_groups(texts):
    """Smallest reachable id over all pairs of a Jaccard similarity of 0.8 or more."""
    sets = {i: five_words(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in texts}


def edited(rng, text, pool, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = rng.choice(pool)
    return " ".join(words)


def near(spark, texts, **parameters):
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("w0", F.lit("x")).withColumn("node", F.lit(1)).withColumn("gone", F.lit(2))
    return {r["doc_id"]: r["component_id"] for r in simhash.near_components(rows.repartition(3), **parameters).collect()}


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 20, "block_shingles": 3000}])
def test_near_components(spark, blocks):
    """Against all pairs: a dense group of one hot text, smaller groups, and texts that are alone; also in small blocks."""
    rng = random.Random(5)
    pool = [f"{w}{k}" for w in WORDS for k in range(40)]
    texts = {k: " ".join(rng.choices(pool, k=rng.randint(60, 200))) for k in range(120)}
    for k in range(120, 220):
        texts[k] = edited(rng, texts[k % 60], pool, rng.randint(0, 3))
    for k in range(220, 320):  # a dense group of one hot text
        texts[k] = edited(rng, texts[3], pool, 1)
    exact, got = exact_groups(texts), near(spark, texts, **blocks)
    assert len(set(exact.values())) > 100 and sum(got[i] == exact[i] for i in texts) >= 0.97 * len(texts)
    assert all(exact[i] == exact[got[i]] for i in texts)  # no link below the threshold


def test_near_pairs(spark):
    """Isolated edited copies, short and long, on both sides of 0.8: those at or above it meet (19 of 20), none below."""
    rng = random.Random(8)
    pool = [f"{w}{k}" for w in WORDS for k in range(40)]
    texts = {}
    for k in range(0, 400, 2):
        texts[k] = " ".join(rng.choices(pool, k=rng.choice((4, 6, 9, 14, 40, 130, 270, 600, 1500))))
        n = len(texts[k].split())
        texts[k + 1] = edited(rng, texts[k], pool, rng.randint(1, 1 + n // 40)) if k % 3 else texts[k] + " " + " ".join(rng.choices(pool, k=1 + n // rng.randint(3, 12)))
    sets = {i: five_words(t) for i, t in texts.items()}
    alike = {k: jaccard(sets[k], sets[k + 1]) for k in range(0, 400, 2)}
    assert sum(0.8 <= x < 0.86 for x in alike.values()) > 15 and sum(0.7 < x < 0.8 for x in alike.values()) > 15
    got = near(spark, texts)
    due = [k for k, x in alike.items() if x >= 0.8]
    assert sum(got[k + 1] == k for k in due) >= 0.95 * len(due)
    assert all(got[i] == i for k, x in alike.items() if x < 0.8 for i in (k, k + 1))


def test_near_chain(spark):
    """A chain of drifting copies, ends unlike, is one group, also in small blocks; a chain cut in the middle is two."""
    rng = random.Random(9)
    pool = [f"{w}{k}" for w in WORDS for k in range(40)]
    head, texts = " ".join(rng.choices(pool, k=30)), {}
    tail = rng.choices(pool, k=170)
    for k in range(400):
        tail[(7 * k) % 170] = rng.choice(pool)
        texts[k] = head + " " + " ".join(tail)
    sets = {i: five_words(t) for i, t in texts.items()}
    assert jaccard(sets[0], sets[399]) < 0.2 and all(jaccard(sets[k], sets[k + 1]) >= 0.8 for k in range(399))
    assert set(near(spark, texts, block_rows=30, block_shingles=4000).values()) == {0}
    rest = {i: t for i, t in texts.items() if not 150 <= i < 250}
    assert near(spark, rest) == exact_groups(rest)


def test_near_parts():
    """Buckets by bits and sets by similarity against all pairs; shingle sets against sets of strings."""
    rng = np.random.default_rng(10)
    base = rng.integers(0, 1 << 63, (12, 4), dtype=np.uint64)
    prints = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 63, (15, 4), dtype=np.uint64)) for b in base[[0, 1, 0, 2]]])
    starts = np.array([0, 7, 30])
    label = simhash.print_groups(starts, prints, 7)
    for lo, hi in ((0, 7), (7, 30), (30, 60)):
        own = np.bitwise_count(prints[lo:hi, None] ^ prints[None, lo:hi]).sum(axis=2) <= 7
        reach = np.linalg.matrix_power(own.astype(float), 64) > 0
        assert (label[lo:hi] == lo + reach.argmax(axis=1)).all()
    words = [random.Random(3).choice(WORDS) for _ in range(300)]
    for n in (0, 1, 4, 5, 6, 300):
        text = " ".join(words[:n])
        assert len(simhash.shingle_set(text, 5)) == len(five_words(text))
    a, b = (set(simhash.shingle_set(" ".join(words[k : k + 200]), 5).tolist()) for k in (0, 50))
    assert len(a & b) == len(five_words(" ".join(words[:200])) & five_words(" ".join(words[50:250])))


def test_near_components_edges(spark):
    rows = [(5, None), (2, " "), (None, "a b c"), (9, "A  b\nc"), (9, "A  b\nc"), (4, "x y"), (4, "p q r s t u v"), (7, "w " * 5000), (8, "w " * 4000), (None, None)]
    found = simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r["doc_id"], r["component_id"]) for r in found)
    assert got[(5, 2)] == got[(2, 2)] == 1 and got[(None, 9)] == 1 and got[(9, 9)] == 2 and got[(None, 2)] == 1 and got[(7, 7)] == got[(8, 7)] == 1
    assert sum(n for (i, _), n in got.items() if i == 4) == 2 and len(found) == len(rows)
    assert simhash.near_components(empty(spark)).collect() == []
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["2", "9", "9", "4", "4", "7", "None", "None"])


def test_simhash_edges(spark):
    assert simhash.fingerprint_of(None) == simhash.fingerprint_of(" \t") == 0
    one = simhash.fingerprint_of("Only Three Words")
    assert one == simhash.fingerprint_of("only  three\nwords") and one != 0
    rows = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (2, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in simhash.simhash_components(rows).collect())
    assert got == [("2", 2), ("5", 5), ("5", 5), ("None", 5)]
    assert simhash.simhash_components(empty(spark)).collect() == []
    kept = simhash.keep_first(spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "z y x w v u")], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in common.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# ---- 2


def test_decontam(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(30))) for k in range(12)] + [(99, None), (98, "")]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(200))) for k in range(30)]
    edited = items[2][1].split()
    edited[5] = "changed"
    edited.insert(15, "more")
    del edited[22]
    rows += [(100, rows[0][1] + " " + items[1][1].upper() + " " + rows[1][1]), (101, rows[2][1] + "\n" + " ".join(edited)), (102, None), (103, ""), (104, " ".join(items[4][1].split()[:8]))]
    found = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for i, t in rows:
        for j, x in items:
            a, b = decontam._words(t), decontam._words(x)
            if b and decontam.smith_waterman(a, b)[0] / len(b) >= decontam.THRESHOLD:
                want.add((i, j))
    assert set(found) == want == {(100, 1), (101, 2)}
    assert found[100, 1]["score"] == 1.0 and found[100, 1]["doc_begin"] == 200 and found[100, 1]["doc_end"] == 230
    assert 0.6 <= found[101, 2]["score"] < 1
    left = decontam.drop_leaking(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in rows} - {100, 101}
    clash = spark.createDataFrame([(1, items[1][1], 2), (None, items[1][1], 3)], "doc_id long, text string, gone int")
    assert [r["doc_id"] for r in decontam.drop_leaking(clash, spark.createDataFrame([(None, items[1][1])], "item_id long, text string")).collect()] == [None]
    assert decontam.leaks(empty(spark), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_decontam_recall():
    """Items edited at many rates: of those that still score 0.6, all but a few hold a seed; matched places are right."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(k, [w.encode() for w in rng.choices(vocabulary, k=rng.randint(15, 60))]) for k in range(60)]
    seeds = decontam.choose_seeds(items, {}, 3)
    names = sorted(seeds)
    matcher, met, due = decontam.Matcher(names), 0, 0
    for rate in (0.05, 0.1, 0.2, 0.3):
        for k, words in items * 3:
            out = []
            for w in words:
                r = rng.random()
                if r >= rate / 3:
                    out.append(rng.choice(vocabulary).encode() if r < 2 * rate / 3 else w)
                    out += [rng.choice(vocabulary).encode()] if r > 1 - rate / 3 else []
            text = [w.encode() for w in rng.choices(vocabulary, k=40)] + out
            grams, spots = matcher.places(text)
            assert all(b" ".join(text[d : d + 3]) == names[g] for g, d in zip(grams.tolist(), spots.tolist(), strict=True))
            if decontam.smith_waterman(text, words)[0] / len(words) >= decontam.THRESHOLD:
                due += 1
                met += any(number == k for g in grams.tolist() for number, _ in seeds[names[g]])
    assert due > 500 and met >= 0.98 * due
    short = decontam.Matcher([b"a b", b"c"])
    assert [sorted(x.tolist()) for x in short.places([b"c", b"a", b"b", b"c"])] == [[0, 1, 1], [0, 1, 3]]


def test_smith_waterman_plain():
    def plain(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i, j in product(range(1, len(a) + 1), range(1, len(b) + 1)):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1, j] - 0.5, h[i, j - 1] - 0.5)
        return h.max()

    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert decontam.smith_waterman(a, b)[0] == pytest.approx(plain(a, b))


# ---- 3


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, corpus):
    extra = [(200, "a b c a b c a b"), (201, "x\nx\n\ny\nx"), (202, "### $$$ <a>|" * 20), (203, "SHOUT " * 60)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in quality.judge(quality.ledger(both)).collect()}
    for i, t in [*corpus, *extra]:
        r = rows[i]
        n, chars, symbols, dup, rep = brute_quality(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep), i
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in quality.keep_good(both).collect()}
    assert kept == {i for i, r in rows.items() if r["kept"]} and 203 not in kept and 111 not in kept
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.ledger(empty(spark)).collect() == []
    table = {r["rule"]: r for r in quality.ablations(quality.ledger(both)).collect()}
    bits = [r["fail_bits"] for r in rows.values()]
    mask = quality.policy_mask(quality.POLICIES["v2"])
    for rule in quality.POLICIES["v2"]:
        bit = 1 << quality.RULES[rule][0]
        assert table[rule]["n_failed"] == sum(bool(b & bit) for b in bits)
        assert table[rule]["n_only"] == sum(b & mask == bit for b in bits)
        assert table[rule]["n_rejected_without"] == sum(bool(b & mask & ~bit) for b in bits)


# ---- 4


def test_html(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href='/'>Home</a></nav><div class='cookie-notice'>We use cookies</div>"
        "<article><h1>A &amp; B</h1><p>First\n  paragraph with <a href='x'>a link</a> in it.</p><aside>See also this</aside><p>Second<br>line &lt;here&gt;</p>"
        "<form><input><label>Mail</label></form><script>var x='</p>';</script><p>Last.</p></article><section id='comments'><p>Nice one!</p></section><footer>Copyright</footer></body></html>"
    )
    want = "A & B\n\nFirst paragraph with a link in it.\n\nSecond line <here>\n\nLast."
    rows = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>cut off &am"), (5, "x", "<div class='ad'>Buy</div>"), (None, "y", "plain words only")], "page_id long, url string, html string")
    got = sorted(((r["page_id"] or -1, r["url"], r["text"], r["n_chars"]) for r in html.extract(rows).collect()), key=str)
    assert got == sorted([(1, "u", want, len(want)), (1, "u", want, len(want)), (2, None, "", 0), (3, "v", "", 0), (4, "w", "cut off &am", 11), (5, "x", "", 0), (-1, "y", "plain words only", 16)], key=str)
    assert html.extract(rows.limit(0)).collect() == []


def test_html_weights():
    """The scan against all runs; signs of the weights; the labelled pages come back; other weights give another text."""
    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.choice((-2.0, -1.0, -0.5, 0.0, 0.5, 1.0)) for _ in range(rng.randint(0, 12))]
        begin, end = html.best_region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        assert sum(scores[begin:end]) == pytest.approx(max(0, best))
    weights = html.learn_weights()
    assert all(x > 0 for c, x in weights.tokens.items() if c.startswith("word")) and all(x < 0 for c, x in weights.tokens.items() if c.startswith("tag"))
    whole, found, spoilt = 0, 0, 0
    for page in html.labelled_pages():
        text = html.main_text("".join(x for x, _ in page))
        words = Counter(w for x, good in page if good for w in re.findall(r"\w+", re.sub("<[^>]*>", " ", x)))
        got = Counter(re.findall(r"\w+", text))
        whole, found, spoilt = whole + words.total(), found + (words & got).total(), spoilt + (got - words).total()
    assert found >= 0.98 * whole and spoilt <= 0.02 * whole
    page = "<body><div><h1>One</h1><p>first text of the page here</p></div><hr><div class='zig'><p>another text that is quite a bit longer than the first one</p></div></body>"
    text = html.main_text(page)
    plain = html.Weights({"word": 1.0, "tag:hr": -100.0}, {})
    against = html.Weights({"word": 1.0, "tag:hr": -100.0}, {"name:zig": -9.0})
    assert "One" in text and "another" in text
    assert html.main_text(page, plain) == "another text that is quite a bit longer than the first one"
    assert html.main_text(page, against) == "One\n\nfirst text of the page here"
    assert html.main_text(page, html.Weights({"word": 0.0, "word:link": 0.0}, {})) == ""


def test_html_parts():
    """Names that speak for furniture on main elements, self-closing and unclosed elements, formulas, and long pages."""
    assert html.main_text('<main class="no-sidebar"><h1>T</h1><p>Some words of the main text.</p></main><div>x y</div>') == "T\n\nSome words of the main text."
    assert html.main_text('<article class="post has-comments"><p>Body of the article.</p></article>') == "Body of the article."
    assert html.main_text('<article><p>one</p><svg class="i"/><p>two</p><iframe src="x"/><p>E = <math><mi>m</mi></math>, three</p></article><footer>f</footer>') == "one\n\ntwo\n\nE = m, three"
    assert html.main_text('<article><p>a<svg><text>no</text></svg><ul><li>b<li>c</ul><div class="ad">buy</div><table><tr><td>1<td>2</table>d</article>') == "a\n\nb\n\nc\n\n1\n\n2\n\nd"
    assert html.main_text("<div class='ad'>" + "buy now " * 500 + "</div><article><p>short text</p></article>") == "short text"
    assert html.main_text("<main><article class='comment'><p>x</p></article><p>the text</p><section id='comments'><p>y</p></section></main>") == "the text"
    assert html.main_text("<article>" + "<p>word</p>" * 50_000 + "</article>").count("word") == 50_000
    assert html.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


# ---- 5


def test_warc(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k % 4}</p>" if k < 12 else None if k < 14 else "") for k in range(16)] + [(20, "http://h/\r\nX: y", "ünï\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit(3)).withColumn("file", F.lit("f"))
    got = {r["page_id"]: r for r in warc.archive_round_trip(pages).collect()}
    first = {}
    for i, _, h in rows:
        first.setdefault((h or "").encode(), i)
    assert len(got) == len(rows)
    for i, _, h in rows:
        p = (h or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[p] == i else ("revisit", first[p]))
        assert r["payload"] == ((h or "") if first[p] == i else None)
    again = spark.createDataFrame([(1, "u", "same"), (5, "u", "same"), (5, "u", "other"), (6, "u", "unique"), (6, "u", "same"), (6, "u", "same"), (None, "u", "same")], "page_id long, url string, html string")
    back = Counter((r["page_id"], r["payload"], r["refers_to"]) for r in warc.archive_round_trip(again).collect())
    assert back == Counter([(1, "same", None), (5, None, 1), (5, "other", None), (6, "unique", None), (6, None, 1), (6, None, 1), (None, "same", None)])
    index = warc.write_archives(warc.mark_revisits(pages, min_bytes=5))
    some = warc.read_records(index.where("page_id % 3 = 0"), gap=0, most=200)
    assert {r["page_id"] for r in some.collect()} == {i for i, _, _ in rows if i % 3 == 0}
    types = {r["page_id"]: r["record_type"] for r in index.collect()}
    assert types[15] == "response" and types[5] == "revisit"
    assert warc.archive_round_trip(pages.limit(0)).collect() == []
    with pytest.raises(ValueError):
        warc.parse_record(warc.build_record(1, "u", b"abc", None).replace(b"abc", b"abd"))
    ranges = list(warc.coalesce_ranges([("a", 0, 10), ("a", 12, 5), ("a", 40, 5), ("b", 0, 3)], 4, 100))
    assert [(f, b, e, len(m)) for f, b, e, m in ranges] == [("a", 0, 17, 2), ("a", 40, 45, 1), ("b", 0, 3, 1)]


# ---- 6


def test_license(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0."), (2, "the GNU General Public License and the MIT license, cc by"), (3, None), (4, ""), (5, "mit licenses"),
        (6, "Licensed under CC BY-NC-SA 4.0"), (7, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
        (8, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby denied"),
    ]
    got = {r["doc_id"]: r for r in license.scan_licenses(spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")).collect()}
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        spots = [(k, v) for p, v in license.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(spots))
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in spots), default=None), max((k for k, _ in spots), default=None))
        assert r["base_labels"] == ",".join(sorted({v for _, v in spots})) and 0 <= r["score"] <= 1
    assert got[1]["labels"] == "apache,apache-2.0" and got[6]["labels"] == "cc-by,cc-by-nc-sa-4.0" and got[7]["labels"] == "isc"
    assert got[7]["score"] == 1.0 and 0.3 < got[8]["score"] < 1.0 and got[8]["labels"] == ""
    assert license.scan_licenses(empty(spark)).collect() == []


def test_license_scan_plain():
    """Spans and labels of all templates against their regular expressions, spoilt wordings included; long texts take linear time."""
    scanner, rng = license.Scanner(), random.Random(4)

    def pattern(template):
        out = ""
        for m in license._MARK.finditer(template):
            if m[0] in ("[[", "]]"):
                out += "(?:" if m[0] == "[[" else ")?"
            else:
                out += f"(?:{m[2] if m[2] != '.+' else '[^ ]+'} ){{{m[3]},{m[4]}}}" if m[1] else f"{m[0]} "
        return re.compile("(?<![^ ])" + out)

    def sample(template):
        text = re.sub(r"\{\{\w+:(.*?):(\d+)-(\d+)\}\}", lambda m: " ".join(("7" if "0-9" in m[1] else "nc" if "|" in m[1] else "some") for _ in range(int(m[3]))), template)
        return " ".join(re.sub(r"\[\[[^\[\]]*\]\]", lambda m: m[0][2:-2] if rng.random() < 0.5 else "", re.sub(r"\[\[(\[\[3\]\])", r"[[", text)).replace("[[", " ").replace("]]", " ").split())

    for name, template in license.TEMPLATES.items():
        regex = pattern(template)
        for spoil in (False, True):
            words = ["aa", *sample(template).split(), "zz"]
            if spoil:
                words[rng.randrange(len(words) // 2, len(words) - 2)] = "spoilt!"
            text = " ".join(words).replace("spoilt!", "spoilt")
            found = regex.search(text + " ")
            row = scanner.scan(text)
            want = [(len(text[: found.start()].split()), len(text[: found.end()].split()))] if found else []
            assert all(x in row["spans"] for x in want) and (row["score"] == 1.0 or not found), (name, spoil)
            assert (re.sub(r"[-{].*", "", name) in row["labels"]) or spoil or not found
            assert found or 0 < row["score"] < 1 or row["spans"]
    assert 0.15 < scanner.scan("Permission is hereby granted, free of charge, to any person obtaining a copy of this software, for a fee")["score"] < 1
    row = scanner.scan("mit license " * 100_000 + "under the " * 50_000)
    assert (row["n_base"], row["first_word"], row["last_word"]) == (100_000, 0, 199_998)


def test_automaton_against_regex():
    a = license.compile_template("x", "alpha [[beta [[gamma]]]] {{v:[0-9]+:1-2}} omega")
    pattern = re.compile(r"alpha( beta( gamma)?)?( [0-9]+){1,2} omega")
    rng = random.Random(5)
    for _ in range(400):
        words = ["alpha"] + [rng.choice(["beta", "gamma", "1", "22", "omega"]) for _ in range(rng.randint(1, 5))]
        found = pattern.match(" ".join(words) + " ")
        _, end, _ = license.run_from(a, [w.encode() for w in words], 0)
        assert end == (len(found[0].split()) if found else -1)


# ---- 7


def py_prf(key, tweak, k, value):
    return int(hashlib.sha256(f"{key}:{tweak}:{k}:{value}".encode()).hexdigest()[:14], 16)


def py_digits(key, tweak, digits):
    u = len(digits) // 2
    sizes = (10**u, 10 ** (len(digits) - u))
    a, b = int(digits[:u]), int(digits[u:])
    for k in range(pii.ROUNDS):
        a, b = b, (a + py_prf(key, f"{tweak}{len(digits)}", k, b) % sizes[k % 2]) % sizes[k % 2]
    return f"{a:0{u}d}{b:0{len(digits) - u}d}"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def test_pii_neighbours(spark):
    """A card beside other numbers is found, and so are the other kinds; the numbers beside it stay."""
    card, split = "4539578763621486", "4539 5787 6362 1486"
    cases = {
        f"pay {card} 124 now": ("pay ", " 124 now", 1), f"pay 10 {card}": ("pay 10 ", "", 1), f"12 35 {card} 5-6 end": ("12 35 ", " 5-6 end", 1), f"7 {split} 12": ("7 ", " 12", 1),
        f"12 34 56 {split}": ("12 34 56 ", "", 1), f"{split}-99 12ab": ("", "-99 12ab", 1), f"{card} 2024-01-05": ("", None, 2), f"{card} 124-45-6789": ("", None, 2),
        f"{card} 555-123-4567 x": ("", None, 2), "1234567890123 4": ("1234567890123 4", "", 0), f"9 {card}a": (f"9 {card}a", "", 0), "8" * 20: ("8" * 20, "", 0),
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pii_report(rows, key="k").collect()}
    plain = pii.pii_report(spark.createDataFrame([(0, card), (1, split)], "doc_id long, text string"), key="k").collect()
    swapped = {r["doc_id"]: r["text"] for r in plain}
    for i, (text, (head, tail, n)) in enumerate(cases.items()):
        moved = swapped[1] if split in text else swapped[0]
        assert got[i]["n_found"] == n and got[i]["n_card"] == min(n, 1), text
        if n == 0:
            assert got[i]["text"] == text
        elif tail is None:
            assert got[i]["text"].startswith(moved) and not set(text.split()) & (set(got[i]["text"].split()) - {"x"})
        else:
            assert got[i]["text"] == head + moved + tail


def test_pii(spark):
    text = "mail Joe.X@mail3.example.com card 4785380592391139 or 4785-3805-9239-1139 not 4785380592391138 call +1 (017) 555-7713 ip 97.51.17.173 on 2021-02-28 and 2021-02-30 ssn 123-45-6789 token 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, text), (2, "again 4785380592391139, 97.51.17.173; 2021-02-28!"), (3, None), (4, ""), (5, "no data here, 3 apples"), (6, "4785380592391139")]
    got = {r["doc_id"]: r for r in pii.pii_report(spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, _kinds string"), key="k").collect()}
    out = got[1]["text"]
    for secret in ("Joe.X", "4785380592391139", "4785-3805", "555-7713", "97.51.17.173", "2021-02-28", "123-45-6789", "24be64439e"):
        assert secret not in out
    assert "4785380592391138" in out and "2021-02-30" in out and " +1 (" in out
    card = re.search(r"card (\d{16})", out)[1]
    assert luhn(card) and card[:-1] == py_digits("k", "card", "478538059239113")
    assert re.search(r"or ([\d-]+)", out)[1].replace("-", "") == card and re.search(r"or (\d{4}-){3}\d{4}", out)
    ip, day = re.search(r"ip ([\d.]+)", out)[1], re.search(r"on (\d{4}-\d\d-\d\d)", out)[1]
    assert all(0 <= int(x) < 256 for x in ip.split("."))
    assert got[2]["text"] == f"again {card}, {ip}; {day}!" and got[6]["text"] == card
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == rows[4][1]
    assert (got[1]["n_email"], got[1]["n_card"], got[1]["n_phone"], got[1]["n_ip"], got[1]["n_date"], got[1]["n_ssn"], got[1]["n_secret"]) == (1, 2, 1, 1, 1, 1, 1)
    assert got[3]["n_found"] == got[5]["n_found"] == 0


def test_pii_long_runs(spark):
    """Texts of a million characters without a break, and runs that once recursed or took quadratic time."""
    card = "4539578763621486"
    cases = {
        "letters": "x" * 1_000_000 + " a@b.example.com", "labels": "a@" + "b." * 500_000 + "1", "labels end": "c@" + "b." * 60 + "com", "local": "a.b" * 300_000 + "@x.org",
        "hex": "0f" * 500_000, "digits": "7" * 1_000_000, "ats": "a@" * 100_000, "dots": "1.2.3." * 100_000, "dashes": "-" * 500_000 + "@",
        "numbers": "1 22 " * 20_000 + card + " 3" * 100, "joined": "x@y.zz.a@b.com",
    }
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(cases.values())], "doc_id long, text string").repartition(4)
    got = {name: r for name, r in zip(cases, sorted(pii.pii_report(rows, key="k").collect(), key=lambda r: r["doc_id"]), strict=True)}
    want = {"letters": (1, "email"), "labels": (0, None), "labels end": (1, "email"), "local": (1, "email"), "hex": (0, None), "digits": (0, None), "ats": (0, None), "dots": (0, None), "dashes": (0, None), "numbers": (1, "card"), "joined": (2, "email")}
    for name, (n, kind) in want.items():
        assert got[name]["n_found"] == n and (kind is None or got[name][f"n_{kind}"] == n), name
        assert n or got[name]["text"] == cases[name]
    assert card not in got["numbers"]["text"] and got["numbers"]["text"].startswith("1 22 1 22") and got["numbers"]["text"].endswith(" 3" * 100)


def test_pii_cards_plain(spark):
    """Cards of runs of numbers, over several chunks, against a plain search from the left."""
    rng = random.Random(6)

    def plain(numbers):
        i, out = 0, []
        while i < len(numbers):
            fits = [j for j in range(i, min(i + 19, len(numbers))) if 13 <= len("".join(numbers[i : j + 1])) <= 19 and luhn("".join(numbers[i : j + 1]))]
            out += [(i, max(fits))] if fits else []
            i = max(fits) + 1 if fits else i + 1
        return out

    cases = [["".join(rng.choice("0123456789") for _ in range(rng.choice((1, 2, 4, 4, 4, 15, 16)))) for _ in range(rng.choice((1, 4, 7, 130, 200)))] for _ in range(40)]
    cases = [c for c in cases if len("".join(c)) >= 13]
    rows = spark.createDataFrame([(k, " ".join(c)) for k, c in enumerate(cases)], "doc_id long, text string")
    found = rows.select("doc_id", pii._pieces(F.col("text")).alias("p")).collect()
    assert len(found) == len(cases) > 30
    for r in found:
        numbers, cards = cases[r["doc_id"]], [s["m"] for s in r["p"] if s["k"] == "card"]
        assert "".join(s["m"] for s in r["p"]) == " ".join(numbers)
        assert cards == [" ".join(numbers[i : j + 1]) for i, j in plain(numbers)]


def test_pii_formats(spark):
    """Pseudonyms stay in their format, and what is not valid stays as it is; clashing columns pass through."""
    days = spark.sql("SELECT date_format(date_add(date'1900-01-01', CAST(id AS INT)), 'yyyy-MM-dd') AS d FROM range(0, 73049, 41)")
    moved = days.select("d", pii._date("k", F.col("d")).alias("p")).collect()
    assert len({r["p"] for r in moved}) == len(moved) and all("1900-01-01" <= r["p"] <= "2099-12-31" for r in moved)
    numbers = spark.createDataFrame([(f"{a:03d}-{g:02d}-{s:04d}",) for a in (1, 7, 665, 667, 899) for g in (1, 50, 99) for s in (1, 77, 9999)], "x string")
    out = [r["p"] for r in numbers.select(pii._ssn("k", F.col("x")).alias("p")).collect()]
    assert len(set(out)) == 45 and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", p) for p in out)
    rows = spark.createDataFrame([(1, "ssn 900-12-3456 and 666-12-3456 or 123-00-4567", 4, 5)], "doc_id long, text string, pii_m int, PII_K int")
    done = pii.pseudonymise(rows)
    assert done.columns == rows.columns and done.collect() == rows.collect()


def test_feistel_is_a_bijection(spark):
    n = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    moved = n.select("d", pii.permute_digits("k", F.lit("t"), F.col("d")).alias("p")).collect()
    assert len({r["p"] for r in moved}) == 1000 and all(r["p"] == py_digits("k", "t", r["d"]) for r in moved)
    a, b = pii.DAYS
    pairs = spark.range(0, a * b, 97).select(F.floor(F.col("id") / b).alias("x"), (F.col("id") % b).alias("y"))
    out = pairs.select(pii.feistel("k", F.lit("date"), F.col("x"), F.col("y"), F.lit(a), F.lit(b)).alias("q")).collect()
    assert len({(r["q"]["a"], r["q"]["b"]) for r in out}) == len(out) and all(0 <= r["q"]["a"] < a and 0 <= r["q"]["b"] < b for r in out)


# ---- 8


def test_crf_marginals_by_enumeration():
    f = toxicity.Field(weights={"=bad": 7.0, "=ugly": 4.0, "bad": -1.0}, bias=-1.0, stay=0.3, enter=0.05)
    chain, rng = toxicity.Chain(f), random.Random(2)
    for _ in range(25):
        words = [rng.choice(["bad", "ugly", "x", "y"]) for _ in range(rng.randint(1, 8))]
        total, mass = 0.0, np.zeros(len(words))
        for states in product((0, 1), repeat=len(words)):
            v, last = 1.0, 0
            for w, s in zip(words, states, strict=True):
                v *= chain.move[last][s] * (np.exp(f.emission(w) + f.bias) if s else 1.0)
                last = s
            total += v
            mass += v * np.array(states)
        active = toxicity._sequence(words, f.emission)
        assert np.allclose([mass[k] / total for k, _ in active], chain.marginals(active, len(words)))


def test_toxicity(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        words, bad = prose(rng, 60).split(), k % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["rotten", "rottenest", "vile", "vileness"]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "clean " * 5000), (None, "vile rotten vile")]
    d, la = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, la).collect()}
    held = [i for i, _ in rows[:600] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i, _ in rows[:600])
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) >= 0.97
    assert got[1000]["score"] == got[1001]["score"] < 0.5 and got[1002]["predicted"] == 0 and got[None]["predicted"] == 1
    text = rows[0][1]
    assert {text[s["begin"] : s["end"]][:4] for s in got[0]["spans"]} <= {"rott", "vile"} and got[0]["spans"]
    none = toxicity.toxicity(d, la.limit(0)).first()
    assert 0 <= none["score"] <= 1


# ---- 9


def test_packing(spark, docs, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    extra = [(300, "<|endoftext|> don't 中文 \U0001f600\x00 a b"), (301, prose(random.Random(1), 6000))]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = packing.pack(both, capacity=256).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in [*corpus, *extra]:
        ids, at = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 256)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(empty(spark)).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_plans(seed):
    """Every length is placed, bins are gapless and never overfull, and the plan is near best fit decreasing or better."""
    rng = random.Random(seed)
    histogram = Counter(rng.choice([rng.randint(1, 100), rng.randint(20, 40), 100, 51, 34]) for _ in range(rng.choice([1, 50, 3000])))
    bound = -(-sum(n * c for n, c in histogram.items()) // 100)
    for groups, large in ((256, 1 / 3), (8, 0.25), (16, 0.5)):
        plan = packing.linear_grouping(histogram, 100, groups, large)
        assert plan.rank == dict(histogram)
        fill = defaultdict(list)
        for length, lo, hi, first, offset in plan.runs:
            for k in range(hi - lo):
                fill[first + k].append((offset, length))
        assert len(fill) == plan.sequences >= bound
        for places in fill.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 100
        if groups == 256 and sum(histogram.values()) > 1000:
            plain = packing._Plan(100)
            for length, count in sorted(histogram.items(), reverse=True):
                plain.best_fit(length, count)
            assert plan.sequences <= 1.02 * plain.sequences
    assert packing.linear_grouping({}, 100).sequences == 0


def test_configurations():
    """Column generation against known optima, and its best filling against all fillings."""
    out = packing.configurations([60, 50, 40], [100, 100, 100], 100)
    assert sum(t for _, t in out) == 150
    used = Counter(k for c, t in out for k in c for _ in range(t))
    assert used == {0: 100, 1: 100, 2: 100}
    out = packing.configurations([41, 34, 25], [7, 9, 30], 100)
    assert all(sum([41, 34, 25][k] for k in c) <= 100 for c, _ in out) and Counter(k for c, t in out for k in c for _ in range(t)) == {0: 7, 1: 9, 2: 30}
    rng = random.Random(1)
    for _ in range(30):
        sizes = np.array(sorted(rng.sample(range(20, 60), 5), reverse=True))
        values = np.array([rng.random() for _ in sizes])
        picked = packing.best_pattern(sizes, values, 100)
        best = max(values[list(c)].sum() for r in range(6) for c in product(range(5), repeat=r) if sizes[list(c)].sum() <= 100)
        assert sizes[picked].sum() <= 100 and values[picked].sum() == pytest.approx(best)


def test_encoder():
    """The fast path gives the ids of ``tokenizers``, special tokens, blanks and all scripts included; another kind of tokenizer runs as it is."""
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    plain, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    rng = random.Random(2)
    marks = ["<|endoftext|>", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "'s", "'LL", "don't", "é", "中", "١٢", "²", "\U0001f600", "\x00", "\x85", "a" * 70, "-" * 40, "Ω"]
    texts = ["".join(rng.choice(marks + WORDS) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", "x" * 30000, " " * 30000]
    assert encoder.fast is not None
    assert all(ids.tolist() == plain.encode(t, add_special_tokens=False).ids for t, ids in zip(texts, encoder.encode_batch(texts), strict=True))
    other = packing.Encoder(path.replace("byte_bpe_50k", "word_bpe_49k"))
    want = Tokenizer.from_file(path.replace("byte_bpe_50k", "word_bpe_49k"))
    assert other.fast is None and [x.tolist() for x in other.encode_batch(texts[:50])] == [want.encode(t, add_special_tokens=False).ids for t in texts[:50]]


# ---- 10


def brute_repeats(rows, length=50):
    seen, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            g = b[p : p + length]
            seen[g] = min(i, seen.get(g, i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix(spark, docs, corpus):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(docs).collect()}
    assert got == brute_repeats(corpus)


def test_suffix_edges(spark):
    rng = random.Random(9)
    s = "".join(rng.choice("abc ") for _ in range(400))
    rows = [(k, s[a : a + rng.randint(40, 90)] + "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))) for k, a in enumerate(rng.randint(0, 300) for _ in range(80))]
    rows += [(100, "z" * 500), (101, "z" * 49), (102, "z" * 50), (103, "ab" * 200 + "z" * 60), (104, s), (105, "ß" * 60), (106, "ß" * 60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(df).collect()}
    assert got == brute_repeats(rows)
    odd = spark.createDataFrame([(None, s), (1, s), (1, s), (2, s), (3, None)], "doc_id long, text string")
    left = sorted((str(r["doc_id"]), r["n_removed"]) for r in suffix.remove_repeats(odd).collect())
    assert left == [("1", 0), ("1", 0), ("2", 400), ("3", 0), ("None", 0)]
    assert suffix.remove_repeats(empty(spark)).collect() == []


def test_suffix_copies(spark, monkeypatch):
    """Copies of one partition collapse before the shuffle, in any order of ids and however little is remembered."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcde ") for _ in range(n)) for n in (49, 50, 51, 304, 305, 2000)]
    rows = [(k, texts[k % 6] if k % 5 else texts[k % 6] + "tail") for k in range(120)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(df).collect()}
    assert got == brute_repeats(rows)
    known: dict = {}
    monkeypatch.setattr(suffix, "_REMEMBER", 2)
    a, b, c = (x.encode() for x in texts[1:4])
    ids, kept, (gone, starts) = suffix._collapse([5, 3, 4, 9, 9], [a, a, a, b, b], known, 50)
    assert ids == [5, 3, 9] and kept == [a, a, b] and gone.tolist() == [4] and starts.tolist() == [1]
    ids, _, (gone, _) = suffix._collapse([10, 11], [c, a], known, 50)
    assert ids == [10, 11] and not len(gone) and len(known) == 2
    doc, lo, n = suffix._whole_spans(suffix._whole(np.array([7, 8]), np.array([1, 600]), 4).column(1)[0].as_py())
    assert list(zip(doc.tolist(), lo.tolist(), n.tolist(), strict=True)) == [(7, 0, 1), (8, 0, 255), (8, 255, 255), (8, 510, 90)]


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(suffix, "_CHUNK", 64)
    suffix._Hasher._tables.clear()
    rng = random.Random(3)
    text = bytes(rng.choice(b"abcd") for _ in range(1000))
    whole = suffix.segments(np.frombuffer(text, np.uint8), np.array([len(text)]))
    covered = set()
    for first, n in zip(whole[3].tolist(), whole[4].tolist(), strict=True):
        covered.update(range(first, first + n))
    assert covered == set(range(len(text) - 49))
    parts = set()
    for data, ends, _, shift in suffix._pieces([1], [text], 50):
        *_, first, n = suffix.segments(data, ends)
        for f, m in zip(first.tolist(), n.tolist(), strict=True):
            parts.update(range(f + int(shift[0]), f + m + int(shift[0])))
    assert parts == covered
    suffix._Hasher._tables.clear()


def test_shared_segments_travel_as_bytes():
    """Their strings have the hashes of the text, meet where the first round's do, and take less room than these hashes."""
    rng = random.Random(4)
    data = np.frombuffer(prose(rng, 4000).encode() + b"z" * 300, np.uint8)
    key, _, _, first, n = suffix.segments(data, np.array([len(data)]))
    anchor, rows = suffix._windows(data, first, n, 50, 20)
    assert (anchor >> suffix._POS_BITS).tolist() == (key >> suffix._POS_BITS).tolist()
    blob = suffix._segments_packed(anchor, np.full(len(n), 7, np.int64), first, n, rows)
    got = [np.concatenate(c) for c in zip(*suffix._strings(blob, 50, 20), strict=True)]
    b = np.arange(len(data) - 49)
    assert got[3].tolist() == b.tolist() and set(got[2].tolist()) == {7} and set(got[4].tolist()) == {1}
    assert (got[0] == suffix._Hasher(data, 0).of(b, b + 50)).all()
    assert (got[1] == suffix._Hasher(data, 1).of(b, b + 50) >> np.uint64(32)).all()
    assert len(blob) < len(suffix._records(*got)) / 3


def test_stage_table_frees_its_shuffle(spark):
    """At the end of the write, not when the driver collects garbage; the table it was made from can still be used."""
    import time

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}

    before, settings = files(), spark.conf.get(common._CLEANUP)
    df = spark.range(20_000).repartition(5, "id")
    out = common.stage_table(df, "frees")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(common._CLEANUP) == settings
    assert out.count() == df.count() == 20_000


# ---- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    words = [f"{rng.choice(WORDS)}{rng.choice('aeiou')}{k % 37}" for k in range(500)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    item = text(30)
    rows = [(k, text(120)) for k in range(20)]
    rows += [(20, rows[0][1]), (21, rows[1][1] + " end"), (22, text(60) + " " + item + " " + text(60)), (23, "junk### " * 80), (24, text(10)), (25, text(100) + " mail bob@mail.example.com"), (26, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        now = common.stage_table(out, f"t-{name}")
        kept[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    assert set(kept["quality"]) == {i for i, t in rows if brute_quality(t)[0] >= 50} - {23}
    sets = {i: five_words(t) for i, t in kept["quality"].items()}
    copies = {i for i in sets if any(j < i and jaccard(sets[i], sets[j]) >= 0.8 for j in sets)}
    assert copies == {20, 21} and set(kept["near_dedup"]) == set(sets) - copies
    assert set(kept["decontaminate"]) == set(kept["near_dedup"]) - {22}
    assert "bob@" not in kept["pii"][25] and kept["pii"][2] == rows[2][1]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(kept["pii"])


@pytest.mark.parametrize("name", ["op3_quality", "op5_warc", "op10_suffix"])
def test_oracles(spark, name):
    """Registered queries against their SQL on the smallest tables."""
    import os

    import duckdb

    from graphloom.llm.queries import ORACLES, QUERIES

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    df = QUERIES[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    """Explode keeps Spark's size estimate, so small files look small enough to broadcast however many variants they make."""
    plans, real = {}, simhash.stage_table

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(simhash, "stage_table", noted)
    docs = spark.createDataFrame([(k, f"one two three four five six seven {k % 3}") for k in range(9)], "doc_id long, text string")
    assert simhash.near_components(docs).count() == 9
    assert simhash.simhash_components(docs).count() == 9
    assert simhash.simhash_components(docs, blocks=1).count() == 9
    for name in ("near-met", "ball-crowded", "simhash-links"):
        assert "Join" in plans[name] and "Broadcast" not in plans[name], name
