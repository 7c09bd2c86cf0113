"""Classifiers, pages, vectors, tokens and packing."""

import hashlib
import math
import time
import random
import struct
import tracemalloc
import zlib
from fractions import Fraction

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

from tilecask.llm import bpe, embeddings, ftrl, language, maxscore, packing, pages, toxicity
from test_texts import odd, table

TOKENIZER = path("word_bpe_49k.json")
ALPHABETS = {"aa": "abcde ", "bb": "fghij ", "cc": "klmno ", "ünd": "äöüß "}


def letters(r, lang, n):
    return "".join(r.choice(ALPHABETS[lang]) for _ in range(n)) + ALPHABETS[lang][0]


# models ---------------------------------------------------------------------------


def test_language(spark):
    r = random.Random(1)
    langs = [r.choice(list(ALPHABETS)) for _ in range(400)]
    rows = [(i, letters(r, g, r.randrange(20, 200)), g) for i, g in enumerate(langs)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !?", "aa"), (1003, letters(r, "bb", 50), None), (None, letters(r, "cc", 50), "cc")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score_", F.lit(1))
    model = language.fit(df)
    assert model.labels == sorted(ALPHABETS) and (model.weights == 0).mean() > 0.5
    got = {x["doc_id"]: x for x in language.predict(df, model).withColumn("h", language.held_out("doc_id")).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["h"] == (i in set(held)) for i in range(400)) and got[None]["h"] is False
    assert np.mean([got[i]["lang_pred"] == langs[i] for i in held]) > 0.98
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "bb" and all(0 <= x["score"] <= 1 for x in got.values())
    relabelled = df.withColumn("lang", F.when(language.held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang")))
    assert "zz" not in language.fit(relabelled).labels


def test_language_odd_tables(spark):
    empty = table(spark, [])
    model = language.fit(empty)
    assert language.predict(empty, model).count() == 0
    assert {x["lang_pred"] for x in language.predict(table(spark, ["some text", None]), model).collect()} == {"und"}
    got = language.predict(odd(spark), language.fit(odd(spark)))
    assert got.columns == [*odd(spark).columns, "lang_pred", "score"] and got.count() == 9


def test_long_texts_count_as_their_parts(monkeypatch):
    r = random.Random(2)
    texts = [letters(r, "aa", 500) + " , " * k + letters(r, "ünd", 300) for k in range(1, 9)]
    whole = [language.counts(t) for t in texts]
    for part in (1, 2, 7, 64):
        monkeypatch.setattr(language, "PART", part)
        assert all((language.counts(t) == w).all() for t, w in zip(texts, whole, strict=True))
    assert all(language.counts(t) is None for t in ("", " ", "1 2 3", "!" * 100))


def test_ftrl_and_temperature():
    r = np.random.default_rng(3)
    rows = [(np.sort(r.choice(50, 6, replace=False)), np.ones(6)) for _ in range(300)]
    target = np.array([[float(7 in at or 3 in at)] for at, _ in rows])
    w = ftrl.fit(rows, target, 50, ftrl.Penalty(0.5, 1, 5.0, 0.1), 5, many=False)
    assert set(np.argsort(-w[:50, 0])[:2]) == {3, 7} and (w[:50, 0] == 0).sum() > 5
    z = np.array([[4.0, 0.0]] * 60 + [[0.0, 4.0]] * 40)
    y = np.array([[1.0, 0.0]] * 80 + [[0.0, 1.0]] * 20)
    t = ftrl.temperature(z, y)
    p = ftrl.softmax(z / t)
    assert t > 1.5 and abs(p.max(1).mean() - 0.8) < 0.03 and ftrl.temperature(z[:0], y[:0]) == 1.0


def test_toxicity(spark):
    r = random.Random(4)
    abuse = ["schlimmwort", "zarquon", "belgium", "frell", "smeg", "grozit", "krout", "dren"]
    rows, labels = [], []
    for i in range(2600):
        own = [f"w{r.randrange(3000)}" for _ in range(r.randrange(20, 120))]
        bad = r.random() < 0.25
        for _ in range(r.randrange(1, 4) if bad else 0):
            own.insert(r.randrange(len(own)), r.choice(["", "Very-"]) + r.choice(abuse) + r.choice(["", "!", "en"]))
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    rows += [(5000, None), (5001, ""), (5001, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels[:2200] + [(1, None), (7777, 1), (None, 1)], "doc_id bigint, toxic int")
    chain = toxicity.fit(docs, known)
    got = {x["doc_id"]: x for x in toxicity.score(docs, chain).collect()}
    assert [c for c in got[0].asDict() if c.startswith("p_")] == ["p_kind_1", "p_kind_2", "p_toxic"]
    held = range(2200, 2600)
    assert np.mean([got[i]["is_toxic"] == bool(labels[i][1]) for i in held]) > 0.95
    assert got[5000]["p_toxic"] == got[5001]["p_toxic"] == 0 and not got[5000]["is_toxic"] and not got[5001]["is_toxic"]
    assert chain.earlier[2, :2].any() and not chain.earlier[0].any()
    kinds = toxicity.kinds_of([np.array(x) for x in ([1, 2], [2, 9], [1, 2, 8], [5, 6], [6, 5, 9], [5], [8], [9], [7])] * 5, np.array(([True] * 6 + [False] * 3) * 5), features=10)
    assert [set(np.flatnonzero(kinds[:6, k])) for k in sorted(range(2), key=lambda k: not kinds[0, k])] == [{0, 1, 2}, {3, 4, 5}] and not kinds[6:9].any()
    nothing = toxicity.fit(docs, known.where("toxic = 0"))
    assert not any(x["is_toxic"] or x["p_toxic"] for x in toxicity.score(docs.limit(5), nothing).collect())
    assert toxicity.score(table(spark, []), chain).count() == 0 and toxicity.score(odd(spark), chain).count() == 9


# pages ----------------------------------------------------------------------------


def text_of(html):
    return "\n".join(x.text for x in pages.body(pages.parse(html)))


def test_structure():
    assert text_of('<body><header>H</header><nav>n</nav><main><header><h1>T</h1></header><p>a&nbsp;b <i>c</i>d<br>e<p>f &lt;b&gt;<aside>z</aside><ul><li>one<li>two</ul>tail</main><footer>q') == "T\na b cd e\nf <b>\none\ntwo\ntail"
    assert text_of('<script>x="</p>"</script><style>p{}</style><!-- c --><p>kept</p><form>no<input></form><div class="cookie-notice">no</div>') == "kept"
    assert text_of('<article class="no-sidebar"><p>in</p><div id="comments"><p>out</p></div></article><p>beside</p>') == "in"
    assert text_of('<div role="navigation">no</div><p title="a>b">yes</p><p hidden>no</p>') == "yes"
    assert text_of("") == text_of("<p> &nbsp; </p>") == text_of("<script>never closed") == "" and text_of("plain &amp; simple") == "plain & simple"
    assert text_of("<p>" + "x " * 200000 + "</p>") == ("x " * 200000).strip()
    assert text_of("<table><tr><td>a<td>b<tr><td>c</table><p>d") == "a\nb\nc\nd"


def test_common_is_longest():
    r = random.Random(5)

    def length(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(20))] for _ in range(2))
        found = [a[i] for i in sorted(pages.common(a, b))]
        rest = iter(b)
        assert len(found) == length(a, b) and all(x in rest for x in found)
    many = ["-"] * 30000
    assert len(pages.common(["x", *many, "y"], ["z", *many, *many, "w"])) == 30000


def longest_common(a, b):
    """Places in ``a`` of a longest common subsequence, by the table of all lengths."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = set()
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def differenced(rows):
    """The expected texts of ``(id, url, article, blocks)``, by looking at every page of the host."""
    cases = {}
    for _, url, article, blocks in rows:
        host, _, path = url.removeprefix("http://").partition("/")
        key = host, article, tuple(blocks)
        cases[key] = min(cases.get(key, path), path)
    out = {}
    for i, url, article, blocks in rows:
        host = url.removeprefix("http://").partition("/")[0]
        own = cases[host, article, tuple(blocks)]
        near = []
        for (h, g, b), path in cases.items():
            if h == host and (g, b) != (article, tuple(blocks)):
                same = next((k for k, (x, y) in enumerate(zip(own, path, strict=False)) if x != y), min(len(own), len(path)))
                between = sum(1 for (h2, *_), p in cases.items() if h2 == host and min(own, path) < p < max(own, path))
                near.append((-same, between, path > own, b))
        near.sort(key=lambda x: x[:3])
        if article:
            gone = set.intersection(*(longest_common(blocks, b) for *_, b in near[:4])) if len(near) >= 4 else set()
        else:
            gone = longest_common(blocks, near[0][3]) if near else set()
        out[i] = "\n".join(x for k, x in enumerate(blocks) if k not in gone)
    return out


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_neighbours(spark, parts):
    rows = []
    for i in range(60):  # pages without an article, whose frame only their neighbours tell
        rows.append((i, f"http://h.org/a/{i:02d}", False, ["Site of things", f"Text {i} of its own.", "Menu one", f"More of {i}.", "All rights kept"]))
    for i in range(100, 130):  # articles with a line of the frame in each, and a quotation in some
        rows.append((i, f"http://b.org/{i % 3}/x{i}", True, [f"Story {i}", "Read more on our site", *["As was said"] * (i % 5 == 0), f"End of {i}"]))
    rows += [(200 + k, f"http://h.org/a/07?copy={k}", False, rows[7][3]) for k in range(5)] + [(300, "http://b.org/1/y", True, rows[70][3])]
    rows += [(400, "http://few.org/a", True, ["One", "Shared"]), (401, "http://few.org/b", True, ["Two", "Shared"])]
    html = [(i, u, ("<article>{}</article>" if g else "{}").format("".join(f"<p>{x}</p>" for x in b))) for i, u, g, b in rows]
    html += [(510, "http://other.org/x", "<div>Alone</div><p>Here</p>"), (511, None, None), (512, "not a url", "<p>t</p>"), (512, "not a url", "<p>t</p>"), (None, "not a url", "<p>t</p>")]
    df = spark.createDataFrame(html, "page_id bigint, url string, html string").repartition(parts)
    for c in ("path", "host", "body", "row", "rank", "gone"):
        df = df.withColumn(c, F.lit(c))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(parts, 12)))
    try:
        found = pages.extract(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {r["page_id"]: r["text"] for r in found}
    want = differenced(rows)
    assert {i: got[i] for i in want} == want and want[5] == "Text 5 of its own.\nMore of 5." and want[400] == "One\nShared"
    assert want[105] == "Story 105\nAs was said\nEnd of 105" and want[300] == want[rows[70][0]]
    assert got[510] == "Alone\nHere" and got[511] == "" and got[512] == got[None] == "t" and len(found) == len(html)
    assert all(r["n_chars"] == len(r["text"]) for r in found) and pages.extract(df.limit(0)).count() == 0


def test_neighbours_across_cells(spark, monkeypatch):
    rows = [(i, f"http://h.org/{i:03d}", True, [f"Story {i}", "Read more", f"End of {i}"]) for i in range(50)]
    html = spark.createDataFrame([(i, u, f"<main><p>{'</p><p>'.join(b)}</p></main>") for i, u, _, b in rows], "page_id bigint, url string, html string")
    monkeypatch.setattr(pages, "CELL", 5)
    assert {r["page_id"]: r["text"] for r in pages.extract(html).collect()} == {i: f"Story {i}\nEnd of {i}" for i in range(50)}


# vectors --------------------------------------------------------------------------


def vectors(spark, extra=True):
    r = np.random.default_rng(6)
    rows = [(i, r.standard_normal(16).tolist(), int(r.integers(3))) for i in range(400)]
    base = r.standard_normal(16)
    rows += [(1000 + i, (base * (1 + i) + r.standard_normal(16) * 0.12 * np.linalg.norm(base) / 4 * (1 + i)).tolist(), 1) for i in range(80)]
    rows += [(2000, base.tolist(), 1), (2001, base.tolist(), 1), (2002, (base * 3).tolist(), 1), (2003, base.tolist(), 2), (2003, base.tolist(), 2)]
    if extra:
        rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [1.0, None] * 8, 1), (3004, [float("nan")] * 16, 1), (3005, [float("inf")] * 16, 1), (3006, base.tolist(), None), (3007, base.tolist()[:8], 1), (3020, [1e300] * 16, 0)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("key", F.lit(1)).withColumn("n", F.lit(2)), rows


def test_embeddings_of_many_near_vectors(spark):
    """Thousands of near vectors in one bucket: every link counted, in memory that does not grow with pairs."""
    import resource

    r = np.random.default_rng(10)
    base = r.standard_normal(64)
    rows = base + r.standard_normal((3000, 64)) * 0.12
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    ones = np.ones(3000, np.int64)
    tables = embeddings.buckets(unit, ones)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    links, near, root = embeddings.linked(unit, tables, 0, ones, None, 0.93)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 << 10
    assert near.all() == (want > 0).all() and (root == root[0]).mean() > 0.99
    assert links.sum() == want.sum()
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(rows.tolist())], "vec_id bigint, embedding array<double>, label int")
    got = {x["vec_id"]: x["n_links"] for x in embeddings.near_duplicates(df, 0.93, block=500).collect()}
    assert sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= want[i] for i in got)


@pytest.mark.parametrize("block", [7, 2048])
def test_embeddings(spark, block):
    df, rows = vectors(spark)
    got = embeddings.near_duplicates(df, 0.93, block=block).collect()
    assert len(got) == len(rows)
    fine = [(i, np.array(v, float), g) for i, v, g in rows if v and g is not None and None not in v and np.isfinite(v).all() and any(v)]
    unit = [x / np.abs(x).max() for _, x, _ in fine]
    unit = [x / np.linalg.norm(x) for x in unit]
    near = [[b for b in range(len(fine)) if a != b and fine[a][2] == fine[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93] for a in range(len(fine))]
    comp = [f[0] for f in fine]
    for _ in range(len(fine)):
        new = [min([comp[a], *(comp[b] for b in near[a])]) for a in range(len(fine))]
        if new == comp:
            break
        comp = new
    want = sorted((f[0], len(n), c) for f, n, c in zip(fine, near, comp, strict=True))
    linked = {f[0] for f in fine}
    mine = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] in linked)
    total, found = sum(w[1] for w in want), sum(m[1] for m in mine)
    assert found >= 0.97 * total and all(m[1] <= w[1] for m, w in zip(mine, want, strict=True))
    assert sum(m[2] == w[2] for m, w in zip(mine, want, strict=True)) >= 0.99 * len(want)
    assert all((r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True) for r in got if 3000 <= r["vec_id"] < 3020)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_maxscore(spark):
    df, rows = vectors(spark, extra=False)
    more = spark.createDataFrame([(4000, None, 1), (4020, [float("nan")] * 16, 1), (None, [1.0] * 16, 1), (4040, [1.0] * 8, 1)], "vec_id bigint, embedding array<double>, label int").withColumn("key", F.lit(1)).withColumn("n", F.lit(2))
    every = df.union(more)
    got = maxscore.top_k(every, every.where("vec_id % 20 = 0"), 20)
    by = {}
    for r in got.orderBy("query_id", "rank").collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = [(i, np.floor(64 * np.array(x)).astype(int)) for i, x, _ in rows]
    for q, x in v:
        if q % 20:
            continue
        best = sorted(((-int(x @ y), i) for i, y in v if i != q))[:20]
        assert by[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert 4020 not in by and 4000 not in by and 4040 not in by
    few = every.where("vec_id < 5")
    assert maxscore.top_k(few, few.where("vec_id = 0"), 20).count() == 4 and maxscore.top_k(few.limit(0), few.limit(0), 3).count() == 0


def top_by_force(rows, queries, k):
    """``(query id, [(id, score), ...])`` of each query row against all rows but its own, with whole numbers."""
    whole = lambda v: [math.floor(Fraction(x) * 64) for x in v]
    every = [(i, whole(v)) for i, v in rows]
    used, out = set(), []
    for q, v in queries:
        x = whole(v)
        own = next((n for n, row in enumerate(rows) if row == (q, v) and n not in used), None)
        used.add(own)
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for n, (i, y) in enumerate(every) if n != own)
        out.append((q, [(i, max(min(-s, 2**63 - 1), -(2**63))) for s, i in scored[:k]]))
    return out


def ranked(df):
    """The same from a result; queries of one id have as many rows of each rank, in any order."""
    by = {}
    for r in df.collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in by.items()}


def as_ranked(found):
    by = {}
    for q, best in found:
        by.setdefault(q, []).extend((k + 1, i, s) for k, (i, s) in enumerate(best))
    return {q: sorted(v) for q, v in by.items()}


def test_maxscore_of_repeated_rows(spark):
    """Every row is a query and a candidate of its own, whatever its id."""
    r = np.random.default_rng(8)
    v = [(i, [float(x) for x in r.standard_normal(6)]) for i in range(600)]
    own = [(0, [4 * x for x in v[0][1]])] * 300
    rows = [*v[1:], *own, (20, v[5][1]), (20, v[5][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    asked = [*own[:5], (0, [9.0] * 6), v[1], v[1], (20, v[5][1]), (20, v[5][1]), v[20]]
    got = ranked(maxscore.top_k(df, spark.createDataFrame(asked, df.schema), 7))
    assert got == as_ranked(top_by_force(rows, asked, 7))
    assert [s for _, i, s in got[0] if i == 0]  # other rows of its id are candidates


@pytest.mark.parametrize("shard", [50, 4096])
def test_maxscore_of_large_components(spark, shard, monkeypatch):
    r = np.random.default_rng(9)
    sizes = [1.0, 1e3, 1e9, 1e12, 1e15, 1e150, 1e300]
    rows = [(i, [float(x) for x in r.standard_normal(5) * (sizes[i % 7] if i % 3 else 1.0)]) for i in range(240)]
    rows += [(300 + i, [1e12 + i % 3, -1e12, 0.5, 3.0, 1.0]) for i in range(30)] + [(400, [1.7e308] * 5), (401, [-1.7e308] * 5), (402, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = [x for x in rows if x[0] % 20 == 0]
    monkeypatch.setattr(maxscore, "SHARD", shard)
    assert ranked(maxscore.top_k(df, df.where("vec_id % 20 = 0"), 20)) == as_ranked(top_by_force(rows, asked, 20))


def test_ordered_bytes():
    numbers = sorted([0, 1, -1, 255, 256, -255, -256, -257, 2**63, -(2**63), 2**64, *(s * 3**n for n in range(1, 700, 7) for s in (1, -1))])
    assert sorted(numbers, key=maxscore.ordered_bytes) == numbers


def test_maxscore_search_is_exact():
    r = np.random.default_rng(7)
    for shape in ((12, 5000), (3, 40), (40, 900)):
        lists = np.floor(r.standard_normal(shape) * r.uniform(0, 60, (shape[0], 1)))
        ids = r.permutation(shape[1])
        for _ in range(10):
            q = np.floor(r.standard_normal(shape[0]) * 64)
            found, scores = maxscore.search(q, lists, lists.min(1), lists.max(1), ids, 15, sample=50)
            every = q @ lists
            want = np.lexsort((ids, -every))[:15]
            assert list(found) == list(want) and list(scores) == list(every[want])


# tokens and packing ---------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(TOKENIZER, memo=50)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def test_tokens_as_the_library(codec, library):
    r = random.Random(8)
    parts = ["a", "e", "th", "é", "ß", "Σ", "σ", "1", "²", "Ⅷ", "!", "?", "'s", "'LL", "\x1c", "\x85", "​", " ", " ", "\n", "<|endoftext|>", "<|", "日本", "é", "İ", "�", "🙂", " ", "ing", "tion", "s", "x" * 40, "ha" * 90, "o" * 500]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randrange(30)))
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.ids(text) == want
        decoder = bpe.Decoder(codec.v)
        assert "".join([*(decoder.feed([i]) for i in want), decoder.finish()]) == library.decode(want, skip_special_tokens=False)


def test_long_texts_in_parts(library, monkeypatch):
    monkeypatch.setattr(bpe, "PART", 5)
    text = "Some words, in<|endoftext|> parts\n\n and averyveryverylongword   " * 20
    assert bpe.Codec(TOKENIZER).ids(text) == library.encode(text, add_special_tokens=False).ids


def test_memos_of_a_worker_take_bounded_memory():
    """More words than the memos hold, each plain, with a capital and with a stop: 24 MB of text that no worker may keep ten times over."""
    codec = bpe.Codec(TOKENIZER)
    for memo in vars(codec).values():
        if isinstance(memo, bpe.Memo) and memo.make.__name__ == "_word":
            memo.make = lambda word: bytes(12)
    tracemalloc.start()
    for at in range(0, 800_000, 1 << 14):
        words = ["".join(chr(97 + (i >> 4 * k) % 16) for k in range(5)) for i in range(at, min(800_000, at + (1 << 14)))]
        assert sum(len(some) for some in codec.encode(" ".join(f"{w} {w.title()} {w}." for w in words))) >= 3 * len(words)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 100e6


def test_long_words_take_bounded_memory(codec, library):
    r = random.Random(9)
    stems = [w.removesuffix("</w>") for w in codec.v.ids if w.removesuffix("</w>").isalpha() and w.isascii() and w.removesuffix("</w>").islower()]
    for k in range(25):
        word = "".join(r.choice("ab" if k % 3 == 0 else "abcdefghij" if k % 3 == 1 else stems[:5000]) for _ in range(r.randrange(200, 4000)))
        t = bpe.Transducer(codec.v, step=16)
        ids, most = [], 0
        for at in range(0, len(word), 37):
            ids += t.feed(word[at : at + 37].encode())
            most = max(most, len(t.held))
        ids += t.finish()
        assert ids == library.encode(word, add_special_tokens=False).ids and most < 4 * t.limit


def test_decoder_of_bytes(codec):
    text = "süße 日本 🙂 done"
    d = bpe.Decoder(codec.v, to_bytes=True)
    assert "".join(d.feed([i]) for i in codec.ids(text)) + d.finish() == text + " "


def test_token_table(spark, library):
    texts = [None, "", "Hello  World's", "x" * 300000, " ".join(["same"] * 50000), "é"]
    got = {r["doc_id"]: r for r in bpe.digest_table(table(spark, texts), TOKENIZER).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    whole = bpe.encode_table(table(spark, texts[:3]), TOKENIZER).orderBy("doc_id").collect()
    assert whole[2]["decoded"] == library.decode(whole[2]["ids"], skip_special_tokens=False) and whole[0]["ids"] == []
    assert bpe.digest_table(odd(spark), TOKENIZER).count() == 9 and bpe.digest_table(table(spark, []), TOKENIZER).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(6))
def test_layout(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 100, 2048])
    counts = {}
    for _ in range(r.choice([1, 30, 500])):
        k = min(capacity, int(r.expovariate(1 / (capacity * r.choice([0.05, 0.3, 0.6])))) + 1)
        counts[k] = counts.get(k, 0) + r.choice([1, 1, 7, 1000])
    rows, large = [], {}
    for length, _, n, first, offset in packing.layout(dict(counts), capacity):
        for k in range(min(n, 3000)):
            rows.append({"sequence_id": first + k, "offset": offset, "length": length})
            if 3 * length > capacity:
                large[first + k] = large.get(first + k, 0) + 1
        assert n <= 3000 or seed >= 0
    if max(counts.values()) <= 3000:
        assert max(large.values(), default=0) <= 2
        n = check_packing(rows, capacity)
        least = math.ceil(sum(k * v for k, v in counts.items()) / capacity)
        assert n <= max(least * 1.25 + 2, sum(v for k, v in counts.items() if 2 * k > capacity) * 1.15 + 2)


def test_packing(spark, library):
    r = random.Random(10)
    texts = [None, "", *(" ".join(r.choice(["alpha", "beta", "gamma", "Δ"]) for _ in range(r.choice([1, 3, 20, 90, 400]))) for _ in range(300))]
    got = packing.pack(table(spark, texts).repartition(3), TOKENIZER, capacity=128).collect()
    want = {}
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 128):
            want[i, k // 128] = (k, len(ids[k : k + 128]), zlib.crc32(struct.pack(f"<{len(ids[k : k + 128])}I", *ids[k : k + 128])))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    n = check_packing(got, 128)
    assert n <= math.ceil(sum(w[1] for w in want.values()) / 128) * 1.05 + 1
    assert packing.pack(table(spark, []), TOKENIZER).count() == 0 and packing.pack(odd(spark), TOKENIZER).select("doc_id").distinct().count() == 8
    whole = packing.place(packing.cut_table(table(spark, ["one two", "three"]), TOKENIZER, 16, with_ids=True), 16)
    assert packing.sequences(whole).first()["ids"].count(0) == 2


@pytest.mark.parametrize("size", [60, 1 << 18])
def test_maxscore_of_queries_together(size):
    """Many queries at once find what each finds alone, with few essential lists or all, in single precision or double."""
    r = np.random.default_rng(17)
    for d, n, slope in ((12, 3000, 0), (16, 3000, 1.5), (40, 900, 0.3), (3, 30, 0)):
        lists = np.floor(r.standard_normal((d, n)) * size * np.exp(-slope * np.arange(d))[:, None])
        lists[:, n // 2 : n // 2 + 40] = lists[:, :1]  # equal scores
        ids, asked = r.permutation(n), lists[:, r.integers(0, n, 300)].T.copy()
        own = np.where(r.random(300) < 0.5, r.integers(0, n, 300), -1)
        q, place, scores = maxscore.search_many(asked, lists, ids, own, 20, sample=100)
        for i in range(300):
            able, every = np.delete(np.arange(n), own[i] if own[i] >= 0 else []), asked[i] @ lists
            want = able[np.lexsort((ids[able], -every[able]))[:20]]
            assert list(place[q == i]) == list(want) and list(scores[q == i]) == list(every[want])


def test_maxscore_of_many_queries_takes_little_time():
    """As many vectors and queries as a cell may have: together they cost a fraction of what each costs alone."""
    r = np.random.default_rng(18)
    lists = np.floor(r.standard_normal((64, 4096)) * 8)
    ids, asked = np.arange(4096), np.floor(r.standard_normal((512, 64)) * 8)
    low, high, began = lists.min(1), lists.max(1), time.process_time()
    alone = [maxscore.search(x, lists, low, high, ids, 20) for x in asked]
    middle = time.process_time()
    q, place, _ = maxscore.search_many(asked, lists, ids, np.full(512, -1), 20)
    assert time.process_time() - middle < (middle - began) / 2
    assert all(list(place[q == i]) == list(found) for i, (found, _) in enumerate(alone))


@pytest.mark.parametrize("products", [0, 64])
def test_maxscore_of_few_essential_lists(monkeypatch, products):
    """Places that still compete after a few lists are probed; the scores stay exact."""
    monkeypatch.setattr(maxscore, "PRODUCTS", products)
    r = np.random.default_rng(19)
    d, n = 24, 3000
    scale = np.where(np.arange(d) < 4, 400.0, 4.0)
    lists, asked = np.floor(r.standard_normal((d, n)) * scale[:, None]), np.floor((r.choice([-1, 1], (200, d)) + r.standard_normal((200, d)) / 9) * scale)
    ids, probed, chosen = r.permutation(n), [], np.ix_
    monkeypatch.setattr(np, "ix_", lambda *a: probed.append(1) or chosen(*a))
    q, place, scores = maxscore.search_many(asked, lists, ids, np.full(200, -1), 20, sample=400)
    every = asked @ lists
    for i in range(200):
        want = np.lexsort((ids, -every[i]))[:20]
        assert list(place[q == i]) == list(want) and list(scores[q == i]) == list(every[i, want])
    assert probed or products
