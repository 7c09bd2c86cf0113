"""Text operators against brute force, and on odd tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilecask.llm import components, frames, lines, minhash, shingles, suffixes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use inside.
CLASHES = ("id", "key", "row", "n", "wanted", "gone", "bucket", "cluster", "c0", "other", "first", "line")


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], DOCS)


def odd(spark):
    """Nulls, an empty and a long text, repeated rows and ids, a null id, columns of clashing names."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(40000))
    df = table(spark, [None, "", "  \n\t", "one", "one", long, long + " more", "tie " * 300, "tie " * 300], [0, 1, 2, 3, 3, 5, 6, None, 8])
    for c in CLASHES:
        df = df.withColumn(c, F.lit(c))
    return df


def words(r, n, k=400):
    return " ".join(f"word{r.randrange(k)}" for _ in range(n))


def variants(seed, groups=12, near=4):
    """Texts with copies, edits and shared passages."""
    r = random.Random(seed)
    passage = words(r, 60)
    out = []
    for g in range(groups):
        base = words(r, r.randrange(30, 200), 5000).split()
        out.append(" ".join(base))
        for _ in range(r.randrange(near)):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, 5, 20])):
                own[r.randrange(len(own))] = f"edit{r.randrange(9999)}"
            out.append(" ".join(own))
        if g % 3 == 0:
            out.append(f"{words(r, 20, 9999)}\n{passage}\n{words(r, 20, 9999)}")
    return out


# near duplicates -------------------------------------------------------------------


def shingle_set(text, width):
    low = (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components_by_force(sets, ids, percent=80):
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = defaultdict(list)
    for i in range(len(sets)):
        if ids[i] is not None:
            least[top(i)].append(ids[i])
    return [min(least[top(i)], default=None) for i in range(len(sets))]


@pytest.mark.parametrize("block", [1, 2, 3, 1024])
def test_minhash_against_force(spark, block):
    texts = variants(1)
    sets = [shingle_set(t, 4) for t in texts]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(table(spark, texts), 4, 80, block=block).collect()}
    want = components_by_force(sets, list(range(len(texts))))
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert all(got[i]["kept"] == (i == want[i]) for i in got)


def test_minhash_chain_without_a_middle(spark):
    """Texts that are linked only by a third one."""
    base = [f"b{i}" for i in range(60)]
    left, right = list(base), list(base)
    left[20], right[40] = "l", "r"
    texts = [" ".join(x) for x in (left, right, base)]
    assert components_by_force([shingle_set(t, 4) for t in texts[:2]], [0, 1]) == [0, 1]
    assert {r["component_id"] for r in minhash.near_duplicates(table(spark, texts), 4).collect()} == {0}


def test_minhash_odd_tables(spark):
    got = minhash.near_duplicates(odd(spark), 5).collect()
    assert len(got) == 9
    by = {(r["doc_id"], r["n_shingles"]): r for r in got}
    assert by[0, 0]["kept"] and by[1, 0]["kept"] and by[2, 0]["component_id"] == 2
    assert by[3, 1]["component_id"] == 3 and by[6, next(n for i, n in by if i == 6)]["component_id"] == 5
    assert by[None, 1]["component_id"] == 8 and not by[None, 1]["kept"]
    assert minhash.near_duplicates(table(spark, []), 5).count() == 0


def test_words_and_signatures():
    r = random.Random(2)
    texts = [b"", b" \n", "Ünder The  sea\x0bx".encode(), words(r, 30000).encode(), b"y" * 3_000_000 + b" z"]
    h, first = shingles.words_of(texts)
    assert list(first) == [0, 0, 0, 4, 30004, 30006]
    seen = defaultdict(set)
    for own, a in zip((t.split() for t in (x.translate(shingles.LOWER) for x in texts)), first, strict=False):
        for k, w in enumerate(own):
            seen[w].add(int(h[a + k]))
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)
    a, b = (next(iter(shingles.shingle_sets([t], 3))) for t in (texts[3], texts[3] + b" and a few more words"))
    agree = (minhash.signature(a) == minhash.signature(b)).mean()
    both = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    assert abs(agree - both) < 0.1


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(25)]
    got = dict(components.connected(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect())
    root = {x: x for e in links for x in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: v for x, v in root.items() if any(x in e and e[0] != e[1] for e in links)}
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_joins_of_heavy_keys(spark):
    """A join whose heavy keys are dealt to many places has the rows of a plain one."""
    r = random.Random(14)
    left = [(r.choice([1, 1, 1, 1, None, 2, *range(3, 40)]), k) for k in range(3000)]
    a = spark.createDataFrame(left, "k bigint, a bigint")
    b = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (5, 50), (None, 0)], "k bigint, b bigint")
    heavy = frames.heavy_keys(a.groupBy("k").count().where("k is not null"), ["k"], "count")
    assert 1 <= len(heavy) < 256
    rows = lambda df: sorted(map(repr, df.collect()))
    for how in ("inner", "left", "left_semi"):
        for keys in (heavy, []):
            assert rows(frames.spread_join(a, b, ["k"], keys, ["a"], how)) == rows(a.join(b, "k", how))
    assert frames.heavy_keys(a.limit(0).groupBy("k").count(), ["k"], "count") == []


def test_temporaries(spark):
    from tilecask.sources.scratch import folders, shared_dir

    shared_dir(spark)
    look = lambda: {*folders(spark, shared_dir(spark)), *folders(spark, spark.sparkContext.getCheckpointDir())}
    before = look()
    with frames.temporaries(spark):
        assert frames.stored(spark.range(10), 2).count() == frames.settle(spark.range(10)).count() == 10
        assert len(look() - before) == 2
    assert look() == before


# repeated strings -------------------------------------------------------------------


def repeats_by_force(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if n[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


def as_rows(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize("length", [60, 200])
def test_suffixes_against_force(spark, length):
    r = random.Random(4)
    texts = variants(5) + ["ab" * 400, "a" * 700, "xyz" + "a" * 450, "ü" * 300, "short", "short", "".join(r.choice("ab") for _ in range(3000))]
    want = sorted((i, *w) for i, w in enumerate(repeats_by_force(texts, length)))
    assert as_rows(suffixes.digest_table(table(spark, texts), length)) == want


@pytest.mark.parametrize("group", [1, 3, 8, 1000])
def test_suffixes_of_a_hot_anchor(spark, group):
    """Anchors with more surroundings than a task may hold are split, down to single windows."""
    r = random.Random(6)
    passage, other = words(r, 40), words(r, 25)
    texts = [f"{words(r, 30, 9999)} {passage} {words(r, 30, 9999)}" for _ in range(12)]
    texts += [f"{words(r, 30, 9999)} {other[k % 5 :]} {words(r, 30, 9999)}" for k in range(9)] + texts[:2] + [words(r, 70, 9999)] * 3
    found = suffixes.repeated_spans(table(spark, texts).select("doc_id", "text"), 100, group=group).collect()
    want = repeats_by_force(texts, 100)
    for row in found:
        removed = suffixes.merged(row["spans"])
        assert (sum(b - a for a, b in removed), len(removed)) == want[row["doc_id"]][1:3]


def test_suffixes_across_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    data = [t.encode() for t in variants(7)]
    whole = [suffixes.anchors(d, 100) for d in data]
    for d, (h, at, first, last) in zip(data, whole, strict=True):
        covered = [i for f, t in zip(first, last, strict=True) for i in range(f, t + 1)]
        assert covered == list(range(len(d) - 99)) or len(d) < 100
        assert all(f <= a <= f + 100 - suffixes.GRAM + (t - f) for a, f, t in zip(at, first, last, strict=True))
    monkeypatch.undo()
    for d, (h, at, *_) in zip(data, whole, strict=True):
        assert set(zip(h.tolist(), at.tolist(), strict=True)) == set(zip(*(x.tolist() for x in suffixes.anchors(d, 100)[:2]), strict=True))


def test_suffix_array():
    import numpy as np

    r = random.Random(8)
    for alphabet in ("ab", "abcdefgh", "\0a"):
        for n in (1, 2, 50, 400):
            raw = "".join(r.choice(alphabet) for _ in range(n)).encode()
            text = np.frombuffer(raw + bytes(24), np.uint8)
            starts = np.array(sorted(r.sample(range(n), max(1, n // 2))))
            sa = suffixes.suffix_array(text, starts, 16)
            keys = [bytes(text[i : i + 16]) for i in sa]
            assert keys == sorted(keys) and sorted(sa) == list(starts)
            shared = suffixes.common_prefixes(text, sa, 16)
            assert [int(x) for x in shared[1:]] == [next((k for k in range(16) if a[k] != b[k]), 16) for a, b in zip(keys, keys[1:], strict=False)]


def test_suffixes_odd_tables(spark):
    df = odd(spark)
    got = suffixes.without_repeats(df)
    assert got.columns == df.columns and got.count() == 9
    by = {r["doc_id"]: r["text"] for r in got.collect()}
    assert by[0] is None and by[1] == "" and by[3] == "one" and by[8] == "" and len(by[6]) < 300
    assert suffixes.digest_table(table(spark, [])).count() == 0 and suffixes.digest_table(table(spark, [None, "x"])).count() == 2
    assert as_rows(suffixes.digest_table(table(spark, [None, "", "é" * 150, "é" * 150]), 200)) == sorted((i, *w) for i, w in enumerate(repeats_by_force([None, "", "é" * 150, "é" * 150], 200)))


# lines ---------------------------------------------------------------------------


def test_patience():
    assert lines.patience([1, 2, 3, 4], [1, 2, 9, 3, 4]) == [(0, 0), (1, 1), (2, 3), (3, 4)]
    assert lines.patience([7, 7, 7], [7, 7]) and lines.patience([], [1]) == []
    assert [b for _, b in lines.patience([5, 1, 5, 2], [1, 2])] == [0, 1]
    r = random.Random(9)
    for _ in range(200):
        a, b = ([r.randrange(8) for _ in range(r.randrange(12))] for _ in range(2))
        got = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x < y and u < v for (x, u), (y, v) in zip(got, got[1:], strict=False))


def lines_by_force(texts, least=10):
    """Every line of a run of ``least`` words that any earlier text has too goes; by comparing all texts."""
    split = [[x.strip() for x in (t or "").split("\n") if x.strip()] for t in texts]
    out = []
    for d, (text, own) in enumerate(zip(texts, split, strict=True)):
        gone = set()
        for e in range(d):
            at = defaultdict(list)
            for i, x in enumerate(split[e]):
                at[x].append(i)
            for j, x in enumerate(own):
                for i in at[x]:
                    n = 0
                    while j + n < len(own) and i + n < len(split[e]) and own[j + n] == split[e][i + n]:
                        n += 1
                    if sum(len(y.split()) for y in own[j : j + n]) >= least:
                        gone |= set(range(j, j + n))
        out.append((text, 0) if not gone else ("\n".join(x for j, x in enumerate(own) if j not in gone), len(gone)))
    return out


def test_lines_against_force(spark):
    r = random.Random(11)
    block = "\n".join(words(r, 12, 9999) for _ in range(4))
    texts = [t.replace(" word1", "\nword1") for t in variants(10)] + [None, "", "a b\n\nc"]
    texts += [f"head {k}\n{block}\ntail {k}" for k in range(40)]
    texts += ["\n".join(f"line {r.randrange(k, k + 30)} of a common stock of them" for _ in range(3)) + f"\nown {k}" for k in range(40)]
    want = lines_by_force(texts)
    got = {r["doc_id"]: (r["text"], r["n_lines_removed"]) for r in lines.without_shared_lines(table(spark, texts).repartition(5)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(n > 0 for _, n in want) >= 60 and block in want[-80][0] and all(block not in t for t, _ in want[-79:])


def test_lines_leave_versions_whole(spark):
    """Near copies keep what they share with each other and lose what another document has of both."""
    r = random.Random(13)
    own = [words(r, 14, 9999) for _ in range(30)]
    block = [words(r, 12, 9999) for _ in range(3)]
    near = own[:7] + ["a line that was edited by somebody later on, of some words"] + own[8:]
    part = own[:6] + [words(r, 14, 9999) for _ in range(30)]
    texts = ["\n".join(x) for x in (block + ["first"], own[:10] + block + own[10:], near[:10] + block + near[10:], own[:10] + block + own[10:], part)]
    got = {x["doc_id"]: x["text"] for x in lines.without_shared_lines(table(spark, texts), versions=0.75).collect()}
    assert got == {0: texts[0], 1: "\n".join(own), 2: "\n".join(near), 3: "\n".join(own), 4: "\n".join(part[6:])}
    assert {x["doc_id"]: x["text"] for x in lines.without_shared_lines(table(spark, texts)).collect()}[2] == near[7]


@pytest.mark.parametrize("copies", [16, 17, 1000])
def test_lines_of_short_lines_in_any_number(spark, copies):
    text = "\n".join(f"short line number {k}" for k in range(6))
    texts = [text] * copies + [f"own head {k}\n{text}\nown tail {k}" for k in range(copies)]
    got = {r["doc_id"]: (r["text"], r["n_lines_removed"]) for r in lines.without_shared_lines(table(spark, texts)).collect()}
    assert got[0] == (text, 0) and all(got[k] == ("", 6) for k in range(1, copies))
    assert all(got[copies + k] == (f"own head {k}\nown tail {k}", 6) for k in range(copies))


def test_lines_whose_parts_are_older(spark):
    """Lines, and parts of a block, that earlier documents have each by themselves."""
    a, b, c = "one two three four five six", "seven eight nine ten eleven", "twelve thirteen"
    texts = [f"{a}\nonly here", f"{b}\nonly there", f"{a}\n{b}\nx", f"p\n{a}\n{b}\n{c}\nq", f"r\n{a}\n{b}\n{c}\ns"]
    texts += [f"y\n{a}\n{b}\n{c}\nz {k}" for k in range(20)]
    got = {r["doc_id"]: (r["text"], r["n_lines_removed"]) for r in lines.without_shared_lines(table(spark, texts)).collect()}
    assert [got[i] for i in range(5)] == [(texts[0], 0), (texts[1], 0), (texts[2], 0), (f"p\n{c}\nq", 2), ("r\ns", 3)]
    assert got[5] == ("y\nz 0", 3) and all(got[5 + k] == (f"z {k}", 4) for k in range(1, 20))


def test_windows_cover_every_block():
    r = random.Random(12)
    for _ in range(300):
        n = [r.randrange(1, 12) for _ in range(r.randrange(1, 9))]
        spans = lines.spans(n, 10)
        for low in range(len(n)):
            for high in range(low + 1, len(n) + 1):
                if sum(n[low:high]) >= 10:
                    assert {k for a, b in spans if low <= a and b <= high for k in range(a, b)} == set(range(low, high))


def test_lines_of_repeated_ids(spark):
    """Rows of one id with different texts lose their own lines only; repeated rows are one document."""
    shared = "\n".join(f"a shared line of some words {k}" for k in range(3))
    own = "\n".join(f"a line that nobody else has {k}" for k in range(4))
    block = "\n".join(f"a block of one id's two texts {k}" for k in range(3))
    texts = [shared, shared + "\nend", own, f"x\n{block}", f"y\n{block}", own + "\nmore", own + "\nmore"]
    rows = lines.without_shared_lines(table(spark, texts, [1, 2, 2, 3, 3, 4, 4])).collect()
    got = {i: sorted((r["text"], r["n_lines_removed"]) for r in rows if r["doc_id"] == i) for i in range(1, 5)}
    assert got[1] == [(shared, 0)] and got[2] == [(own, 0), ("end", 3)]
    assert got[3] in ([(f"x\n{block}", 0), ("y", 3)], [("x", 3), (f"y\n{block}", 0)])
    assert got[4] == [("more", 4), ("more", 4)]


def test_lines_odd_tables(spark):
    df = odd(spark)
    got = lines.without_shared_lines(df)
    assert got.columns == [*df.columns, "n_lines_removed"] and got.count() == 9
    assert lines.without_shared_lines(table(spark, [])).count() == 0
    assert lines.without("a\n\nb\nc", {0, 1}) == "c" and lines.without("a\n\nb\nc", set()) == "a\n\nb\nc" and lines.without("x\n\ny", {1}) == "x\n"


def jobs_of(spark, group, action):
    """What the action returns, and the numbers of Spark jobs and of their tasks."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = spark.sparkContext.statusTracker()
    jobs = told.getJobIdsForGroup(group)
    stages = {s for j in jobs for s in told.getJobInfo(j).stageIds}
    return out, len(jobs), sum(i.numTasks for i in map(told.getStageInfo, stages) if i)


def test_components_of_few_links_take_few_jobs(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(400)], "a bigint, b bigint")
    got, jobs, _ = jobs_of(spark, "few-links", lambda: components.connected(links, "a", "b").collect())
    assert dict(got) == dict.fromkeys(range(401), 0) and jobs <= 10


@pytest.mark.parametrize("most", [1, 40])
def test_components_of_many_links(spark, monkeypatch, most):
    """Rounds of stars find what a forest of all links has."""
    monkeypatch.setattr(components, "LINKS", most)
    r = random.Random(16)
    links = [(f"{r.randrange(150):03}".encode(), f"{r.randrange(150):03}".encode()) for _ in range(130)] + [(b"h", b"h%d" % i) for i in range(90)]
    got = dict(components.connected(spark.createDataFrame(links, "a binary, b binary"), "a", "b").collect())
    own = [(a, b) for a, b in links if a != b]
    nodes, roots = components.forest(*(pa.array(x, pa.binary()) for x in zip(*own, strict=True)))
    assert {bytes(k): bytes(v) for k, v in got.items()} == dict(zip(nodes.to_pylist(), roots.to_pylist(), strict=True))


@pytest.mark.parametrize("groups", [0, 4096])
def test_minhash_of_large_groups(spark, monkeypatch, groups):
    """Groups of many blocks, told to every task or not, take a bounded number of jobs and give what comparing all gives."""
    monkeypatch.setattr(minhash, "GROUPS", groups)
    base = [f"w{i}" for i in range(50)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(45)] + [" ".join([*base, f"y{k}"]) for k in range(20)] + variants(4)
    want = components_by_force([shingle_set(t, 4) for t in texts], list(range(len(texts))))
    got, jobs, _ = jobs_of(spark, f"large-groups-{groups}", lambda: minhash.near_duplicates(table(spark, texts), 4, 80, block=3).collect())
    assert [x for _, x in sorted((r["doc_id"], r["component_id"]) for r in got)] == want
    assert jobs <= 110


def test_links_of_workers_take_one_worker_a_task(spark, monkeypatch):
    """Links that a Python worker makes reach the forests through an exchange: two workers in one task stay for the later stages."""
    plans = []

    def settle(df, *few):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return frames.settle(df, *few)

    monkeypatch.setattr(components, "settle", settle)
    links = spark.range(60).selectExpr("id AS a", "id + 20 AS b").mapInArrow(lambda batches: batches, "a bigint, b bigint")
    got = dict(components.connected(links, "a", "b").collect())
    assert got == {i: i % 20 for i in range(80)}
    steps = [re.findall("MapInArrow|Exchange|Scan ExistingRDD", plan) for plan in plans]
    assert sum(s.count("MapInArrow") for s in steps) == 3
    assert ("MapInArrow", "MapInArrow") not in {two for s in steps for two in zip(s, s[1:], strict=False)}
