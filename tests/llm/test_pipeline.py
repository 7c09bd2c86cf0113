"""The pipeline's stages on planted cases, and the registered queries."""

import oracle
import pytest

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    names = set(__spark_entry__.queries())
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op2_suffixes", "op3_pages", "op5_minhash", "op7_maxscore", "op10_embeddings"])
def test_sql(spark, name):
    assert oracle.differences(__spark_entry__.queries()[name](spark, SF), __spark_entry__.oracle_sql()[name], oracle.connect(SF)) == []


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == COLUMNS
        rows = out.collect()
        ids = {r["doc_id"] for r in rows}
        assert ids <= set(before)
        if name == "language":
            assert len(ids) >= 0.98 * len(before)
        if name == "minhash":
            assert all(r["text"] == before[r["doc_id"]] for r in rows) and len(ids) < len(before)
        if name == "packing":
            assert ids == set(before)
        docs = out if name == "packing" else spark.createDataFrame(rows, docs.schema)
    assert len(ids) < len(texts)


def test_rows_without_an_id_and_repeated_rows(spark):
    """Each text stays once in minhash and is whole after suffixes, whatever its rows' ids are."""
    texts = [" ".join(f"w{k}x{j}" for j in range(80)) for k in range(7)]
    near = texts[1].replace("w1x40 ", "")
    rows = [(None, texts[0]), (1, texts[1]), (None, near), (2, texts[2]), (2, texts[2]), (3, texts[3]), (3, near), (None, texts[4]), (None, texts[4]), (5, texts[5]), (6, texts[5]), (7, texts[6]), (None, ""), (None, ""), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS).schema)
    stages = dict(corpus_pipeline.STAGES)
    got = stages["minhash"](spark, docs, SF)
    assert got.columns == COLUMNS
    want = [(None, ""), (None, ""), (None, texts[0]), (None, texts[4]), (1, texts[1]), (2, texts[2]), (3, texts[3]), (5, texts[5]), (7, texts[6]), (8, None)]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=order) == sorted(want, key=order)
    own = stages["suffixes"](spark, spark.createDataFrame(got.collect(), docs.schema), SF)
    assert sorted(((r["doc_id"], r["text"]) for r in own.collect()), key=order) == sorted(want, key=order)


STEMS = {"aa": "abcdeg", "bb": "fhijkl", "cc": "mnopqr"}


def planted(r):
    """``(id, text)`` of clean texts, near and exact copies, shared blocks and passages, junk, empty and missing ones."""

    def line(lang, n):
        return " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randrange(3, 9))) for _ in range(n))

    def text(lang, n):
        return [line(lang, r.randrange(10, 16)) for _ in range(n)]

    out = []
    block = text("aa", 2)
    passage = line("bb", 60)
    for k in range(40):
        lang = "aa bb cc".split()[k % 3]
        own = text(lang, r.randrange(6, 12))
        if k % 5 == 1:
            own[2:2] = block
        if k % 7 == 2:
            own[1] = f"{line(lang, 8)} {passage} {line(lang, 8)}"
        out.append("\n".join(own))
        if k % 4 == 0:
            near = list(own)
            near[-1] = line(lang, 3) + " " + near[-1].split(" ", 3)[-1]
            out += ["\n".join(near), "\n".join(own)]
    out += ["123 456 !!", "", None, "-- 7 --"]
    return list(enumerate(out))


def test_every_stage_against_force(spark, tmp_path):
    """The whole pipeline on planted cases, each stage by its rule over all documents."""
    import random
    import re

    from tokenizers import Tokenizer

    from public_tokenizers import path
    from test_texts import components_by_force, shingle_set

    cases = planted(random.Random(21))
    kind = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS).schema
    rows = [(i, t, None if t is None else next((g for g, s in STEMS.items() if re.search(f"[{s}]", t)), "aa"), "s", None if t is None else len(t)) for i, t in cases]
    # each language often enough to be learned
    extra = [(1000 + k, " ".join("".join(random.Random(k * 50 + j).choice(STEMS[g]) for _ in range(6)) for j in range(30)), g, "s", 209) for k, g in enumerate(["aa", "bb", "cc"] * 60)]
    spark.createDataFrame([*rows, *extra], kind).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    texts = [(i, t) for i, t, *_ in [*rows, *extra]]
    # language
    texts = [(i, t) for i, t in texts if t and re.search("[a-z]", t)]
    # lines: a run of ten words that an earlier text has goes, unless both texts are near copies
    sets = {i: shingle_set(t, 5) for i, t in texts}
    split = {i: t.split("\n") for i, t in texts}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    cut = []
    for n, (i, t) in enumerate(texts):
        seen = {x for j, _ in texts[:n] if not near(i, j) for x in split[j] if len(x.split()) >= 10}
        left = "\n".join(x for x in split[i] if x not in seen)
        if left:
            cut.append((i, left))
    # near duplicates: the first of each component
    root = components_by_force([shingle_set(t, 5) for _, t in cut], [i for i, _ in cut])
    kept = [(i, t) for (i, t), c in zip(cut, root, strict=True) if i == c]
    assert len(texts) > len(kept) >= 30
    # repeated strings of 200 bytes
    windows = {}
    for i, t in kept:
        for a in range(len(t.encode()) - 199):
            windows.setdefault(t.encode()[a : a + 200], []).append((i, a))
    gone = {i: bytearray(len(t.encode())) for i, t in kept}
    for w in windows.values():
        if len(w) > 1:
            for i, a in w:
                gone[i][a : a + 200] = b"\1" * 200
    final = {i: bytes(b for b, g in zip(t.encode(), gone[i], strict=True) if not g).decode() for i, t in kept}
    assert any(final[i] != t for i, t in kept)
    final = {i: t for i, t in final.items() if t}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    sizes = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in final.items()}
    assert {r["doc_id"]: sum(x["length"] for x in got if x["doc_id"] == r["doc_id"]) for r in got} == sizes
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(sizes.values()) // 2048) + 1


def test_what_a_stage_leaves(spark, tmp_path):
    """After a run the shared folder has its result and nothing else of it."""
    from tilecask.sources.scratch import folders, shared_dir

    where = shared_dir(spark)
    before = {*folders(spark, where), *folders(spark, spark.sparkContext.getCheckpointDir())}
    got = corpus_pipeline.run(spark, SF)
    after = {*folders(spark, where), *folders(spark, spark.sparkContext.getCheckpointDir())}
    assert got.count() > 0 and [p for p in after - before if "corpus-packing" not in p] == []


def test_whole_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    per = got.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0]
    assert per <= 2048 and got.count() > 100


def test_texts_are_dealt_out_once_for_the_kept_rows(spark):
    """Repeated rows are grouped where the join has brought them, without another exchange of their texts."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "g"), (None, "h i")], "doc_id bigint, text string")
        out = corpus_pipeline.one_of_each(spark, docs, "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(out.collect(), key=str) == sorted([(1, "a b c d e f"), (3, "g"), (None, "h i")], key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    above = plan[: plan.index("SortMergeJoin")]
    assert "SortAggregate" in above and "Exchange" not in above
