"""The corpus pipeline on a small table, against plain versions of its filtering stages."""

import random

import corpus_pipeline
from footfall.llm import stages, toxicity
from footfall.llm.common import CLEANUP, stored


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    plain = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        rows.append((i, " ".join(rng.choices(plain, k=25)) + (" you idiot scum" if toxic else " a fine day"), int(toxic)))
    clean = [r for r in rows if not r[2]]
    rows += [(600 + k, clean[k][1], 0) for k in range(10)]  # exact copies
    rows += [(610 + k, clean[20 + k][1] + " tail", 0) for k in range(10)]  # near copies
    rows += [(620, "password = 'hunter2hunter2' among " + " ".join(rng.choices(plain, k=20)), 0), (621, None, 0), (622, "", 0)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t, _ in rows],
                                 "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id BIGINT, quality INT, toxic INT")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    predicted = {r.doc_id: r.predicted for r in toxicity.score(docs, labels).collect()}
    left = [(i, t) for i, t, _ in rows if not predicted[i]]
    assert {i for i, _ in left} == {i for i, _, y in rows if not y}
    last = {}
    for i, t in left:
        last[t or ""] = max(i, last.get(t or "", i))
    left = sorted((i, t) for i, t in left if last[t or ""] == i)
    sets = {i: _shingles(t) for i, t in left}
    root = {i: i for i, _ in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, _ in left:
        for j, _ in left:
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in left if find(i) == i]
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 4096
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity"


def test_stages_keep_the_columns_and_take_an_empty_table(spark, tmp_path):
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    docs = spark.createDataFrame([], schema)
    spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")] and docs.count() == 0, name


def test_near_copies_by_id_and_text(spark, tmp_path):
    """An id with two texts, null ids, near copies of the same id."""
    rng = random.Random(3)
    a, b, c, d = (" ".join(f"{x}{rng.randrange(10 ** 6)}" for _ in range(60)) for x in "abcd")
    rows = [(1, a), (2, a + " tail"), (2, b), (3, c), (3, c + " tail"), (None, d), (None, d + " tail"), (None, b + " tail"),
            (4, None), (5, ""), (None, "  "), (6, d[::-1])]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = [(r.doc_id, r.text) for r in stages.no_near_copies(spark, docs, str(tmp_path)).collect()]
    assert len(got) == 8
    assert {(1, a), (2, b), (4, None), (5, ""), (None, "  "), (6, d[::-1])} <= set(got)
    assert sum(i == 3 for i, _ in got) == 1 and sum(t is not None and t.startswith(d) for _, t in got) == 1


def test_stages_keep_columns_named_like_helpers(spark, tmp_path):
    """Further columns keep their names and values, also those that a stage would take for itself."""
    extra = ["blob", "cuts", "_blob", "_one", "one", "_key", "row", "start", "Found", "component_id", "sha", "x.y"]
    rows = [(1, "password = 'hunter2hunter2' among words", 40), (2, "a fine day for all of us here", 29), (2, "a fine day for all of us here", 29),
            (3, "a fine day for all of us here", 29), (4, None, 0), (None, "", 0)]
    docs = spark.createDataFrame([(i, t, n, *[f"{c}{k}" for c in extra]) for k, (i, t, n) in enumerate(rows)],
                                 ["doc_id", "text", "n_chars", *extra])
    spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        for r in got.collect():
            k = int(r["blob"][4:])
            assert [r[c] for c in extra] == [f"{c}{k}" for c in extra], name
            assert r["text"] == ("[secret]' among words" if name == "secret scans" and k == 0 else rows[k][1])


def _shuffled(spark):
    """Bytes of the shuffle files there are."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(found) if f.getName().startswith("shuffle_"))


def test_secret_scans_shuffle_only_texts_that_may_have_one(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.getrandbits(64):x}z" for _ in range(300)), "keep", 0) for i in range(400)]
    rows += [(400, "a token = abcdef123 b AKIA" + "Q" * 20, "x", 0), (401, None, "x", 7), (402, "token: x", "x", 8), (402, "0123456789abcdef" * 2, "y", 0),
             (403, "a token = abcdef123 b AKIA" + "Q" * 20, "x", 0)]
    path = f"{tmp_path}/docs"
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING, n_chars BIGINT").write.parquet(path)
    before, threshold = _shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stages.no_secrets(spark, spark.read.parquet(path), "").write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert _shuffled(spark) - before < 100_000 < sum(len(t or "") for _, t, _, _ in rows) / 10
    got = sorted((r.doc_id, r.text or "", r.source, r.n_chars) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = [r for r in rows if r[0] < 400] + [(400, "a [secret] b [secret]", "x", 21), (401, "", "x", 7), (402, "[secret]", "y", 8),
                                             (402, "token: x", "x", 8), (403, "a [secret] b [secret]", "x", 21)]
    assert got == sorted(want)


def test_a_stored_step_leaves_no_shuffle_files(spark):
    before = _shuffled(spark)
    docs = stored(spark.range(20_000).selectExpr("id", "uuid() AS text").repartition(5, "id"), "step")
    assert _shuffled(spark) - before < 100_000 and docs.count() == 20_000
    assert spark.conf.get(CLEANUP) == "false"
