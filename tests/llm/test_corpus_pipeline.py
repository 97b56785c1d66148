"""The corpus pipeline against what each stage must do to a small corpus."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdlucmfw", k=rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    docs, want = {}, {}
    for i in range(30):  # clean
        docs[i] = prose(rng, rng.randint(60, 300))
        want[i] = len(docs[i].split())
    docs[100], docs[101], docs[102], docs[103] = None, "", "too short", "spam eggs " * 200  # rejected by the rules
    for i in range(110, 120):  # a footer that ten documents share: the first keeps it
        body = prose(rng, 80)
        docs[i] = f"{body}\nSee all of our other pages about this subject"
        want[i] = 80 + (9 if i == 110 else 0)
    base = prose(rng, 200)
    for i in range(130, 134):  # near copies: the first stays
        words = base.split()
        words[100] = f"changed{i}"
        docs[i] = " ".join(words)
    want[130] = 200
    passage = prose(rng, 60)
    for i in range(140, 145):  # a passage inside of lines: only its first document keeps it whole
        docs[i] = f"{prose(rng, 100)} {passage} {prose(rng, 100)}"
        want[i] = 260 if i == 140 else (200, 232)
    return docs, want


def stages(spark, tmp_path, docs):
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], SCHEMA)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_run(spark, tmp_path, corpus):
    docs, want = corpus
    rows = corpus_pipeline.run(spark, stages(spark, tmp_path, docs)).collect()
    got = {r.doc_id: r.n_tokens for r in rows}
    assert len(got) == len(rows) and set(got) == set(want)
    for i, n in want.items():
        low, high = n if isinstance(n, tuple) else (n, n)
        assert low <= got[i] <= high, i
    assert all(r.n_tokens <= r.bucket_tokens for r in rows)


def test_stages_keep_the_columns(spark, tmp_path, corpus):
    folder = stages(spark, tmp_path, corpus[0])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, n = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "substring dedup", "packing"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        assert docs.count() <= n
        n = docs.count()
        if i < 4:
            assert docs.columns == names


def test_no_documents(spark, tmp_path):
    folder = stages(spark, tmp_path, {1: "x"})
    assert corpus_pipeline.run(spark, folder).count() == 0
