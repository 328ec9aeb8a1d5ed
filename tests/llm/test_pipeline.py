"""The pipeline stage by stage against plain versions of what each has to do."""

import random

import pytest

from tests.llm.test_jaccard import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def folder(spark, tmp_path):
    r = random.Random(3)
    words = [a + b + c for a in ("ba", "do", "ki", "lum", "re") for b in ("na", "ler", "mi", "sto") for c in ("sa", "n", "to", "li", "")]
    item = " ".join(r.choices(words, k=30))
    docs, kind = [], {}
    for i in range(160):
        text, kind[i] = " ".join(r.choices(words, k=r.randint(30, 90))).capitalize() + ".", "good"
        if i % 8 == 1:
            text, kind[i] = " ".join(w.upper() + "!!" for w in text.split()), "bad"
        if i % 8 == 2:
            text, kind[i] = f"{text} {item} {text[::-1]}", "leak"
        if i % 8 == 3:
            text, kind[i] = docs[-3][1] + " more", "copy"
        docs.append((i, text, "en", "s", len(text)))
    docs += [(None, "no id at all", "en", "s", 1), (500, None, None, None, None), (501, "", "en", "s", 0), (0, docs[0][1], "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs, kind


def test_stages(spark, folder):
    path, docs, kind = folder
    texts = {i: t for i, t, *_ in docs if i is not None}
    now, columns = spark.read.parquet(f"{path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    left = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, path).write.parquet(f"{path}/{number}")
        now = spark.read.parquet(f"{path}/{number}")
        assert now.columns == columns
        left.append([r["doc_id"] for r in now.collect()])
    # The row without an id has a text of its own, which stays to the end.
    assert all(ids.count(None) == 1 for ids in left)
    left = [[i for i in ids if i is not None] for ids in left]
    assert sorted(left[0]) == sorted([i for i in kind if kind[i] != "bad"] + [0])
    groups = brute([(i, texts[i]) for i in sorted(set(left[0]))])
    assert sorted(left[1]) == sorted({low for _, _, low in groups}) and len(left[1]) < len(set(left[0]))
    assert sorted(left[2]) == [i for i in sorted(left[1]) if kind[i] != "leak"] and len(left[2]) < len(left[1])
    packed = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in packed} == {None, *left[2]}


def test_clashing_names(spark, folder):
    """Columns named as the stages name theirs stay as they are."""
    path, docs, _ = folder
    extra = ["row_key", "gone", "key", "row", "component_id", "text_", "n"]
    table = spark.createDataFrame([(i, t, *[f"{c}-{i}" for c in extra]) for i, t, *_ in docs], f"doc_id long, text string, {', '.join(f'{c} string' for c in extra)}")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, table, path)
        assert got.columns == table.columns
        assert all(r[c] == f"{c}-{r['doc_id']}" for r in got.collect() for c in extra)


def test_empty(spark, folder, tmp_path):
    path, *_ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_rows_without_own_ids(spark, folder):
    """Null ids and one id for several texts: only the rows decided on go."""
    path, docs, kind = folder
    by_id = {i: t for i, t, *_ in docs if i is not None and i < 160}
    good, leak = [by_id[i] for i in kind if kind[i] == "good"], next(by_id[i] for i in kind if kind[i] == "leak")
    rows = [(None, good[0]), (None, good[1]), (7, good[2]), (7, good[3]), (7, good[3] + " more"), (7, good[3]), (8, good[4]), (3, good[4]), (3, good[5]), (None, good[5])]
    rows += [(9, leak), (9, good[6]), (None, leak)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    once = [(r["doc_id"], r["text"]) for r in corpus_pipeline.deduplicate(spark, table, path).collect()]
    sevens = [x for x in once if x[0] == 7]
    assert len(sevens) == 2 and (7, good[2]) in sevens
    rest = sorted((x for x in once if x[0] != 7), key=str)
    assert rest == sorted([(None, good[0]), (None, good[1]), (3, good[4]), (3, good[5]), (9, good[6]), (9, leak)], key=str)
    clean = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminate(spark, table, path).collect()]
    assert sorted(clean, key=str) == sorted((x for x in rows if x[1] != leak), key=str)
