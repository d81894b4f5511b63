"""The pipeline's stages, each on its own input, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vaultsieve.llm import mixing, queries

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, docs, labels = prose(60), [], []
    for i in range(240):
        text = prose(r.randint(20, 90))
        if i % 8 == 0:
            text += f" zkorx {prose(3)} wubbel zkorx"
        if i % 11 == 0:
            text = f"{text} {passage} {prose(5)}"
        docs.append((i, text, "en", f"s{i % 3}" if i % 5 else "hot", len(text)))
        labels.append((i, int(i % 8 == 0), 1))
    docs += [(300 + i, docs[i][1], "en", "hot", docs[i][4]) for i in range(5)] + [(400, None, None, None, None), (401, "", "en", "s1", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_in_their_order_keep_the_columns(spark, folder):
    assert list(STAGES) == ["toxicity", "minhash_near_dedup", "substring_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name


def test_toxic_documents_go_and_others_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {r.doc_id for r in STAGES["toxicity"](spark, docs, folder).collect()}
    toxic = {i for i in range(240) if i % 8 == 0} | {300}
    assert len(left & toxic) <= 2 and len({r.doc_id for r in docs.collect()} - toxic - left) <= 2


def test_one_of_each_group_stays(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {r.doc_id for r in STAGES["minhash_near_dedup"](spark, docs, folder).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {300 + i for i in range(5)}


def test_one_row_of_repeated_and_nameless_rows_stays(spark, folder):
    r = random.Random(22)
    text = lambda: " ".join("".join(r.choice("aeioulnrst") for _ in range(6)) for _ in range(80))
    a, b, c, d = text(), text(), text(), text()
    near = f"{b} more"
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, a, "en", "t", 1), (2, b, "en", "s", 1), (2, near, "en", "s", 1), (3, b, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1), (None, d, "en", "s", 1), (9, d, "en", "s", 1), (None, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = [tuple(x) for x in STAGES["minhash_near_dedup"](spark, docs, folder).collect()]
    assert len(left) == 5
    assert (1, a, "en", "s", 1) in left and (None, c, "en", "s", 1) in left and (9, d, "en", "s", 1) in left and (None, None, "en", "s", 1) in left
    assert sum(x[0] == 2 and x[1] in (b, near) for x in left) == 1


def test_passages_stay_in_the_smallest_document(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 300")
    texts = {r.doc_id: r.text.split() for r in docs.collect()}
    first: dict[tuple, int] = {}
    for i in sorted(texts):
        for p in range(len(texts[i]) - 49):
            first.setdefault(tuple(texts[i][p : p + 50]), i)
    changed = 0
    for r in STAGES["substring_dedup"](spark, docs, folder).collect():
        w, gone = texts[r.doc_id], set()
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < r.doc_id:
                gone |= set(range(p, p + 50))
        changed += bool(gone)
        assert r.text.split() == [x for j, x in enumerate(w) if j not in gone] and r.n_chars == len(r.text)
    assert changed > 15


def test_mixing_repeats_documents_as_counted(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGES["mixing"](spark, docs, folder)
    assert out.count() == mixing.mix_sources(docs).agg(F.sum("copies")).first()[0]
    assert out.distinct().exceptAll(docs).count() == 0


def test_run_packs_what_the_stages_leave(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    one = found.groupBy("doc_id", "sequence_id", "offset").count()
    assert one.where("count > 1").count() == 0 and found.count() > 100
    assert queries.queries()["pipeline"]


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
