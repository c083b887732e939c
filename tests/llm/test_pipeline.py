import random

import __spark_entry__
import corpus_pipeline
from codelake.llm import toxicity

from .test_topk_classifiers import INSULTS, word


def write(spark, root, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def corpus(seed=6):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(300):
        w = [word(rng) + str(rng.randrange(30)) for _ in range(120)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        text = "\n".join(" ".join(w[a : a + 20]) for a in range(0, len(w), 20))
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 5}", len(text)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    for n, i in enumerate(range(1, 60, 6)):  # copies with a few words changed all over
        w = rows[i][1].split(" ")
        w[5] = w[60] = "changed"
        text = " ".join(x if k % 2 else x.replace("\n", " \n") for k, x in enumerate(w))
        rows.append((1000 + n, text, "en", "s1", len(text)))
    return rows, labels


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    root = write(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{root}/labels.parquet"))
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, root).write.parquet(f"{root}/stage{n}")
        docs = spark.read.parquet(f"{root}/stage{n}")
        kept.append(docs)
        if n < 4:
            assert docs.columns == before.columns
    texts = {r[0]: r[1] for r in rows}
    bad = {i for i, t in texts.items() if model.score(max(model.margins(toxicity.words_of(t)))) >= 0.5}
    assert bad == {i for i in range(300) if i % 6 == 0}
    assert {r["doc_id"] for r in kept[0].collect()} == texts.keys() - bad
    lines = [x for r in kept[1].collect() for x in r["text"].split("\n") if len(x) >= 16]
    assert len(lines) == len(set(lines)) and kept[1].count() == kept[0].count()
    assert all(r["n_chars"] == len(r["text"]) for r in kept[1].collect())
    third = {r["doc_id"] for r in kept[2].collect()}
    assert {i for i in range(300) if i % 6} <= third
    copies = {r["doc_id"]: r["count"] for r in kept[3].groupBy("doc_id").count().collect()}
    assert copies.keys() <= third and max(copies.values()) <= 3
    packed = kept[4].groupBy("doc_id").sum("n_words").collect()
    words = {r["doc_id"]: len(r["text"].split()) for r in kept[3].collect()}
    assert {r[0]: r[1] for r in packed} == {i: words[i] * c for i, c in copies.items() if words[i]}


def test_near_copies_leave_one(spark, docs_of):
    rng = random.Random(1)
    rows = []
    for i in range(20):
        w = [f"x{rng.randrange(2000)}" for _ in range(200)]
        rows += [(i, " ".join(w), "s"), (500 + i, " ".join(w), "s"), (100 + i, " ".join([*w[:50], "new", *w[50:]]), "s")]
    rows += [(7, rows[21][1], "s"), (None, "no id", "s"), (None, "no id", "s"), (5, "another text with id five", "s")]
    docs = docs_of(rows)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.where("doc_id is not null").collect()) == sorted([*range(20), 5])
    assert out.where("doc_id is null").count() == 1


def test_registered(spark, tmp_path):
    names = __spark_entry__.queries()
    assert names["pipeline"].__wrapped__ is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    rows, labels = corpus()
    root = write(spark, tmp_path, rows, labels)
    assert corpus_pipeline.run(spark, root).count() > 0


def test_empty_tables(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    assert corpus_pipeline.run(spark, root).count() == 0


def test_odd_rows_pass_all_stages(spark, odd, tmp_path):
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/odd{n}")
        docs = spark.read.parquet(f"{tmp_path}/odd{n}")
    assert docs.count() > 0


def test_columns_named_as_the_stages_name_theirs(spark, docs_of, tmp_path):
    labels = [(i, 1, 0) for i in range(5)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs_of([(i, f"text number {i} of a few", "s") for i in range(5)]).withColumnsRenamed({"score": "toxicity_score", "h": "kept", "fp": "gone", "first": "row", "role": "leader"})
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert all(r["toxicity_score"] == 0.5 and r["kept"] == 1 and r["row"] == "y" for r in out.collect()), name


def test_conflicting_labels_are_left_out(spark):
    from codelake.llm.common import agreed_labels

    rows = [(1, 1), (1, 1), (2, 0), (2, 1), (3, None), (None, 1), (4, 0), (5, 7)]
    assert {(r["doc_id"], r["y"]) for r in agreed_labels(spark.createDataFrame(rows, "doc_id long, toxic int"), "toxic").collect()} == {(1, 1), (4, 0)}
