"""Passages of questions in blocks, against plain loops."""

import time

from plumbline.operators import joins, scale


def tables(spark):
    questions = [(i,) for i in [*range(40), 3, None]]
    ranked = [(i, r, (i * 7 + r) % 13 if r < 5 else None) for i in range(36) for r in range(1, 6)] + [(None, 1, 2), (5, 1, 99)]
    corpus = [(d, f"Title {d}\ntext {d}" * (d + 1) if d != 4 else None) for d in range(13)] + [(None, "Title\nnothing")]
    return (
        spark.createDataFrame(questions, "question_id BIGINT"),
        spark.createDataFrame(ranked, "question_id BIGINT, rank INT, doc_id BIGINT"),
        spark.createDataFrame(corpus, "doc_id BIGINT, contents STRING"),
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {blocks.apply(i).name() for i in range(blocks.size()) if blocks.apply(i).name().startswith("shuffle")}


def test_contexts_in_blocks(spark):
    questions, ranked, corpus = tables(spark)
    answer = lambda q, r: joins.attach_context(q, r, corpus, 3)
    named = answer(questions, ranked)
    before = shuffle_files(spark)
    parts = joins.by_blocks(questions.where("question_id is not null"), ranked, 5, answer, "contexts")
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(scale.DROP_SHUFFLES) == "false"
    assert rows(parts) == rows(named.where("question_id is not null")) and parts.count() == 41
    context = {r.question_id: r.context for r in parts.collect()}
    assert context[0] == "".join(f"Doc {r}(Title: Title {r}) text {r}" + (f"Title {r}\ntext {r}" * r) + "\n" for r in (1, 2, 3))
    assert context[38] == ""


def test_passages_in_blocks(spark):
    questions, ranked, corpus = tables(spark)
    answer = lambda q, r: joins.format_passages(q, scale.lookup(r, corpus, ["doc_id"]).where("contents is not null"))
    parts = joins.by_blocks(questions.where("question_id is not null"), ranked, 3, answer, "passages")
    assert rows(parts) == rows(answer(questions, ranked).where("question_id is not null"))
    assert {r.text for r in parts.where("question_id >= 36").collect()} == {joins.NO_RESULTS}


def test_blocks_follow_the_text_that_meets(spark):
    _, ranked, corpus = tables(spark)
    length = {r.doc_id: len(r.contents or "") for r in corpus.collect()}
    met = sum(length.get(r.doc_id, 0) for r in ranked.collect() if r["rank"] <= 3 and r.doc_id is not None)
    assert joins.passage_blocks(ranked, corpus, 3) == 1
    assert joins.passage_blocks(ranked, corpus, 3, share=0.5, floor=1) == -(-met // (0.5 * sum(length.values())))
    assert joins.passage_blocks(ranked.limit(0), corpus.limit(0), 3, floor=1) == 1


def test_lookup_keeps_rows_of_null_and_hot_keys(spark):
    rows_ = spark.sql("select id as i, case when id % 3 = 0 then null when id % 3 = 1 then 7L else id end as k from range(300)")
    table = spark.createDataFrame([(7, "x"), (None, "y"), (8, "z"), (8, "zz")], "k BIGINT, v STRING")
    for floor in (5, 1_000_000):
        out = scale.lookup(rows_, table, ["k"], hot_floor=floor)
        assert out.columns == ["i", "k", "v"] and out.count() == 301
        assert out.where("v = 'x'").count() == 100 and out.where("k is null and v is null").count() == 100
