import random
import zlib

from postloom.llm.toxicity import reject_toxic, score, train


def corpus(n=900):
    rnd = random.Random(6)
    syllables = ["ba", "do", "ki", "lu", "me", "no", "ra", "su", "ti", "ve"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        w = [word() for _ in range(rnd.randrange(5, 300))]
        for _ in range(rnd.randrange(1, 4) if toxic else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(["Grumpf", "zorgling", "quaxer"]) + rnd.choice(["", "s", "ly"]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_learns_and_keeps_the_held_out_part_out(spark):
    docs, labels = corpus()
    # Labels of the held-out part say the opposite and must not matter.
    wrong = [(i, q, t if zlib.crc32(str(i).encode()) % 5 else 1 - t) for i, q, t in labels]
    odd = [(None, 1, 1), (5, 1, None), (10**9, 1, 1), (3, 1, 7)]
    extra = [(None, "Grumpf quaxers"), (5000, None), (5001, ""), (5002, " \n"), (5003, "zorglingly " * 20_000), (5004, "ki " * 50_000), (7, docs[7][1])]
    df = spark.createDataFrame([(*d, "x", 1, 0.5) for d in docs + extra], "doc_id bigint, text string, y string, slot int, score double")
    model = train(df, spark.createDataFrame(wrong + odd, "doc_id bigint, quality int, toxic int"))
    got = score(df, model).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(held) > 100 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[None].held_out is False and by[None].predicted == 1 and by[5003].predicted == 1
    assert [by[i].predicted for i in (5000, 5001, 5002, 5004)] == [0] * 4 and by[5000].score == by[5001].score == by[5002].score
    kept = reject_toxic(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {5000, 5001, 5004} <= set(ids) and sum(truth.get(i, 0) for i in ids) <= 3 and ids.count(7) == 2 and len(ids) > 700


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    schema = "doc_id bigint, quality int, toxic int"
    assert [r.score for r in score(df, train(df, spark.createDataFrame([], schema))).collect()] == [0.0, 0.0]
    assert [r.score for r in score(df, train(df, spark.createDataFrame([(1, 1, 0), (2, 1, 0)], schema))).collect()] == [0.0, 0.0]
    only = spark.createDataFrame([(1, 1, 1)], schema)
    assert {r.predicted for r in score(df, train(df, only)).collect()} == {1}
    assert score(df.limit(0), train(df, only)).count() == 0
