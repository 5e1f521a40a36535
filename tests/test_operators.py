import pytest
from pyspark.sql import functions as F

from pairsmith.operators import judging, lists, records, stats


def items(spark, values):
    return spark.createDataFrame([(v, k) for k, v in enumerate(values)], "item string, pos int")


@pytest.mark.parametrize(("values", "want"), [(["Apple", "banana", "APPLE", "Banana"], ["Apple", "banana"]), ([" a ", "b", "a", " b "], ["a", "b"]), (["a", "", "b", "  ", "c"], ["a", "b", "c"]), ([""], []), ([], []), (["same"] * 3, ["same"])])
def test_dedup(spark, values, want):
    assert [r.item for r in lists.dedup_ordered(items(spark, values)).orderBy("pos").collect()] == want


def test_last_n(spark):
    for size, n, want, cut in ((5, 3, [3, 4, 5], True), (3, 3, [1, 2, 3], False), (2, 1, [2], True), (300, 50, list(range(251, 301)), True)):
        r = spark.range(1).select(lists.last_n(F.sequence(F.lit(1), F.lit(size)), n).alias("x")).first().x
        assert (list(r["items"]), r.truncated) == (want, cut)


def test_dense_ids_over_many_partitions(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("a"), F.lit("x").alias("b")).repartition(7)
    got = sorted((r.a, r.job_id) for r in lists.dense_ids(rows, ["a"]).collect())
    assert [j for _, j in got] == list(range(5000))
    assert lists.dense_ids(rows.limit(0), ["a"]).count() == 0


def test_pending_and_progress(spark):
    jobs, done = spark.createDataFrame([(k, "p") for k in range(1, 5)], "job_id long, prompt string"), spark.createDataFrame([(1,), (3,), (3,)], "job_id long")
    assert sorted(r.job_id for r in lists.pending(jobs, done).collect()) == [2, 4]
    assert stats.progress(jobs, done).first().percent == 50 and stats.progress(jobs.limit(0), done).first().percent == 0


def test_scores(spark):
    rows = spark.createDataFrame([({},), ({"a": (8, "")},), ({"a": (8, ""), "b": (6, ""), "c": (10, "")},), ({"a": (0, ""), "b": (0, "")},), (None,)], f"s {records.SCORES}")
    assert [r.m for r in rows.select(judging.mean_score(F.col("s")).alias("m")).collect()] == [0.0, 8.0, 8.0, 0.0, None]


@pytest.mark.parametrize(("chosen", "rejected", "keep"), [(4.0, 3.0, True), (3.9, None, False), (4.0, 3.1, False), (None, None, True), (5.0, None, True)])
def test_filter(spark, chosen, rejected, keep):
    assert spark.range(1).select(judging.passes(F.lit(chosen).cast("double"), F.lit(rejected).cast("double"), 4, 3).alias("x")).first().x is keep


def test_judged(spark):
    replies = spark.createDataFrame([(1, "chosen", '{"accuracy": {"score": 5}, "clarity": {"score": 4}}'), (1, "rejected", '{"accuracy": {"score": 2}, "clarity": {"score": 2}}'), (2, "chosen", "no"), (3, "rejected", "{}")], "job_id long, side string, response string")
    got = {r.job_id: (r.chosen_score_total, r.rejected_score_total, r.preference_margin) for r in judging.judged(replies).collect()}
    assert got == {1: (4.5, 2.0, 2.5), 2: (None, None, None), 3: (None, 0.0, None)}


def test_record_shapes(spark):
    pairs = spark.createDataFrame([("main", "sub", "say hi", "hello", "bye", "why", None)], "main_topic string, sub_topic string, prompt string, chosen string, rejected string, chosen_reasoning string, rejected_reasoning string")
    a = records.sft(pairs, "alpaca", topics=True).first()
    assert (a.instruction, a.output, a.main_topic, a.conversations) == ("say hi", "hello", "main", None)
    s = records.sft(pairs).first()
    assert ([tuple(t) for t in s.conversations], s.instruction, s.main_topic) == ([("human", "say hi"), ("gpt", "hello")], None, None)
    assert [tuple(r) for r in records.kto(pairs).collect()] == [("say hi", "hello", True), ("say hi", "bye", False)]
    assert records.dpo_with_reasoning(pairs).first() == ("say hi", "<think>\nwhy\n</think>\n\nhello", "bye")


def test_reasoning_into_records(spark):
    def merged(turns, reasoning):
        rows = spark.createDataFrame([(turns, None, reasoning)], f"conversations array<{records.TURN}>, output string, reasoning string")
        return [tuple(t) for t in records.sft_with_reasoning(rows).first().conversations]

    assert merged([("human", "q"), ("gpt", "a"), ("human", "r"), ("gpt", "b")], "w")[3] == ("gpt", "<think>\nw\n</think>\n\nb")
    assert merged([("human", "q")], "w") == [("human", "q"), ("gpt", "<think>\nw\n</think>\n\n")] and merged([("human", "q"), ("gpt", "a")], "") == [("human", "q"), ("gpt", "a")]


def test_prompt_and_chosen(spark):
    def talk(*turns):
        r = records.prompt_and_chosen(spark.createDataFrame([(list(turns),)], f"conversations array<{records.TURN}>"), "sharegpt").first()
        return r.prompt, r.chosen

    assert talk(("system", "s"), ("human", "  "), ("User ", " q "), ("gpt", "x"), ("assistant", " y")) == ("q", " y")
    assert talk(("human", "q"), ("gpt", "x"), ("gpt", " ")) == ("q", None) and talk(("gpt", "x")) == (None, "x")
    rows = spark.createDataFrame([(" A ", " B ", "o"), (" A ", "", " o "), (" ", "B ", "o"), ("", "", " ")], "instruction string, input string, output string")
    assert [(r.prompt, r.chosen) for r in records.prompt_and_chosen(rows, "alpaca").collect()] == [("A\n\nB", "o"), ("A", " o "), ("B", "o"), (None, None)]


def test_best_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([(16, 5.0), (8, 5.0), (24, 4.0)], "workers int, throughput double")
    assert stats.best(rows).first().workers == 8
