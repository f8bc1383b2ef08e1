import json

from kindred.streaming import feedback
from pyspark.sql import functions as F


def test_stream_matches_batch_on_closed_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"pseudonymous_user_id": f"u{i % 3}", "artist_id": "a", "action": ("interested", "known", "not_for_me")[i % 3], "created_at": f"2024-01-{1 + i // 5:02d}T0{i % 5}:00:00Z", "model_version": "v"} for i in range(40)]
    (tmp_path / "in/f.json").write_text("".join(json.dumps(r) + "\n" for r in rows + rows[:5]))
    stream = feedback.read_feedback(spark, str(tmp_path / "in"))
    once = feedback.once(stream, ["pseudonymous_user_id", "artist_id", "created_at"])
    feedback.write(feedback.feedback_windows(once, late=None), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    streamed = {r.start: (r.events, r.interested) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r.start: (r.events, r.interested) for r in feedback.feedback_windows(spark.read.schema(stream.schema).json(str(tmp_path / "in")).dropDuplicates()).collect()}
    assert len(streamed) == len(batch) - 1 and all(batch[k] == v for k, v in streamed.items())


def test_rates_and_sessions_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"pseudonymous_user_id": f"u{i % 2}", "artist_id": f"a{i}", "action": feedback.ACTIONS[i % 5], "created_at": f"2024-01-{1 + i // 10:02d}T0{i % 10}:00:00Z", "model_version": "v"} for i in range(30)]
    (tmp_path / "in/f.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    stream = feedback.read_feedback(spark, str(tmp_path / "in"))
    table = spark.read.schema(stream.schema).json(str(tmp_path / "in"))
    listens = lambda x: x.select(F.col("pseudonymous_user_id").alias("user_id"), "artist_id", F.col("created_at").alias("ts"))
    for name, of in (("rates", lambda x: feedback.feedback_rates(x, width="1 day")), ("sessions", lambda x: feedback.listen_sessions(listens(x), "3 hours"))):
        feedback.write(of(stream), str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination(120)
        streamed, batch = ({str(r) for r in x.collect()} for x in (spark.read.parquet(str(tmp_path / name)), of(table)))
        assert streamed and streamed < batch
    rates = feedback.feedback_rates(table).first()
    assert all(rates[f"{a}_rate"] == 0.2 for a in feedback.ACTIONS)


def test_sessions(spark):
    rows = spark.createDataFrame([("u", "a", "2024-01-01 00:00:00"), ("u", "b", "2024-01-01 00:29:00"), ("u", "c", "2024-01-01 02:00:00")], "user_id string, artist_id string, ts string")
    assert sorted(r.artists for r in feedback.listen_sessions(rows).collect()) == [["a", "b"], ["c"]]
