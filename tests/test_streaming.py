"""Enforcement of a stream equals that of the same rows as a table, also across restarts."""

import pytest
from pyspark.sql import functions as F

from tablepact import (
    Contract,
    ContractError,
    Port,
    annotate,
    apply_contract,
    enforce,
    enforce_stream,
    enforce_stream_tables,
    parsed_records,
    read_summary,
    split,
    summarise,
    summarise_port_streams,
    summarise_stream,
    violations,
)

CONTRACT = Contract.from_schema(
    {
        "required": ["event_id"],
        "properties": {
            "event_id": {"type": "integer"},
            "ts": {"format": "date-time"},
            "event_type": {"enum": ["click", "view"]},
            "value": {"type": "number", "maximum": 100},
        },
    }
)


def add_file(spark, folder, first, rows=20):
    events = spark.range(first, first + rows).selectExpr(
        "case when id % 10 = 9 then 'none' else cast(id as string) end as event_id",
        "case when id % 4 = 0 then 'soon' else '2024-01-01T00:00:00Z' end as ts",
        "case when id % 3 = 0 then 'error' else 'click' end as event_type",
        "id as value",
    )
    events.coalesce(1).write.mode("append").json(folder)


@pytest.fixture
def paths(tmp_path):
    return {name: str(tmp_path / name) for name in ("in", "good", "bad", "ckpt", "batch_good", "batch_bad")}


def run(spark, paths):
    stream = spark.readStream.schema(CONTRACT.text_schema).option("maxFilesPerTrigger", 1).json(paths["in"])
    query = enforce_stream(stream, CONTRACT, paths["good"], paths["bad"], paths["ckpt"])
    query.awaitTermination()


def sides(spark, good, bad):
    kept = spark.read.parquet(good).select("event_id", "event_type", "value").collect()
    rest = spark.read.parquet(bad).select("event_id", "ts", "value").collect()
    return sorted(map(str, kept)), sorted(map(str, rest))


def test_stream_equals_batch_and_restarts_add_nothing(spark, paths):
    for first in (0, 20, 40):
        add_file(spark, paths["in"], first)
    run(spark, paths)
    enforce(spark.read.schema(CONTRACT.text_schema).json(paths["in"]), CONTRACT, paths["batch_good"], paths["batch_bad"])
    batch = sides(spark, paths["batch_good"], paths["batch_bad"])
    assert sides(spark, paths["good"], paths["bad"]) == batch
    assert len(batch[0]) + len(batch[1]) == 60 and batch[0] and batch[1]
    assert spark.read.parquet(paths["good"]).select("batch_id").distinct().count() == 3

    run(spark, paths)
    assert sides(spark, paths["good"], paths["bad"]) == batch

    add_file(spark, paths["in"], 60)
    run(spark, paths)
    assert sum(map(len, sides(spark, paths["good"], paths["bad"]))) == 80


def test_checks_apply_to_streaming_frames(spark, paths):
    add_file(spark, paths["in"], 0)
    stream = spark.readStream.schema(CONTRACT.text_schema).json(paths["in"])
    for frame in (annotate(stream, CONTRACT), apply_contract(stream, CONTRACT), *split(stream, CONTRACT)):
        assert frame.isStreaming
    query = annotate(stream, CONTRACT).writeStream.format("memory").queryName("annotated").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("annotated").count() == 20


def test_a_replayed_batch_overwrites_itself(spark, paths, tmp_path):
    add_file(spark, paths["in"], 0)
    add_file(spark, paths["in"], 20)
    run(spark, paths)
    before = sides(spark, paths["good"], paths["bad"])
    # As after a crash between writing the last batch and committing it.
    for commit in (tmp_path / "ckpt" / "commits").iterdir():
        if commit.name in ("1", ".1.crc"):
            commit.unlink()
    run(spark, paths)
    assert sides(spark, paths["good"], paths["bad"]) == before


def test_a_new_checkpoint_keeps_what_is_stored(spark, paths, tmp_path):
    add_file(spark, paths["in"], 0)
    run(spark, paths)
    before = sides(spark, paths["good"], paths["bad"])
    add_file(spark, paths["in"], 20)
    run(spark, {**paths, "ckpt": str(tmp_path / "other")})
    after = sides(spark, paths["good"], paths["bad"])
    assert len(before[0]) + len(before[1]) == 20 and len(after[0]) + len(after[1]) == 60
    assert set(before[0]) <= set(after[0]) and set(before[1]) <= set(after[1])


def stream_of(spark, paths, **options):
    return spark.readStream.schema(CONTRACT.text_schema).options(maxFilesPerTrigger=1, **options).json(paths["in"])


def test_both_sides_agree_on_a_stream_that_never_gives_the_same_rows_twice(spark, paths):
    """Each batch is evaluated once: a row that is good by chance is on one side, and on no other."""
    add_file(spark, paths["in"], 0, 400)
    chance = stream_of(spark, paths).withColumn("value", F.rand() * 200).withColumn("event_type", F.lit("click")).withColumn("event_id", F.uuid())
    contract = Contract.from_schema({"properties": {"event_id": {"type": "string"}, "value": {"type": "number", "maximum": 100}}})
    enforce_stream(chance, contract, paths["good"], paths["bad"], paths["ckpt"]).awaitTermination()
    good, bad = spark.read.parquet(paths["good"]), spark.read.parquet(paths["bad"])
    assert good.count() + bad.count() == 400 and good.where("value > 100").count() == bad.where("value <= 100").count() == 0
    assert 100 < good.count() < 300 and spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


@pytest.fixture
def tables(spark):
    names = ("events_kept", "events_lost")
    yield names
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_a_stream_into_the_tables_of_its_port(spark, paths, tables, tmp_path):
    good, bad = tables

    def run_into_tables():
        enforce_stream_tables(stream_of(spark, paths), CONTRACT, good, bad, paths["ckpt"]).awaitTermination()
        for t in tables:
            spark.catalog.refreshTable(t)
        return [sorted(map(str, spark.table(t).drop("_run").collect())) for t in tables]

    for first in (0, 20):
        add_file(spark, paths["in"], first)
    once = run_into_tables()
    enforce(spark.read.schema(CONTRACT.text_schema).json(paths["in"]), CONTRACT, paths["batch_good"], paths["batch_bad"])
    batch = [sorted(map(str, spark.read.parquet(paths[p]).collect())) for p in ("batch_good", "batch_bad")]
    assert once == batch and sum(map(len, once)) == 40
    assert spark.table(good).schema["value"].dataType == CONTRACT.schema["value"].dataType
    for commit in (tmp_path / "ckpt" / "commits").iterdir():
        if commit.name in ("1", ".1.crc"):
            commit.unlink()
    assert run_into_tables() == once
    assert spark.table(good).select("_run").distinct().count() == 2


def test_running_totals_equal_the_batch_summary_across_restarts(spark, paths, tmp_path):
    totals, key = str(tmp_path / "totals"), "check_no"
    for first in (0, 20, 40):
        add_file(spark, paths["in"], first)
        summarise_stream(stream_of(spark, paths), CONTRACT, totals, paths["ckpt"]).awaitTermination()
        batch = summarise(spark.read.schema(CONTRACT.text_schema).json(paths["in"]), CONTRACT)
        found = read_summary(spark, totals)
        assert found.drop("stream").orderBy(key).collect() == batch.orderBy(key).collect()
        assert found.select("rows").distinct().collect()[0].rows == first + 20
    for commit in (tmp_path / "ckpt" / "commits").iterdir():
        if commit.name in ("2", ".2.crc"):
            commit.unlink()
    summarise_stream(stream_of(spark, paths), CONTRACT, totals, paths["ckpt"]).awaitTermination()
    assert read_summary(spark, totals).drop("stream").orderBy(key).collect() == batch.orderBy(key).collect()
    with pytest.raises(ContractError, match="no checks"):
        summarise_stream(stream_of(spark, paths), Contract.from_schema({"properties": {"ts": {}}}, "bare"), totals, paths["ckpt"])


def test_totals_of_several_streaming_ports(spark, paths, tmp_path):
    add_file(spark, paths["in"], 0)
    stream = stream_of(spark, paths)
    ports = {
        "events": Port(stream, CONTRACT), "01": Port(stream, {"properties": {"value": {"type": "number", "maximum": 3}}}),
        "free": Port(stream, None), "bare": Port(stream, {"properties": {"ts": {"type": "string"}}}),
    }
    started = summarise_port_streams(ports, str(tmp_path / "t"), str(tmp_path / "c"))
    assert set(started) == {"events", "01"}
    for query in started.values():
        query.awaitTermination()
    found = {(r.port, r.check, r.column): r.violations for r in read_summary(spark, str(tmp_path / "t"), ports=True).collect()}
    assert found["01", "is_not_greater_than", "value"] == 16 and found["events", "is_in_list", "event_type"] == 7 and len(found) == 5
    with pytest.raises(ContractError, match="gone"):
        summarise_port_streams(ports, "t", "c", ["events", "gone"])


ORDER_EVENT = Contract.from_schema(
    {
        "required": ["event_id"],
        "properties": {
            "event_id": {"format": "uuid"}, "timestamp": {"format": "date-time"}, "metadata": {"type": "object"},
            "lines": {"type": "array", "items": {"properties": {"n": {"type": "integer"}}}},
        },
    }
)
ID = "00000000-0000-4000-8000-000000000001"
MESSAGES = [
    ("a", f'{{"event_id": "{ID}", "timestamp": "2024-01-01T00:00:00Z", "metadata": {{"x": "1"}}, "lines": [{{"n": 1}}]}}'),
    ("b", f'{{"event_id": "{ID}", "timestamp": "soon"}}'), ("c", '{"event_id": '), ("d", "plain"), ("e", None), ("f", f'[{{"event_id": "{ID}"}}, {{}}]'),
]


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_a_port_on_a_message_bus(spark, paths, kind):
    """Key, payload and time of arrival, as a file stream; the payload's own timestamp counts."""
    rows = [(k, v, i) for i, (k, v) in enumerate(MESSAGES)]
    messages = spark.createDataFrame(rows, "key string, value string, timestamp long").withColumn("value", F.col("value").cast(kind))
    messages.coalesce(1).write.parquet(paths["in"])
    stream = spark.readStream.schema(messages.schema).parquet(paths["in"])
    enforce_stream(parsed_records(stream, "value", ORDER_EVENT), ORDER_EVENT, paths["good"], paths["bad"], paths["ckpt"]).awaitTermination()
    kept = spark.read.parquet(paths["good"]).collect()
    assert len(kept) == 2 and {r.timestamp is None for r in kept} == {True, False}
    assert [r.lines[0].n for r in kept if r.lines] == [1] and [r.metadata for r in kept if r.metadata] == [{"x": "1"}]
    lost = {(r.key, r._unreadable): [e.check for e in r._errors] for r in spark.read.parquet(paths["bad"]).collect()}
    assert lost == {
        ("b", None): ["is_valid_timestamp"], ("c", '{"event_id": '): ["is_not_null", "is_readable"], ("d", "plain"): ["is_not_null", "is_readable"],
        ("e", None): ["is_not_null"], ("f", None): ["is_not_null"],
    }
    batch = violations(parsed_records(messages, "value", ORDER_EVENT), ORDER_EVENT, "key")
    assert sorted((r.key, r.check) for r in batch.collect()) == sorted((k, c) for (k, _), checks in lost.items() for c in checks)
