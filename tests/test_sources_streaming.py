"""Sources, sinks and streams in temporary folders."""

import random

from pyspark.sql import functions as F

from quillspark.operators import revisions
from quillspark.sources import feeds, sinks
from quillspark.streaming import events

RSS = """<?xml version="1.0"?><rss xmlns:sf="https://superfeed.rssprime/ns/1.0"><channel>
<item><guid>g1</guid><link>https://a.com/1</link><title>One</title><pubDate>Mon, 5 Jan 2026 10:00:00 +0000</pubDate><sf:event_key>k</sf:event_key><sf:urls>https://a.com/1|https://b.com/2</sf:urls><sf:multi_source>true</sf:multi_source><sf:source_count>2</sf:source_count></item>
<item><link>https://c.com/3</link><title>Two</title><pubDate>2026-01-06</pubDate></item>
<item><guid>g3</guid><link>https://d.com/3</link><title>Three</title><sf:event_key>k</sf:event_key></item>
</channel></rss>"""


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(RSS)
    items = feeds.normalise(feeds.rss(spark, str(tmp_path / "f.xml"))).withColumn("source_id", F.lit("s"))
    config = spark.createDataFrame([("s", "superfeed", "movies", "S", 5)], "source_id string, origin string, topic string, source_name string, priority int")
    rows = feeds.read(items, config).collect()
    assert [r.title for r in rows] == ["One", "Two"]
    assert rows[0].cluster_signature and rows[0].urls == ["https://a.com/1", "https://b.com/2"] and rows[0].canonical_url == "a.com/1"
    assert len(rows[1].id) == 64 and rows[1].priority == 5 and rows[1].topic == "movies"


def test_sitemap(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset>" + "".join(f"<url><loc>https://a.com/{i}</loc><lastmod>2026-01-0{i}</lastmod></url>" for i in range(1, 6)) + "</urlset>")
    got = [r.loc[-1] for r in feeds.sitemap(spark, str(tmp_path / "s.xml"), limit=3, deny="/5$").collect()]
    assert got == ["4", "3", "2"]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "out")
    batch = lambda *rows: spark.createDataFrame(rows, "draft_id string, output_hash string")
    run = lambda *rows: {r.draft_id: r.submission for r in sinks.submit_drafts(batch(*rows), path).collect()}
    assert run(("a", "1"), ("b", "1")) == {"a": "WRITTEN", "b": "WRITTEN"}
    assert run(("a", "1"), ("b", "2"), ("c", "1")) == {"a": "UNCHANGED", "b": "CONFLICT", "c": "WRITTEN"}
    for _ in range(2):
        sinks.append_absent(batch(("x", "1")), str(tmp_path / "t"), ["draft_id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_stream_decisions_equal_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, f"k{rng.randint(0, 5)}", rng.randint(1, 5), rng.choice("ab")) for i in range(120)]
    schema = "seq long, event_key string, revision int, payload_hash string"
    df = spark.createDataFrame(rows, schema)
    want = {r.seq: (r.decision, r.missing_from, r.missing_to) for r in revisions.decide(df).collect()}
    for part in range(3):
        df.where(f"seq div 40 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = events.revision_decisions(events.read(spark, str(tmp_path / "in"), df.schema))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = got.writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.seq: (r.decision, r.missing_from, r.missing_to) for r in spark.table("decided").collect()} == want


def test_state_of_keys_is_forgotten(spark, tmp_path):
    """A key without deliveries for longer than the limit leaves the state; a gap of two thousand million revisions is two numbers."""
    import time

    schema = "seq long, event_key string, revision int, payload_hash string"
    land = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    def run(*rows):
        land(*rows)
        got = events.revision_decisions(events.read(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), forget_ms=1000)
        q = got.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        # With such a timeout a stream is never done: it looks for keys to forget without new rows.
        for _ in range(80):
            time.sleep(0.5)
            if any(p.numInputRows for p in q.recentProgress):
                break
        q.stop()

    run((1, "a", 1, "x"), (2, "a", 2_000_000_000, "y"))
    time.sleep(2)
    run((3, "b", 1, "x"))
    run((4, "a", 1, "z"))
    got = {r.seq: (r.decision, r.missing_from, r.missing_to) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[2] == ("ACCEPT_NEW_REVISION", 2, 1_999_999_999) and got[4][0] == "ACCEPT_NEW_EVENT"


def test_batches_are_appended_once(spark, tmp_path):
    from quillspark.streaming import routing

    path = str(tmp_path / "t")
    batch = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    write = sinks.batch_writer(path, ["k"])
    write(batch(("a", 1), ("b", 1)), 0)
    write(batch(("c", 9)), 0)  # a committed batch that comes again
    write(batch(("a", 2), ("d", 2)), 1)
    assert sorted(tuple(r) for r in routing.table(spark, path, "rows", batch(("", 0)).schema).collect()) == [("a", 1), ("b", 1), ("d", 2)]


def test_stream_dedupe_and_windows(spark, tmp_path):
    df = spark.sql("select timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, id) ts, id % 6 as k from range(48)")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(name, out, mode):
        out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert len(run("deduped", events.deduplicated(read(), ["k"]), "append")) == 6
    assert sum(r.n for r in run("windows", events.tumbling(read(), ["k"]), "complete")) == 48


def test_breaker(spark):
    rows = [("s", i, f) for i, f in enumerate([True, True, True, True, False, True])]
    got = events.breaker(spark.createDataFrame(rows, "source_id string, seq int, failed boolean")).orderBy("seq").collect()
    assert [r.streak if r.failed else 0 for r in got] == [1, 2, 3, 4, 0, 1] and [r.skip_next for r in got] == [False, False, True, False, False, False]
