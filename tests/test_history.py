"""Clusters, looking back, accounting and routing against plain versions, with odd rows."""

import json
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.functions import body
from quillspark.functions.dom import parse
from quillspark.operators import accounting, clusters, history
from quillspark.streaming import routing

# --- cutting and budgets -------------------------------------------------------


def test_cut_by_visible_characters():
    assert body.cut("<p>one two three</p><p>four</p>", 100) == "<p>one two three</p><p>four</p>"
    assert body.cut("<p>one two three</p><p>four</p>", 9) == "<p>one two</p>" and body.cut("<p>one  \n two</p>", 5) == "<p>one t</p>"
    assert body.cut("<div><b></b><script>x</script><p>ab</p><img src=x><i>cd</i></div>", 2) == "<div><p>ab</p></div>"
    assert body.cut("<img src=x><p> </p>", 9) == '<img src="x"><p> </p>' and body.cut(None, 5) == body.cut("x", 0) == body.cut("", 5) == ""
    rng = random.Random(2)
    for _ in range(200):
        markup = "".join(rng.choice(["<p>", "</p>", "<b>", "word ", "x", " ", "<ul><li>", "</ul>", "<br>"]) for _ in range(rng.randint(0, 20)))
        n = rng.randint(1, 30)
        got = body.cut(markup, n)
        size = len("".join(parse(got).texts()))
        whole = sum(len(body.re.sub(r"\s+", " ", t)) for t in parse(markup).texts())
        assert size <= n and (whole > n or size == whole), markup
    assert len(body.cut("<div>" * 30_000 + "a " * 30_000, 20_000)) < 400_000


def fair(sizes, budget):
    """What each gets if the budget is poured out evenly."""
    left, given = budget, {}
    for k, i in enumerate(sorted(range(len(sizes)), key=lambda i: sizes[i])):
        share = left // (len(sizes) - k)
        if sizes[i] > share:
            for j in sorted(range(len(sizes)), key=lambda i: sizes[i])[k:]:
                given[j] = share
            return given
        given[i] = sizes[i]
        left -= sizes[i]
    return given


def test_allowances(spark):
    rng = random.Random(5)
    groups = {c: [rng.randint(0, 60) for _ in range(rng.randint(1, 7))] for c in range(60)} | {99: [5000] * 3}
    rows = spark.createDataFrame([(c, p, s) for c, sizes in groups.items() for p, s in enumerate(sizes)], "c int, p int, s int")
    got = {(r.c, r.p): (r.a, r.allowance) for r in clusters.allowances(clusters.allowances(rows, "s", 100, "c", "p").withColumnRenamed("allowance", "a"), "s", 100, "c", "p", fair=True).collect()}
    for c, sizes in groups.items():
        want = fair(sizes, 100)
        for p, s in enumerate(sizes):
            before = sum(sizes[:p])
            assert got[c, p] == (max(0, min(s, 100 - before)), want[p]), (c, sizes)
        assert sum(got[c, p][1] for p in range(len(sizes))) <= 100 or sum(sizes) <= 100
    assert clusters.allowances(rows.limit(0), "s", 100, "c", "p", fair=True).count() == 0


def test_payloads(spark):
    long = "<p>" + "palavra " * 120 + "</p>"
    kind = "cluster_id int, position int, url string, name string, title string, content string, published_at string, used int"
    rows = [
        (1, 0, "https://www.collider.com/a", "Collider", "A", long, "d", 1), (1, 1, "https://b.ex/x", None, None, long, None, 1), (1, 2, "https://c.ex/", "C", "C", "<p>curto</p>", None, 1), (1, 3, "https://d.ex/", "D", "D", long, None, 1),
        (2, 0, "https://variety.com/a", "", "V", long, None, 1), (2, 1, "http://www.variety.com/a/?q=1", "", "again", long, None, 1), (2, 2, None, "", "", long, None, 1),
        (3, 0, "https://x.ex/", "", "X", long, None, 1), (4, 0, "https://y.ex/", "", "Y", None, None, 1), (5, 0, "", "", "", "", None, 1),
    ]
    sources = spark.createDataFrame(rows, kind)
    got = {r.cluster_id: r for r in clusters.payloads(sources).collect()}
    assert set(got) == {1, 2}
    assert (got[1].basis, [d.source_name for d in got[1].documents], [s.status for s in got[1].skipped]) == ("multi_source", ["Collider", "B"], ["TOO_SHORT"])
    assert got[1].title == "A" and got[1].content.startswith("=== FONTE PRINCIPAL: Collider ===\nTítulo: A\nURL: https://www.collider.com/a\n\n<p>palavra") and "=== FONTE SECUNDÁRIA 1: B ===\nTítulo: \n" in got[1].content
    assert got[2].basis == "single_source_trusted" and [(s.status, s.title, s.chars) for s in got[2].skipped] == [("DUPLICATE", "", 0)]
    shared = {r.cluster_id: r for r in clusters.payloads(sources, budget=1000).collect()}
    assert all(400 < len(parse(d.content).text()) <= 500 for d in shared[1].documents) and len(parse(shared[2].documents[0].content).text()) > 900
    assert clusters.payloads(sources.limit(0)).count() == 0


def test_media(spark):
    image = lambda u: {"url": u, "alt": "", "caption": ""}
    rows = [(1, 1, [image("https://h/B.jpg"), image("https://h/a-300x200.jpg?w=3&x=1")], "https://h/lead.png"), (1, 0, [image("https://h/b.jpg "), image(None), image("")], None), (1, 2, None, "https://h/A.jpg?x=1"), (2, 0, None, None), (None, 0, [image("data:x"), image("z")], "")]
    docs = spark.createDataFrame(rows, "cluster_id int, position int, images array<struct<url:string,alt:string,caption:string>>, lead string")
    got = lambda **k: [(r.cluster_id, r.n, r.url) for r in sorted(clusters.media(docs, **k).collect(), key=lambda r: (r.cluster_id or 0, r.n))]
    assert got(most=None) == [(None, 1, "z"), (1, 1, "https://h/b.jpg "), (1, 2, "https://h/a-300x200.jpg?w=3&x=1"), (1, 3, "https://h/lead.png"), (1, 4, "https://h/A.jpg?x=1")]
    assert got(variants=True) == [(None, 1, "z"), (1, 1, "https://h/b.jpg "), (1, 2, "https://h/a-300x200.jpg?w=3&x=1"), (1, 3, "https://h/lead.png")]
    clips = spark.createDataFrame([(1, 1, ["x", "y"]), (1, 0, ["y", "", None]), (2, 0, None)], "cluster_id int, position int, videos array<string>")
    assert sorted((r.cluster_id, r.n, r.video) for r in clusters.videos(clips).collect()) == [(1, 1, "y"), (1, 2, "x")]


# --- looking back ----------------------------------------------------------------


def test_asof_equals_a_search(spark):
    rng = random.Random(9)
    start = datetime(2024, 1, 1)
    at = lambda: start + timedelta(hours=rng.randint(0, 24 * 9))
    key = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    left = [(i, key(), at() if rng.random() < 0.95 else None, "x") for i in range(300)] + [(7, "a", start, "x")] * 3
    right = [(key(), at() if rng.random() < 0.95 else None, rng.randint(0, 9), rng.choice([None, "v", "w"])) for _ in range(200)]
    ldf = spark.createDataFrame(left, "id int, k string, t timestamp, _t string")
    rdf = spark.createDataFrame(right, "k string, since timestamp, n int, s string")

    def want(k, t):
        seen = [(r[1], (r[2], r[3] or "")) for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and r[1] <= t]
        return max(seen)[1] if seen else (None, "")

    expected = sorted((i, str(k), str(t), *want(k, t)) for i, k, t, _ in left if True)
    for slice_of in (None, F.lit(0), F.date_trunc("hour", "_t")):
        got = history.asof(ldf, rdf, "k", "t", "since", ["n", "s"], slice_of)
        assert got.columns == ["id", "k", "t", "_t", "n", "s"]
        assert sorted(((r.id, str(r.k), str(r.t), r.n, r.s or "") for r in got.collect()), key=repr) == sorted(expected, key=repr)
    assert history.asof(ldf.limit(0), rdf, "k", "t", "since", ["n"]).count() == 0
    assert history.asof(ldf, rdf.limit(0), "k", "t", "since", ["n"]).where("n is not null").count() == 0


def test_revisions_and_material(spark):
    events = spark.createDataFrame([("a", 1, 0), ("a", 4, 0), ("a", 5, 0), ("b", 2_000_000_000, 0), (None, 1, 0)], "event_key string, revision int, gap int")
    got = {(r.event_key, r.revision): (r.ordinal, r.revisions, r.gap) for r in history.revisions(events.drop("gap")).collect()}
    assert got == {("a", 1): (1, 3, 0), ("a", 4): (2, 3, 2), ("a", 5): (3, 3, 0), ("b", 2_000_000_000): (1, 1, 0), (None, 1): (1, 1, 0)}
    evidence = spark.createDataFrame([("d", "u", 2, " two ", "WEAK", "N2"), ("d", "u", 1, "one", "PRIMARY", "N1"), ("d", "u", 3, None, "WEAK", "N3"), ("d", "v", 1, "", "WEAK", None)], "draft_id string, source_url string, ordinal int, excerpt string, strength string, source_name string")
    rows = {r.url: r for r in history.source_material(evidence.withColumn("title", F.lit(None).cast("string")).withColumn("published_at", F.lit(None).cast("string"))).collect()}
    assert (rows["u"].content, rows["u"].is_primary, rows["u"].source_name) == ("one two", True, "N1") and rows["v"].content == ""


def test_replay_recovers_and_repeats(spark, tmp_path):
    events = spark.createDataFrame([("a", 1, "p1"), ("a", 2, "p2"), ("b", 1, "p3"), ("c", 1, ""), ("d", 1, "p4")], "event_key string, revision int, payload string")
    asked = spark.createDataFrame([("a", None), ("a", 1), ("a", 2), ("b", None), ("c", None), ("d", None), ("nobody", None), ("b", 9)], "event_key string, revision int")
    seen = []

    def process(broken):
        def run(df):
            rows = [(r.event_key, r.revision, r.payload) for r in df.collect()]
            seen.append(sorted(rows))
            out = [(k, v, None if k in broken else "d" + p, "h", "broken" if k in broken else None) for k, v, p in rows if k != "d" or "d" not in broken]
            return df.sparkSession.createDataFrame(out, "event_key string, revision int, draft_id string, output_hash string, error string")

        return run

    ledger = str(tmp_path / "ledger")
    status = lambda df: Counter((r.event_key, r.revision, r.status) for r in df.collect())
    first = status(history.replay(events, asked, process({"b", "d"}), ledger, "r1"))
    assert first == Counter({("a", 1, "REPLAY_COMPLETED"): 1, ("a", 2, "REPLAY_COMPLETED"): 1, ("b", 1, "REPLAY_FAILED"): 1, ("d", 1, "REPLAY_FAILED"): 1, ("c", 1, "NO_PAYLOAD"): 1, ("nobody", None, "NOT_FOUND"): 1, ("b", 9, "NOT_FOUND"): 1})
    second = status(history.replay(events, asked, process(set()), ledger, "r1"))
    assert second["b", 1, "REPLAY_COMPLETED"] == second["d", 1, "REPLAY_COMPLETED"] == second["a", 1, "REPLAY_COMPLETED"] == 1
    history.replay(events, asked, process(set()), ledger, "r1")
    assert seen[1] == [("b", 1, "p3"), ("d", 1, "p4")] and seen[2] == []
    assert status(history.replay(events, asked.limit(1), process(set()), ledger, "r2")) == Counter({("a", 2, "REPLAY_COMPLETED"): 1})


# --- accounting --------------------------------------------------------------------


def test_states_merge_as_the_log_counts(spark):
    rng = random.Random(3)
    rows = [(datetime(2024, 1, rng.randint(1, 4), rng.randint(0, 23)), rng.choice(["g", "o", None]), rng.choice(["m", "n"]), str(rng.choice([rng.randint(0, 900), -1, "x", None])), str(rng.randint(0, 90)), rng.choice([True, False, None]), i % 5) for i in range(900)]
    log = spark.createDataFrame(rows, "at timestamp, api_type string, model string, prompt_tokens string, completion_tokens string, success boolean, part int")
    states = [accounting.partial(log.where(F.col("part") == p), F.col("part")) for p in range(5)]
    merged = accounting.merge(states[3], states[0], states[0], accounting.merge(*states[1:]), states[2])
    sums = defaultdict(lambda: [0] * 6)
    for _, api, _, p, c, ok, _ in rows:
        if p.isdigit():
            for i, v in enumerate((int(p), int(c), int(p) + int(c), 1, int(bool(ok)), int(not ok))):
                sums[api][i] += v
    got = {r.api_type: [r[c] for c in accounting.SUMS] for r in accounting.summary(merged, ["api_type"]).collect()}
    assert got == dict(sums)
    whole = accounting.summary(merged, []).first()
    sizes = sorted(int(p) + int(c) for _, _, _, p, c, _, _ in rows if p.isdigit())
    assert whole.requests == len(sizes) and abs(sizes.index(whole.median_size) / len(sizes) - 0.5) < 0.03
    assert {r.status for r in accounting.integrity(log, merged, F.col("part")).collect()} == {"OK"}
    found = Counter(r.status for r in accounting.integrity(log.where("part < 4"), states[0].unionByName(states[4]), F.col("part")).collect())
    assert found["MISSING"] and found["UNKNOWN"] and found["OK"] and not found["STALE"]
    assert accounting.partial(log.limit(0), F.lit(1)).count() == 0


def test_gate_metrics(spark):
    rows = spark.createDataFrame([([("B", {"y": "1", "x": None}), ("A", {"z": "2"}), ("C", None)],), ([],), (None,)], "rules array<struct<code:string,metrics:map<string,string>>>")
    got = [r.m for r in rows.select(accounting.gate_metrics(F.col("rules")).alias("m")).collect()]
    keys = [r.k for r in rows.select(F.map_keys(accounting.gate_metrics(F.col("rules"))).alias("k")).collect()]
    assert got == [{"A.z": "2", "B.x": None, "B.y": "1"}, {}, None] and keys == [["A.z", "B.x", "B.y"], [], None]


# --- routing -------------------------------------------------------------------------


def payloads():
    from quillspark.functions import canonical  # noqa: F401  the hash is made by Spark below

    source = lambda s, p: {"domain": s, "url": f"https://{s}/1", "author": "x", "published_at": "2024-01-01T00:00:00Z", "is_primary": p}
    base = {"contract_version": "rss-prime-event-v1", "revision": 1, "topic": "movies", "title": "T", "first_seen": "2024-01-01T00:00:00Z", "last_seen": "2024-01-02T00:00:00Z", "is_multi_source": True, "source_count": 2, "cluster_confidence": 0.5, "cursor": "c", "sources": [source("a.com", True), source("b.com", False)]}
    return [base | {"event_key": k, "revision": r, "title": t} for k, r, t in (("k1", 1, "T"), ("k2", 1, "T"), ("k1", 2, "T"), ("k1", 1, "other"))]


@pytest.fixture(scope="module")
def deliveries(spark):
    from quillspark.functions.canonical import payload_hash

    plain = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads())], "seq long, payload string")
    rows = [(r.seq, r.payload[:-1] + f', "payload_hash": "{r.h}"}}') for r in plain.select("*", payload_hash(F.col("payload")).alias("h")).collect()]
    return rows + [(10, "{no"), (11, None), (12, '{"id": 1}'), (13, '{"contract_version": "v9"}'), (14, '{"contract_version": "rss-prime-event-v1", "title": "no key"}')]


def test_a_stream_is_routed_once(spark, deliveries, tmp_path):
    path, landed = str(tmp_path / "out"), str(tmp_path / "landed")
    for n in range(0, len(deliveries), 3):
        spark.createDataFrame(deliveries[n : n + 3], "seq long, payload string").coalesce(1).write.mode("append").parquet(landed)

    def run(checkpoint):
        raw = spark.readStream.schema("seq long, payload string").option("maxFilesPerTrigger", 1).parquet(landed)
        q = routing.route_stream(raw, path, str(tmp_path / checkpoint))
        q.processAllAvailable()
        q.stop()

    def rows():
        return sorted((t, r.seq, r.reason) for t in routing.TARGETS for r in routing.table(spark, path, t, routing.ROUTED).collect())

    run("c1")
    once = rows()
    assert [(t, s) for t, s, _ in once if t == "accepted"] == [("accepted", 0), ("accepted", 1), ("accepted", 2)]
    assert ("rejected", 3, "REVISION_HASH_CONFLICT") in once and [s for t, s, _ in once if t == "dead_letter"] == [10, 11, 13] and [s for t, s, _ in once if t == "passed"] == [12] and ("rejected", 14) in [(t, s) for t, s, _ in once]
    assert len(once) == len(deliveries)
    run("c2")  # a lost checkpoint: the same batches come again and are left alone
    assert rows() == once


def test_an_interrupted_batch_is_written_anew(spark, deliveries, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame(deliveries[:2], "seq long, payload string")
    judge = routing.judge_after(path)

    def breaks(rows, batch):
        raise RuntimeError("lost")

    routing.fan_out(path, judge)(df, 0)
    with pytest.raises(RuntimeError):
        routing.fan_out(path, breaks)(df, 1)
    # Half of batch 1 was written before the loss.
    judge(df, 1).where("target = 'rejected'").drop("target").write.parquet(f"{path}/rejected/batch=1")
    assert routing.committed(spark, path) == [0] and routing.table(spark, path, "rejected", routing.ROUTED).count() == 0
    routing.fan_out(path, judge)(df, 1)
    assert routing.committed(spark, path) == [0, 1]
    assert sorted((r.seq, r.reason) for r in routing.table(spark, path, "rejected", routing.ROUTED).collect()) == [(0, "DUPLICATE"), (1, "DUPLICATE")]
    assert routing.table(spark, path, "accepted", routing.ROUTED).count() == 2


def test_rows_are_judged_in_one_pass(spark, deliveries):
    ledger = spark.createDataFrame([], "seq long, event_key string, revision int, payload_hash string")
    # Numbers that repeat, or none, multiply or lose no delivery.
    rows = [(1, p) for _, p in deliveries] + [(None, "{no"), (None, '{"id": 1}')]
    got = routing.judged(spark.createDataFrame(rows, "seq long, payload string"), ledger)
    assert sorted(str(r.payload) for r in got.collect()) == sorted(str(p) for _, p in rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("json_tuple") == 1 and "get_json_object" not in plan
    moved = routing.judged(spark.range(100).selectExpr("id as seq", "'{}' as payload"), ledger)
    moved.collect()
    assert moved._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_opened_payloads_have_the_fields_of_single_reads(spark):
    from quillspark.operators import contract

    odd = ['{"title": 1.50, "topic": {"b": 1, "a": [1, "x"]}, "revision": "", "cursor": null, "event_key": "\\u00e9 \\"q\\"", "sources": [{"url": "a"}]}', '{"title": true, "sources": "none", "eventKey": 1e5}', '[{"title": "T"}]', '"title"', "7", "{}", "{no", '{"title": "T"} x', "", None]
    rows = contract.opened(spark.createDataFrame([(x,) for x in odd], "payload string"))
    pairs = rows.select(*[F.struct(contract.field(n), F.get_json_object("payload", f"$.{n}")).alias(n) for n in contract.FIELDS], "_readable", F.try_parse_json("payload").isNotNull().alias("json")).collect()
    for r in pairs:
        assert r._readable == r.json and (not r.json or all(r[n][0] == r[n][1] for n in contract.FIELDS)), r


def test_routed_files_are_many(spark, tmp_path, monkeypatch):
    from quillspark.plans import history as plans

    (tmp_path / "sf").mkdir()
    spark.range(6_000).selectExpr("id as o_orderkey", "timestamp'2024-01-01' as o_orderdate").coalesce(1).write.parquet(str(tmp_path / "sf/orders.parquet"))
    monkeypatch.setattr(plans, "scratch", lambda *_: str(tmp_path / "routing"))
    assert plans.routed_deliveries(spark, str(tmp_path / "sf")).count() == 8_000
    assert len(list((tmp_path / "routing/plain/0").glob("part-*"))) >= 32  # one row group was one file and one task
