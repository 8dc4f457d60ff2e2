"""Operators on small inputs of their own."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import scalars
from weftline.operators import corroborate, entities, extract, geofence, graph, normalize, smalltarget, tracks
from weftline.operators.components import components
from weftline.plans.answer import Answers
from weftline.plans.scenario import Fusion, observations_from
from weftline.sources import feed_source, feeds, sinks
from weftline.sources.scenario import load_reports

REPORTS = [
    (0, "R-1", "2024-01-01T00:00:00Z", "a", "Grey Heron met the Lantern agent. Host 198.51.100.7 and mail Ops@Lantern.example.com."),
    (1, "R-2", "2024-01-02T00:00:00Z", "b", "Wallet addr-9f3kd2 paid GREY HERON, see https://Example.com/X."),
    (2, "R-3", "2024-01-03T00:00:00Z", "c", "Wallet addr-9f3kd2 again near 36.1234, -5.4321 with é 198.51.100.7."),
    (3, "R-4", "2024-01-04T00:00:00Z", "d", None),
]
GAZETTEER = {"vessel": {"Grey Heron": ["heron"]}, "org": {"Lantern": []}}


def reports(spark):
    return spark.createDataFrame(REPORTS, "report_ord long, id string, timestamp string, source string, text string")


def obs(spark, rows):
    """rows: dicts over defaults."""
    base = {"discipline": "OSINT", "source": "s", "timestamp": "2024-01-01T00:00:00Z", "text": "t", "entity": "", "entity_type": "vessel", "lat": None, "lon": None, "attributes": {}, "reliability": "B", "credibility": "2"}
    full = [{"id": f"obs--{k:03}", **base, **r} for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c] for c in normalize.OBSERVATION_COLUMNS) for r in full], normalize.OBSERVATION_SCHEMA)


def test_mentions_have_their_places(spark):
    m = extract.extract(reports(spark), GAZETTEER).collect()
    texts = {r[1]: r[4] for r in REPORTS}
    for x in m:
        cut = texts[x["source_ref"]][x["start"] : x["end"]]
        assert cut == x["value"] or cut.lower() == x["value"]
    found = {(x["type"], x["value"], x["source_ref"]) for x in m}
    assert ("vessel", "GREY HERON", "R-2") in found and ("vessel", "HERON", "R-2") in found and ("email", "ops@lantern.example.com", "R-1") in found
    assert ("org", "Lantern", "R-1") in found and ("geo", "36.1234, -5.4321", "R-3") in found
    r = {x["key"]: x for x in extract.resolve_mentions(extract.extract(reports(spark), GAZETTEER)).collect()}
    assert r["grey heron"]["canonical"] == "Grey Heron" and r["grey heron"]["mentions"] == 4 and r["grey heron"]["sources"] == ["R-1", "R-2"]


def test_mentions_are_found_once_for_an_evaluation(spark, monkeypatch):
    from weftline.plans import evaluate

    seen, made = spark.sparkContext.accumulator(0), extract.extract

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def found(reports, gazetteer=None):
        m = made(reports, gazetteer)
        return m.mapInArrow(counted, m.schema)

    monkeypatch.setattr(evaluate.extract, "extract", found)
    got = {r["metric"]: r["value"] for r in evaluate.core_evaluation(spark).collect()}
    rows = spark.createDataFrame([(k, i, t) for k, i, t in evaluate._REPORTS], "report_ord long, id string, text string")
    assert got == evaluate.CORE_EXPECTED and seen.value == made(rows, evaluate._GAZETTEER).count()


def test_an_answer_writes_no_edges(spark, monkeypatch):
    from weftline.plans import answer

    names, write = [], answer.stage
    monkeypatch.setattr(answer, "stage", lambda df, name, **o: names.append(name) or write(df, name, **o))
    got = Answers(reports(spark), GAZETTEER).answer("wallet addr-9f3kd2 again", 2)
    assert names == ["mentions"] and got["citations"][0] == "R-3" and {c["value"] for c in got["correlated"]} == {"Grey Heron", "https://Example.com/X.".lower(), "36.1234, -5.4321", "198.51.100.7"}


def test_graph_and_answer(spark):
    a = Answers(reports(spark), GAZETTEER)
    near = {r["value"]: r["weight"] for r in graph.correlate(a.nodes, a.edges, "grey heron").collect()}
    assert near["addr-9f3kd2"] == 1.0 and near["Lantern"] == 1.0
    got = a.answer("wallet addr-9f3kd2 again", 2)
    assert got["citations"][0] == "R-3" and got["pivot_entity"] == {"type": "crypto-address", "value": "addr-9f3kd2"}
    assert got["answer"].startswith("Wallet addr-9f3kd2") and [t["tool"] for t in got["trace"]] == ["retrieve", "extract", "correlate", "summarize"]
    assert sinks.answer_text(got).startswith("Query: wallet")
    assert a.answer("zzz", 2)["citations"] == []
    stix = sinks.graph_stix(a.nodes, a.edges).collect()
    assert len({s["id"] for s in stix}) == len(stix) and json.loads(stix[1]["object"])["pattern_type"] == "stix"


def test_reports_from_json(spark, tmp_path):
    at = tmp_path / "r.json"
    at.write_text(json.dumps([{"id": "x", "timestamp": "", "source": "s", "text": "1\n2"}, {"id": "y", "text": "é"}]))
    assert [(r["report_ord"], r["id"], r["text"]) for r in load_reports(spark, str(at)).orderBy("report_ord").collect()] == [(0, "x", "1\n2"), (1, "y", "é")]


def test_components_against_union_find(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(110)] + [(k, k + 1) for k in range(200, 260)]
    parent = {n: n for n in range(300)}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = components(spark.range(300).toDF("node"), spark.createDataFrame(edges, "a long, b long"))
    assert {x["node"]: x["comp"] for x in got.collect()} == {n: find(n) for n in range(300)}


def test_components_of_a_long_chain_and_a_hub(spark):
    n = 100_000
    chain = spark.range(n - 1).select(F.concat(F.lit("c"), "id").alias("a"), F.concat(F.lit("c"), F.col("id") + 1).alias("b"))
    hub = spark.range(20_000).select(F.lit("hub").alias("a"), F.concat(F.lit("h"), "id").alias("b"))
    nodes = chain.select("a").union(chain.select("b")).union(hub.select("a")).union(hub.select("b")).union(spark.range(5).select(F.concat(F.lit("x"), "id"))).distinct().toDF("node")
    rounds = []
    got = components(nodes, chain.union(hub).union(hub.select("b", "a")), rounds)
    sizes = {r["comp"]: r["n"] for r in got.groupBy("comp").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"c0": n, "h0": 20_001} | {f"x{k}": 1 for k in range(5)}
    assert len(rounds) <= 20 and all(later[0] < 0.6 * before[0] and later[1] < before[1] for before, later in zip(rounds, rounds[1:], strict=False) if before[0] > 100)


def test_moving_centres_in_a_grid():
    r = random.Random(13)

    def walked(points, radius):  # past all centres, one by one
        centres = []
        for lat, lon in points:
            for c in centres:
                if tracks._km(c[0], c[1], lat, lon) <= radius:
                    c[2] += 1
                    c[0], c[1] = c[0] + (lat - c[0]) / c[2], c[1] + (lon - c[1]) / c[2]
                    break
            else:
                centres.append([lat, lon, 1])
        return centres

    for at, spread, radius in (((0, 0), 0.3, 5), ((89.5, 0), 0.5, 20), ((10, 179.9), 0.3, 5), ((40, 10), 5, 100), ((0, 0), 60, 3000), ((0, 0), 0.01, 0)):
        points = [(max(-90.0, min(90.0, at[0] + r.gauss(0, spread))), (at[1] + r.gauss(0, spread) * (1 if at[0] < 80 else 200) + 180) % 360 - 180) for _ in range(600)]
        points += points[:50]
        grid = tracks._Centres(radius)
        for p in points:
            grid.add(*p)
        assert [c[:3] for c in grid.all] == walked(points, radius)


def test_a_track_of_very_many_areas(spark):
    import time

    n = 300_000  # over 10,000 places that are 11 km apart
    points = spark.range(n).select(F.lit("k").alias("root"), F.col("id").alias("seq"), ((F.col("id") * 7919 % 100) * 0.1).alias("lat"), ((F.floor(F.col("id") / 100) % 100) * 0.1).alias("lon"))
    began = time.time()
    got = tracks.dwell_areas(points).collect()
    assert len(got) == 10_000 and {a["n"] for a in got} == {30} and time.time() - began < 60


def test_zones_of_every_size_and_place(spark):
    r = random.Random(12)
    places = [(0, 0), (89.99, 20), (-90, 0), (10, 180), (-15, -179.99), (60, 100), (45, -45)]
    zones = [(f"z{k}.{radius}", float(lat), float(lon), float(radius), "restricted", "", []) for k, (lat, lon) in enumerate(places) for radius in (0, 0.01, 3, 150, 1000, 4500, 9000, 20_100)]
    spots = [(lat + r.choice([0, 1e-7, 0.01, 1, 20]) * r.uniform(-1, 1), (lon + r.choice([0, 1e-7, 0.01, 1, 40, 180]) * r.uniform(-1, 1) + 180) % 360 - 180) for lat, lon in places for _ in range(30)]
    spots = [(max(-90.0, min(90.0, float(a))), float(b)) for a, b in spots] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 180.0), (0.0, -180.0)]
    o = obs(spark, [{"lat": a, "lon": b} for a, b in spots])
    z = spark.createDataFrame(zones, geofence.ZONE_SCHEMA)
    assert max(c["count"] for c in geofence.zone_cells(z).groupBy("name").count().collect()) <= (2 * geofence.SPAN + 1) ** 2
    every = o.select(F.col("id").alias("oid"), F.col("lat").alias("a"), F.col("lon").alias("b")).crossJoin(z)  # few of both
    d = scalars.haversine_km(F.col("a"), F.col("b"), F.col("lat"), F.col("lon"))
    want = sorted((x["name"], x["oid"], x["d"] <= x["radius_km"]) for x in every.withColumn("d", d).where(F.col("d") <= F.col("radius_km") * 1.5).collect())
    got = sorted((x["zone"], x["observation_id"], x["status"] == "inside") for x in geofence.evaluate(o, z).collect())
    assert got == want and len(got) > 2000
    assert geofence.evaluate(o, z.limit(0)).count() == 0


def test_near_pairs_of_all_points(spark, monkeypatch):
    import numpy as np

    from weftline.operators import colocation

    r = np.random.default_rng(4)
    spots = {"one": (10, 20), "pole": (90, 0), "line": (0, 180), "wide": (-40, 60)}
    rows = []
    for name, (lat, lon) in spots.items():
        n, spread = (10_000, 0.15) if name == "one" else (700, 20 if name == "wide" else 0.2)
        at = np.stack([lat + spread * r.standard_normal(n), lon + (spread * r.standard_normal(n) if name != "pole" else 360 * r.random(n))], 1)
        at[:, 0] = np.where(at[:, 0] > 90, 180 - at[:, 0], at[:, 0])
        at[:, 1] = (at[:, 1] + 180) % 360 - 180
        at[: n // 10] = at[0]  # many at one place
        rows += [(name, float(a), float(b)) for a, b in at]
    rows += [("single", 1.0, 2.0), ("none", None, 1.0), (None, 1.0, 1.0), ("alike", 5.0, 5.0), ("alike", 5.0, 5.0), ("alike", 5.0, 5.0)]
    got = {x["root"]: (x["points"], x["near"]) for x in colocation.near_pairs(spark.createDataFrame(rows, "root string, lat double, lon double"), 25.0).collect()}

    def brute(name):
        p = np.radians([x[1:] for x in rows if x[0] == name])
        near = 0
        for k in range(len(p) - 1):
            a, b = p[k], p[k + 1 :]
            h = np.sin((b[:, 0] - a[0]) / 2) ** 2 + np.cos(a[0]) * np.cos(b[:, 0]) * np.sin((b[:, 1] - a[1]) / 2) ** 2
            near += int((2 * scalars.EARTH_RADIUS_KM * np.arcsin(np.minimum(1, np.sqrt(h))) <= 25).sum())
        return len(p), near

    assert got == {name: brute(name) for name in (*spots, "alike")} | {"single": (1, 0)}
    share = corroborate.colocation(spark.createDataFrame(rows[800:2000], "root string, lat double, lon double"), points=None).collect()
    assert [x["root"] for x in share] == ["one"] and 0 < share[0]["colocation"] < 1


def test_colocation_counts_every_point(spark):
    """Of 63 points the last three in time are far from the first 60, and from each other."""
    o = obs(spark, [{"entity": "Heron", "timestamp": f"2024-01-01T00:00:{k:02}Z", "lat": 10.0, "lon": 20.0} for k in range(60)] + [{"entity": "Heron", "timestamp": f"2024-02-0{k}T00:00:00Z", "lat": 10.0 + 5 * k, "lon": 20.0} for k in (1, 2, 3)])
    f = Fusion("co", o)
    (row,) = f.corroboration.collect()
    assert row["colocation"] == pytest.approx((60 * 59) / (63 * 62)) and row["band"] == "single-source"
    (row,) = corroborate.colocation(f.entity_obs, points=60).collect()
    assert row["colocation"] == 1.0


def test_resolution_merges_and_keeps_apart(spark):
    o = obs(spark, [{"entity": "MV Grey Heron", "attributes": {"imo": "1"}}, {"entity": "grey-heron"}, {"entity": "Tern", "attributes": {"imo": "1"}, "timestamp": "2024-01-02"}, {"entity": "Gull"}, {"entity": ""}, {"entity": "Gull", "entity_type": "craft"}])
    c = {r["id"]: r["root"] for r in entities.cluster(o).collect()}
    assert c == {"obs--000": "obs--000", "obs--001": "obs--000", "obs--002": "obs--000", "obs--003": "obs--003", "obs--005": "obs--005"}
    e = entities.resolve_entities(o, entities.cluster(o))
    assert {r["canonical"] for r in e.collect()} == {"MV Grey Heron", "Gull"}
    assert entities.name_type_conflicts(e).first()["etypes"] == ["craft", "vessel"]
    assert entities.identifier_conflicts(e).count() == 0


def test_exploded_names_are_not_broadcast(spark):
    """Few names are many sequences and tokens, which grow with them; their joins shuffle."""
    names = spark.createDataFrame([("v", f"unit {k:07}") for k in range(50)], "etype string, name string")
    for df in (entities._held(names), entities._alike(names, 0.6)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.split("\n") if re.search(r"BroadcastHashJoin.*(gram|token)#", line)]
        assert re.search(r"SortMergeJoin.*(gram|token)#", plan)


def test_similar_names_against_all_pairs(spark):
    r = random.Random(2)
    tokens = ["red", "blue", "heron", "lady", "of", "sea", "x1", "x10"]
    names = sorted({" ".join(r.sample(tokens, r.randint(1, 5))) for _ in range(60)} | {"a", "ab", "re"})
    got = {(x["a"], x["b"]) for x in entities.similar_names(spark.createDataFrame([("v", n) for n in names], "etype string, name string")).collect()}
    jac = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    assert got == {(a, b) for a in names for b in names if a < b and (a in b or b in a or jac(a, b) >= 0.6)}


def test_signal_content_is_dropped(spark):
    r = spark.createDataFrame([("E-1", "secret words", 12)], "emitter_id string, content string, bearing int")
    o = normalize.normalize("SIGINT", r).first()
    assert "secret" not in str(o) and o["attributes"]["emitter_id"] == "E-1" and (o["reliability"], o["credibility"]) == ("B", "2")
    with pytest.raises(KeyError):
        normalize.normalize("imint", r)


def test_tracks_and_contradictions(spark):
    rows = [{"entity": "x", "timestamp": f"2024-01-01T0{h}:00:00Z", "lat": 10.0 + d, "lon": 20.0} for h, d in enumerate([0, 0.01, 0.02, 30, 0.03, 0.04])]
    o = obs(spark, rows).withColumn("root", F.lit("r"))
    assert corroborate.spatial_contradictions(o).count() == 2
    legs = tracks.track_legs(tracks.track_points(o))
    assert {r["seq"] for r in tracks.speed_anomalies(legs).collect()} == {3, 4}
    areas = tracks.dwell_areas(tracks.track_points(o)).collect()
    assert sorted(a["n"] for a in areas) == [1, 5]
    assert tracks.off_pattern_locations(tracks.track_points(o), tracks.dwell_areas(tracks.track_points(o))).count() == 1


def test_zones(spark):
    o = obs(spark, [{"lat": 10.0, "lon": 179.99}, {"lat": 10.0, "lon": -179.99, "entity": "e"}, {"lat": 89.99, "lon": 100.0}, {"lat": 0.0, "lon": 0.0}, {"lat": 10.0, "lon": 179.9, "entity_type": "team"}])
    z = spark.createDataFrame([("line", 10.0, 179.995, 5.0, "keep-out", "", ["vessel"]), ("pole", 90.0, 0.0, 10.0, "other", "", []), ("point", 0.0, 0.0, 0.0, "restricted", "", [])], geofence.ZONE_SCHEMA)
    got = {(a["zone"], a["observation_id"][-1], a["status"], a["severity"]) for a in geofence.evaluate(o, z).collect()}
    assert got == {("line", "0", "inside", 4), ("line", "1", "inside", 4), ("pole", "2", "inside", 2), ("point", "3", "inside", 3)}
    assert geofence.dwell_alerts(geofence.evaluate(o, z)).count() == 0


def test_scenario(spark):
    src = {
        "geoint": spark.createDataFrame([("2024-03-01T09:00:00Z", "MV Grey Heron", "vessel", 36.12, -5.41), ("2024-03-01T12:00:00Z", "Grey Heron", "vessel", 36.15, -5.45)], "timestamp string, entity string, entity_type string, lat double, lon double"),
        "humint": spark.createDataFrame([("2024-03-01T10:00:00Z", "Heron seen", "Grey Heron", "vessel")], "timestamp string, report string, entity string, entity_type string"),
    }
    f = Fusion("demo", observations_from(src), spark.createDataFrame([("quay", 36.12, -5.42, 5.0, "keep-out", "", [])], geofence.ZONE_SCHEMA))
    c = f.counts.first()
    assert (c["observations"], c["entities"], c["disciplines"], c["tracks"], c["zone_alerts"]) == (3, 1, 2, 1, 2)
    assert f.dossier("heron").first()["band"] in ("moderate", "strong", "weak")
    with pytest.raises(KeyError):
        f.dossier("nobody")
    page = sinks.dashboard_html(f)
    assert "<script" not in page and "Grey Heron" in page and "demo" in sinks.picture_text(f)
    assert sinks.fusion_stix(f.observations, f.entities).count() == 1 + 3 + 1 + 3


def test_feeds(spark):
    rss = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="http://l"/><summary>&lt;b&gt;bold&lt;/b&gt; text</summary><updated>d</updated></entry></feed>'
    payloads = [
        ("g", 0, "g", "gdelt", json.dumps({"articles": [{"url": "u", "title": "t", "domain": "d", "seendate": "x"}, {"url": "u", "title": "t2"}]})),
        ("r", 1, "r", "rss", rss), ("i", 2, "i", "ioc_lines", "# c\nid,198.51.100.7,x\nhttps://bad.example/x,1\n\nnone"),
        ("u", 3, "u", "usgs", json.dumps({"features": [{"id": "q", "properties": {"mag": 5.1, "place": "sea", "time": 123}}]})),
        ("w", 4, "w", "reliefweb", json.dumps({"data": [{"id": 7, "fields": {"title": "Flood", "date": {"created": "2024"}}}]})), ("b", 5, "b", "gdelt", "not json"),
    ]
    p = spark.createDataFrame(payloads, "feed string, feed_ord int, source string, adapter string, content string")
    got = sorted((r["source"], r["text"], r["timestamp"]) for r in feeds.first_reports(feeds.payload_reports(p)).collect())
    assert got == [("g", "t (d)", "x"), ("i", "Threat indicator 198.51.100.7 reported by i.", ""), ("i", "Threat indicator https://bad.example/x reported by i.", ""), ("r", "T. bold text", "d"), ("u", "M5.1 sea", "123"), ("w", "Flood", "2024")]
    with pytest.raises(KeyError):
        feeds.get_source("none")


def test_feed_cache(spark, tmp_path):
    client = feeds.HttpClient(str(tmp_path), offline=True)
    reports_, errors = feed_source.collect(spark, client, ("feodo_iocs", "nowhere"))
    assert reports_.count() == 0 and {e["feed"] for e in errors.collect()} == {"feodo_iocs", "nowhere"}


def test_small_targets(spark):
    r = random.Random(7)
    grid = [[r.gauss(10, 1) for _ in range(40)] for _ in range(40)]
    for at in ((5, 6), (20, 30)):
        grid[at[0]][at[1]] = 60.0
    frames = spark.createDataFrame([("f", grid), ("blank", [[0.0] * 20] * 20), ("none", None)], "frame_id string, grid array<array<double>>")
    got = {(t["row"], t["col"]) for t in smalltarget.detect_targets(frames).collect() if t["frame_id"] == "f"}
    assert {(5.0, 6.0), (20.0, 30.0)} <= got
    assert {m["frame_id"] for m in smalltarget.media_reports(frames).collect()} == {"f", "blank", "none"}


def test_scalars(spark):
    import uuid

    row = spark.createDataFrame([("a:b", "2024-01-01T05:00:00+02:00", "Foo--Bar_baz, (x)")], "n string, t string, name string").select(
        scalars.uuid5(sinks.STIX_NAMESPACE, F.col("n")).alias("u"), scalars.utc_hour(scalars.parse_ts(F.col("t"))).alias("h"), scalars.utc_weekday(scalars.parse_ts(F.col("t"))).alias("d"),
        scalars.norm_name(F.col("name")).alias("m"), scalars.parse_ts(F.lit("20240101")).isNull().alias("bad"), scalars.parse_ts(F.lit("2024-01-01")).isNotNull().alias("day"),
    ).first()
    assert row["u"] == str(uuid.uuid5(uuid.UUID(sinks.STIX_NAMESPACE), "a:b")) and row["h"] == 3 and row["d"] == "Mon" and row["m"] == "foo bar baz x" and row["day"]


def test_streaming(spark, tmp_path):
    from weftline.streaming.zones import stream_alerts, stream_dwell

    o = obs(spark, [{"entity": "e", "lat": 1.0, "lon": 1.0, "timestamp": f"2024-01-0{d}T10:00:00Z"} for d in (1, 1, 2, 9)])
    o.write.parquet(str(tmp_path / "in"))
    z = spark.createDataFrame([("z", 1.0, 1.0, 5.0, "keep-out", "", [])], geofence.ZONE_SCHEMA)
    s = spark.readStream.schema(o.schema).parquet(str(tmp_path / "in"))
    q = stream_dwell(stream_alerts(s, z)).writeStream.outputMode("complete").format("memory").queryName("dwell").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert [r["points"] for r in spark.table("dwell").collect()] == [2]


def test_addresses_against_the_standard_library(spark):
    import ipaddress

    r = random.Random(11)
    tokens = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::ffff:1.2.3.4", "1::2::3", ":::", ":1", "1:", "fe80::1%eth0", "12345::", "g::1", "", "x", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.456", "1.2.3.4:80"]
    tokens += [":".join(r.choice(["", "0", "a1", "ffff", "1.2.3.4", "12345"]) for _ in range(r.randint(1, 9))) for _ in range(400)]

    def valid(t):
        try:
            return bool(ipaddress.ip_address(t))
        except ValueError:
            return False

    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", feeds.is_ip(F.col("t")).alias("ip")).collect()
    assert {g["t"]: g["ip"] for g in got} == {t: valid(t) for t in tokens}


def test_block_list_limit_and_feed_depth(spark):
    content = "\n".join(f"10.0.{k // 250}.{k % 250}" for k in range(130))
    rss = "<r><item><title>A</title><more><item><title>B</title><link>l</link></item></more><description>x<b>y</b>z</description></item><item/></r>"
    p = spark.createDataFrame([(content, rss, "<broken")], "c string, r string, bad string").select(
        F.size(feeds.ioc_lines(F.col("c"), F.lit("s"))).alias("n"), F.size(feeds.ioc_lines(F.col("c"), F.lit("s"), 1000)).alias("all"), feeds.rss(F.col("r")).alias("r"), feeds.rss(F.col("bad")).alias("bad"),
    ).first()
    assert (p["n"], p["all"], p["bad"]) == (100, 130, [])
    assert [(i["key"], i["text"]) for i in p["r"]] == [("A", "A. x"), ("l", "B. "), ("", ". ")]


def test_gazetteer_terms_of_any_shape(spark):
    text = "The U.S. Navy and u.s. navy, not us navy; C++ and X-ray, x-rays, ÉLAN élan, 東京 tower; (alpha) alpha-beta alpha."
    gazetteer = {"t": {"U.S. Navy": [], "X-ray": ["x"], "élan": [], "東京": [], "alpha": ["alpha-beta", "(alpha)"], "++": []}}
    r = spark.createDataFrame([(0, "a", text), (1, "b", None), (2, "c", "")], "report_ord long, id string, text string")
    got = sorted((m["canonical"], m["value"], m["start"]) for m in extract.extract_gazetteer(r, gazetteer).collect())
    import re

    want = sorted(
        (name, m[0], m.start()) for names in gazetteer.values() for name, aliases in names.items() for t in (name, *aliases) if re.search(r"\w", t)
        for m in re.finditer(rf"\b{re.escape(t.lower())}\b", text, re.I)
    )
    assert got == want and extract.extract_gazetteer(r, {}).count() == 0


def test_pairs_of_large_reports_in_blocks(spark):
    m = spark.createDataFrame([(f"r{k % 3}", "t", f"e{k % 17}") for k in range(60)], "source_ref string, type string, canonical string")
    rows = lambda block: sorted((e["src"], e["dst"], e["weight"], tuple(e["sources"])) for e in graph.comention_edges(m, block).collect())
    assert rows(4) == rows(256) and len(rows(4)) == 17 * 16 // 2


def test_term_frequencies(spark):
    from weftline.operators import retrieve

    r = spark.createDataFrame([(0, "a", "b a b, c b"), (1, "b", ""), (2, "c", None)], "report_ord long, id string, text string")
    assert sorted((p["id"], p["term"], p["tf"]) for p in retrieve.postings(r).collect()) == [("a", "a", 0.2), ("a", "b", 0.6), ("a", "c", 0.2)]


def test_scenario_file(spark, tmp_path):
    from weftline.plans.scenario import run_scenario
    from weftline.sources.scenario import load_gazetteer

    at = tmp_path / "s.json"
    at.write_text(json.dumps({
        "name": "n", "sources": {"sigint": [{"emitter_id": "E1", "content": "hidden", "lat": 1.0, "lon": 2.0}], "osint": [{"title": "t", "entity": "Gull"}], "unknown": [{"a": 1}]},
        "zones": [{"name": "z", "lat": 1.0, "lon": 2.0}],
    }))
    f = run_scenario(spark, str(at))
    assert f.name == "n" and "hidden" not in str(f.observations.collect()) and f.observations.count() == 2
    z = f.zones.first()
    assert (z["name"], z["radius_km"], z["kind"]) == ("z", 1.0, "area-of-interest") and f.zone_alerts.count() == 1
    g = tmp_path / "g.json"
    g.write_text(json.dumps({"org": {"A": ["b"]}}))
    assert load_gazetteer(spark, str(g)) == {"org": {"A": ["b"]}}
    rows = sinks.fusion_json(f.observations, f.entities).collect()
    assert [r["part"] for r in sorted(rows, key=lambda r: r["part"])] == ["entities"] * f.entities.count() + ["observations"] * 2


def test_evaluations_of_small_gold(spark):
    from weftline.plans import evaluate

    for run, want in ((evaluate.core_evaluation, evaluate.CORE_EXPECTED), (evaluate.fusion_evaluation, evaluate.FUSION_EXPECTED)):
        assert {r["metric"]: r["value"] for r in run(spark).collect()} == want


def test_names_meet_by_rare_tokens_only(spark, monkeypatch):
    """Names of three tokens that differ in one cannot be similar, and
    do not meet by the two that all of them have."""
    monkeypatch.setattr(entities, "jaccard", lambda a, b: F.lit(1.0))  # whatever meets is told
    names = [("v", f"taskgroup unit {k:05}") for k in range(300)] + [("v", "unit 00007")]
    got = {(x["a"], x["b"]) for x in entities.similar_names(spark.createDataFrame(names, "etype string, name string")).collect()}
    assert got == {("taskgroup unit 00007", "unit 00007")}


def test_held_names_of_every_length(spark):
    random.seed(5)
    names = {"".join(random.choice("ab ") for _ in range(random.choice([1, 2, 3, 4, 5, 8, 9, 17]))).strip() for _ in range(150)} - {""}
    got = {(x["x"], x["y"]) for x in entities._held(spark.createDataFrame([("v", n) for n in names], "etype string, name string")).collect()}
    assert got == {(x, y) for x in names for y in names if x != y and x in y}


def test_clusters_link_names_not_observations(spark, monkeypatch):
    """What is iterated grows with the names; an observation without a
    type is alone but for its identifiers."""
    seen = []
    monkeypatch.setattr(entities, "components", lambda nodes, edges: seen.append(nodes.count()) or components(nodes, edges))
    rows = [{"entity": f"Boat {k % 4}", "text": str(k)} for k in range(80)]
    rows += [{"entity": "Boat 0", "entity_type": None}, {"entity": "Boat 0", "entity_type": None, "attributes": {"imo": "7"}}, {"entity": "Other", "attributes": {"imo": "7"}}, {"entity": "..."}, {"entity": "-"}]
    got = {r["id"]: r["root"] for r in entities.cluster(obs(spark, rows).drop("ts")).collect()}
    assert seen == [4 + 2 + 1 + 1]  # names, two without a type, Other, the empty name
    assert got == {f"obs--{k:03}": f"obs--{k % 4:03}" for k in range(80)} | {"obs--080": "obs--080", "obs--081": "obs--081", "obs--082": "obs--081", "obs--083": "obs--083", "obs--084": "obs--083"}


def test_roots_are_told_by_name(spark):
    """Roots are kept for what observations call entities, not for each
    observation, and entities are made of rooted observations without a join."""
    rows = [{"entity": ("Boat 1", "boat-1", "MV Boat 1")[k % 3], "text": str(k), "attributes": {"imo": str(k % 2)}} for k in range(60)]
    rows += [{"entity": "Boat 1", "entity_type": None, "attributes": {"imo": "9"}}, {"entity": "Far", "attributes": {"imo": "9"}}, {"entity": "", "text": "none"}]
    o = obs(spark, rows).drop("ts")
    roots = entities.name_roots(o)
    assert roots.count() == 3 + 1 + 1  # as written, without a type, Far
    own = entities.rooted(o, roots)
    assert {r["id"]: r["root"] for r in own.collect()} == {r["id"]: r["root"] for r in entities.cluster(o).collect()}
    assert own.count() == 62 and own.columns == [*o.columns, "root"]
    e = entities.resolve_entities(own)
    told = lambda df: {r["root"]: (r["canonical"], r["observation_ids"], r["identifiers"], r["n_obs"]) for r in df.collect()}
    assert told(e) == told(entities.resolve_entities(o, entities.cluster(o)))


def test_targets_apart_and_exact_noise(spark):
    """pixels that are hit are told one by one if asked for, and signal
    to noise beside a very bright pixel keeps its places."""
    import numpy as np

    r = np.random.default_rng(1)
    grid = r.normal(0, 1e-3, (12, 12)) + 7
    grid[2, 2], grid[9, 9], grid[9, 10] = 1e6, 9.0, 9.0
    frames = spark.createDataFrame([(1, grid.tolist()), (2, np.ones((3, 3)).tolist())], "frame_id long, grid array<array<double>>")
    whole = smalltarget.detect_targets(frames).collect()
    assert sorted((x["rank"], x["size"]) for x in whole) == [(0, 1), (1, 2)]
    apart = smalltarget.detect_targets(frames, apart=True).collect()
    assert sorted((x["row"], x["col"], x["rank"], x["size"]) for x in apart) == [(2, 2, 0, 1), (9, 9, 0, 1), (9, 10, 0, 1)]
    for x in apart:
        at = int(x["row"]), int(x["col"])
        ring = [grid[i, j] for i in range(12) for j in range(12) if 2 <= max(abs(i - at[0]), abs(j - at[1])) <= 5]
        assert x["peak_snr"] == round((grid[at] - np.mean(ring)) / np.std(ring), 2)
    assert len({m["id"] for m in smalltarget.media_reports(frames, apart=True).collect()}) == 4


def test_terms_across_separators_as_sql_has_them(spark, tmp_path):
    """a term's words may stand in two sentences or lines."""
    import duckdb

    from weftline.plans import queries

    texts = ["Then hereat. Ou was there", "hereat ou, hereat\nou hereat -- OU", "hereatou hereat_ou hereat x ou", "Éeau onst;thand thnd", None]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    turns = spark.createDataFrame([(1, 1, "user", "hereat ou")], "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    for name, df in (("documents", docs), ("conversations", turns)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("extract_gazetteer", "mentions_with_gazetteer", "gazetteer_positions"):
        df = queries.QUERIES[name](spark, str(tmp_path))
        cursor = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in df.columns)} from ({queries.ORACLE_SQL[name]})")
        assert sorted(map(tuple, df.collect())) == sorted(cursor.fetchall()), name
    pairs = extract.extract_gazetteer(docs.limit(0).union(spark.createDataFrame([(9, "a, a a. a a", "", "", 0)], docs.schema)).select(F.lit("r").alias("id"), F.lit(1).alias("report_ord"), "text"), {"x": {"A-a": []}}, loose=True)
    assert sorted((m["start"], m["end"]) for m in pairs.collect()) == [(0, 4), (5, 9)]


def test_reports_of_one_id_and_two_keys_are_two(spark, tmp_path):
    """sha1 of k743767 and of k779473 begin with the same ten digits."""
    import duckdb

    from weftline.plans import queries

    e = [(3 * k + j, f"2024-01-02 00:00:0{j}", k % 7, t) for k in (743767, 779473) for j in (0, 1) for t in ("click", "view")] + [(3, "2024-01-03 00:00:00", 1, "purchase")]
    spark.createDataFrame(e, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp_ntz("ts")).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"select id, timestamp, source, text, error from ({queries.ORACLE_SQL['feed_ingest']})").fetchall()
    assert len(want) == 5 and sorted(map(str, want)) == sorted(str(tuple(r)) for r in queries.QUERIES["feed_ingest"](spark, str(tmp_path)).collect())


def test_indicator_places_of_repeated_and_enclosed_values(spark):
    """Values that stand more than once, also inside what is no match, are placed as a scan places them."""
    texts = [
        "1.2.3.4 and 1.2.3.4", "x1.2.3.4 then 1.2.3.4", "991.2.3.4.5 1.2.3.4", "a@b.co,a@b.co a@b.co.", "+a.b-c@d-e.f_g. @x.y z@ é.ü@ö.de", "😀 1.2.3.4 😀 é@b.co", "1.1.1.1.1.1.1.1",
        "addr-a addr-ab addr-a", "https://x.y https://x.y/z", "1.2345, 6.7890, 1.2345, 6.7890", "a" * 64 + " " + "A" * 64, "", "none",
    ]
    r = spark.createDataFrame([(str(k), k, t) for k, t in enumerate(texts)], "id string, report_ord long, text string")
    got = sorted((int(m["source_ref"]), m["type"], m["start"], m["end"]) for m in extract.extract_indicators(r).collect())
    want = [(k, kind, m.start(), m.end()) for k, t in enumerate(texts) for kind, rx in extract.INDICATORS.items() for m in re.finditer(rx.replace("(?U)", ""), t)]
    assert got == sorted(want)


def test_correlate_shuffles_pairs_of_its_node_only(spark):
    """the sums over pairs are asked for the pivot; it may be either end, and may be missing."""
    r = spark.createDataFrame([("r1", 1, "a@x.co 1.2.3.4 z@x.co"), ("r2", 2, "a@x.co z@x.co"), ("r3", 3, "1.2.3.4 q@x.co")], "id string, report_ord long, text string")
    m = extract.extract_indicators(r)
    nodes, edges = graph.mention_nodes(m), graph.comention_edges(m)
    told = lambda value: sorted((x["value"], x["weight"], sorted(x["shared"])) for x in graph.correlate(nodes, edges, value).collect())
    assert told("Z@x.co") == [("1.2.3.4", 1.0, ["r1"]), ("a@x.co", 2.0, ["r1", "r2"])]
    assert told("1.2.3.4") == [("a@x.co", 1.0, ["r1"]), ("q@x.co", 1.0, ["r3"]), ("z@x.co", 1.0, ["r1"])]
    assert told("nobody") == []
    plan = graph.correlate(nodes, edges, "z@x.co")._jdf.queryExecution().optimizedPlan().toString()
    pivot = nodes.where("value = 'z@x.co'").first()["id"]
    assert plan.rindex(pivot) > plan.index("collect_list(source_ref")  # the filter is below the sum


def test_one_product_writes_no_rooted_observations(spark, monkeypatch):
    """A product that takes the observations with their root
    once neither writes them nor makes columns that it has no use for."""
    from weftline.plans import scenario

    written = []
    monkeypatch.setattr(scenario, "stage", lambda df, name: written.append(name) or df)
    o = obs(spark, [{"entity": ("Boat 1", "boat-1")[k % 2], "text": str(k), "timestamp": f"2024-01-0{1 + k % 7}T0{k % 10}:00:00Z"} for k in range(40)]).drop("ts")
    f = Fusion("once", o)
    hours = tracks.hour_histogram(f.once.entity_obs)
    assert written == [] and f.once.name_roots is f.name_roots
    assert "sha2" not in hours._jdf.queryExecution().optimizedPlan().toString()
    told = lambda df: sorted((r["root"], r["hour"], r["n"]) for r in df.collect())
    assert told(hours) == told(tracks.hour_histogram(f.entity_obs)) and written == ["entity-obs"]
    assert sorted(f.once.legs.collect()) == sorted(f.legs.collect())


def test_places_are_written_as_formatting_has_them(spark):
    """Coordinates in observation ids, without the formatter where six places are all."""
    x = [None, 0.0, -0.0, 1e-7, -4e-7, 1e-6, 0.000001, -0.1, 30.25, -18.999999, 179.123456, 0.1234565, -0.12345649, 60.7644, 999999.999999, 1e6, 1e9 + 0.5, 1e300, float("nan"), float("inf"), -float("inf")]
    x += [round(random.Random(k).uniform(-180, 180), 6) for k in range(500)] + [random.Random(k).uniform(-180, 180) for k in range(500)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = df.select(normalize._place(F.col("x")).alias("got"), F.coalesce(F.format_string("%.6f", F.col("x")), F.lit("")).alias("want"), "x").collect()
    assert [r["got"] for r in got if r["x"] is not None] == [r["want"] for r in got if r["x"] is not None] and got[0]["got"] == ""


@pytest.mark.parametrize("name", ["graph_stix_objects", "fusion_stix_objects"])
def test_objects_are_not_made_to_test_their_refs(spark, name):
    """no object is put together inside a filter, once more than it is told; and
    of relationships there is one source in the plan, not one for each use of names."""
    from weftline.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if re.match(r"[ :|+-]*Filter", line) and ("to_json" in line.lower() or "structstojson" in line.lower() or "get_json_object" in line)]
    assert plan.count("Generate inline(") <= 1
