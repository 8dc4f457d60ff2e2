"""Commands over the operators: python -m weftline.cli COMMAND."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import graph, smalltarget
from weftline.operators.geofence import zones_frame
from weftline.plans.answer import Answers
from weftline.plans.scenario import Fusion, run_scenario
from weftline.sources import feed_source, feeds, sinks
from weftline.sources.scenario import load_gazetteer, load_reports

DEMO_REPORTS = [
    ("R-1", "2024-03-01T06:00:00Z", "harbour log", "Grey Heron left the north quay at dawn. Contact 198.51.100.7 was active nearby."),
    ("R-2", "2024-03-01T09:30:00Z", "port office", "An agent of Lantern Shipping paid from wallet addr-9f3kd2 and wrote from desk@lantern.example.com."),
    ("R-3", "2024-03-02T11:00:00Z", "analyst", "The wallet addr-9f3kd2 was used again near 36.1234, -5.4321 while Grey Heron waited offshore."),
]
DEMO_GAZETTEER = {"vessel": {"Grey Heron": ["the Heron"]}, "org": {"Lantern Shipping": ["Lantern"]}}
DEMO_SCENARIO = {
    "name": "harbour watch",
    "sources": {
        "osint": [{"source": "news", "timestamp": "2024-03-01T08:00:00Z", "title": "Grey Heron sighted off the point", "entity": "Grey Heron", "entity_type": "vessel", "lat": 36.10, "lon": -5.40}],
        "geoint": [
            {"timestamp": "2024-03-01T09:00:00Z", "entity": "MV Grey Heron", "entity_type": "vessel", "lat": 36.12, "lon": -5.41, "speed_kn": 8, "track_id": "T-7"},
            {"timestamp": "2024-03-01T12:00:00Z", "entity": "MV Grey Heron", "entity_type": "vessel", "lat": 36.15, "lon": -5.45, "track_id": "T-7"},
        ],
        "sigint": [{"timestamp": "2024-03-01T10:00:00Z", "emitter_id": "E-12", "freq_band": "X", "lat": 36.13, "lon": -5.43, "content": "never read"}],
    },
    "zones": [{"name": "quay", "lat": 36.12, "lon": -5.42, "radius_km": 5.0, "kind": "keep-out", "watch_entity_types": ["vessel"]}],
}


def _reports(spark: SparkSession, path: str | None) -> DataFrame:
    if path:
        return load_reports(spark, path)
    rows = [(k, *r) for k, r in enumerate(DEMO_REPORTS)]
    return spark.createDataFrame(rows, "report_ord long, id string, timestamp string, source string, text string")


def _answers(spark: SparkSession, args) -> Answers:
    gazetteer = load_gazetteer(spark, args.gazetteer) if args.gazetteer else None if args.reports else DEMO_GAZETTEER
    return Answers(_reports(spark, args.reports), gazetteer)


def _fusion(spark: SparkSession, path: str | None) -> Fusion:
    if path:
        return run_scenario(spark, path)
    sources = {d: spark.createDataFrame(rows) for d, rows in DEMO_SCENARIO["sources"].items()}
    zones = zones_frame(spark.createDataFrame(DEMO_SCENARIO["zones"]))
    return run_scenario(spark, (DEMO_SCENARIO["name"], {d: r.drop("content") for d, r in sources.items()}, zones))


def _print_rows(df: DataFrame) -> None:
    """All rows as JSON lines, a partition at a time; objects are JSON already."""
    for r in (df if df.columns == ["object"] else sinks.as_json(df)).toLocalIterator():
        print(r["object"])


def cmd_query(spark, args):
    got = _answers(spark, args).answer(args.q, args.k)
    print(json.dumps(got, indent=2, default=str) if args.json else sinks.answer_text(got))


def cmd_demo(spark, args):
    a = _answers(spark, args)
    print(sinks.answer_text(a.answer(args.query)))
    if args.stix:
        _print_rows(sinks.graph_stix(a.nodes, a.edges).select("object"))


def cmd_extract(spark, args):
    _print_rows(_answers(spark, args).mentions.orderBy("seq"))


def cmd_correlate(spark, args):
    a = _answers(spark, args)
    _print_rows(graph.correlate(a.nodes, a.edges, args.value, args.type))


def cmd_graph(spark, args):
    a = _answers(spark, args)
    _print_rows(sinks.graph_stix(a.nodes, a.edges).select("object") if args.stix else sinks.graph_json(a.nodes, a.edges))


def cmd_sources_list(spark, args):
    _print_rows(feeds.list_sources(spark, args.category))


def cmd_sources_stats(spark, args):
    _print_rows(feeds.catalog_stats(spark).orderBy("category"))


def _ingest(spark, args):
    client = feeds.HttpClient(args.cache, args.offline)
    names = tuple(args.feeds.split(",")) if getattr(args, "feeds", None) else None
    return feed_source.collect(spark, client, names, args.limit)


def cmd_sources_ingest(spark, args):
    reports, errors = _ingest(spark, args)
    _print_rows(reports)
    _print_rows(errors)


def cmd_demo_live(spark, args):
    reports, errors = _ingest(spark, args)
    numbered = reports.withColumn("report_ord", F.col("feed_ord") * 1_000_000 + F.col("item_ord"))
    print(sinks.answer_text(Answers(numbered).answer(args.query, args.k)))
    _print_rows(errors)


def cmd_analyze_image(spark, args):
    grid = [[float((r * 7 + c * 3) % 5) for c in range(40)] for r in range(40)]
    for r, c in ((8, 9), (25, 30)):
        grid[r][c] = 60.0
    frames = spark.createDataFrame([("demo", grid)], "frame_id string, grid array<array<double>>")
    _print_rows(smalltarget.detect_targets(frames, args.k))
    _print_rows(smalltarget.media_reports(frames, k=args.k))


def cmd_fuse(spark, args):
    f = _fusion(spark, args.scenario)
    print(sinks.picture_text(f))
    if args.html:
        Path(args.html).write_text(sinks.dashboard_html(f), encoding="utf-8")


def cmd_dossier(spark, args):
    try:
        _print_rows(_fusion(spark, args.scenario).dossier(args.entity))
    except KeyError:
        print(f"no entity matches {args.entity}", file=sys.stderr)
        raise SystemExit(1) from None


def cmd_export(spark, args):
    f = _fusion(spark, args.scenario)
    tables = {
        "json": lambda: sinks.fusion_json(f.observations, f.entities, f.corroboration), "csv": lambda: sinks.observation_csv(f.observations), "entities-csv": lambda: sinks.entity_csv(f.entities),
        "stix": lambda: sinks.fusion_stix(f.observations, f.entities).select("object"), "symbols": lambda: sinks.as_json(sinks.symbol_agnostic(f.entities)),
    }
    table = tables[args.format]()
    if not args.out:
        _print_rows(table)
    elif args.format.endswith("csv"):
        sinks.write_csv(table, args.out)
    else:
        table.select("object").write.text(args.out)


def cmd_demo_fusion(spark, args):
    f = _fusion(spark, None)
    print(sinks.picture_text(f))
    _print_rows(f.dossiers())
    _print_rows(sinks.symbol_agnostic(f.entities))


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(required=True)

    def command(name, run, *options):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for flag, kind in options:
            c.add_argument(flag, **kind)
        return c

    text, on, need = {"default": None}, {"action": "store_true"}, {"required": True}
    inputs = (("--reports", text), ("--gazetteer", text))
    net = (("--offline", on), ("--cache", {"default": ".feed-cache"}), ("--limit", {"type": int, "default": 50}))
    command("demo", cmd_demo, *inputs, ("--query", {"default": "wallet used by Grey Heron"}), ("--stix", on))
    command("query", cmd_query, *inputs, ("--q", need), ("--k", {"type": int, "default": 3}), ("--json", on))
    command("extract", cmd_extract, *inputs)
    command("correlate", cmd_correlate, *inputs, ("--value", need), ("--type", text))
    command("graph", cmd_graph, *inputs, ("--stix", on))
    command("sources-list", cmd_sources_list, ("--category", text))
    command("sources-stats", cmd_sources_stats)
    command("sources-ingest", cmd_sources_ingest, ("--feeds", text), *net)
    command("analyze-image", cmd_analyze_image, ("--k", {"type": float, "default": 5.0}))
    command("fuse", cmd_fuse, ("--scenario", text), ("--html", text))
    command("dossier", cmd_dossier, ("--scenario", text), ("--entity", need))
    command("export", cmd_export, ("--scenario", text), ("--format", {"choices": ["json", "csv", "entities-csv", "stix", "symbols"], "default": "json"}), ("--out", text))
    command("demo-fusion", cmd_demo_fusion)
    command("demo-live", cmd_demo_live, ("--query", {"default": "conflict"}), ("--k", {"type": int, "default": 3}), *net)
    return p


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    spark = SparkSession.builder.appName("weftline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    args.run(spark, args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
