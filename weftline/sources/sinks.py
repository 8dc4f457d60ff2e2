"""Products as JSON, CSV, STIX-shaped objects, text and HTML.

Tables stay tables: a STIX bundle is a table of objects as JSON, written with
write.text.  Only views that people read (text, HTML) are put together on the
driver, from a bounded number of rows.
"""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalars import uuid5

# fixed values
STIX_NAMESPACE = "00abedb4aa424466938eaeb5ae0d2ce6"  # a namespace of our own
STIX_TIME = "2024-01-01T00:00:00.000Z"
STIX_TYPES = {"ipv4": ("ipv4-addr", "value"), "email": ("email-addr", "value"), "url": ("url", "value"), "sha256": ("file", "hashes.SHA-256"), "crypto-address": ("x-crypto-address", "value")}
SUSPECT_WORDS = ("suspect", "hostile-report", "illicit", "smuggl")
OBSERVATION_CSV = ("id", "discipline", "source", "timestamp", "entity", "entity_type", "lat", "lon", "reliability", "credibility", "text")


def stix_id(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{kind}--"), uuid5(STIX_NAMESPACE, F.concat(F.lit(f"{kind}:"), name)))


def observation_csv(observations: DataFrame) -> DataFrame:
    """Columns and texts as the CSV has them; absent values are ''."""
    flat = observations.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "))
    return flat.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in OBSERVATION_CSV])


def entity_csv(entities: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(c, "|").alias(c)
    return entities.select(F.col("entity_id").alias("id"), "canonical", F.col("etype").alias("entity_type"), F.size("disciplines").alias("discipline_count"), F.size("observation_ids").alias("observation_count"), joined("disciplines"), joined("sources"), joined("aliases"))


def write_csv(table: DataFrame, path: str) -> None:
    table.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def affiliation(aliases: Column, canonical: Column) -> Column:
    """'suspect' only where reporting says so itself."""
    hints = F.lower(F.concat_ws(" ", aliases, canonical))
    return F.when(hints.rlike("|".join(SUSPECT_WORDS)), "suspect").otherwise("unknown")


def symbol_agnostic(entities: DataFrame) -> DataFrame:
    """Descriptive labels only: no symbol codes."""
    return entities.select(F.col("entity_id").alias("id"), F.col("canonical").alias("label"), F.col("etype").alias("entity_type"), affiliation(F.col("aliases"), F.col("canonical")).alias("affiliation"), "aliases", "disciplines", "identifiers")


def _identity(df: DataFrame, name: str, created: str) -> DataFrame:
    one = df.sparkSession.range(1)
    o = F.struct(F.lit("identity").alias("type"), F.lit("2.1").alias("spec_version"), stix_id("identity", F.lit(name)).alias("id"), F.lit(created).alias("created"), F.lit(created).alias("modified"), F.lit(name).alias("name"), F.lit("system").alias("identity_class"))
    return one.select(F.lit("identity").alias("type"), stix_id("identity", F.lit(name)).alias("id"), F.to_json(o).alias("object"))


def _objects(df: DataFrame, kind: str, id_: Column, identity: str, created: str, *fields: Column) -> DataFrame:
    head = [F.lit(kind).alias("type"), F.lit("2.1").alias("spec_version"), id_.alias("id"), F.lit(created).alias("created"), F.lit(created).alias("modified"), stix_id("identity", F.lit(identity)).alias("created_by_ref")]
    return df.select(F.lit(kind).alias("type"), id_.alias("id"), F.to_json(F.struct(*head, *fields)).alias("object"))


def graph_stix(nodes: DataFrame, edges: DataFrame, identity: str = "Weftline", created: str = STIX_TIME) -> DataFrame:
    """type, id, object: identity, an indicator for each node, a relationship
    for each edge.  Quotes in a value are escaped in its pattern."""
    name = lambda kind, value: F.concat(kind, F.lit(":"), F.lower(value))
    kind, prop = F.lit("x-entity"), F.lit("value")
    for t, (k, p) in STIX_TYPES.items():
        kind, prop = F.when(F.col("type") == t, F.lit(k)).otherwise(kind), F.when(F.col("type") == t, F.lit(p)).otherwise(prop)
    quoted = F.replace(F.replace(F.col("value"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    indicators = _objects(
        nodes, "indicator", stix_id("indicator", name(F.col("type"), F.col("value"))), identity, created,
        F.concat("type", F.lit(": "), "value").alias("name"), F.lit("stix").alias("pattern_type"), F.concat(F.lit("["), kind, F.lit(":"), prop, F.lit(" = '"), quoted, F.lit("']")).alias("pattern"),
        F.lit(created).alias("valid_from"), F.array(F.lit("observed-data")).alias("labels"), F.transform("sources", lambda s: F.struct(F.lit("report").alias("source_name"), s.alias("external_id"))).alias("external_references"),
    )
    ref = lambda end: nodes.select(F.col("id").alias(end), stix_id("indicator", name(F.col("type"), F.col("value"))).alias(f"{end}_ref"))
    ends = edges.join(ref("src"), "src").join(ref("dst"), "dst")
    related = _objects(ends, "relationship", stix_id("relationship", F.concat("src", "relation", "dst")), identity, created, F.lit("related-to").alias("relationship_type"), F.col("src_ref").alias("source_ref"), F.col("dst_ref").alias("target_ref"))
    return _identity(nodes, identity, created).unionByName(indicators).unionByName(related)


def fusion_stix(observations: DataFrame, entities: DataFrame, identity: str = "Weftline Fusion", created: str = STIX_TIME) -> DataFrame:
    """1 + observations + entities + the observations of each entity objects."""
    when = F.coalesce(F.nullif("timestamp", F.lit("")), F.lit(created))
    seen = _objects(
        observations, "observed-data", stix_id("observed-data", F.col("id")), identity, created, when.alias("first_observed"), when.alias("last_observed"), F.lit(1).alias("number_observed"),
        F.array(F.concat(F.lit("discipline:"), "discipline"), F.concat(F.lit("source:"), "source")).alias("labels"), F.col("text").alias("x_text"),
        F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.array("lat", "lon")).alias("x_geo"), F.col("reliability").alias("x_reliability"), F.col("credibility").alias("x_credibility"),
    )
    # entities of one type and name share entity_id, so objects are named by the root
    eid = stix_id("x-entity", F.col("root"))
    things = _objects(entities, "x-entity", eid, identity, created, F.col("canonical").alias("name"), F.col("etype").alias("entity_type"), F.col("aliases"), F.col("disciplines").alias("x_disciplines"))
    links = entities.select("root", F.explode("observation_ids").alias("oid"))
    derived = _objects(links, "relationship", stix_id("relationship", F.concat(eid, F.lit("sighting"), F.col("oid"))), identity, created, F.lit("derived-from").alias("relationship_type"), eid.alias("source_ref"), stix_id("observed-data", F.col("oid")).alias("target_ref"))
    return _identity(observations, identity, created).unionByName(seen).unionByName(things).unionByName(derived)


def as_json(table: DataFrame) -> DataFrame:
    """object: each row as JSON."""
    return table.select(F.to_json(F.struct(*table.columns)).alias("object"))


def _parts(**tables: DataFrame | None) -> DataFrame:
    """object, part: the rows of all tables as JSON, with their table's name."""
    out = None
    for part, df in tables.items():
        if df is not None:
            rows = as_json(df).withColumn("part", F.lit(part))
            out = rows if out is None else out.unionByName(rows)
    return out


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _parts(entities=nodes, edges=edges)


def fusion_json(observations: DataFrame, entities: DataFrame | None = None, assessment: DataFrame | None = None) -> DataFrame:
    """A fusion result as JSON rows; entities and assessment may be left out."""
    return _parts(observations=observations, entities=entities, assessment=assessment)


def project(points: DataFrame, width: float = 680.0, height: float = 360.0, pad: float = 28.0) -> DataFrame:
    """x, y of points (lat, lon) on a map of that size, to one place."""
    ends = points.agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])  # one row
    p = points.crossJoin(F.broadcast(ends))
    span = lambda c: F.when(F.col(f"max_{c}") > F.col(f"min_{c}"), F.col(f"max_{c}") - F.col(f"min_{c}")).otherwise(1.0)
    x = pad + (F.col("lon") - F.col("min_lon")) / span("lon") * (width - 2 * pad)
    y = pad + (F.col("max_lat") - F.col("lat")) / span("lat") * (height - 2 * pad)
    return p.select(*points.columns, F.round(x, 1).alias("x"), F.round(y, 1).alias("y"))


def picture_text(fusion) -> str:
    """A summary of a fusion result in plain text."""
    c = fusion.counts.first()
    lines = [
        f"Common picture: {fusion.name}", "For awareness only; every item goes back to cited observations.", "",
        f"{c['observations']} observations, {c['entities']} entities, {c['disciplines']} disciplines, {c['sources']} sources",
        f"{c['tracks']} tracks, {c['anomalies']} anomalies, {c['contradictions']} contradictions, {c['deconfliction_flags']} conflicts of identity, {c['zone_alerts']} zone alerts", "", "Entities by corroboration:",
    ]
    lines += [f"  {r['band']:<13} {r['score']:.2f} {r['canonical']} ({', '.join(r['disciplines'])})" for r in fusion.corroboration.take(8)]
    lines += ["Contradictions:", *[f"  {r['from_id']} to {r['to_id']}: {r['kmh']} km/h" for r in fusion.spatial_contradictions.take(6)]]
    lines += ["Zone alerts:", *[f"  {r['status']}: {r['entity']} at {r['zone']}, {r['distance_km']} km" for r in fusion.zone_alerts.take(6)]]
    return "\n".join(lines)


def dashboard_html(fusion, most: int = 20, most_points: int = 2000) -> str:
    """One page without scripts: counts, a map, entities, alerts.  It shows no
    more than a page can: `most` rows of a table, most_points on the map."""
    e = html.escape

    def table(title: str, rows: list, *columns: str) -> str:
        head = "".join(f"<th>{e(c)}</th>" for c in columns)
        body = "".join("<tr>" + "".join(f"<td>{e(str(r[c]))}</td>" for c in columns) + "</tr>" for r in rows)
        return f"<h2>{e(title)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"

    points = project(fusion.observations.where("lat is not null and lon is not null").select("id", "discipline", "entity", "lat", "lon").orderBy("id").limit(most_points)).collect()
    dots = "".join(f'<circle cx="{p["x"]}" cy="{p["y"]}" r="3"><title>{e(p["discipline"])} {e(p["entity"])}</title></circle>' for p in points)
    c = fusion.counts.first().asDict()
    parts = [
        table("Counts", [c], *c),
        f'<h2>Map</h2><svg viewBox="0 0 680 360" role="img">{dots}</svg>',
        table("Entities", fusion.corroboration.take(most), "canonical", "band", "score"),
        table("Zone alerts", fusion.zone_alerts.take(most), "zone", "entity", "status", "distance_km", "severity"),
        table("Contradictions", fusion.spatial_contradictions.take(most), "from_id", "to_id", "kmh"),
        table("Timeline", fusion.timeline.take(most), "timestamp", "discipline", "entity", "text"),
    ]
    style = "body{font:14px sans-serif;margin:2em}td,th{text-align:left;padding:2px 8px;border-bottom:1px solid #ccc}svg{border:1px solid #999;width:100%}"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{e(fusion.name)}</title><style>{style}</style></head><body><h1>{e(fusion.name)}</h1>{''.join(parts)}</body></html>"


def answer_text(answer: dict) -> str:
    lines = [f"Query: {answer['query']}", f"Answer: {answer['answer'] or '(nothing relevant was reported)'}", f"Cited: {', '.join(answer['citations']) or 'none'}"]
    if answer["pivot_entity"]:
        lines.append(f"Pivot: {answer['pivot_entity']['type']} {answer['pivot_entity']['value']}")
    lines += [f"  {c['type']} {c['value']}: weight {c['weight']:g} ({', '.join(c['shared_reports'])})" for c in answer["correlated"][:10]]
    return "\n".join([*lines, "Steps:", *[f"  {s['tool']}: {s['note']}" for s in answer["trace"]]])
