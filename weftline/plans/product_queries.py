"""Registered queries of adapters, normalizers, exports, answers and
evaluations, each with its SQL; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import corroborate, extract, graph, normalize
from weftline.plans import evaluate
from weftline.plans import queries as Q
from weftline.plans import tables as T
from weftline.plans.answer import Answers
from weftline.sources import feeds, sinks

query = Q.query


def _payloads(df, adapter: str, key: str, content):
    """A payload for each row, in the order of the key."""
    return df.select(F.lit(adapter).alias("source"), F.col(key).cast("int").alias("feed_ord"), F.lit(adapter).alias("adapter"), content.alias("content"))


def _rid(source: str, key: str) -> str:
    return f"'{source}-' || substr(sha1({key}), 1, 10)"


# --- feeds -------------------------------------------------------------------


@query(f"""select {_rid('reliefweb', 's_suppkey::varchar')} as id, strftime(date '2024-01-01' + (s_suppkey % 300)::int, '%Y-%m-%d') as timestamp, 'reliefweb' as source, 'Flood at ' || s_name as text from supplier""")
def feed_reliefweb(spark, sf_dir):
    s = T.table(spark, sf_dir, "supplier")
    created = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 300).cast("int")), "yyyy-MM-dd")
    fields = F.struct(F.concat(F.lit("Flood  at\n"), "s_name").alias("title"), F.struct(created.alias("created")).alias("date"))
    content = F.to_json(F.struct(F.array(F.struct(F.col("s_suppkey").alias("id"), fields.alias("fields"))).alias("data")))
    return feeds.payload_reports(_payloads(s, "reliefweb", "s_suppkey", content)).select("id", "timestamp", "source", "text")


@query(f"""select {_rid('usgs', "'us' || s_suppkey")} as id, (s_suppkey * 1000)::varchar as timestamp, 'usgs' as source, case when s_suppkey % 3 = 0 then 'Quake near ' || s_name else 'M' || s_nationkey || ' ' || s_name end as text from supplier""")
def feed_usgs(spark, sf_dir):
    s = T.table(spark, sf_dir, "supplier")
    properties = F.struct(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Quake near "), "s_name")).alias("title"), (F.col("s_suppkey") * 1000).alias("time"), F.col("s_name").alias("place"), F.col("s_nationkey").alias("mag"))
    content = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("us"), "s_suppkey").alias("id"), properties.alias("properties"))).alias("features")))
    return feeds.payload_reports(_payloads(s, "usgs", "s_suppkey", content)).select("id", "timestamp", "source", "text")


@query(f"""with i as (select c_custkey as k, c_name as name, unnest([1, 2]) as n from customer)
select case when n = 1 then {_rid('rss', "'https://h.example/' || k")} when k % 2 = 0 then {_rid('rss', "'https://alt.example/' || k")} else {_rid('rss', "'Notice ' || name")} end as id,
  case when n = 1 then 'D' || k else 'U' || k end as timestamp, 'rss' as source, case when n = 1 then 'Alert & ' || name || '. bold text ' || k else 'Notice ' || name || '. last' end as text from i""")
def feed_rss(spark, sf_dir):
    """A channel of an RSS item, and an Atom entry at another depth, for each customer."""
    c = T.table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    item = F.concat(F.lit("<item><title>Alert &amp; "), "c_name", F.lit("</title><link>https://h.example/"), k, F.lit("</link><description>&lt;b&gt;bold&lt;/b&gt; text "), k, F.lit("<br/>unheard</description><pubDate>D"), k, F.lit("</pubDate></item>"))
    link = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('<a:link href="https://alt.example/'), k, F.lit('"/>'))).otherwise("")
    entry = F.concat(F.lit("<a:entry><a:title>Notice "), "c_name", F.lit("</a:title>"), link, F.lit("<a:summary>first</a:summary><a:content>last</a:content><a:updated>U"), k, F.lit("</a:updated></a:entry>"))
    content = F.concat(F.lit('<rss xmlns:a="http://www.w3.org/2005/Atom"><channel>'), item, F.lit("<more>"), entry, F.lit("</more></channel></rss>"))
    return feeds.payload_reports(_payloads(c, "rss", "c_custkey", content)).select("id", "timestamp", "source", "text")


@query("""with l as (select s_suppkey as k, unnest(['https://bad.example/' || s_suppkey, '10.0.' || (s_suppkey % 256) || '.7', '2001:db8::' || printf('%x', s_suppkey), '::ffff:10.1.2.' || (s_suppkey % 256)]) as v from supplier)
select 'ioc_lines-' || substr(sha1(v), 1, 10) as id, '' as timestamp, 'ioc_lines' as source, 'Threat indicator ' || v || ' reported by ioc_lines.' as text from l""")
def feed_iocs(spark, sf_dir):
    s = T.table(spark, sf_dir, "supplier")
    k, byte = F.col("s_suppkey").cast("string"), (F.col("s_suppkey") % 256).cast("string")
    content = F.concat(
        F.lit("# comment 10.9.9.9\r\n; 10.8.8.8\n\n 1,\"https://bad.example/"), k, F.lit("\",10.7.7.7\nid;10.0."), byte, F.lit(".7\nid,10.0."), byte, F.lit(".7,80\n999.1.1.1 x 01.2.3.4 "),
        F.lit("1:2:3:4:5:6:7:8:9 2001:db8::"), F.lower(F.hex("s_suppkey")), F.lit(" y\n:::1 1::2::3 12345::1 fe80: ::ffff:10.1.2."), byte, F.lit("\nnothing here\n"),
    )
    return feeds.payload_reports(_payloads(s, "ioc_lines", "s_suppkey", content)).select("id", "timestamp", "source", "text")


@query("""with i as (select e.event_id, (e.user_id % 50)::int as feed_ord, 'u' || (e.event_id % 40) as url, e.event_type || ' (d)' as text from events e),
n as (select *, row_number() over (partition by feed_ord order by event_id) - 1 as item_ord from i)
select 'feed-' || substr(sha1(url), 1, 10) as id, arg_min(text, (feed_ord, item_ord)) as text, min(feed_ord) as feed_ord from n where item_ord < 5 group by url""")
def ingest_first_reports(spark, sf_dir):
    """Fifty feeds: five items of each are taken before repeats go."""
    e = T.table(spark, sf_dir, "events").withColumn("feed_ord", (F.col("user_id") % 50).cast("int"))
    article = F.struct(F.col("event_id"), F.concat(F.lit("u"), F.col("event_id") % 40).alias("url"), F.col("event_type").alias("title"), F.lit("d").alias("domain"))
    p = e.groupBy("feed_ord").agg(F.to_json(F.struct(F.array_sort(F.collect_list(article)).alias("articles"))).alias("content"))
    p = p.select(F.lit("feed").alias("source"), "feed_ord", F.lit("gdelt").alias("adapter"), "content")
    return feeds.first_reports(feeds.payload_reports(p, 5)).select("id", "text", "feed_ord")


# --- normalizers -------------------------------------------------------------

_OBSERVED = ("discipline", "source", "timestamp", "text", "entity", "entity_type", "lat", "lon", "attributes", "reliability", "credibility")


def _observed(discipline: str, records):
    o = normalize.normalize(discipline, records)
    pairs = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return o.withColumn("attributes", F.array_join(pairs, "|")).select(*_OBSERVED)


def _observed_sql(discipline: str, grade: str, rows: str) -> str:
    return f"select '{discipline}' as discipline, source, timestamp, text, entity, entity_type, round(lat, 6) as lat, round(lon, 6) as lon, attributes, '{grade[0]}' as reliability, '{grade[1]}' as credibility from ({rows})"


@query(_observed_sql("OSINT", "C3", "select case when c_custkey % 5 = 0 then 'osint' else 'desk' end as source, '' as timestamp, case when c_custkey % 2 = 0 then trim(c_name) else 'title ' || c_mktsegment end as text, case when c_custkey % 3 = 0 then '' else c_name end as entity, '' as entity_type, c_acctbal / 100 as lat, null::double as lon, 'lang=en|url=http://' || c_custkey as attributes from customer"))
def osint_observations(spark, sf_dir):
    k = F.col("c_custkey")
    c = T.table(spark, sf_dir, "customer").select(
        F.when(k % 5 != 0, "desk").alias("source"), F.when(k % 2 == 0, F.concat(F.lit(" "), "c_name", F.lit(" "))).otherwise("").alias("text"), F.concat(F.lit("title "), "c_mktsegment").alias("title"),
        F.when(k % 3 != 0, F.col("c_name")).alias("entity"), (F.col("c_acctbal") / 100).alias("lat"), F.concat(F.lit("http://"), k).alias("url"), F.lit("en").alias("lang"),
    )
    return _observed("osint", c)


@query(_observed_sql("GEOINT", "B2", "select 'geoint' as source, strftime(o_orderdate, '%Y-%m-%d') as timestamp, case when o_orderkey % 4 = 0 then 'vessel' else 'track' end || ' T' || o_custkey || ' at ' || (o_orderkey % 80) || ',' || (o_custkey % 170) || case when o_orderkey % 2 = 0 then '; speed ' || (o_orderkey % 30) || 'kn' else '' end || '; heading ' || (o_custkey % 360) || 'deg' as text, 'T' || o_custkey as entity, case when o_orderkey % 4 = 0 then 'vessel' else 'track' end as entity_type, (o_orderkey % 80)::double as lat, (o_custkey % 170)::double as lon, 'heading=' || (o_custkey % 360) || case when o_orderkey % 2 = 0 then '|speed_kn=' || (o_orderkey % 30) else '' end || '|track_id=T' || o_custkey as attributes from orders"))
def geoint_observations(spark, sf_dir):
    o, k, c = T.table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    r = o.select(
        F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd").alias("timestamp"), F.concat(F.lit("T"), c).alias("track_id"), F.when(k % 4 == 0, "vessel").alias("entity_type"), (k % 80).alias("lat"), (c % 170).alias("lon"),
        F.when(k % 2 == 0, k % 30).alias("speed_kn"), (c % 360).alias("heading"),
    )
    return _observed("geoint", r)


@query(_observed_sql("HUMINT", "C3", "select 'H' || s_nationkey as source, '' as timestamp, 'seen ' || s_name as text, s_name as entity, 'person' as entity_type, null::double as lat, s_acctbal / 100 as lon, 'source_id=H' || s_nationkey as attributes from supplier"))
def humint_observations(spark, sf_dir):
    s = T.table(spark, sf_dir, "supplier")
    return _observed("humint", s.select(F.concat(F.lit("H"), "s_nationkey").alias("source_id"), F.concat(F.lit(" seen "), "s_name").alias("report"), F.col("s_name").alias("entity"), F.lit("person").alias("entity_type"), (F.col("s_acctbal") / 100).alias("lon")))


@query(_observed_sql("MASINT", "B2", "select case when p_size % 2 = 0 then 'S' || p_size else 'masint' end as source, '' as timestamp, 'MASINT ' || case when p_size % 3 = 0 then 'signature' else p_brand end || ' event' || case when p_size % 5 = 0 then '' else ': ' || p_size || 'dB' end as text, case when p_size % 3 = 0 then 'signature' else p_brand end as entity, 'sensor-event' as entity_type, null::double as lat, null::double as lon, case when p_size % 5 = 0 then '' else 'measurement=' || p_size || '|' end || 'phenomenology=' || case when p_size % 3 = 0 then 'signature' else p_brand end || case when p_size % 2 = 0 then '|sensor=S' || p_size else '' end || '|unit=dB' as attributes from part"))
def masint_observations(spark, sf_dir):
    n = F.col("p_size")
    p = T.table(spark, sf_dir, "part").select(F.when(n % 2 == 0, F.concat(F.lit("S"), n)).alias("sensor"), F.when(n % 3 != 0, F.col("p_brand")).alias("phenomenology"), F.when(n % 5 != 0, n).alias("measurement"), F.lit("dB").alias("unit"))
    return _observed("masint", p)


@query(_observed_sql("STRUCTURED", "B2", "select 'structured' as source, '' as timestamp, 'port ' || n_name || ' code=' || n_nationkey || ', region=' || n_regionkey as text, n_name as entity, 'port' as entity_type, null::double as lat, null::double as lon, 'code=' || n_nationkey || '|region=' || n_regionkey as attributes from nation"))
def structured_observations(spark, sf_dir):
    n = T.table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"), F.lit("port").alias("entity_type"), F.col("n_nationkey").alias("code"), F.col("n_regionkey").alias("region"))
    return _observed("structured", n)


@query(f"with {T.OBSERVATIONS_SQL} select id, timestamp, discipline || ':' || source as source, case when text <> '' then text else trim(entity_type || ' ' || entity) end as text from obs")
def observation_reports(spark, sf_dir):
    return normalize.to_reports(T.observations(spark, sf_dir))


# --- graph and exports -------------------------------------------------------


@query(f"with {T.LINKED_SQL}, {Q._mentions_sql('linked')}, {Q._EDGES_SQL}, pv as (select {Q._NODE} as eid from mentions where lower(value) = 'desk.7@mail.example.com' limit 1) select case when src in (from pv) then dst else src end as id, weight from edges where src in (from pv) or dst in (from pv)")
def graph_neighbors(spark, sf_dir):
    m = extract.extract_indicators(T.linked_reports(spark, sf_dir))
    pivot = F.concat(F.lit("email--"), F.substring(F.sha1(F.lit("email:desk.7@mail.example.com")), 1, 16))
    return graph.neighbors(graph.comention_edges(m), pivot).select("id", "weight")


@query("""with n as (select 'c' || c_custkey % 50 as id, c_mktsegment as kind, 'a' || c_custkey % 3 as s, 0 as ord from customer where c_custkey % 2 = 0 and c_custkey % 50 < 30 group by all
  union all select 'c' || c_custkey % 50, c_mktsegment, 'b' || c_custkey % 4, 1 from customer where c_custkey % 50 > 20 group by all)
select id, arg_min(kind, (ord, kind, s)) as kind, array_to_string(list_sort(list(distinct s)), '|') as sources from n group by id""")
def graph_merged_nodes(spark, sf_dir):
    """Two graphs' nodes become one: sources unite, the first one's attributes stay."""
    c = T.table(spark, sf_dir, "customer")
    def side(rows, letter, n):
        r = rows.select(F.concat(F.lit("c"), F.col("c_custkey") % 50).alias("id"), F.col("c_mktsegment").alias("kind"), F.concat(F.lit(letter), F.col("c_custkey") % n).alias("s")).distinct()
        return r.groupBy("id").agg(F.min_by("kind", F.struct("kind", "s")).alias("kind"), F.collect_set("s").alias("sources"))
    merged = graph.merge_nodes(side(c.where("c_custkey % 2 = 0 and c_custkey % 50 < 30"), "a", 3), side(c.where("c_custkey % 50 > 20"), "b", 4))
    return merged.select("id", "kind", Q._join("sources"))


@query("select 'n' || c_nationkey as src, 's' || c_custkey % 7 as dst, c_mktsegment as relation, array_to_string(list_sort(list(distinct 'r' || c_custkey % 5)), '|') as sources, sum((c_custkey % 3)::double) as weight from customer group by all")
def graph_merged_edges(spark, sf_dir):
    k = F.col("c_custkey")
    e = T.table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("s"), k % 7).alias("dst"), F.col("c_mktsegment").alias("relation"), F.array(F.concat(F.lit("r"), k % 5)).alias("sources"), (k % 3).cast("double").alias("weight"))
    return graph.merge_edges(e).select("src", "dst", "relation", Q._join("sources"), "weight")


@query(f"with {T.LINKED_SQL}, {Q._mentions_sql('linked')}, {Q._EDGES_SQL} select 'entities' as part, {Q._NODE} as id, lower(value) as value, count(*)::double as n from mentions group by all union all select 'edges', src, dst, weight from edges")
def graph_json_rows(spark, sf_dir):
    """The graph as JSON rows, read again."""
    m = extract.extract_indicators(T.linked_reports(spark, sf_dir))
    rows = sinks.graph_json(graph.mention_nodes(m), graph.comention_edges(m))
    get = lambda *paths: F.coalesce(*[F.get_json_object("object", f"$.{p}") for p in paths])
    return rows.select("part", get("id", "src").alias("id"), F.lower(get("value", "dst")).alias("value"), get("mentions", "weight").cast("double").alias("n"))


@query(f"with {Q._ENT_SQL}, {Q._ENTITIES_SQL} select 'ent--' || substr(sha256(etype || ':' || {Q._NORM.format('canonical')}), 1, 12) as id, canonical, etype as entity_type, n_disciplines::int as discipline_count, n_obs::int as observation_count, disciplines, sources, aliases from ent")
def entity_csv(spark, sf_dir):
    return sinks.entity_csv(Q._fusion(spark, sf_dir).entities)


@query(f"with {T.OBSERVATIONS_SQL} select id, discipline, entity, lat, emitter_id from obs")
def observations_as_json(spark, sf_dir):
    """Observations as JSON rows, read again."""
    o = sinks.as_json(T.observations(spark, sf_dir)).withColumn("o", F.from_json("object", normalize.OBSERVATION_SCHEMA))
    return o.select("o.id", "o.discipline", "o.entity", "o.lat", F.col("o.attributes")["emitter_id"].alias("emitter_id"))


@query(f"with {Q._ENT_SQL}, {Q._ENTITIES_SQL}, {Q._SCORES_SQL} select 'observations' as part, id, text as told from obs union all select 'entities', root, canonical from ent union all select 'assessment', root, band from scores")
def fusion_json_rows(spark, sf_dir):
    """A fusion result as JSON rows, read again."""
    f = Q._fusion(spark, sf_dir)
    get = lambda p: F.get_json_object("object", f"$.{p}")
    rows = sinks.fusion_json(f.observations, f.entities, f.corroboration)
    of = lambda a, b, c: F.when(F.col("part") == "observations", get(a)).when(F.col("part") == "entities", get(b)).otherwise(get(c))
    return rows.select("part", of("id", "root", "root").alias("id"), of("text", "canonical", "band").alias("told"))


@query(f"with {Q._ENT_SQL}, {Q._SCORES_SQL}, {Q._SPATIAL_SQL}, {Q._ATTRIBUTES_SQL} select count(*) as entities, count(*) filter (band = 'strong') as strong, count(*) filter (band = 'moderate') as moderate, count(*) filter (band = 'weak') as weak, count(*) filter (band = 'single-source') as single_source, (select count(*) from spatial) as spatial, (select count(*) from attrs) as attribute from scores")
def assessment(spark, sf_dir):
    f = Q._fusion(spark, sf_dir)
    return corroborate.assessment_summary(f.corroboration, f.spatial_contradictions, f.attribute_conflicts)


# --- answers and evaluations -------------------------------------------------

_ASKED = "Desk.7 addr-7 example.com near"


@query(f"""with {T.LINKED_SQL}, reports as (select report_ord, id, text from linked), {Q._TOKENS_SQL}, {Q._mentions_sql('linked')}, {Q._EDGES_SQL},
q0 as (select term, count(*)::double / sum(count(*)) over () as tf from (select unnest(regexp_extract_all(lower('{_ASKED}'), '[a-z0-9][a-z0-9._-]*')) as term) group by term), q as (select term, tf * idf as w from q0 join df using (term)),
hits as (select report_ord, id, round(sum(w.w * q.w) / any_value(norm) / (select sqrt(sum(x * x)) from (select tf * coalesce(idf, ln(1 + n) + 1) as x from q0 left join df using (term), n)), 10) as raw from w join q using (term) join norm using (report_ord) group by 1, 2 order by 3 desc, 1 limit 3),
ranked as (select id, row_number() over (order by raw desc, report_ord) as rank from hits),
ms as (select m.type, m.value, r.rank, m.report_ord from mentions m join ranked r on m.id = r.id),
top as (select type, value, count(*) as n, min(rank) as first from ms group by 1, 2 order by n desc, first, case type when 'ipv4' then 0 when 'email' then 1 when 'url' then 2 when 'sha256' then 3 when 'crypto-address' then 4 else 5 end limit 1)
select (select string_agg(id, '|' order by rank) from ranked) as citations, (select type from top) as pivot_type, (select lower(value) from top) as pivot_value,
  (select count(*) from edges where {Q._NODE.replace('type', "(select type from top)").replace('lower(value)', "(select lower(value) from top)")} in (src, dst)) as correlated""")
def cited_answer(spark, sf_dir):
    a = Answers(T.linked_reports(spark, sf_dir)).answer(_ASKED, 3)
    row = ("|".join(a["citations"]), a["pivot_entity"]["type"], a["pivot_entity"]["value"].lower(), len(a["correlated"]))
    return spark.createDataFrame([row], "citations string, pivot_type string, pivot_value string, correlated long")


def _metrics_sql(**values: str) -> str:
    return " union all ".join(f"select '{k}' as metric, round(({v})::double, 4) as value" for k, v in values.items())


#: Customers whose orders are asked for.
_ASKED_FOR = (7, 11, 13)
_GOLD_ADDRESS = "'addr-' || case when o_orderkey % 10 = 0 then 0 else o_custkey end"


@query(f"""with {T.LINKED_SQL}, reports as (select report_ord, id, text from linked), {Q._TOKENS_SQL}, {Q._mentions_sql('linked')},
found as (select distinct id, type, lower(value) as key from mentions), gold as (select distinct 'o' || o_orderkey as id, 'crypto-address' as type, {_GOLD_ADDRESS} as key from orders join customer on c_custkey = o_custkey),
tp as (select count(*)::double as n from found join gold using (id, type, key)), p as (select n / (select count(*) from found) as p, n / (select count(*) from gold) as r from tp),
want as (select 'addr-' || o_custkey as key, list_sort(list('o' || o_orderkey) filter (o_custkey % 100 <> 0 or o_orderkey % 2 = 0)) as want from orders join customer on c_custkey = o_custkey where o_custkey % 50 = 0 group by 1),
got as (select lower(value) as key, list_sort(list(distinct id)) as got from mentions where type = 'crypto-address' group by 1),
hits as (select term, id, row_number() over (partition by term order by round(w / norm, 10) desc, report_ord) as rank from w join norm using (report_ord) where term in ({', '.join(f"'addr-{c}'" for c in _ASKED_FOR)})),
rel as (select 'addr-' || o_custkey as term, 'o' || o_orderkey as id from orders where o_custkey in {_ASKED_FOR}),
each as (select term, coalesce(bool_or(rank = 1), false)::int as p1, count(distinct id) filter (rank <= 3)::double / count(distinct id) as rec, coalesce(max(1.0 / rank) filter (rank <= 3), 0) as rr from rel left join hits using (term, id) group by term)
{_metrics_sql(extraction_precision="select p from p", extraction_recall="select r from p", extraction_f1="select 2 * p * r / (p + r) from p", resolution_accuracy="select avg((got is not distinct from want)::int) from want left join got using (key)",
    precision_at_1="select avg(p1) from each", recall_at_3="select avg(rec) from each", mrr="select avg(rr) from each", stix_determinism="1")}""")
def core_evaluation(spark, sf_dir):
    """The text pipeline over the linked reports against gold from the orders: a
    tenth of the addresses is wrong there, and so are half of the resolutions."""
    o = T.table(spark, sf_dir, "orders").join(T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").withColumn("id", F.concat(F.lit("o"), "o_orderkey"))
    address = F.concat(F.lit("addr-"), "o_custkey")
    gold = o.select(F.col("id").alias("source_ref"), F.lit("crypto-address").alias("type"), F.when(F.col("o_orderkey") % 10 == 0, "addr-0").otherwise(address).alias("canonical")).distinct()
    told = F.when((F.col("o_custkey") % 100 != 0) | (F.col("o_orderkey") % 2 == 0), F.col("id"))
    resolution = o.where("o_custkey % 50 = 0").groupBy("o_custkey").agg(F.collect_list(told).alias("sources")).select(F.lit("crypto-address").alias("type"), address.alias("canonical"), "sources")
    relevant = o.where(F.col("o_custkey").isin(*_ASKED_FOR)).select(address.alias("query"), "id")
    return evaluate.core_metrics(T.linked_reports(spark, sf_dir), {}, gold, resolution, relevant)


_GATE = T.ZONES[0]


@query(f"""with {Q._ENT_SQL}, {Q._SCORES_SQL}, {Q._SPATIAL_SQL}, names as (select distinct lower(entity) as name, root from eo),
label as (select name, right(name, 7) as label, root from names), r as (select label, min(root) as root, count(distinct root) as roots from label group by 1), l as (select *, count(*) over (partition by root) as labels from r),
b as (select case when scores.band = 'strong' then 1 else 0 end as hit from names left join scores using (root)),
k as (select distinct lower(entity) as name from eo where lat is not null and {T.haversine_sql('eo.', 'z.').replace('z.lat', f'{_GATE[1]}').replace('z.lon', f'{_GATE[2]}')} <= {_GATE[3]}), inside as (select distinct root from names join k using (name))
{_metrics_sql(entity_resolution="select avg((roots = 1 and labels = 1)::int) from l", band_accuracy="select avg(hit) from b", keep_out_recall="select avg((inside.root is not null)::int) from names left join inside using (root)",
    contradiction_precision="select case when count(*) = 0 then 1 else 0 end from spatial")}""")
def fusion_evaluation(spark, sf_dir):
    """The fusion of the events against simple gold: names that end in one number
    are one entity, all are strong, all were in the keep-out zone, and no two
    observations contradict each other."""
    f = Q._fusion(spark, sf_dir)
    names = f.entity_obs.select(F.lower("entity").alias("name")).distinct()
    return evaluate.fusion_metrics(f, names.withColumn("label", F.substring("name", -7, 7)), names.withColumn("band", F.lit("strong")), names)
