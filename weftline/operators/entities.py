"""Cross-source entity resolution and de-confliction.

Observations are linked by shared identifiers, equal names and similar names;
connected observations are one entity, whose root is the least observation id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalars import jaccard, name_tokens, norm_name
from weftline.functions.staging import stage
from weftline.operators.components import components

# fixed values: attributes that identify
IDENTIFIERS = ("emitter_id", "track_id", "imo", "mmsi", "callsign", "hull", "tail")
NAME_THRESHOLD = 0.6


def identifier_rows(o: DataFrame, *more: str) -> DataFrame:
    """id, timestamp, key, value of identifying attributes that are not empty."""
    each = o.select("id", "timestamp", *more, F.explode("attributes").alias("key", "value"))
    return each.where(F.col("key").isin(*IDENTIFIERS) & F.col("value").isNotNull() & (F.col("value") != ""))


def _star(rows: DataFrame, *keys: str) -> DataFrame:
    """Edges from every row of a group to its least id: as many edges as rows."""
    least = rows.groupBy(*keys).agg(F.min("id").alias("b"))
    return rows.join(least, list(keys)).select(F.col("id").alias("a"), "b").where("a <> b")


def shuffled(exploded: DataFrame) -> DataFrame:
    """For a join: Spark takes exploded rows for as small as what they came from, and
    would send them all to every executor by way of the driver."""
    return exploded.hint("merge")


def _held(names: DataFrame) -> DataFrame:
    """etype, x, y: pairs of different names of which y holds x.

    A name of 2**k letters or more, and fewer than twice as many, is looked for by
    its rarest sequence of 2**k letters, which is over half of it, among the
    sequences of the names of its type; only their hashes are shuffled.
    """
    size = F.length("name")
    own = F.pow(F.lit(2), F.length(F.bin(size)) - 1).cast("int")
    grams = F.transform(F.sequence(F.lit(1), size - F.col("level") + 1), lambda i: F.xxhash64(F.substring(F.col("name"), i, F.col("level"))))
    n = names.withColumn("own", own)
    levels = n.groupBy("etype").agg(F.collect_set("own").alias("levels"))
    each = n.join(levels, "etype").select("etype", "name", "own", F.explode("levels").alias("level")).where(F.col("level") <= F.col("own"))
    each = each.select("etype", "name", "own", "level", F.explode(F.array_distinct(grams)).alias("gram"))
    df = each.groupBy("etype", "level", "gram").agg(F.count("*").alias("df"))
    whole = each.where("level = own").join(shuffled(df), ["etype", "level", "gram"])
    rarest = whole.groupBy("etype", F.col("name").alias("x"), "level").agg(F.min(F.struct("df", "gram"))["gram"].alias("gram"))
    met = rarest.join(shuffled(each.select("etype", "level", "gram", F.col("name").alias("y"))), ["etype", "level", "gram"])
    return met.where((F.col("x") != F.col("y")) & F.col("y").contains(F.col("x"))).select("etype", "x", "y")


def _alike(names: DataFrame, threshold: float) -> DataFrame:
    """etype, x, y: pairs of different names whose tokens' Jaccard similarity is
    high enough.

    Names of s and t tokens must have threshold / (1 + threshold) * (s + t) in
    common, so they share one of the rarest of each that are left beside these.
    Rows are keyed by the token and both sizes: names of three tokens, which must
    be the same in both, do not meet by a frequent one.
    """
    t = names.withColumn("tokens", name_tokens(F.col("name"))).withColumn("own", F.size("tokens")).where("own > 0")
    each = t.select("etype", "name", "own", F.explode("tokens").alias("token"))
    common = each.groupBy("etype", "token").agg(F.count("*").alias("df"))
    ranked = each.join(shuffled(common), ["etype", "token"]).groupBy("etype", "name", "own").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda r: r["token"]).alias("rare"))
    sizes = t.groupBy("etype").agg(F.collect_set("own").alias("sizes"))
    spare = 1e-9  # of bounds that are products of floats
    sized = ranked.join(sizes, "etype").select("etype", "name", "own", "rare", F.explode("sizes").alias("other"))
    sized = sized.where((F.least("own", "other") + spare >= threshold * F.greatest("own", "other")))
    shared = F.greatest(F.ceil(threshold / (1 + threshold) * (F.col("own") + F.col("other")) - spare), F.lit(1))
    keyed = sized.select("etype", "name", "own", "other", "rare", F.explode(F.slice("rare", F.lit(1), (F.col("own") - shared + 1).cast("int"))).alias("token"))
    a, b = keyed.where("own <= other").alias("a"), keyed.where("own >= other").alias("b")
    on = (F.col("a.etype") == F.col("b.etype")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.own") == F.col("b.other")) & (F.col("a.other") == F.col("b.own"))
    met = a.join(shuffled(b), on).where(((F.col("a.own") < F.col("b.own")) | (F.col("a.name") < F.col("b.name"))) & (jaccard(F.col("a.rare"), F.col("b.rare")) >= threshold))
    return met.select("a.etype", F.col("a.name").alias("x"), F.col("b.name").alias("y"))


def similar_names(names: DataFrame, threshold: float = NAME_THRESHOLD) -> DataFrame:
    """etype, a, b: pairs a < b of different names of a type of which one holds
    the other, or whose tokens' Jaccard similarity is high enough."""
    n = names.select("etype", "name").where("name <> ''").distinct()
    # names are few bytes and many sequences: without a number they would be cut in one or two tasks
    n = stage(n.repartition(names.sparkSession.sparkContext.defaultParallelism, "etype", "name"), "names")
    return _held(n).union(_alike(n, threshold)).select("etype", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def name_roots(observations: DataFrame, threshold: float = NAME_THRESHOLD) -> DataFrame:
    """etype, entity, lone, root: the root of everything that observations of a type
    call an entity; an observation without a type (lone) is alone, but for its
    identifiers.

    Observations of one name and type are one entity anyway, so it is names that
    are linked, each by its least observation id; of an identifier every name
    that bears it counts once.  What is normalised and iterated grows with the
    different names.
    """
    borne = F.map_filter("attributes", lambda k, v: k.isin(*IDENTIFIERS) & v.isNotNull() & (v != ""))
    lone = F.when(F.col("entity_type").isNull(), F.col("id"))
    # one pass over the observations: a row for each name as written and identifier (null: none)
    each = observations.where("entity <> ''").select("id", F.col("entity_type").alias("etype"), "entity", lone.alias("lone"), F.explode_outer(F.map_entries(borne)).alias("borne"))
    own = ["etype", "entity", "lone", F.col("borne.key").alias("key"), F.col("borne.value").alias("value")]
    # a minimum of texts is taken from sorted rows, and a hash in front sorts them by one number
    written = each.groupBy(F.xxhash64("etype", "entity", "lone", "borne"), *own).agg(F.min("id").alias("id")).select("etype", "entity", "lone", "key", "value", "id")
    named = stage(written.withColumn("name", norm_name(F.col("entity"))), "named")
    first = stage(named.where("lone is null").groupBy("etype", "name").agg(F.min("id").alias("first")), "names-first")
    borne = named.where("key is not null")
    bearers = borne.where("lone is null").select("etype", "name", "key", "value").distinct().join(first, ["etype", "name"]).select(F.col("first").alias("id"), "key", "value")
    bearers = bearers.union(borne.where("lone is not null").select("lone", "key", "value"))
    pairs = similar_names(first, threshold)
    left = pairs.join(first.select("etype", F.col("name").alias("a"), F.col("first").alias("x")), ["etype", "a"])
    by_likeness = left.join(first.select("etype", F.col("name").alias("b"), F.col("first").alias("y")), ["etype", "b"]).select("x", "y")
    called = named.select("etype", "entity", "name", "lone").distinct().join(first, ["etype", "name"], "left")
    called = stage(called.select("etype", "entity", "lone", F.coalesce("lone", "first").alias("node")), "names-called")
    roots = components(called.select("node").distinct(), _star(bearers, "key", "value").union(by_likeness))
    return stage(called.join(roots, "node").select("etype", "entity", "lone", F.col("comp").alias("root")), "names-root")


def rooted(observations: DataFrame, roots: DataFrame) -> DataFrame:
    """Every observation that names an entity, with its root, from `name_roots`.

    It is joined by what it is called, as of that there is far less."""
    of_name = roots.where("lone is null").select(F.col("etype").alias("entity_type"), "entity", "root")
    of_lone = roots.where("lone is not null").select(F.col("lone").alias("id"), "root")
    o, columns = observations.where("entity <> ''"), [*observations.columns, "root"]
    whole = o.where("entity_type is not null").join(of_name, ["entity_type", "entity"]).select(*columns)
    return whole.union(o.where("entity_type is null").join(of_lone, "id").select(*columns))


def cluster(observations: DataFrame, threshold: float = NAME_THRESHOLD) -> DataFrame:
    """id, root for every observation that names an entity."""
    narrow = observations.select("id", "entity", "entity_type")
    return rooted(narrow, name_roots(observations, threshold)).select("id", "root").distinct()


def entity_key(etype: Column, canonical: Column) -> Column:
    return F.concat(F.lit("ent--"), F.substring(F.sha2(F.concat(etype, F.lit(":"), norm_name(canonical)), 256), 1, 12))


def resolve_entities(observations: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Of observations with their root, or with clusters that tell it: entity_id, root, canonical, etype, aliases, observation_ids, disciplines,
    sources, identifiers, n_obs.

    canonical is the most frequent name, then the longest, then the first;
    etype that of the root; observation_ids are in order of (timestamp, id), and
    of identifiers the last in that order counts.
    """
    o = observations if clusters is None else observations.join(clusters, "id")
    names = o.groupBy("root", "entity").agg(F.count("*").alias("n"))
    best = names.groupBy("root").agg(
        F.min(F.struct((-F.col("n")).alias("n"), (-F.length("entity")).alias("l"), F.col("entity"))).alias("best"),
        F.array_sort(F.collect_set("entity")).alias("names"),
    )
    seen = o.groupBy("root").agg(
        F.max(F.when(F.col("id") == F.col("root"), F.col("entity_type"))).alias("etype"),
        F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "id"))), lambda x: x["id"]).alias("observation_ids"),
        F.array_sort(F.collect_set("discipline")).alias("disciplines"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.count("*").alias("n_obs"),
    )
    last = identifier_rows(o, "root").groupBy("root", "key").agg(F.max_by("value", F.struct("timestamp", "id")).alias("value"))
    identifiers = last.groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("identifiers"))
    e = seen.join(best, "root").join(identifiers, "root", "left").withColumn("canonical", F.col("best.entity"))
    return e.select(
        entity_key(F.col("etype"), F.col("canonical")).alias("entity_id"), "root", "canonical", "etype", F.array_remove("names", F.col("canonical")).alias("aliases"),
        "observation_ids", "disciplines", "sources", F.coalesce("identifiers", F.expr("cast(map() as map<string,string>)")).alias("identifiers"), "n_obs",
    )


def name_type_conflicts(entities: DataFrame) -> DataFrame:
    """Names that entities of several types bear."""
    g = entities.groupBy(norm_name(F.col("canonical")).alias("name")).agg(F.count("*").alias("n_entities"), F.array_sort(F.collect_set("etype")).alias("etypes"), F.array_sort(F.collect_list("entity_id")).alias("entity_ids"))
    return g.where((F.col("n_entities") > 1) & (F.size("etypes") > 1)).withColumn("kind", F.lit("name-type-ambiguity"))


def identifier_conflicts(entities: DataFrame) -> DataFrame:
    """Identifiers that several entities bear."""
    each = entities.select("root", "entity_id", F.explode("identifiers").alias("key", "value"))
    g = each.groupBy("key", "value").agg(F.countDistinct("root").alias("n_entities"), F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
    return g.where("n_entities > 1").withColumn("kind", F.lit("identifier-collision"))
