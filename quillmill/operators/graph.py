"""Entity graphs: merging mentions, components, neighbourhoods and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.identity import entity_id, folded, relation_type
from quillmill.functions.text import has_any
from quillmill.plans.checkpoints import cut
from quillmill.registry import query
from quillmill.sources.tables import dealt, in_stored_order, table


def merge_entities(mentions: DataFrame) -> DataFrame:
    """(name, kind, description, doc, chunk, seq) by folded name: first name and first kind that is known, the longest description
    (the first of equals), and the numbers of distinct documents, of (document, chunk) places and of mentions. `seq` is whatever has an
    order; mentions that share one are kept as they come, so it should be their own. Texts are merged on the map side, and places are
    counted apart as numbers, so that no entity's rows are gathered. `entity_places` lists the places."""
    named = mentions.withColumn("key", F.lower(folded(F.col("name"))))
    long_first = F.struct(F.coalesce(-F.length("description"), F.lit(1)), "seq")
    said = named.groupBy("key").agg(
        F.min_by("name", "seq").alias("name"), F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("seq"))).alias("kind"), F.min_by("description", long_first).alias("description"), F.count("*").alias("mentions"),
    )
    placed = named.groupBy("key", "doc", "chunk").agg(F.lit(1).alias("one")).groupBy("key", "doc").agg(F.count("*").alias("places")).groupBy(F.col("key").alias("of")).agg(F.count("doc").alias("docs"), F.sum("places").alias("places"))
    return said.join(placed, F.col("key").eqNullSafe(F.col("of"))).select("key", "name", "kind", "description", "docs", "places", "mentions")


def entity_places(mentions: DataFrame) -> DataFrame:
    """(key, doc, chunk): the distinct places of each entity, a row each."""
    return mentions.select(F.lower(folded(F.col("name"))).alias("key"), "doc", "chunk").distinct()


def merge_relations(found: DataFrame) -> DataFrame:
    """(source, target, kind, description, doc, seq): one edge for each kind between two entities, weighted by its number."""
    return found.groupBy("source", "target", relation_type(F.col("kind")).alias("kind")).agg(F.min_by("description", "seq").alias("description"), F.countDistinct("doc").alias("n_docs"), F.count("*").alias("weight"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b) of either direction.

    Each round hangs all neighbours of a node on the smallest of them, with map-side minima; it ends when no edge changes.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        pairs = cut(small.filter("a <> b").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        before = now


def neighbourhood(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch one of the nodes at either end. Each end is an equi-join."""
    a = edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi")
    b = edges.join(nodes.select(F.col("node").alias("target")), "target", "left_semi").select(a.columns)
    return a.unionByName(b).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi")


def search_entities(entities: DataFrame, words: list[str], limit: int) -> DataFrame:
    """Entities whose name or description contains one of the words, most mentioned first."""
    hit = has_any(F.lower("name"), [w.lower() for w in words]) | has_any(F.lower("description"), [w.lower() for w in words])
    return entities.filter(hit).orderBy(F.desc("mentions"), "key").limit(limit)


def _mentions(spark, d: str) -> DataFrame:
    """Parts as entities that lines mention; the supplier stands for the document. Lines come by order and number; of those that share
    both (a quarter of all lines do) the one that is stored first comes first."""
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    seq = F.when(number.isNotNull(), F.struct(number.alias("number"), "at"))
    lines = dealt(in_stored_order(table(spark, d, "lineitem"))).select("l_partkey", F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("chunk"), seq.alias("seq"))
    return lines.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("name"), F.col("p_type").alias("kind"), F.col("p_name").alias("description"), "doc", "chunk", "seq"
    )


@query("agg17_gen1_merge_entities", """
  WITH m AS (SELECT p_brand AS name, p_type AS kind, p_name AS description, l_suppkey AS doc, l_orderkey * 10 + l_linenumber AS seq FROM lineitem JOIN part ON l_partkey = p_partkey)
  SELECT lower(name) AS key, arg_min(kind, seq) AS kind, max(length(description))::BIGINT AS longest, count(DISTINCT doc)::BIGINT AS docs, count(*)::BIGINT AS mentions,
    substr(md5('c:' || lower(name)), 1, 16) AS id FROM m GROUP BY name""")
def merged_entities(spark, d):
    merged = merge_entities(_mentions(spark, d))
    return merged.select("key", "kind", F.length("description").cast("bigint").alias("longest"), "docs", "mentions", entity_id(F.lit("c"), F.col("name")).alias("id"))


def _edges(spark, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"),
        F.when(F.col("l_returnflag") == "R", " returned  by").otherwise("supplied").alias("kind"), F.col("l_linestatus").alias("description"), F.col("l_orderkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


@query("agg18_merge_relations", """
  SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, CASE WHEN l_returnflag = 'R' THEN 'RETURNED_BY' ELSE 'SUPPLIED' END AS kind,
    arg_min(l_linestatus, l_orderkey * 10 + l_linenumber) AS description, count(DISTINCT l_orderkey)::BIGINT AS n_docs, count(*)::BIGINT AS weight FROM lineitem GROUP BY 1, 2, 3""")
def merged_relations(spark, d):
    return merge_relations(_edges(spark, d))


_CHAINS = "(SELECT o_orderkey AS a, -o_custkey - 1 AS b FROM orders)"


@query("gra1_agg19_components", f"""
  WITH g AS (SELECT b, min(a) AS low, count(*) AS n FROM {_CHAINS} GROUP BY b)
  SELECT least(low, b) AS component, (n + 1)::BIGINT AS members FROM g""")
def component_sizes(spark, d):
    edges = table(spark, d, "orders").select(F.col("o_orderkey").alias("a"), (-F.col("o_custkey") - 1).alias("b"))
    return components(edges).groupBy("component").agg(F.count("*").alias("members"))


@query("gra2_entity_search", """
  WITH m AS (SELECT p_brand AS name, arg_min(p_name, p_partkey) AS description, count(*) AS mentions FROM part GROUP BY 1)
  SELECT name, description, mentions::BIGINT AS mentions FROM m WHERE contains(lower(name), '#2') OR contains(lower(description), 'gear') ORDER BY mentions DESC, name LIMIT 10""")
def entity_search(spark, d):
    entities = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.min_by("p_name", "p_partkey").alias("description"), F.count("*").alias("mentions")).withColumn("key", F.col("name"))
    return search_entities(entities, ["#2", "GEAR"], 10).select("name", "description", "mentions")


def graph_search(entities: DataFrame, edges: DataFrame, communities: DataFrame, named: list[str], said: str, limit: int) -> DataFrame:
    """(kind, id): entities whose name contains one of the named ones, or, where none is named, whose name or description contains
    a word of over two characters of what was said, most mentioned first; then edges at them, twice as many at most, and their
    communities. entities: (key, name, description, mentions, community), edges: (source, target, weight)."""
    words = [w.lower() for w in said.split() if len(w) > 2]
    name, description = F.lower("name"), F.lower("description")
    hit = has_any(name, [n.lower() for n in named]) if named else (has_any(name, words) | has_any(description, words) if words else F.lit(False))
    best = entities.filter(hit).orderBy(F.desc("mentions"), "key").limit(limit)
    touching = neighbourhood(edges, best.select(F.col("key").alias("node"))).orderBy(F.desc("weight"), "source", "target").limit(2 * limit)
    around = communities.join(best.select("community").distinct(), "community", "left_semi")
    of = lambda f, kind, c: f.select(F.lit(kind).alias("kind"), c.alias("id"))
    return of(best, "entity", F.col("key")).unionByName(of(touching, "edge", F.concat_ws(">", "source", "target"))).unionByName(of(around, "community", F.col("community").cast("string")))


def _world(spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as entities with the size as their community, edges between parts of one order's neighbouring lines."""
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    mentions = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("mentions"))
    key = lambda c: F.concat(F.lit("p"), c.cast("string"))
    entities = part.join(mentions, "p_partkey").select(key(F.col("p_partkey")).alias("key"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("kind"), "mentions", F.col("p_size").alias("community"))
    a = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("a"))
    b = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("b"))
    edges = a.join(b, ["l_orderkey", "l_linenumber"]).filter("a <> b").groupBy(key(F.col("a")).alias("source"), key(F.col("b")).alias("target")).agg(F.count("*").alias("weight"))
    return entities, edges, entities.groupBy("community").agg(F.count("*").alias("members"))


_WORLD = """e AS (SELECT 'p' || p_partkey AS key, p_name AS name, p_type AS description, p_brand AS kind, n AS mentions, p_size AS community FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
  g AS (SELECT 'p' || a.l_partkey AS source, 'p' || b.l_partkey AS target, count(*) AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2)"""


@query("gra3_graph_search", f"""
  WITH {_WORLD}, n AS (SELECT *, 'named' AS way FROM e WHERE contains(lower(name), 'bolt') ORDER BY mentions DESC, key LIMIT 10), w AS (SELECT *, 'words' AS way FROM e WHERE contains(lower(name), 'cold') OR contains(lower(name), 'promo') OR contains(lower(description), 'cold') OR contains(lower(description), 'promo') ORDER BY mentions DESC, key LIMIT 10),
  b AS (FROM n UNION ALL FROM w), t AS (SELECT w AS way, source, target, row_number() OVER (PARTITION BY w ORDER BY weight DESC, source, target) AS rn FROM g, (SELECT DISTINCT way AS w FROM b) WHERE EXISTS (SELECT 1 FROM b x WHERE x.way = w AND (x.key = source OR x.key = target)))
  SELECT way, 'entity' AS kind, key AS id FROM b UNION ALL SELECT way, 'edge', source || '>' || target FROM t WHERE rn <= 20 UNION ALL SELECT DISTINCT way, 'community', community::VARCHAR FROM b""")
def graph_search_query(spark, d):
    """Searches by a named entity, and by the words of an utterance that names none."""
    world = _world(spark, d)
    named = graph_search(*world, ["Bolt"], "", 10).withColumn("way", F.lit("named"))
    return named.unionByName(graph_search(*world, [], "a Cold promo", 10).withColumn("way", F.lit("words"))).select("way", "kind", "id")


def graph_view(entities: DataFrame, edges: DataFrame, least: int, kinds: list[str], limit: int | None = None) -> DataFrame:
    """(kind, id, n) to draw: nodes of some kinds with enough mentions, edges among them, their communities by size, and totals."""
    nodes = entities.filter((F.col("mentions") >= least) & F.col("kind").isin(kinds)).orderBy(F.desc("mentions"), "key")
    nodes = nodes.limit(limit) if limit else nodes
    inner = induced(edges, nodes.select(F.col("key").alias("node")))
    sizes = entities.groupBy("community").agg(F.count("*").alias("n")).join(nodes.select("community").distinct(), "community", "left_semi")
    of = lambda f, kind, c, n: f.select(F.lit(kind).alias("kind"), c.alias("id"), n.cast("bigint").alias("n"))
    shown = of(nodes, "node", F.col("key"), F.col("mentions")).unionByName(of(inner, "edge", F.concat_ws(">", "source", "target"), F.col("weight"))).unionByName(of(sizes, "community", F.col("community").cast("string"), F.col("n")))
    return shown.unionByName(of(shown.groupBy("kind").agg(F.count("*").alias("c")), "total", F.col("kind"), F.col("c")))


@query("gra4_graph_view", f"""
  WITH {_WORLD}, n AS (SELECT * FROM e WHERE mentions >= 20 AND kind IN ('Brand#13', 'Brand#5', 'Brand#19') ORDER BY mentions DESC, key LIMIT 200),
  s AS (SELECT 'node' AS kind, key AS id, mentions::BIGINT AS n FROM n UNION ALL SELECT 'edge', source || '>' || target, weight FROM g WHERE source IN (SELECT key FROM n) AND target IN (SELECT key FROM n)
    UNION ALL SELECT 'community', community::VARCHAR, count(*) FROM e WHERE community IN (SELECT community FROM n) GROUP BY community)
  FROM s UNION ALL SELECT 'total', kind, count(*) FROM s GROUP BY kind""")
def graph_view_query(spark, d):
    entities, edges, _ = _world(spark, d)
    return graph_view(entities, edges, 20, ["Brand#13", "Brand#5", "Brand#19"], 200)


@query("joi10_neighbourhood", """
  SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem WHERE l_suppkey % 20 = 0 OR l_partkey % 20 = 0""")
def neighbours(spark, d):
    """Around the suppliers and parts whose key is divisible by 20."""
    name = lambda c: F.concat(F.lit(c[0]), F.col(f"{c[0]}_{c}key").cast("string")).alias("node")
    nodes = table(spark, d, "supplier").filter("s_suppkey % 20 = 0").select(name("supp")).unionByName(table(spark, d, "part").filter("p_partkey % 20 = 0").select(name("part")))
    return neighbourhood(_edges(spark, d).select("source", "target").distinct(), nodes)


@query("joi11_gra4_induced_subgraph", """
  SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, count(*)::BIGINT AS weight FROM lineitem
  WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) >= 550) AND l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 35) GROUP BY 1, 2""")
def subgraph(spark, d):
    edges = _edges(spark, d).groupBy("source", "target").agg(F.count("*").alias("weight"))
    sides = edges.groupBy(F.col("source").alias("node")).agg(F.sum("weight").alias("n")).filter("n >= 550").unionByName(edges.groupBy(F.col("target").alias("node")).agg(F.sum("weight").alias("n")).filter("n >= 35"))
    return induced(edges, sides.select("node"))


@query("joi12_neighbour_lists", "SELECT s_suppkey, count(DISTINCT l_partkey)::BIGINT AS neighbours FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1")
def neighbour_lists(spark, d):
    """How many distinct neighbours each node has, none included."""
    near = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey").distinct().groupBy("s_suppkey").agg(F.count("*").alias("neighbours"))
    return table(spark, d, "supplier").join(near, "s_suppkey", "left").select("s_suppkey", F.coalesce("neighbours", F.lit(0)).cast("bigint").alias("neighbours"))


def upsert_facilities(entities: DataFrame, facilities: DataFrame) -> DataFrame:
    """(id, name, name_lower, description, mentions): facilities (facility_id, name, kind, address, phone) under fixed ids put into
    the entities; what is there already keeps its number of mentions, new ones have one."""
    some = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    new = facilities.select(F.concat(F.lit("facility:"), F.col("facility_id").cast("string")).alias("id"), "name", F.lower("name").alias("name_lower"), F.concat_ws(" · ", *[some(F.col(c)) for c in ("kind", "address", "phone")]).alias("description"))
    kept = new.join(entities.select("id", "mentions"), "id", "left").withColumn("mentions", F.coalesce("mentions", F.lit(1)).cast("bigint"))
    return entities.join(new, "id", "left_anti").select(kept.columns).unionByName(kept)


@query("gra5_facility_upsert", """
  WITH old AS (SELECT 'facility:' || s_suppkey AS id, s_name AS name, 'old' AS description, s_suppkey % 9 AS mentions FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation', 5 FROM nation),
  new AS (SELECT 'facility:' || s_suppkey AS id, s_name || '!' AS name, concat_ws(' · ', n_name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'Str ' || s_suppkey END, CASE WHEN s_acctbal > 0 THEN s_acctbal::VARCHAR END) AS description FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0)
  SELECT id, name, lower(name) AS name_lower, description, mentions::BIGINT AS mentions FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT n.id, n.name, lower(n.name), n.description, coalesce(o.mentions, 1) FROM new n LEFT JOIN old o USING (id)""")
def facilities(spark, d):
    suppliers, nations = table(spark, d, "supplier"), table(spark, d, "nation")
    key = F.concat(F.lit("facility:"), F.col("s_suppkey").cast("string"))
    old = suppliers.filter("s_suppkey % 3 = 0").select(key.alias("id"), F.col("s_name").alias("name"), F.lower("s_name").alias("name_lower"), F.lit("old").alias("description"), (F.col("s_suppkey") % 9).alias("mentions"))
    old = old.unionByName(nations.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("name_lower"), F.lit("nation").alias("description"), F.lit(5).cast("bigint").alias("mentions")))
    joined = suppliers.filter("s_suppkey % 2 = 0").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    street = F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("Str "), F.col("s_suppkey").cast("string")))
    new = joined.select(F.col("s_suppkey").alias("facility_id"), F.concat("s_name", F.lit("!")).alias("name"), F.col("n_name").alias("kind"), street.alias("address"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal").cast("string")).alias("phone"))
    return upsert_facilities(old, new)


@query("agg20_gra6_graph_stats", "SELECT round(l_discount * 100)::BIGINT AS collection, count(DISTINCT l_suppkey)::BIGINT AS suppliers, count(DISTINCT l_partkey)::BIGINT AS parts, count(DISTINCT (l_suppkey, l_partkey))::BIGINT AS edges, count(DISTINCT p_size)::BIGINT AS communities FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity = 50 GROUP BY 1")
def graph_stats(spark, d):
    """Entities of both kinds, edges and communities (sizes of parts) of each collection, in one pass over its distinct edges."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    left = table(spark, d, "lineitem").filter("l_quantity = 50").select(F.round(F.col("l_discount") * 100).cast("bigint").alias("collection"), "l_suppkey", "l_partkey").join(part, "l_partkey")
    edges = left.groupBy("collection", "l_suppkey", "l_partkey").agg(F.first("p_size").alias("community"))
    return edges.groupBy("collection").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"), F.count("*").alias("edges"), F.countDistinct("community").alias("communities"))
