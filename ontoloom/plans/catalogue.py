"""Every query of the ontology operators over the given tables, each with the same query in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontoloom.functions import text
from ontoloom.functions import vocabulary as V
from ontoloom.operators import closure as hier
from ontoloom.operators import derive, display, export, graph, link, linkdelta, mapping, nested, reach, search, shape, textindex, treepage
from ontoloom.plans.spread import small
from ontoloom.plans.staging import staged
from ontoloom.plans.tables import CLOSURE_SQL, ENTITIES_SQL, PARENTS_SQL, Tables, edges, entities, key
from ontoloom.service import Service
from ontoloom.session import shared_dir

_QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(sql: str | None):
    def register(build: Callable[[Tables], DataFrame]):
        _QUERIES[build.__name__] = (build, sql)
        return build

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, f=build: f(Tables(spark, folder))) for name, (build, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


def _props(frame: DataFrame, id_: Column, predicate: str | Column, value: Column, kind: str = "literal", lang: Column | None = None) -> DataFrame:
    """Rows of a table as properties of nodes."""
    name = F.lit(predicate) if isinstance(predicate, str) else predicate
    lang = F.lit("") if lang is None else lang
    return frame.select(
        F.lit("x").alias("ontology_id"), id_.cast("string").alias("id"), name.alias("predicate"), F.lit(0).alias("pos"),
        F.lit(kind).alias("kind"), value.cast("string").alias("value"), F.lit("").alias("datatype"), lang.alias("lang"),
    )


def _nodes(frame: DataFrame, id_: Column, *types: str) -> DataFrame:
    """Rows of a table as nodes of the given types."""
    kinds = F.array(*map(F.lit, types))
    return frame.select(F.lit("x").alias("ontology_id"), id_.cast("string").alias("id"), id_.cast("string").startswith("_:").alias("bnode"), kinds.alias("types"), F.lit(False).alias("imported"))


def _parents(t: Tables) -> DataFrame:
    return edges(t, "directParent").select("src", "dst")


_CLO = CLOSURE_SQL.format(edges="par")
_GEO = "geo as (select 'nation:' || n_nationkey as src, 'region:' || n_regionkey as dst from nation)"


# --- hierarchies ------------------------------------------------------------------------------------------------------


@query(f"with recursive {ENTITIES_SQL}, {PARENTS_SQL}, {_CLO} select id, coalesce(n, 0) as num_descendants from ent left join (select dst, count(*) as n from clo group by 1) on id = dst")
def descendant_counts(t):
    return hier.descendant_counts(entities(t), hier.closure(_parents(t)))


@query(f"with recursive {PARENTS_SQL}, {_CLO} select src as id, dst as ancestor from clo")
def ancestor_pairs(t):
    return hier.closure(_parents(t)).select(F.col("src").alias("id"), F.col("dst").alias("ancestor"))


@query(f"""with recursive {PARENTS_SQL}, both_ as (select * from par union all select 'part:' || p_partkey, 'brand:' || p_brand from part),
{CLOSURE_SQL.format(edges="both_")} select dst as id, count(*) as n from clo where dst like 'brand:%' or dst like 'type:%' group by 1""")
def hierarchical_descendants(t):
    pairs = hier.closure(edges(t, "directParent", "part_of").select("src", "dst"))
    return pairs.where(F.col("dst").startswith("brand:") | F.col("dst").startswith("type:")).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))


_BOTH = "both_ as (select * from par union all select 'part:' || p_partkey, 'brand:' || p_brand from part)"


@query(f"""with recursive {PARENTS_SQL}, {_BOTH}, {CLOSURE_SQL.format(edges="both_")} select dst as top, src as id from clo
where dst like 'region:%' or dst like 'brand:%' or dst like 'type:%' or dst like 'nation:%'""")
def subtree_by_interval(t):
    """What lies below regions, nations, brands and types, by numbers of a forest; parts have two parents, so brands are told by exceptions."""
    tops = entities(t).where(F.col("kind").isin("region", "nation", "brand", "type")).select("id")
    return reach.build(entities(t), edges(t, "directParent", "part_of").select("src", "dst")).below(tops)


@query(f"""with recursive {ENTITIES_SQL}, {PARENTS_SQL}, {_BOTH}, {CLOSURE_SQL.format(edges="both_")}
select id, coalesce(n, 0) as n from ent left join (select dst, count(*) as n from clo group by 1) on id = dst""")
def interval_descendant_counts(t):
    return reach.build(entities(t), edges(t, "directParent", "part_of").select("src", "dst")).descendant_counts()


_MANY = """many as (select 'nation:' || n_nationkey as src, 'region:' || n_regionkey as dst from nation union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey from supplier
union all select distinct 'part:' || l_partkey, 'supplier:' || l_suppkey from lineitem union all select 'part:' || p_partkey, 'type:' || p_type from part union all select 'part:' || p_partkey, 'brand:' || p_brand from part),
walk as (select distinct dst as node, [dst] as path from many where dst not in (select src from many) union all select src, list_append(path, src) from walk join many on dst = node)"""


def _supply(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Parts below their suppliers, types and brands; suppliers below nations, and these below regions: several ways to a part."""
    up = edges(t, "directParent", "part_of", "supplied_by").where("src like 'nation:%' or src like 'supplier:%' or src like 'part:%'").select("src", "dst")
    dag = treepage.acyclic(up)
    return dag, dag.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


@query(f"with recursive {_MANY} select node as id, count(*) as n from walk group by 1")
def tree_path_counts(t):
    dag, nodes = _supply(t)
    return treepage.path_counts(nodes, dag).select("id", F.col("n").cast("long").alias("n"))


@query(f"""with recursive {_MANY}, f as (select node as focus, path, row_number() over (partition by node order by list_reverse(path)) - 1 as k from walk where node like 'part:%')
select focus, k, array_to_string(path, '>') as path from f where k between 3 and 6""")
def tree_page(t):
    """Of every part, its paths number 3 to 6: a page of a tree is the feature here."""
    dag, nodes = _supply(t)
    found = treepage.paths(nodes.where("id like 'part:%'"), dag, treepage.path_counts(nodes, dag), 3, 4)
    return found.select("focus", "k", F.array_join("path", ">").alias("path"))


_RING = "ring as (select 'customer:' || c_custkey as src, 'nation:' || c_nationkey as dst from customer union all select 'nation:' || n_nationkey, 'region:' || n_regionkey from nation union all select 'region:' || r_regionkey, 'region:' || ((r_regionkey + 1) % 5) from region)"


@query(f"with recursive {_RING}, {CLOSURE_SQL.format(edges='ring')} select src, dst from clo")
def cyclic_closure(t):
    around = t.region.select(key("region", "r_regionkey").alias("src"), key("region", (F.col("r_regionkey") + 1) % 5).alias("dst"))
    up = t.nation.select(key("nation", "n_nationkey").alias("src"), key("region", "n_regionkey").alias("dst"))
    return hier.closure(t.customer.select(key("customer", "c_custkey").alias("src"), key("nation", "c_nationkey").alias("dst")).union(up).union(around)).select("src", "dst")


@query(f"with {ENTITIES_SQL}, {PARENTS_SQL} select id, exists (select 1 from par where src = id) as has_parents, exists (select 1 from par where dst = id) as has_children from ent")
def hierarchy_flags(t):
    return hier.hierarchy_flags(entities(t), _parents(t))


@query(f"with {ENTITIES_SQL}, {PARENTS_SQL} select id, label, id not in (select dst from par) as orphan from ent where id not in (select src from par)")
def roots_and_orphans(t):
    top = hier.roots(entities(t), _parents(t))
    return hier.marked(top, _parents(t).select(F.col("dst").alias("id")), "kids").select("id", "label", (~F.col("kids")).alias("orphan"))


@query("select 'customer:' || c_custkey as id, c_name as label, (select count(*) from customer where c_nationkey = 3) as total from customer where c_nationkey = 3 order by id limit 20 offset 5")
def children_page(t):
    """A page of a node's children is the feature here."""
    kids = graph.step(edges(t, "directParent"), ["directParent"], incoming=True).where((F.col("id") == "nation:3") & F.col("other").startswith("customer:"))
    named = kids.select(F.col("id").alias("node"), F.col("other").alias("id")).join(entities(t).select("id", "label"), "id")
    totals = kids.groupBy(F.col("id").alias("node")).agg(F.count(F.lit(1)).alias("total"))
    return search.page(named, 5, 20, [F.col("id")]).join(totals, "node").select("id", "label", "total")


@query("select 'part:' || l_partkey as id, count(distinct l_orderkey) as related_from from lineitem group by 1")
def related_terms_by_property(t):
    return graph.step(edges(t, "contains"), ["contains"], incoming=True).groupBy("id").agg(F.count(F.lit(1)).alias("related_from"))


@query("""with f as (select p_partkey from part where p_size = 7)
select distinct 'part:' || p_partkey as focus, 'part:' || p_partkey as src, 'supplier:' || l_suppkey as dst, 'supplied_by' as edge_type from f join lineitem on l_partkey = p_partkey
union all select 'part:' || f.p_partkey, 'part:' || f.p_partkey, 'type:' || p_type, 'directParent' from f join part using (p_partkey)
union all select distinct 'part:' || p_partkey, 'order:' || l_orderkey, 'part:' || p_partkey, 'contains' from f join lineitem on l_partkey = p_partkey""")
def neighbourhood_graph(t):
    focus = t.part.where("p_size = 7").select(key("part", "p_partkey").alias("id"))
    return graph.neighbourhood(edges(t, "directParent", "contains", "supplied_by"), focus, ["directParent", "supplied_by"], ["contains"])


@query(f"""with recursive ups as (select 'nation:' || n_nationkey as src, 'region:' || n_regionkey as dst from nation union all select 'customer:' || c_custkey, 'nation:' || c_nationkey from customer),
walk as (select 'region:' || r_regionkey as id, 'region:' || r_regionkey as path, '#' as parent_id, 1 as depth from region
union all select src, path || ';' || src, base64(encode(path)), depth + 1 from walk join ups on dst = id)
select id, base64(encode(path)) as node_id, parent_id, cast(depth as bigint) as depth from walk""")
def jstree_paths(t):
    nodes = entities(t).where(F.col("kind").isin("region", "nation", "customer"))
    up = _parents(t).where(F.col("src").startswith("nation:") | F.col("src").startswith("customer:"))
    return graph.js_tree(nodes, up)


@query(f"with recursive {PARENTS_SQL}, {_CLO} select src as id, dst as type_id from clo where src like 'order:%'")
def all_types_of_individual(t):
    typed = edges(t, "directParent").withColumn("edge_type", F.when(F.col("src").startswith("order:"), "rdf:type").otherwise("rdfs:subClassOf"))
    return graph.reach(typed, ["rdf:type", "rdfs:subClassOf"]).where(F.col("id").startswith("order:")).select("id", F.col("other").alias("type_id"))


@query("""with recursive cells as (select conv_id || ' ' || turn as id, conv_id || ' ' || (turn + 1) as rest from conversations),
walk as (select c.id, c.id as head, 0 as pos from cells c where c.id not in (select rest from cells) union all select n.id, w.head, pos + 1 from walk w join cells c on c.id = w.id join cells n on n.id = c.rest)
select id, head, cast(pos as bigint) as pos from walk""")
def rdf_list_eval(t):
    name = lambda turn: F.concat_ws(" ", "conv_id", turn)
    cells = t.conversations.select(name("turn").alias("id"), name(F.col("turn") + 1).alias("rest"))
    there = cells.select(F.col("id").alias("rest"), F.lit(True).alias("there"))
    linked = cells.join(there, "rest", "left").select("id", F.when(F.col("there"), F.col("rest")).alias("rest"))
    return hier.list_positions(linked)


# --- search -----------------------------------------------------------------------------------------------------------


@query(f"with {ENTITIES_SQL} select type as value, onto, count(*) as n from ent group by 1, 2")
def type_statistics(t):
    return entities(t).groupBy(F.col("type").alias("value"), "onto").agg(F.count(F.lit(1)).alias("n"))


@query("""select 'event_type' as field, event_type as value, count(*) as n from events where value >= 250 group by 2
union all select 'high', 'true', count(*) from events where value >= 250""")
def faceted_events(t):
    rows = t.events.select(F.col("event_id").alias("id"), "event_type", (F.col("value") >= 250).cast("string").alias("high"), F.lit("x").alias("label"))
    spec = search.SearchSpec(filters={"high": ["true"], "event_type": ["click", "view"]}, facets=("event_type",))
    counts = search.facets(rows, spec)
    return counts.union(search.facets(rows.where("high = 'true'"), search.SearchSpec(facets=("high",))))


@query("select o_orderkey as id, o_orderstatus as status, o_orderpriority as priority from orders where lower(o_orderpriority) in ('1-urgent', '2-high') and lower(o_orderstatus) in ('o', 'p')")
def dynamic_filter_entities(t):
    params = search.dynamic_filters({"o_orderpriority": ["1-urgent,2-HIGH"], "o_orderstatus": ["o,p"], "page": ["0"]}, include_obsolete=True)
    rows = t.orders
    for name, repeats in params.items():
        for values in repeats:
            rows = search.filtered(rows, {name: values}, fold=True)
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


_TOK = r"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


@query(f"""with s as (select doc_id as id, {_TOK.format(c='text')} as tok, lang, source from documents),
m as (select id, case when list_contains(tok, 'the') and list_contains(tok, 'that') then 5.0 else 0.0 end as hit, case when lang = 'en' then 10.0 else 0.0 end + case when source = 'src3' then 2.0 else 0.0 end as boost from s)
select id, cast(hit + boost as double) as score from m where hit > 0 order by score desc, id limit 50""")
def ranked_search_documents(t):
    """A page of ranked hits is the feature here."""
    docs = t.documents.select(F.col("doc_id").alias("id"), "text", "lang", "source")
    spec = search.SearchSpec("the that", fields=(("text", 5.0, search.LOWER_TOKENS),), boosts=(("lang", "en", 10.0, search.WHOLE), ("source", "src3", 2.0, search.WHOLE)), rows=50)
    return search.page(search.search(docs, spec).select("id", "score"), 0, spec.rows)


def _indexed(docs: DataFrame, spec: search.SearchSpec) -> textindex.TextIndex:
    return textindex.write(docs, textindex.kinds_for(spec), f"{shared_dir(docs.sparkSession)}/index-{uuid.uuid4().hex}")


@query(f"""with s as (select doc_id as id, {_TOK.format(c='text')} as tok, {_TOK.format(c='source')} as src, lang from documents),
m as (select id, lang, case when list_contains(tok, 'the') then 5.0 when list_contains(src, 'the') then 3.0 else 0.0 end as a,
case when list_contains(tok, 'src3') then 5.0 when list_contains(src, 'src3') then 3.0 else 0.0 end as b from s)
select id, cast(a + b + case when lang = 'en' then 10.0 else 0.0 end as double) as score from m where a > 0 and b > 0""")
def indexed_search(t):
    """Every word in some field, from postings that this query writes first."""
    docs = t.documents.select(F.col("doc_id").alias("id"), "text", "lang", "source")
    fields = (("text", 5.0, search.LOWER_TOKENS), ("source", 3.0, search.LOWER_TOKENS))
    spec = search.SearchSpec("The SRC3", fields=fields, boosts=(("lang", "en", 10.0, search.WHOLE),), combine=search.EVERY)
    return _indexed(docs, spec).search(docs, spec).select("id", "score")


@query(r"""with s as (select doc_id as id, lower(text) as v from documents)
select id, cast(2.0 + case when regexp_matches(v, '(^|[^\p{L}\p{N}])of[^\p{L}\p{N}]+the([^\p{L}\p{N}]|$)') then 10.0 else 0.0 end as double) as score
from s where regexp_matches(v, '(^|[^\p{L}\p{N}])of([^\p{L}\p{N}]|$)') and regexp_matches(v, '(^|[^\p{L}\p{N}])the([^\p{L}\p{N}]|$)')""")
def phrase_search(t):
    """Both words anywhere, raised where they stand in a row; positions of postings tell."""
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    spec = search.SearchSpec("of the", fields=(("text", 2.0, search.LOWER_TOKENS),), boosts=(("text", None, 10.0, search.PHRASE),))
    return _indexed(docs, spec).search(docs, spec).select("id", "score")


@query("""select p_brand as brand, p_partkey as id, p_retailprice as score, cast(row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) - 1 as integer) as place
from part qualify place <= 7""")
def expanded_groups(t):
    """The best part of each brand and seven more: the first of a group are the feature here."""
    parts = t.part.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    return search.expanded(parts, "brand", 7)


@query("select p_partkey as id, p_name as label from part where p_name = (select min(p_name) from part)")
def exact_match_lookup(t):
    wanted = t.part.agg(F.min("p_name")).first()[0]
    parts = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    spec = search.SearchSpec(wanted, exact=True, fields=(("label", 1.0, search.LOWER_TOKENS),))
    return search.search(parts, spec).select("id", "label")


@query(r"""with l as (select p_name as label, lower(p_name) as low, list_filter(regexp_split_to_array(lower(p_name), '[^\p{L}\p{N}]+'), lambda w: starts_with(w, 'b')) as hit from part)
select label, cast(max(case when low = 'b' then 10.0 when starts_with(low, 'b') then 2.0 else 1.0 end) as double) as score from l where len(hit) > 0 or starts_with(low, 'b') group by 1""")
def suggest_labels(t):
    return search.suggest(t.part, "b", "p_name")


@query("""select p_name as iri, p_partkey as id, p_brand as brand, cast(p_size as double) as score from part
qualify row_number() over (partition by p_name order by p_size desc, p_partkey) = 1""")
def collapse_by_iri(t):
    rows = t.part.select(F.col("p_name").alias("iri"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("score"))
    return search.collapsed(rows, "iri")


@query(f"""select doc_id as id, regexp_replace(text, '(?i)(with|from)', '<b>\\1</b>', 'g') as text_autosuggest from documents
where list_contains({_TOK.format(c='text')}, 'with') and list_contains({_TOK.format(c='text')}, 'from')""")
def select_intersection_highlight(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    hits = docs.where(search.matches(docs, "text", "with from", search.LOWER_TOKENS))
    return hits.select("id", text.highlighted(F.col("text"), ["with", "from"]).alias("text_autosuggest"))


@query(f"with recursive {ENTITIES_SQL}, {PARENTS_SQL}, {_CLO} select id, label from ent where id in (select src from clo where dst in ('nation:3', 'region:1')) or id in ('nation:3', 'region:1')")
def subtree_search_inclusive(t):
    pairs = hier.closure(_parents(t))
    return search.subtree(entities(t).select("id", "label"), pairs, ["nation:3", "region:1"], inclusive=True)


@query("""select 'o_orderstatus' as field, o_orderstatus as value, count(*) as n from orders where o_totalprice > 1000 group by 2
union all select 'o_orderpriority', o_orderpriority, count(*) from orders where o_totalprice > 1000 group by 2""")
def flat_facets(t):
    rows = t.orders.where("o_totalprice > 1000").withColumn("id", F.col("o_orderkey"))
    return search.facets(rows, search.SearchSpec(facets=("o_orderstatus", "o_orderpriority")))


@query(f"with {ENTITIES_SQL} select id, rank from (select id, 0 as rank from ent where id in ('part:7', 'zzz') union all select id, case when label = (select min(p_name) from part) then 1 end from ent where label = (select min(p_name) from part) and kind = 'part')")
def id_cascade_lookup(t):
    wanted = t.part.agg(F.min("p_name").alias("wanted")).union(t.part.where("p_partkey = 7").select(key("part", "p_partkey").alias("wanted")))
    return graph.by_cascade(entities(t).where(F.col("kind") == "part"), wanted, ["id", "label"]).select("id", "rank")


# --- strings and derived properties -----------------------------------------------------------------------------------


@query(r"""select page_id, regexp_extract(url, '([^/#]*)$', 1) as short_form, regexp_replace(replace(regexp_extract(url, '([^/#]*)$', 1), '?page=', '_'), '_(\d+)$', ':\1') as curie, translate(lower(url), '.-_/', '') as normal from pages""")
def short_forms_curies(t):
    short = text.local_name(F.col("url"))
    marked = F.replace(short, F.lit("?page="), F.lit("_"))
    return t.pages.select("page_id", short.alias("short_form"), text.curie(marked).alias("curie"), text.normal_prefix(F.col("url")).alias("normal"))


@query("""select doc_id as id, coalesce(case when lang = 'en' then source end, case when lang = 'de' then source || '@de' end, 'doc_' || doc_id) as label,
case when lang in ('en', 'de') then 1 else 2 end as rank from documents""")
def collate_labels_with_fallback(t):
    """Labels of documents: the untagged and English one, else one tagged German, else the short form."""
    nodes, own = _nodes(t.documents, F.col("doc_id"), "class"), F.col("lang")
    tagged = t.documents.where(own.isin("en", "de"))
    props = _props(tagged, F.col("doc_id"), V.LABEL, F.when(own == "de", F.concat("source", F.lit("@de"))).otherwise(F.col("source")), lang=own)
    shorts = nodes.select("ontology_id", "id", F.concat(F.lit("doc_"), "id").alias("short_form"))
    first = derive.labels(nodes, props, shorts).where("pos = 0")
    return first.select(F.col("id").cast("long").alias("id"), F.col("value").alias("label"), F.when(F.col("lang") == "", 2).otherwise(1).alias("rank"))


@query("""with l as (select source, lang, min(doc_id) as first_id from documents where lang is not null group by 1, 2),
r as (select *, case lang when 'de' then 1 when 'en' then 2 when 'fr' then 3 else 4 end as k from l)
select source, first_id, lang as used from r qualify row_number() over (partition by source order by k, first_id) = 1""")
def localise_with_fallback(t):
    each = t.documents.where("lang is not null").groupBy("source", "lang").agg(F.min("doc_id").alias("first_id"))
    k = F.when(F.col("lang") == "de", 1).when(F.col("lang") == "en", 2).when(F.col("lang") == "fr", 3).otherwise(4)
    best = each.groupBy("source").agg(F.min(F.struct(k.alias("k"), "first_id", "lang")).alias("b"))
    return best.select("source", "b.first_id", F.col("b.lang").alias("used"))


@query("""select 'part:' || p_partkey as id, array_to_string(list_sort([p_name, p_brand, p_type]), '|') as searchable_values from part
union all select 'customer:' || c_custkey, array_to_string(list_sort([c_name, c_mktsegment]), '|') from customer""")
def searchable_values(t):
    parts = [_props(t.part, key("part", "p_partkey"), c, F.col(c)) for c in ("p_name", "p_brand", "p_type")]
    named = [_props(t.customer, key("customer", "c_custkey"), c, F.col(c)) for c in ("c_name", "c_mktsegment")]
    nodes = _nodes(t.part, key("part", "p_partkey"), "class").union(_nodes(t.customer, key("customer", "c_custkey"), "class"))
    found = derive.searchable_values(nodes, reduce(DataFrame.union, [*parts, *named]))
    return found.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("searchable_values"))


@query("select 'order:' || o_orderkey as id, o_orderstatus = 'F' or o_totalprice < 1500 as is_obsolete from orders")
def obsolete_flags(t):
    orders, one = key("order", "o_orderkey"), t.orders
    said = _props(one.where("o_orderstatus = 'F'"), orders, V.DEPRECATED, F.lit("true"))
    below = _props(one.where("o_totalprice < 1500"), orders, V.SUBCLASS, F.lit(V.OBSOLETE_CLASS), "uri")
    return derive.obsolete(_nodes(one, orders, "individual"), said.union(below)).select("id", "is_obsolete")


@query("""with f as (select text, min(doc_id) as first_id from documents group by 1), s as (select doc_id as a, first_id as b from documents join f using (text) where doc_id <> first_id)
select a, b from s union select b, a from s""")
def symmetric_equivalence(t):
    """Each document states that it equals the first with its text; completion adds the other direction, not all pairs of a group."""
    digest = t.documents.where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    first = digest.groupBy("h").agg(F.min("doc_id").alias("b"))
    stated = _props(digest.join(first, "h").where("doc_id <> b"), F.col("doc_id"), V.OWL + "equivalentClass", F.col("b"), "uri")
    pairs = derive.equivalents(_nodes(t.documents, F.col("doc_id"), "class"), stated)
    return pairs.select(F.col("id").cast("long").alias("a"), F.col("value").cast("long").alias("b"))


@query("select distinct x.conv_id, x.role as a, y.role as b, x.turn as turn_a, y.turn as turn_b from conversations x join conversations y on x.conv_id = y.conv_id and x.turn <> y.turn and abs(x.turn - y.turn) = 1")
def pairwise_different(t):
    """Ordered pairs of neighbouring members of each list."""
    other = t.conversations.select("conv_id", F.col("role").alias("b"), F.col("turn").alias("turn_b"), F.explode(F.array(F.col("turn") - 1, F.col("turn") + 1)).alias("turn_a"))
    own = t.conversations.select("conv_id", F.col("role").alias("a"), F.col("turn").alias("turn_a"))
    return own.join(other, ["conv_id", "turn_a"]).select("conv_id", "a", "b", "turn_a", "turn_b").distinct()


@query("select 'customer:' || c_custkey as id from customer where c_custkey in (select o_custkey from orders)")
def has_individuals(t):
    nodes = _nodes(t.customer, key("customer", "c_custkey"), "class").union(_nodes(t.orders, key("order", "o_orderkey"), "individual"))
    return derive.has_individuals(nodes, _props(t.orders, key("order", "o_orderkey"), V.TYPE, key("customer", "o_custkey"), "uri")).select("id")


@query("select 'doc:' || doc_id as id, 'negativePropertyAssertion+toxic' as predicate, quality as value from labels where toxic = 1")
def negative_assertions(t):
    toxic, ax = t.labels.where("toxic = 1"), F.concat(F.lit("_:n"), F.col("doc_id").cast("string"))
    parts = [("sourceIndividual", key("doc", "doc_id"), "uri"), ("assertionProperty", F.lit("toxic"), "uri"), ("targetValue", F.col("quality"), "literal")]
    props = reduce(DataFrame.union, [_props(toxic, ax, V.OWL + p, v, kind) for p, v, kind in parts])
    return derive.negative_assertions(props).select("id", "predicate", F.col("value").cast(dict(t.labels.dtypes)["quality"]).alias("value"))


@query("""select 'order:' || o_orderkey as id, count(l_orderkey) as n_axioms, coalesce(array_to_string(list_sort(list_distinct(list(l_returnflag) filter (l_returnflag is not null))), '|'), '') as flags
from orders left join lineitem on l_orderkey = o_orderkey group by 1""")
def reified_axioms_fold(t):
    """Each lineitem as an axiom on its order's one value."""
    fields = [(V.OWL + "annotatedSource", key("order", "l_orderkey")), (V.OWL + "annotatedProperty", F.lit("p")), (V.OWL + "annotatedTarget", F.lit("v")), ("flag", F.col("l_returnflag"))]
    rows = t.lineitem.withColumn("k", F.monotonically_increasing_id()).select("k", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), v.alias("v")) for p, v in fields])).alias("x"))
    said = _props(rows, F.concat(F.lit("_:a"), F.col("k").cast("string")), F.col("x.p"), F.col("x.v")).withColumn("kind", F.when(F.col("predicate").endswith("Source") | F.col("predicate").endswith("Property"), "uri").otherwise("literal"))
    folded = derive.reified(_props(t.orders, key("order", "o_orderkey"), "p", F.lit("v")), derive.axioms(said))
    flags = F.array_sort(F.array_distinct(F.flatten(F.transform("axioms", lambda m: m["flag"]))))
    return folded.select("id", F.coalesce(F.size("axioms"), F.lit(0)).cast("long").alias("n_axioms"), F.coalesce(F.array_join(flags, "|"), F.lit("")).alias("flags"))


# --- linking ----------------------------------------------------------------------------------------------------------


def _definitions(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_name").alias("iri"), F.col("p_brand").alias("ontology_id"), F.lit("class").alias("type"))


@query("select p_name as iri, count(distinct p_brand) as n_definitions, string_agg(distinct p_brand, '|' order by p_brand) as appears_in from part group by 1")
def definitions_index(t):
    return link.definitions(_definitions(t)).select("iri", "n_definitions", F.array_join("appears_in", "|").alias("appears_in"))


@query("""with d as (select p_name as iri, min(p_brand) as definer from part group by 1)
select distinct p_brand as ontology_id, definer as imports_from from part join d on iri = p_name where p_brand <> definer""")
def import_export_pairs(t):
    rows = _definitions(t)
    return link.import_pairs(rows, rows.groupBy("iri").agg(F.min("ontology_id").alias("ontology_id")))


@query(r"""with g as (select page_id, regexp_extract_all(url || ' ' || html, '[A-Z]+:[0-9A-z]+', 0) as a, regexp_extract_all(url || ' ' || html, '[A-z]+://[^\s]+', 0) as b from pages)
select distinct page_id, unnest(list_concat(a, b)) as s from g""")
def gathered_strings(t):
    return link.gathered(t.pages.select("page_id", F.concat_ws(" ", "url", "html").alias("s")), "page_id", "s")


@query(r"""with p as (select source, url as v from documents join pages on doc_id = page_id),
parts as (select source, unnest(list_concat(regexp_extract_all(v, '[A-Z]+:[0-9A-z]+', 0), regexp_extract_all(v, '[A-z]+://[^\s]+', 0))) as s from p)
select source as ontology_id, v as s from p union select source, s from parts union select source, 'http://x/address' from p""")
def gathered_values(t):
    """What the addresses of pages may refer to, by the source of the document with the page's id."""
    rows = t.documents.select("doc_id", "source").join(t.pages.select(F.col("page_id").alias("doc_id"), "url"), "doc_id")
    props = _props(rows, F.col("doc_id"), F.lit("seen+http://x/address"), F.col("url"))
    return link.gathered_values(props.join(rows.select(F.col("doc_id").cast("string").alias("id"), "source"), "id").drop("ontology_id").withColumnRenamed("source", "ontology_id"))


_REGISTRY = r"""reg as (select distinct regexp_extract(url, '^https?://[^/]+/', 0) as uri_prefix, 'h' || length(regexp_extract(url, '^https?://[^/]+/', 0)) as prefix from pages
union select distinct regexp_extract(url, '^https?://[^/]+/[^/?#]+/', 0), 's' || length(regexp_extract(url, '^https?://[^/]+/[^/?#]+/', 0)) from pages where regexp_matches(url, '^https?://[^/]+/[^/?#]+/'))"""


def _registry(t: Tables) -> DataFrame:
    host, section = F.regexp_extract("url", "^https?://[^/]+/", 0), F.regexp_extract("url", "^https?://[^/]+/[^/?#]+/", 0)
    rows = [t.pages.select(p.alias("uri_prefix"), F.concat(F.lit(mark), F.length(p).cast("string")).alias("prefix")) for p, mark in ((host, "h"), (section, "s"))]
    return rows[0].union(rows[1]).where("uri_prefix <> ''").distinct()


@query(f"with {_REGISTRY} select url, arg_max(prefix, length(uri_prefix)) || ':' || substring(url, max(length(uri_prefix)) + 1) as curie from (select distinct url from pages) join reg on starts_with(url, uri_prefix) where uri_prefix <> '' group by url")
def longest_prefix_curie(t):
    return link.url_to_curie(t.pages.select("url"), "url", _registry(t))


@query("""select p_name as iri, p_partkey as id, p_brand as ontology_id from part
qualify row_number() over (partition by p_name order by case when p_size > 40 then 0 else 1 end, p_brand, p_partkey) = 1""")
def link_precedence(t):
    rows = t.part.select(F.col("p_name").alias("iri"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("ontology_id"), F.when(F.col("p_size") > 40, 0).otherwise(1).alias("k"))
    return link.by_precedence(rows, "iri", [F.col("k"), F.col("ontology_id"), F.col("id")]).select("iri", "id", "ontology_id")


_XREFS = "xs as (select url as x from pages union select p_brand || ':' || p_size || ':x' from part union select p_name from part)"


@query(rf"""with {_XREFS} select x as value, case when regexp_matches(x, '^https?:') then null when regexp_matches(x, '^[A-Z]+:.+://') or strpos(x, ':') = 0 then null else split_part(x, ':', 1) end as database,
case when regexp_matches(x, '^https?:') or regexp_matches(x, '^[A-Z]+:.+://') or strpos(x, ':') = 0 then x else split_part(x, ':', 2) end as id, case when regexp_matches(x, '^https?:') then x end as url from xs""")
def xref_parse(t):
    """Addresses of pages, names of parts, and their brands and sizes as accessions, each once."""
    brands = F.concat("p_brand", F.lit(":"), F.col("p_size").cast("string"), F.lit(":x"))
    values = t.pages.select(F.col("url").alias("value")).union(t.part.select(brands)).union(t.part.select("p_name")).distinct()
    return values.select("value", text.xref(F.col("value")).alias("x")).select("value", "x.*")


# --- exports and merges -----------------------------------------------------------------------------------------------


@query("""select event_id as id, 'kind' as field, 0 as pos, event_type as value from events
union all select event_id, 'http__//x/k', 0, props->>'$.k' from events union all select event_id, 'both', 0, 'a' from events union all select event_id, 'both', 1, event_type from events""")
def nested_search_values(t):
    """Events as nested documents: a plain object holds nothing to search, wrapped values count, lists keep their order."""
    literal = lambda v: F.concat(F.lit('{"type":["literal"],"value":'), v, F.lit("}"))
    kind, k = F.concat(F.lit('"'), "event_type", F.lit('"')), F.get_json_object("props", "$.k")
    wrapped = F.concat(F.lit('{"type":["reification"],"axioms":[],"value":'), literal(k), F.lit("}"))
    doc = F.concat(F.lit('{"kind":'), kind, F.lit(',"plain":'), "props", F.lit(',"http://x/k":'), wrapped, F.lit(',"both":["a",'), literal(kind), F.lit("]}"))
    return nested.search_values(t.events.select(F.col("event_id").alias("id"), doc.alias("doc")))


@query("select event_id, event_type, props->>'$.k' as k, cast(props->>'$.k' as integer) % 2 = 0 as even from events")
def json_flatten(t):
    k = F.get_json_object("props", "$.k")
    return t.events.select("event_id", "event_type", k.alias("k"), (k.cast("int") % 2 == 0).alias("even"))


@query(f"""with {ENTITIES_SQL}, {PARENTS_SQL} select a.onto || '+' || a.type || '+' || src as src, 'directParent' as edge_type, b.onto || '+' || b.type || '+' || dst as dst
from par join ent a on a.id = src join ent b on b.id = dst""")
def edges_export(t):
    nodes = entities(t).select("id", export.entity_id(F.col("onto"), F.col("type"), F.col("id")).alias("node_id"))
    rows = edges(t, "directParent")
    a, b = nodes.select(F.col("id").alias("src"), F.col("node_id").alias("s")), nodes.select(F.col("id").alias("dst"), F.col("node_id").alias("d"))
    return rows.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), "edge_type", F.col("d").alias("dst"))


@query("""select 'x+class+' || c_custkey as "id:ID", 'class' as ":LABEL", '{}' as _json, c_name || '|' || c_mktsegment || '|' || c_nationkey || '|' || c_custkey as "http__//t/name:string[]",
c_mktsegment as "de+http__//t/name:string[]", c_custkey::varchar as "fr+http__//t/name:string[]" from customer""")
def node_columns(t):
    """Four values of a name, three of them in other languages: a language's column has its first."""
    said = [(0, "c_name", ""), (1, "c_mktsegment", "de"), (2, "c_nationkey", "de"), (3, "c_custkey", "fr")]
    props = reduce(DataFrame.union, [_props(t.customer, F.col("c_custkey"), "http://t/name", F.col(c), lang=F.lit(lang)).withColumn("pos", F.lit(pos)) for pos, c, lang in said])
    nodes = _nodes(t.customer, F.col("c_custkey"), "class")
    kinds = export.entity_types(nodes)
    return export.graph_nodes(props, kinds, nodes.select("ontology_id", "id", F.lit("{}").alias("json")), "class")


@query("""select 'x+individual+o:' || l_orderkey as ":START_ID", 'http://t/part' as ":TYPE", 'x+class+p:' || l_partkey as ":END_ID",
'{"http://t/line":["' || l_linenumber || '"],"http://t/state":["' || l_returnflag || '|","' || l_linestatus || '"]}' as _json,
l_linenumber::varchar as "http__//t/line:string[]", l_returnflag || '\\u007C|' || l_linestatus as "http__//t/state:string[]"
from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey""")
def edge_columns(t):
    """Orders have parts; a line's number and states are what axioms say of the edge."""
    line = F.create_map(F.lit("http://t/line"), F.array(F.col("l_linenumber").cast("string")), F.lit("http://t/state"), F.array(F.concat("l_returnflag", F.lit("|")), "l_linestatus"))
    named = t.lineitem.select(key("o", "l_orderkey").alias("id"), key("p", "l_partkey").alias("value"), F.array(line).alias("axioms"))
    rows = named.select(F.lit("x").alias("ontology_id"), "id", F.lit("http://t/part").alias("predicate"), F.lit("uri").alias("kind"), "value", "axioms")
    nodes = _nodes(t.orders, key("o", "o_orderkey"), "individual").union(_nodes(t.part, key("p", "p_partkey"), "class"))
    return export.edge_rows(export.graph_edges(rows, export.entity_types(nodes)))


_LINKED_SQL = """with kept as (select l.*, s_acctbal < 0 as again from lineitem l join supplier on s_suppkey = l_suppkey where s_acctbal <= 9000 and (s_acctbal >= 0 or l_quantity > 25)),
ent as (select distinct 's' || l_suppkey as o, 'p' || l_partkey as iri, case when l_linestatus = 'F' then 'S' || l_suppkey || ':' || l_partkey else 'p_' || l_partkey end as curie from kept),
base as (select distinct 's' || s_suppkey as o, case when s_acctbal < 0 then 'p1' else 'p' end || s_suppkey as b from supplier where s_acctbal <= 9000),
def as (select distinct 'p' || l_partkey as iri, 's' || l_suppkey as o from kept where l_returnflag = 'R' union select iri, ent.o from ent join base on ent.o = base.o and starts_with(iri, b))"""


def _merged_links(t: Tables, *told: str) -> linkdelta.Links:
    """Suppliers are ontologies of the parts in their lines. All are loaded; then those in debt again with their larger lines, and the richest are taken away.

    A line that came back says that its supplier defines the part, and so does a supplier's number at the front of a part's.
    ``told`` names what is asked for besides IRIs: type and curie.
    """
    rows = t.lineitem.select("l_suppkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    name, of = (lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))), t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    curie = F.when(F.col("l_linestatus") == "F", F.concat(name("S", "l_suppkey"), name(":", "l_partkey"))).otherwise(name("p_", "l_partkey"))

    def linked(lines: DataFrame, suppliers: DataFrame, base: str) -> linkdelta.Linked:
        own = [name("s", "l_suppkey").alias("ontology_id"), name("p", "l_partkey").alias("iri")]
        tops = suppliers.select(own[0], name("http://s/", "l_suppkey").alias("iri"))
        said = lines.where("l_returnflag = 'R'").select(*own, name("http://s/", "l_suppkey").alias("of"))
        return linkdelta.Linked(lines.select(*own, F.lit("class").alias("type"), curie.alias("curie")).select("ontology_id", "iri", *told), said, tops, suppliers.select(own[0], name(base, "l_suppkey").alias("base")))

    old, poor = linked(rows, of, "p"), of.where("s_acctbal < 0")
    changed = of.where("s_acctbal < 0 or s_acctbal > 9000").select(name("s", "l_suppkey").alias("ontology_id"))
    fresh = linked(rows.join(small(poor.select("l_suppkey")), "l_suppkey", "left_semi").where("l_quantity > 25"), poor, "p1")
    return linkdelta.merged(linkdelta.links(old), old, old.replaced(changed, fresh), changed)


@query(f"""{_LINKED_SQL} select u.o as ontology_id, d.o as imports_from, count(*) as n from (select distinct iri, o from ent) u join def d on u.iri = d.iri
where not exists (select 1 from def x where x.iri = u.iri and x.o = u.o) group by 1, 2""")
def incremental_imports(t):
    return _merged_links(t).imports


@query(f"""{_LINKED_SQL}, who as (select iri, string_agg(distinct o, '|' order by o) as appears_in, count(distinct o) as n_definitions from ent group by 1),
by_ as (select iri, string_agg(o, '|' order by o) as defined_by from def group by 1),
one as (select ent.iri, arg_min(curie, (case when def.o is null then 1 else 0 end, case when contains(curie, ':') then 0 else 1 end, ent.o, curie)) as curie from ent left join def on ent.iri = def.iri and ent.o = def.o group by 1)
select who.iri, n_definitions, appears_in, defined_by, curie from who left join by_ using (iri) left join one using (iri)""")
def incremental_links(t):
    by = F.when(F.size("definers") > 0, F.array_join("definers", "|")).alias("defined_by")
    return _merged_links(t, "type", "curie").whole.select("iri", "n_definitions", F.array_join("appears_in", "|").alias("appears_in"), by, "curie")


@query("""with open_ as (select distinct o_custkey from orders where o_orderstatus = 'O')
select o_custkey as ontology_id, o_orderkey as id, case when o_custkey in (select o_custkey from open_) then 'new' else 'old' end as load from orders""")
def incremental_merge(t):
    """An old load of all orders by customer; customers with an open order are loaded again."""
    rows = t.orders.select(F.col("o_custkey").alias("ontology_id"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    again = rows.join(rows.where("o_orderstatus = 'O'").select("ontology_id").distinct(), "ontology_id", "left_semi").drop("o_orderstatus")
    return export.merged(rows.drop("o_orderstatus").withColumn("load", F.lit("old")), again.withColumn("load", F.lit("new")))


@query(f"with {ENTITIES_SQL} select onto as ontology_id, count(*) filter (type = 'class') as classes, count(*) filter (type = 'individual') as individuals, count(*) as entities from ent group by 1")
def counters(t):
    iri = F.when(F.col("type") == "class", V.OWL + "Class").otherwise(V.NAMED_INDIVIDUAL)
    said = entities(t).select(F.col("onto").alias("ontology_id"), F.lit(False).alias("s_bnode"), F.lit(V.TYPE).alias("p"), iri.alias("o"), F.lit("").alias("lang"))
    return derive.counters(said).select("ontology_id", "classes", "individuals", "entities")


@query("""select user_id, event_type as name, array_to_string(list_sort(list_distinct(list(props->>'$.k'))), '|') as vals from events group by 1, 2""")
def annotation_map(t):
    k = F.get_json_object("props", "$.k")
    props = _props(t.events, F.col("user_id"), F.concat(F.lit("http://notes/"), "event_type"), k)
    names = t.events.select(F.lit("x").alias("ontology_id"), F.concat(F.lit("http://notes/"), "event_type").alias("id"), F.col("event_type").alias("label")).distinct()
    found = shape.annotations(props, names, ()).select(F.col("id").cast("long").alias("user_id"), F.explode("annotations").alias("name", "values"))
    return found.select("user_id", "name", F.array_join(F.array_sort("values"), "|").alias("vals"))


@query("""with u as (select p_brand as prefix, p_type || '/' || p_size as namespace, min(p_partkey) as seen, count(*) as n from part group by 1, 2),
r as (select *, row_number() over (partition by prefix order by seen, namespace) as rank from u),
o as (select namespace, arg_min(prefix, (seen, prefix)) as owner from r where rank = 1 group by 1),
f as (select namespace, arg_min(prefix, (seen, prefix)) as base, min(seen) as seen from r where rank > 1 and namespace not in (select namespace from o) group by 1),
g as (select namespace, base || '_' || (1 + row_number() over (partition by base order by seen, namespace)) as given from f)
select prefix, namespace, case when rank = 1 then prefix else coalesce(owner, given) end as name, n from r left join o using (namespace) left join g using (namespace)""")
def curie_map_allocation(t):
    space = F.concat("p_type", F.lit("/"), F.col("p_size").cast("string"))
    return mapping.allocated_prefixes(t.part.select(F.col("p_brand").alias("prefix"), space.alias("namespace"), F.col("p_partkey").alias("seen")))


@query("""select distinct 'part:' || l_partkey as subject_id, p_name as subject_label, 'skos:exactMatch' as predicate_id, 'supplier:' || l_suppkey as object_id, s_name as object_label, 'semapv:UnspecifiedMatching' as mapping_justification
from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey""")
def sssom_mappings(t):
    props = edges(t, "supplied_by").select(F.lit("x").alias("ontology_id"), F.col("src").alias("id"), F.col("edge_type").alias("predicate"), F.col("dst").alias("value"))
    named = entities(t).where(F.col("kind").isin("part", "supplier")).select(F.lit("x").alias("ontology_id"), "id", "label", F.col("id").alias("curie"), F.lit(None).cast("string").alias("url"))
    linked = named.select("ontology_id", F.col("id").alias("s"), F.col("id").alias("iri"), "url", "curie", "label")
    rows, _ = mapping.mappings(props, named, linked, {"supplied_by": "skos:exactMatch"}, {}, {})
    return rows.drop("ontology_id")


@query("select 'region:' || r_regionkey as id, r_name in (select max(r_name) from region union all select min(r_name) from region) as is_preferred_root from region")
def preferred_roots(t):
    regions = _nodes(t.region, key("region", "r_regionkey"), "class")
    ends = t.region.agg(F.array(F.max_by("r_regionkey", "r_name"), F.min_by("r_regionkey", "r_name")).alias("k"))
    config = ends.select(F.lit("x").alias("ontology_id"), F.transform("k", lambda k: F.concat(F.lit("region:"), k.cast("string"))).alias("preferred_root_term"))
    none = _props(t.region.where("false"), key("region", "r_regionkey"), V.LABEL, F.col("r_name"))
    return derive.preferred_roots(regions, none, config).select("id", "is_preferred_root")


@query("select 'part:' || p_partkey as id, 'label' as field, p_name as label from part union all select 'part:' || p_partkey, 'synonym', p_brand || ' ' || p_name from part")
def autocomplete_rows(t):
    pair = F.array(F.struct(F.lit("label").alias("field"), F.col("p_name").alias("label")), F.struct(F.lit("synonym").alias("field"), F.concat_ws(" ", "p_brand", "p_name").alias("label")))
    return t.part.select(key("part", "p_partkey").alias("id"), F.explode(pair).alias("x")).select("id", "x.*")


@query(f"""with {ENTITIES_SQL}, {PARENTS_SQL} select a.onto || '+' || a.type || '+' || src as src, 'directParent' as edge_type, b.onto || '+' || b.type || '+' || dst as dst
from par join ent a on a.id = src join ent b on b.id = dst where a.onto = b.onto""")
def graph_edges(t):
    """Edges within an ontology, as the export of the property graph writes them."""
    kinds = entities(t).select(F.col("onto").alias("ontology_id"), "id", "type")
    up = edges(t, "directParent").select(F.col("src").alias("id"), "edge_type", "dst").join(kinds.select("id", "ontology_id"), "id")
    props = up.select("ontology_id", "id", F.col("edge_type").alias("predicate"), F.lit("uri").alias("kind"), F.col("dst").alias("value"))
    return export.graph_edges(props, kinds).select("src", "edge_type", "dst")


@query("select 'part:' || p_partkey as id, p_name as label from part union all select 'part:' || p_partkey, p_brand || ' ' || p_name from part")
def autocomplete_terms(t):
    names = _props(t.part, key("part", "p_partkey"), V.LABEL, F.col("p_name"))
    return export.autocomplete(names, _props(t.part, key("part", "p_partkey"), V.SYNONYMS[0], F.concat_ws(" ", "p_brand", "p_name"))).select("id", "label")


# --- derived properties in full ---------------------------------------------------------------------------------------


@query("""with r as (select source, doc_id, case coalesce(lower(lang), '') when 'de' then 0 when '' then 1 when 'en' then 2 end as k from documents),
b as (select source, min(k) as k from r where k is not null group by 1) select source as id, doc_id from r join b using (source, k)""")
def localised_values(t):
    """Documents of each source in German, else untagged, else in English."""
    props = _props(t.documents.where("source is not null"), F.col("source"), "text", F.col("doc_id"), lang=F.coalesce("lang", F.lit("")))
    return shape.localised(props, "de").select("id", F.col("value").cast("long").alias("doc_id"))


@query(f"with {PARENTS_SQL} select distinct src as id, dst as parent from par")
def direct_parents(t):
    kind = F.when(F.col("type") == "class", F.array(F.lit("class"))).otherwise(F.array(F.lit("individual")))
    nodes = entities(t).select(F.lit("x").alias("ontology_id"), "id", F.lit(False).alias("bnode"), kind.alias("types"), F.lit(False).alias("imported"))
    rule = F.when(F.col("src").startswith("order:"), V.TYPE).otherwise(V.SUBCLASS)
    return derive.direct_parents(nodes, _props(edges(t, "directParent"), F.col("src"), rule, F.col("dst"), "uri")).select("id", "parent")


@query(f"""select 'part:' || p_partkey as id, 'type:' || p_type as parent, cast(null as varchar) as relation from part
union all select 'part:' || p_partkey, 'brand:' || p_brand, '{V.PART_OF}' from part""")
def hierarchical_parents(t):
    ids = [(t.part, "part", "p_partkey"), (t.part.select("p_type").distinct(), "type", "p_type"), (t.part.select("p_brand").distinct(), "brand", "p_brand")]
    nodes = reduce(DataFrame.union, [_nodes(frame, key(kind, k), "class") for frame, kind, k in ids])
    props = _props(t.part, key("part", "p_partkey"), V.SUBCLASS, key("type", "p_type"), "uri")
    relations = _props(t.part, key("part", "p_partkey"), V.PART_OF, key("brand", "p_brand"), "uri").select("ontology_id", "id", F.col("predicate").alias("property"), "value")
    return derive.hierarchical_parents(nodes, props, relations).select("id", "parent", "relation")


@query("select 'part:' || p_partkey as id, unnest(['brand', 'type']) as predicate from part")
def used_predicates(t):
    props = reduce(DataFrame.union, [_props(t.part, key("part", "p_partkey"), n, F.col(f"p_{n}")) for n in ("name", "brand", "type")])
    return derive.used_predicates(_nodes(t.part, key("part", "p_partkey"), "class"), props, ("brand", "type")).select("id", "predicate")


@query("select 'part:' || p_partkey as id, 0 as pos, p_brand as value from part union all select 'part:' || p_partkey, 1, p_name from part")
def collated_definitions(t):
    """Two predicates of a definition as one list, by predicate."""
    said = _props(t.part, key("part", "p_partkey"), V.DEFINITIONS[0], F.col("p_name")).union(_props(t.part, key("part", "p_partkey"), V.DEFINITIONS[1], F.col("p_brand")))
    return derive.collated(_nodes(t.part, key("part", "p_partkey"), "class"), said, V.DEFINITIONS).select("id", "pos", "value")


@query("select p_partkey as id, 'CAT_' || p_partkey as short_form, 'CAT:' || p_partkey as curie from part")
def obo_short_forms(t):
    iri = F.concat(F.lit(V.OBO + "CAT_"), F.col("p_partkey").cast("string"))
    config = t.spark.range(1).select(F.lit("x").alias("ontology_id"), F.lit("CAT").alias("prefix"), F.lit(None).cast("array<string>").alias("base_uris"))
    found = derive.short_forms(_nodes(t.part, iri, "class"), config)
    return found.select(F.substring_index("id", "_", -1).cast("long").alias("id"), "short_form", "curie")


@query("select 'nation:' || x.n_nationkey as id, 'nation:' || y.n_nationkey as value from nation x join nation y on x.n_regionkey = y.n_regionkey and x.n_nationkey <> y.n_nationkey")
def pairwise_members(t):
    """The nations of each region as a list of all-different members."""
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    cells = t.nation.withColumn("k", place).withColumn("last", F.col("k") == F.count(F.lit(1)).over(Window.partitionBy("n_regionkey")))
    cell = lambda k: F.concat(F.lit("_:c"), F.col("n_regionkey").cast("string"), F.lit("-"), k.cast("string"))
    first = _props(cells, cell(F.col("k")), V.FIRST, key("nation", "n_nationkey"), "uri")
    rest = _props(cells, cell(F.col("k")), V.REST, F.when(F.col("last"), F.lit(V.NIL)).otherwise(cell(F.col("k") + 1)), "bnode")
    axiom = F.concat(F.lit("_:d"), F.col("n_regionkey").cast("string"))
    heads = cells.where("k = 1")
    props = first.union(rest).union(_props(heads, axiom, V.OWL + "distinctMembers", cell(F.lit(1)), "bnode"))
    return derive.pairwise(_nodes(heads, axiom, "allDifferent"), props).select("id", "value")


# --- links in full ----------------------------------------------------------------------------------------------------

_PART_ENTITIES = "pe as (select p_name as iri, p_brand as ontology_id, p_type as type, 'n' || p_size as label, case when p_partkey % 3 = 0 then 'P:' else 'P_' end || p_size as curie from part), de as (select distinct p_name as iri, p_brand as ontology_id from part where p_size > 40)"


def _part_entities(t: Tables) -> tuple[DataFrame, DataFrame]:
    size = F.col("p_size").cast("string")
    mark = F.when(F.col("p_partkey") % 3 == 0, "P:").otherwise("P_")
    rows = t.part.select(F.col("p_name").alias("iri"), F.col("p_brand").alias("ontology_id"), F.col("p_type").alias("type"), F.concat(F.lit("n"), size).alias("label"), F.concat(mark, size).alias("curie"))
    return rows, t.part.where("p_size > 40").select(F.col("p_name").alias("iri"), F.col("p_brand").alias("ontology_id")).distinct()


@query(f"""with {_PART_ENTITIES}, uses as (select distinct s.p_brand as ontology_id, a.p_name as iri from part a join part s on s.p_partkey = a.p_partkey + 1),
ea as (select iri, ontology_id, min(label) as label, min(curie) as curie, string_agg(distinct type, '|' order by type) as types, count(distinct type) as n from pe group by 1, 2),
em as (select ea.*, de.iri is not null as d from ea left join de using (iri, ontology_id)),
w as (select iri, sum(n) as num, count(*) filter (d) as n_def, string_agg(ontology_id, '|' order by ontology_id) filter (d) as definers, count(*) as n_all, min(ontology_id) as first_o, min(ontology_id) filter (d) as first_d from em group by 1)
select u.ontology_id, u.iri, case when n_def > 0 then definers when n_all = 1 then first_o end as defined_by, cast(num as bigint) as num_appears_in, own.iri is not null as has_local_definition,
shown.label, shown.curie, shown.types
from uses u join w using (iri) left join ea own on own.iri = u.iri and own.ontology_id = u.ontology_id
join ea shown on shown.iri = u.iri and shown.ontology_id = coalesce(first_d, own.ontology_id, first_o)""")
def linked_entity_payloads(t):
    """What an ontology (a brand) is told about each IRI it mentions, here the names of the parts numbered before its own."""
    rows, definers = _part_entities(t)
    after = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("ontology_id"))
    uses = t.part.select("p_partkey", F.col("p_name").alias("iri")).join(after, "p_partkey")
    told = link.payloads(uses, rows, definers)
    return told.withColumns({"defined_by": F.array_join("defined_by", "|"), "types": F.array_join("types", "|")})


@query(f"""with {_PART_ENTITIES}, good as (select iri, ontology_id, curie from pe join de using (iri, ontology_id) where curie like '%:%'),
best as (select iri, curie as fixed from good qualify row_number() over (partition by iri order by ontology_id, curie) = 1)
select iri, ontology_id, case when curie like '%:%' then curie else coalesce(fixed, curie) end as curie, count(*) as n from pe left join best using (iri) group by 1, 2, 3""")
def curies_repaired(t):
    fixed = link.repaired_curies(*_part_entities(t))
    return fixed.groupBy("iri", "ontology_id", "curie").agg(F.count(F.lit(1)).alias("n"))


@query(r"""with c as (select distinct p_brand || ':' || p_size as curie, p_brand as db, p_size as local from part), pats as (select p_brand as db, case when min(p_partkey) % 2 = 0 then '\d' else '\d+' end as pattern from part group by 1)
select curie, 'http://' || db || '/' || local || '/x' as url from c join pats using (db) where regexp_full_match(cast(local as varchar), pattern)""")
def curie_urls(t):
    """URLs of CURIEs whose local part fits the pattern of their prefix as a whole."""
    curies = t.part.select(F.concat_ws(":", "p_brand", F.col("p_size").cast("string")).alias("curie"))
    pattern = F.when(F.min("p_partkey") % 2 == 0, r"\d").otherwise(r"\d+")
    registry = t.part.groupBy(F.col("p_brand").alias("prefix")).agg(pattern.alias("pattern")).withColumn("uri_format", F.concat(F.lit("http://"), "prefix", F.lit("/$1/x")))
    return link.curie_to_url(curies, "curie", registry).select("curie", "url")


# --- the service's answers --------------------------------------------------------------------------------------------


def _service(t: Tables) -> Service:
    flags = hier.hierarchy_flags(entities(t), _parents(t))
    docs = entities(t).join(flags, "id").select(
        "id", F.col("id").alias("iri"), F.col("onto").alias("ontologyId"), F.array("type").alias("type"), F.array("label").alias("label"), F.replace("id", F.lit(":"), F.lit("_")).alias("shortForm"),
        F.col("label").startswith("small").alias("isObsolete"), F.col("has_parents").alias("hasDirectParents"), F.col("has_parents").alias("hasHierarchicalParents"),
        F.col("has_children").alias("hasDirectChildren"), F.col("has_children").alias("hasHierarchicalChildren"),
    )
    return Service(docs, edges(t, "directParent").withColumn("props", F.lit(None).cast("map<string,array<string>>")))


_BEGINS = r"len(list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: starts_with(w, 'b'))) > 0"


@query(f"""with {ENTITIES_SQL} select id, cast(100 + case when {_BEGINS.format(c="label")} then 500 else 0 end + case when {_BEGINS.format(c="id")} then 500 else 0 end as double) as score
from ent where onto = 'catalog' and type = 'class' and label not like 'small%' and len(list_filter(string_split(lower(label), ' '), lambda w: starts_with(w, 'b'))) > 0""")
def service_classes(t):
    return _service(t).entities("class", "catalog", "b").hits.select("id", "score")


@query(f"""with {ENTITIES_SQL} select 'onto' as field, onto as value, count(*) as n from ent where label not like 'small%' group by 2""")
def service_facets(t):
    """Counts of a facet that is also filtered: its own filter does not bear on it."""
    return _service(t).entities("entity", facets=("ontologyId",), ontologyId=["geo,sales"]).facets.select(F.lit("onto").alias("field"), "value", "n")


@query(f"with recursive {ENTITIES_SQL}, {PARENTS_SQL}, walk as (select 'region:1' as id union select src from walk join par on dst = id) select id, label from ent where id in (select id from walk) and id <> 'region:1'")
def service_descendants(t):
    return _service(t).related("class", "geo", "region:1", "descendants").select("id", F.col("label")[0].alias("label"))


@query(f"""with recursive {ENTITIES_SQL}, {PARENTS_SQL}, walk as (select 'nation:3' as id union select src from walk join par on dst = id)
select id, cast(10 as double) as score from ent where id in (select id from walk) and label not like 'small%' and lower(label) like 'order %'""")
def service_search(t):
    hits = _service(t).search("order", below=("nation:3",), inclusive=True, relation="directParent", group=True).hits
    return hits.select("id", "score")


@query(f"""with {ENTITIES_SQL} select id, cast(501 as double) as score, regexp_replace(label, '(?i)(ord|12)', '<b>\\1</b>', 'g') as label_autosuggest from ent
where label not like 'small%' and lower(label) like 'ord%' and lower(label) like '% 12%'""")
def service_select(t):
    return _service(t).select("ord 12").hits.select("id", "score", F.col("label_autosuggest")[0].alias("label_autosuggest"))


@query(f"with {ENTITIES_SQL}, {PARENTS_SQL} select id from ent where type = 'class' and onto = 'catalog' and id not in (select src from par) and label not like 'small%'")
def service_roots(t):
    return _service(t).roots("class", "catalog").select("id")


@query(f"with {ENTITIES_SQL} select type, count(*) as n from ent group by 1")
def service_stats(t):
    return _service(t).stats()


# --- display ----------------------------------------------------------------------------------------------------------


@query("""with recursive ups as (select 'nation:' || n_nationkey as src, 'region:' || n_regionkey as dst from nation union all select 'customer:' || c_custkey, 'nation:' || c_nationkey from customer),
walk as (select 'region:1' as id, 'region:1' as path, '#' as parent_id, 1 as depth union all select src, path || ';' || src, base64(encode(path)), depth + 1 from walk join ups on dst = id),
n as (select dst, count(*) as n from ups group by 1)
select id, base64(encode(path)) as node_id, parent_id, cast(depth as bigint) as depth, coalesce(n, 0) as n_below from walk left join n on dst = id""")
def preferred_root_tree(t):
    """The tree below the flagged root, with how many children each node has for its count."""
    nodes = entities(t).where(F.col("kind").isin("region", "nation", "customer")).select("id", (F.col("id") == "region:1").alias("preferred"))
    up = _parents(t).where(F.col("src").startswith("nation:") | F.col("src").startswith("customer:"))
    counts = up.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("num_descendants"))
    return display.tree(nodes.join(counts, "id", "left"), up, preferred="preferred")


@query("""with notes as (select l_orderkey as k, 'flag' as note, l_returnflag as v from lineitem union all select l_orderkey, 'status', l_linestatus from lineitem)
select 'order:' || k as id, note, string_agg(distinct v, '|' order by v) as vals from notes where v is not null group by 1, 2""")
def merged_axiom_notes(t):
    """Each lineitem of an order as an axiom on it; the axioms on an order show as one map."""
    note = F.create_map(F.lit("flag"), F.array("l_returnflag"), F.lit("status"), F.array("l_linestatus"))
    rows = t.lineitem.select(F.lit("o").alias("ontology_id"), key("order", "l_orderkey").alias("id"), F.lit("p").alias("predicate"), F.lit("v").alias("value"), F.array(note).alias("axioms"))
    return display.merged_axioms(rows).select("id", F.explode("annotations").alias("note", "vs")).select("id", "note", F.array_join("vs", "|").alias("vals"))
