"""An ontology as DataFrames, and the graph operators over it (ONT-01 to ONT-49).

Tables, of which only nodes and edges need to be given:
nodes(id, label, type, deprecated), edges(sub, pred, obj), synonyms(id, val, scope), xrefs(id, xref, source),
subsets(id, subset), props(id, pred, val), logical_defs(id, genus, restrictions), property_chains(pred, chain).
Every method gives a new DataFrame or Ontology; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from . import closure as C

IS_A, PART_OF, EQUIVALENT = "subClassOf", "BFO:0000050", "equivalentTo"
#: Relations along which a mapping to a subset is safe.
SLIM_RELATIONS = (IS_A, PART_OF, "subPropertyOf")
#: Steps up that are walked before a closure, whose rounds grow with the logarithm of the depth, takes over.
WALKED = 64
SCHEMAS = {
    "nodes": "id string, label string, type string, deprecated boolean",
    "edges": "sub string, pred string, obj string",
    "synonyms": "id string, val string, scope string",
    "xrefs": "id string, xref string, source string",
    "subsets": "id string, subset string",
    "props": "id string, pred string, val string",
    "logical_defs": "id string, genus array<string>, restrictions array<struct<property:string,filler:string>>",
    "property_chains": "pred string, chain array<string>",
    "definitions": "id string, val string, xrefs array<string>",
}


def _ids(spark: SparkSession, ids: Sequence[str] | DataFrame) -> DataFrame:
    return ids.select("id").distinct() if isinstance(ids, DataFrame) else spark.createDataFrame([(x,) for x in dict.fromkeys(ids)], "id string")


def not_redundant(keyed: DataFrame, closed: DataFrame, key: str = "key") -> DataFrame:
    """(key, id) without ids that are proper ancestors of another id of the key (ONT-06)."""
    above = keyed.join(closed, F.col("id") == F.col("term")).select(key, F.col("anc").alias("id")).distinct()
    return keyed.join(above, [key, "id"], "left_anti")


@dataclass
class Ontology:
    nodes: DataFrame
    edges: DataFrame
    synonyms: DataFrame | None = None
    xrefs: DataFrame | None = None
    subsets: DataFrame | None = None
    props: DataFrame | None = None
    logical_defs: DataFrame | None = None
    property_chains: DataFrame | None = None
    definitions: DataFrame | None = None

    def __post_init__(self):
        self._closures: dict = {}
        for f in fields(self):
            if getattr(self, f.name) is None:
                setattr(self, f.name, self.spark.createDataFrame([], SCHEMAS[f.name]))

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @classmethod
    def of_edges(cls, edges: DataFrame) -> Ontology:
        nodes = C.nodes_of(edges).select("id", F.col("id").alias("label"), F.lit("CLASS").alias("type"), F.lit(False).alias("deprecated"))
        return cls(nodes, edges)

    def closure(self, relations: Sequence[str] | None = None) -> DataFrame:
        """(term, anc), computed once for each set of relations."""
        key = None if relations is None else tuple(sorted(relations))
        if key not in self._closures:
            self._closures[key] = C.closure(self.edges, relations)
        return self._closures[key]

    def reflexive_closure(self, relations: Sequence[str] | None = None) -> DataFrame:
        return C.reflexive(self.closure(relations), self.nodes)

    # --- graph shape

    def filtered(self, relations: Sequence[str] | None = None, prefix: str | None = None) -> Ontology:
        """Edges of the relations; with a prefix also nodes of that prefix only, and the edges between them (ONT-01)."""
        nodes, edges = self.nodes, C.with_relations(self.edges, relations)
        if prefix is not None:
            begins = lambda c: F.startswith(F.col(c), F.lit(f"{prefix}:"))
            nodes, edges = nodes.filter(begins("id")), edges.filter(begins("sub") & begins("obj"))
        return replace(self, nodes=nodes, edges=edges)

    def merge(self, other: Ontology) -> Ontology:
        """Union of all tables; a node's fields come from the later ontology (ONT-02)."""
        both = self.nodes.withColumn("o", F.lit(0)).unionByName(other.nodes.withColumn("o", F.lit(1)), allowMissingColumns=True)
        cols = [c for c in both.columns if c not in ("id", "o")]
        nodes = both.groupBy("id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("o"))).alias(c) for c in cols))
        rest = {f.name: getattr(self, f.name).unionByName(getattr(other, f.name), allowMissingColumns=True).distinct() for f in fields(self) if f.name != "nodes"}
        return Ontology(nodes, **rest)

    def subgraph(self, ids: Sequence[str] | DataFrame) -> Ontology:
        """The nodes given and the edges between them (ONT-03)."""
        keep = _ids(self.spark, ids)
        sub, obj = keep.withColumnRenamed("id", "sub"), keep.withColumnRenamed("id", "obj")
        return replace(self, nodes=self.nodes.join(keep, "id", "left_semi"), edges=self.edges.join(sub, "sub", "left_semi").join(obj, "obj", "left_semi").select("sub", "pred", "obj"))

    def subontology(self, ids: Sequence[str] | DataFrame, minimal: bool = False, relations: Sequence[str] | None = None) -> Ontology:
        """Subgraph of the nodes given, or with minimal the slimmed graph of their ancestors; then the relations (ONT-04)."""
        found = self.minimal_subgraph(ids, relations) if minimal else self.subgraph(ids)
        return found.filtered(relations) if relations else found

    def traverse(self, ids: Sequence[str] | DataFrame, up: bool = True, down: bool = False, relations: Sequence[str] | None = None) -> DataFrame:
        """(id): the seeds and what they reach; up and down from one class is its hub (ONT-17, SRC-14)."""
        seeds, closed = _ids(self.spark, ids), self.closure(relations)
        found = seeds
        if up:
            found = found.unionAll(closed.join(seeds, F.col("term") == F.col("id")).select(F.col("anc").alias("id")))
        if down:
            found = found.unionAll(closed.join(seeds, F.col("anc") == F.col("id")).select(F.col("term").alias("id")))
        return found.distinct()

    def ancestors(self, ids: Sequence[str] | DataFrame, relations: Sequence[str] | None = None, reflexive: bool = False) -> DataFrame:
        """(id, anc). An id that is no node has no ancestors, but itself if reflexive (ONT-15)."""
        seeds = _ids(self.spark, ids)
        found = seeds.join(self.closure(relations), F.col("id") == F.col("term")).select("id", "anc")
        return found.unionAll(seeds.select("id", F.col("id").alias("anc"))) if reflexive else found

    def descendants(self, ids: Sequence[str] | DataFrame, relations: Sequence[str] | None = None, reflexive: bool = False) -> DataFrame:
        """(id, desc) (ONT-16)."""
        seeds = _ids(self.spark, ids)
        found = seeds.join(self.closure(relations), F.col("id") == F.col("anc")).select("id", F.col("term").alias("desc"))
        return found.unionAll(seeds.select("id", F.col("id").alias("desc"))) if reflexive else found

    def parents(self, relations: Sequence[str] | None = None) -> DataFrame:
        """(id, parent) (ONT-11)."""
        return C.with_relations(self.edges, relations).select(F.col("sub").alias("id"), F.col("obj").alias("parent")).distinct()

    def children(self, relations: Sequence[str] | None = None) -> DataFrame:
        """(id, child) (ONT-12)."""
        return C.with_relations(self.edges, relations).select(F.col("obj").alias("id"), F.col("sub").alias("child")).distinct()

    def neighbors(self, relations: Sequence[str] | None = None) -> DataFrame:
        """(id, neighbor), parents and children as a bag (ONT-13)."""
        return self.parents(relations).unionAll(self.children(relations)).toDF("id", "neighbor")

    def pair_relations(self) -> DataFrame:
        """(sub, obj, preds sorted) (ONT-14)."""
        return self.edges.groupBy("sub", "obj").agg(F.array_sort(F.collect_set("pred")).alias("preds"))

    def relations_used(self) -> DataFrame:
        """(pred) (ONT-10)."""
        return self.edges.select("pred").distinct()

    def prefixes(self) -> DataFrame:
        return self.nodes.select(text.prefix(F.col("id")).alias("prefix")).distinct()

    def roots(self, relations: Sequence[str] | None = None, prefix: str | None = None) -> DataFrame:
        """(id): nodes without a parent that have a child (ONT-18)."""
        e = self.filtered(relations, prefix).edges
        return e.select(F.col("obj").alias("id")).distinct().join(e.select(F.col("sub").alias("id")).distinct(), "id", "left_anti")

    def level(self, n: int, relations: Sequence[str] | None = None, prefix: str | None = None) -> DataFrame:
        """(id): children of children, n times, from the roots; as a bag (ONT-19)."""
        e = self.filtered(relations, prefix).edges.select("sub", "obj").distinct()
        now = self.roots(relations, prefix)
        for _ in range(n):
            now = now.join(e, F.col("id") == F.col("obj")).select(F.col("sub").alias("id"))
        return now

    def levels(self, n: int, relations: Sequence[str] | None = None, prefix: str | None = None) -> DataFrame:
        """(level, id, n): the bags of levels 0 to n, as how often each holds a node, with the edges read once (ONT-19)."""
        e = C.cut(self.filtered(relations, prefix).edges.select("sub", "obj").distinct())
        now = C.cut(e.select(F.col("obj").alias("id")).distinct().join(e.select(F.col("sub").alias("id")), "id", "left_anti").withColumn("n", F.lit(1).cast("long")))
        out = now.select(F.lit(0).alias("level"), "id", "n")
        for k in range(1, n + 1):
            now = C.cut(now.join(e, F.col("id") == F.col("obj")).groupBy(F.col("sub").alias("id")).agg(F.sum("n").alias("n")))
            out = out.unionAll(now.select(F.lit(k).alias("level"), "id", "n"))
        return out

    def parent_index(self) -> DataFrame:
        """(id, parents sorted) of every node (ONT-20)."""
        got = self.edges.groupBy(F.col("sub").alias("id")).agg(F.array_sort(F.collect_set("obj")).alias("parents"))
        return self.nodes.select("id").distinct().join(got, "id", "left").select("id", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))

    def topological(self) -> DataFrame:
        return C.topological(self.edges, self.nodes)

    def equivalents(self) -> DataFrame:
        """(a, b): undirected equivalence edges, a < b (ONT-22)."""
        return self.edges.filter(F.col("pred") == EQUIVALENT).select(F.least("sub", "obj").alias("a"), F.greatest("sub", "obj").alias("b")).distinct()

    # --- subsets and slims

    def subset(self, name: str) -> DataFrame:
        """(id): members of the subset, by name after any # (ONT-07)."""
        return self.subsets.filter(F.regexp_extract("subset", "([^#]*)$", 1) == name).select("id").distinct()

    def subset_expression(self, expression: str) -> DataFrame:
        """a,b for both subsets, a|b for either (ONT-36); , binds more tightly."""
        either = [reduce(DataFrame.intersect, map(self.subset, part.split(","))) for part in expression.split("|")]
        return reduce(DataFrame.union, either).distinct()

    def slim_map(self, subset: DataFrame, relations: Sequence[str] | None = SLIM_RELATIONS, check: bool = True) -> DataFrame:
        """(id, slim): each node's nearest reflexive ancestors in subset (id); slim is null for nodes without one (ONT-05)."""
        if check and (relations is None or set(relations) - set(SLIM_RELATIONS)):
            raise ValueError(f"not safe for a slim: {relations}")
        if check and not subset.limit(1).count():
            raise ValueError("the subset is empty")
        within = self.reflexive_closure(relations).join(subset.select(F.col("id").alias("anc")), "anc", "left_semi").select(F.col("term").alias("key"), F.col("anc").alias("id"))
        near = not_redundant(within, self.closure(relations))
        return self.nodes.select("id").join(near.select(F.col("key").alias("id"), F.col("id").alias("slim")), "id", "left")

    def minimal_subgraph(self, ids: Sequence[str] | DataFrame, relations: Sequence[str] | None = None) -> Ontology:
        """The focus nodes and those ancestors that tell them apart (ONT-31).

        An edge whose ends have the same focus nodes below binds its ends; of bound nodes those outside the focus that have a
        child in the group are left out. Survivors are linked to the nearest survivors above through what was left out.
        """
        focus = _ids(self.spark, ids)
        edges = C.with_relations(self.edges, relations)
        # what the focus reaches, not the closure of the whole graph, unless that is very deep
        reached = C.walk(edges, focus, depth=WALKED).filter("depth > 0")
        if reached.filter(F.col("depth") == WALKED).limit(1).count():
            proper = self.closure(relations).join(focus, F.col("term") == F.col("id")).select("term", "anc")
        else:
            proper = reached.select(F.col("seed").alias("term"), F.col("id").alias("anc"))
        own = self.nodes.join(focus, "id", "left_semi").select(F.col("id").alias("term"), F.col("id").alias("anc"))
        counts = C.cut(proper.unionAll(own).distinct().groupBy("anc").agg(F.count("*").alias("n")))
        inside = C.cut(edges.select("sub", "obj").join(counts.toDF("sub", "n_sub"), "sub").join(counts.toDF("obj", "n_obj"), "obj").distinct())
        bound = inside.filter("n_sub = n_obj and sub <> obj")
        gone = bound.select(F.col("obj").alias("id")).distinct().join(focus, "id", "left_anti")
        kept = counts.select(F.col("anc").alias("id")).join(gone, "id", "left_anti")
        drop, keep = gone.select(F.col("id").alias("obj")), kept
        direct = inside.select("sub", "obj").join(keep.toDF("sub"), "sub", "left_semi")
        total = direct.join(keep.toDF("obj"), "obj", "left_semi").select("sub", "obj")
        now = C.cut(direct.join(drop, "obj", "left_semi").select("sub", "obj"))
        step = inside.select(F.col("sub").alias("obj"), F.col("obj").alias("up"))
        seen = now
        while now.limit(1).count():
            met = now.join(step, "obj").select("sub", F.col("up").alias("obj")).filter("sub <> obj").distinct()
            total = total.unionAll(met.join(keep.toDF("obj"), "obj", "left_semi").select("sub", "obj"))
            now = C.cut(met.join(drop, "obj", "left_semi").select("sub", "obj").join(seen, ["sub", "obj"], "left_anti"))
            seen = seen.unionAll(now)
        links = C.cut(total.distinct())
        closed = C.closure(links.select("sub", F.lit(IS_A).alias("pred"), "obj"))
        longer = links.join(closed.toDF("mid", "obj"), "obj").join(links.toDF("sub", "mid"), ["sub", "mid"], "left_semi").select("sub", "obj").distinct()
        near = links.join(longer, ["sub", "obj"], "left_anti")
        return replace(self, nodes=self.nodes.join(kept, "id", "left_semi"), edges=near.select("sub", F.lit(IS_A).alias("pred"), "obj"))

    # --- node data

    def labels(self, fallback: bool = False) -> DataFrame:
        return self.nodes.select("id", F.coalesce("label", "id").alias("label") if fallback else F.col("label"))

    def all_synonyms(self, include_label: bool = False) -> DataFrame:
        """(id, val, scope); labels have scope label (ONT-25)."""
        if not include_label:
            return self.synonyms
        return self.synonyms.unionByName(self.nodes.filter("label is not null").select("id", F.col("label").alias("val"), F.lit("label").alias("scope")))

    def values(self, pred: str) -> DataFrame:
        """(id, val) of a property; obo namespace and replacements are such (ONT-26, ONT-27)."""
        return self.props.filter(F.col("pred") == pred).select("id", "val")

    def obo_namespace(self) -> DataFrame:
        return self.values("OIO:hasOBONamespace").groupBy("id").agg(F.min("val").alias("namespace"))

    def obsoletes(self) -> DataFrame:
        return self.nodes.filter("deprecated").select("id")

    def replaced_by(self, strict: bool = False) -> DataFrame:
        """(id, replacements sorted); strict fails if a node has several."""
        found = self.values("IAO:0100001").groupBy("id").agg(F.array_sort(F.collect_set("val")).alias("replacements"))
        if strict and found.filter(F.size("replacements") > 1).limit(1).count():
            raise ValueError("a node has several replacements")
        return found

    def xrefs_of(self, bidirectional: bool = False, prefix: str | None = None) -> DataFrame:
        """(id, xref): those a node itself states, or those in either direction (ONT-28)."""
        found = self.xrefs.filter("source = id or source is null").select("id", "xref")
        if bidirectional:
            found = self.xrefs.select("id", "xref").unionAll(self.xrefs.select(F.col("xref").alias("id"), F.col("id").alias("xref")))
        return (found if prefix is None else found.filter(F.startswith("xref", F.lit(f"{prefix}:")))).distinct()

    def with_xref_edges(self) -> Ontology:
        """xref edges both ways where both ends are nodes (ONT-32)."""
        both = self.xrefs_of(bidirectional=True)
        ends = both.join(self.nodes.select("id"), "id", "left_semi").join(self.nodes.select(F.col("id").alias("xref")), "xref", "left_semi")
        return replace(self, edges=self.edges.unionByName(ends.select(F.col("id").alias("sub"), F.lit("xref").alias("pred"), F.col("xref").alias("obj"))))

    def xref_table(self, prefixes: Sequence[str]) -> DataFrame:
        """One row per node, a column per database, the greatest local id or blank (ONT-47)."""
        x = self.xrefs_of().withColumn("db", text.prefix(F.col("xref"))).withColumn("local", text.fragment(F.col("xref")))
        wide = x.groupBy("id").pivot("db", list(prefixes)).agg(F.max("local"))
        return self.labels().join(wide, "id", "left").na.fill("", list(prefixes))

    def search(self, terms: Sequence[str], regex: bool = False, partial: bool = False, synonyms: bool = False) -> DataFrame:
        """(term, id): an id stands for itself; % is a wildcard; else labels, or synonyms too, equal, hold or match the term (ONT-30)."""
        ids = [t for t in terms if t.count(":") == 1]
        words = [t for t in terms if t.count(":") != 1]
        names = self.all_synonyms(include_label=True).select("id", "val") if synonyms else self.nodes.select("id", F.col("label").alias("val"))
        out = self.spark.createDataFrame([(t, t) for t in ids], "term string, id string")
        for t in words:
            val, wild = F.col("val"), regex or "%" in t
            test = F.rlike(val, F.lit(t.replace("%", ".*"))) if wild else F.contains(val, F.lit(t)) if partial else val == t
            out = out.unionAll(names.filter(test).select(F.lit(t).alias("term"), "id").distinct())
        return out

    def logical_definitions(self, ids: Sequence[str] | DataFrame) -> DataFrame:
        """(id, genus, restrictions) of the classes given (ONT-24)."""
        return self.logical_defs.join(_ids(self.spark, ids), "id", "left_semi")

    def chains_of(self, preds: Sequence[str]) -> DataFrame:
        """(pred, chain) of the relations given; chains keep their order (ONT-24)."""
        return self.property_chains.filter(F.col("pred").isin(*preds))

    def text_definitions(self, ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
        """(id, val, xrefs) (ONT-23)."""
        return self.definitions if ids is None else self.definitions.join(_ids(self.spark, ids), "id", "left_semi")

    def leaves(self, relations: Sequence[str] | None = None) -> DataFrame:
        """(id): nodes with a parent and without a child (ONT-39)."""
        e = C.with_relations(self.edges, relations)
        return e.select(F.col("sub").alias("id")).distinct().join(e.select(F.col("obj").alias("id")), "id", "left_anti")

    def has_nodes(self, ids: Sequence[str] | DataFrame) -> DataFrame:
        """(id, known, label, type): whether ids are nodes, and what they are called (ONT-09)."""
        n = self.nodes.select("id", "label", "type", F.lit(True).alias("known"))
        return _ids(self.spark, ids).join(n, "id", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("label", "id").alias("label"), "type")

    # --- changes: each gives a new ontology (ONT-29)

    def _plus(self, **rows: Sequence[tuple]) -> Ontology:
        return replace(self, **{k: getattr(self, k).unionByName(self.spark.createDataFrame(list(v), SCHEMAS[k]), allowMissingColumns=True) for k, v in rows.items()})

    def add_node(self, id: str, label: str | None = None, type: str = "CLASS") -> Ontology:
        return self._plus(nodes=[(id, label, type, False)])

    def add_parent(self, id: str, parent: str, relation: str = IS_A) -> Ontology:
        return self._plus(edges=[(id, relation, parent)])

    def add_xref(self, id: str, xref: str) -> Ontology:
        return self._plus(xrefs=[(id, xref, id)])

    def add_synonym(self, id: str, val: str, scope: str = "exact") -> Ontology:
        return self._plus(synonyms=[(id, val, scope)])

    def add_to_subset(self, id: str, subset: str) -> Ontology:
        return self._plus(subsets=[(id, subset)])

    def add_logical_definition(self, id: str, genus: Sequence[str], restrictions: Sequence[tuple[str, str]]) -> Ontology:
        return self._plus(logical_defs=[(id, list(genus), list(restrictions))])

    def add_property_chain(self, pred: str, chain: Sequence[str]) -> Ontology:
        return self._plus(property_chains=[(pred, list(chain))])

    def add_definition(self, id: str, val: str, xrefs: Sequence[str] = ()) -> Ontology:
        return self._plus(definitions=[(id, val, list(xrefs))])

    def set_obsolete(self, id: str, value: bool = True) -> Ontology:
        return replace(self, nodes=self.nodes.withColumn("deprecated", F.when(F.col("id") == id, F.lit(value)).otherwise(F.col("deprecated"))))

    # --- compositions

    def chain(self, seeds: Sequence[str] | DataFrame, relations: Sequence[str], up: bool = True, sink_type: str | None = None) -> DataFrame:
        """(id, sink): what the seeds reach by following the relations in order (ONT-40)."""
        now = _ids(self.spark, seeds).select("id", F.col("id").alias("sink"))
        for r in relations:
            e = self.edges.filter(F.col("pred") == r).select(F.col("sub" if up else "obj").alias("at"), F.col("obj" if up else "sub").alias("to"))
            now = now.join(e, F.col("sink") == F.col("at")).select("id", F.col("to").alias("sink")).distinct()
        return now if sink_type is None else now.join(self.nodes.filter(F.col("type") == sink_type).select(F.col("id").alias("sink")), "sink", "left_semi").select("id", "sink")

    def bundle(self, id: str, up: int = 20, down: int = 1) -> DataFrame:
        """(id): a node's superclasses to a depth, subclasses to a depth, and equivalents (ONT-42)."""
        seed = _ids(self.spark, [id])
        eq = self.equivalents()
        same = eq.filter(F.col("a") == id).select(F.col("b").alias("id")).unionAll(eq.filter(F.col("b") == id).select(F.col("a").alias("id")))
        return C.walk(self.edges, seed, True, up, [IS_A]).select("id").unionAll(C.walk(self.edges, seed, False, down, [IS_A]).select("id")).unionAll(same).distinct()

    def described_edges(self) -> DataFrame:
        """Edges with the labels of both ends (ONT-49)."""
        sub, obj = self.labels(True).toDF("sub", "sub_label"), self.labels(True).toDF("obj", "obj_label")
        return self.edges.join(sub, "sub", "left").join(obj, "obj", "left").select("sub", "sub_label", "pred", "obj", "obj_label")

    def aspect(self, roots: Sequence[tuple[str, str]], relations: Sequence[str] | None = None) -> DataFrame:
        """(id, aspect): that of the first root, in the order given, among a node's reflexive ancestors (ONT-34)."""
        order = self.spark.createDataFrame([(r, a, i) for i, (r, a) in enumerate(roots)], "anc string, aspect string, k int")
        return self.reflexive_closure(relations).join(F.broadcast(order), "anc").groupBy(F.col("term").alias("id")).agg(F.min_by("aspect", "k").alias("aspect"))

    def has_part_inferences(self, assoc: DataFrame, relation: str = "BFO:0000051") -> DataFrame:
        """(subject, object): parts of the reflexive superclasses of what subjects are annotated to (ONT-43)."""
        above = assoc.join(self.reflexive_closure([IS_A]), F.col("object") == F.col("term")).select("subject", "anc")
        parts = self.edges.filter(F.col("pred") == relation).select(F.col("sub").alias("anc"), F.col("obj").alias("object"))
        return above.join(parts, "anc").select("subject", "object").distinct()

    def termable(self, roots: Sequence[str], relation: str) -> DataFrame:
        """(id, targets): nodes under the roots that have parents by the relation (ONT-44)."""
        below = self.descendants(roots, [IS_A], True).select(F.col("desc").alias("sub")).distinct()
        return self.edges.filter(F.col("pred") == relation).join(below, "sub", "left_semi").groupBy(F.col("sub").alias("id")).agg(F.array_sort(F.collect_set("obj")).alias("targets"))

    def clique_leaders(self, relation: str = "cliqueLeader") -> DataFrame:
        """(id, leader): the node that stands for each node's clique, itself without one (ONT-41)."""
        led = self.edges.filter(F.col("pred") == relation).groupBy(F.col("sub").alias("id")).agg(F.min("obj").alias("leader"))
        return self.nodes.select("id").join(led, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))

    def bio_objects(self, taxon: str = "RO:0002162", disposition: str = "RO:0000091", inheritance: Sequence[str] = ()) -> DataFrame:
        """(id, label, leader, taxon, inheritance, modifiers): dispositions that lie under an inheritance root are such, others modify (ONT-48)."""
        taxa = self.edges.filter(F.col("pred") == taxon).groupBy(F.col("sub").alias("id")).agg(F.min("obj").alias("taxon"))
        under = self.descendants(list(inheritance) or [""], reflexive=True).select(F.col("desc").alias("obj"), F.lit(True).alias("inherits")).distinct()
        disp = self.edges.filter(F.col("pred") == disposition).join(under, "obj", "left").join(self.labels().toDF("obj", "l"), "obj", "left")
        item = F.struct(F.col("obj").alias("id"), F.col("l").alias("label"))
        lists = disp.groupBy(F.col("sub").alias("id")).agg(F.array_sort(F.collect_set(F.when(F.col("inherits"), item))).alias("inheritance"), F.array_sort(F.collect_set(F.when(F.col("inherits").isNull(), item))).alias("modifiers"))
        return self.labels().join(self.clique_leaders(), "id").join(taxa, "id", "left").join(lists, "id", "left")

    def regulation(self, regulators: Sequence[tuple[str, str]]) -> DataFrame:
        """(id, bucket): that of the first root, by the order given, that a node lies under; none without (ONT-45)."""
        found = self.aspect(regulators)
        return self.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("aspect", F.lit("none")).alias("bucket"))

    def described(self, ids: Sequence[str] | DataFrame) -> DataFrame:
        """Edges at either end of the nodes given (ONT-49)."""
        keep = _ids(self.spark, ids)
        return self.edges.join(keep.toDF("sub"), "sub", "left_semi").unionByName(self.edges.join(keep.toDF("obj"), "obj", "left_semi")).distinct()

    def compact(self) -> tuple[DataFrame, DataFrame]:
        """((id, n): numbers of nodes in order, (pred, n, parents): adjacency by relation) (SRC-30).

        Numbers come from a range sort and the counts of its partitions, so no task sees all nodes.
        """
        ids = C.cut(self.nodes.select("id").distinct().repartitionByRange("id").sortWithinPartitions("id").withColumn("p", F.spark_partition_id()))
        least = ids.groupBy("p").agg(F.count("*").alias("c"))
        before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        least = least.withColumn("first", F.coalesce(F.sum("c").over(before), F.lit(0)))
        rank = F.row_number().over(Window.partitionBy("p").orderBy("id"))
        numbers = ids.withColumn("k", rank).join(F.broadcast(least), "p").select("id", (F.col("first") + F.col("k") - 1).alias("n"))
        e = self.edges.join(numbers.toDF("sub", "n"), "sub").join(numbers.toDF("obj", "m"), "obj")
        return numbers, e.groupBy("pred", "n").agg(F.array_sort(F.collect_set("m")).alias("parents"))


def expand_labels(rows: DataFrame, columns: Sequence[str], labels: DataFrame) -> DataFrame:
    """rows with a column <col>_label after each of the columns; null for unknown ids (ONT-33)."""
    out = rows
    for c in columns:
        out = out.join(labels.select(F.col("id").alias("__i"), F.col("label").alias(f"{c}_label")), F.col(c) == F.col("__i"), "left").drop("__i")
    order = [x for c in rows.columns for x in ((c, f"{c}_label") if c in columns else (c,))]
    return out.select(*order)
