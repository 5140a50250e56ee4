"""Readers: ontologies, association and entity files, lookup tables (SRC-01 to SRC-31).

Paths are anything Spark reads, .gz too (SRC-20). Association documents are Parquet tables (SRC-28); file comparison takes the
frames of ``associations`` (SRC-29).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import parse
from ..operators.ontology import SCHEMAS, Ontology
from ..operators.rules import inference_key

#: Stems of identifiers in ontology files; each may be extended by a context.
CONTEXT = {
    "OIO": "http://www.geneontology.org/formats/oboInOwl#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
}
#: Relations that have another name in files.
PREDICATES = {"is_a": "subClassOf", "http://purl.obolibrary.org/obo/part_of": "BFO:0000050", "part_of": "BFO:0000050"}
_LIST = "array<string>"
OBOGRAPH = (
    "`@context` map<string,string>, graphs array<struct<id:string,nodes:array<struct<id:string,lbl:string,type:string,is_obsolete:string,meta:struct<"
    "definition:struct<val:string,xrefs:array<string>>,subsets:array<string>,comments:array<string>,deprecated:boolean,"
    "synonyms:array<struct<pred:string,val:string,xrefs:array<string>,synonymType:string>>,xrefs:array<struct<val:string>>,"
    "basicPropertyValues:array<struct<pred:string,val:string>>>>>,edges:array<struct<sub:string,pred:string,obj:string>>,"
    "equivalentNodesSets:array<struct<nodeIds:array<string>>>,logicalDefinitionAxioms:array<struct<definedClassId:string,genusIds:array<string>,"
    "restrictions:array<struct<propertyId:string,fillerId:string>>>>,propertyChainAxioms:array<struct<predicateId:string,chainPredicateIds:array<string>>>>>"
)


def _short(col: Column, prefixes: Mapping[str, str]) -> Column:
    named = text.contracted(col, prefixes)
    obo = F.when(F.rlike(named, F.lit("^https?://purl.obolibrary.org/obo/[A-Za-z]+_[^/]+$")), text.obo_curie(named)).otherwise(named)
    return obo


def obograph(spark: SparkSession, path: str, node_type: str | None = None, predicates: Sequence[str] | None = None) -> Ontology:
    """All graphs of an obograph JSON file (SRC-01 to SRC-05). Nodes marked obsolete at the top go; those deprecated in meta stay."""
    docs = spark.read.schema(OBOGRAPH).option("multiLine", True).json(path)
    own = docs.select(F.explode("@context").alias("k", "v")).filter("v is not null").distinct().collect()  # the file's prefixes: a small header
    prefixes = CONTEXT | {r.k: r.v for r in own if not r.k.startswith("@")}
    short = lambda c: _short(c if isinstance(c, Column) else F.col(c), prefixes)
    graphs = docs.select(F.explode("graphs").alias("g"))
    raw = graphs.select(F.explode("g.nodes").alias("n")).filter("coalesce(n.is_obsolete, 'false') <> 'true'").select(short("n.id").alias("id"), F.col("n.lbl").alias("lbl"), F.col("n.type").alias("type"), F.col("n.meta").alias("meta"))
    raw = raw if node_type is None else raw.filter(F.col("type") == node_type)
    nodes = raw.select("id", F.col("lbl").alias("label"), "type", F.coalesce("meta.deprecated", F.lit(False)).alias("deprecated"))
    known = F.create_map(*(F.lit(x) for kv in PREDICATES.items() for x in kv))
    edges = graphs.select(F.explode("g.edges").alias("e")).select(short("e.sub").alias("sub"), F.coalesce(F.element_at(known, F.col("e.pred")), short("e.pred")).alias("pred"), short("e.obj").alias("obj"))
    sets = graphs.select(F.explode("g.equivalentNodesSets").alias("q")).select(F.col("q.nodeIds").alias("ids"))
    pairs = sets.select("ids", F.explode("ids").alias("x")).select("x", F.explode("ids").alias("y")).filter("x <> y")
    edges = edges.unionByName(pairs.select(short("x").alias("sub"), F.lit("equivalentTo").alias("pred"), short("y").alias("obj")))
    if predicates is not None:
        edges = edges.filter(F.col("pred").isin(*predicates))
    syn = raw.select("id", F.explode("meta.synonyms").alias("s")).select("id", F.col("s.val").alias("val"), F.lower(F.regexp_replace(F.regexp_extract("s.pred", "([^#/:]+)$", 1), "^has(.*)Synonym$", "$1")).alias("scope"))
    xref = raw.select("id", F.explode("meta.xrefs").alias("x")).select("id", F.col("x.val").alias("xref"), F.col("id").alias("source"))
    subsets = raw.select("id", F.explode("meta.subsets").alias("subset"))
    props = raw.select("id", F.explode("meta.basicPropertyValues").alias("p")).select("id", short("p.pred").alias("pred"), short("p.val").alias("val"))
    defs = raw.filter("meta.definition is not null").select("id", F.col("meta.definition.val").alias("val"), F.col("meta.definition.xrefs").alias("xrefs"))
    logic = graphs.select(F.explode("g.logicalDefinitionAxioms").alias("l")).filter("l.definedClassId is not null")
    rest = F.transform(F.filter("l.restrictions", lambda r: r.isNotNull()), lambda r: F.struct(short(r["propertyId"]).alias("property"), short(r["fillerId"]).alias("filler")))
    logic = logic.select(short("l.definedClassId").alias("id"), F.transform("l.genusIds", short).alias("genus"), rest.alias("restrictions"))
    chains = graphs.select(F.explode("g.propertyChainAxioms").alias("c")).select(short("c.predicateId").alias("pred"), F.transform("c.chainPredicateIds", short).alias("chain"))
    return Ontology(nodes, edges, syn, xref, subsets, props, logic, chains, defs)


def obo(spark: SparkSession, path: str) -> Ontology:
    """Stanzas of an OBO file (SRC-07): [Term] and [Typedef] with their usual tags."""
    stanzas = spark.read.option("lineSep", "\n[").text(path).select(F.concat(F.lit("["), F.regexp_replace("value", r"^\[", "")).alias("v")).filter("v rlike '^\\\\[(Term|Typedef)\\\\]'")
    lines = stanzas.select(F.regexp_extract("v", r"(?m)^id: *(\S+)", 1).alias("id"), F.regexp_extract("v", r"^\[(\w+)\]", 1).alias("kind"), F.split("v", "\n").alias("ls"))
    tags = lines.select("id", "kind", F.explode("ls").alias("l")).filter("l rlike '^[a-z_]+:'").select("id", "kind", F.substring_index("l", ":", 1).alias("tag"), F.trim(F.regexp_extract("l", r"^[a-z_]+: *(.*?)( *!.*)?$", 1)).alias("val"))
    one = lambda tag: tags.filter(F.col("tag") == tag)
    quoted = r'^"((?:[^"\\]|\\.)*)"'
    nodes = tags.groupBy("id").agg(F.max(F.when(F.col("tag") == "name", F.col("val"))).alias("label"), F.first(F.when(F.col("kind") == "Term", "CLASS").otherwise("PROPERTY")).alias("type"), F.coalesce(F.max(F.when(F.col("tag") == "is_obsolete", F.col("val") == "true")), F.lit(False)).alias("deprecated"))
    isa = one("is_a").select(F.col("id").alias("sub"), F.when(F.col("kind") == "Term", "subClassOf").otherwise("subPropertyOf").alias("pred"), F.substring_index("val", " ", 1).alias("obj"))
    known = F.create_map(*(F.lit(x) for kv in PREDICATES.items() for x in kv))
    rel = one("relationship").select(F.col("id").alias("sub"), F.substring_index("val", " ", 1).alias("r"), F.split("val", " +")[1].alias("obj")).select("sub", F.coalesce(F.element_at(known, F.col("r")), F.col("r")).alias("pred"), "obj")
    syn = one("synonym").select("id", F.regexp_extract("val", quoted, 1).alias("val"), F.lower(F.regexp_extract("val", r'" +([A-Z]+)', 1)).alias("scope"))
    return Ontology(
        nodes, isa.unionByName(rel), syn,
        one("xref").select("id", F.substring_index("val", " ", 1).alias("xref"), F.col("id").alias("source")),
        one("subset").select("id", F.substring_index("val", " ", 1).alias("subset")),
        one("namespace").select("id", F.lit("OIO:hasOBONamespace").alias("pred"), "val").unionByName(one("replaced_by").select("id", F.lit("IAO:0100001").alias("pred"), "val")),
        definitions=one("def").select("id", F.regexp_extract("val", quoted, 1).alias("val"), F.split(F.regexp_extract("val", r"\[(.*)\] *$", 1), ", *").alias("xrefs")),
    )


def ntriples(spark: SparkSession, path: str, prefixes: Mapping[str, str] | None = None) -> DataFrame:
    """(s, p, o, lang) of N-Triples lines; identifiers are shortened (SRC-08, SRC-10, SRC-11)."""
    form = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?)\s*\.\s*$'
    rows = spark.read.text(path).filter(F.rlike("value", F.lit(form)))
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    short = lambda c: _short(bare(c), CONTEXT | dict(prefixes or {}))
    o = F.regexp_extract("value", form, 3)
    value = F.when(F.startswith(o, F.lit('"')), F.replace(F.replace(F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))).otherwise(short(o))
    return rows.select(short(F.regexp_extract("value", form, 1)).alias("s"), short(F.regexp_extract("value", form, 2)).alias("p"), value.alias("o"), F.nullif(F.regexp_extract(o, r'"@([\w-]+)$', 1), F.lit("")).alias("lang"))


def turtle(spark: SparkSession, path: str, prefixes: Mapping[str, str] | None = None) -> DataFrame:
    """(s, p, o, lang) of a plain Turtle file: prefixes, ; and , lists, literals with a language; no blank node brackets (SRC-08, SRC-09).

    Statements are read as lines of a file that ends each with ' .' at a line's end; each is split by itself.
    """
    whole = spark.read.option("lineSep", ".\n").text(path)
    heads = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"@prefix\s+(\S*:)\s+(<[^>]*>)"), 0)).alias("h")).select(F.regexp_extract("h", r"@prefix\s+(\S*):\s", 1).alias("k"), F.regexp_extract("h", "<([^>]*)>", 1).alias("v")).distinct().collect()  # the header
    own = {r.k: r.v for r in heads}
    token = r'"""[\s\S]*?"""(?:@[\w-]+)?|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^\S+)?|<[^>]*>|[;,]|[^\s;,]+'
    body = F.regexp_replace(F.regexp_replace("value", r"@prefix\s+\S*:\s+<[^>]*>\s*\.?", ""), r"(?m)^\s*#.*$", "")
    st = whole.select(F.regexp_extract_all(body, F.lit(token), 0).alias("t")).filter("size(t) >= 3").withColumn("t", F.filter("t", lambda x: x != "."))
    # after ; a predicate follows, after , another object: the predicate of a token is the one after the last ;
    pos = st.select(F.get("t", F.lit(0)).alias("s"), F.concat(F.array(F.lit(";")), F.slice("t", F.lit(2), F.size("t"))).alias("t"))
    groups = pos.select("s", F.explode(F.filter(F.split(F.array_join("t", "\u0001"), "(^|\u0001);(\u0001|$)"), lambda g: g != "")).alias("g")).select("s", F.filter(F.split("g", "\u0001"), lambda x: (x != "") & (x != ",")).alias("g"))
    rows = groups.filter("size(g) >= 2").select("s", F.get("g", F.lit(0)).alias("p"), F.explode(F.slice("g", F.lit(2), F.size("g"))).alias("o"))
    stems = CONTEXT | dict(prefixes or {}) | own

    def short(c: str) -> Column:
        col = F.when(F.col(c) == "a", "rdf:type").otherwise(F.col(c))
        return F.when(F.startswith(col, F.lit("<")), _short(F.regexp_replace(col, "^<|>$", ""), {k: v for k, v in stems.items() if k})).otherwise(col)

    literal = F.coalesce(F.nullif(F.regexp_extract("o", r'^"""([\s\S]*?)"""', 1), F.lit("")), F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"', 1))
    return rows.select(short("s").alias("s"), short("p").alias("p"), F.when(F.startswith("o", F.lit('"')), literal).otherwise(short("o")).alias("o"), F.nullif(F.regexp_extract("o", r'"@([\w-]+)$', 1), F.lit("")).alias("lang"))


def ontology_of_triples(triples: DataFrame) -> Ontology:
    """Classes with labels, subclasses, synonyms, xrefs, subsets and obsolescence (SRC-10 to SRC-12); blank nodes stay out."""
    t = triples.filter(~F.startswith("s", F.lit("_:")) & ~F.startswith("o", F.lit("_:")))
    of = lambda p: t.filter(F.col("p") == p)
    ids = of("rdf:type").filter("o = 'owl:Class'").select(F.col("s").alias("id")).union(of("rdfs:subClassOf").select(F.explode(F.array("s", "o")).alias("id"))).distinct()
    label = of("rdfs:label").groupBy(F.col("s").alias("id")).agg(F.min("o").alias("label"))
    old = of("owl:deprecated").select(F.col("s").alias("id"), F.lit(True).alias("deprecated")).distinct()
    nodes = ids.join(label, "id", "left").join(old, "id", "left").select("id", "label", F.lit("CLASS").alias("type"), F.coalesce("deprecated", F.lit(False)).alias("deprecated"))
    edges = of("rdfs:subClassOf").select(F.col("s").alias("sub"), F.lit("subClassOf").alias("pred"), F.col("o").alias("obj")).union(of("rdfs:subPropertyOf").select("s", F.lit("subPropertyOf"), "o"))
    syn = t.filter(F.rlike("p", F.lit("^OIO:has\\w+Synonym$"))).select(F.col("s").alias("id"), F.col("o").alias("val"), F.lower(F.regexp_extract("p", "has(\\w+)Synonym", 1)).alias("scope"))
    xref = of("OIO:hasDbXref").select(F.col("s").alias("id"), F.col("o").alias("xref"), F.col("s").alias("source"))
    return Ontology(nodes, edges, syn, xref, of("OIO:inSubset").select(F.col("s").alias("id"), F.col("o").alias("subset")))


def skos(triples: DataFrame, lang: str = "en") -> Ontology:
    """Concepts, broader as parents, related as edges, exactMatch as xrefs, altLabel as synonyms, schemes as subsets (SRC-09)."""
    of = lambda p: triples.filter(F.col("p") == f"skos:{p}")
    mine = lambda p: of(p).filter((F.col("lang") == lang) | F.col("lang").isNull())
    ids = triples.filter("p = 'rdf:type' and o = 'skos:Concept'").select(F.col("s").alias("id")).distinct()
    nodes = ids.join(mine("prefLabel").groupBy(F.col("s").alias("id")).agg(F.min("o").alias("label")), "id", "left").select("id", "label", F.lit("CLASS").alias("type"), F.lit(False).alias("deprecated"))
    edges = of("broader").select(F.col("s").alias("sub"), F.lit("subClassOf").alias("pred"), F.col("o").alias("obj")).union(of("related").select("s", F.lit("related"), "o"))
    defs = mine("definition").groupBy(F.col("s").alias("id")).agg(F.min("o").alias("val")).withColumn("xrefs", F.array().cast(_LIST))
    return Ontology(nodes, edges, mine("altLabel").select(F.col("s").alias("id"), F.col("o").alias("val"), F.lit("exact").alias("scope")), of("exactMatch").select(F.col("s").alias("id"), F.col("o").alias("xref"), F.col("s").alias("source")), of("inScheme").select(F.col("s").alias("id"), F.col("o").alias("subset")), definitions=defs)


def individuals(triples: DataFrame) -> Ontology:
    """Named individuals: edges between them, labelled by the labels of their types joined with ; (SRC-08)."""
    ids = triples.filter("p = 'rdf:type' and o = 'owl:NamedIndividual'").select(F.col("s").alias("id")).distinct()
    types = triples.filter("p = 'rdf:type' and o <> 'owl:NamedIndividual'").select(F.col("s").alias("id"), F.col("o").alias("t"))
    label = triples.filter("p = 'rdfs:label'").select(F.col("s").alias("t"), F.col("o").alias("l"))
    named = types.join(label, "t", "left").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("l", "t"))), ";").alias("label"))
    edges = triples.filter("p <> 'rdf:type'").join(ids.toDF("s"), "s", "left_semi").join(ids.toDF("o"), "o", "left_semi")
    return Ontology(ids.join(named, "id", "left").select("id", "label", F.lit("INDIVIDUAL").alias("type"), F.lit(False).alias("deprecated")), edges.select(F.col("s").alias("sub"), F.col("p").alias("pred"), F.col("o").alias("obj")))


def ontology(spark: SparkSession, handle: str) -> Ontology:
    """By handle: a+b merges; .json, .obo, .nt, .ttl by suffix; skos:path for a concept scheme (SRC-06, SRC-07)."""
    if "+" in handle:
        first, *rest = handle.split("+")
        out = ontology(spark, first)
        for h in rest:
            out = out.merge(ontology(spark, h))
        return out
    if handle.startswith("skos:"):
        return skos(turtle(spark, handle[5:]))
    suffix = PurePosixPath(handle.removesuffix(".gz")).suffix
    readers = {".json": obograph, ".obo": obo, ".nt": lambda s, p: ontology_of_triples(ntriples(s, p)), ".ttl": lambda s, p: ontology_of_triples(turtle(s, p))}
    if suffix not in readers:
        raise ValueError(f"no reader for {handle}; remote services and OWL files are out of scope")
    return readers[suffix](spark, handle)


def associations(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Annotations of GAF, GPAD or HPOA files, by their header if kind is not given (SRC-15, SRC-16, SRC-19, SRC-21)."""
    lines = spark.read.text(path)
    if kind is None:
        row = lines.filter(F.startswith("value", F.lit("!"))).select(F.lower(F.regexp_extract("value", parse.VERSION, 1)).alias("k")).filter(F.col("k").isin("gaf", "gpad")).limit(1).collect()
        if not row:
            raise ValueError("no header line names a format")
        kind = row[0].k
    version = parse.header_version(lines, kind)
    return parse.annotations(parse.cells(lines.select("value"), kind, version), kind, version)


def entities(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, name, synonyms, types, taxon, encoded_by, parents, members, xrefs, properties) of GPI files of either version (SRC-17)."""
    lines = spark.read.text(path)
    version = parse.header_version(lines, "gpi")
    rows = parse.cells(lines, "gpi", version).filter("problem is null or problem = 'too many columns'")
    many = lambda c: F.filter(F.split(c, r"\|"), lambda x: x != "")
    none = F.array().cast(_LIST)
    old = version == "1.2"
    return rows.select(
        (text.without_double_prefix(F.concat_ws(":", "db", "db_object_id")) if old else F.col("id")).alias("id"), F.col("symbol").alias("label"), "name", many("synonym").alias("synonyms"), many("type").alias("types"),
        F.regexp_replace("taxon", "^taxon:", "NCBITaxon:").alias("taxon"), (none if old else many("encoded_by")).alias("encoded_by"), many("parent").alias("parents"), (none if old else many("complex_members")).alias("members"),
        many("xref").alias("xrefs"), text.properties(F.col("properties")).alias("properties"),
    )


def basic_gene_information(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, name, type, taxon, synonyms, xrefs) of BGI JSON (SRC-18)."""
    schema = "data array<struct<primaryId:string,symbol:string,name:string,soTermId:string,taxonId:string,synonyms:array<string>,crossReferenceIds:array<string>,basicGeneticEntity:struct<primaryId:string,taxonId:string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("data").alias("d"))
    return rows.select(F.coalesce("d.primaryId", "d.basicGeneticEntity.primaryId").alias("id"), F.col("d.symbol").alias("label"), F.col("d.name").alias("name"), F.col("d.soTermId").alias("type"), F.coalesce("d.taxonId", "d.basicGeneticEntity.taxonId").alias("taxon"), F.coalesce("d.synonyms", F.array().cast(_LIST)).alias("synonyms"), F.coalesce("d.crossReferenceIds", F.array().cast(_LIST)).alias("xrefs"))


def evidence_table(spark: SparkSession, path: str) -> DataFrame:
    """(code, ref, cls); Default is a null reference (SRC-22)."""
    rows = spark.read.option("sep", "\t").option("comment", "#").schema("code string, ref string, cls string").csv(path)
    return rows.withColumn("ref", F.when(F.col("ref") != "Default", F.col("ref")))


def metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A YAML list of records, read as text by Spark and parsed on the driver: lookup files of a few hundred entries (SRC-23)."""
    import yaml

    content = spark.read.text(path, wholetext=True).collect()
    rows = [r for x in content for r in (yaml.safe_load(x.value) or [])]
    names = spark.createDataFrame([], schema).columns
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def retracted(spark: SparkSession, path: str) -> DataFrame:
    """(id): what stands before the first comma of lines that aren't comments (SRC-24)."""
    return spark.read.text(path).filter("value not like '!%' and trim(value) <> ''").select(F.trim(F.substring_index("value", ",", 1)).alias("id"))


def inferences(spark: SparkSession, path: str) -> DataFrame:
    """(key, satisfiable, taxon_problem, inferences) of an inference file (SRC-25)."""
    unit = "struct<relation:string,term:string>"
    schema = f"annotation struct<annotation:{unit},taxon:string,extension:array<{unit}>>, satisfiable boolean, taxonProblem boolean, inferences array<{unit}>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    units = F.coalesce("annotation.extension", F.array().cast(f"array<{unit}>"))
    return rows.select(inference_key(F.col("annotation.annotation.relation"), F.col("annotation.annotation.term"), F.col("annotation.taxon"), units).alias("key"), "satisfiable", F.col("taxonProblem").alias("taxon_problem"), "inferences")


def patients(spark: SparkSession, path: str) -> DataFrame:
    """Match requests (SRC-26)."""
    named = "array<struct<id:string,label:string>>"
    schema = f"patient struct<id:string,label:string,features:array<struct<id:string,label:string,observed:string>>,disorders:{named},genomicFeatures:array<struct<gene:struct<id:string>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select("patient.*")


def tab_separated(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A file with a header line; all columns are strings (SRC-27)."""
    return spark.read.option("header", True).option("sep", sep).csv(path)


def scraped_names(pages: DataFrame, html: str = "html") -> DataFrame:
    """(id, label, href): list items and headings of pages as names, each its own id (SRC-31)."""
    items = F.regexp_extract_all(html, F.lit(r"(?is)<(?:li|h[1-6]|a)\b[^>]*>(.*?)</(?:li|h[1-6]|a)>"), 0)
    rows = pages.select(F.explode(items).alias("x"))
    label = F.trim(F.regexp_replace(F.regexp_replace("x", "(?s)<[^>]*>", " "), r"\s+", " "))
    return rows.select(label.alias("id"), label.alias("label"), F.nullif(F.regexp_extract("x", r'(?i)href="([^"]*)"', 1), F.lit("")).alias("href")).filter("label <> ''").distinct()


def empty(spark: SparkSession) -> Ontology:
    return Ontology(spark.createDataFrame([], SCHEMAS["nodes"]), spark.createDataFrame([], SCHEMAS["edges"]))
