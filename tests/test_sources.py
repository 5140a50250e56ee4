import gzip
import json

import pytest
from pyspark.sql import functions as F

from termweave.operators import parse, rules
from termweave.operators.ontology import Ontology
from termweave.sources import readers, writers

OBO = "http://purl.obolibrary.org/obo/"
GRAPH = {
    "@context": {"EX": "http://example.org/"},
    "graphs": [
        {
            "id": "g",
            "nodes": [
                {"id": f"{OBO}GO_0000001", "lbl": "root", "type": "CLASS"},
                {"id": f"{OBO}GO_0000002", "lbl": "child one", "type": "CLASS", "meta": {
                    "definition": {"val": 'a "quoted" one', "xrefs": ["PMID:1"]}, "subsets": [f"{OBO}go#slim_a"], "xrefs": [{"val": "MESH:1"}],
                    "synonyms": [{"pred": "hasExactSynonym", "val": "first child"}], "basicPropertyValues": [{"pred": "http://www.geneontology.org/formats/oboInOwl#hasOBONamespace", "val": "biological_process"}]}},
                {"id": f"{OBO}GO_0000003", "lbl": "old", "type": "CLASS", "meta": {"deprecated": True, "basicPropertyValues": [{"pred": f"{OBO}IAO_0100001", "val": f"{OBO}GO_0000002"}]}},
                {"id": f"{OBO}GO_0000009", "lbl": "gone", "type": "CLASS", "is_obsolete": "true"},
                {"id": "http://example.org/x", "lbl": "x", "type": "CLASS"},
            ],
            "edges": [{"sub": f"{OBO}GO_0000002", "pred": "is_a", "obj": f"{OBO}GO_0000001"}, {"sub": "http://example.org/x", "pred": f"{OBO}BFO_0000050", "obj": f"{OBO}GO_0000002"}],
            "equivalentNodesSets": [{"nodeIds": [f"{OBO}GO_0000001", "http://example.org/x"]}],
            "logicalDefinitionAxioms": [{"definedClassId": f"{OBO}GO_0000002", "genusIds": [f"{OBO}GO_0000001"], "restrictions": [{"propertyId": f"{OBO}BFO_0000050", "fillerId": "http://example.org/x"}, None]}],
            "propertyChainAxioms": [{"predicateId": f"{OBO}RO_1", "chainPredicateIds": [f"{OBO}RO_2", f"{OBO}RO_3"]}],
        }
    ],
}


@pytest.fixture
def graph(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps(GRAPH))
    return readers.ontology(spark, str(tmp_path / "g.json"))


def test_obograph(graph):
    assert {r.id for r in graph.nodes.collect()} == {"GO:0000001", "GO:0000002", "GO:0000003", "EX:x"}
    assert {tuple(r) for r in graph.edges.collect()} == {("GO:0000002", "subClassOf", "GO:0000001"), ("EX:x", "BFO:0000050", "GO:0000002"), ("GO:0000001", "equivalentTo", "EX:x"), ("EX:x", "equivalentTo", "GO:0000001")}
    assert [tuple(r) for r in graph.synonyms.collect()] == [("GO:0000002", "first child", "exact")]
    assert [r.id for r in graph.subset("slim_a").collect()] == ["GO:0000002"]
    assert [tuple(r) for r in graph.replaced_by(strict=True).collect()] == [("GO:0000003", ["GO:0000002"])]
    assert [r.id for r in graph.obsoletes().collect()] == ["GO:0000003"]
    assert graph.obo_namespace().first().namespace == "biological_process"
    assert graph.logical_defs.first().restrictions[0].filler == "EX:x" and graph.property_chains.first().chain == ["RO:2", "RO:3"]


def test_obo_round_trip(spark, graph, tmp_path):
    writers.save_lines(writers.obo(graph).coalesce(1), str(tmp_path / "out"))
    text = "format-version: 1.2\n\n" + "\n\n".join(r.value for r in writers.obo(graph).collect())
    assert 'def: "a \\"quoted\\" one" [PMID:1]' in text and "is_obsolete: true" in text
    (tmp_path / "g.obo").write_text(text)
    back = readers.ontology(spark, str(tmp_path / "g.obo"))
    assert {tuple(r) for r in back.nodes.select("id", "label", "deprecated").collect()} == {tuple(r) for r in graph.nodes.select("id", "label", "deprecated").collect()}
    isa = graph.edges.filter("pred = 'subClassOf'")
    assert {tuple(r) for r in back.edges.filter("pred = 'subClassOf'").collect()} == {tuple(r) for r in isa.collect()}
    assert [r.id for r in back.subset("slim_a").collect()] == ["GO:0000002"]


def test_handles(spark, graph, tmp_path):
    (tmp_path / "h.obo").write_text("format-version: 1.2\n\n[Term]\nid: GO:0000001\nname: other root\n\n[Term]\nid: Z:1\nname: z ! zed\nis_a: GO:0000001 ! root\nrelationship: part_of EX:x\n")
    both = readers.ontology(spark, f"{tmp_path}/g.json+{tmp_path}/h.obo")
    labels = {r.id: r.label for r in both.nodes.collect()}
    assert labels["GO:0000001"] == "other root" and labels["EX:x"] == "x" and "Z:1" in labels
    assert both.edges.filter("sub = 'Z:1' and pred = 'BFO:0000050'").count() == 1
    with pytest.raises(ValueError):
        readers.ontology(spark, "http://example.org/sparql")


def test_triples_and_skos(spark, tmp_path):
    (tmp_path / "a.nt").write_text(
        "\n".join([
            "<http://ex.org/A> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.w3.org/2002/07/owl#Class> .",
            "<http://ex.org/B> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <http://ex.org/A> .",
            '<http://ex.org/A> <http://www.w3.org/2000/01/rdf-schema#label> "a \\"label\\""@en .',
            "_:b <http://www.w3.org/2000/01/rdf-schema#subClassOf> <http://ex.org/A> .", "# no triple",
        ])
    )
    onto = readers.ontology(spark, str(tmp_path / "a.nt"))
    assert {(r.id, r.label) for r in onto.nodes.collect()} == {("http://ex.org/A", 'a "label"'), ("http://ex.org/B", None)}
    (tmp_path / "s.ttl").write_text('''@prefix skos: <http://www.w3.org/2004/02/skos/core#> .
@prefix e: <http://e.org/> .
e:1 a skos:Concept ;
  skos:prefLabel "one"@en , "eins"@de ;
  skos:altLabel "uno; first"@en ;
  skos:inScheme e:s .
e:2 a skos:Concept ; skos:broader e:1 ; skos:prefLabel "two"@en ; skos:exactMatch <http://other.org/2> .
''')
    s = readers.ontology(spark, f"skos:{tmp_path}/s.ttl")
    assert {(r.id, r.label) for r in s.nodes.collect()} == {("e:1", "one"), ("e:2", "two")}
    assert [tuple(r) for r in s.edges.collect()] == [("e:2", "subClassOf", "e:1")]
    assert [r.val for r in s.synonyms.collect()] == ["uno; first"] and [r.xref for r in s.xrefs.collect()] == ["http://other.org/2"]
    assert [r.id for r in s.subset("e:s").collect()] == ["e:1"]


GAF = [
    "!gaf-version: 2.2", "! comment",
    "MGI\tMGI:1\tAbc\tNOT|enables\tGO:1\tPMID:1|GO_REF:2\tIPI\tUniProtKB:P1,UniProtKB:P2|X:3\tF\tname\tsyn\tgene\ttaxon:10090|taxon:562\t20200102\tMGI\tpart_of(CL:1),occurs_in(CL:2)\tPR:1",
    "A\tb\tS\tinvolved_in\tGO:2\tPMID:1\tIDA\t\tP\t\t\tgene\ttaxon:9606\t2020-01-02\tX",
    "A\tb\tS|T\tinvolved_in\tGO:2\tPMID:1\tIDA\t\tP\t\t\tgene\ttaxon:9606\t20200102\tX",
    "too\tfew", "",
    "A\tb\tS\tinvolved_in\tGO:2\tPMID:1\tIDA\t\tP\t\t\tgene\ttaxon:0\t20200102\tX",
    "A\tb\tS\tinvolved_in\tGO:2\tPMID:1\tIDA\t\tP\t\t\tgene\ttaxon:1\tsoon\tX",
]


def test_gaf(spark, tmp_path):
    with gzip.open(tmp_path / "a.gaf.gz", "wt") as f:
        f.write("\n".join(GAF))
    rows = readers.associations(spark, str(tmp_path / "a.gaf.gz"))
    got = {r.problem: r for r in rows.collect()}
    assert set(got) == {None, "symbol holds |", "too few columns", "taxon can't be read", "date can't be read"}
    first = rows.filter("evidence = 'IPI'").first()
    assert first.subject == "MGI:1" and first.negated and first.relation == "enables" and first.taxa == ["NCBITaxon:10090", "NCBITaxon:562"]
    assert first.with_from == [["UniProtKB:P1", "UniProtKB:P2"], ["X:3"]] and [u.term for u in first.extensions[0]] == ["CL:1", "CL:2"]
    ok = rows.filter("problem is null")
    assert str(ok.filter("evidence = 'IDA'").first().date) == "2020-01-02"
    assert parse.counters(rows).first().asDict() == {"lines": 6, "associations": 2, "skipped": 4}
    line = writers.gaf(ok.filter("evidence = 'IPI'")).first().value
    assert line == GAF[2].replace("MGI:1\tAbc", "1\tAbc")
    assert writers.gaf(ok.filter("evidence = 'IPI'"), "2.1").first().value.split("\t")[3] == "NOT"


def test_gpad_versions(spark, tmp_path):
    (tmp_path / "one.gpad").write_text("!gpa-version: 1.1\n!gpad-version: 1.2\nMGI\tMGI:1\tNOT|part_of\tGO:1\tPMID:1\tECO:1\t\t\t20200102\tX\t\tk=v|w=")
    (tmp_path / "two.gpad").write_text("!gpad-version: 2.0\nMGI:1\tNOT\tRO:1\tGO:1\tPMID:1\tECO:1\t\tNCBITaxon:5\t2020-01-02\tX\tBFO:1(CL:1)\tk=v")
    one, two = (readers.associations(spark, str(tmp_path / f"{n}.gpad")) for n in ("one", "two"))
    a, b = one.first(), two.first()
    assert (a.subject, a.negated, a.relation, a.problem) == ("MGI:1", True, "part_of", None)
    assert (b.subject, b.negated, b.relation, str(b.date), b.problem) == ("MGI:1", True, "RO:1", "2020-01-02", None)
    out = writers.gpad(two.withColumn("taxa", F.array(F.lit("a:1"), F.lit("NCBITaxon:5"))), "2.0").first().value
    assert out == "MGI:1\tNOT\tRO:1\tGO:1\tPMID:1\tECO:1\t\tNCBITaxon:5\t2020-01-02\tX\tBFO:1(CL:1)\tk=v"
    assert writers.gpad(one.withColumn("taxa", F.array().cast("array<string>")), "1.2").first().value.startswith("MGI\t1\tNOT|part_of\tGO:1")


def test_entities(spark, tmp_path):
    (tmp_path / "a.gpi").write_text("!gpi-version: 1.2\nA\tb\tS\tname\tx|y\tprotein\ttaxon:9\tA:p\tZ:1\tk=v")
    (tmp_path / "b.gpi").write_text("!!gpi-version: 2.0\nPR:1\tS\tname\tx\tPR:t\tNCBITaxon:9\tA:g\tA:p\t\tZ:1\tk=v")
    one, two = (readers.entities(spark, str(tmp_path / n)) for n in ("a.gpi", "b.gpi"))
    assert one.first().id == "A:b" and one.first().taxon == "NCBITaxon:9" and one.first().synonyms == ["x", "y"]
    assert two.first().encoded_by == ["A:g"]
    assert writers.gpi(two).first().value == "PR:1\tS\tname\tx\tPR:t\tNCBITaxon:9\tA:g\tA:p\t\tZ:1\tk=v"
    assert writers.gpi(one, "1.2").first().value == "A\tb\tS\tname\tx|y\tprotein\ttaxon:9\tA:p\tZ:1\tk=v"
    (tmp_path / "b.json").write_text(json.dumps({"data": [{"primaryId": "FB:1", "symbol": "s", "name": "n", "soTermId": "SO:1", "taxonId": "NCBITaxon:7"}]}))
    assert readers.basic_gene_information(spark, str(tmp_path / "b.json")).first().synonyms == []


def test_hpoa(spark, tmp_path):
    (tmp_path / "a.hpoa").write_text("\t".join(["OMIM", "1", "S", "NOT", "HP:1", "OMIM:1", "IEA", "", "", "", "O", "", "2009.02.17", "HPO"]))
    r = readers.associations(spark, str(tmp_path / "a.hpoa"), "hpoa").first()
    assert (r.subject, r.negated, r.relation, r.taxa, r.problem) == ("OMIM:1", True, "has_phenotype", ["NCBITaxon:9606"], None)


def test_lookups(spark, tmp_path):
    (tmp_path / "eco.txt").write_text("# c\nIEA\tGO_REF:1\tECO:1\nIEA\tDefault\tECO:2\n")
    codes = readers.evidence_table(spark, str(tmp_path / "eco.txt"))
    rows = spark.createDataFrame([("IEA", "GO_REF:1"), ("IEA", "X:1"), ("Q", "X:1")], "evidence string, reference string")
    assert [r.eco for r in parse.evidence_classes(rows, codes).orderBy("evidence", "reference").collect()] == ["ECO:1", "ECO:2", None]
    (tmp_path / "m.yaml").write_text("- database: A\n  name: first\n- database: B\n")
    assert [tuple(r) for r in readers.metadata(spark, str(tmp_path / "m.yaml"), "database string, name string").collect()] == [("A", "first"), ("B", None)]
    (tmp_path / "r.txt").write_text("! x\nPMID:1,why\nPMID:2\n")
    assert [r.id for r in readers.retracted(spark, str(tmp_path / "r.txt")).collect()] == ["PMID:1", "PMID:2"]
    inf = [{"annotation": {"annotation": {"relation": "r", "term": "GO:1"}, "taxon": "T:1", "extension": [{"relation": "p", "term": "C:1"}]}, "satisfiable": True, "taxonProblem": False, "inferences": [{"relation": "q", "term": "GO:2"}]}]
    (tmp_path / "i.json").write_text(json.dumps(inf))
    table = readers.inferences(spark, str(tmp_path / "i.json"))
    ext = F.array(F.array(F.struct(F.lit("p").alias("relation"), F.lit("C:1").alias("term"))))
    rows = spark.createDataFrame([(1, "S", "r", "GO:1", "IDA", ["T:1"])], "row_id long, subject string, relation string, term string, evidence string, taxa array<string>").withColumn("extensions", ext)
    flagged, new = rules.infer(rows, table)
    assert [(r.relation, r.term, r.inferred_relation) for r in new.collect()] == [("r", "GO:2", "q")] and not flagged.first().taxon_problem
    (tmp_path / "p.json").write_text(json.dumps({"patient": {"id": "P", "features": [{"id": "HP:1", "observed": "no"}], "disorders": [{"id": "MIM:5"}]}}))
    from termweave.operators.similarity import patient_features

    assert patient_features(readers.patients(spark, str(tmp_path / "p.json"))).first().terms == ["OMIM:5"]
    pages = spark.createDataFrame([('<h5>A b</h5><ul><li><a href="/x">C <b>d</b></a></li></ul>',)], "html string")
    assert {(r.label, r.href) for r in readers.scraped_names(pages).collect()} >= {("A b", None), ("C d", "/x")}


def test_renderers(spark, graph):
    lines = [r.value for r in writers.tree(graph, ["subClassOf", "BFO:0000050"]).collect()]
    assert lines == ["* GO:0000001 ! root", "  % GO:0000002 ! child one", "    < EX:x ! x"]
    assert any('"EX:x" -> "GO:0000002"' in r.value for r in writers.dot(graph).collect())
    assert writers.obograph(graph).filter("list = 'nodes'").count() == 4
    assert writers.names(graph).first().value == "EX:x x"
    numbers = [r.value.split("\t")[:3] for r in writers.compact(graph).collect() if r.value.startswith("N")]
    assert sorted(numbers) == [["N", str(i), x] for i, x in enumerate(["EX:x", "GO:0000001", "GO:0000002", "GO:0000003"])]


def test_tree_of_any_depth(spark):
    deep = Ontology.of_edges(spark.createDataFrame([(f"n{i + 1:02}", "subClassOf", f"n{i:02}") for i in range(63)], "sub string, pred string, obj string"))
    assert [r.path[-1] for r in writers.tree(deep).select("path").collect()] == [f"n{i:02}" for i in range(64)]
    assert writers.tree(deep, most=2).count() == 3


def test_reports(spark):
    found = spark.createDataFrame([(1, 2, "ERROR", "m"), (2, 2, "WARNING", "n"), (3, 5, "INFO", "o")], "row_id long, rule int, level string, message string")
    counters = spark.createDataFrame([(3, 2, 1)], "lines long, associations long, skipped long")
    doc = json.loads(writers.report(found, counters, "g", "d", 1).first().value)
    assert doc["lines"] == 3 and list(doc["messages"]) == ["0000002"] and len(doc["messages"]["0000002"]) == 1
    text = writers.report_markdown(found, counters, "T")
    assert "## Rule 2" in text and "Rule 5" not in text
    lines = spark.createDataFrame([("!h",), ("a\tb\tc\td\te\tf\tIEA",), ("a\tb\tc\td\te\tf\tIDA",)], "value string")
    assert [r.value[-3:] for r in writers.without_evidence(lines, ["IEA"]).collect()] == ["!h", "IDA"]
    assert [r.value for r in writers.merged_lines(lines, [lines]).collect()][:2] == ["!h", "!h"]


def test_ntriples_writer(spark):
    from termweave.operators import triples as R

    t = spark.createDataFrame([("EX:1", "EX:p", "EX:2"), ("_:b", "EX:p", 'a "word"')], "s string, p string, o string")
    assert [r.value for r in R.ntriples(t, {"EX": "http://e/"}).collect()] == ["<http://e/1> <http://e/p> <http://e/2> .", '_:b <http://e/p> "a \\"word\\"" .']
