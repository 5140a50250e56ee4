import pytest
from pyspark.sql import functions as F

from termweave import cli
from termweave.operators import assoc, search, similarity, triples
from termweave.operators.ontology import Ontology
from termweave.operators.validate import ParserConfig, validate

LINE = "A\t{}\tS\t{}\t{}\tPMID:1\t{}\t{}\t{}\t\t\tgene\ttaxon:1\t20231201\tX"


@pytest.fixture(scope="module")
def onto(spark):
    nodes = spark.createDataFrame([("GO:1", "one", "CLASS", False), ("GO:2", "two", "CLASS", False), ("GO:3", "old", "CLASS", True), ("GO:4", "older", "CLASS", True)], "id string, label string, type string, deprecated boolean")
    edges = spark.createDataFrame([("GO:2", "subClassOf", "GO:1")], "sub string, pred string, obj string")
    props = spark.createDataFrame([("GO:3", "IAO:0100001", "GO:2")], "id string, pred string, val string")
    return Ontology(nodes, edges, props=props)


def test_validate(spark, onto):
    data = [LINE.format("s1", "involved_in", "GO:2", "IDA", "", "P"), LINE.format("s2", "involved_in", "GO:3", "IDA", "GO:3", "P"), LINE.format("s3", "involved_in", "GO:4", "IDA", "", "P"), LINE.format("s4", "involved_in", "GO:9", "IDA", "", "P"), LINE.format("s5", "", "GO:1", "IPI", "", "F"), LINE.format("s6", "involved_in", "GO:1", "IBA", "", "P"), "bad"]
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(["!gaf-version: 2.2", *data])], "row_id long, value string")
    done = validate(lines, onto, ParserConfig(rule_set="all"))
    got = sorted((r.row_id, r.rule, r.level) for r in done.messages.collect())
    assert got == [(2, 17, "WARNING"), (2, 20, "WARNING"), (3, 20, "ERROR"), (4, 27, "WARNING"), (5, 18, "WARNING"), (6, 26, "ERROR"), (7, 1, "ERROR")]
    kept = {r.row_id: r for r in done.annotations.collect()}
    assert sorted(kept) == [1, 2, 4, 5] and kept[2].term == "GO:2" and kept[2].with_from == [["GO:2"]]
    assert done.counters.first().asDict() == {"lines": 7, "associations": 6, "skipped": 1}
    none = validate(lines, onto, ParserConfig())
    assert none.messages.filter("rule > 30 or rule in (17, 18, 26)").count() == 0


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.gaf").write_text("!gaf-version: 2.2\n" + LINE.format("s1", "involved_in", "GO:2", "IDA", "", "P"))
    (tmp_path / "o.obo").write_text("format-version: 1.2\n\n[Term]\nid: GO:1\nname: one\n\n[Term]\nid: GO:2\nname: two\nis_a: GO:1\n")
    o, f = str(tmp_path / "o.obo"), str(tmp_path / "a.gaf")
    for argv, want in ((["ontology", "-r", o, "two", "--to", "ancestors"], "GO:2\tGO:1"), (["assoc", "-r", o, "-f", f, "query", "GO:1"], "A:s1"), (["convert", f, "--to", "gpad-2.0"], "A:s1\t\tinvolved_in\tGO:2"), (["skim", f], "A:s1\tS\tGO:2"), (["ontology", "-r", o, "--to", "tree"], "* GO:1 ! one\n  % GO:2 ! two"), (["check", f, "-r", o], "associations: 1")):
        cli.main(argv)
        assert want in capsys.readouterr().out


def test_bio_objects_and_models(spark, onto):
    o = onto.add_parent("D:1", "H:2", "RO:0000091").add_parent("D:1", "M:1", "RO:0000091").add_parent("H:2", "H:1").add_node("D:1", "disease").add_parent("D:1", "T:9", "RO:0002162")
    r = o.bio_objects(inheritance=["H:1"]).filter("id = 'D:1'").first()
    assert r.taxon == "T:9" and [x.id for x in r.inheritance] == ["H:2"] and [x.id for x in r.modifiers] == ["M:1"] and r.leader == "D:1"
    unit = "array<array<struct<relation:string,term:string>>>"
    rows = spark.createDataFrame([("P:1", "GO:1", "F"), ("P:2", "GO:2", "P"), ("Q:1", "GO:1", "F")], "subject string, object string, aspect string").withColumn("extensions", F.array().cast(unit))
    made = triples.gene_models(rows, spark.createDataFrame([("P:1", "G:1"), ("P:2", "G:1")], "id string, parent string"))
    assert {r.graph for r in made.collect()} == {"G:1", "Q:1"}
    assert sorted(r.o for r in made.filter("graph = 'G:1' and p = 'rdf:type'").collect()) == ["GO:0003674", "GO:1", "GO:2", "P:1", "P:2"]
    wide = triples.grouped_values(spark.createDataFrame([("a", "p", "2"), ("a", "p", "1"), ("b", "q", "3")], "s string, p string, o string"), ["p", "q"]).orderBy("s")
    assert [tuple(r) for r in wide.collect()] == [("a", "1|2", ""), ("b", "", "3")]


def test_lookups_and_profiles(spark, onto):
    s = assoc.AssociationSet(spark.createDataFrame([("s1", "GO:2"), ("s2", "GO:1")], "subject string, object string"), onto)
    assert sorted(r.term for r in s.inferred_types("s1").collect()) == ["GO:1", "GO:2"] and s.between("s1", "GO:2").count() == 1
    with pytest.raises(KeyError):
        s.inferred_types("nobody", strict=True)
    assert s.labelled(spark.createDataFrame([("s1", "Sue")], "id string, label string")).filter("subject = 's1'").first().asDict() == {"subject": "s1", "subject_label": "Sue", "object": "GO:2", "object_label": "two"}
    prof = spark.createDataFrame([("x", "GO:2"), ("y", "GO:2"), ("z", "GO:1")], "id string, term string")
    got = {r.y: r.score for r in similarity.compare_profiles(prof, "x", s).collect()}
    assert got == {"y": 1.0, "z": 0.0}
    docs = spark.createDataFrame([(["a", "b", "a"], ["1", "2", "3"])], "k array<string>, v array<string>")
    assert search.zipped(docs, "k", "v", "m").first().m == {"a": "3", "b": "2"}
