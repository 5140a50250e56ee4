from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from termweave.functions import stats, text
from termweave.operators import assoc, blocks, closure, differ, lexmap, ontology, parse, rules, search, similarity, triples
from termweave.operators.ontology import Ontology, expand_labels

# b and c under a, d under both, e part of d; x and y on a cycle; z alone
EDGES = [("b", "subClassOf", "a"), ("c", "subClassOf", "a"), ("d", "subClassOf", "b"), ("d", "subClassOf", "c"), ("e", "BFO:0000050", "d"), ("x", "subClassOf", "y"), ("y", "subClassOf", "x")]


@pytest.fixture(scope="module")
def onto(spark):
    o = Ontology.of_edges(spark.createDataFrame(EDGES, "sub string, pred string, obj string"))
    return o.add_node("z", "zed").add_to_subset("a", "g#slim").add_to_subset("b", "g#slim").add_to_subset("b", "g#other").add_synonym("d", "dee").add_xref("d", "X:1").add_xref("e", "a")


def ids(df, *cols):
    return sorted(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect())


def test_closure(onto):
    assert ids(onto.ancestors(["d", "nothing"]), "id", "anc") == [("d", "a"), ("d", "b"), ("d", "c")]
    assert ids(onto.ancestors(["nothing"], reflexive=True), "id", "anc") == [("nothing", "nothing")]
    assert ids(onto.ancestors(["e"], ["subClassOf"]), "anc") == []
    assert ids(onto.ancestors(["x"]), "anc") == ["y"]  # never itself, cycle or not
    assert ids(onto.descendants(["b"]), "desc") == ["d", "e"]
    assert ids(closure.in_cycles(onto.edges), "id") == ["x", "y"]
    assert ids(closure.strong_components(onto.edges, onto.nodes).filter("id in ('x', 'y', 'a')"), "id", "component") == [("a", "a"), ("x", "x"), ("y", "x")]
    assert ids(closure.simple_cycles(onto.edges).select(F.array_join("path", "").alias("p")), "p") == ["xy"]
    with pytest.raises(ValueError):
        closure.topological(onto.edges, onto.nodes, 20)


def test_shape(onto):
    assert ids(onto.roots(), "id") == ["a"]
    assert ids(onto.level(2), "id") == ["d", "d"]  # a bag
    assert ids(onto.levels(2), "level", "id", "n") == [(0, "a", 1), (1, "b", 1), (1, "c", 1), (2, "d", 2)]
    assert ids(onto.neighbors().filter("id = 'd'"), "neighbor") == ["b", "c", "e"]
    assert dict(ids(onto.parent_index().filter("id in ('d', 'z')").select("id", F.array_join("parents", "").alias("p")), "id", "p")) == {"d": "bc", "z": ""}
    assert ids(onto.subontology(["a", "b", "d"]).edges, "sub", "obj") == [("b", "a"), ("d", "b")]
    assert ids(onto.traverse(["b"], True, True), "id") == ["a", "b", "d", "e"]
    assert ids(onto.chain(["e"], ["BFO:0000050", "subClassOf"]), "sink") == ["b", "c"]
    assert ids(onto.bundle("d", up=1), "id") == ["b", "c", "d"]
    assert ids(onto.subset_expression("slim,other|slim"), "id") == ["a", "b"]


def test_slim_and_minimal(onto):
    got = {r.id: r.slim for r in onto.slim_map(onto.subset("slim")).collect()}
    assert got["d"] == "b" and got["c"] == "a" and got["z"] is None
    with pytest.raises(ValueError):
        onto.slim_map(onto.subset("none"))
    with pytest.raises(ValueError):
        onto.slim_map(onto.subset("slim"), ["regulates"])
    small = onto.minimal_subgraph(["e", "c"])
    assert ids(small.nodes, "id") == ["a", "c", "e"] or ids(small.nodes, "id") == ["c", "e"]
    assert ids(small.edges, "sub", "obj")[0][0] in ("c", "e")


def test_minimal_without_whole_closure(spark, onto, monkeypatch):
    fresh = Ontology(onto.nodes, onto.edges)
    small = fresh.minimal_subgraph(["e", "c"])
    assert ids(small.nodes, "id") == ["c", "e"] and not fresh._closures
    assert ids(fresh.minimal_subgraph(["x", "nothing"]).nodes, "id") == ["x"]
    monkeypatch.setattr(ontology, "WALKED", 1)
    deep = Ontology(onto.nodes, onto.edges).minimal_subgraph(["e", "c"])  # more steps than are walked
    assert ids(deep.nodes, "id") == ["c", "e"] and ids(deep.edges, "sub", "obj") == ids(fresh.minimal_subgraph(["e", "c"]).edges, "sub", "obj")


def test_search_labels_xrefs(spark, onto):
    assert ids(onto.search(["dee"], synonyms=True), "id") == ["d"]
    assert ids(onto.search(["z%"]), "id") == ["z"] and ids(onto.search(["A:1"]), "id") == ["A:1"] and ids(onto.search(["e"], partial=True), "id") == ["e", "z"]
    assert ids(onto.xrefs_of(bidirectional=True), "id", "xref") == [("X:1", "d"), ("a", "e"), ("d", "X:1"), ("e", "a")]
    assert ids(onto.with_xref_edges().edges.filter("pred = 'xref'"), "sub", "obj") == [("a", "e"), ("e", "a")]
    rows = spark.createDataFrame([("z", 1), ("q", 2)], "gene string, n int")
    assert [tuple(r) for r in expand_labels(rows, ["gene"], onto.labels()).orderBy("n").collect()] == [("z", "zed", 1), ("q", None, 2)]


@pytest.fixture(scope="module")
def aset(spark, onto):
    rows = spark.createDataFrame([("s1", "d"), ("s2", "b"), ("s3", "c"), ("s3", "unknown"), ("s1", "d")], "subject string, object string")
    known = spark.createDataFrame([("s0",), ("s1",), ("s2",), ("s3",)], "subject string")
    return assoc.AssociationSet(rows, onto, known)


def test_boolean_query(aset):
    assert ids(aset.query(), "subject") == ["s0", "s1", "s2", "s3"]
    assert ids(aset.query(["b"]), "subject") == ["s1", "s2"] and ids(aset.query(["b", "c"]), "subject") == ["s1"]
    assert ids(aset.query([], ["b", "c"]), "subject") == ["s0"] and ids(aset.query(["a"], ["b"]), "subject") == ["s3"]
    assert ids(aset.query(["owl:Thing"]), "subject") == ["s0", "s1", "s2", "s3"] and ids(aset.query(["unknown"]), "subject") == ["s3"]


def test_intersections_and_similarity(spark, aset):
    cells = {(r.x, r.y): (r.c, r.j) for r in aset.intersections(["b", "none"], ["c", "b"]).collect()}
    assert cells[("b", "c")] == (1, pytest.approx(1 / 3)) and cells[("b", "b")] == (2, 1.0) and cells[("none", "b")] == (0, 0.0)
    pairs = spark.createDataFrame([("s1", "s2"), ("s0", "s0")], "a string, b string")
    assert {r.a: r.j for r in aset.jaccard(pairs).collect()} == {"s1": 0.5, "s0": 0.0}
    assert {r.a: r.cosine for r in similarity.cosine_binary(aset, pairs).collect()}["s1"] == pytest.approx(2 / 8**0.5)
    near = {(r.a, r.b): r.c for r in aset.similar_subjects(["s1", "s2", "s3"]).collect()}
    assert near == {("s1", "s2"): 2, ("s1", "s3"): 2, ("s2", "s3"): 1}  # what all share counts too
    ic = {r.term: r.ic for r in similarity.information_content(aset).collect()}
    assert ic["a"] == pytest.approx(0.41503749927884376) and ic["d"] == 2.0
    found = [(r.subject, r["rank"]) for r in similarity.search_profiles(aset, ["d"]).collect()]
    assert found[0] == ("s1", 1)


def test_similar_subjects_make_no_rows_of_shared_terms(spark, aset):
    """without common terms too, subjects that share a term meet once, not once for each term."""
    near = aset.similar_subjects(["s1", "s2", "s3"], 2.0)
    assert "Aggregate" not in near._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.a, r.b): (r.c, r.j) for r in near.collect()} == {("s1", "s2"): (2, 2 / 4), ("s1", "s3"): (2, 2 / 5), ("s2", "s3"): (1, 1 / 4)}
    sizes = {r.subject: r.n for r in aset.numbered().selectExpr("subject", "explode(terms) AS t").distinct().groupBy("subject").agg(F.count("*").alias("n")).collect()}
    assert sizes == {r.subject: r.n for r in aset.inferred.groupBy("subject").agg(F.count("*").alias("n")).collect()}


def test_similar_subjects_with_common_terms_shuffle_no_pairs(spark, aset):
    """where terms are common, the dense result isn't joined with the pairs that share others."""
    near = aset.similar_subjects(["s1", "s2", "s3"], 0.5)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "x_block" in plan  # blocks with blocks
    assert ids(near, "a", "b", "c", "j") == ids(aset.similar_subjects(["s1", "s2", "s3"]), "a", "b", "c", "j")


@pytest.mark.parametrize("dense", [0, 3, 1 << 40])
def test_shared_counts_over_many_blocks(spark, monkeypatch, dense):
    """blocks against blocks give the rows of all pairs, by lists, by matrix products and by both; j is rounded half up."""
    for name, value in (("SUBJECTS", 7), ("CELLS", 40), ("MEETINGS", 5), ("DENSE", dense)):
        monkeypatch.setattr(blocks, name, value)
    sets = {f"s{k}": {k % 3, 10 + k % 7, 100 + k // 2, *range(200, 200 + k % 5)} for k in range(45)}
    sets |= {"S": set(range(1000, 1512)), "é": {1000}, "z": {5000}}
    rows = [(s, sorted(x)[part::2]) for s, x in sets.items() for part in (0, 1)] + [("s1", [1, 1])]
    lists = spark.createDataFrame(rows, "subject string, terms array<long>")
    fits = []
    for a in sets:
        for b in sets:
            if a < b and (c := len(sets[a] & sets[b])):
                j = (Decimal(c) / len(sets[a] | sets[b])).quantize(Decimal("1e-8"), ROUND_HALF_UP)
                fits.append((a, b, c, float(j)))
    assert ids(blocks.shared_counts(lists, 8), "a", "b", "c", "j") == sorted(fits) and ("S", "é", 1, 0.00195313) in fits
    if not dense:
        assert blocks.shared_counts(lists.filter("false")).count() == 0


def test_fisher(spark):
    from math import comb

    def want(a, b, c, d, side):
        n, k, m = a + b + c + d, a + c, a + b
        p = {i: comb(k, i) * comb(n - k, m - i) / comb(n, m) for i in range(max(0, m + k - n), min(k, m) + 1)}
        keep = {"greater": lambda i: i >= a, "less": lambda i: i <= a, "two-sided": lambda i: p[i] <= p[a] * (1 + 1e-7)}[side]
        return min(1, sum(v for i, v in p.items() if keep(i)))

    cells = [(3, 1, 1, 3), (0, 5, 4, 90), (12, 0, 3, 400), (1, 0, 0, 1), (7, 30, 8, 2_000)]
    df = spark.createDataFrame(cells, "a long, b long, c long, d long")
    for side in ("greater", "less", "two-sided"):
        got = {r.a: r.p for r in df.select("a", stats.fisher(*map(F.col, "abcd"), side).alias("p")).collect()}
        for cell in cells:
            assert got[cell[0]] == pytest.approx(want(*cell, side), rel=1e-9)


def test_enrichment_tests_equal_counts_once(spark, monkeypatch):
    rows = [(f"s{k}", t) for k in range(6) for t in ("t", "u", "v") if k < 4 or t == "v"]
    made = assoc.AssociationSet(spark.createDataFrame(rows, "subject string, object string"), Ontology.of_edges(spark.createDataFrame([], "sub string, pred string, obj string")))
    got = {r.term: (r.sample_count, r.bg_count, r.p) for r in made.enrichment(["s0", "s1"], threshold=2.0, side="two-sided").collect()}
    assert got["t"] == got["u"] == (2, 4, pytest.approx(7 / 15)) and got["v"] == (2, 6, 1.0)
    monkeypatch.setattr(assoc, "fisher", lambda *_: F.rand())
    got = {r.term: r.p for r in made.enrichment(["s0", "s1"], threshold=2.0).collect()}
    assert got["t"] == got["u"] != got["v"]


def test_mica_and_mrca(spark, onto):
    pairs = spark.createDataFrame([("b", "c"), ("d", "e"), ("a", "z")], "a string, b string")
    closed = onto.closure()
    assert ids(similarity.mrca(pairs, onto.reflexive_closure(), closed), "a", "b", "anc") == [("b", "c", "a"), ("d", "e", "d")]
    assert ids(similarity.mrca(pairs, onto.reflexive_closure(), onto.parents().toDF("term", "anc")), "a", "b", "anc") == [("b", "c", "a"), ("d", "e", "d")]
    ic = spark.createDataFrame([("a", 0.5), ("d", 2.0), ("b", 1.0)], "term string, ic double")
    got = {r.a: (r.ic, r.terms) for r in similarity.mica(pairs, onto.reflexive_closure(), ic).collect()}
    assert got == {"b": (0.5, ["a"]), "d": (2.0, ["d"]), "a": (0.0, [])}
    profiles = spark.createDataFrame([("p", "b"), ("p", "z"), ("q", "c"), ("q", "e"), ("r", "z")], "id string, term string")
    two = spark.createDataFrame([("p", "q"), ("q", "p"), ("p", "r"), ("p", "p")], "x string, y string")
    cells = similarity.term_pairs(profiles, two)
    slow = similarity.resnik_bma(cells.join(similarity.mica(cells, onto.reflexive_closure(), ic).select("a", "b", "ic"), ["a", "b"]))
    fast = similarity.resnik_bma_of(profiles, two, onto.reflexive_closure(), ic)
    assert ids(fast, "x", "y", "score", "rows", "cols") == ids(slow, "x", "y", "score", "rows", "cols") and fast.count() == 4
    scores = spark.createDataFrame([("a", 0.405), ("b", 0.511), ("c", 0.405), ("d", 0.908)], "id string, score double")
    assert {r.id: r["rank"] for r in similarity.ranked(scores).collect()} == {"a": 3, "b": 2, "c": 3, "d": 1}


def test_lexical_mapping(spark):
    rows = [("TEST:1", "T", "foo bar", "label"), ("TEST:2", "T", "bar foo", "label"), ("TEST:3", "T", "foo bar", "label"), ("TEST:4", "T", "1 2", "label"), ("TEST:5", "T", "ABCD", "label"), ("TEST:6", "T", "ABCD", "exact")]
    idx = lexmap.index(spark.createDataFrame(rows, "id string, ont string, val string, scope string"), normal_weight=0.25)
    best = {(r.a, r.b): r.score for r in lexmap.best_pairs(lexmap.pairs(idx)).collect()}
    assert best == {("TEST:1", "TEST:3"): 100, ("TEST:1", "TEST:2"): 25, ("TEST:2", "TEST:3"): 25, ("TEST:5", "TEST:6"): 22}
    full = lexmap.reciprocal(lexmap.best_pairs(lexmap.pairs(idx)))
    assert ids(lexmap.unmapped(spark.createDataFrame([("TEST:1",), ("TEST:4",)], "id string"), full), "id") == ["TEST:4"]
    weights = lexmap.axiom_weights(full, spark.createDataFrame([], "term string, anc string")).first().pr
    assert sum(weights) == pytest.approx(1) and max(weights) == weights[2]
    seen = spark.createDataFrame([("X of the IV", "camelCase")], "a string, b string").select(text.normal_label(text.standard_label(F.col("a"))).alias("a"), text.standard_label(F.col("b")).alias("b")).first()
    assert tuple(seen) == ("10 4", "camel case")


def test_text(spark):
    one = lambda **c: spark.range(1).select(*(v.alias(k) for k, v in c.items())).first()
    r = one(a=text.curie(F.lit("A:b:c")), b=text.identifier_problem(F.lit("doi:10.1/x(1)")), c=text.identifier_problem(F.lit("A:b|c")), d=text.without_double_prefix(F.lit("MGI:MGI:1")))
    assert (r.a.namespace, r.a.identity, r.a.error, r.b, r.c, r.d) == ("A", "b:c", None, None, "bad character", "MGI:1")
    r = one(a=text.contracted(F.lit("http://e/x#1"), {"E": "http://e/", "X": "http://e/x#"}), b=text.expanded(F.lit("E:a b"), {"E": "http://e/"}), c=text.prefix(F.lit("http://e/x#1")), d=text.iso_date(F.lit("2020-01-02T03:04")))
    assert (r.a, r.b, r.c, r.d.time) == ("X:1", "http://e/a_b", "http://e/x", "03:04")
    r = one(a=text.longest_highlight(F.array(F.lit("<em>a</em> b"), F.lit("x <em>abc</em>"))), b=parse.qualifier_problem(F.lit("NOT|enables"), "2.2"), c=parse.qualifier_problem(F.lit("foo"), "2.1"), d=parse.taxa(F.lit("taxon:x")))
    assert tuple(r) == ("x abc", None, "unknown qualifier", None)


def _rule_rows(spark):
    unit = "array<array<struct<relation:string,term:string>>>"
    cols = "row_id long, subject string, subject_type string, taxa array<string>, relation string, term string, aspect string, negated boolean, evidence string, references array<string>, with_from array<array<string>>, assigned_by string, date date"
    import datetime

    day = datetime.date(2023, 12, 1)
    base = ("S:1", "gene", ["T:1"], "involved_in", "GO:9", "P", False, "IDA", ["PMID:1"], [], "X", day)
    change = lambda i, **k: (i, *(k.get(n, v) for n, v in zip("subject subject_type taxa relation term aspect negated evidence references with_from assigned_by date".split(), base)))
    rows = [
        change(1), change(2, term="GO:5515x"), change(3, term="GO:0005515", negated=True), change(4, evidence="ND"), change(5, evidence="IPI"), change(6, aspect="F"),
        change(7, relation="enables"), change(8, evidence="IEA", date=datetime.date(2019, 1, 1)), change(9, evidence="ISS", with_from=[["S:1"]]), change(10, references=["PMID:1", "PMID:2"]),
        change(11, evidence="IBA"), change(12, with_from=[["A:1"]]),
    ]
    return spark.createDataFrame(rows, cols).withColumn("extensions", F.array().cast(unit))


def test_rules(spark, onto):
    terms = spark.createDataFrame([("GO:9", "P", [])], "id string, aspect string, subsets array<string>")
    flagged = rules.with_flags(_rule_rows(spark), onto.reflexive_closure(), terms)
    done = rules.run(flagged, rules.standard_rules())
    got = {r.row_id: [x.rule for x in r.results] for r in done.collect()}
    assert got == {1: [], 2: [], 3: [2], 4: [11], 5: [18], 6: [28], 7: [61], 8: [29], 9: [50], 10: [55], 11: [26], 12: [17]}
    fixed = {r.row_id: r for r in done.collect()}
    assert fixed[6].aspect == "P" and fixed[7].relation == "acts_upstream_of_or_within" and fixed[8].dropped and not fixed[6].dropped
    assert rules.run(flagged, rules.standard_rules(), None).filter("size(results) > 0").count() == 0
    assert {r.rule for r in rules.messages(rules.run(flagged, rules.standard_rules(), [17]), rules.standard_rules(), [17]).collect()} == {17}
    cases = flagged.filter("row_id in (1, 12)").withColumn("rule_id", F.lit(17)).withColumn("kind", F.when(F.col("row_id") == 1, "pass").otherwise("fail"))
    assert all(r.ok for r in rules.examples(cases, rules.standard_rules()).collect())


def test_extension_constraints(spark, onto):
    unit = F.struct(F.lit("part_of").alias("relation"), F.lit("CL:1").alias("term"))
    odd = F.struct(F.lit("has").alias("relation"), F.lit("CL:1").alias("term"))
    rows = _rule_rows(spark).filter("row_id = 1").withColumn("extensions", F.array(F.array(unit), F.array(unit, odd)))
    terms = spark.createDataFrame([("GO:9", "P", [])], "id string, aspect string, subsets array<string>")

    def check(constraints, contexts=("import",)):
        allowed = None
        if constraints is not None:
            made = spark.createDataFrame(constraints, "relation string, namespaces array<string>, primary_root_terms array<string>, cardinality int")
            allowed = rules.constraint_closure(made, onto.reflexive_closure())
        got = rules.run(rules.with_flags(rows, onto.reflexive_closure(), terms, constraints=allowed), rules.standard_rules(), contexts=contexts).first()
        return [x.rule for x in got.results], len(got.extensions)

    assert check([("part_of", ["CL"], ["GO:9"], None)]) == ([58], 1) and check([("part_of", ["CL"], ["GO:9"], None)], ()) == ([], 2)
    assert check([("part_of", ["CL"], ["GO:9"], None), ("has", ["CL", "X"], ["GO:9"], 1)]) == ([], 2)
    assert check([("part_of", ["CL"], ["GO:8"], None)]) == ([58], 0)  # of another term
    assert check(None) == ([], 2)  # without constraints all pass


def test_extension_cardinality(spark, onto):
    unit = lambda t: F.struct(F.lit("part_of").alias("relation"), F.lit(t).alias("term"))
    rows = _rule_rows(spark).filter("row_id = 1").withColumn("extensions", F.array(F.array(unit("CL:1"), unit("CL:2"))))
    for most, want in ((1, 0), (2, 1), (None, 1)):
        made = spark.createDataFrame([("part_of", ["CL"], ["GO:9"], most)], "relation string, namespaces array<string>, primary_root_terms array<string>, cardinality int")
        flagged = rules.with_flags(rows, onto.reflexive_closure(), spark.createDataFrame([("GO:9", "P", [])], "id string, aspect string, subsets array<string>"), constraints=rules.constraint_closure(made, onto.reflexive_closure()))
        assert len(rules.run(flagged, rules.standard_rules(), contexts=["import"]).first().extensions) == want


def test_evidence_of_another_class(spark):
    table = spark.createDataFrame([("IEA", None, "ECO:1"), ("IEA", "GO_REF:2", "ECO:2"), ("IEA", "GO_REF:3", "ECO:1")], "code string, ref string, cls string")
    rows = spark.createDataFrame([(1, "IEA", ["GO_REF:2"]), (2, "IEA", ["GO_REF:3"]), (3, "IEA", []), (4, "IDA", ["GO_REF:2"]), (5, None, [])], "row_id long, evidence string, references array<string>")
    assert {r.row_id: r.code for r in rules.with_code(rows, table).collect()} == {1: "", 2: "IEA", 3: "IEA", 4: "IDA", 5: ""}


def test_repairs(spark):
    rows = spark.createDataFrame([(1, [["A:1", "B:1"], ["A:1"]]), (2, [])], "row_id long, with_from array<array<string>>")
    new = spark.createDataFrame([("A:1", ["C:1"])], "id string, replacements array<string>")
    assert {r.row_id: r.with_from for r in parse.repaired_lists(rows, new).collect()} == {1: [["C:1", "B:1"], ["C:1"]], 2: []}
    spaces = spark.createDataFrame([("UniProt", "UniProtKB")], "prefix string, canonical string")
    assert parse.canonical_spaces(spark.createDataFrame([("UniProt:1",), ("Q:1",)], "subject string"), spaces).orderBy("subject").select("subject", "known_space").collect() == [("Q:1", False), ("UniProtKB:1", True)]


def test_faceted_search(spark):
    docs = spark.createDataFrame([("1", "g:1", "p:1", "r", ["p:1", "p:0"], "e1"), ("2", "g:1", "p:2", "r", ["p:2", "p:0"], "e2"), ("3", "p:1", "g:1", "r", ["g:1"], "e1")], "id string, subject string, object string, relation string, object_closure array<string>, evidence string")
    q = search.AssociationQuery
    assert ids(q(objects=["p:0"]).run(docs), "id") == ["1", "2"] and ids(q(objects=["p:1"], object_direct=True).run(docs), "id") == ["1"]
    assert ids(q(subjects=["g:1"], subject_direct=True, evidence="-e2").run(docs), "id") == ["1"]
    assert ids(q(subjects=["g:1"], subject_direct=True, invert=True).run(docs), "subject") == ["g:1"]
    assert ids(q(evidence="e1", names={"evidence": None}).run(docs), "id") == ["1", "2", "3"]
    assert [tuple(r) for r in search.facets(docs, ["evidence"], limit=1).collect()] == [("evidence", "e1", 2)]
    assert search.page(docs, ["id"], 1, -1).count() == 2 and ids(search.either_side(docs, ["g:1"]), "other") == ["p:1", "p:1", "p:2"]
    named = docs.withColumn("label", F.concat(F.lit("gene "), "id"))
    assert [r.id for r in search.text_search(named, "gene 2", {"label": 2.0}).collect()][0] == "2" and [r.id for r in search.autocomplete(named, "gene 3").collect()] == ["3"]


def test_simple_paths_of_any_length(spark):
    edges = spark.createDataFrame([(f"n{i}", "p", f"n{i + 1}") for i in range(52)] + [("n50", "p", "n0"), ("n51", "p", "x")], "sub string, pred string, obj string")
    start = spark.createDataFrame([("n0",)], "id string")
    chain = [f"n{i}" for i in range(53)]
    assert sorted(r.path for r in closure.simple_paths(edges, start).collect()) == sorted([chain, [*chain[:52], "x"]])
    assert closure.simple_paths(edges, start, most=3).count() == 0


def test_text_annotation(spark):
    docs = spark.createDataFrame([("d", "A Big cat, and the big  CAT sat.")], "id string, text string")
    names = spark.createDataFrame([("X:1", "big cat"), ("X:2", "sat"), ("X:3", "at")], "term string, val string")
    got = sorted((r.start, r.end, r.text, r.term) for r in search.annotate_text(docs, names).collect())
    assert got == [(2, 9, "Big cat", "X:1"), (28, 31, "sat", "X:2")]
    long = "positive regulation of transcription by RNA polymerase II"
    docs = spark.createDataFrame([("d", f"The {long}, and binding."), ("e", "of RNA"), ("f", None)], "id string, text string")
    names = spark.createDataFrame([("G:1", long), ("G:2", "RNA polymerase II"), ("G:3", "binding"), ("G:4", None)], "term string, val string")
    got = sorted((r.id, r.start, r.end, r.text, r.term) for r in search.annotate_text(docs, names).collect())
    assert got == [("d", 4, 61, long, "G:1"), ("d", 44, 61, "RNA polymerase II", "G:2"), ("d", 67, 74, "binding", "G:3")]
    assert {r.term for r in search.annotate_text(docs, names, longest=3).collect()} == {"G:2", "G:3"}


def test_triples(spark):
    rows = spark.createDataFrame([("S", "r", "O", "ECO:1", ["PMID:1"], ["W:1"])], "subject string, relation string, object string, evidence string, references array<string>, with_from array<string>")
    made = triples.with_evidence(rows)
    assert made.count() == made.distinct().count() == 9
    again = triples.match(made, [("?a", "owl:annotatedTarget", "O"), ("?a", "RO:0002612", "?e"), ("?e", "dc:source", "?ref")])
    assert [r.ref for r in again.collect()] == ["PMID:1"]
    lines = spark.createDataFrame([("S", "O", False, ["b", "a"], [], ["P:1", "Q:1"], "IPI", "R:1", "1"), ("S", "O", False, ["a", "b"], [], ["P:1"], "IPI", "R:2", "2")], "subject string, object string, negated boolean, qualifiers array<string>, extensions array<string>, with_from array<string>, evidence string, reference string, date string")
    binding, taxa = spark.createDataFrame([("O",)], "term string"), spark.createDataFrame([("S", "t"), ("P:1", "t"), ("Q:1", "u")], "id string, taxon string")
    got = triples.collapsed(lines, binding, taxa).collect()
    assert len(got) == 1 and got[0].header == ["P:1"] and got[0].n == 2 and [x.with_from for x in got[0].lines] == [["Q:1"], []]


def test_differences(spark):
    one, two = (spark.createDataFrame(x, "subject string, evidence string") for x in ([("a", "e"), ("b", None)], [("a", "e"), ("c", "e"), ("b", None)]))
    assert differ.missing(one, two, ["subject", "evidence"]).count() == 0 and ids(differ.missing(two, one, ["subject", "evidence"]), "subject") == ["c"]
    assert [tuple(r) for r in differ.group_changes(one, two, ["subject"]).collect()] == [("c", 0, 1)]
    assert "Only in the second: 1" in differ.report(one, two, ["subject"])


def test_clusters(spark):
    d = spark.createDataFrame([("a", "b", 0.1), ("a", "c", 0.9), ("b", "c", 0.8)], "a string, b string, d double")
    got = [tuple(r) for r in assoc.linkage(d).orderBy("step").collect()]
    assert got[0][:4] == (0, "a", "b", pytest.approx(0.1)) and got[1][3] == pytest.approx(0.9)


def test_axiom_weights_of_a_hub(spark):
    """Votes meet by keys: all pairs that share an end would be 3.6 billion here."""
    from threading import Timer

    n = 60_000
    ids_of = lambda c: F.concat(F.lit("A:"), c.cast("string"))
    mapping = spark.range(n).select(ids_of(F.col("id")).alias("a"), F.lit("B:0").alias("b"), F.lit("A").alias("oa"), F.lit("B").alias("ob"))
    closed = spark.range(n).select(ids_of(F.col("id")).alias("term"), ids_of(F.col("id") + 1).alias("anc"))
    stop = Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = {r.a: r.pr for r in lexmap.axiom_weights(mapping, closed).filter("a in ('A:0', 'A:1', 'A:59999')").collect()}
    finally:
        stop.cancel()
    assert got["A:0"][0] > got["A:1"][0] > got["A:59999"][0] and got["A:59999"][1] > got["A:1"][1] > got["A:0"][1]
