"""Command line: python -m termweave.cli COMMAND ...; results go to standard output, or to a folder with --out."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import lexmap, parse, search
from .operators.assoc import AssociationSet, of_associations
from .operators.ontology import expand_labels
from .operators.validate import ParserConfig, validate
from .sources import readers, writers


def _show(df: DataFrame, args) -> None:
    if args.out:
        writers.save_table(df, args.out)
    else:
        for row in df.limit(args.limit).collect():
            print("\t".join("" if x is None else str(x) for x in row))


def _associations(spark: SparkSession, args) -> AssociationSet:
    rows = readers.associations(spark, args.file).filter("problem is null").withColumn("object", F.col("term"))
    return AssociationSet(of_associations(rows), readers.ontology(spark, args.ontology))


def ontology(spark: SparkSession, args) -> None:
    """Ancestors, descendants, search, tree or OBO of an ontology."""
    o = readers.ontology(spark, args.ontology)
    found = o.search(args.terms, partial=args.partial, synonyms=True).select("id").distinct() if args.terms else o.nodes.select("id")
    if args.to == "obo":
        _show(writers.obo(o.subontology(o.traverse(found)) if args.terms else o).select("value"), args)
    elif args.to == "tree":
        _show(writers.tree(o.subontology(o.traverse(found)) if args.terms else o).select("value"), args)
    elif args.to == "descendants":
        _show(o.descendants(found, args.relation or None), args)
    elif args.to == "ancestors":
        _show(o.ancestors(found, args.relation or None), args)
    else:
        _show(found.join(o.labels(), "id", "left"), args)


def assoc(spark: SparkSession, args) -> None:
    """Boolean query, enrichment or similarity over an association file."""
    s = _associations(spark, args)
    if args.what == "query":
        _show(s.query(args.terms, args.negated or ()), args)
    elif args.what == "enrichment":
        _show(s.enrichment(args.terms, threshold=args.threshold), args)
    else:
        _show(s.similar_subjects(args.terms or s.subjects), args)


def convert(spark: SparkSession, args) -> None:
    """An association file in another format (PRS-34)."""
    rows = readers.associations(spark, args.file).filter("problem is null")
    _show(writers.registry()[args.to](rows), args)


def check(spark: SparkSession, args) -> None:
    """Validates an association file; prints the report."""
    lines = spark.read.text(args.file).withColumn("row_id", F.monotonically_increasing_id())
    done = validate(lines, readers.ontology(spark, args.ontology), ParserConfig(kind=args.kind, rule_set="all", as_of=args.as_of))
    print(writers.report_markdown(done.messages, done.counters, args.file))


def mapping(spark: SparkSession, args) -> None:
    """Lexical mapping between the vocabularies of an ontology, or of several joined by +."""
    o = readers.ontology(spark, args.ontology)
    best = lexmap.reciprocal(lexmap.best_pairs(lexmap.pairs(lexmap.index(lexmap.terms_of(o)))))
    _show(lexmap.table(best, o.labels()), args)


def expand(spark: SparkSession, args) -> None:
    """A TSV file with a label column after each column of ids."""
    _show(expand_labels(readers.tab_separated(spark, args.file), args.columns, readers.ontology(spark, args.ontology).labels()), args)


def facets(spark: SparkSession, args) -> None:
    """Counts of the columns of a Parquet table of association documents, or a pivot of two (GLR-35, GLR-36)."""
    docs = spark.read.parquet(args.file)
    _show(search.pivot_facet(docs, *args.columns) if args.pivot else search.facets(docs, args.columns), args)


def skim(spark: SparkSession, args) -> None:
    """(subject, label, term) of a GAF file."""
    lines = spark.read.text(args.file)
    _show(parse.skim(parse.cells(lines, "gaf", parse.header_version(lines, "gaf")).filter("problem is null")), args)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="termweave", description=__doc__)
    top.add_argument("--out", help="a new folder for the result")
    top.add_argument("--limit", type=int, default=1_000, help="rows to print")
    sub = top.add_subparsers(dest="command", required=True)

    def add(f, *arguments):
        p = sub.add_parser(f.__name__, help=f.__doc__)
        for names, options in arguments:
            p.add_argument(*names, **options)
        p.set_defaults(run=f)

    onto, file, terms = (("-r", "--ontology"), {"required": True}), (("file",), {}), (("terms",), {"nargs": "*"})
    add(ontology, onto, terms, (("--to",), {"choices": ["labels", "ancestors", "descendants", "tree", "obo"], "default": "labels"}), (("-p", "--relation"), {"action": "append"}), (("--partial",), {"action": "store_true"}))
    add(assoc, onto, (("-f", "--file"), {"required": True}), (("what",), {"choices": ["query", "enrichment", "similarity"]}), terms, (("-n", "--negated"), {"action": "append"}), (("--threshold",), {"type": float, "default": 0.05}))
    add(convert, file, (("--to",), {"required": True, "choices": sorted(writers.registry())}))
    add(check, file, onto, (("--kind",), {"default": "gaf"}), (("--as-of",), {"default": "2024-01-01"}))
    add(mapping, onto)
    add(expand, file, onto, (("-c", "--columns"), {"nargs": "+", "required": True}))
    add(facets, file, (("-c", "--columns"), {"nargs": "+", "required": True}), (("--pivot",), {"action": "store_true"}))
    add(skim, file)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("termweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    args.run(spark, args)


if __name__ == "__main__":
    main()
