import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from termweave.llm import common, queries, warc

BIG = "<p>é</p>" * 40


def _pages(spark):
    rows = [(5, "http://a/5", BIG), (3, "http://b/3\r\nX: y", BIG), (9, None, BIG), (1, "http://a/1", "short"), (2, "http://a/2", "short"), (4, "u", None), (6, "u", ""), (None, "u", BIG), (None, "u", "z" * 200), (7, "u", "WARC/1.1\r\n\r\n" * 20), (3, "http://b/3", BIG), (8, "u", "y" * 300_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_round_trip_and_revisits(spark):
    pages, rows = _pages(spark)
    path = common.scratch_path(spark, "warc-test")
    warc.write(warc.with_revisits(pages.withColumn("warc_type", F.lit("clash"))), path, max_file_mb=0.001)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.record_id, []).append(r)
    assert [r.warc_type for r in by["<urn:page:3>"]] == ["response"] * 2
    assert all((r.warc_type, r.refers_to) == ("revisit", "<urn:page:3>") for k in ("<urn:page:5>", "<urn:page:9>") for r in by[k])
    assert sorted(r.warc_type for r in by[None]) == ["response", "revisit"]
    for i, _, html in rows:
        data = (html or "").encode()
        assert any(r.payload_digest == "sha256:" + hashlib.sha256(data).hexdigest() and r.payload_length == len(data) and (r.warc_type == "revisit" or bytes(r.payload) == data) for r in by[None if i is None else f"<urn:page:{i}>"])


def test_pushed_filters_skip_blocks(spark):
    pages, _ = _pages(spark)
    path = common.scratch_path(spark, "warc-test")
    warc.write(warc.with_revisits(pages), path)
    found = warc.read(spark, path)
    assert {r.record_id for r in found.filter("warc_type = 'revisit'").collect()} == {"<urn:page:5>", "<urn:page:9>", None}
    assert found.filter("warc_type = 'response' and target_uri like 'http://a%' and payload_length > 3").count() == 2
    assert found.filter("warc_type in ('revisit', 'x')").count() == 3 and found.filter("target_uri is null").count() == 1
    assert warc.read(spark, path, payload=False).filter("payload is not null").count() == 0
    reader = warc.WarcReader(path, True)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("warc_type",), "revisit"), GreaterThan(("payload_length",), 3)]))
    assert len(left) == 1 and reader.wanted({"warc-type": "revisit"}) and not reader.wanted({"warc-type": "response"})


def test_archives_are_plain_gzip(spark):
    from pyarrow import fs

    pages, _ = _pages(spark)
    path = common.scratch_path(spark, "warc-test")
    warc.write(warc.with_revisits(pages.coalesce(1)), path)
    system, root = fs.FileSystem.from_uri(path)
    files = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.path.endswith(".warc.gz")]
    text = b"".join(gzip.decompress(system.open_input_file(f).read()) for f in files)
    assert text.count(b"\r\nWARC-Type: ") == 12 and text.startswith(b"WARC/1.1\r\n")


#: As other tools write them: names in any case, no blank after a colon, a continued line, bare line feeds, a metadata block.
OTHERS = [
    b"WARC/1.0\r\nwarc-type:warcinfo\r\nWARC-Record-ID: <urn:uuid:0>\r\nContent-Type: application/warc-fields\r\nContent-Length: 13\r\n\r\nsoftware: x\r\n\r\n\r\n",
    b"WARC/1.0\r\nWARC-TYPE: response\r\nWARC-Record-ID:<urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\n  b\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: 38\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\r\n\r\nmore \r\n\r\n",
    b"WARC/1.0\nWARC-Type: metadata\nWARC-Record-ID: <urn:uuid:2>\nContent-Type: text/plain\nContent-Length: 9\n\na\r\n\r\nb: c\r\n\r\n",
    b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Refers-To: <urn:uuid:1>\r\nContent-Type: application/http\r\nContent-Length: 19\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\r\n\r\n",
]


@pytest.mark.parametrize("kind", ["plain", "members", "one member", "mixed"])
def test_archives_of_other_tools(spark, tmp_path, kind):
    parts = [gzip.compress(x) for x in OTHERS] if kind == "members" else [gzip.compress(b"".join(OTHERS))] if kind == "one member" else [warc.member(OTHERS[0]), *map(gzip.compress, OTHERS[1:])] if kind == "mixed" else OTHERS
    path = tmp_path / ("a.warc" if kind == "plain" else "a.warc.gz")
    path.write_bytes(b"".join(parts))
    (tmp_path / "notes.txt").write_text("no archive")
    for where in (tmp_path, path):
        got = {r.record_id[10:-1]: r for r in warc.read(spark, str(where)).collect()}
        assert [got[k].warc_type for k in "0123"] == ["warcinfo", "response", "metadata", "revisit"]
        assert [None if got[k].payload is None else bytes(got[k].payload) for k in "0123"] == [b"software: x\r\n", b"body\r\n\r\nmore ", b"a\r\n\r\nb: c", None]
        assert got["1"].target_uri == "http://a/ b" and got["3"].refers_to == "<urn:uuid:1>"
    found = warc.read(spark, str(path))
    assert [r.record_id for r in found.filter("warc_type = 'metadata'").collect()] == ["<urn:uuid:2>"]
    done = {r.record_id[10:-1]: r for r in warc.resolved(found).collect()}
    assert (done["3"].payload_length, done["3"].payload_digest) == (13, hashlib.sha256(b"body\r\n\r\nmore ").hexdigest())


def test_broken_archives_are_errors(tmp_path):
    from pyarrow import fs

    for data in (OTHERS[0] + OTHERS[1][:-20], OTHERS[0] + b"WARC/1.0\r\nA: b", gzip.compress(OTHERS[1])[:-30], b"nothing of the kind\r\n\r\n"):
        (tmp_path / "x.warc").write_bytes(data)
        with pytest.raises(ValueError), fs.LocalFileSystem().open_input_file(str(tmp_path / "x.warc")) as f:
            list(warc.records(f, lambda h: True))


def test_empty_archive(spark):
    pages, _ = _pages(spark)
    path = common.scratch_path(spark, "warc-test")
    warc.write(warc.with_revisits(pages.limit(0)), path)
    assert warc.read(spark, path).collect() == []


# --- pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _corpus(spark, tmp_path):
    good = [" ".join(f"w{(i * 31 + k * (k + i)) % 997}" for k in range(60)) for i in range(60)]
    bad = [" ".join(f"x{(i * 17 + k) % 97}%%%" for k in range(60)) for i in range(30)]
    rows = [(i, f"{t}\nshared line here", "en", f"s{i % 3}", len(t)) for i, t in enumerate(good)]
    rows += [(100 + i, t, "en", "s1", len(t)) for i, t in enumerate(bad)]
    rows += [(200, good[0] + "\nSHARED line here ", None, None, None), (201, None, None, None, None), (202, "", "en", "s0", 0), (None, "w1 w2 w3", "en", "s0", 8), (0, rows[0][1], "en", "s0", 5), (203, good[5] + " w1" * 30_000, "fr", "s2", 1)]
    spark.createDataFrame(rows, COLUMNS).withColumn("copies", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(30)] + [(201, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, good


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, good = _corpus(spark, tmp_path)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = common.staged(stage(spark, docs, str(tmp_path)), f"stage-{k}")
        kept[name] = docs.collect()
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == [*COLUMNS.replace(" long", "").replace(" string", "").split(", "), "copies"]
            assert {r.copies for r in kept[name]} == {"clash"}  # a further column goes along, whatever its name
    ids = lambda name: {r.doc_id for r in kept[name]}
    assert not ids("quality classifier") & set(range(100, 130)) and set(range(60)) <= ids("quality classifier")
    assert all("shared line" not in (r.text or "").lower() and r.n_chars == len(r.text) for r in kept["line dedup"])
    near = [r.doc_id for r in kept["SimHash near-dedup"]]
    assert 200 not in near and near.count(0) == 1 and set(range(60)) <= set(near)
    copies = [r.doc_id for r in kept["mixing sources"]]
    assert max(copies.count(i) for i in copies) <= 2
    assert len(kept["byte-level BPE"]) == len(copies)
    texts = {r.doc_id: r.text for r in kept["mixing sources"]}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids) for r in kept["byte-level BPE"])


def test_pipeline_on_an_empty_table(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_query_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
