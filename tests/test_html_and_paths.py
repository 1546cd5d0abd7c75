"""HTML text against an independent parser, one path form, batching and doc-maps with equal names."""

import html
import json
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators import ingest as I
from papyra.operators import search as S
from papyra.plans.ordinal import global_ordinal
from papyra.sinks import writers as W
from papyra.sources import readers as SR
from papyra.streaming import ingest_stream as ST


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        self.out.append("\n")

    def handle_comment(self, data):
        self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def _parsed(page):
    p = _Text()
    p.feed(page)
    p.close()
    return "\n".join(x.strip() for x in "".join(p.out).splitlines() if x.strip())


PAGES = ["<p title='a>b'>caf&eacute; &mdash; x</p>", '<a href="x>y" title=\'"\'>link</a> &lt;b&gt; tail', "<p>1 < 2 and 3 > 2</p>",
         "<br/>a&nbsp;b<hr>c", "<script>if (a<b) '</p>'</script>seen", "<!-- <p>no</p> -->yes", "&amp;lt; once &amp;amp;",
         "a &notit; b &notin; c &hellip; d &fjlig; e", "&copy 2020 &copycat; AT&T &am &unknown; &", "<p>&#8211;&#x2014&#150; &#65</p>",
         "<div class=\"a\" id='b' data-x=\"<p>\">in</div>", "plain", "", "&zwj;&CounterClockwiseContourIntegral;"]


def test_html_text_equals_an_independent_parser(spark):
    got = [r[0] for r in spark.createDataFrame([(p,) for p in PAGES], "h string").select(T.html_to_text("h")).collect()]
    for page, text in zip(PAGES, got, strict=True):
        assert text == _parsed(page), page


def test_references_like_the_standard_library(spark):
    texts = ["&eacute;&eacute &Eacute;", "&ampamp; &lt&gt", "&notit;", "&#0;&#128;&#159;&#xD800;", "&#9999999; &#x1F600;", "&;&#;&x", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.decode_entities("t")).collect()]
    assert got[:3] == [html.unescape(t) for t in texts[:3]] and got[4:6] == [html.unescape(t) for t in texts[4:6]]
    assert got[3] == "�€Ÿ�" and got[6] is None


def test_one_path_form(spark, tmp_dir):
    import os
    os.makedirs(f"{tmp_dir}/d/sub")
    for name in ("a b.pdf", "l+1.pdf", "sub/deep.pdf"):
        open(f"{tmp_dir}/d/{name}", "w").write("x")
    for base in (f"{tmp_dir}/d", f"file://{tmp_dir}/d", f"file:{tmp_dir}/d/"):
        assert {r.file_name for r in SR.scan_files(spark, base).collect()} == {"a b.pdf", "l+1.pdf"}, base
    os.makedirs(f"{tmp_dir}/c")
    open(f"{tmp_dir}/c/l 1.csv", "w").write("h\n1\n2\n")
    open(f"{tmp_dir}/c/none.csv", "w").write("h\n")
    counts = {(r.path or "all").split("/")[-1]: r.rows for r in SR.csv_row_counts(spark, f"{tmp_dir}/c").collect()}
    assert counts == {"l 1.csv": 2, "none.csv": 0, "all": 2}
    results = spark.createDataFrame([(f"file://{tmp_dir}/d/a%20b.pdf",), (f"{tmp_dir}/d/l+1.pdf",), ("/gone.pdf",)], "file_path string")
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_dir}/d")
    assert S.existing_files_semi(results, listing).count() == 2


def test_every_row_has_one_place(spark):
    rows = [("a", 1), ("a", 2), (None, 3), ("b", 4), ("a", 5), (None, 6)]
    df = spark.createDataFrame(rows * 50, "file_name string, n int")
    got = global_ordinal(df, ["file_name"], num_partitions=4).collect()
    assert sorted(r.ordinal for r in got) == list(range(300))
    by = sorted(got, key=lambda r: r.ordinal)
    assert [r.file_name for r in by] == [None] * 100 + ["a"] * 150 + ["b"] * 50
    sizes = I.assign_batches(df, ["file_name"], 7).groupBy("batch_index").count().collect()
    assert sorted((r.batch_index, r["count"]) for r in sizes) == [(i, 7) for i in range(1, 43)] + [(43, 6)]


def test_docmap_with_equal_and_null_names(spark, tmp_dir):
    contact = ("array<string>", "struct<country: string, area: string, prefix: string, line: string>")
    schema = (f"file_name string, content string, is_resume boolean, contact_info struct<emails: {contact[0]}, phone_numbers: "
              f"array<{contact[1]}>, linkedin: {contact[0]}, github: {contact[0]}, urls: {contact[0]}>, created_time string, "
              "hash_id string, batch_index long")
    rows = [(n, t, True, None, None, "h", 1) for n, t in (("a", "one"), ("a", "two"), (None, "x"), ("b", "y"))]
    W.write_docmap(spark.createDataFrame(rows, schema), f"{tmp_dir}/m")
    raw = spark.read.text(f"{tmp_dir}/m").first()[0]
    assert {k: v["content"] for k, v in json.loads(raw).items()} == {"a": "two", "b": "y", "": "x"}
    assert SR.read_docmap(spark, f"{tmp_dir}/m").count() == 3


def test_summary_of_a_folder_run_counts_supported_files_only(spark):
    from papyra.plans import queries as Q
    sf = "/root/testdata/sf0.01"
    r = Q.q_run_summary(spark, sf).first()
    assert (r.total_files_processed, r.unprocessed_documents_count) == (800, 0)


def test_a_ledger_that_cannot_be_read_is_an_error(spark, tmp_dir):
    assert ST._known_hashes(spark, f"{tmp_dir}/none", 1).count() == 0
    with pytest.raises(Exception, match="nosuchfs"):
        ST._known_hashes(spark, "nosuchfs://x/ledger", 1)


def test_stream_dedup_goes_on_from_its_checkpoint(spark, tmp_dir):
    def put(part, texts):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(f"{tmp_dir}/in/{part}")

    def run():
        q = ST.stream_dedup(spark, f"{tmp_dir}/in/*", "text string", f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
        q.awaitTermination()
        return sorted(r.hash_id for r in spark.read.parquet(f"{tmp_dir}/out").collect())

    put(1, ["a", "b", "a"])
    assert len(run()) == 2
    put(2, ["b", "c"])
    got = run()
    assert got == sorted(r[0] for r in spark.createDataFrame([("a",), ("b",), ("c",)], "t string").select(F.md5("t")).collect())
