"""Pages that come one by one, and HTML blocks."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.plans.ingest import ingest
from folioscope.session import new_run_dir
from folioscope.sources.pages import html_blocks, html_bookmarks, html_layout
from folioscope.sources.tables import StoredTable
from folioscope.streaming import waiting

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGES = f"{schemas.PAGES}, page_count int"


def documents_of(pages):
    ids = pages.select("document_id").distinct()
    return ids.select("document_id", F.upper("document_id").alias("document_name"), F.concat("document_id", F.lit(".pdf")).alias("pdf_file"))


class Feed:
    """Files into a folder, one a batch, through the stream."""

    def __init__(self, spark):
        self.spark, self.folder, self.files = spark, new_run_dir(spark, "feed"), 0
        self.chunks = StoredTable(spark, f"{self.folder}/chunks", schemas.CHUNKS, "chunk_id")
        self.registry = StoredTable(spark, f"{self.folder}/registry", schemas.REGISTRY, "document_id")

    def give(self, *batches):
        for rows in batches:
            df = self.spark.createDataFrame(rows, PAGES)
            df.coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
            self.files += 1

    def run(self):
        stream = self.spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        waiting.start_page_ingest(
            stream, documents_of, self.chunks, self.registry, f"{self.folder}/progress", f"{self.folder}/waiting"
        ).awaitTermination()

    def stored(self):
        return sorted((r.document_id, r.text, r.page_start, r.page_end) for r in self.chunks.read().collect())

    def left(self):
        rows = waiting.waiting_pages(self.spark, f"{self.folder}/waiting", self.files - 1).collect()
        return sorted((r.document_id, r.page_number) for r in rows)


def at_once(spark, rows):
    pages = spark.createDataFrame([r[:3] for r in rows], schemas.PAGES)
    made = ingest(pages, documents_of(pages)).chunks
    return sorted((r.document_id, r.text, r.page_start, r.page_end) for r in made.collect())


def text(name, n):
    return f"{n}.1 Part {n} of {name}\n" + " ".join(f"{name}{n}word{k}" for k in range(40))


def test_documents_in_several_batches(spark):
    a = [("a", n, text("a", n), 3 if n == 3 else None) for n in (1, 2, 3)]
    b = [("b", n, text("b", n), 2) for n in (1, 2)]
    feed = Feed(spark)
    feed.give([a[2], b[0]], [a[0], ("c", 1, text("c", 1), None), (None, 1, "lost", 1), ("d", None, "lost", 1)])
    feed.run()
    assert feed.stored() == [] and feed.left() == [("a", 1), ("a", 3), ("b", 1), ("c", 1)]
    # a page again, with another text, before its document is whole
    feed.give([("a", 1, "another text", None), a[1]], [b[1]])
    feed.run()
    assert feed.stored() == at_once(spark, a + b) and feed.left() == [("c", 1)]
    # late pages of whole documents, one of them beyond its count
    feed.give([("a", 2, "late", 3), ("b", 9, "late", 9), ("c", 2, text("c", 2), 2)])
    feed.run()
    assert feed.left() == []
    assert feed.stored() == at_once(spark, a + b + [("c", n, text("c", n), 2) for n in (1, 2)])


def test_a_batch_cut_before_its_pages_wait(spark, monkeypatch):
    """The documents are stored, then the run is cut; the batch comes again."""
    a = [("a", n, text("a", n), 2) for n in (1, 2)]
    feed = Feed(spark)
    feed.give([a[0]], [a[1], ("b", 1, text("b", 1), 2)])
    real = waiting.delete_dir

    def cut(spark, path):
        if path.endswith("generation=-1"):
            raise RuntimeError("cut short")
        real(spark, path)

    monkeypatch.setattr(waiting, "delete_dir", cut)
    with pytest.raises(Exception, match="cut short"):
        feed.run()
    monkeypatch.setattr(waiting, "delete_dir", real)
    feed.run()
    assert feed.stored() == at_once(spark, a) and feed.left() == [("b", 1)]


# -- HTML ---------------------------------------------------------------------

HTML = [
    ("<h1>Title</h1><p>One<p>Two</p>", [("h1", False, "Title"), ("p", False, "One"), ("p", False, "Two")]),
    ("<div><p>open<h2>next</h2></div>after", [("p", False, "open"), ("h2", False, "next")]),
    ("<div><p>in a parent</div> not in it", [("p", False, "in a parent")]),
    ("<p>to the end", [("p", False, "to the end")]),
    ("<P CLASS='x'><B>Bold</B> and <i>more</i><br>line<br/>s</P>", [("p", True, "Bold and more line s")]),
    ("<script>var t='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes", [("p", False, "yes")]),
    ("<p>a &lt; b &amp;&amp; c &#233;&#xE9; &amp;lt; &unknown; &#55296; &#1114112;</p>",
     [("p", False, "a < b && c éé &lt; &unknown; &#55296; &#1114112;")]),
    ("<p>1 < 2 and 3<4 <b>x</b> <", [("p", False, "1 < 2 and 3<4 x <")]),
    ("<pre>not a paragraph</pre><param><path>", []),
    ("<h3></h3><p></p>", [("h3", False, ""), ("p", False, "")]),
    ("<ul><li><p>item<li>next</ul>", [("p", False, "item")]),
    ("plain", []), ("", []), (None, []),
]


def test_html_blocks(spark):
    df = spark.createDataFrame([(str(n), h) for n, (h, _) in enumerate(HTML)], "url string, html string")
    got = {}
    for r in html_blocks(df).orderBy("document_id", "block_no").collect():
        got.setdefault(int(r.document_id), []).append((r.tag, r.bold, r.text))
    for n, (_, blocks) in enumerate(HTML):
        assert got.get(n, []) == blocks, HTML[n][0]
    first = html_blocks(df.where("url = '0'"))
    assert [(r.level, r.title) for r in html_bookmarks(first).collect()] == [(1, "Title")]
    assert [r.spans[0].size for r in html_layout(first).orderBy("block_no").collect()] == [24.0, 10.0, 10.0]


def test_every_start_tag_gives_a_block(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    tags = pages.agg(F.sum(F.size(F.regexp_extract_all(bare, F.lit(r"(?i)<(?:h[1-6]|p)[\s>]"), 0)))).first()[0]
    assert html_blocks(pages).count() == tags > 2000
