from pyspark.sql import functions as F

from chunkloom.functions import text as tx
from chunkloom.operators.imports import import_status
from chunkloom.sources.files import charset_report, dedup_uploads, list_paths, read_corpus, read_files
from chunkloom.sources.pages import page_documents, page_text


def make(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("héllo\r\nworld", encoding="utf-8", newline="")
    (tmp_path / "sub" / "b.MD").write_bytes("你好".encode("gbk"))
    (tmp_path / "sub" / "c.log").write_bytes(b"\xff")
    (tmp_path / "blank.txt").write_text(" \n　")
    (tmp_path / "tool.exe").write_text("MZ")
    (tmp_path / "paper.pdf").write_bytes(b"%PDF")
    return f"file:{tmp_path}"


def test_listing(spark, tmp_path):
    root = make(tmp_path)
    paths = list_paths(spark, root, f"{root}/sub")
    assert sorted(r.path.rsplit("/", 1)[1] for r in paths.collect()) == ["a.txt", "b.MD", "blank.txt", "c.log", "paper.pdf"]
    assert "content" not in paths._jdf.queryExecution().executedPlan().toString()


def test_decoding(spark, tmp_path):
    files = read_files(spark, make(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.charset) for r in files.collect()}
    assert got["a.txt"] == ("héllo\nworld", "utf-8")
    assert got["b.MD"] == ("你好", "gbk")
    assert got["c.log"] == ("ÿ", "latin-1")
    report = {r.charset: r.files for r in charset_report(files).collect()}
    assert report == {"utf-8": 2, "gbk": 1, "latin-1": 1}


def test_corpus_has_names_and_no_blank_files(spark, tmp_path):
    root = make(tmp_path)
    texts = sorted(r.text for r in read_corpus(spark, root, f"{root}/sub").collect())
    assert texts == ["[文件名: a]\nhéllo\nworld", "[文件名: b]\n你好", "[文件名: c]\nÿ"]


def test_path_functions(spark):
    df = spark.createDataFrame([("/x/a.tar.GZ",), ("/x/.bashrc",), ("/x/n",), ("C:\\data\\web\\p.txt",)], "p string")
    got = df.select(tx.stem("p"), tx.extension("p"), tx.source_class("p")).collect()
    assert [tuple(r) for r in got] == [
        ("a.tar", "gz", "docs"), (".bashrc", "", "docs"), ("n", "", "docs"), ("C:\\data\\web\\p", "txt", "web"),
    ]


def test_import_status_order_of_checks(spark):
    files = spark.createDataFrame(
        [("/d/a.txt", "Some text."), ("/d/t.exe", "MZ"), ("/d/b.md", " ")], "path string, text string")
    asked = spark.createDataFrame([("/d/a.txt",), ("/d/t.exe",), ("/d/b.md",), ("/d/none.exe",)], "file string")
    got = {r.file: (r.status, r.chunks, r.message) for r in import_status(asked, files).collect()}
    assert got == {
        "/d/a.txt": ("success", 1, None),
        "/d/t.exe": ("error", None, "不支持的格式: .exe"),
        "/d/b.md": ("error", None, "文件内容为空"),
        "/d/none.exe": ("error", None, "文件不存在"),
    }


def test_page_text(spark):
    html = (
        '<html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head>'
        '<body><!-- x > y --><p title="a>b">One&nbsp;&lt;two&gt; &amp;lt; &#8364;</p>\n\n <p>three</body>'
    )
    pages = spark.createDataFrame([("http://x/1", html), ("http://x/2", "<p>no title"), ("http://x/3", "<p> &nbsp; </p>")],
                                  "url string, html string")
    got = {r.url: (r.title, r.text) for r in page_text(pages).collect()}
    assert got == {"http://x/1": ("A & B", "A & BOne <two> &lt; € three"), "http://x/2": ("http://x/2", "no title")}
    doc = page_documents(pages, "2026-01-01 00:00:00").filter(F.contains("text", F.lit("no title"))).first()
    assert doc.text == "[网页标题: http://x/2]\n[来源: http://x/2]\n[爬取时间: 2026-01-01 00:00:00]\n\nno title"


def test_dedup_uploads(spark):
    df = spark.createDataFrame([("a", 1, "p2"), ("a", 1, "p1"), ("a", 2, "p3")], "name string, size int, path string")
    assert sorted(tuple(r) for r in dedup_uploads(df).collect()) == [("a", 1, "p1"), ("a", 2, "p3")]


def test_word_count(spark):
    df = spark.createDataFrame([("a b　c\n",), (" ",), ("x",)], "t string")
    assert [r[0] for r in df.select(tx.word_count("t")).collect()] == [3, 0, 1]
