import pytest

from chunkloom.operators.catalog import filter_source
from chunkloom.operators.chunking import chunk_corpus
from chunkloom.sources import snapshot as sn

BASE = {"/d/a": "a. " * 800, "/d/b": "b", "/d/c": "c"}


def content(df):
    return sorted((r.id, r.text, r.content_hash) for r in df.collect())


def expected(docs, template=None):
    return content(chunk_corpus(docs, template, created_at="t"))


@pytest.fixture(scope="module")
def base(spark):
    return sn.build(spark.createDataFrame(list(BASE.items()), "path string, text string"), created_at="t")


def sources(df):
    return df.selectExpr("path AS source")


def test_add_update_delete(spark, base, corpus):
    assert content(base.read(spark)) == expected(corpus(BASE))
    two = sn.upsert(base, corpus({"/d/a": "short", "/d/n": "n"}), created_at="t")
    three = sn.delete(two, sources(corpus({"/d/c": ""})))
    assert content(three.read(spark)) == expected(corpus({"/d/a": "short", "/d/b": "b", "/d/n": "n"}))
    four = sn.upsert(three, corpus({"/d/c": "back"}), created_at="t")
    assert four.documents(spark).count() == 4
    again = sn.upsert(four, corpus({"/d/c": "back"}), created_at="t")
    assert content(again.read(spark)) == content(four.read(spark))


def test_earlier_snapshots_stay(spark, base, corpus):
    sn.delete(base, sources(corpus(BASE)))
    assert content(base.read(spark)) == expected(corpus(BASE))
    assert sn.open_snapshot(spark, base.path) == base


def test_an_empty_collection(spark, corpus):
    empty = sn.build(spark.createDataFrame([], "path string, text string"))
    assert empty.read(spark).count() == 0 and empty.documents(spark).count() == 0
    assert content(sn.sync(empty, corpus(BASE), created_at="t")[0].read(spark)) == expected(corpus(BASE))


def test_sync_equals_build_and_a_second_sync_changes_nothing(spark, base, corpus):
    now = corpus({"/d/a": "a. " * 700, "/d/b": "b", "/d/n": "n"})
    synced, plan = sn.sync(base, now, created_at="t")
    assert {r.source: r.action for r in plan.collect()} == {"/d/a": "update", "/d/b": "unchanged", "/d/c": "delete", "/d/n": "add"}
    again, plan = sn.sync(synced, now, created_at="t")
    assert {r.action for r in plan.collect()} == {"unchanged"}
    assert content(again.read(spark)) == content(synced.read(spark)) == expected(now)


def test_an_invalid_snapshot_is_an_error(spark, corpus):
    def uneven():
        return lambda texts: [[1.0] * (1 + (len(t) > 50)) for t in texts]

    with pytest.raises(Exception):
        sn.build(corpus(BASE), model=uneven, created_at="t")
    with pytest.raises(ValueError):
        sn.write_snapshot(sn.build(corpus(BASE)).read(spark).unionByName(sn.build(corpus(BASE)).read(spark)))


def test_another_template(spark, base, corpus):
    new, _ = sn.sync(base, corpus(BASE), "code", created_at="t")
    assert new.template == "code" and content(new.read(spark)) == expected(corpus(BASE), "code")
    with pytest.raises(ValueError):
        sn.upsert(base, corpus({"/d/n": "n"}), template="code")
    with pytest.raises(ValueError):
        sn.sync(base, corpus(BASE), "code", scope="docs")


def test_clean_orphans(spark, base, corpus):
    left = sn.clean_orphans(base, corpus({"/d/a": "", "/d/c": ""}))
    assert sorted(r.source for r in left.documents(spark).collect()) == ["/d/a", "/d/c"]


def test_custom_model_runs_in_batches(spark, base):
    def lengths():
        def encode(texts):
            assert len(texts) <= 50
            return [[float(len(t)), 1.0] for t in texts]
        return encode

    rows = sn.reembed(spark, base, model=lengths).read(spark).collect()
    assert rows and all(r.embedding == [float(len(r.text)), 1.0] for r in rows)


def test_checks(spark, base):
    good = base.read(spark)
    assert sn.snapshot_checks(good).first().valid
    assert sn.snapshot_checks(good.limit(0)).first().valid
    assert not sn.snapshot_checks(good.unionByName(good)).first().valid
    assert not sn.snapshot_checks(good.selectExpr("id", "IF(chunk_index = 0, NULL, embedding) AS embedding")).first().valid


def test_source_filter_reaches_the_scan(spark, base):
    plan = filter_source(base.read(spark).select("id", "source"), "/d/b")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,/d/b)" in plan and "embedding" not in plan and "text" not in plan.split("ReadSchema")[1]


def test_listed_files_without_text_keep_their_chunks(spark, base, corpus):
    left = {p: t for p, t in BASE.items() if p == "/d/a"}
    new, plan = sn.sync(base, corpus(left), created_at="t", paths=corpus({"/d/a": "", "/d/b": ""}).select("path"))
    actions = {r.source: r.action for r in plan.collect()}
    assert actions["/d/a"] == actions["/d/b"] == "unchanged" and actions["/d/c"] == "delete"
    assert sorted(r.source for r in new.documents(spark).collect()) == ["/d/a", "/d/b"]


def test_delete_scope(spark, corpus):
    both = sn.build(corpus({"/data/docs/a": "a", "/data/web/w": "w"}), created_at="t")
    left, totals = sn.delete_scope(spark, both, "web")
    assert totals.first().documents == 1
    assert [r.source for r in left.documents(spark).collect()] == ["/data/docs/a"]


def test_import_stores_what_it_reports(spark, base, corpus):
    files = corpus({"/d/b.txt": "new b", "/d/x.exe": "MZ", "/d/blank.md": " \n", "/d/b": "kept"})
    asked = spark.createDataFrame([(f,) for f in ("/d/b.txt", "/d/b.txt", "/d/x.exe", "/d/blank.md", "/d/none.txt", "/d/b")], "file string")
    new, report = sn.import_files(base, asked, files, created_at="t")
    rows = sorted((r.file, r.status, r.chunks) for r in report.collect())
    assert rows == [("/d/b", "error", None), ("/d/b.txt", "success", 1), ("/d/b.txt", "success", 1), ("/d/blank.md", "error", None),
                    ("/d/none.txt", "error", None), ("/d/x.exe", "error", None)]
    stored = {r.source: r.chunks for r in new.documents(spark).collect()}
    assert stored.keys() == {*BASE, "/d/b.txt"} and stored["/d/b.txt"] == 1


def test_a_page_that_was_stored_twice_is_one_document(spark, tmp_path):
    """Two pages of one url are one path: the collection is valid, and holds the path once."""
    from chunkloom.plans.queries import REGISTRY

    spark.createDataFrame([(1, "one text", "en", "s", 8), (2, "two", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    pages = [(1, "http://a/x", "<p>first</p>"), (2, "http://a/x", "<p>second</p>"), (3, "http://a/y", "<p>third</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = {r.scope: (r.documents, r.left_documents) for r in REGISTRY["delete_scope"](spark, str(tmp_path)).collect()}
    assert rows == {"docs": (2, 2), "web": (2, 2), "all": (4, 0)}


def test_an_import_cuts_its_files_once(spark, base, corpus, monkeypatch):
    calls = []
    monkeypatch.setattr(sn, "chunk_corpus", lambda docs, *a, **kw: calls.append(1) or chunk_corpus(docs, *a, **kw))
    monkeypatch.setattr("chunkloom.operators.imports.with_chunks", lambda *a, **kw: pytest.fail("cut again to be counted"))
    requests = spark.createDataFrame([("/d/n.txt",), ("/d/n.txt",), ("/d/x.exe",), ("/d/none.md",), ("/d/e.md",)], "file string")
    new, report = sn.import_files(base, requests, corpus({"/d/n.txt": "n. " * 900, "/d/x.exe": "x", "/d/e.md": " ", "/d/other.md": "o"}), created_at="t")
    got = sorted((r.file, r.status, r.chunks) for r in report.collect())
    assert [x[:2] for x in got] == [("/d/e.md", "error"), ("/d/n.txt", "success"), ("/d/n.txt", "success"), ("/d/none.md", "error"), ("/d/x.exe", "error")]
    stored = {r.source: r.chunks for r in new.documents(spark).collect()}
    assert set(stored) == {*BASE, "/d/n.txt"} and got[1][2] == stored["/d/n.txt"] > 1 and len(calls) == 1
