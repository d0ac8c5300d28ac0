from chunkloom.operators import catalog, sync
from chunkloom.operators.chunking import chunk_corpus


def state(docs):
    chunks = chunk_corpus(docs, created_at="t0")
    return chunks, catalog.list_documents(chunks)


def actions(plan):
    return {r.source.rsplit("/", 1)[1]: r.action for r in plan.collect()}


def test_all_actions_and_blank_files_keep_their_chunks(corpus):
    _, stored = state(corpus({"/d/same": "a", "/d/changed": "b", "/d/gone": "c", "/d/blanked": "d"}))
    now = corpus({"/d/same": "a", "/d/changed": "B", "/d/new": "e", "/d/blanked": " ", "/d/newblank": ""})
    assert actions(sync.plan_sync(sync.current_state(now), stored)) == {
        "same": "unchanged", "changed": "update", "gone": "delete", "new": "add", "blanked": "unchanged",
    }


def test_scope_limits_what_a_sync_deletes(corpus):
    _, stored = state(corpus({"/data/docs/a": "a", "/data/web/w": "w"}))
    now = sync.current_state(corpus({"/data/docs/b": "b"}))
    assert actions(sync.plan_sync(now, stored, "docs")) == {"a": "delete", "b": "add"}
    assert actions(sync.plan_sync(now, stored, "all")) == {"a": "delete", "b": "add", "w": "delete"}


def test_applying_a_plan_gives_the_chunks_of_the_new_corpus(corpus):
    chunks, stored = state(corpus({"/d/a": "a. " * 600, "/d/b": "b", "/d/c": "c"}))
    now = corpus({"/d/a": "a. " * 300, "/d/b": "b", "/d/n": "n"})
    plan = sync.plan_sync(sync.current_state(now), stored)
    result = sync.apply_sync(chunks, plan, now, created_at="t0")
    assert sorted(map(tuple, result.collect())) == sorted(map(tuple, chunk_corpus(now, created_at="t0").collect()))
    again = sync.plan_sync(sync.current_state(now), catalog.list_documents(result))
    assert set(actions(again).values()) == {"unchanged"}


def test_sync_stats(corpus):
    chunks, stored = state(corpus({"/d/a": "a", "/d/b": "b"}))
    now = corpus({"/d/a": "a", "/d/n": "n. " * 1000})
    plan = sync.plan_sync(sync.current_state(now), stored)
    added = sync.chunks_to_add(plan, now, created_at="t0")
    row = sync.sync_stats(plan, added).first()
    assert (row.added, row.updated, row.unchanged, row.deleted) == (1, 0, 1, 1)
    assert row.added_chunks == added.count() > 1


def test_upsert_is_idempotent(corpus):
    chunks, _ = state(corpus({"/d/a": "a", "/d/b": "b"}))
    docs = corpus({"/d/b": "new b", "/d/c": "c"})
    once = sync.upsert(chunks, docs, created_at="t0")
    twice = sync.upsert(once, docs, created_at="t0")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.count() == 3


def test_delete_lists_in_a_shuffle_join_too(spark, corpus):
    chunks, _ = state(corpus({f"/d/{i}": str(i) for i in range(9)}))
    gone = chunks.select("source").filter("source < '/d/5'")
    short = sync.delete_sources(chunks, gone)
    rows = sorted(map(tuple, short.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        long = sync.delete_sources(chunks, gone)
        assert rows == sorted(map(tuple, long.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert short.count() == 4


def test_union_of_corpora_keeps_the_first_of_a_path(corpus):
    from chunkloom.sources.tables import union_corpora

    one, two = corpus({"/d/a": "1", "/d/b": "1", "/d/c": "1"}), corpus({"/d/a": "2", "/d/b": "2", "/d/z": "2"})
    want = {"/d/a": "1", "/d/b": "1", "/d/c": "1", "/d/z": "2"}
    assert dict(map(tuple, union_corpora(one, two).collect())) == want


def test_delete_scope(corpus):
    chunks, _ = state(corpus({"/data/docs/a": "a", "/data/web/w": "w"}))
    assert [r.source for r in sync.delete_scope(chunks, "web").collect()] == ["/data/docs/a"]
    assert [r.source for r in sync.delete_scope(chunks, "docs").collect()] == ["/data/web/w"]
    assert sync.delete_scope(chunks, "all").count() == 0


def test_catalog_statuses_and_scope(corpus):
    _, stored = state(corpus({"/data/docs/a": "a", "/data/docs/o": "o", "/data/web/w": "w"}))
    local = corpus({"/data/docs/a": "a", "/data/docs/l": "l", "/data/web/w": "w"})
    got = {r.name: (r.status, r.source_type, r.chunks) for r in catalog.document_catalog(local, stored).collect()}
    assert got == {"a": ("imported", "local", 1), "o": ("orphan", "local", 1),
                   "l": ("local", "local", 0), "w": ("imported", "web", 1)}
    web = catalog.document_catalog(local, stored, "web").collect()
    assert [r.name for r in web] == ["w"]
    assert {r.name for r in catalog.document_catalog(local, stored, "docs").collect()} == {"a", "o", "l"}


def test_name_lookup_prefers_the_exact_name(spark, corpus):
    _, stored = state(corpus({"/d/a/Report.txt": "a", "/d/b/port.txt": "b", "/d/c/zz.txt": "c"}))
    assert catalog.find_by_name(stored, "port.txt").first().source == "/d/b/port.txt"
    assert catalog.find_by_name(stored, "REPORT").first().source == "/d/a/Report.txt"
    assert catalog.find_by_name(stored, "nothing").count() == 0
    names = spark.createDataFrame([("PORT",), ("z",), ("q",)], "name string")
    assert catalog.match_names(stored, names).count() == 3
