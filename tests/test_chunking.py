import pytest
from pyspark.sql import functions as F

from chunkloom.model import TEMPLATES, Template, get_template
from chunkloom.operators import chunking
from chunkloom.operators.chunking import chunk_corpus, with_chunks


def cut(spark, text, template):
    return with_chunks(spark.createDataFrame([(text,)], "text string"), template).first().chunks


def small(strategy, size=20, overlap=5, separators=("\n\n", "\n", ". ", "?", "!", ",", " ", ""), **kw):
    return Template("small", size, overlap, strategy, separators, **kw)


@pytest.mark.parametrize("text, want", [
    ("U.S.A. is 3.14 big! Yes.", ["U.S.A.is 3.14 big!Yes."]),
    ("你好。世界！再见？", ["你好。世界！再见？"]),
    ("a??b", ["a??b"]),
    (" \n　 ", []),
    ("　hi　", ["hi"]),
    ("😀 ok", ["😀 ok"]),
])
def test_sentence_texts(spark, text, want):
    assert cut(spark, text, "sentence") == want


def test_sentence_groups_repeat_the_last_sentences(spark):
    t = small("sentence", size=12, overlap=0, overlap_sentences=1)
    assert cut(spark, "Aaaa. Bbbb. Cccc. Dddd.", t) == ["Aaaa.Bbbb.", "Bbbb.Cccc.", "Cccc.Dddd."]


def test_a_sentence_above_the_size_stays_whole(spark):
    assert cut(spark, "x" * 50 + ". Ab.", small("sentence", overlap=0, overlap_sentences=0)) == ["x" * 50 + ".", "Ab."]


def test_flat_drops_separators_and_repeats_the_tail(spark):
    assert cut(spark, "aaaa. bbbb\ncccc dddd eeee", small("flat")) == ["aaaa bbbb cccc dddd", " dddd eeee".strip()]


def test_flat_cuts_a_giant_word(spark):
    assert cut(spark, "x" * 45, small("flat")) == ["x" * 20, "x" * 20, "x" * 5]


def test_recursive_packs_whole_paragraphs(spark):
    assert cut(spark, "one two\n\nthree\r\nfour", small("recursive")) == ["one two three\r\nfour"]


def test_recursive_keeps_marks_and_drops_commas(spark):
    got = cut(spark, "Is it ? Yes, it is. Really , yes! ok", small("recursive", size=14, overlap=0))
    assert got == ["Is it? Yes", "it is. Really", "yes! ok"]


def test_repeated_marks_leave_one(spark):
    assert cut(spark, "aaaaaaaa?? bbbbbbbb?! cccccccc", small("recursive", overlap=0)) == ["aaaaaaaa? bbbbbbbb?", "cccccccc"]


def test_text_before_an_overlong_sentence_is_kept(spark):
    got = cut(spark, "Ab. " + "w" * 45 + ". Cd", small("recursive", size=20, overlap=0))
    assert got == ["Ab.", "w" * 20, "w" * 20, "w" * 5 + ".", "Cd"]


def test_markdown_sections(spark):
    assert cut(spark, "# H1\n\n## H2\nbody", "markdown_header") == ["## H2\nbody"]
    assert cut(spark, "pre\n# H\n\nfoo\n\nbar", "markdown_header") == ["pre", "# H\nfoo\nbar"]
    assert cut(spark, "#nothing\n####### seven", "markdown_header") == ["#nothing\n####### seven"]


def test_markdown_cuts_long_sections_and_repeats_the_header(spark):
    t = Template("m", 10, 0, "markdown_header")
    assert cut(spark, "# H\naaaa\nbbbb\n" + "c" * 25, t) == [
        "# H\naaaa\nbbbb", "# H\n" + "c" * 10, "# H\n" + "c" * 10, "# H\n" + "c" * 5,
    ]
    # Line breaks do not count towards the size until a cut is due.
    assert cut(spark, "# H\naaaaa\nbbbbb", t) == ["# H\naaaaa\nbbbbb"]


def test_separator_that_overlaps_an_earlier_one_is_applied_in_order(spark):
    t = Template("o", 100, 0, "flat", (". ", "b."))
    assert cut(spark, "ab. c", t) == ["ab c"]
    assert cut(spark, "ab.c", t) == ["a c"]


def test_long_texts_are_cut_like_short_ones(spark, monkeypatch):
    text = " ".join(f"Wörd{i} 你好{i}." for i in range(3000))
    near = {n: cut(spark, text, n) for n in ("academic", "code", "sentence")}
    monkeypatch.setattr(chunking, "LONG_TEXT", 10)
    monkeypatch.setattr(chunking, "BLOCK", 64)
    for n, want in near.items():
        assert cut(spark, text, n) == want
        assert len(want) > 10


@pytest.mark.parametrize("name", ["academic", "chinese", "code", "custom"])
def test_length_bound_and_no_lost_words(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    t = TEMPLATES[name]
    c = with_chunks(docs, t)
    assert c.select(F.max(F.array_max(F.transform("chunks", F.length)))).first()[0] <= 1.5 * t.chunk_size
    words = lambda x: F.filter(F.split(x, r"[\s。.!！?？;；,，、]+"), lambda w: (w != "") & (F.length(w) < 100))
    lost = c.select(F.size(F.array_except(words("text"), words(F.array_join("chunks", " ")))).alias("n"))
    assert lost.filter("n > 0").count() == 0


def test_records(spark, corpus):
    docs = corpus({"/data/docs/a/x.txt": "Hi there.", "/data/docs/a/blank.txt": " "})
    r = chunk_corpus(docs, created_at="2026-01-01 00:00:00").collect()
    assert len(r) == 1
    assert r[0].source_name == "x.txt" and r[0].chunk_index == 0 and r[0].source_type == "local_file"
    assert r[0].id.endswith("-0") and len(r[0].id) == 14


def test_indexes_are_contiguous_and_ids_unique(spark, sf_dir):
    from chunkloom.plans import inputs

    c = inputs.chunks(spark, sf_dir)
    per = c.groupBy("source").agg(F.count("*").alias("n"), F.max("chunk_index").alias("m"), F.count_distinct("chunk_index").alias("d"))
    assert per.filter("n <> m + 1 or n <> d").count() == 0
    assert c.count() == c.select("id").distinct().count()


def test_templates():
    assert get_template("no such") is TEMPLATES["academic"]
    with pytest.raises(ValueError):
        Template("bad", 100, 60)


def test_chunking_needs_no_shuffle_and_reads_each_text_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("path"), "text")
    plan = chunk_corpus(docs, created_at="x")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1 and plan.count("FileScan") == 1


def test_all_templates_go_to_python_in_one_pass(spark, corpus):
    from chunkloom.model import TEMPLATES
    from chunkloom.operators.chunking import with_chunks, with_chunks_by

    df = corpus({"/a": "One. Two two; three!\n\n" * 300, "/b": "", "/c": "# h\nx " * 900})
    both = with_chunks_by(df, {f"c_{t}": t for t in TEMPLATES})
    assert both._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    for t in TEMPLATES:
        one = {r.path: r.chunks for r in with_chunks(df, t).collect()}
        assert {r.path: r[f"c_{t}"] for r in both.collect()} == one
