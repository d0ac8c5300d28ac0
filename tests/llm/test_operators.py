"""Each operator against brute force, a round trip or SQL, and on awkward rows."""

import collections
import hashlib
import os
import random
import re
import time

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from chunkloom.llm import bpe, embedding_dedup, exact_dedup, html_main, language_id, minhash_dedup, packing, queries, substring_dedup, token_output, warc
from chunkloom.llm.suffix_sort import big_endian_words, sort_suffixes

TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, component_id long, block int, score double"
PASSAGE = "the quick brown fox jumps over the lazy dog and then some more words follow here "


def awkward_rows():
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(200_000))
    texts = [None, "", " \n", "...", "Hello World", "hello world", "HELLO WORLD", long, long, "é" * 60, PASSAGE + "one", PASSAGE + "two", "é" * 60 + "x"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", len(t or ""), "clash", 7, 7, 7.0) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, "hello world", "en", "s", 11, "clash", 7, 7, 7.0), (None, None, None, None, None, None, None, None, None), (4, "another text of the same id", "en", "s", 1, "", 1, 1, 1.0)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}


def components(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_sql_twins(spark, sf_dir, duck):
    for name, sql in queries.ORACLE_SQL.items():
        ours = queries.QUERIES[name](spark, sf_dir).collect()
        want = duck.execute(sql).fetchall()
        columns = [c[0] for c in duck.description]
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in ours))) == sorted(map(str, want)), name


# --- language ID


def test_language_accuracy(spark, sf_dir, documents):
    langs = {r.doc_id: r.lang for r in documents.collect()}
    rows = language_id.op1_language_id(spark, sf_dir).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and 0 < len(held) < len(rows)
    assert np.mean([langs[r.doc_id] == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_profiles_against_a_plain_bind_and_bundle(spark):
    """N-gram by n-gram, place by place."""
    d = language_id.DIMENSIONS
    letter = {c: [int(x) for x in language_id._letter_vector(ord(c))] for c in " abcdefghilmnorstuwy\u00e9"}

    def bundle(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower())
        padded = f" {' '.join(words.split())} "
        total = np.zeros(d, np.int64)
        for k in range(len(padded) - 2):
            bound = [1] * d
            for place, c in enumerate(padded[k : k + 3]):
                turn = 2 - place
                bound = [x * letter[c][(i - turn) % d] for i, x in enumerate(bound)]
            total += bound
        return total / np.linalg.norm(total)

    labelled = [("en", "the cat, the dog"), ("en", "and the hound"), ("fr", "l\u00e9 chat et le chien"), ("fr", "une table ronde")]
    plain = {x: sum(bundle(t) for y, t in labelled if y == x) for x in ("en", "fr")}
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(labelled)], "doc_id long, text string, lang string")
    prototypes = language_id.fit(docs)
    asked = ["the hat", "le chat", "a"]
    got = spark.createDataFrame([(t,) for t in asked], "text string").select("text", language_id.predict(F.col("text"), prototypes).alias("g")).collect()
    for r in got:
        cosine = {x: float(bundle(r.text) @ v / np.linalg.norm(v)) for x, v in plain.items()}
        best = max(cosine, key=cosine.get)
        assert r.g.lang == best and r.g.score == pytest.approx(max(cosine[best], 0), abs=1e-4)


def test_language_of_awkward_rows(awkward, nothing, documents):
    prototypes = language_id.fit(documents)
    got = awkward.select("doc_id", "text", language_id.predict(awkward["text"], prototypes).alias("g")).collect()
    for r in got:
        assert (r.g.lang == "und" and r.g.score == 0) == (not any(c.isalpha() for c in r.text or ""))
    kept = language_id.keep_identified(awkward, prototypes)
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert kept.columns == awkward.columns and kept.where("lang is null").count() == 0 < awkward.where("lang is null").count()
    assert language_id.fit(nothing) == {}
    assert language_id.keep_identified(awkward, {}).count() == 0
    assert language_id.keep_identified(nothing, prototypes).count() == 0


def test_texts_with_a_letter_are_kept(spark, documents, texts):
    rng = random.Random(12)
    other = ["".join(rng.choice("αβγδεζηθικλμνξοπρστυφχψω ") for _ in range(30)) + "α" for _ in range(100)]
    short = sorted({w for t in texts.values() for w in t.split() if any(c.isalpha() for c in w)})[:2000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*other, *short, "...", "123", "", None])], "doc_id long, text string")
    kept = language_id.keep_identified(rows, language_id.fit(documents)).collect()
    assert sorted(r.doc_id for r in kept) == list(range(len(other) + len(short)))


def test_prototypes_do_not_depend_on_partitions(documents):
    a, b = language_id.fit(documents), language_id.fit(documents.repartition(7))
    assert all(np.array_equal(a[k], b[k]) for k in a)


# --- exact de-duplication


def test_exact_dedup_of_awkward_rows(awkward, nothing):
    kept = exact_dedup.exact_dedup(awkward)
    assert kept.columns == awkward.columns
    got = [(r.doc_id, (r.text or "").lower()) for r in kept.collect()]
    want = {}
    for r in awkward_rows():
        want[(r[1] or "").lower()] = max(want.get((r[1] or "").lower(), -1), -1 if r[0] is None else r[0])
    assert sorted(got) == sorted((v, k) for k, v in want.items())
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_index_keeps_what_it_has(spark, awkward):
    index = exact_dedup.new_index(spark)
    first = exact_dedup.exact_dedup(awkward.where("doc_id < 6"), index=index).count()
    assert exact_dedup.exact_dedup(awkward.where("doc_id < 6"), index=index).count() == first
    assert exact_dedup.exact_dedup(awkward.where("doc_id = 6"), index=index).count() == 0
    assert index.read().count() == first
    assert exact_dedup.exact_dedup(awkward.where("doc_id = 7"), index=index).count() == 1


def test_index_counts_over_batches(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_ROWS", 3)
    rows = [(i, f"text {i % 4}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = exact_dedup.new_index(spark)
    assert index.read().count() == 0
    size, keep = collections.Counter(), {}
    for part in ("doc_id < 18", "doc_id >= 18 and doc_id < 30", "doc_id >= 30", "doc_id < 0"):
        batch = docs.where(part)
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(batch, index=index).collect()}
        of = {r.doc_id: r.text for r in batch.collect()}
        size.update(of.values())
        keep = {**{t: max(i for i, x in of.items() if x == t) for t in of.values()}, **keep}
        assert got == {i: (keep[t], size[t]) for i, t in of.items()}
    again = exact_dedup.DigestIndex(spark, index.path)
    again.add(docs.where("doc_id = 39").select("doc_id", exact_dedup.text_digest("text").alias("digest")))
    assert again.buckets == index.buckets == 6
    assert {r.keep_id: r.group_size for r in again.read().collect()} == {keep[t]: n + (t == "text 3") for t, n in size.items()}


# --- MinHash


def word_sets(texts):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t))
        out[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    return out


def near(sets, similarity=85):
    ids = sorted(i for i in sets if sets[i])
    return [(a, b) for k, a in enumerate(ids) for b in ids[:k] if 100 * (n := len(sets[a] & sets[b])) >= similarity * (len(sets[a]) + len(sets[b]) - n)]


@pytest.mark.parametrize("similarity", [85, 80])
def test_near_groups_against_brute_force(spark, texts, similarity):
    rng = random.Random(3)
    texts = dict(texts)
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randrange(50)) for _ in range(150)).split()
    for k in range(120):  # a group of near copies, some of which link with each other and some don't
        own = list(base)
        for _ in range(rng.randrange(0, 7)):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
        texts[10_000 + k] = " ".join(own)
    sets = word_sets(texts)
    want = components(near(sets, similarity), sets)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in minhash_dedup.near_groups(docs, similarity=similarity).collect()}
    assert {i: len(s) for i, s in sets.items()} == {i: r.n_shingles for i, r in got.items()}
    assert want == {i: r.component_id for i, r in got.items()}


def test_near_groups_in_small_blocks(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    texts = {}
    for k in range(60):
        own = list(base)
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        texts[k] = " ".join(own)
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", 7)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == components(near(word_sets(texts), minhash_dedup.SIMILARITY), texts)


def test_texts_that_share_an_id(spark):
    """Ids on several rows, with equal and with unlike texts: links through any of them, in both rounds."""
    rng = random.Random(12)
    bases = [[f"w{b}x{rng.randrange(60)}" for _ in range(120)] for b in range(5)]
    rows = []
    for k in range(150):
        own = list(bases[k % 5])
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
        rows.append((rng.randrange(40) if k % 3 == 0 else 100 + k, " ".join(own)))
    rows += rows[:20] + [(7, None), (500, "alone on two rows"), (500, "and with another text")]
    sets = word_sets({n: t or "" for n, (_, t) in enumerate(rows)})
    links = [(rows[a][0], rows[b][0]) for a, b in near(sets, 85)]
    got = minhash_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), similarity=85).collect()
    assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == collections.Counter((rows[n][0], len(x)) for n, x in sets.items())
    want = components(links, {i for i, _ in rows})
    assert {(r.doc_id, r.component_id) for r in got} == set(want.items())


def test_least_matches():
    assert [minhash_dedup.least_matches(x) for x in (100, 85, 80)] == [64, 42, 37]


def test_near_dedup_of_awkward_rows(awkward, nothing):
    kept = minhash_dedup.near_dedup(awkward)
    assert kept.columns == awkward.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids[None] == 2 and 5 not in ids and 6 not in ids and 8 not in ids and {0, 1, 2, 3, 7} <= ids.keys()
    assert minhash_dedup.near_dedup(nothing).count() == 0


def test_near_dedup_leaves_no_large_scratch(spark, documents):
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    assert minhash_dedup.near_dedup(documents).count() > 0
    left = {x.rpartition("-")[0] for x in set(os.listdir(folder)) - before}
    assert "kept" in left and not left & {"sketches", "classes", "sets", "postings", "placed", "hubs"}


# --- suffix sorting


def test_suffix_sort():
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(97, 99, 2000), np.full(300, 97), np.tile([97, 98], 200), rng.integers(97, 99, 60)]).astype(np.uint8)
    data = np.concatenate([data, data[:400]])
    starts = rng.permutation(len(data) - 60)
    order, fresh = sort_suffixes(big_endian_words(data), starts, 50)
    strings = [data.tobytes()[p : p + 50] for p in starts[order]]
    assert strings == sorted(strings)
    assert fresh.tolist() == [k == 0 or s != strings[k - 1] for k, s in enumerate(strings)]


def cut(texts):
    """By brute force: id -> (bytes, removed, spans, what is left)."""
    low, out = {}, {}
    for i in sorted(texts):
        t = texts[i].encode()
        for k in range(len(t) - 49):
            low.setdefault(t[k : k + 50], i)
    for i in texts:
        t = texts[i].encode()
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if low[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("block", "hot"), [(1 << 22, 512), (20_000, 512), (20_000, 0), (20_000, 3)])
def test_substrings_against_brute_force(spark, texts, monkeypatch, block, hot):
    monkeypatch.setattr(substring_dedup, "HOT_BLOCKS", hot)
    texts = {i: t[:4000] for i, t in texts.items()} | {5001: "ab" * 300, 5002: "x" + "ab" * 200, 5003: "a" * 500, 5004: "a" * 49, 5005: "é" * 100, 5006: "q" + "é" * 90, 5007: "a" * 50}
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(substring_dedup, "SORT_ROWS", block // 4)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup._deduplicated(docs, "doc_id", "text", False).collect()}
    assert got == cut(texts)


@pytest.mark.parametrize("hot", [512, 4])
def test_one_line_in_all_documents(spark, monkeypatch, hot):
    """5,000 otherwise unlike documents share a line. With its key taken as hot, no task gets much more of it than the others."""
    rng = random.Random(6)
    line = "this line of some sixty bytes stands in each of the documents"
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9)))
    texts = {i: " ".join(word() for _ in range(9)) + line + " ".join(word() for _ in range(9)) for i in range(5000)}
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(substring_dedup, "HOT_BLOCKS", hot)
    plain, folder = substring_dedup._sorted_spans, spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    mark = f"{folder}/parts-{hot}"
    os.makedirs(mark)

    def noted(group):
        sizes = [len(x) for x, done in zip(group["data"].to_pylist(), group["done"].to_pylist(), strict=True) if not done]
        with open(f"{mark}/{group['part'][0].as_py()}", "w") as f:
            f.write(str(sum(sizes)))
        return plain(group)

    monkeypatch.setattr(substring_dedup, "_sorted_spans", noted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup._deduplicated(docs, "doc_id", "text", False).collect()}
    assert got == cut(texts)
    largest = sorted(int(open(f"{mark}/{x}").read()) for x in os.listdir(mark))
    if hot == 4:
        assert largest[-1] < 3 * sum(largest) / len(largest)


def test_a_passage_in_all_blocks_is_sent_once(spark, tmp_path, monkeypatch):
    """200 documents in more than 100 blocks share a passage: its stretches are sent once, not once for each block, and to fewer receivers than blocks."""
    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(n))
    passage = words(400)
    texts = {i: words(4) + passage + words(4) for i in range(200)}
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 5_000)
    plain = substring_dedup._sorted_spans

    def noted(group):
        (tmp_path / str(group["part"][0].as_py())).write_text(str(sum(map(len, group["data"].to_pylist()))))
        return plain(group)

    monkeypatch.setattr(substring_dedup, "_sorted_spans", noted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup._deduplicated(docs, "doc_id", "text", False).collect()}
    assert got == cut(texts)
    received = [int(x.read_text()) for x in tmp_path.iterdir()]
    assert len(received) < 200 and sum(received) < 0.5 * sum(map(len, texts.values()))


def test_substrings_of_awkward_rows(awkward, nothing):
    got = substring_dedup.without_repeats(awkward)
    assert got.schema == awkward.schema and got.count() == awkward.count()
    by_id = {r.doc_id: r.text for r in got.collect()}
    assert by_id[0] is None and by_id[7] == awkward_rows()[7][1] and by_id[8] == "" and by_id[10] == PASSAGE + "one" and by_id[11] == "two"
    assert by_id[12] == "x"
    assert substring_dedup.without_repeats(nothing).count() == 0


# --- packing


def test_packing_keeps_all_and_has_no_conflicts(spark, awkward, nothing):
    rng = random.Random(5)
    rows = [(i, "x" * rng.choice([0, 1, 50, 200, 500, 900]), f"s{0 if rng.random() < 0.4 else rng.randrange(9)}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(docs, packing.F.octet_length("text"), packing.text_digest("text"), packing.F.col("source"), capacity=400, shard_rows=150).collect()
    size = collections.Counter()
    bins = collections.defaultdict(list)
    for r in got:
        size[r.doc_id] += r.n_tokens
        bins[r.bin_id].append(r)
    by_id = {i: (t, s) for i, t, s in rows}
    assert all(size[i] == len(t) for i, t, _ in rows) and {r.doc_id for r in got} == set(by_id)
    for own in bins.values():
        assert len({by_id[r.doc_id][1] for r in own}) == len(own)
        at = 0
        for r in sorted(own, key=lambda r: (r.start, r.n_tokens)):
            assert r.start == at
            at += r.n_tokens
        assert at <= 400
    assert packing.pack_documents(awkward).where("piece = 0").count() == awkward.count()
    assert packing.pack_documents(nothing).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(6)
    for _ in range(40):
        bins, plain = packing._Bins(20, 3, 3), []
        for _ in range(60):
            size, source, cluster = rng.randrange(0, 21), rng.randrange(-1, 4), rng.randrange(-1, 4)
            fits = [b for b in plain if b[0] >= size and (source < 0 or source not in b[1]) and (cluster < 0 or cluster not in b[2])]
            number, start = bins.place(size, source, cluster)
            left = 20 - start
            assert left == (min(b[0] for b in fits) if fits else 20)
            if number == len(plain):
                plain.append([20, set(), set()])
            b = plain[number]
            assert b in fits or not fits
            b[0] -= size
            b[1].add(source)
            b[2].add(cluster)


# --- BPE


def test_bpe_equals_the_library():
    rng = random.Random(7)
    alphabet = ["a", "b", "e", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "'s", "'LL", "1", "²", "Ⅷ", "é", "ß", "é", "中", "🙂", "!", "<|endoftext|>", "<|endof", "_", "\0", "ª", "न", "ि"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["", "a" * 3000, "the" * 2000, " " * 2000, "!" * 1500]
    library, own = Tokenizer.from_file(TOKENIZER), bpe.Codec(TOKENIZER)
    library.no_truncation()
    library.no_padding()
    for text, ids, want in zip(texts, own.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert own.decode(ids).decode() == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_of_long_words():
    rng = random.Random(11)
    words = ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(n)) for n in (2, 3, 4, 5, 9, 17, 33, 20_000)] + ["ab" * 30_000, "🙂é" * 5_000]
    library, own = Tokenizer.from_file(TOKENIZER), bpe.Codec(TOKENIZER)
    library.no_truncation()
    for word in words:
        assert np.frombuffer(own.encode([word])[0], "<u4").tolist() == library.encode(word, add_special_tokens=False).ids, len(word)
    again = ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(300_000)) for _ in range(2)]
    start = time.perf_counter()
    own.encode(again)
    assert time.perf_counter() - start < 30
    forms = [w.encode() for w in words if len(w) < 100]
    assert own.encode_words(forms) == own.encode_words(forms * 20)[: len(forms)]


def test_kept_words_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_BYTES", 1_000)
    own, plain = bpe.Codec(TOKENIZER), bpe.Codec(TOKENIZER)
    texts = [f"some words and a long one {chr(97 + k) * 700}" for k in range(6)]
    assert [own.encode([t])[0] for t in texts] == plain.encode(texts)
    assert len(own.words) < 12


def test_bpe_of_awkward_rows(awkward, nothing):
    rows = bpe.digests(awkward, TOKENIZER).collect()
    want = sorted((str(r[0]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in awkward_rows())
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in rows) == want
    assert bpe.digests(nothing, TOKENIZER).count() == 0
    ids = awkward.select("text", bpe.encode_column(awkward["text"], TOKENIZER).alias("ids"))
    assert all(r.back == (r.text or "") for r in ids.select("text", bpe.decode_column(ids["ids"], TOKENIZER).alias("back")).collect())


# --- packed token ids


def test_segment_tree_finds_the_tightest_row():
    rng = random.Random(8)
    for _ in range(200):
        capacity = rng.choice([1, 5, 16, 33])
        sizes = np.array([rng.randint(1, capacity) for _ in range(rng.randint(0, 40))], int)
        rows, free = token_output.best_fit(sizes, capacity), []
        for i in np.argsort(-sizes, kind="stable"):
            fits = [f for f in free if f >= sizes[i]]
            if fits:
                free[free.index(min(fits))] -= sizes[i]
            else:
                free.append(capacity - sizes[i])
        assert sorted(free) == sorted(capacity - sizes[r].sum() for r in rows)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))


@pytest.mark.parametrize("end", [None, 50256])
def test_packed_rows_hold_every_text(awkward, nothing, end):
    codec, pieces = bpe.Codec(TOKENIZER), collections.defaultdict(list)
    for m in token_output.packed(awkward.where("doc_id is not null and doc_id <> 4"), TOKENIZER, row_tokens=256, end_id=end).collect():
        ids = np.frombuffer(m.ids, "<u2").reshape(m.n_rows, 256)
        for row, ends, resets, docs, first in zip(ids, m.cu_seqlens, m.position_resets, m.doc_ids, m.first_tokens, strict=True):
            assert ends[:-1] == resets and ends[0] == 0 and ends[-1] <= 256
            for k, doc in enumerate(docs):
                pieces[doc].append((first[k], row[ends[k] : ends[k + 1]]))
    for r in awkward_rows():
        if r[0] is not None and r[0] != 4:
            ids = np.concatenate([np.empty(0, "<u2"), *(p for _, p in sorted(pieces[r[0]], key=lambda p: p[0]))])
            if end is not None:
                assert ids[-1] == end
                ids = ids[:-1]
            assert codec.decode(ids.astype("<u4").tobytes()).decode() == (r[1] or "")
    assert token_output.packed(nothing, TOKENIZER).count() == 0


# --- embeddings


def test_vector_groups_against_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 16))
    rows = [(int(i), [float(x) for x in base[i % 40] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.3])], int(i % 3 == 0)) for i in range(400)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] * 16, 1), (1004, rows[0][1], None), (1005, [1.0] * 8, 1), (1006, [float("inf")] * 16, 1), (1007, [2 * x for x in rows[3][1]], rows[3][2])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    good = rows + [odd[7]]
    unit = np.array([r[1] for r in good])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    label = np.array([r[2] for r in good])
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    ids = [r[0] for r in good]
    want = components([(ids[a], ids[b]) for a, b in zip(*np.nonzero(link), strict=True)], ids)
    for shard_rows in (10_000, 50):
        got = {r.vec_id: r for r in embedding_dedup.vector_groups(frame, shard_rows=shard_rows).collect()}
        assert len(got) == 408
        assert [got[i].n_links for i in ids] == link.sum(axis=1).tolist()
        assert {i: got[i].component_id for i in ids} == want
        assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(1000, 1007))
    assert embedding_dedup.vector_groups(frame.where("false")).count() == 0


def test_the_graph_answers_where_no_vector_has_a_link(monkeypatch):
    """No block is compared with its whole shard, and planted probes are found."""
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(2000, 32))
    ids = np.arange(2000)
    table = pa.table({"key": ids * 0, "shard": pa.array(ids * 0, pa.int32()), "rep": ids, "n": ids * 0 + 1, "embedding": pa.array(vectors.tolist(), pa.list_(pa.float64()))})
    graph = embedding_dedup._build(table)
    unit = (vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.float32)
    layers = embedding_dedup.build_graph(unit, ids)
    probes = embedding_dedup.planted(unit, ids, 400)
    truth = probes @ unit.T >= 0.93
    assert truth.any(axis=1).all() and (probes * probes).sum(axis=1) == pytest.approx(1, abs=1e-5)
    found = embedding_dedup.search(unit, layers, probes, graph["width"][0].as_py())
    assert np.mean([truth[i][f].sum() / truth[i].sum() for i, f in enumerate(found)]) >= 0.985
    seen, plain = [], embedding_dedup._beam

    def watched(held, links, queries, entry, width):
        seen.append(len(queries))
        return plain(held, links, queries, entry, width)

    monkeypatch.setattr(embedding_dedup, "_beam", watched)
    assert embedding_dedup._query(table, graph).num_rows == 0
    assert sum(seen) >= 2000 and 2 * graph["width"][0].as_py() < 2000


def test_links_over_several_shards(spark):
    """One vector in a hundred has a copy; a third of the others is one group."""
    rng = np.random.default_rng(13)
    base = rng.normal(size=(1500, 24))
    base[1000:1015] = base[:15] + 0.05 * rng.normal(size=(15, 24))
    base[500:700] = base[500] + 0.05 * rng.normal(size=(200, 24))
    frame = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(base)], "vec_id long, embedding array<double>, label int")
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    link = unit @ unit.T >= 0.93
    np.fill_diagonal(link, False)
    got = {r.vec_id: r for r in embedding_dedup.vector_groups(frame, shard_rows=300).collect()}
    want = components([(int(a), int(b)) for a, b in zip(*np.nonzero(link), strict=True)], range(1500))
    assert {i: got[i].component_id for i in got} == want
    assert sum(got[i].n_links for i in got) >= 0.99 * link.sum()


def test_graph_recall():
    rng = np.random.default_rng(10)
    vectors = rng.normal(size=(3000, 32)).astype(np.float32)
    vectors[1000:1400] = vectors[0] + 0.1 * rng.normal(size=(400, 32))
    vectors[2000:2600] = np.repeat(vectors[100:400], 2, axis=0) + 0.03 * rng.normal(size=(600, 32))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    layers = embedding_dedup.build_graph(vectors, np.arange(3000))
    found = embedding_dedup.search(vectors, layers, vectors, embedding_dedup.BEAM)
    truth = vectors @ vectors.T >= 0.93
    hit = sum(truth[i][f].sum() for i, f in enumerate(found))
    assert len(layers) > 1 and hit >= 0.98 * truth.sum()


@pytest.mark.parametrize(("large", "pairs"), [(500, 500), (500, 20), (0, 1)])
def test_audit_sees_small_groups(monkeypatch, large, pairs):
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(1500, 32))
    vectors[:large] = vectors[0] + 0.05 * rng.normal(size=(large, 32))
    vectors[large : large + pairs] = vectors[1500 - pairs :] + 0.05 * rng.normal(size=(pairs, 32))
    ids = np.arange(1500)
    table = pa.table({"key": ids * 0, "shard": pa.array(ids * 0, pa.int32()), "rep": ids, "n": ids * 0 + 1, "embedding": pa.array(vectors.tolist(), pa.list_(pa.float64()))})
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    links = (unit @ unit.T >= 0.93).sum(axis=1) - 1

    def short(vectors, layers, queries, width):
        """A search that misses all groups of two with narrow beams."""
        near = [np.flatnonzero(row) for row in queries @ vectors.T >= 0.93]
        return [x if width > 64 or len(x) > 2 else x[(queries[i] @ vectors[x].T) > 0.99999] for i, x in enumerate(near)]

    monkeypatch.setattr(embedding_dedup, "search", short)
    got = {r["a"]: r["n"] for r in embedding_dedup._query(table, embedding_dedup._build(table)).to_pylist() if r["b"] is None}
    assert [got.get(i, 0) for i in range(1500)] == links.tolist()


# --- WARC


def test_warc_with_magic_in_payloads(spark, tmp_path, duck):
    record = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nx"
    rows = [(1, "u", record), (2, "a b\n", None), (3, None, ""), (4, "u", "é\r\n\r\nWARC/1.0\r\n"), (5, "u", "WARC/1.0\r\n" * 50), (6, "u", "é\r\n\r\nWARC/1.0\r\n"), (7, "u", "x" * 100_000), (None, "u", "x"), (8, "u", record)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(map(str, duck.execute(warc.OP5_SQL).fetchall()))
    for size in ("128m", "100"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            assert sorted(str(tuple(r)) for r in warc.op5_warc(spark, str(tmp_path)).collect()) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


# --- HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<p>", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<body><nav><a href=x>Menu</a></nav><article><h1>A  title</h1><p>One&nbsp;two,\n three<br>four<p>Five &lt;b&gt;</article><footer>&copy; me</footer>", "A title\nOne two, three four\nFive <b>"),
        ("<div class='sidebar'>Buy, buy, buy, now, and, here</div><div id=content><p>Text that counts, really.</p><div class=\"ad\">No</div><p>More</p></div><div id=comments><p>First, I think, that, this</p></div>", "Text that counts, really.\nMore"),
        ("<script>var a='</p><p>x, y, z'</script><style>p{}</style><!-- <p>no</p> --><p>Yes, text</p><form><p>Name, mail</p></form>", "Yes, text"),
        ("<article><p><b>Bold never closed<p>Next <a href='a>b'>link</a> here</p></article>", "Bold never closed\nNext link here"),
        ("<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div><p>The article, with words, and commas, goes on.</p></div>", "The article, with words, and commas, goes on."),
        ("<table><tr><td>cell, one<td>cell, two</table>", "cell, one\ncell, two"),
        ("<div class='main-nav'><p>Home, news, and more, of that</p></div><div class='page has-sidebar'><div class='post-header'><h1>Title</h1></div><p>Words, of the article.</p></div><div id=siteFooter><p>Imprint, terms, and so on, here</p></div>", "Title\nWords, of the article."),
    ],
)
def test_main_text(page, text):
    assert html_main.main_text(page) == text


@pytest.mark.parametrize("n", [3, 8, 30, 300])
@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("<article><h1>T</h1>Loose one<div class=lead>The lead</div><div class=body>", "</div><pre>x = 1</pre><section><h2>Last</h2><p>End, of it</p></section><ul><li>item</ul><blockquote>Quote</blockquote><table><tr><td>cell</table>Loose two</article>"),
        ("<main><h1>T</h1>Loose one<p>The lead</p><article><div><div>", "</div></div></article><pre>x = 1</pre><h2>Last</h2><p>End, of it</p><ul><li>item</ul><blockquote>Quote</blockquote><table><tr><td>cell</table>Loose two</main>"),
        ("<div id=a><h1>T</h1>Loose one<div class=lead>The lead</div><div class=body>", "</div><pre>x = 1</pre><section><h2>Last</h2><p>End, of it</p></section><ul><li>item</ul><blockquote>Quote</blockquote><table><tr><td>cell</table>Loose two</div>"),
        ("<div id=a><h1>T</h1>Loose one<div class=lead>The lead</div><div class=body><div><div>", "</div></div></div><pre>x = 1</pre><section><h2>Last</h2><p>End, of it</p></section><ul><li>item</ul><blockquote>Quote</blockquote><table><tr><td>cell</table>Loose two</div>"),
    ],
)
def test_whole_article(n, before, after):
    paragraphs = [f"Paragraph {i}, with words, and more, of {'some ' * 55}length." for i in range(n)]
    page = "<body><ul><li><a href=1>One</a><li><a href=2>Two</a></ul>" + before + "".join(f"<p>{p}</p>" for p in paragraphs) + after + "<div><a href=3>Three</a> <a href=4>Four</a></div><footer>me</footer>"
    assert html_main.main_text(page).split("\n") == ["T", "Loose one", "The lead", *paragraphs, "x = 1", "Last", "End, of it", "item", "Quote", "cell", "Loose two"]


@pytest.mark.parametrize(
    ("part", "text"),
    [
        ("<section id='side-effects'><h2 id='related-work'>Related</h2><p class='print'>Side effects</p></section>", "Related\nSide effects"),
        ("<section id=community><h2>Community</h2><p>Who, and how</p></section>", "Community\nWho, and how"),
        ("<div class='section level2' id=community><p>Who, and how</p></div>", "Who, and how"),
        ("<pre><code>x = 1 <span class='token comment'># one</span> + <span class=hljs-comment>(two)</span></code></pre>", "x = 1 # one + (two)"),
        ("<code><div class='line comment'># all of it</div></code>", "# all of it"),
        ("<p>A <span class=ad>word</span> <em id=reply>here</em></p>", "A word here"),
        ("<div aria-label=\"Hidden figures\"><p>Film</p></div><section title='a hidden gem'><p>Gem</p></section><div data-x='class=ad' title=\"x id='comments'\"><p>Shown</p></div>", "Film\nGem\nShown"),
        ("<div data-id=sidebar data-style='display:none'><p>Shown</p></div>", "Shown"),
        ("<div class=layout-no-sidebar><p>Wide</p></div>", "Wide"),
        ("<div class=ad-container><p>No</p></div><div class=comments-area><p>No</p></div><div class=share-buttons><p>No</p></div><div class=related-posts><p>No</p></div>", ""),
        ("<div class=comment-body><p>No</p></div><div class=sidebar-left><p>No</p></div><section id=comments><p>No</p></section><ul id='main-menu'><li>No</ul>", ""),
        ("<div\nCLASS = 'x ad'><p>No</p></div><div class=\"a\"id=\"sidebar\"><p>No</p></div><div hidden><p>No</p></div><div role=search><p>No</p></div><p style='display: none'>No</p>", ""),
    ],
)
def test_boilerplate_names(part, text):
    prose = "Words of the article, and more, of it. " * 5
    page = f"<article><p>{prose}</p>{part}<p>{prose}</p></article>"
    assert html_main.main_text(page).split("\n") == [prose.strip(), *text.split("\n")[: bool(text) * 9], prose.strip()]


@pytest.mark.parametrize(
    ("part", "text"),
    [
        ("<header><h1>T</h1>lead</header>", "T\nlead"),
        ("<header class=entry-header><h2>T</h2></header>", "T"),
        ("<p>Pick <label for=a>Name <b>of</b></label>one <button>Go</button>and go</p>", "Pick one and go"),
        ("<p>Open <label>never closed</p><p>Next</p>", "Open\nNext"),
        ("<p>A <select><option>x<option>y</select>b</p>", "A b"),
        ("<button><div>Go</div><p>there</p></button><p>Shown</p>", "Shown"),
        ("<label>No<p>Shown</p>", "Shown"),
        ("<article class=comment><p>No</p></article>", ""),
        ("<div class=comment-thread><p>No</p></div><div id=respond><p>No</p></div><div id=disqus_thread><p>No</p></div>", ""),
        ("<section id=comments-section><p>No</p></section><ins class=adsbygoogle><p>No</p></ins>", ""),
        ("<p>An <ins>inserted</ins> word</p>", "An inserted word"),
        ("<form><p>No</p><input name=a></form>", ""),
    ],
)
def test_parts_of_an_article(part, text):
    prose = "Words of the article, and more, of it. " * 5
    page = f"<header><h1>Site</h1></header><article><p>{prose}</p>{part}<p>{prose}</p></article>"
    assert html_main.main_text(page).split("\n") == [prose.strip(), *text.split("\n")[: bool(text) * 9], prose.strip()]


def test_form_around_the_page():
    prose = "Words of the article, and more, of it. " * 5
    page = f"<body><form id=aspnet><nav><a href=1>Menu</a></nav><div><h1>T</h1><p>{prose}</p><form><p>Mail, name</p></form></div></form></body>"
    assert html_main.main_text(page) == f"T\n{prose.strip()}"


@pytest.mark.parametrize(
    "page",
    ["<div>x, y" * 100_000, "<ul><li>x, y" * 50_000, "<div>" * 50_000 + "</nav>" * 50_000 + "<p>x, y", "<label>x<button>" * 50_000, "<div>" * 30_000 + "<li>x<td>y" * 30_000],
)
def test_deep_pages_take_linear_time(page):
    start = time.perf_counter()
    html_main.main_text(page)
    assert time.perf_counter() - start < 6


def test_points_are_as_told():
    """A page's points by the rule of the docstring, block by block."""
    page = "<body><div><section><p>One, two, three</p><p>Four <a href=x>five</a></p></section><blockquote>Six, seven</blockquote></div></body>"
    root = html_main.parse(page)
    scored = {e.tag: e for e in html_main._score(root)}
    one, four, six = 1 + 2 + 15 / 100, (1 + 9 / 100) * (1 - 4 / 9), 1 + 1 + 10 / 100
    assert scored["section"].points == pytest.approx(3 + one + four)
    assert scored["blockquote"].points == pytest.approx(2 + six)
    assert scored["div"].points == pytest.approx(2 + (one + four) / 2 + six / 2)
    assert scored["html"].points == pytest.approx((one + four) / 6 + six / 6)
    assert html_main._value(scored["section"]) == pytest.approx((3 + one + four) * (1 - 4 / 24))


def test_pages(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in html_main.op10_html(spark, sf_dir).collect():
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html_main.html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "<p>x" * 5000, "t")], "page_id long, html string, text string")
    rows = html_main.extract(odd).orderBy("page_id").collect()
    assert [r.main_text for r in rows][:2] == ["", ""] and {r.text for r in rows} == {"t"}
    assert html_main.extract(odd.where("false")).count() == 0


# --- pipeline


def test_pipeline(spark, sf_dir, documents):
    docs = documents
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != "packing":
            assert docs.columns == documents.columns
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
        counts.append(docs.select("doc_id").distinct().count())
    assert counts[0] >= counts[1] > counts[2] >= counts[3] == counts[4] == counts[5]


def test_pipeline_of_awkward_rows(spark, tmp_path, awkward, nothing):
    for name, docs in (("awkward", awkward), ("nothing", nothing)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert got.columns == ["doc_id", "piece", "n_tokens", "bin_id", "start"]
        assert (got.count() > 0) == (name == "awkward")
