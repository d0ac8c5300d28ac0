"""Corpus chunking: documents in, chunk records out, without a shuffle.

Every strategy works inside the row of its document. Splitting, trimming, cutting and
hashing are built-in expressions; the greedy packing of segment lengths is a small Arrow
function (``functions.packing``) that never sees the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.packing import char_packer, sentence_packer, topic_packer
from chunkloom.functions.text import (
    GAP, NO_GAP, WS_IN_LINE, any_of, content_hash, cut_every, md5_short, quote, source_name, strip,
)
from chunkloom.model import BREAK_PERCENT, CHUNK_COLUMNS, KEPT_MARKS, Template, get_template
from chunkloom.operators.embedding import HASH_DIM, hash_buckets
from chunkloom.session import bound_batches

PARAGRAPH_MARKS = ("\n\n", "\r\n\r\n", "\r\n")
WORD = r"[\p{L}\p{N}_]"

# A character offset is found by walking the string, so texts above this length are first
# cut to blocks and each span is taken from the few blocks it touches.
LONG_TEXT = 1 << 16
BLOCK = 1 << 12


def _pieces(x: Column, pattern: str) -> Column:
    """Split, trim, drop the empty pieces."""
    return F.filter(F.transform(F.split(x, pattern), strip), lambda s: s != "")


def _ordered_split(x: Column, marks: list[str]) -> Column:
    """Split by each mark in turn.

    One alternation gives the same pieces unless a mark can start inside an occurrence of
    an earlier-listed one; white space alone is no conflict, since pieces are trimmed.
    """
    def conflict(first: str, later: str) -> bool:
        tails = any(first.startswith(later[i:]) for i in range(1, len(later)))
        inside = first in later[1:]
        return (tails or inside) and not (first + later).isspace()

    if any(conflict(a, b) for i, a in enumerate(marks) for b in marks[i + 1:]):
        parts = F.array(x)
        for pattern in map(quote, marks):
            # Column functions are built at once, so the loop variable is safe in the lambda.
            parts = F.flatten(F.transform(parts, lambda p: F.split(p, pattern)))
        return F.filter(F.transform(parts, strip), lambda s: s != "")
    return _pieces(x, any_of(marks))


def _flat_segments(text: Column, t: Template) -> Column:
    marks = [s for s in t.separators if s]
    if not marks:
        return F.filter(F.array(strip(text)), lambda s: s != "")
    return _ordered_split(text, marks)


def _sentence_marks(t: Template) -> list[str]:
    skip = {*PARAGRAPH_MARKS, " ", ""}
    if "\n\n" in t.separators:
        skip.add("\n")
    return [s for s in t.separators if s not in skip]


def _recursive_segments(text: Column, t: Template) -> Column:
    """Paragraphs; those above the chunk size as sentences that keep their end mark."""
    para_marks = [s for s in PARAGRAPH_MARKS if s in t.separators] or ["\n\n"]
    paragraphs = _pieces(text, "|".join(para_marks))
    marks = _sentence_marks(t)
    if not marks:
        return paragraphs
    # A mark is kept when its first character is a kept one; the blanks before it go.
    kept = [m for m in marks if m[0] in KEPT_MARKS]
    whole = [m for m in kept if not m[1:].strip()]  # a trailing blank is trimmed later
    dropped = [m for m in marks if m not in kept]
    single = [m for m in whole if len(m) == 1]
    cuts = [f"(?<={quote(m)})" for m in whole if len(m) > 1]
    cuts += [f"(?<={quote(m[0])}){quote(m[1:])}" for m in kept if m not in whole]
    cuts += [f"(?<={any_of(single)})"] if single else []
    cuts += [any_of(dropped)] if dropped else []
    cut, at_kept = "|".join(cuts), any_of(kept)

    def sentences(p: Column) -> Column:
        tight = F.regexp_replace(p, f"{GAP}(?={at_kept})", "") if kept else p
        # A piece that is just a mark closes nothing.
        parts = F.filter(F.split(tight, cut), lambda s: ~F.ltrim(s).isin(*kept, ""))
        return F.filter(F.transform(parts, strip), lambda s: s != "")

    return F.flatten(
        F.transform(
            paragraphs,
            lambda p: F.when(F.length(p) <= t.chunk_size, F.array(p)).otherwise(sentences(p)),
        )
    )


def _sentences(text: Column) -> Column:
    """Sentences with their end mark; a dot between two word characters is none."""
    return _pieces(text, rf"(?<=[。！？；!?;\n])|(?<=\.)(?<!{WORD}\.)|(?<=\.)(?!{WORD})")


def _cut_spans(joined: Column, spans: Column) -> Column:
    """The texts of ``spans``; linear in the length of the text however long it is."""
    def near(p: Column) -> Column:
        return F.substring(joined, p["start"] + 1, p["len"])

    def far(blocks: Column) -> Column:
        def one(p: Column) -> Column:
            first = F.floor(p["start"] / BLOCK).cast("int")
            last = F.floor((p["start"] + p["len"] - 1) / BLOCK).cast("int")
            part = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
            return F.substring(part, p["start"] - first * BLOCK + 1, p["len"])

        return F.transform(spans, one)

    # The single-element transform names the block list once for all its spans.
    blocked = F.flatten(F.transform(F.array(cut_every(joined, BLOCK)), far))
    return F.when(F.length(joined) <= LONG_TEXT, F.transform(spans, near)).otherwise(blocked)


def _limit_length(chunks: Column, size: int) -> Column:
    """Trim; cut what is above one and a half sizes every ``size`` characters."""
    def one(c: Column) -> Column:
        return F.when(F.length(c) <= 1.5 * size, F.array(c)).otherwise(
            F.transform(cut_every(c, size), strip)
        )

    return F.filter(F.flatten(F.transform(F.transform(chunks, strip), one)), lambda c: c != "")


def _spans(t: Template, segments: str) -> Column:
    lens = F.transform(segments, lambda s: F.length(s))
    if t.strategy == "sentence":
        return sentence_packer(t.chunk_size, t.overlap_sentences)(lens)
    long_words = F.transform(
        F.filter(segments, lambda s: F.length(s) > t.chunk_size),
        lambda s: F.transform(F.split(s, " "), lambda w: F.length(w)),
    )
    if t.strategy != "recursive":
        long_words = F.array().cast("array<array<int>>")
    return char_packer(t.chunk_size, t.overlap)(lens, long_words)


def _packed(df: DataFrame, wanted: dict[str, tuple[Template, Column]]) -> DataFrame:
    """Add the chunks of each output column by its template and segments. All lists of lengths go to Python in one pass, so a task
    has one worker however many templates there are."""
    bound_batches(df.sparkSession)
    df = df.withColumns({f"_segments_{out}": segments for out, (_, segments) in wanted.items()})
    df = df.withColumns({f"_spans_{out}": _spans(t, f"_segments_{out}") for out, (t, _) in wanted.items()})
    joined = {f"_joined_{out}": F.array_join(f"_segments_{out}", "" if t.strategy == "sentence" else " ") for out, (t, _) in wanted.items()}
    df, cut = df.withColumns(joined), {}
    for out, (t, _) in wanted.items():
        chunks = _cut_spans(F.col(f"_joined_{out}"), F.col(f"_spans_{out}"))
        if t.strategy == "sentence":
            cut[out] = F.filter(F.transform(chunks, strip), lambda c: c != "")
        else:
            cut[out] = _limit_length(chunks, t.chunk_size)
    return df.withColumns(cut).drop(*[f"{c}_{out}" for out in wanted for c in ("_segments", "_spans", "_joined")])


def _topics(df: DataFrame, t: Template, sentences: Column, out: str) -> DataFrame:
    """Sentences with a space between them, cut where two neighbours share little of their words compared with the
    text's other neighbours, and before the chunk size is passed. Only lengths and word buckets go to the packer."""
    df = df.withColumn("_segments", sentences)
    lens = F.transform("_segments", lambda s: F.length(s))
    spans = topic_packer(t.chunk_size, HASH_DIM, BREAK_PERCENT)(lens, F.transform("_segments", lambda s: hash_buckets(s)))
    df = df.withColumn("_spans", spans)
    chunks = F.transform("_spans", lambda p: F.array_join(F.slice("_segments", p["start"] + 1, p["len"]), " "))
    return df.withColumn(out, _limit_length(chunks, t.chunk_size)).drop("_segments", "_spans")


def _header_chunks(text: Column, t: Template) -> Column:
    """Header sections; each chunk repeats the header of its section.

    A body is read line by line: once its lines sum to more than the chunk size, size-long
    pieces are cut from the front (white space between them skipped) and the rest goes on
    as one line. Sections without a body give no chunk.
    """
    size = t.chunk_size
    header = rf"#{{1,6}}[{WS_IN_LINE}]"
    no_text = F.array().cast("array<string>")
    clean = F.array_join(
        F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), "\n"
    )

    def fold(body: Column) -> Column:
        def step(acc: Column, line: Column) -> Column:
            cur = F.when(acc["cur"] == "", line).otherwise(F.concat(acc["cur"], F.lit("\n"), line))
            total = acc["n"] + F.length(line)
            cuts = F.regexp_extract_all(cur, F.lit(f"(?s){NO_GAP}.{{0,{size - 1}}}"), F.lit(0))
            rest = strip(F.element_at(cuts, -1))
            full = F.transform(F.slice(cuts, 1, F.size(cuts) - 1), strip)
            return F.when(
                total <= size, F.struct(acc["out"].alias("out"), cur.alias("cur"), total.alias("n"))
            ).otherwise(
                F.struct(
                    F.concat(acc["out"], full).alias("out"),
                    rest.alias("cur"),
                    F.length(rest).alias("n"),
                )
            )

        start = F.struct(no_text.alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"))
        return F.aggregate(
            F.split(body, "\n"), start, step, lambda a: F.concat(a["out"], F.array(a["cur"]))
        )

    def section(s: Column) -> Column:
        headed = s.rlike("^" + header)
        head = F.when(headed, F.concat(F.substring_index(s, "\n", 1), F.lit("\n"))).otherwise("")
        body = F.when(headed, F.regexp_extract(s, r"(?s)^[^\n]*\n(.*)$", 1)).otherwise(s)
        parts = F.when(F.length(body) <= size, F.array(body)).otherwise(fold(body))
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(head, p))

    return F.flatten(F.transform(F.split(clean, rf"\n(?={header})"), section))


def with_chunks(
    df: DataFrame, template: Template | str | None = None, text: str = "text", out: str = "chunks"
) -> DataFrame:
    """Add an array of chunk texts; the strategy comes from the template."""
    return with_chunks_by(df, {out: template}, text)


def with_chunks_by(df: DataFrame, templates: dict[str, Template | str | None], text: str = "text") -> DataFrame:
    """Add an array of chunk texts by each template, named by its output column."""
    x, packed = F.coalesce(F.col(text), F.lit("")), {}
    for out, template in templates.items():
        t = get_template(template)
        if t.strategy == "markdown_header":
            df = df.withColumn(out, _header_chunks(x, t))
        elif t.strategy == "semantic":
            df = _topics(df, t, _sentences(x), out)
        elif t.strategy == "recursive":
            packed[out] = t, _recursive_segments(x, t)
        elif t.strategy == "sentence":
            packed[out] = t, _sentences(x)
        else:
            packed[out] = t, _flat_segments(x, t)
    return _packed(df, packed) if packed else df


def chunk_corpus(
    docs: DataFrame,
    template: Template | str | None = None,
    source_type: str = "local_file",
    created_at: str | None = None,
) -> DataFrame:
    """Chunk records of documents ``(path, text[, title][, source_type])``.

    ``created_at`` fixes the time stamp ("YYYY-MM-DD HH:MM:SS"); the default is now.
    """
    kind = F.col("source_type") if "source_type" in docs.columns else F.lit(source_type)
    title = F.col("title") if "title" in docs.columns else F.lit(None).cast("string")
    stamp = (
        F.lit(created_at) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    )
    base = docs.select(
        "text",
        F.col("path").alias("source"),
        kind.alias("source_type"),
        source_name(kind, "path", title).alias("source_name"),
    )
    return (
        with_chunks(base, template)
        .withColumn("content_hash", content_hash("text"))
        # The outer form keeps Catalyst from inferring a "not empty" filter, which would
        # be pushed below the packing and compute every chunk list twice.
        .select("source", "source_type", "source_name", "content_hash", F.posexplode_outer("chunks"))
        .filter(F.col("pos").isNotNull())
        .select(
            F.concat(md5_short("source"), F.lit("-"), F.col("pos").cast("string")).alias("id"),
            F.col("col").alias("text"),
            "source",
            "source_type",
            "source_name",
            F.col("pos").alias("chunk_index"),
            "content_hash",
            stamp.alias("created_at"),
        )
        .select(*CHUNK_COLUMNS)
    )
