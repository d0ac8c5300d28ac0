"""Record schemas, chunk templates and other fixed parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- record shapes -----------------------------------------------------------

CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("created_at", T.StringType()),
    ]
)
VECTOR_CHUNK = T.StructType(
    [*CHUNK.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]
)
CHUNK_COLUMNS = CHUNK.fieldNames()
VECTOR_CHUNK_COLUMNS = VECTOR_CHUNK.fieldNames()


# --- chunk templates ---------------------------------------------------------


@dataclass(frozen=True)
class Template:
    """How a text is cut. ``overlap`` counts characters, ``overlap_sentences`` sentences."""

    name: str
    chunk_size: int
    overlap: int = 0
    strategy: str = "flat"
    separators: tuple[str, ...] = ()
    overlap_sentences: int = 2

    def __post_init__(self):
        if self.chunk_size < 2:
            raise ValueError("chunk_size must be at least 2")
        # An overlap above half the size could stop a window from advancing.
        if not 0 <= self.overlap <= self.chunk_size // 2:
            raise ValueError("overlap must lie between 0 and chunk_size / 2")
        if self.overlap_sentences < 0:
            raise ValueError("overlap_sentences must not be negative")


# The preset templates.
TEMPLATES = {
    "academic": Template(
        "academic", 1000, 200, "recursive",
        ("\n\n", "\n", "\r\n", "。", ". ", "！", "?", "？", "!", "；", ";", "，", ",", "、", " ", ""),
    ),
    "chinese": Template(
        "chinese", 1500, 150, "recursive",
        ("\n\n", "\n", "。", "！", "？", "；", "，", "、", " ", ""),
    ),
    "code": Template("code", 3000, 300, "flat", ("\n\n\n", "\n\n", "\n", ". ", " ", "")),
    "custom": Template("custom", 500, 100, "recursive", ("\n\n", "\n", " ", "")),
    "sentence": Template("sentence", 1000, 0, "sentence", (), 2),
    "markdown_header": Template("markdown_header", 2000, 0, "markdown_header"),
}
DEFAULT_TEMPLATE = "academic"

#: Cut between sentences that share few words; given as an object, it is none of the presets.
SEMANTIC = Template("semantic", 1000, 0, "semantic")
#: Of a text's neighbouring sentences, those below this percentile of similarity are parted.
BREAK_PERCENT = 20


def get_template(template: str | Template | None = None) -> Template:
    """A template object as is, a preset by name, the default for an unknown name."""
    if isinstance(template, Template):
        return template
    return TEMPLATES.get(template or DEFAULT_TEMPLATE, TEMPLATES[DEFAULT_TEMPLATE])


# File extensions the corpus reader accepts (lower case, no dot).
EXTENSIONS = (
    "pdf", "docx", "txt", "md", "py", "js", "ts", "java", "c", "cpp", "go", "rs", "r", "sh",
    "ps1", "swift", "kt", "rb", "lua", "sql", "json", "yaml", "yml", "csv", "xml", "toml",
    "ini", "cfg", "conf", "log", "html", "css",
)
# Binary office formats are listed as supported but must be turned to text upstream.
BINARY_EXTENSIONS = ("pdf", "docx")
TEXT_EXTENSIONS = tuple(e for e in EXTENSIONS if e not in BINARY_EXTENSIONS)

# Characters counted as white space when a text is stripped.
WHITESPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)

# Marks kept at the end of the piece they close.
KEPT_MARKS = ".。!！?？;；"

# Import messages.
MSG_MISSING = "文件不存在"
MSG_UNSUPPORTED = "不支持的格式"
MSG_EMPTY = "文件内容为空"

# Retrieval and embedding defaults.
TOP_K = 5
FETCH_K = 15
EMBED_BATCH = 50
PAGE_SIZE = 20
SPACES = ("cosine", "l2", "ip")

# BM25's saturation and length norm, reciprocal-rank fusion's constant.
BM25_K1, BM25_B = 1.2, 0.75
FUSION_CONSTANT = 60

# Phrases of stored pages and of answers.
NAME_LINE = "[文件名: "
PAGE_TITLE, PAGE_SOURCE, PAGE_TIME = "[网页标题: ", "[来源: ", "[爬取时间: "
ANSWER_SOURCE, ANSWER_SIMILARITY = "] 来源: ", " | 相似度: "
ANSWER_FOUND, ANSWER_COUNT, ANSWER_RANKED = "找到 ", " 条相关文档", "（已重排）| 分数: "
