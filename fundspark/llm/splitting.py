"""Oversized sections into pieces, by structure-tree packing.

The text is parsed into a tree of headings, blocks (paragraphs, tables, fenced code), nested list items and lines; sentences,
clauses and words are its lowest nodes. Sibling subtrees are merged bottom-up to the limit; only
oversized nodes are descended into. Every character lies in a piece.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundspark.session import bounded_broadcast

if TYPE_CHECKING:
    import pyarrow as pa

DEFAULT_CONFIG = "defaut"

# Ranks of the places where a node of the tree begins, outermost first: headings by level, blocks (paragraphs, tables, code), list items by depth, lines; below them the levels inside a line.
HEADING, NUMBERED, BLOCK, ITEM, LINE = 0, 6, 10, 11, 19
#: List items nest as deep as this; deeper ones count as this deep.
MOST_DEEP = LINE - ITEM - 1
INSIDE = (
    r"(?:[.!?…]+[\"»”')\]]*\s+)(?=\S)|[。！？]",
    r"[;:](?:\s+)(?=\S)|[；：]",
    r",\s+(?=\S)|[，、]",
    r"\s+(?=\S)",
)

# A line by its form: heading marks or tag, number of a heading, list mark, table row, code fence, rule below a heading.
_LINE = (
    r"(?P<blank>\s*$)|(?P<fence>\s*(?:```|~~~))|(?P<under>={3,}\s*$|-{3,}\s*$)|(?P<hashes>#{1,6})\s|<(?P<tag>h[1-6])\b|"
    r"(?P<row>\s*\||[^\n]*\t[^\n]*\t|\s*<t[rdh]\b)|(?P<indent>\s*)(?:[-*+•–·]|\d{1,3}[.)]|[a-z][.)]|<li\b)\s?(?=\S)|"
    r"(?P<word>(?i:article|section|abschnitt|artículo|chapitre|chapter|kapitel)\s\d|[IVXLC]+[.)]\s)|<(?P<block>p|div|ul|ol|table|section|blockquote|pre)\b"
)
_NUMBER = r"(?P<number>\d+(?:\.\d+)*)[.)]?\s[^\r\n]{1,100}$"


RESULT = "section_id bigint, parent_no int, piece_no int, begin int, end int, text string, child_size int, parent_max_chars int"


_KEPT: dict = {}


def _compiled(pattern: str):
    import re

    if pattern not in _KEPT:
        _KEPT[pattern] = re.compile(pattern)
    return _KEPT[pattern]


def structure(text: str) -> list[list[int]]:
    """The tree of a text as the places where a node of each rank begins, rising.

    One pass over the lines. A heading holds what follows up to the next one of its rank or a higher one; blank lines,
    tables and fenced code make blocks; list items nest by their indentation; other lines belong to the item or paragraph
    before them. Headings and list marks inside fences, and lines of a table, stay in their block.
    """
    starts: list[list[int]] = [[] for _ in range(LINE + 1)]
    line, number, at = _compiled(_LINE), _compiled(_NUMBER), 0
    indents: list[int] = []  # of the open list items
    fence, row, after_blank, last = False, False, True, 0
    while at < len(text):
        end = _line_end(text, at)
        own = text[at:end]
        m = line.match(own)
        kind = m.lastgroup if m else None
        rank = LINE
        if fence:
            fence = kind != "fence"
        elif kind == "blank":
            after_blank = True
            at = _next_line(text, end)
            continue
        elif kind == "fence":
            fence, rank = True, BLOCK
        elif kind == "under" and not after_blank:
            # the line before is a heading
            starts[HEADING if own[0] == "=" else HEADING + 1].append(last)
        elif kind == "hashes":
            rank = HEADING + len(m["hashes"]) - 1
        elif kind == "tag":
            rank = HEADING + int(m["tag"][1]) - 1
        elif kind == "row":
            rank = LINE if row and not after_blank else BLOCK
        elif kind == "word":
            rank = NUMBERED
        elif after_blank and (n := number.match(own)):
            rank = NUMBERED + min(n["number"].count("."), BLOCK - NUMBERED - 1)
        elif kind == "indent":
            deep = len(m["indent"].expandtabs(4))
            while indents and indents[-1] > deep:
                indents.pop()
            if not indents or indents[-1] < deep:
                indents.append(deep)
            rank = ITEM + min(len(indents) - 1, MOST_DEEP)
        elif kind == "block" or after_blank:
            rank = BLOCK
        if rank <= BLOCK:
            indents.clear()
        row = kind == "row"
        if at:
            starts[rank].append(at)
        after_blank, last = False, at
        at = _next_line(text, end)
    return starts


def _line_end(text: str, at: int) -> int:
    m = _compiled(r"[\r\n]").search(text, at)
    return m.start() if m else len(text)


def _next_line(text: str, end: int) -> int:
    return end + 2 if text[end : end + 2] == "\r\n" else end + 1


def _children(text: str, starts: list[list[int]], a: int, b: int, rank: int) -> list[tuple[int, int]]:
    """The nodes of a rank in text[a:b]."""
    if rank <= LINE:
        own = starts[rank]
        cuts = own[bisect_right(own, a) : bisect_left(own, b)]
    else:
        cuts = [m.end() for m in _compiled(INSIDE[rank - LINE - 1]).finditer(text, a, b) if a < m.end() < b]
    edges = [a, *cuts, b]
    return list(zip(edges[:-1], edges[1:]))


def pack_tree(text: str, a: int, b: int, limit: int, starts: list[list[int]] | None = None) -> list[tuple[int, int]]:
    """Consecutive spans that cover text[a:b], each at most ``limit`` long and cut as high in the tree as possible.

    Siblings are merged up to the limit, only oversized nodes are descended into. ``starts``: ``structure`` of the text.
    """
    if b - a <= limit:
        return [(a, b)]
    starts = structure(text) if starts is None else starts
    out: list[tuple[int, int]] = []
    stack = [(a, b, 0)]  # nodes still to be packed, the next one last
    open_ = False  # whether the last span may still take siblings
    while stack:
        a, b, level = stack.pop()
        if level < 0:
            open_ = False
            continue
        if b - a <= limit:
            if open_ and out and b - out[-1][0] <= limit:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
            open_ = True
        elif level == LINE + 1 + len(INSIDE):
            # no boundary left: fixed cuts, never before a combining mark
            import unicodedata

            while b - a > limit:
                cut = a + limit
                while cut > a + 1 and unicodedata.combining(text[cut]):
                    cut -= 1
                if cut == a + 1 and limit > 1:
                    cut = a + limit
                out.append((a, cut))
                a = cut
            out.append((a, b))
            open_ = True
        else:
            nodes = _children(text, starts, a, b, level)
            # what stands before an oversized node isn't merged with its insides, apart from a short head
            if open_ and out and out[-1][1] - out[-1][0] > limit // 4:
                open_ = False
            stack.append((0, 0, -1))
            stack.extend((x, y, level + 1) for x, y in reversed(nodes))
    return out


def pieces(text: str, size: int, overlap: int, parent_max: int) -> list[tuple[int, int, int]]:
    """(parent number, begin, end) of each piece of ``text``, in code points.

    Parents are consecutive, at most ``parent_max`` long and cover the text;
    within a parent every piece is at most ``size`` long and begins
    ``overlap`` characters before the end of the one before it (at the
    parent's begin where that is shorter). A text within both limits is one piece, an empty one none.
    """
    size, parent_max = max(1, size), max(1, parent_max)
    overlap = min(max(0, overlap), size - 1)
    out = []
    if not text or len(text) <= min(size, parent_max):
        return [(0, 0, len(text))] if text else []
    starts = structure(text)
    for no, (a, b) in enumerate(pack_tree(text, 0, len(text), parent_max, starts)):
        if b - a <= size:
            out.append((no, a, b))
            continue
        for x, y in pack_tree(text, a, b, size - overlap, starts):
            out.append((no, max(a, x - overlap), y))
    return out


def _split(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa

    names = ["section_id", "parent_no", "piece_no", "begin", "end", "text", "child_size", "parent_max_chars"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]

    def send(rows: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    rows, chars = [], 0
    for batch in batches:
        for key, text, size, overlap, most in zip(*(c.to_pylist() for c in batch.columns)):
            for k, (no, a, b) in enumerate(pieces(text or "", size, overlap, most)):
                rows.append((key, no, k, a, b, text[a:b] if with_text else None, size, most))
                chars += b - a if with_text else 100
                if chars > 4_000_000:
                    yield send(rows)
                    rows, chars = [], 0
    if rows:
        yield send(rows)


def split_sections(sections: DataFrame, configs: DataFrame, with_text: bool = True) -> DataFrame:
    """The pieces of each section, as RESULT; ``piece_no`` counts through the section.

    ``sections``: section_id, text, config_code; a null or unknown code means
    the default configuration. ``configs``: config_code, child_size,
    child_overlap, parent_max_chars, a small fixed table that is broadcast. Other
    columns are dropped. A null or empty text gives no row; a blank one is cut like any other. No shuffle.
    Without ``with_text`` only the places of the pieces come out.
    """
    c = configs.groupBy(F.col("config_code").alias("_c")).agg(*[F.first(x).alias(x) for x in ("child_size", "child_overlap", "parent_max_chars")])
    c = bounded_broadcast(c, configs)
    own = sections.select("section_id", "text", "config_code").join(c, F.col("config_code") == F.col("_c"), "left").drop("_c")
    names = ("child_size", "child_overlap", "parent_max_chars")
    plain = configs.where(F.col("config_code") == DEFAULT_CONFIG).select(*names).first() or (800, 120, 12_000)
    limits = [F.coalesce(n, F.lit(v)).alias(n) for n, v in zip(names, plain)]
    return own.select(F.col("section_id").cast("bigint"), "text", *limits).mapInArrow(lambda batches: _split(batches, with_text), RESULT)


def over_limit(parts: DataFrame) -> DataFrame:
    """(section_id, limit_name) of the sections that are longer than a limit of theirs: a piece ends beyond it.

    Pieces cover their section, so the last one ends at its length; that a section was cut doesn't tell by which limit.
    """
    over = F.filter(F.array(*[F.when(F.col("end") > F.col(n), n) for n in ("child_size", "parent_max_chars")]), lambda n: n.isNotNull())
    return parts.where(F.col("end") > F.least("child_size", "parent_max_chars")).select("section_id", F.explode(over).alias("limit_name")).distinct()
