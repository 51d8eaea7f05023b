"""Sections to overlapping child chunks by a recursive character split, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundspark.functions.scalars import chunk_id
from fundspark.session import bounded_broadcast

if TYPE_CHECKING:
    import pyarrow as pa

# Separators from coarse to fine, and the usual sizes.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", "")
SIZE, OVERLAP, DEFAULT_CONFIG = 800, 120, "defaut"


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters (unless one has no separator left); a separator stays with what follows it.

    A text is cut at the first separator that it holds; short cuts are joined
    to pieces that share up to ``overlap`` characters in whole cuts, longer ones are cut at the next separator. Pieces are stripped, blank ones dropped.
    """
    at = next((k for k, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    if sep:
        head, *rest = text.split(sep)
        cuts = [c for c in (head, *(sep + r for r in rest)) if c]
    else:
        cuts = list(text)
    out: list[str] = []
    short: list[str] = []
    for cut in cuts:
        if len(cut) < size:
            short.append(cut)
            continue
        out += _join(short, size, overlap)
        short = []
        out += split_text(cut, size, overlap, finer) if finer else [cut]
    return out + _join(short, size, overlap)


def _join(cuts: list[str], size: int, overlap: int) -> list[str]:
    out, first, total = [], 0, 0
    for k, cut in enumerate(cuts):
        if total + len(cut) > size and k > first:
            out.append("".join(cuts[first:k]).strip())
            while first < k and (total > overlap or total + len(cut) > size):
                total -= len(cuts[first])
                first += 1
        total += len(cut)
    if first < len(cuts):
        out.append("".join(cuts[first:]).strip())
    return [x for x in out if x]


def child_chunks(sections: DataFrame, configs: DataFrame) -> DataFrame:
    """(id, parent_id, source_file, section_index, child_index, text) of sections (source_file, section_index, text, config_code). Row-wise, without a shuffle; null and blank texts give none.

    ``configs``: config_code, child_size, child_overlap, a small fixed table that is broadcast. A null or unknown code means the default configuration.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            rows = [(f, i, k, x) for f, i, t, size, overlap in zip(*(c.to_pylist() for c in batch.columns)) if t for k, x in enumerate(split_text(t, size, overlap))]
            cols = list(zip(*rows)) or [(), (), (), ()]
            types = (pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["source_file", "section_index", "child_index", "text"])

    names = ("child_size", "child_overlap")
    plain = configs.where(F.col("config_code") == DEFAULT_CONFIG).select(*names).first() or (SIZE, OVERLAP)
    own = bounded_broadcast(configs.groupBy(F.col("config_code").alias("_c")).agg(*[F.first(n).alias(n) for n in names]))
    x = sections.join(own, F.col("config_code") == F.col("_c"), "left")
    limits = [F.coalesce(n, F.lit(v)).alias(n) for n, v in zip(names, plain)]
    x = x.select("source_file", F.col("section_index").cast("int").alias("section_index"), "text", *limits)
    x = x.mapInArrow(cut, "source_file string, section_index int, child_index int, text string")
    return x.select(
        chunk_id(F.col("source_file"), "c", F.col("section_index"), F.col("child_index")).alias("id"),
        chunk_id(F.col("source_file"), "p", F.col("section_index")).alias("parent_id"),
        "*",
    )
