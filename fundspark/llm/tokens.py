"""Encoding of a whole corpus with a public byte-level BPE.

A global distinct-word shuffle: documents are cut into pre-tokens in blocks,
each block sends every distinct word once, and its sequence of word numbers; words meet on
the shuffle by word and are encoded there once; ids return to their block and
are put together by position. Decoding joins the table of token bytes.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

#: Folder of the public vocabulary files; a parameter of every operator here.
TOKENIZER_DIR = os.environ.get("FUNDSPARK_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the public pre-tokenisation pattern of these vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text in a block (a longer text makes a block of its own) and words whose ids a task remembers.
BLOCK_CHARS, REMEMBERED_WORDS = 1_000_000, 1_000_000
#: The words of a block that come first by frequency, and over how many keys such a word's blocks are spread.
FREQUENT_WORDS, SALTS = 4096, 64

# A row of a block's word: its number in the block. The block's own row (number -1): the numbers of its words in order, packed, and the words of each document.
_BLOCKS = "block bigint, word string, no int, sequence binary, counts binary, docs array<bigint>"
_CODED = "block bigint, no int, ids binary, size int, sequence binary, counts binary, docs array<bigint>"


def read_ranks(tokenizer: str, folder: str = TOKENIZER_DIR) -> bytes:
    """The vocabulary file of a byte-level BPE (about 0.8 MB), read on the driver and sent to the executors."""
    with open(os.path.join(folder, f"{tokenizer}.tiktoken"), "rb") as f:
        return f.read()


def ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


_ENCODERS: dict[int, object] = {}


def _encoder(raw: bytes):
    import tiktoken

    key = hash(raw)
    if key not in _ENCODERS:
        _ENCODERS[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks_of(raw), special_tokens={})
    return _ENCODERS[key]


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 in little space: their bytes by rank, lowest first, deflated (numbers are by falling frequency, so high bytes are mostly 0)."""
    import zlib

    import numpy as np

    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    import zlib

    import numpy as np

    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").reshape(-1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import pyarrow as pa
    import regex
    from pyspark import TaskContext

    find = regex.compile(PATTERN).findall
    block = TaskContext.get().partitionId() << 32
    schema = pa.schema(
        [("block", pa.int64()), ("word", pa.string()), ("no", pa.int32()), ("sequence", pa.binary()), ("counts", pa.binary()), ("docs", pa.list_(pa.int64()))]
    )

    def send(docs: list, counts: list, known: dict, flat: list) -> pa.RecordBatch:
        at = np.fromiter(flat, np.int64, len(flat))
        order = np.argsort(-np.bincount(at, minlength=len(known)), kind="stable")
        rank = np.empty(len(known), np.int64)
        rank[order] = np.arange(len(known))
        # the block's own row has a key that no pre-token can have: a mark right before digits
        n = len(known)
        return pa.record_batch(
            [
                pa.array([block] * (n + 1), pa.int64()), pa.array([f"\x00{block}", *known], pa.string()), pa.array(np.r_[-1, rank].astype(np.int32)),
                pa.array([_packed(rank[at]), *[None] * n], pa.binary()), pa.array([np.array(counts, np.int32).tobytes(), *[None] * n], pa.binary()),
                pa.array([docs, *[None] * n], pa.list_(pa.int64())),
            ],
            schema=schema,
        )

    docs, counts, known, flat, chars = [], [], {}, [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = find(text) if text else []
            docs.append(doc)
            counts.append(len(words))
            flat.extend([known.setdefault(w, len(known)) for w in words])
            chars += len(text or "") + 50
            if chars >= BLOCK_CHARS:
                yield send(docs, counts, known, flat)
                block += 1
                docs, counts, known, flat, chars = [], [], {}, [], 0
    if docs:
        yield send(docs, counts, known, flat)


def _code_words(raw, with_ids: bool):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        one = _encoder(raw.value)._encode_single_piece
        known: dict[str, tuple[bytes | None, int]] = {}
        for batch in batches:
            ids, sizes = [], []
            for w, no in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if no < 0:
                    ids.append(None)
                    sizes.append(0)
                    continue
                got = known.get(w)
                if got is None:
                    if len(known) >= REMEMBERED_WORDS:
                        known.clear()
                    new = one(w)
                    got = known[w] = (np.array(new, np.int32).tobytes() if with_ids else None, len(new))
                ids.append(got[0])
                sizes.append(got[1])
            cols = [batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), *batch.columns[3:6]]
            yield pa.record_batch(cols, names=["block", "no", "ids", "size", "sequence", "counts", "docs"])

    return code


def _opened(table: pa.Table):
    """Documents of a block, words of each, its words in order, and rows and sizes of the words by their number."""
    import numpy as np

    no = table.column("no").to_numpy()
    own = int(np.flatnonzero(no < 0)[0])
    words = np.flatnonzero(no >= 0)
    words = words[np.argsort(no[words])]
    per_doc = np.frombuffer(table.column("counts")[own].as_py(), np.int32)
    size = table.column("size").to_numpy()[words].astype(np.int64)
    return table.column("docs")[own].as_py(), per_doc, _unpacked(table.column("sequence")[own].as_py()), words, size


def _assemble(table: pa.Table) -> pa.Table:
    import numpy as np
    import pyarrow as pa

    doc_ids, per_doc, sequence, words, size = _opened(table)
    parts = table.column("ids").combine_chunks().take(pa.array(words)).to_pylist()
    ids = np.frombuffer(b"".join(parts), np.int32)
    start = np.cumsum(size) - size  # of each word's ids
    long = size[sequence] if len(sequence) else np.zeros(0, np.int64)
    begin = np.r_[0, np.cumsum(long)]
    flat = ids[np.repeat(start[sequence] - begin[:-1], long) + np.arange(begin[-1])] if len(sequence) else np.zeros(0, np.int32)
    cuts = begin[np.r_[0, np.cumsum(per_doc)]].astype(np.int32)
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int32()))})


def _add_up(table: pa.Table) -> pa.Table:
    import numpy as np
    import pyarrow as pa

    doc_ids, per_doc, sequence, _, size = _opened(table)
    upto = np.r_[0, np.cumsum(size[sequence])] if len(sequence) else np.zeros(1, np.int64)
    cuts = np.r_[0, np.cumsum(per_doc)]
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "tokens": pa.array(upto[cuts[1:]] - upto[cuts[:-1]], pa.int64())})


def _coded(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str, with_ids: bool):
    """The blocks' words, coded and grouped by block again.

    A word that is among the most frequent of its block comes from nearly every block of the corpus, so its rows are spread
    over SALTS keys by block; rarer words meet on one key. Each key is coded once, so either way gives the same ids.
    """
    raw = spark.sparkContext.broadcast(read_ranks(tokenizer, folder))
    words = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_blocks, _BLOCKS)
    salt = F.when(F.col("no").between(0, FREQUENT_WORDS - 1), F.pmod(F.xxhash64("block"), F.lit(SALTS))).otherwise(0)
    return words.repartition("word", salt).mapInArrow(_code_words(raw, with_ids), _CODED).groupBy("block")


def encode(spark: SparkSession, docs: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, ids) of each row of ``docs`` (doc_id, text; other columns are dropped), without special tokens.

    A null or an empty text has the empty list. Every row gives one row, repeated
    and null doc_ids too. Words are spread by their hash and a word comes once
    per block of about a million characters, so that neither a frequent word nor a long text fills a task.
    """
    return _coded(spark, docs, tokenizer, folder, True).applyInArrow(_assemble, "doc_id bigint, ids array<int>")


def sizes(spark: SparkSession, docs: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, tokens): the number of ids that ``encode`` gives, without making the lists; only the number of ids of each word returns to its block."""
    return _coded(spark, docs, tokenizer, folder, False).applyInArrow(_add_up, "doc_id bigint, tokens bigint")


def token_table(spark: SparkSession, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id, bytes) of each token of the vocabulary: about 50,000 rows, a size fixed by the tokenizer."""
    rows = [(i, bytearray(b)) for b, i in ranks_of(read_ranks(tokenizer, folder)).items()]
    return spark.createDataFrame(rows, "id int, bytes binary")


def decode(spark: SparkSession, encoded: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, text) by a join of the exploded ids with the token-byte table; an empty list gives the empty text.

    doc_ids must be unique. The join is by a broadcast of the vocabulary, bounded by the tokenizer.
    """
    places = encoded.select("doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    joined = places.join(F.broadcast(token_table(spark, tokenizer, folder)), "id", "left")
    parts = joined.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("bytes").isNotNull(), F.struct("pos", F.hex("bytes").alias("h"))))).alias("p"))
    return parts.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")), "UTF-8").alias("text"))
