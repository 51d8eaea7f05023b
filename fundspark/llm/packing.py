"""Items into containers of fixed capacity, by best-two-fit.

Each container is filled greedily (the largest item that fits, again and
again); then its smallest item is replaced with two unpacked ones that fit the
expanded gap more tightly, as long as that fills it better.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

#: Items that are packed together. More of them leave less space unused (at most one poorly filled container a shard), fewer make smaller tasks.
SHARD_ITEMS = 20_000

RESULT = "spec_code string, container_id bigint, doc_id bigint, piece_no int, tokens int"


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item; sizes are 1 to ``capacity``."""
    import numpy as np

    sizes = np.asarray(sizes, np.int64)
    order = np.argsort(-sizes, kind="stable")
    stacks: dict[int, list[int]] = {}
    for k in order[::-1]:
        stacks.setdefault(int(sizes[k]), []).append(int(k))
    count = np.zeros(capacity + 1, np.int64)
    for s, items in stacks.items():
        count[s] = len(items)
    mask = 0  # bit s is set while an item of size s is left
    for s in stacks:
        mask |= 1 << s
    out = np.full(len(sizes), -1, np.int64)

    def take(s: int) -> int:
        nonlocal mask
        count[s] -= 1
        if not count[s]:
            mask &= ~(1 << s)
        return stacks[s].pop()

    def give(s: int, item: int) -> None:
        nonlocal mask
        count[s] += 1
        mask |= 1 << s
        stacks[s].append(item)

    box = 0
    while mask:
        gap, inside = capacity, []
        while gap > 0 and (fit := (mask & ((1 << (gap + 1)) - 1)).bit_length() - 1) > 0:
            inside.append((fit, take(fit)))
            gap -= fit
        while gap > 0 and mask:
            small, item = inside[-1]  # items come in falling order
            room = gap + small
            left = np.flatnonzero(count[: room + 1])
            if not len(left):
                break
            mate = np.searchsorted(left, room - left, side="right") - 1
            b = np.where(mate >= 0, left[mate], 0)
            lone = (b == left) & (count[left] < 2)  # the item can't be its own mate
            b = np.where(lone, np.where(mate > 0, left[np.maximum(mate - 1, 0)], 0), b)
            total = np.where(b > 0, left + b, 0)
            k = int(total.argmax())
            if total[k] <= small:
                break
            inside.pop()
            x, y = sorted((int(left[k]), int(b[k])), reverse=True)
            inside += [(x, take(x)), (y, take(y))]
            inside.sort(key=lambda e: -e[0])
            give(small, item)
            gap = room - x - y
        for _, item in inside:
            out[item] = box
        box += 1
    return out


def _pack(table: pa.Table) -> pa.Table:
    import numpy as np
    import pyarrow as pa

    capacity = int(table.column("capacity")[0].as_py())
    shard = int(table.column("shard")[0].as_py())
    tokens = table.column("tokens").to_numpy().astype(np.int64)
    docs = table.column("doc_id")
    full = tokens // capacity
    rest = tokens - full * capacity
    pieces = full + ((rest > 0) | (full == 0))
    row = np.repeat(np.arange(len(tokens)), pieces)
    no = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.where(no < full[row], capacity, rest[row])
    box = np.zeros(len(row), np.int64)
    some = size > 0
    if some.any():
        # in the order of doc_id, so that the result doesn't depend on the order of arrival
        key = np.lexsort((no[some], docs.fill_null(-(1 << 62)).to_numpy()[row[some]]))
        got = np.empty(int(some.sum()), np.int64)
        got[key] = best_two_fit(size[some][key], capacity)
        box[some] = got
    n = len(row)
    return pa.table(
        {
            "spec_code": pa.array([table.column("spec_code")[0].as_py()] * n, pa.string()), "container_id": pa.array(box + (shard << 32), pa.int64()),
            "doc_id": docs.take(pa.array(row)), "piece_no": pa.array(no.astype(np.int32)), "tokens": pa.array(size.astype(np.int32)),
        }
    )


def pack(items: DataFrame, specs: list[tuple[str, int]], shards: int) -> DataFrame:
    """Assigns each row of ``items`` (doc_id, tokens) to a container of each spec (code, capacity), as RESULT.

    An item above the capacity is cut into full containers and a rest
    (``piece_no``); all others stay whole. An item without tokens (null or
    empty text) takes no space and lies in the first container of its shard.
    Items are spread over ``shards`` by the hash of doc_id, so a task packs about SHARD_ITEMS items whatever the size of the corpus.
    """
    spec = F.explode(F.array(*[F.struct(F.lit(c).alias("spec_code"), F.lit(int(n)).alias("capacity")) for c, n in specs]))
    shard = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)).cast("int")
    x = items.select("doc_id", F.coalesce(F.col("tokens").cast("bigint"), F.lit(0)).alias("tokens"), shard.alias("shard"), spec.alias("s"))
    x = x.select("doc_id", "tokens", "shard", "s.spec_code", "s.capacity")
    return x.groupBy("spec_code", "shard").applyInArrow(_pack, RESULT)


def shards_for(n_items: int) -> int:
    return max(1, -(-n_items // SHARD_ITEMS))
