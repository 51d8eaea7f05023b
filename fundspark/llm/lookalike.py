"""One consistent form for texts that look alike but differ in their characters.

Compatibility normalisation in composed form, full case folding, mapped white
space and removal of default-ignorable characters, vectorised per distinct
value of a batch; letters of other scripts that look like Latin ones are mapped to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundspark.operators.pairs import differing_pairs

if TYPE_CHECKING:
    import pyarrow as pa

# Cyrillic, Greek and other letters, in the order of the Latin letters they look like.
LOOKALIKES = {
    "АВЕЅІЈКМНОРСТХУ": "ABESIJKMHOPCTXY",
    "асеіјорѕхуһԁԛԝ": "aceijopsxyhdqw",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "οϲϳ": "ocj",
    "ІЇ": "IÏ",
    "ёЁїӓӒӧӦ": "ëËïäÄöÖ",
    "ԌԚԜ": "GQW",
    "ѵүӏԌ": "vylG",
    "ѴҮӀ": "VYI",
    "օսոհցզՕՍՏԼ": "ounhgqOUSL",
    "ν": "v",
    "ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ": "BPdDTGKJCZFMNLSRVHWXYAEIOU",
    "‐‑": "--",
}

# Default-ignorable code points (first, last).
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

#: Compatibility forms that look different from their plain ones are kept: raised and lowered signs, fractions, circled and squared signs.
_KEPT_FORMS = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>")


class _Map(dict):
    """Character to what it becomes, filled as characters come up."""

    def __init__(self, look: bool):
        super().__init__()
        self.look = look
        self.latin = {ord(a): b for x, y in LOOKALIKES.items() for a, b in zip(x, y)}

    def __missing__(self, code: int) -> str:
        import unicodedata

        c = chr(code)
        if any(a <= code <= b for a, b in IGNORABLE):
            out = ""
        elif code in self.latin:
            out = self.latin[code]
        elif c.isspace() or code in (0x2028, 0x2029):
            out = " "
        else:
            form = unicodedata.decomposition(c)
            out = c if self.look and form.startswith(_KEPT_FORMS) else unicodedata.normalize("NFKC", c)
            if out != c and len(out) >= 1:
                out = "".join(self[ord(x)] if x != c else x for x in out)
        self[code] = out
        return out


_MAPS: dict[bool, _Map] = {}


def normal_form(text: str, look: bool = False) -> str:
    """The consistent form of a text.

    ``look`` keeps what a reader can tell apart (letter case, raised digits);
    without it the form is also case-folded and raised digits are plain ones.
    Runs of white space, line ends too, become one blank, and the ends have none.
    """
    import unicodedata

    if look not in _MAPS:
        _MAPS[look] = _Map(look)
    out = text if text.isascii() else unicodedata.normalize("NFC", text.translate(_MAPS[look]))
    if not look:
        out = unicodedata.normalize("NFC", out.casefold().translate(_MAPS[look]))
    return " ".join(out.split())


def _forms(with_text: bool):
    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import pyarrow as pa

        digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).digest()[:16]
        for batch in batches:
            values = batch.column(1).dictionary_encode()
            words = values.dictionary.to_pylist()
            flat = [normal_form(w) for w in words]
            look = [normal_form(w, look=True) for w in words]
            at = values.indices
            yield pa.record_batch(
                [
                    batch.column(0),
                    *batch.columns[2:],
                    pa.array(flat if with_text else [None] * len(flat), pa.string()).take(at),
                    pa.array([digest(a) if a else None for a in flat], pa.binary()).take(at),
                    pa.array([digest(b) if b else None for b in look], pa.binary()).take(at),
                    pa.array([digest(w) for w in words], pa.binary()).take(at),
                ],
                names=["id", *batch.schema.names[2:], "normal", "flat_key", "look_key", "stored_key"],
            )

    return forms


def normalise(rows: DataFrame, with_text: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Of each row of ``rows`` (id, text and strings to ``keep``; other columns are dropped): ``normal``, the consistent form, and 128-bit keys.

    ``flat_key`` is that of the consistent form, ``look_key`` that of the
    form which keeps what a reader can tell apart, ``stored_key`` that of the
    characters as stored. A null text gives nulls; a blank one gives the empty form and null keys of it.
    Without ``with_text`` the form itself stays out (null), as where only keys are compared.
    No shuffle; each distinct value of a batch is normalised once.
    """
    kept = "".join(f"{k} string, " for k in keep)
    return rows.select("id", "text", *keep).mapInArrow(_forms(with_text), f"id bigint, {kept}normal string, flat_key binary, look_key binary, stored_key binary")


def look_alike_pairs(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``, id_a < id_b) of the non-blank texts of ``rows`` (id, text, ``by``), within equal ``by``, that look the same but aren't stored with the same characters.

    Rows meet on the key of the consistent form and, as the exact check, on that of the looks, which keeps case and raised
    digits. Only keys are shuffled, no texts; copies of one text aren't compared with each other (``differing_pairs``).
    """
    keys = normalise(rows, with_text=False, keep=by).select("id", *by, "flat_key", "look_key", F.col("stored_key").alias("stored"))
    return differing_pairs(keys.dropna(), [*by, "flat_key", "look_key"], by)
