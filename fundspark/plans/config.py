"""Layered settings and golden questions, on the driver."""

from __future__ import annotations

import json
import os
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

GOLDEN = "id string, question string, expected_answer string, expected_chunk_ids array<string>, expected_source_files array<string>, tags array<string>, category string"


def merged(below: dict, above: dict) -> dict:
    """``above`` over ``below``, nested tables key by key."""
    out = dict(below)
    for k, v in above.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _read(path: Path) -> Any:
    text = path.read_text(encoding="utf-8")
    if path.suffix in (".yaml", ".yml"):
        import yaml  # an optional library

        return yaml.safe_load(text)
    return json.loads(text)


def settings(defaults: dict, files: tuple[str, ...] = (), prefix: str = "FUNDSPARK_", env: dict[str, str] | None = None) -> dict:
    """Defaults, then files in order (JSON, or YAML where a reader is installed; one that isn't there is passed over), then variables such as FUNDSPARK_STORE__PATH, which win. Values of variables are JSON or else text."""
    out = defaults
    for f in files:
        if Path(f).is_file():
            out = merged(out, _read(Path(f)) or {})
    for name, value in sorted((os.environ if env is None else env).items()):
        if name.startswith(prefix):
            try:
                value = json.loads(value)
            except ValueError:
                pass
            for key in reversed(name[len(prefix) :].lower().split("__")):
                value = {key: value}
            out = merged(out, value)
    return out


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions of a file (a list, or a table with ``items``) as GOLDEN. ValueError for an item without id or question, or an id that comes twice."""
    data = _read(Path(path))
    items = data["items"] if isinstance(data, dict) else data
    ids = [i.get("id") for i in items]
    if len(set(ids)) != len(ids) or not all(i.get("id") and i.get("question") for i in items):
        raise ValueError("each item needs an id of its own and a question")
    names = [c.split()[0] for c in GOLDEN.split(", ")]
    return spark.createDataFrame([tuple(i.get(n, [] if "array" in GOLDEN.split(", ")[k] else None) for k, n in enumerate(names)) for i in items], GOLDEN)
