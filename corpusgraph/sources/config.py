"""Strictly validated options, project scaffold and evaluation cases."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.schema import MAX_FILE_BYTES

CONFIG = "corpusgraph.yaml"
FOLDER = ".corpusgraph"
KEYS = {"include", "exclude", "max_file_bytes", "allow_secret_content"}


def parse_yaml(text: str) -> dict:
    """The subset in use: ``key: value``, one level of nesting, lists of strings."""
    out: dict = {}
    here, key = out, None
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        if body.startswith("- "):
            if key is None:
                raise ValueError(f"list item without a key: {raw}")
            if not isinstance(here.get(key), list):
                here[key] = []
            here[key].append(_scalar(body[2:]))
            continue
        name, colon, value = body.partition(":")
        if not colon:
            raise ValueError(f"not a mapping: {raw}")
        if indent == 0:
            here, key = out, name
            out[name] = _value(value) if value.strip() else {}
        else:
            section = list(out)[-1]
            if not isinstance(out[section], dict):
                raise ValueError(f"unexpected indent: {raw}")
            here, key = out[section], name
            here[name] = _value(value) if value.strip() else []
    return out


def _value(text: str):
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    return _scalar(text)


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1]:
        return text[1:-1]
    if text in ("true", "false"):
        return text == "true"
    return int(text) if text.lstrip("-").isdigit() else text


def index_options(root: str) -> dict:
    """Validated index options of a project; defaults where there is no file."""
    file = Path(root, CONFIG)
    data = parse_yaml(file.read_text()) if file.is_file() else {"version": 1}
    if type(data.get("version")) is not int or data["version"] != 1:
        raise ValueError("version must be the integer 1")
    index = data.get("index", {})
    if not isinstance(index, dict) or set(index) - KEYS:
        raise ValueError("unknown index options")
    for k in KEYS - {"max_file_bytes"}:
        if k in index and not (isinstance(index[k], list) and all(isinstance(p, str) and p for p in index[k])):
            raise ValueError(f"{k} must be a list of patterns")
    size = index.get("max_file_bytes", MAX_FILE_BYTES)
    if type(size) is not int or size <= 0:
        raise ValueError("max_file_bytes must be a positive integer")
    return {"include": tuple(index.get("include", ("**",))), "exclude": tuple(index.get("exclude", ())), "allow": tuple(index.get("allow_secret_content", ())), "max_bytes": size}


def scaffold(root: str) -> None:
    """Config, ignore file and folder of a project; what exists stays."""
    config, ignore = Path(root, CONFIG), Path(root, ".gitignore")
    if not config.exists():
        config.write_text('version: 1\nindex:\n  include: ["**"]\n')
    Path(root, FOLDER).mkdir(exist_ok=True)
    held = ignore.read_text().splitlines() if ignore.exists() else []
    if f"{FOLDER}/" not in held:
        ignore.write_text("\n".join([*held, f"{FOLDER}/"]) + "\n")


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """(query, expected) of a JSON file of cases."""
    return spark.read.json(path, multiLine=True, schema="cases array<struct<query:string,expected:array<string>>>").select(F.explode("cases").alias("c")).select("c.*")


def recall_at(cases: DataFrame, found: DataFrame, k: int = 5) -> DataFrame:
    """Mean recall of the expected results among the first k."""
    both = cases.join(found, "query")
    return both.agg(F.avg(F.size(F.array_intersect("expected", F.slice("found", 1, k))) / F.greatest(F.lit(1), F.size("expected"))).alias("recall"), F.median("latency_ms").alias("median_ms"))
