"""Workflow definitions: files to normalised tables.

Files are found and read by Spark; parsing YAML is the one thing its functions can't do and runs in batches on the executors. All
shapes the format allows (lists or maps, entities defined in place, one or many sources) become rows here, so that everything after
is relational.
"""

from __future__ import annotations

import codecs
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans import schemas
from weftline.shipping import ship


def scan(spark: SparkSession, root: str, pattern: str = "*.cwl", sep: str = "/", relative: bool = True) -> DataFrame:
    """path, content of every matching file below ``root``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    path = F.regexp_replace("path", "^[a-z]+:(//[^/]*)?(?=/)", "")
    if relative:
        plain = root.split(":", 1)[-1].rstrip("/")
        path = F.regexp_replace(path, "^" + "".join(f"\\{c}" if not c.isalnum() else c for c in "/" + plain.lstrip("/")) + "/", "")
    return found.select((path if sep == "/" else F.replace(path, F.lit("/"), F.lit(sep))).alias("path"), "content")


def decode(data: bytes) -> str:
    """UTF-8, with or without mark, or what a mark says; Latin-1 for anything else."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def type_text(kind) -> str | None:
    """A parameter's type as text: a name, alternatives joined by OR, or anything else as canonical JSON."""
    if kind is None or isinstance(kind, str):
        return kind
    if isinstance(kind, list):
        return " OR ".join(x if isinstance(x, str) else type_text(x) or "null" for x in kind)
    return json.dumps(kind, sort_keys=True, default=str)


def _items(of, id_key: str = "id") -> list[tuple[str, object]]:
    """(id, details) of a list of mappings with ids, or of a mapping; other items have no id and are skipped."""
    if isinstance(of, dict):
        return [(str(k), v) for k, v in of.items()]
    if isinstance(of, list):
        return [(str(x[id_key]), x) for x in of if isinstance(x, dict) and x.get(id_key) is not None]
    return []


def _texts(of) -> list[str]:
    return [] if of is None else [str(x) for x in of if x is not None] if isinstance(of, list) else [str(of)]


def _join(sep: str, *parts: str) -> str:
    return sep.join(p for p in parts if p)


def _fold(path: str, sep: str) -> str:
    out: list[str] = []
    for p in path.replace("\\", "/").split("/"):
        if p == "..":
            del out[-1:]
        elif p not in (".", ""):
            out.append(p)
    return sep.join(out)


def normalise(path: str, entity: dict, sep: str = "/"):
    """Yields (table, row) of an entity and those defined inside it, rows being tuples in their schema's order."""
    parts = path.split(sep)
    folder = sep.join(parts[: next((i for i, p in enumerate(parts) if ".cwl" in p), len(parts) - 1)])
    requirements = entity.get("requirements")
    if isinstance(requirements, list):
        requirements = {r.get("class"): r for r in requirements if isinstance(r, dict)}
    listing = ((requirements or {}).get("InitialWorkDirRequirement") or {}).get("listing") if isinstance(requirements, dict) else None
    entries = [{"entryname": str(x.get("entryname") or ""), "entry": str(x.get("entry") or "")} for x in listing or () if isinstance(x, dict)] if isinstance(listing, list) else []
    yield "entities", {"path": path, "class": entity.get("class"), "base_command": _texts(entity.get("baseCommand")), "listing": entries}
    for i, (k, v) in enumerate(_items(entity.get("inputs"))):
        kind = v.get("type") if isinstance(v, dict) else v
        yield "params", {"component_id": path, "direction": "in", "parameter_id": k, "parameter_type": type_text(kind), "sources": [], "ord": i}
    for i, (k, v) in enumerate(_items(entity.get("outputs"))):
        kind, sources = (v.get("type"), _texts(v.get("outputSource"))) if isinstance(v, dict) else (v, [])
        yield "params", {"component_id": path, "direction": "out", "parameter_id": k, "parameter_type": type_text(kind), "sources": sources, "ord": i}
    for i, (k, step) in enumerate(_items(entity.get("steps"))):
        if not isinstance(step, dict):
            continue
        run = step.get("run")
        inline = isinstance(run, dict)
        target = _join(sep, path, k) if inline else None if run is None else _fold(_join("/", folder.replace(sep, "/"), str(run)), sep)
        when = step.get("when")
        yield "steps", {"workflow_id": path, "step_id": k, "ord": i, "run_path": target, "is_inline": inline, "when_expr": None if when is None else str(when)}
        for j, (name, given) in enumerate(_items(step.get("in"))):
            source = given.get("source") if isinstance(given, dict) else given
            yield "step_inputs", {"workflow_id": path, "step_id": k, "input_id": name, "sources": _texts(source), "ord": j}
        if inline:
            yield from normalise(target, run, sep)


def parse(files: DataFrame, sep: str = "/") -> DataFrame:
    """table, row (JSON) of definitions (path, content). A file that isn't YAML, or no mapping, gives a row of table ``errors``."""
    ship(files.sparkSession)

    def run(batches):
        import pyarrow as pa
        import yaml

        for batch in batches:
            names, rows = [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    entity = yaml.load(decode(content or b""), getattr(yaml, "CSafeLoader", yaml.SafeLoader))
                    if not isinstance(entity, dict):
                        raise ValueError("not a mapping")
                    found = list(normalise(path, entity, sep))
                except (yaml.YAMLError, ValueError, RecursionError) as e:
                    found = [("errors", {"path": path, "error": str(e)[:500]})]
                for name, row in found:
                    names.append(name)
                    rows.append(json.dumps(row, default=str))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(rows, pa.string())], names=["table", "row"])

    return files.select("path", "content").mapInArrow(run, "table string, row string")


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """entities, params, steps, step_inputs and errors of parse()'s result, which should be stored: it is read for each."""
    of = {"entities": schemas.ENTITIES, "params": schemas.PARAMS, "steps": schemas.STEPS, "step_inputs": schemas.STEP_INPUTS}
    out = {n: parsed.where(F.col("table") == n).select(F.from_json("row", s).alias("r")).select("r.*") for n, s in of.items()}
    return out | {"errors": parsed.where("table = 'errors'").select(F.from_json("row", "path string, error string").alias("r")).select("r.*")}
