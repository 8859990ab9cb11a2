"""Snapshots of declared manifests: probes derived from them, a seal, and whether the content still reproduces it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.canon import canonical, digest, parse

SCHEMA, SCHEMES = "snapshot/1", ("index", "content")
#: What the seal is over; `id_scheme` only where it isn't the first of SCHEMES.
CORE = ("schema", "label", "manifest_digest", "probe_set_digest", "created_at")


def probes_of(manifest: dict, scheme: str = "content") -> list[dict]:
    """A probe for every item of every field, in order of their ids.

    An id names the field, and the item by its place or by its content's hash;
    by content, an item keeps its id when others come or go, and equal items of
    a field are one probe.
    """
    found = {}
    for field, value in manifest.items():
        for place, item in enumerate(value if isinstance(value, list) else [value]):
            answer = item if isinstance(item, str) else canonical(item)
            name = str(place) if scheme == "index" else hashlib.sha256(canonical(item).encode()).hexdigest()[:12]
            found[f"{field}:{name}"] = {"id": f"{field}:{name}", "prompt": f"State {field} {name}.", "scoring": {"type": "exact_match", "answer": answer}}
    return [found[k] for k in sorted(found)]


def _seal(snapshot: dict) -> str:
    core = {k: snapshot[k] for k in CORE}
    return digest(core if snapshot["id_scheme"] == SCHEMES[0] else core | {"id_scheme": snapshot["id_scheme"]})


def _sealed(label: str | None, raw: str | None, created_at: str, scheme: str) -> tuple[str | None, str | None]:
    ok, manifest = parse(raw, unique_keys=True) if raw is not None else (False, None)
    if not ok or not isinstance(manifest, dict):
        return None, "the manifest is no object"
    try:
        probes = probes_of(manifest, scheme)
        if not probes:
            return None, "nothing to probe"
        made = {"schema": SCHEMA, "label": label, "manifest": manifest, "manifest_digest": digest(manifest), "probes": probes, "probe_set_digest": digest(probes), "created_at": created_at, "id_scheme": scheme}
        return canonical(made | {"digest": _seal(made)}), None
    except (ValueError, RecursionError):
        return None, "the manifest has no digest"


def sealed(manifests: DataFrame, created_at: str, scheme: str = "content") -> DataFrame:
    """(id, raw, problem) of manifests (id, label, manifest: JSON text): the snapshot's canonical JSON, or why there is none."""
    if scheme not in SCHEMES:
        raise ValueError(f"id scheme must be one of {SCHEMES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_sealed(a, b, created_at, scheme) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([m[i] for m in made], pa.string()) for i in range(2)]], names=["id", "raw", "problem"])

    rows = manifests.select("id", F.col("label").cast("string"), F.col("manifest").cast("string"))
    return rows.mapInArrow(run, f"id {manifests.schema['id'].dataType.simpleString()}, raw string, problem string")


def _state(raw: str | None) -> str:
    ok, s = parse(raw, unique_keys=True) if raw is not None else (False, None)
    if not ok:
        return "unreadable"
    if not isinstance(s, dict) or s.get("schema") != SCHEMA:
        return "other_schema"
    if not {*CORE, "manifest", "probes", "id_scheme", "digest"} <= s.keys() or s["id_scheme"] not in SCHEMES or not isinstance(s["manifest"], dict):
        return "malformed"
    probes = s["probes"]
    if not isinstance(probes, list) or not probes or not all(isinstance(p, dict) and {"id", "prompt", "scoring"} <= p.keys() for p in probes):
        return "malformed"
    try:
        if digest(s["manifest"]) != s["manifest_digest"]:
            return "manifest_altered"
        if digest(sorted(probes, key=lambda p: str(p["id"]))) != s["probe_set_digest"]:
            return "probes_altered"
        if probes_of(s["manifest"], s["id_scheme"]) != sorted(probes, key=lambda p: str(p["id"])):
            return "probes_not_of_manifest"
        return "good" if _seal(s) == s["digest"] else "seal_altered"
    except (ValueError, RecursionError):
        return "malformed"


def check(snapshots: DataFrame) -> DataFrame:
    """(id, state) of snapshots (id, raw): good, or the first thing that doesn't hold.

    States in order: unreadable (a key twice too), other_schema, malformed,
    manifest_altered, probes_altered (their digest doesn't reproduce),
    probes_not_of_manifest, seal_altered. The seal is over digests, so each
    digest is derived from its content first. The order of probes in the file
    plays no part; repeated rows come back as often as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_state(r) for r in batch.column(1).to_pylist()], pa.string())], names=["id", "state"])

    return snapshots.select("id", F.col("raw").cast("string")).mapInArrow(run, f"id {snapshots.schema['id'].dataType.simpleString()}, state string")


def probes(snapshots: DataFrame) -> DataFrame:
    """(id, probe, answer) of every probe of snapshots (id, raw) that are good."""
    good = snapshots.join(check(snapshots).where("state = 'good'").select("id").distinct(), "id", "left_semi")
    kind = "struct<probes:array<struct<id:string,scoring:struct<answer:string>>>>"
    each = good.select("id", F.explode(F.from_json("raw", kind)["probes"]).alias("p"))
    return each.select("id", F.col("p.id").alias("probe"), F.col("p.scoring.answer").alias("answer"))
