"""Small record builders and checks: authority blocks, declarations, head pins, bound facts, results, command lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.canon import JSON_RECIPE
from plumbline.operators import chain

#: Option and variable names whose values don't belong in a record.
CREDENTIAL = r"(?i)((?:--?|\b)[a-z0-9_-]*(?:token|secret|password|passwd|api[-_]?key)[= ])(\S+)"
ACCESS_URL, ACCESS_FILE = r"[a-z][a-z0-9+.-]*://[^\s\"']+", r"(?<![\w/:.])(?:\.{0,2}/)[\w./-]+"


def authority(principal: Column, version: Column, schema: Column) -> Column:
    """JSON of who may do what: the principal, the capability's version, and the first 16 hex digits of the tool schema's hash."""
    digest = F.when(schema.isNotNull(), F.substring(F.sha2(schema, 256), 1, 16))
    return F.to_json(F.struct(principal.alias("principal"), version.alias("version"), digest.alias("schema")), {"ignoreNullFields": "true"})


def call_digest(name: Column, arguments: Column) -> Column:
    """Digest of a call: its name and its arguments (JSON text without blanks), in one canonical object."""
    body = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"name":'), F.to_json(F.struct(name.alias("n"))).substr(6, 1 << 20))
    return F.concat(F.lit(JSON_RECIPE), F.sha2(body, 256))


def declare(lines: DataFrame, why: str) -> DataFrame:
    """Rows that excuse lines (ledger_id, line, raw), each pinned to the bytes that it has now."""
    return lines.select("ledger_id", F.col("line").alias("orphan_line"), F.sha2("raw", 256).alias("raw_sha256"), F.lit(why).alias("why"))


def head_pins(rows: DataFrame) -> DataFrame:
    """(namespace, rows, chain): the heads of ledgers that verify whole; empty and broken ones get no pin."""
    good = chain.verify(rows).where("ok").select("ledger_id")
    return chain.heads(rows).join(good, "ledger_id").where("rows > 0").select(F.col("ledger_id").alias("namespace"), "rows", F.col("head").alias("chain"))


def bind(facts: DataFrame) -> DataFrame:
    """(name, digest, size) of facts (name, value) that can be fetched again."""
    return facts.select("name", F.sha2(F.col("value").cast("binary"), 256).alias("digest"), F.octet_length("value").alias("size"))


def recheck(bound: DataFrame, now: DataFrame) -> DataFrame:
    """(name, finding) of bound facts against what they are now: same, changed, or could_not_look where they are gone."""
    met = bound.join(bind(now).withColumnsRenamed({"digest": "now", "size": "now_size"}), "name", "left")
    return met.select("name", F.when(F.col("now").isNull(), "could_not_look").when(F.col("now") == F.col("digest"), "same").otherwise("changed").alias("finding"))


def item_count(result: Column) -> Column:
    """Items of a tool's result: of a JSON list, or of the list under `items` or `results`; null where it is none."""
    return F.coalesce(F.json_array_length(result), F.json_array_length(F.get_json_object(result, "$.items")), F.json_array_length(F.get_json_object(result, "$.results")))


def without_credentials(command: Column) -> Column:
    return F.regexp_replace(command, CREDENTIAL, "$1***")


def accessed(rows: DataFrame) -> DataFrame:
    """(id, kind, name) of the URLs and files that the arguments (JSON text) of calls (id, arguments) name, each once."""
    urls = rows.select("id", F.lit("url").alias("kind"), F.explode(F.regexp_extract_all("arguments", F.lit(ACCESS_URL), 0)).alias("name"))
    files = rows.select("id", F.lit("file").alias("kind"), F.explode(F.regexp_extract_all(F.regexp_replace("arguments", ACCESS_URL, ""), F.lit(ACCESS_FILE), 0)).alias("name"))
    return urls.unionAll(files).distinct()
