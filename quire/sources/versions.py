"""Tables in versions: folders that never change, and manifests that say which of them are the table.

A table's rows belong to owners (a document's chunks, a chunk's embedding). A change names
owners and gives all the rows that they have from then on; named without rows, an owner is
deleted. A change is written into a folder of its own and becomes a version when its manifest
appears, which happens once or not at all: what failed on its way is never read, versions
before stay readable, and of two writers of one version the later is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..scratch import drop_folder, list_names, read_text, write_once


class VersionedTable:
    """The table at path, whose rows belong to owners by the column owner.

    Manifests are small: a base and the changes since, each by folder. Reading takes the
    newest change of each owner; compact writes that as the next base, so that a read joins
    only what has changed since. A null owner is an owner like others.
    """

    def __init__(self, spark: SparkSession, path: str, owner: str):
        self.spark, self.path, self.owner = spark, path.rstrip("/"), owner

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in list_names(self.spark, f"{self.path}/versions") if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the newest; of a table without any, an empty one."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "schema": None, "folders": []}
        if version is not None and version not in known:
            raise ValueError(f"{self.path} has no version {version}")
        return json.loads(read_text(self.spark, f"{self.path}/versions/{known[-1] if version is None else version:012d}.json"))

    def _publish(self, was: dict, schema: str, folders: list[dict]) -> int:
        number = was["version"] + 1
        if not write_once(self.spark, f"{self.path}/versions/{number:012d}.json", json.dumps({"version": number, "schema": schema, "folders": folders})):
            raise RuntimeError(f"{self.path}: another writer made version {number} first")
        return number

    def _stage(self, rows: DataFrame, owners: DataFrame | None = None, base: bool = False) -> dict:
        """Writes rows, and the owners of a change (by default those of the rows written), into a new folder."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}/rows")
        if not base:
            named = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}/rows") if owners is None else owners
            named.select(self.owner).distinct().write.parquet(f"{self.path}/{folder}/owners")
        return {"folder": folder, "base": base}

    def replace_all(self, rows: DataFrame) -> int:
        """A version that has these rows and no others."""
        was = self.manifest()
        return self._publish(was, rows.schema.json(), [self._stage(rows, base=True)])

    def change(self, rows: DataFrame, owners: DataFrame | None = None) -> int:
        """A version in which owners (by default those of rows) have these rows instead of what they had.

        Owners that are named and have no rows here are deleted; rows of owners that aren't
        named are refused, for they would join what is there without notice.
        """
        was = self.manifest()
        if was["schema"] and [(f["name"], f["type"]) for f in json.loads(was["schema"])["fields"]] != [(f["name"], f["type"]) for f in json.loads(rows.schema.json())["fields"]]:
            raise ValueError("the rows' columns are not the table's")
        staged = self._stage(rows, owners)
        if owners is not None:
            at = f"{self.path}/{staged['folder']}"
            left, named = self.spark.read.schema(rows.schema).parquet(f"{at}/rows"), self._owners(f"{at}/owners", rows.schema[self.owner].dataType)
            if not left.join(named, left[self.owner].eqNullSafe(named["__owner"]), "left_anti").isEmpty():
                raise ValueError("some rows belong to owners that the change doesn't name")
        return self._publish(was, was["schema"] or rows.schema.json(), was["folders"] + [staged])

    def _owners(self, path: str, kind) -> DataFrame:
        return self.spark.read.parquet(path).select(F.col(f"`{self.owner}`").cast(kind).alias("__owner"))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        m = self.manifest(version)
        if not m["folders"]:
            raise ValueError(f"{self.path} has no version yet")
        schema = StructType.fromJson(json.loads(m["schema"]))
        rows = [self.spark.read.schema(schema).parquet(f"{self.path}/{f['folder']}/rows") for f in m["folders"]]
        changes = [(i, f) for i, f in enumerate(m["folders"]) if not f["base"]]
        if not changes:
            return rows[0]
        named = None
        for i, f in changes:
            one = self._owners(f"{self.path}/{f['folder']}/owners", schema[self.owner].dataType).withColumn("__at", F.lit(i))
            named = one if named is None else named.unionAll(one)
        newest = named.groupBy("__owner").agg(F.max("__at").alias("__at"))
        changed = None
        for i, _ in changes:
            one = rows[i].withColumn("__of", F.lit(i))
            changed = one if changed is None else changed.unionAll(one)
        same = changed[self.owner].eqNullSafe(newest["__owner"])
        out = changed.join(newest, same & (changed["__of"] == newest["__at"]), "left_semi").drop("__of")
        if m["folders"][0]["base"]:
            base = rows[0]
            out = base.join(newest, base[self.owner].eqNullSafe(newest["__owner"]), "left_anti").unionAll(out)
        return out

    def compact(self) -> int:
        """The next version: the same rows as one base."""
        was = self.manifest()
        return self._publish(was, was["schema"], [self._stage(self.read(was["version"]), base=True)])

    def restore(self, version: int) -> int:
        """The next version: the rows that an earlier one had."""
        old, was = self.manifest(version), self.manifest()
        return self._publish(was, old["schema"], old["folders"])

    def vacuum(self, keep: int = 1) -> None:
        """Drops all but the last versions, with folders that no manifest names; no writer may be at work."""
        known = self.versions()
        for number in known[:-keep]:
            drop_folder(self.spark, f"{self.path}/versions/{number:012d}.json")
        named = {f["folder"] for v in known[-keep:] for f in self.manifest(v)["folders"]}
        for name in list_names(self.spark, f"{self.path}/data"):
            if f"data/{name}" not in named:
                drop_folder(self.spark, f"{self.path}/data/{name}")


def embeddings_of(spark: SparkSession, path: str, model: str, dimension: int, owner: str = "chunk_id") -> VersionedTable:
    """The embeddings of one model at one dimension: a table of its own, so that a switch of model wipes nothing.

    What waits for the model is store.pending of chunks and this table's rows; switching back
    finds what was embedded before.
    """
    name = "".join(ch if ch.isalnum() or ch in "-." else f"%{ord(ch):04x}" for ch in model)
    return VersionedTable(spark, f"{path.rstrip('/')}/{name}/{dimension}", owner)
