"""Dataset builds: fingerprints, the staleness states and incremental rebuilds of Parquet artifacts."""

from __future__ import annotations

import hashlib
import json
import time
from collections import defaultdict
from enum import Enum

from pyspark.sql import DataFrame, SparkSession

from ..functions.features import engineer
from ..functions.text import build_text
from ..operators.capability import report
from ..operators.embedding import Provider, embed
from ..operators.quality import validate
from ..operators.schema import map_schema
from ..operators.search import Index, build_index
from ..sources.catalogue import CSV_NAMES, checked_json, read_csv, with_row_id
from ..sources.files import Files
from .fingerprints import file_hash

ARTIFACTS = ("items", "embeddings")
FACTS = ("version", "csv_hash", "config_hash", "artifact_hash", "rows")
VERSION = "1.0.0"


class State(Enum):
    MISSING = "missing"
    CORRUPT = "corrupt"
    STALE = "stale"
    STALE_EMBEDDINGS = "stale embeddings"
    COMPLETE = "complete"


class BuildError(RuntimeError):
    """A build step that failed, by name."""


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


class DatasetManager:
    """Builds and loads the datasets below a root folder; a dataset is a folder with a CSV and its artifacts."""

    def __init__(self, spark: SparkSession, root: str, config: dict | None = None, provider: Provider | None = None, text: str = "search_text"):
        self.spark, self.root, self.text, self.provider = spark, root, text, provider
        self.config = config or {"provider": "hash", "text": text, "index": "flat_ip"}
        self.files = Files(spark)
        self.counts: dict[str, float] = defaultdict(float)

    def folder(self, name: str, version: str | None = None) -> str:
        """``root/name/version`` if it is there, else ``root/name``."""
        base = f"{self.root}/{name}"
        folder = f"{base}/{version}" if version and self.files.is_dir(f"{base}/{version}") else base
        if not self.files.is_dir(folder):
            raise FileNotFoundError(f"no dataset {name!r} below {self.root}")
        return folder

    def _paths(self, name: str, version: str | None) -> tuple[str, str]:
        folder = self.folder(name, version)
        for csv in CSV_NAMES:
            if self.files.is_file(f"{folder}/{csv}"):
                return f"{folder}/{csv}", f"{folder}/artifacts"
        raise FileNotFoundError(f"none of {', '.join(CSV_NAMES)} in {folder}")

    def _facts(self, out: str) -> dict:
        return checked_json(self.files.read(f"{out}/facts.json"), f"{out}/facts.json", FACTS)

    def _artifact_hash(self, out: str) -> str:
        return hashlib.sha256("".join(file_hash(self.spark, f"{out}/{a}") for a in ARTIFACTS).encode()).hexdigest()

    def inspect(self, name: str, version: str | None = None) -> State:
        """Checked in this order: facts there, facts readable, CSV unchanged, embeddings there and of this configuration, artifacts whole."""
        csv, out = self._paths(name, version)
        if not self.files.is_file(f"{out}/facts.json"):
            return State.MISSING
        try:
            facts = self._facts(out)
        except ValueError:
            return State.CORRUPT
        if facts["csv_hash"] != file_hash(self.spark, csv):
            return State.STALE
        if facts["config_hash"] != config_hash(self.config) or not self.files.is_dir(f"{out}/embeddings"):
            return State.STALE_EMBEDDINGS
        try:
            whole = facts["artifact_hash"] == self._artifact_hash(out)
        except Exception:  # noqa: BLE001 - unreadable is corrupt
            whole = False
        return State.COMPLETE if whole else State.CORRUPT

    def build(self, name: str, version: str | None = None) -> None:
        """CSV to items with canonical columns, features and texts, then embeddings. A table that isn't valid aborts."""
        csv, out = self._paths(name, version)
        mapped, _ = self._step("schema", lambda: map_schema(read_csv(self.spark, csv)))
        keyed = with_row_id(mapped)
        checked = self._step("validation", lambda: validate(keyed))
        if not checked.is_valid:
            raise BuildError("validation: " + checked.report())
        featured, _ = self._step("features", lambda: engineer(keyed))
        items, _ = self._step("text", lambda: build_text(featured))
        self._step("items", lambda: items.write.mode("overwrite").parquet(f"{out}/items"))
        self._embed(csv, out)

    def _step(self, what: str, run):
        began = time.time()
        try:
            return run()
        except Exception as e:
            self.counts["failures"] += 1
            raise BuildError(f"{what}: {e}") from e
        finally:
            self.counts[f"seconds of {what}"] += time.time() - began

    def _known(self, out: str) -> DataFrame | None:
        """Embeddings of this configuration by the hash of their texts: they needn't be made again."""
        try:
            if self._facts(out)["config_hash"] != config_hash(self.config) or not self.files.is_dir(f"{out}/embeddings"):
                return None
            held = self.spark.read.parquet(f"{out}/embeddings")
        except Exception:  # noqa: BLE001 - unreadable: all are made anew
            return None
        return held.where("is_success").select("text_hash", "embedding").dropDuplicates(["text_hash"]) if "is_success" in held.columns else None

    def _embed(self, csv: str, out: str, csv_hash: str | None = None) -> None:
        """Embeds the texts of the items that the stored embeddings don't have, beside the stored ones, which are then replaced."""
        table = self.spark.read.parquet(f"{out}/items")
        known, next_ = self._known(out), f"{out}/embeddings-next"
        vectors = embed(table.select("row_id", self.text), self.text, self.provider, known).select("row_id", "embedding", "text_hash", "is_success")
        self._step("embeddings", lambda: vectors.write.mode("overwrite").parquet(next_))
        self.files.delete(f"{out}/embeddings")
        self.files.move(next_, f"{out}/embeddings")
        facts = {"version": VERSION, "csv_hash": csv_hash or file_hash(self.spark, csv), "config_hash": config_hash(self.config), "artifact_hash": self._artifact_hash(out), "rows": table.count(), "built": time.time()}
        self.files.write(f"{out}/facts.json", json.dumps(facts, indent=2, sort_keys=True))
        self.counts["builds"] += 1

    def rebuild_embeddings(self, name: str, version: str | None = None) -> None:
        """New embeddings of the stored items; the CSV's fingerprint is kept, so a later edit is still noticed."""
        csv, out = self._paths(name, version)
        self._embed(csv, out, self._facts(out)["csv_hash"])

    def load(self, name: str, version: str | None = None) -> tuple[DataFrame, Index]:
        """Items and index, after whatever rebuild the state asks for."""
        state = self.inspect(name, version)
        if state == State.STALE_EMBEDDINGS:
            self.rebuild_embeddings(name, version)
        elif state != State.COMPLETE:
            self.build(name, version)
        self.counts["loads"] += 1
        return self.reload(name, version)

    def reload(self, name: str, version: str | None = None) -> tuple[DataFrame, Index]:
        """Items and index as they are stored, whatever their state."""
        _, out = self._paths(name, version)
        items, vectors = (self.spark.read.parquet(f"{out}/{a}") for a in ARTIFACTS)
        return items, build_index(vectors, self.config["index"])

    def names(self) -> list[str]:
        """The datasets below the root."""
        return [n for n in self.files.names(self.root) if any(self.files.is_file(f"{self.root}/{n}/{csv}") for csv in CSV_NAMES)]

    def rebuild_all(self) -> dict[str, str]:
        """Every dataset built anew: its state then, or what failed. One that fails doesn't stop the others."""
        told = {}
        for name in self.names():
            try:
                self.build(name)
                told[name] = self.inspect(name).value
            except BuildError as e:
                told[name] = str(e)
        return told

    def health(self) -> dict:
        """The state of every dataset, and whether all can be used as they are."""
        states = {name: self.inspect(name).value for name in self.names()}
        return {"datasets": states, "healthy": all(s == State.COMPLETE.value for s in states.values())}

    def statistics(self) -> dict[str, float]:
        """Builds, loads, failures, and the seconds that each kind of step took, since this manager began."""
        return dict(self.counts)

    def rebuild_index(self, name: str, version: str | None = None) -> Index:
        _, out = self._paths(name, version)
        return build_index(self.spark.read.parquet(f"{out}/embeddings"), self.config["index"])

    def status(self, name: str, version: str | None = None) -> dict:
        csv, out = self._paths(name, version)
        facts = json.loads(self.files.read(f"{out}/facts.json")) if self.files.is_file(f"{out}/facts.json") else {}
        major = str(facts.get("version", VERSION)).split(".")[:2] == VERSION.split(".")[:2]
        return {"state": self.inspect(name, version).value, "csv": csv, "facts": facts, "warnings": [] if major else ["built by another version"]}

    def capabilities(self, name: str, version: str | None = None) -> dict:
        _, out = self._paths(name, version)
        return report(self.spark.read.parquet(f"{out}/items"))
