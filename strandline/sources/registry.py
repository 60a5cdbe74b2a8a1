"""A registry of unique names: projects, kinds, commits, reverts and lists, kept as a log of versions.

Every change is one small file of the log, named by its version and created only if no other
writer has created it; a writer that comes second reads the log again and numbers its names anew.
So two allocations at a time can't give one name.  Names themselves are tables beside the log, which
an entry of the log points to; what no entry points to doesn't count.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import maps

# The letters of a name that tell the kind.
KIND_CODES = {"EST": "ES", "SO:0000345": "ES", "transcribed_cluster": "TC", "library": "lc", "sa": "sa"}
#: Letters and digits of a number's code.
WIDTH = 6
_LOG = "version long, action string, project string, code string, kind string, last long, description string, date string, names string"


def code_of(number: Column, width: int = WIDTH) -> Column:
    """A number's code: digits; where they don't suffice, one letter and digits, two letters and digits, and so on."""
    out, before = F.lit(None).cast("string"), 0
    steps = []
    for k in range(width):
        size = 26**k * 10 ** (width - k)
        steps.append((before, before + size, k))
        before += size
    for low, high, k in reversed(steps):
        n = number - low
        head = F.floor(n / 10 ** (width - k)).cast("long")
        letters = F.concat(*[F.char(F.lit(65) + F.floor(head / 26 ** (k - 1 - j)).cast("long") % 26) for j in range(k)]) if k else F.lit("")
        text = F.concat(letters, F.lpad((n % 10 ** (width - k)).cast("string"), width - k, "0"))
        out = F.when((number >= low) & (number < high), text).otherwise(out)
    return out


class Conflict(Exception):
    """Another writer was first."""


class NamingRegistry:
    """Names under ``path``, a folder that driver and executors share."""

    #: Tries before a writer that always comes second gives up.
    TRIES = 20

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("log").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("log"))

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def entries(self) -> list[dict]:
        """The log in order of versions; one entry a change, so it is small."""
        if not self._fs.listStatus(self._at("log")):
            return []
        return [r.asDict() for r in self.spark.read.schema(_LOG).json(f"{self.path}/log/*.json").orderBy("version").collect()]

    def _append(self, version: int, **entry) -> None:
        entry |= {"version": version, "date": datetime.now(timezone.utc).isoformat()}
        data = bytearray(json.dumps(entry).encode())
        target = self._at(f"log/{version:08d}.json")
        local = self._fs.getUri().getScheme() == "file"
        # A local file is written aside and linked, which fails if the name is taken; other stores create it so themselves.
        aside = self._at(f"log/.{uuid.uuid4().hex}") if local else target
        try:
            stream = self._fs.create(aside, False)
            stream.write(data)
            stream.close()
            if local:
                nio = self._jvm.java.nio.file
                paths = [self._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, aside)]
                nio.Files.createLink(*paths)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict from e
            raise
        finally:
            if local:
                self._fs.delete(aside, False)

    def _changed(self, change) -> dict:
        """``change(entries)`` gives an entry; it is worked out again while others come first."""
        for _ in range(self.TRIES):
            log = self.entries()
            entry = change(log)
            try:
                self._append(len(log) + 1, **entry)
                return entry
            except Conflict:
                continue
        raise Conflict(f"{self.TRIES} other writers came first")

    @staticmethod
    def _live(log: list[dict], project: str | None = None, kind: str | None = None) -> list[dict]:
        """Commits that no revert has taken back, oldest first."""
        held: list[dict] = []
        for e in log:
            if e["action"] == "commit":
                held.append(e)
            elif e["action"] == "revert":
                gone = next((x for x in reversed(held) if x["project"] == e["project"] and x["kind"] == e["kind"]), None)
                held = [x for x in held if x is not gone]
        return [e for e in held if project in (None, e["project"]) and kind in (None, e["kind"])]

    def add_project(self, name: str, code: str, description: str | None = None) -> None:
        def change(log):
            if any(e["action"] == "project" and e["project"] == name for e in log):
                raise ValueError(f"there is a project {name} already")
            return {"action": "project", "project": name, "code": code, "description": description}

        self._changed(change)

    def projects(self) -> dict[str, str]:
        return {e["project"]: e["code"] for e in self.entries() if e["action"] == "project"}

    def _tables(self, commits: list[dict]) -> DataFrame:
        paths = [f"{self.path}/names/{e['names']}" for e in commits if e["names"]]
        shape = "name string, number long, unique_name string"
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def allocate(self, items: DataFrame, project: str, kind: str, key: str = "name", description: str | None = None) -> DataFrame:
        """(``key``, unique_name) of every distinct key: names that were given stay, new keys are numbered on in their order, and committed."""
        items = items.select(F.col(key).cast("string").alias("name")).where(F.col("name").isNotNull()).distinct()

        def change(log):
            code = next((e["code"] for e in log if e["action"] == "project" and e["project"] == project), None)
            if code is None:
                raise ValueError(f"there is no project {project}")
            held = self._live(log, project, kind)
            last = held[-1]["last"] if held else 0
            new = items.join(self._tables(held), "name", "left_anti")
            table = uuid.uuid4().hex
            numbered = maps.ranked(new, "name", "_r").select("name", (F.col("_r") + last).cast("long").alias("number"))
            numbered = numbered.withColumn("unique_name", F.concat(F.lit(code + KIND_CODES[kind]), code_of(F.col("number"))))
            numbered.write.parquet(f"{self.path}/names/{table}")
            got = self.spark.read.parquet(f"{self.path}/names/{table}").agg(F.max("number")).first()[0]
            return {"action": "commit", "project": project, "code": code, "kind": kind, "last": got or last, "description": description, "names": table}

        if kind not in KIND_CODES:
            raise ValueError(f"no code for the kind {kind}")
        self._changed(change)
        every = self._tables(self._live(self.entries(), project, kind))
        return items.join(every, "name").select(F.col("name").alias(key), "unique_name")

    def revert(self, project: str, kind: str) -> None:
        """Take the last commit of a project and kind back; its numbers are given anew."""

        def change(log):
            if not self._live(log, project, kind):
                raise ValueError(f"nothing to revert for {project} and {kind}")
            return {"action": "revert", "project": project, "kind": kind}

        self._changed(change)

    def commits(self, project: str | None = None, kind: str | None = None) -> list[dict]:
        """Commits that stand, oldest first: project, project_code, kind, the last name given, description and date."""
        held = self._live(self.entries(), project, kind)
        last = self.spark.createDataFrame([(k, e["last"]) for k, e in enumerate(held)], "k int, n long").select("k", code_of(F.col("n")).alias("c")).collect()
        codes = {r["k"]: r["c"] for r in last}
        return [{"project": e["project"], "project_code": e["code"], "feature_type": e["kind"], "name": e["code"] + KIND_CODES[e["kind"]] + codes[k], "description": e["description"], "date": e["date"]} for k, e in enumerate(held)]

    def names(self, project: str, kind: str) -> DataFrame:
        """name, number, unique_name of all commits that stand."""
        return self._tables(self._live(self.entries(), project, kind))
