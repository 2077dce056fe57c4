"""What the code graph consists of, shapes of responses, and the pace of calls."""

from __future__ import annotations

import random
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Node types in the order in which they are extracted, with their fields.
NODE_TYPES = {
    "Repository": "repoName url created_at branch commit description", "Directory": "name path", "Module": "name paths description",
    "File": "fileName filePath fileType subtype size complexityScore", "BusinessConcept": "conceptName conceptType description originSource",
    "Technology": "techName techCategory description version originSource", "TypeDefinition": "typeName category filePath description interfaceType startLine endLine codeSnippet",
    "Method": "methodName returnType visibility filePath typeName description parameters isStatic isAsync startLine endLine",
    "Test": "testName testType filePath description testedElement framework startLine endLine", "Service": "serviceName description exposureLevel filePath",
    "ExternalDependency": "dependencyName dependencyCategory version ecosystem description originSource",
}
# Kinds of edges.
EDGE_TYPES = ("CONTAINS", "DEPENDS_ON", "REFERENCES", "IMPLEMENTS", "DECLARES", "PROVIDES", "EXPOSES", "USES", "TESTS")
#: Fields that every node has besides.
COMMON = ("confidence", "extractionMethod")


def node_types(spark: SparkSession) -> DataFrame:
    """node_type, place (order of extraction, from 1), property."""
    rows = [(n, i, p) for i, (n, fields) in enumerate(NODE_TYPES.items(), 1) for p in (*fields.split(), *COMMON)]
    return spark.createDataFrame(rows, "node_type string, place int, property string")


def edge_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in sorted(EDGE_TYPES)], "relationship_type string")


def object_shape(name: str, properties: dict[str, dict], required: list[str], more: bool = False) -> dict:
    """JSON Schema of a response that is one object."""
    return {"name": name, "strict": True, "schema": {"type": "object", "properties": properties, "required": required, "additionalProperties": more}}


def array_shape(name: str, key: str, properties: dict[str, dict], required: list[str], more: bool = True) -> dict:
    """JSON Schema of a response that holds one list of objects under a key."""
    item = object_shape("", properties, required, more)["schema"]
    return object_shape(name, {key: {"type": "array", "items": item}}, [key])


def stored_facts(responses: DataFrame, content: str = "content") -> DataFrame:
    """One row, entries, bytes, mb (two places) of stored responses."""
    size = F.coalesce(F.sum(F.octet_length(content)), F.lit(0))
    return responses.agg(F.count(F.lit(1)).alias("entries"), size.alias("bytes"), F.round(size / 1048576.0, 2).alias("mb"))


class Pace:
    """Keeps calls to a service under so many a minute and so far apart; after refusals
    the wait doubles up to a limit, with some chance in it.  Used on the driver only."""

    def __init__(self, per_minute: int = 60, apart: float = 0.0, base: float = 2.0, longest: float = 60.0, jitter: float = 0.1, clock=time.time, sleep=time.sleep):
        self.per_minute, self.apart, self.base, self.longest, self.jitter = per_minute, apart, base, longest, jitter
        self.clock, self.sleep, self.lock = clock, sleep, threading.Lock()
        self.calls: list[float] = []
        self.refused = 0

    def wait(self) -> float:
        """Waits until the next call may be made, notes it, and says how long it took."""
        with self.lock:
            now = self.clock()
            self.calls = [t for t in self.calls if t > now - 60.0] or self.calls[-1:]
            recent = [t for t in self.calls if t > now - 60.0]
            free = [now]
            if self.apart > 0 and self.calls:
                free.append(self.calls[-1] + self.apart)
            if 0 < self.per_minute <= len(recent):
                free.append(recent[-self.per_minute] + 60.0)
            at = max(free)
            self.calls.append(at)
        if at > now:
            self.sleep(at - now)
        return at - now

    def accepted(self) -> None:
        self.refused = 0

    def rejected(self) -> float:
        """How long to wait before trying again."""
        self.refused += 1
        delay = min(self.base**self.refused, self.longest)
        return delay * (1 + self.jitter * random.random())
