"""Files of a repository folder as rows, and files that hold rows."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decoded(content: Column) -> Column:
    """Text of the bytes by their byte order mark, else UTF-8, else Latin-1."""
    head = F.hex(F.substring(content, 1, 3))
    rest = lambda n: F.substring(content, n, 2**31 - 1)
    return (
        F.when(head.startswith("FFFE"), F.decode(rest(3), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(rest(3), "UTF-16BE"))
        .when(head == "EFBBBF", F.decode(rest(4), "UTF-8"))
        .when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8"))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )


def scanned(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """path (below the folder), size_bytes, content of all files but those in .git or
    __pycache__ and compiled Python.  Not ``strict``: whatever holds .git or __pycache__
    anywhere in its path is left out, .gitignore and .github included."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    inner = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + folder.rstrip("/") + "/", "")
    rows = rows.select(inner.alias("path"), F.col("length").alias("size_bytes"), "content")
    left_out = F.col("path").rlike(r"(^|/)(\.git|__pycache__)/") if strict else F.col("path").contains(".git") | F.col("path").contains("__pycache__")
    return rows.where(~left_out & ~F.col("path").endswith(".pyc"))


#: Names of the files that describe a repository, the first that is there.  Fixed values.
DESCRIPTIONS = ("README.md", "README.txt", "README.rst", "README")


def repository_descriptions(texts: DataFrame) -> DataFrame:
    """repository_name, description from rows repository_name, path, content: of the first
    five lines of the first description file at the root that says something, those that
    are neither blank nor headings, joined, 500 characters at most."""
    lines = F.transform(F.slice(F.split("content", r"\r\n|\n|\r"), 1, 5), F.trim)
    said = F.substring(F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")), " "), 1, 500)
    place = F.array_position(F.array(*map(F.lit, DESCRIPTIONS)), F.col("path"))
    some = texts.select("repository_name", place.alias("place"), said.alias("said")).where("place > 0 and said <> ''")
    return some.groupBy("repository_name").agg(F.min_by("said", "place").alias("description"))


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file that holds one JSON array; none if there is no such file."""
    try:
        return spark.read.option("multiLine", True).schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def imported(base: DataFrame, rows: DataFrame, delete_first: bool = False) -> DataFrame:
    """The table with imported rows behind its own, or in place of them."""
    return rows if delete_first else base.unionByName(rows, allowMissingColumns=True)


def seeded(base: DataFrame, rows: DataFrame, force: bool = False) -> DataFrame:
    """The table as it is, or the seed rows where it is empty (or ``force``)."""
    return rows if force or base.isEmpty() else base


def write_rows(df: DataFrame, path: str, *order: str) -> None:
    """Rows as JSON lines in one file, in order: for small tables such as settings."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").json(path)


def model_parts(elements: DataFrame, relationships: DataFrame) -> DataFrame:
    """part, identifier, xml of each element and relationship of an exchange document."""
    quoted = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    q = lambda c: quoted(F.col(c))
    doc = F.when(F.col("documentation").isNull() | (F.col("documentation") == ""), "").otherwise(F.concat(F.lit('<documentation xml:lang="en">'), q("documentation"), F.lit("</documentation>")))
    e = F.concat(F.lit('<element identifier="'), q("identifier"), F.lit('" xsi:type="'), q("element_type"), F.lit('"><name xml:lang="en">'), q("name"), F.lit("</name>"), doc, F.lit("</element>"))
    r = F.concat(F.lit('<relationship identifier="'), q("identifier"), F.lit('" source="'), q("source_id"), F.lit('" target="'), q("target_id"), F.lit('" xsi:type="'), q("relationship_type"), F.lit('"/>'))
    return elements.select(F.lit("element").alias("part"), "identifier", e.alias("xml")).unionByName(relationships.select(F.lit("relationship").alias("part"), "identifier", r.alias("xml")))


def model_lines(parts: DataFrame, name: str, identifier: str = "model-001") -> DataFrame:
    """place, identifier, line: the lines of the exchange document, in the order of place
    and identifier.  A section without parts is left out."""
    spark = parts.sparkSession
    ns = 'xmlns="http://www.opengroup.org/xsd/archimate/3.0/" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://www.opengroup.org/xsd/archimate/3.0/ http://www.opengroup.org/xsd/archimate/3.1/archimate3_Diagram.xsd"'
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<model {ns} identifier="{escape(identifier, {chr(34): "&quot;"})}"><name xml:lang="en">{escape(name)}</name>'
    fixed = spark.createDataFrame([(0, "", head), (9, "", "</model>")], "place int, identifier string, line string")
    own = parts.select(F.when(F.col("part") == "element", 2).otherwise(5).alias("place"), "identifier", F.col("xml").alias("line"))
    # a section's begin and end stand beside its first and last place, if it has parts
    there = parts.select("part").distinct()
    at = F.when(F.col("part") == "element", 1).otherwise(4)
    section = F.concat("part", F.lit("s"))
    begin = there.select(at.alias("place"), F.lit("").alias("identifier"), F.concat(F.lit("<"), section, F.lit(">")).alias("line"))
    end = there.select((at + 2).alias("place"), F.lit("").alias("identifier"), F.concat(F.lit("</"), section, F.lit(">")).alias("line"))
    return fixed.unionByName(begin).unionByName(own).unionByName(end)


def write_model(parts: DataFrame, name: str, path: str) -> None:
    """The exchange document as one text file: its parts are sorted in parallel and
    streamed through one task, so no process holds the model."""
    model_lines(parts, name).orderBy("place", "identifier").select("line").coalesce(1).write.mode("overwrite").text(path)


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A report of a small table; more than ``most`` rows are an error, not left out."""
    head = rows.columns
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{title}: more than {most} rows are no report")
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(str(v) for v in r) + " |" for r in found])


def replace_session(df: DataFrame, path: str) -> None:
    """Writes metrics partitioned by session; only the sessions in the rows are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)
