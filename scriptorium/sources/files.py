"""Files, JSON lines, versions and fallback chains."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_texts(spark: SparkSession, path: str, pattern: str = "*.tex") -> DataFrame:
    """Whole files: path, text."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_texts(df: DataFrame, path: str, text_col: str = "text") -> None:
    """One line or more per row."""
    df.select(F.col(text_col).alias("value")).write.mode("overwrite").text(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str, tolerant: bool = False) -> DataFrame:
    """An explicit schema; a bad line fails the read, or is dropped when ``tolerant``. Blank lines go."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """S3, S8, S26"""
    df.write.mode("append" if append else "overwrite").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """S9, by the file system of the path."""
    p, system = hadoop(spark, path)
    return system.exists(p)


def make_folder(spark: SparkSession, path: str) -> None:
    """S9"""
    p, system = hadoop(spark, path)
    system.mkdirs(p)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """A file or a folder, also from one file system to another."""
    (a, one), (b, other) = hadoop(spark, source), hadoop(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(one, a, other, b, False, spark.sparkContext._jsc.hadoopConfiguration())


def hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str, ending: str) -> list[str]:
    """Names, without ending, of a folder's rule files in their order."""
    p, system = hadoop(spark, folder)
    return sorted(f.getPath().getName().removesuffix(ending) for f in system.listStatus(p) if f.getPath().getName().endswith(ending)) if system.exists(p) else []


def snapshot(df: DataFrame, path: str, version: str, key: str) -> DataFrame:
    """Writes a version, appends a row to the manifest and gives it: rows, keys, a fingerprint, and its place in the manifest.

    The fingerprint is a sum of row hashes: it doesn't depend on the rows' order, and equal rows don't cancel out.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    rows = spark.read.parquet(f"{path}/version={version}")
    content = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)]).cast("decimal(20,0)")
    place = spark.read.json(f"{path}/_manifest").agg(F.max("place")).first()[0] if exists(spark, f"{path}/_manifest") else 0
    found = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"), F.coalesce(F.sum(content), F.lit(0)).cast("string").alias("fingerprint")).withColumn("version", F.lit(version)).withColumn("place", F.lit(place + 1))
    found.write.mode("append").json(f"{path}/_manifest")
    return found


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version that the manifest names last, whatever its name."""
    last = spark.read.json(f"{path}/_manifest").agg(F.max_by("version", "place")).first()[0]
    return spark.read.parquet(f"{path}/version={last}")


def file_kind(reference: Column, content_type: Column) -> Column:
    """By extension, then by content type."""
    low = F.lower(reference)
    out = F.when(low.rlike(r"\.pdf([?#]|$)"), "pdf").when(low.rlike(r"\.docx([?#]|$)"), "docx").when(low.rlike(r"\.html?([?#]|$)"), "html").when(low.rlike(r"\.(txt|md|tex)([?#]|$)"), "text")
    for part in ("pdf", "wordprocessingml", "html"):
        out = out.when(F.contains(F.lower(content_type), F.lit(part)), "docx" if part == "wordprocessingml" else part)
    return out.otherwise("text")


def docx_text(data: bytes) -> str | None:
    """The paragraphs of a DOCX file; null if it isn't one."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    name = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join(t.text or "" for t in p.iter(f"{name}t")) for p in root.iter(f"{name}p"))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Path, text of each file."""

    @F.pandas_udf("string")
    def text(files: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in files:
            yield part.map(lambda x: docx_text(bytes(x)))

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", text("content").alias("text"))


def upload_errors(files: DataFrame, most_bytes: int = 10 << 20) -> DataFrame:
    """Of binaryFile rows: size, extension and leading bytes."""
    head = F.hex(F.substring("content", 1, 4))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    wanted = F.when(ext == "pdf", head == "25504446").when(ext == "docx", head == "504B0304").otherwise(F.lit(True))
    tests = {"too_large": F.col("length") > most_bytes, "empty": F.col("length") == 0, "unknown_type": ~ext.isin("pdf", "docx", "txt", "md", "tex"), "wrong_content": ~wanted}
    return files.select("path", "length", F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()])).alias("errors"))


def first_text(sources: dict[str, Column], least: int) -> dict[str, Column]:
    """Text and name of the first source with enough text, the status and what was wrong with those before."""
    enough = {k: F.coalesce(F.char_length(c) >= least, F.lit(False)) for k, c in sources.items()}
    text = F.coalesce(*[F.when(enough[k], c) for k, c in sources.items()])
    kind = F.coalesce(*[F.when(enough[k], F.lit(k)) for k in sources])
    errors = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(f"{k}:missing")).when(~enough[k], F.lit(f"{k}:too_short")) for k, c in sources.items()]))
    return {"text": text, "source_kind": kind, "status": F.when(text.isNull(), "failed").otherwise("ok"), "errors": errors}


def rules(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A rule table from a CSV or JSON-lines file."""
    json_lines = path.endswith((".jsonl", ".json"))
    rows = spark.read.json(path) if json_lines else spark.read.csv(path, header=True, inferSchema=True)
    return rows.select(*columns)


def environment_layer(prefix: str, environment: dict[str, str]) -> dict:
    """A configuration layer from variables like PREFIX_SCORING__LEAST=5: two underscores go one level down, names are lower case."""
    out: dict = {}
    for name, value in sorted(environment.items()):
        if name.startswith(f"{prefix}_"):
            *above, last = name[len(prefix) + 1 :].lower().split("__")
            inner = out
            for part in above:
                inner = inner.setdefault(part, {})
            inner[last] = config_value(value)
    return out


def merged_config(*layers: dict) -> dict:
    """Later layers win, nested ones key by key."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def config_value(text: str) -> bool | int | float | str:
    """Of an environment variable: boolean, whole number, number, or text."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def docx_bytes(text: str) -> bytes:
    """A DOCX file with a paragraph per line."""
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    root = ElementTree.Element(f"{{{space}}}document")
    body = ElementTree.SubElement(root, f"{{{space}}}body")
    for line in text.split("\n"):
        run = ElementTree.SubElement(ElementTree.SubElement(body, f"{{{space}}}p"), f"{{{space}}}r")
        ElementTree.SubElement(run, f"{{{space}}}t").text = line
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("word/document.xml"), ElementTree.tostring(root, encoding="utf-8", xml_declaration=True))
    return out.getvalue()


def to_docx(text: Column) -> Column:
    """A DOCX file of each text, as binary."""

    @F.pandas_udf("binary")
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else docx_bytes(t))

    return made(text)


def from_docx(content: Column) -> Column:
    """The text of a DOCX file; null if it isn't one."""

    @F.pandas_udf("string")
    def text(files: pd.Series) -> pd.Series:
        return files.map(lambda x: None if x is None else docx_text(bytes(x)))

    return text(content)


def to_markdown(title: Column, text: Column, facts: dict[str, Column]) -> Column:
    """A Markdown page: a heading, a list of facts, the text."""
    lines = [F.concat(F.lit(f"- {k}: "), F.coalesce(c.cast("string"), F.lit("-"))) for k, c in facts.items()]
    return F.concat(F.lit("# "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.concat_ws("\n", *lines), F.lit("\n\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def mock_corpus(spark: SparkSession, n: int, words: tuple[str, ...], seed: int, length: int = 40) -> DataFrame:
    """N documents of some of the words, the same for the same seed: doc_id, text."""
    pick = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.get(F.array(*map(F.lit, words)), F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(len(words))).cast("int")))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.array_join(pick, " "), F.lit(".")).alias("text"))
