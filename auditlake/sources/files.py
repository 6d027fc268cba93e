"""Sources: source trees, guideline documents, packs, hardware configurations and POU XML."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import suffix
from ..operators.corpus import without_ignored
from ..shared import materialize

GUIDELINES = [".md", ".markdown", ".txt", ".rst", ".adoc"]


def _relative(root: str):
    at = F.regexp_replace(F.col("_metadata.file_path"), "%20", " ")
    base = root.split("://", 1)[-1].rstrip("/")
    return F.substring_index(at, base + "/", -1)


def read_repo(spark: SparkSession, path: str, repo: str | None = None, ignored: list[str] | None = None) -> DataFrame:
    """``repo, path, ext, content, size, mtime`` of all text files below a folder, less noise folders."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rel = F.substring_index(F.col("path"), path.split("://", 1)[-1].rstrip("/") + "/", -1)
    files = raw.select(F.lit(repo or path.rstrip("/").rpartition("/")[2]).alias("repo"), rel.alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return without_ignored(files, ignored).select("repo", "path", suffix("path").alias("ext"), "content", "size", "mtime")


def guideline_documents(raw: DataFrame, path: str) -> DataFrame:
    """``source, content`` of whole files read as text below ``path``: guideline documents, hidden paths passed over.

    source is the path below the folder, or below the part of ``path`` before its first wildcard.
    """
    docs = raw.select(_relative(re.split(r"/[^/]*[*?\[{]", path)[0]).alias("source"), F.col("value").alias("content"))
    return docs.filter(suffix("source").isin(GUIDELINES) & ~F.regexp_like("source", F.lit(r"(?:^|/)\.")))


def read_guidelines(spark: SparkSession, path: str, max_files: int = 500) -> DataFrame:
    """``source, content`` of guideline documents, hidden paths passed over, the first ``max_files`` by path."""
    docs = guideline_documents(spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True), path)
    return docs.orderBy("source").limit(max_files)


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """Packs from markdown with front matter; the name defaults to the folder; packs without description are dropped."""
    lists = ["extensions", "imports", "frameworks", "languages", "filename_patterns"]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for source, head, body in zip(frame["source"], frame["head"], frame["body"], strict=True):
                fields: dict = {}
                key = None
                for line in head.split("\n"):
                    text = line.strip()
                    if text.startswith("- ") and key:
                        fields.setdefault(key, [])
                        if isinstance(fields[key], list):
                            fields[key].append(text[2:].strip().strip("'\""))
                    elif ":" in text:
                        key, _, value = text.partition(":")
                        key, value = key.strip(), value.strip()
                        fields[key] = [v.strip().strip("'\"") for v in value[1:-1].split(",") if v.strip()] if value.startswith("[") else value.strip("'\"") if value else []
                parts = source.split("/")
                rows.append({"name": fields.get("name") or (parts[-2] if len(parts) > 1 else parts[-1]), "description": fields.get("description") or "", "body": body} | {k: fields[k] if isinstance(fields.get(k), list) else [fields[k]] if fields.get(k) else [] for k in lists})
            yield pd.DataFrame(rows, columns=["name", "description", *lists, "body"])

    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    front = r"(?s)\A---\s*\n(.*?)\n---\s*\n?(.*)\z"
    cut = raw.select(_relative(path).alias("source"), F.regexp_extract("value", front, 1).alias("head"), F.regexp_extract("value", front, 2).alias("body")).filter("head <> ''")
    schema = "name string, description string, " + ", ".join(f"{k} array<string>" for k in lists) + ", body string"
    return cut.mapInPandas(parse, schema).filter("description <> ''")


def extract_st(xml: DataFrame) -> DataFrame:
    """Adds ``st``: the text of all ST elements of ``content``, whatever their name space; null where XML is broken."""
    return xml.withColumn("st", F.array_join(F.xpath("content", F.lit('//*[local-name()="ST"]//text()')), "\n"))


def xml_elements(xml: DataFrame) -> DataFrame:
    """``path, n, parent, tag, attrs, text`` of all elements of ``content`` in document order, without name spaces; broken XML gives none."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    waiting = [(ElementTree.fromstring(content or ""), -1)]
                except ElementTree.ParseError:
                    continue
                n = 0
                while waiting:
                    e, parent = waiting.pop()
                    rows.append((path, n, parent, e.tag.rpartition("}")[2], dict(e.attrib), (e.text or "").strip()))
                    waiting += [(child, n) for child in reversed(e) if isinstance(child.tag, str)]
                    n += 1
            yield pd.DataFrame(rows, columns=["path", "n", "parent", "tag", "attrs", "text"])

    return xml.select("path", "content").mapInPandas(run, "path string, n int, parent int, tag string, attrs map<string,string>, text string")


#: Elements that describe a controller, modules, networks and safety.
HW_TAGS = {"cpu": ["CPU", "Controller", "PlcDevice", "Device"], "module": ["Module", "IOModule", "DI", "DO", "AI", "AO"], "network": ["NetworkInterface", "PROFINET", "Ethernet", "Interface"], "safety": ["SafetyConfiguration", "FConfiguration"]}
#: Parts of article numbers and of model names that mark safety controllers.
F_ARTICLES, F_MODELS = ["511-1F", "513-1F", "515-2F", "516-3F", "517-3F", "518-4F"], ["F-CPU", "F ", "/F"]


def read_hw_config(xml: DataFrame) -> DataFrame:
    """``path, cpu, io_modules, networks, safety`` from ``content``, for documents that are XML; see HW_TAGS.

    Of several controllers or safety elements the last one counts.
    """
    e = materialize(xml_elements(xml), "hw-elements")
    last = e.groupBy("path", "parent", "tag").agg(F.max_by(F.struct("text", "attrs"), "n").alias("x"))
    kids = last.groupBy("path", F.col("parent").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("tag", "x"))).alias("kids"))
    full = e.join(kids, ["path", "n"], "left").withColumn("kids", F.coalesce("kids", F.create_map().cast("map<string,struct<text:string,attrs:map<string,string>>>")))
    attr = lambda *names: F.coalesce(*[F.try_element_at("attrs", F.lit(x)) for x in names], F.lit(""))
    kid = lambda *names: F.coalesce(*[F.try_element_at("kids", F.lit(x))["text"] for x in names], F.lit(""))
    yes = lambda c: F.lower(c).isin("true", "1", "enabled")
    number = lambda c, default: F.coalesce(c.try_cast("int"), F.lit(default))
    has = lambda c, parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.upper(c), p))
    model, article = attr("Model", "TypeName", "Name"), attr("ArticleNumber", "OrderNumber")
    cpu = F.struct(model.alias("model"), article.alias("article"), attr("FirmwareVersion", "FWVersion").alias("firmware"), number(kid("ProtectionLevel"), 0).alias("protection_level"), number(kid("Watchdog", "CycleWatchdog", "OB1Watchdog"), 0).alias("watchdog_ms"), F.lit(0).alias("memory_kb"), yes(kid("WebServer")).alias("web_enabled"), number(F.try_element_at("kids", F.lit("WebServer"))["attrs"]["Port"], 80).alias("web_port"), (has(model, F_MODELS) | has(article, F_ARTICLES)).alias("is_safety"))
    name = attr("Name", "TypeName")
    module = F.struct("n", name.alias("name"), has(name, ["F-", "FAILSAFE", "SAFETY"]).alias("is_safety"), has(name, ["RED"]).alias("redundant"))
    network = F.struct("n", attr("Protocol", "Type").alias("protocol"), attr("Name").alias("name"), yes(kid("PortSecurity")).alias("port_security"), yes(kid("TLS", "Encryption")).alias("encrypted"))
    of = lambda kind, c: F.when(F.col("tag").isin(HW_TAGS[kind]), c)
    programs = e.filter(F.col("tag").isin("SafetyProgram", "FProgram", "Program") & (F.col("text") != "")).join(e.filter(F.col("tag").isin(HW_TAGS["safety"])).select("path", F.col("n").alias("parent")), ["path", "parent"]).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("programs"))
    plain = lambda c: F.transform(F.array_sort(c), lambda x: x.dropFields("n"))
    got = full.groupBy("path").agg(F.max_by(of("cpu", cpu), of("cpu", F.col("n"))).alias("cpu"), plain(F.collect_list(of("module", module))).alias("io_modules"), plain(F.collect_list(of("network", network))).alias("networks"), F.coalesce(F.bool_or(F.col("tag").isin(HW_TAGS["safety"])), F.lit(False)).alias("enabled"), F.max_by(of("safety", kid("PasswordLevel1", "Password")), of("safety", F.col("n"))).alias("password"))
    safety = F.struct("enabled", F.coalesce("programs", F.array().cast("array<string>")).alias("programs"), F.coalesce("password", F.lit("")).alias("password"))
    return got.join(programs, "path", "left").select("path", "cpu", "io_modules", "networks", safety.alias("safety"))
