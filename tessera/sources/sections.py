"""Loaders: files to sections (source_id, artifact_type, section_id, section_ref, text).

A folder is scanned once: each file is parsed row by row in Arrow batches, one file a row, so files are spread over the cluster, and gives
sections, spans of laid-out pages, the text of a diagram, or an error. These are written once; diagrams and spans become sections by
DataFrame operations on that table.
"""

from __future__ import annotations

import heapq
import html
import io
import json
import re
import warnings
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as T
from tessera.operators.positions import ordered, renumbered
from tessera.plans.storage import bound_batches, materialize
from tessera.sources import pdf

SUPPORTED = ("pdf", "docx", "txt", "xml", "uml", "xmi", "json", "yaml", "yml", "puml")
PLAIN = ("txt", "yaml", "yml")
#: Block openers of a diagram file (fixed values).
DIAGRAM_BLOCKS = (r"package\s+", r"class\s+", r"abstract\s+class\s+", r"interface\s+", r"enum\s+", r"component\s+", r"database\s+", r"actor\s+", r"note\s+as\s+", r"sequence\s+", r"@startuml", r"title\s+")
RULE = r"^[=\-*]{4,}$"


def files(spark: SparkSession, path: str, artifact_type: str) -> DataFrame:
    """source_id, ext, artifact_type, content of every supported file (a folder is not searched below)."""
    if artifact_type not in schemas.ARTIFACT_TYPES:
        raise ValueError(f"artifact_type must be one of {schemas.ARTIFACT_TYPES}")
    any_case = ",".join("".join(f"[{c}{c.upper()}]" for c in ext) for ext in SUPPORTED)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{any_case}}}").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = raw.select(
        F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("source_id"),
        F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"),
        F.lit(artifact_type).alias("artifact_type"),
        "content",
    )
    return rows.filter(F.col("ext").isin(*SUPPORTED))


_LINE_END = re.compile(r"\r\n|[\n\x0b\f\r\x85\u2028\u2029]")
# patterns of headings (fixed values)
_NUMBERED = re.compile(r"^([0-9]+[.0-9]*|Chapter\s+[0-9]+|Appendix\s+[A-Z])\s+\S", re.ASCII)
_TITLE = re.compile(r"^[A-Z][^\n]{3,59}$")
_SPACE = " \t\n\x0b\f\r"


def is_heading(line: str, after: str) -> bool:
    """Whether a trimmed line is a heading; `after` is the next one, trimmed."""
    if not line or len(line) > 100:
        return False
    if _NUMBERED.match(line) or re.match(RULE, after):
        return True
    if line == line.upper() and line != line.lower() and 4 <= len(line) <= 60:
        return True
    return len(line) < 60 and line[-1] not in ".," and bool(_TITLE.match(line)) and line.count(" ") < 8


def cut_text(text: str, most: int = 150, least_words: int = 150) -> list[tuple[int, str, str]]:
    """Heading lines open blocks, small blocks join the one before, and at most `most` sections remain."""
    lines = _LINE_END.split(text)
    trimmed = [x.strip(_SPACE) for x in lines]
    blocks: list[tuple[str, list[str]]] = [("Introduction", [])]
    for i, s in enumerate(trimmed):
        if is_heading(s, trimmed[i + 1] if i + 1 < len(lines) else ""):
            blocks.append((s, []))
        elif not re.match(RULE, s):
            blocks[-1][1].append(lines[i])
    merged: list[list] = []
    for ref, rows in blocks:
        body = clean_text("\n".join(rows))
        n = len(body.split())
        if not body:
            continue
        if merged and merged[-1][2] + n < least_words:
            merged[-1][1].append(body)
            merged[-1][2] += n
        else:
            merged.append([ref, [body], n])
    rows = shrink([[ref, "\n\n".join(parts)] for ref, parts, _ in merged], most)
    return [(i, ref[:80], t) for i, (ref, t) in enumerate(rows, 1)]


def text_sections(rows: DataFrame, most: int = 150, least_words: int = 150) -> DataFrame:
    """Sections of plain texts (source_id, artifact_type, text), row by row without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(r.source_id, r.artifact_type, *s) for r in pdf.itertuples() if r.text for s in cut_text(r.text, most, least_words)]
            yield pd.DataFrame(out, columns=["source_id", "artifact_type", "section_id", "section_ref", "text"])

    return rows.select("source_id", "artifact_type", "text").mapInPandas(run, schemas.SECTION)


def shrink(sections: list[list[str]], most: int) -> list[list[str]]:
    """Joins the neighbours with the fewest words together (the first such on ties) until there are at most `most` sections."""
    size = [len(t.split()) for _, t in sections]
    after, before = list(range(1, len(sections) + 1)), list(range(-1, len(sections) - 1))
    parts = [[t] for _, t in sections]
    heap = [(size[i] + size[i + 1], i, i + 1) for i in range(len(sections) - 1)]
    heapq.heapify(heap)
    left, gone = len(sections), [False] * len(sections)
    while left > most and heap:
        n, i, j = heapq.heappop(heap)
        if gone[i] or gone[j] or after[i] != j or n != size[i] + size[j]:
            continue  # one of them has grown since
        parts[i] += parts[j]
        size[i], gone[j], after[i], left = n, True, after[j], left - 1
        if after[j] < len(sections):
            before[after[j]] = i
            heapq.heappush(heap, (size[i] + size[after[j]], i, after[j]))
        if before[i] >= 0:
            heapq.heappush(heap, (size[before[i]] + size[i], before[i], i))
    return [[sections[i][0], "\n\n".join(parts[i])] for i in range(len(sections)) if not gone[i]]


def diagram_sections(rows: DataFrame) -> DataFrame:
    """Blocks of diagram sources; comment lines with little content go."""
    kept = F.filter(F.split("text", r"\R"), lambda x: ~T.trim_all(x).startswith("'") | (F.length(F.regexp_replace(F.substring(T.trim_all(x), 2, 1 << 30), r"^[ \-=~_]+|[ \-=~_]+$", "")) > 4))
    parts = F.split(F.array_join(kept, "\n"), r"(?im)(?=^(?:" + "|".join(DIAGRAM_BLOCKS) + "))")
    fine = F.filter(F.transform(parts, T.clean), lambda x: F.length(x) >= 10)
    full = T.clean("text")
    pieces = F.when(F.size(fine) > 0, F.transform(fine, lambda x: F.struct(F.concat(F.lit("puml:"), F.substring(F.split(x, r"\R")[0], 1, 80)).alias("ref"), x.alias("t")))).when(full != "", F.array(F.struct(F.lit("puml:full").alias("ref"), full.alias("t"))))
    return rows.select("source_id", "artifact_type", F.posexplode(pieces).alias("p", "x")).selectExpr("source_id", "artifact_type", "cast(p + 1 as int) as section_id", "x.ref as section_ref", "x.t as text")


def clean_text(text: str) -> str:
    return "\n".join(x.rstrip() for x in re.sub(r"\n{3,}", "\n\n", text).splitlines()).strip()


def json_sections(raw: bytes) -> list[tuple[int, str, str]]:
    """API descriptions by endpoint and schema, other JSON by key or element."""
    text = raw.decode("utf-8", "replace")
    try:
        data = json.loads(text)
    except ValueError:
        return [(1, "json:raw", clean_text(text))] if clean_text(text) else []
    if isinstance(data, dict) and ("swagger" in data or "openapi" in data):
        return [(i, ref, t) for i, (ref, t) in enumerate(((r, clean_text(x)) for r, x in _api_parts(data)), 1) if t]
    dump = lambda v: clean_text(json.dumps(v, indent=2, ensure_ascii=False))
    if isinstance(data, dict):
        return [(i, f"json:{k}", t) for i, (k, t) in enumerate(((k, dump(v)) for k, v in data.items()), 1)]
    if isinstance(data, list):
        return [(i, f"json:item:{i}", dump(v)) for i, v in enumerate(data, 1)]
    return []


def _api_parts(data: dict) -> Iterator[tuple[str, str]]:
    get = lambda d, k: d.get(k, "") if isinstance(d, dict) else ""
    info = data.get("info", {})
    head = {"API": get(info, "title"), "Version": get(info, "version"), "Description": get(info, "description"), "Base path": get(data, "basePath"), "Host": get(data, "host")}
    yield "openapi:info", "\n".join(f"{k}: {v}" for k, v in head.items())
    for path, methods in data.get("paths", {}).items():
        out = [f"Endpoint: {path}"]
        for name, spec in methods.items():
            if not isinstance(spec, dict):
                continue
            out += [f"  Method: {name.upper()}", f"  Summary: {get(spec, 'summary')}", f"  Description: {get(spec, 'description')}", f"  Tags: {', '.join(spec.get('tags', []))}"]
            if params := spec.get("parameters"):
                out.append("  Parameters:")
                out += [f"    - {get(p, 'name')} ({get(p, 'in')}, {p.get('type', get(p.get('schema', {}), 'type'))}, required={p.get('required', False)})" for p in params]
            if answers := spec.get("responses"):
                out.append("  Responses:")
                out += [f"    - {code}: {get(a, 'description')}" for code, a in answers.items()]
        yield f"openapi:path:{path}", "\n".join(out)
    for name, schema in data.get("definitions", data.get("components", {}).get("schemas", {})).items():
        rows = [f"  - {k} ({get(p, 'type')}): {get(p, 'description')}" for k, p in schema.get("properties", {}).items()]
        yield f"openapi:schema:{name}", "\n".join([f"Schema: {name}", f"Description: {get(schema, 'description')}", *rows])


_MARKUP = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<\?.*?(?:\?>|$)|<!DOCTYPE(?:[^\[<>]*\[.*?\]\s*>|[^<>]*>)"
    r"|</\s*(?P<end>[^\s<>/]+)[^<>]*>?"
    r"|<(?P<start>[A-Za-z_:][^\s<>/=\"']*)(?P<attributes>(?:\s+[^\s<>=/\"']+(?:\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'|[^\s<>\"']+))?|[\s\"'=]|/(?!>))*)(?P<empty>/?)>?"
    r"|(?P<text>[^<]+|<)", re.S,
)
_ATTRIBUTE = re.compile(r"([^\s<>=/\"']+)\s*=\s*(?:\"([^\"<]*)\"|'([^'<]*)'|([^\s<>\"']+))")


def mended_tree(raw: bytes) -> ElementTree.Element | None:
    """The elements of a broken file: an end tag closes what is open up to the element of its name, and is passed over where there is none."""
    named = re.match(rb"[^<]*<\?xml[^>]*encoding=[\"']([\w.-]+)", raw)
    try:
        text = raw.decode(named[1].decode() if named else "utf-8-sig", "replace")
    except LookupError:
        text = raw.decode("utf-8", "replace")
    root, last, stack = None, None, []
    for m in _MARKUP.finditer(text):
        if m["start"]:
            e = ElementTree.Element(m["start"], {k: html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m["attributes"])})
            if root is None:
                root = e
            else:  # what stands behind the root's end is taken as its child
                (stack[-1] if stack else root).append(e)
            last = e if m["empty"] else None
            if not m["empty"]:
                stack.append(e)
        elif m["end"]:
            at = max((k for k, e in enumerate(stack) if e.tag == m["end"]), default=None)
            if at is not None:
                last = stack[at]
                del stack[at:]
        elif (body := m["cdata"] if m["cdata"] is not None else m["text"] and html.unescape(m["text"])) and stack:
            if last is None:
                stack[-1].text = (stack[-1].text or "") + body
            else:
                last.tail = (last.tail or "") + body
    return root


def xml_sections(raw: bytes) -> list[tuple[int, str, str]]:
    """One section per child of the root: texts of leaves and named elements. Broken files are read with what their tags allow."""
    try:
        root = ElementTree.fromstring(raw)
    except (ElementTree.ParseError, ValueError, LookupError):
        root = mended_tree(raw)
    if root is None:
        return []
    local = lambda name: name.rsplit("}", 1)[-1].rsplit(":", 1)[-1]
    has_text = lambda e: bool(e.text and e.text.strip())
    leaf = lambda e: has_text(e) and not any(has_text(c) for c in e)

    def attribute(e, name: str) -> str:
        return next((v.strip() for k, v in e.attrib.items() if local(k) == name), "")

    out = []
    for top in root:
        rows: dict[str, None] = {}
        found: list[str] = []
        for e in top.iter():
            tag = local(e.tag)
            if leaf(e):
                mark = attribute(e, "name") or attribute(e, "id")
                found.append(f"[{tag}{':' + mark if mark else ''}] {e.text.strip()}")
            name, kind = attribute(e, "name"), attribute(e, "kind") or attribute(e, "type")
            entry = f"[{tag}] name={name}" + (f", kind={kind}" if kind else "")
            if name and tag not in ("XMI", "Model") and entry not in rows and entry not in found:
                rows[entry] = None
                found.append(entry)
        if text := clean_text("\n".join(found)):
            out.append((len(out) + 1, f"xml:{local(top.tag)}", text))
    if not out and (text := clean_text("\n".join(f"[{local(e.tag)}] {e.text.strip()}" for e in root.iter() if leaf(e)))):
        out.append((1, "xml:root", text))
    return out


def docx_sections(raw: bytes) -> list[tuple[int, str, str]]:
    """Paragraphs below heading styles; one section a paragraph if there are no headings. Tables are left out."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
        styles = {s.get(f"{w}styleId"): s.find(f"{w}name").get(f"{w}val") for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{w}style") if s.find(f"{w}name") is not None} if "word/styles.xml" in z.namelist() else {}
    blocks: list[tuple[str, list[str]]] = [("Preamble", [])]
    plain: list[tuple[int, str, str]] = []
    headed = False
    for i, p in enumerate(body.findall(f"{w}p") if body is not None else [], 1):
        text = "".join(t.text or "" for t in p.iter(f"{w}t")).strip()
        if not text:
            continue
        style = p.find(f"{w}pPr/{w}pStyle")
        name = styles.get(key := style.get(f"{w}val"), key) if style is not None else ""
        plain.append((i, f"paragraph {i}", text))
        if name.lower().startswith("heading"):
            headed = True
            blocks.append((f"H{re.sub(r'[^0-9]', '', name) or 1}: {text}", []))
        else:
            blocks[-1][1].append(text)
    if not headed:
        return plain
    kept = [(ref, clean_text("\n".join(rows))) for ref, rows in blocks]
    return [(i, ref, t) for i, (ref, t) in enumerate(((r, t) for r, t in kept if t), 1)]


def span_sections(spans: DataFrame, ratio: float = 1.2) -> DataFrame:
    """Sections of laid-out pages from spans (source_id, artifact_type, page, pos, size, flags, text).

    More than 40 % large spans make a slide deck, which goes by pages, as does what has fewer than three sections.
    """
    middle = spans.groupBy("source_id").agg(F.median("size").alias("body"))
    s = spans.join(middle, "source_id")
    big = F.col("size") >= ratio * F.col("body")
    deck = s.groupBy("source_id").agg((F.count_if(big) > 0.4 * F.count("*")).alias("deck"))
    heading = (big | (F.col("flags").bitwiseAND(16) != 0)) & F.length("text").between(15, 150) & ~F.col("text").rlike("^[*\\-+#>•·]")
    s = s.join(deck, "source_id").select("source_id", "artifact_type", "page", "pos", "text", (heading & ~F.col("deck")).alias("heading"), "deck")
    # headings are summed up within stretches of places, and stretches by one row each
    s = ordered(s, ["source_id", "page", "pos"], "spans").withColumn("stretch", F.shiftright("place", 16))
    sums = s.groupBy("source_id", "stretch").agg(F.sum(F.col("heading").cast("int")).alias("n"))
    first = sums.select("source_id", "stretch", F.coalesce(F.sum("n").over(W.partitionBy("source_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    within = F.coalesce(F.sum(F.col("heading").cast("int")).over(W.partitionBy("source_id", "stretch").orderBy("place").rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    blocked = s.filter("not deck").withColumn("within", within).join(first, ["source_id", "stretch"]).withColumn("block", F.col("first") + F.col("within"))
    key = ["source_id", "artifact_type", "block"]
    full = materialize(blocked.filter(~F.coalesce("heading", F.lit(False)) & (T.trim_all("text") != "")).select(*key).distinct(), "blocks")
    many = full.groupBy("source_id").count().filter("count >= 3").select("source_id")
    # only sections that are given are put together: a source without headings would be one of all its spans
    numbers = renumbered(full.join(many, "source_id", "left_semi"), ["source_id"], ["block", "artifact_type"], "section_id")
    row = F.struct("page", "pos", "text", "heading")
    g = blocked.join(many, "source_id", "left_semi").groupBy(*key).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    head = F.get(F.filter("rows", lambda r: r["heading"]), 0)
    ref = F.concat(F.substring(F.coalesce(head["text"], F.lit("Preamble")), 1, 80), F.lit(" (p."), F.coalesce(head["page"], F.lit(1)).cast("string"), F.lit(")"))
    text = T.clean(F.array_join(F.transform(F.filter("rows", lambda r: ~r["heading"]), lambda r: r["text"]), " \n")).alias("text")
    numbered = g.select(*key, ref.alias("section_ref"), text).filter("text <> ''").join(numbers, key)
    pages = s.join(many, "source_id", "left_anti").groupBy("source_id", "artifact_type", "page").agg(T.clean(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["text"]), "\n")).alias("text")).filter("text <> ''")
    cols = ["source_id", "artifact_type", "section_id", "section_ref", "text"]
    return numbered.select(cols).unionByName(pages.select("source_id", "artifact_type", F.col("page").cast("int").alias("section_id"), F.concat(F.lit("page "), F.col("page").cast("string")).alias("section_ref"), "text"))


Parser = Callable[[bytes], list[tuple[int, str, str]]]
_LOADED = schemas.SECTION + ", kind string, page int, pos int, size double, flags int, error string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
_FIELDS = pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in _LOADED.split(", "))])
OUT_ROWS, OUT_CHARS = 10_000, 4 << 20


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)


class DocumentSections:
    """The table function `document_sections(content, ext)` of SQL."""

    def eval(self, content: bytes, ext: str):
        registry = LoaderRegistry()
        parser = registry.parsers.get((ext or "").lower())
        if parser is not None and content is not None:
            for number, ref, text in parser(bytes(content)):
                yield number, ref, text


def register_functions(spark: SparkSession) -> None:
    """Registers document_sections (section_id, section_ref, text) for LATERAL joins. A null content or an extension without a parser gives no rows."""
    spark.udtf.register("document_sections", F.udtf(DocumentSections, returnType="section_id int, section_ref string, text string"))


class LoaderRegistry:
    """Parsers by extension; others can be added. A file that fails yields a row with its error and no sections."""

    def __init__(self) -> None:
        self.parsers: dict[str, Parser] = {"json": json_sections, "xml": xml_sections, "uml": xml_sections, "xmi": xml_sections, "docx": docx_sections}
        self.parsers |= {ext: lambda raw: cut_text(raw.decode("utf-8", "replace")) for ext in PLAIN}

    def register(self, ext: str, parser: Parser) -> None:
        self.parsers[ext.lower()] = parser

    def parsed(self, rows: DataFrame) -> DataFrame:
        """What each file (source_id, artifact_type, ext, content) gives: sections, a diagram's text, spans, or the error that its parser met, told by `kind`."""
        parsers = dict(self.parsers)

        def parts(ext: str, raw: bytes) -> list[tuple]:
            if ext in parsers:
                return [(*x, "section", None, None, None, None, None) for x in parsers[ext](raw)]
            if ext == "puml":
                return [(None, None, raw.decode("utf-8", "replace"), "diagram", None, None, None, None, None)]
            if ext == "pdf":
                return [(None, None, text, "span", page, pos, size, flags, None) for page, pos, size, flags, text in pdf.spans(raw)]
            raise ValueError(f"no parser for .{ext}")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, held = [], 0
            for batch in batches:
                for source, artifact, ext, raw in zip(*(batch.column(c) for c in ("source_id", "artifact_type", "ext", "content")), strict=True):
                    try:
                        out = parts(ext.as_py(), bytes(raw.as_py()))
                    except Exception as e:  # one bad file must not end the load
                        out = [(None, None, None, "error", None, None, None, None, f"{type(e).__name__}: {e}")]
                    head = source.as_py(), artifact.as_py()
                    for x in out:  # files share batches, which are bounded in rows and characters
                        kept.append((*head, *x))
                        held += len(x[2] or "")
                        if len(kept) >= OUT_ROWS or held >= OUT_CHARS:
                            yield _table(kept)
                            kept, held = [], 0
            if kept:
                yield _table(kept)

        bound_batches(rows.sparkSession)
        return rows.select("source_id", "artifact_type", "ext", "content").mapInArrow(run, _LOADED)

    def sections(self, rows: DataFrame) -> DataFrame:
        """Sections of files, and a row for each that failed, with `error`. The files are read once; what they give is written into the shared folder."""
        table = materialize(self.parsed(rows), "loaded")
        cols = [x.split()[0] for x in schemas.SECTION.split(", ")]
        out = table.filter("kind in ('section', 'error')").select(*cols, "error")
        drawn = diagram_sections(table.filter("kind = 'diagram'"))
        laid = span_sections(table.filter("kind = 'span'").select("source_id", "artifact_type", "page", "pos", "size", "flags", "text"))
        for more in (drawn, laid):
            out = out.unionByName(more.select(*cols, F.lit(None).cast("string").alias("error")))
        return out

    def read(self, spark: SparkSession, path: str, artifact_type: str) -> DataFrame:
        """Sections of all files below `path`, and a row with its error for each file that failed, from one scan."""
        return self.sections(files(spark, path, artifact_type))

    def load(self, spark: SparkSession, path: str, artifact_type: str) -> DataFrame:
        """Sections of all files below `path`; how many files failed is a warning."""
        whole = self.read(spark, path, artifact_type)
        if failed := whole.filter("error is not null").count():
            warnings.warn(f"{failed} files below {path} couldn't be loaded; `read` names them", stacklevel=2)
        return whole.filter("error is null").drop("error")

    def load_file(self, spark: SparkSession, path: str, artifact_type: str, source_id: str | None = None) -> DataFrame:
        """Sections of one file. A missing file, an extension that isn't supported and a file that fails are errors."""
        ext = path.rsplit(".", 1)[-1].lower()
        if ext not in SUPPORTED:
            raise ValueError(f"no loader for .{ext}; there are {', '.join(sorted(SUPPORTED))}")
        try:
            rows = files(spark, path, artifact_type)
            if source_id is not None:
                rows = rows.withColumn("source_id", F.lit(source_id))
            whole = self.sections(rows)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                raise FileNotFoundError(path) from e
            raise
        if failed := whole.filter("error is not null").select("error").first():
            raise ValueError(f"{path}: {failed['error']}")
        return whole.drop("error")
