"""Office sheets (.xlsx) and shape files (.shp with .dbf), read as whole files by tasks and written from small tables.

Such files are small by their format (about a million rows; 2 GB), so a file is one task's work; a pattern of paths
reads many files side by side.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of a sheet, with its head, by the format.
SHEET_ROWS = 1_048_576
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def _letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def sheet_rows(data: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet (the first without a name), cell by cell as text; null for empty cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): targets[s.get(f"{_REL}id")] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet}; there are {', '.join(sheets)}")
        target = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as xml:
            for _, row in ElementTree.iterparse(xml):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for cell in row.iter(f"{_MAIN}c"):
                    at = _number(re.match("[A-Z]+", cell.get("r")).group()) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    value = cell.find(f"{_MAIN}v")
                    if cell.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in cell.iter(f"{_MAIN}t")))
                    elif value is None or value.text is None:
                        cells.append(None)
                    else:
                        cells.append(shared[int(value.text)] if cell.get("t") == "s" else value.text)
                yield cells
                row.clear()


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """All columns are strings, named by the first row of the first file."""
    first = _files(spark, path).orderBy("path").limit(1)

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1).to_pylist():
                names = [x or f"_{i}" for i, x in enumerate(next(sheet_rows(data, sheet), []))]
                yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string()))], names=["names"])

    names = first.mapInArrow(head, "names array<string>").first()[0]
    if not names:
        raise ValueError("the sheet is empty")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list[list[str | None]]) -> pa.RecordBatch:
            columns = [[r[i] if i < len(r) else None for r in held] for i in range(len(names))]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in columns], names=[f"c{i}" for i in range(len(names))])

        for batch in batches:
            for data in batch.column(1).to_pylist():
                each = sheet_rows(data, sheet)
                next(each, None)
                held: list[list[str | None]] = []
                for r in each:
                    held.append(r)
                    if len(held) == 4096:
                        yield made(held)
                        held = []
                if held:
                    yield made(held)

    return _files(spark, path).mapInArrow(rows, ", ".join(f"c{i} string" for i in range(len(names)))).toDF(*names)


def write_sheets(frames: dict[str, DataFrame], path: str) -> None:
    """One .xlsx file at a path of the driver, a sheet for each table. Rows pass the driver one partition at a time."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        n = len(frames)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, n + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="r{i}"/>' for i, name in enumerate(frames, 1)) + "</sheets></workbook>")
        for i, df in enumerate(frames.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                out.write(f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
                out.write(_row(1, df.columns))
                for r, row in enumerate(df.toLocalIterator(), 2):
                    if r > SHEET_ROWS:
                        raise ValueError("too many rows for a sheet")
                    out.write(_row(r, row))
                out.write(b"</sheetData></worksheet>")


def _row(number: int, values) -> bytes:
    cells = []
    for i, x in enumerate(values):
        at = f"{_letters(i)}{number}"
        if x is None:
            continue
        if isinstance(x, bool | str) or not isinstance(x, int | float):
            cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>')
        else:
            cells.append(f'<c r="{at}"><v>{x!r}</v></c>')
    return f'<row r="{number}">{"".join(cells)}</row>'.encode()


def shapes(data: bytes) -> Iterator[str | None]:
    """Each record of a .shp file as text: POINT or POLYGON (a hole follows its outer ring, which runs clockwise); null for empty or other shapes."""
    at = 100
    while at + 12 <= len(data):
        _, words = struct.unpack_from(">ii", data, at)
        (kind,) = struct.unpack_from("<i", data, at + 8)
        if kind % 10 == 1 and kind:
            yield "POINT ({:.17g} {:.17g})".format(*struct.unpack_from("<dd", data, at + 12))
        elif kind % 10 == 5:
            parts, points = struct.unpack_from("<ii", data, at + 44)
            starts = [*struct.unpack_from(f"<{parts}i", data, at + 52), points]
            xy = struct.unpack_from(f"<{2 * points}d", data, at + 52 + 4 * parts)
            polygons: list[list[str]] = []
            for a, b in zip(starts, starts[1:], strict=False):
                ring = [(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)]
                outer = sum((x2 - x1) * (y2 + y1) for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False)) >= 0
                text = "(" + ", ".join(f"{x:.17g} {y:.17g}" for x, y in ring) + ")"
                if outer or not polygons:
                    polygons.append([text])
                else:
                    polygons[-1].append(text)
            body = [f"({', '.join(p)})" for p in polygons]
            yield f"POLYGON {body[0]}" if len(body) == 1 else f"MULTIPOLYGON ({', '.join(body)})" if body else None
        else:
            yield None
        at += 8 + 2 * words


def attributes(data: bytes, encoding: str = "latin-1") -> tuple[list[str], Iterator[list[str | None]]]:
    """Column names and rows of a .dbf file, as text."""
    count, head, size = struct.unpack_from("<IHH", data, 4)
    fields = []
    at = 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding), data[at + 16]))
        at += 32

    def rows() -> Iterator[list[str | None]]:
        for i in range(count):
            place = head + i * size + 1
            out = []
            for _, width in fields:
                out.append(data[place : place + width].decode(encoding).rstrip(" \0") or None)
                place += width
            yield out

    return [name for name, _ in fields], rows()


def _code_page(spark: SparkSession, path: str) -> str:
    """What the .cpg files name, if there are any; Latin-1 without."""
    try:
        said = spark.read.text(path).limit(1).first()
    except AnalysisException:
        return "latin-1"
    name = (said[0] if said else "").strip()
    return f"cp{name}" if name.isdigit() else name or "latin-1"


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """geometry (text), then the columns of the .dbf file beside it, as strings, in the code page that a .cpg file names."""
    table = re.sub(r"\.shp$", ".dbf", path)
    encoding = _code_page(spark, re.sub(r"\.shp$", ".cpg", path))

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([attributes(x, encoding)[0] for x in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["names"])

    names = _files(spark, table).orderBy("path").limit(1).mapInArrow(head, "names array<string>").first()[0]
    both = _files(spark, path).select(F.regexp_replace("path", r"\.shp$", "").alias("file"), F.col("content").alias("shp")).join(_files(spark, table).select(F.regexp_replace("path", r"\.dbf$", "").alias("file"), F.col("content").alias("dbf")), "file")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shp, dbf in zip(batch.column("shp").to_pylist(), batch.column("dbf").to_pylist(), strict=True):
                records = [[g, *r] for g, r in zip(shapes(shp), attributes(dbf, encoding)[1], strict=True)]
                columns = list(zip(*records, strict=True)) or [[]] * (1 + len(names))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.string()) for x in columns], names=["geometry", *(f"c{i}" for i in range(len(names)))])

    return both.mapInArrow(rows, ", ".join(["geometry string", *(f"c{i} string" for i in range(len(names)))])).toDF("geometry", *names)


#: Bytes that a column's name and value may have in a .dbf file.
NAME_BYTES, VALUE_BYTES = 10, 254


def _body(text: str | None) -> tuple[bytes, list[tuple[float, float]]]:
    """A record of a .shp file and its corners. Outer rings are turned with the clock and holes against it, as the format wants them."""
    if text is None:
        return struct.pack("<i", 0), []
    parts = re.findall(r"\(\([^()]+\)(?:,\s*\([^()]+\))*\)", text)
    if not parts:
        points = [tuple(map(float, x)) for x in re.findall(r"\(\s*(\S+)\s+([^\s()]+)\s*\)", text)[:1]]
        return struct.pack("<i2d", 1, *points[0]), points
    rings = []
    for part in parts:
        for i, ring in enumerate(re.findall(r"\(([^()]+)\)", part)):
            corners = [tuple(map(float, p.split()[:2])) for p in ring.split(",")]
            corners += corners[:1] if corners[0] != corners[-1] else []
            clockwise = sum((x2 - x1) * (y2 + y1) for (x1, y1), (x2, y2) in zip(corners, corners[1:], strict=False)) >= 0
            rings.append(corners if clockwise == (i == 0) else corners[::-1])
    points = [p for ring in rings for p in ring]
    starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
    box = [f(p[k] for p in points) for f in (min, max) for k in (0, 1)]
    return struct.pack("<i4dii", 5, *box, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<dd", *p) for p in points), points


def write_shapes(df: DataFrame, geometry: str, path: str) -> None:
    """Texts of polygons or of points, and the other columns, as .shp, .shx, .dbf and .cpg (UTF-8) beside each other at a path
    of the driver. Rows pass it one partition at a time and go straight to the files. What the format can't hold raises an
    error and nothing is written: other or mixed geometries, names of over 10 and values of over 254 bytes."""
    names = [c for c in df.columns if c != geometry]
    if long := [n for n in names if len(n.encode()) > NAME_BYTES]:
        raise ValueError(f"column names have over {NAME_BYTES} bytes: {', '.join(long)}")
    rows = df.select(F.col(f"`{geometry}`").alias("g"), *[F.col(f"`{n}`").cast("string").alias(f"c{i}") for i, n in enumerate(names)])
    polygon, point = (F.regexp_like("g", F.lit(p)) for p in (r"^(MULTI)?POLYGON\s*\(", r"^POINT\s*\("))
    sums = rows.agg(F.count_if(polygon).alias("polygons"), F.count_if(point).alias("points"), F.count("g").alias("all"), F.count(F.lit(1)).alias("rows"), *[F.max(F.octet_length(f"c{i}")).alias(f"c{i}") for i in range(len(names))]).first()
    if sums["all"] not in (sums["polygons"], sums["points"]):
        raise ValueError("all geometries must be polygons, or all points")
    widths = [max(1, sums[f"c{i}"] or 1) for i in range(len(names))]
    if wide := [n for n, w in zip(names, widths, strict=True) if w > VALUE_BYTES]:
        raise ValueError(f"values have over {VALUE_BYTES} bytes in: {', '.join(wide)}")
    kind = 5 if sums["polygons"] or not sums["points"] else 1
    base = re.sub(r"\.shp$", "", path)
    with open(f"{base}.shp", "wb") as shp, open(f"{base}.shx", "wb") as shx, open(f"{base}.dbf", "wb") as dbf:
        for out in (shp, shx):
            out.write(bytes(100))
        dbf.write(struct.pack("<B3BIHH20x", 3, 95, 7, 26, sums["rows"], 33 + 32 * len(names), 1 + sum(widths)))
        for name, width in zip(names, widths, strict=True):
            dbf.write(name.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([width]) + bytes(15))
        dbf.write(b"\r")
        box, n = [float("inf")] * 2 + [float("-inf")] * 2, 0
        for n, row in enumerate(rows.toLocalIterator(), 1):
            body, points = _body(row[0])
            for x, y in points:
                box = [min(box[0], x), min(box[1], y), max(box[2], x), max(box[3], y)]
            shx.write(struct.pack(">ii", shp.tell() // 2, len(body) // 2))
            shp.write(struct.pack(">ii", n, len(body) // 2) + body)
            dbf.write(b" " + b"".join((x or "").encode().ljust(w) for x, w in zip(row[1:], widths, strict=True)))
        if n != sums["rows"]:
            raise ValueError("the table changed while it was written")
        dbf.write(b"\x1a")
        for out in (shp, shx):
            size = out.tell()
            out.seek(0)
            out.write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<ii8d", 1000, kind, *(box if box[0] <= box[2] else [0.0] * 4), 0, 0, 0, 0))
    with open(f"{base}.cpg", "w") as out:
        out.write("UTF-8")
