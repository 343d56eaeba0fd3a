"""Stage-navigator documents: targets as parallel arrays of numbered properties, in XML.

Points, rectangles and polygons each have arrays of ids, places and names, and arrays of constants of the
same length; regions are listed once more for scanning. A plan holds what one acquisition can visit, so each
document is built from one group of rows; the documents of many images are built and read in tasks.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import tables

# Fixed values of the format: keys of the two property sets, then property numbers.
SETTINGS_KEY, NAVIGATOR_KEY = "ParamSetInfo", "StageNavigator"
DOCUMENT_NAME = "1073741824"
OVERVIEW_BOX, OVERVIEW_CENTRE = "1073741825", "1073741888"
TOP_LEFT, TOP_RIGHT, BOTTOM_LEFT = "401141", "401142", "401143"
ALL_IDS = "1073741885"
POINT_PLACES, POINT_IDS, POINT_NAMES = "1073741839", "1073741840", "1073741926"
RECT_PLACES, RECT_IDS, RECT_SIZES, RECT_NAMES = "1073741836", "1073741837", "1073741838", "1073741927"
POLYGONS, POLYGON_NAMES = "1073741908", "1073741929"
VERTICES, ID, AUX, Z = "1073741909", "1073741910", "1073741911", "1073741912"
NAME, NAME_SET = "1073741923", "1073741930"
SCANS = "1073741884"
# Arrays that hold one constant for each point, and for each rectangle (number, type, constant).
POINT_CONSTANTS = (
    ("1073741845", "double", "0"), ("1073741846", "double", "0"), ("1073741849", "unsigned_char", "255"), ("1073741851", "unsigned_char", "0"), ("1073741868", "int", "-1"),
    ("1073741889", "unsigned_char", "0"), ("1073741890", "double", "0"), ("1073741892", "unsigned_char", "0"), ("1073741893", "double", "0"),
)
RECT_CONSTANTS = (
    ("1073741847", "double", "0"), ("1073741848", "double", "0"), ("1073741850", "unsigned_char", "255"), ("1073741852", "unsigned_char", "0"), ("1073741861", "unsigned_char", "255"),
    ("1073741869", "int", "-1"), ("1073741895", "unsigned_char", "0"), ("1073741896", "double", "0"), ("1073741898", "unsigned_char", "0"), ("1073741899", "double", "0"),
)
# Arrays of the scan list (number, type, value; None is the region's id, "#" its place from 0).
SCAN_ARRAYS = (("1073741879", "int", None), ("1073741880", "int", "3"), ("1073741883", "int", "#"), ("1073741882", "int", "-1"), ("1073741881", "unsigned_char", "1"), ("1073741907", "unsigned_char", "0"))
EMPTY_DOCUMENT = f'<Configuration><PropertySet Key="{SETTINGS_KEY}"/><PropertySet Key="{NAVIGATOR_KEY}"/></Configuration>'


def _value(kind: str, content: object) -> ET.Element:
    """An element of one value: numbers nest as doubles in vectors and boxes, properties in sets."""
    e = ET.Element(kind)
    if kind == "PropertySet":
        e.extend(content)
    elif isinstance(content, tuple):
        e.extend(_value("double", c) for c in content)
    else:
        e.text = repr(float(content)) if isinstance(content, float) else str(content)
    return e


def _one(number: str, kind: str, content: object) -> ET.Element:
    p = ET.Element("Property", ID=number)
    p.append(_value(kind, content))
    return p


def _many(number: str, kind: str, contents: list, empty: str | None = None) -> ET.Element:
    """An array of values; without any, it names the type that they would have."""
    p = ET.Element("Property", ID=number, IsArray="true")
    for c in contents:
        ET.SubElement(p, "Component").append(_value(kind, c))
    if not contents:
        ET.SubElement(p, "Empty", Type=empty or kind)
    return p


def _names(number: str, rows: list) -> ET.Element:
    return _many(number, "PropertySet", [[_one(NAME_SET, "PropertySet", [_one(NAME, "wstring", r["name"])]), _one(ID, "int", r["target_id"])] for r in rows], "CPropSet")


def _polygon(r) -> list[ET.Element]:
    return [_one(ID, "int", r["target_id"]), _one(Z, "double", float(r["z"])), _one(AUX, "int", -1), _many(VERTICES, "CdVec2", [(v["x"], v["y"]) for v in r["vertices"]])]


def _properties(rows: list) -> list[ET.Element]:
    """All arrays of targets, empty ones too."""
    points, rects, polygons = ([r for r in rows if r["kind"] == k] for k in tables.KINDS)
    ids = lambda rs: [r["target_id"] for r in rs]
    place = lambda rs: [(r["x"], r["y"], r["z"]) for r in rs]
    scanned = ids(rects) + ids(polygons)
    scans = [_many(n, t, [i if v is None else k if v == "#" else v for k, i in enumerate(scanned)]) for n, t, v in SCAN_ARRAYS]
    return [
        _many(POINT_PLACES, "CdVec3", place(points)), _many(POINT_IDS, "int", ids(points)), *(_many(n, t, [v] * len(points)) for n, t, v in POINT_CONSTANTS), _names(POINT_NAMES, points),
        _many(RECT_PLACES, "CdVec3", place(rects)), _many(RECT_IDS, "int", ids(rects)), _many(RECT_SIZES, "CdVec2", [(r["width"], r["height"]) for r in rects]),
        *(_many(n, t, [v] * len(rects)) for n, t, v in RECT_CONSTANTS), _names(RECT_NAMES, rects),
        _many(POLYGONS, "PropertySet", [_polygon(r) for r in polygons], "CPropSet"), _names(POLYGON_NAMES, polygons), _many(ALL_IDS, "int", ids(rows)), _one(SCANS, "PropertySet", scans),
    ]


def _set(doc: ET.Element, key: str) -> ET.Element:
    found = next((s for s in doc.iter("PropertySet") if s.get("Key") == key), None)
    if found is None:
        raise ValueError(f"the document has no property set {key}")
    return found


def _put(where: ET.Element, new: ET.Element) -> None:
    """Put a property in the place of the one with its number, or last."""
    at = next((i for i, p in enumerate(where) if p.tag == "Property" and p.get("ID") == new.get("ID")), None)
    if at is None:
        where.append(new)
    else:
        old = where[at].find("PName")
        if old is not None:
            new.insert(0, old)
        where[at] = new


def to_xml(targets: DataFrame, name: str, template: str | None = None, corners: list[tuple[float, float]] | None = None) -> str:
    """The document of targets with ids, which are checked first. All else in a template stays; its earlier
    targets go. ``corners`` of the overview (top left, top right, bottom left in stage units, and bottom
    right, which defaults to the parallelogram's) set its box and centre too."""
    return _document(tables.check(targets).orderBy("target_id").collect(), name, template, corners)


def to_documents(targets: DataFrame, prefix: str = "plan", template: str | None = None) -> DataFrame:
    """(image_id, value): the document of each image's targets (image_id, target_id and target columns), named after
    the image. Targets are checked first."""

    def build(df: pd.DataFrame) -> pd.DataFrame:
        image = df["image_id"].iloc[0]
        rows = df.sort_values("target_id").to_dict("records")
        return pd.DataFrame({"image_id": [image], "value": [_document(rows, f"{prefix} {image}", template, None)]})

    kind = dict(targets.dtypes)["image_id"]
    t = tables.check(targets).select("image_id", "target_id", *tables.COLUMNS)
    return t.groupBy("image_id").applyInPandas(build, f"image_id {kind}, value string")


def _document(rows: list, name: str, template: str | None, corners: list[tuple[float, float]] | None) -> str:
    doc = ET.fromstring(template or EMPTY_DOCUMENT)
    nav = _set(doc, NAVIGATOR_KEY)
    _put(_set(doc, SETTINGS_KEY), _one(DOCUMENT_NAME, "CString", name))
    for p in _properties(rows):
        _put(nav, p)
    if corners:
        (ax, ay), (bx, by), (cx, cy) = corners[:3]
        xs, ys = zip(*(corners if len(corners) == 4 else [*corners, (bx + cx - ax, by + cy - ay)]), strict=True)
        for number, corner in zip((TOP_LEFT, TOP_RIGHT, BOTTOM_LEFT), corners, strict=False):
            _put(nav, _one(number, "CdVec2", corner))
        _put(nav, _one(OVERVIEW_BOX, "CdRect", (min(xs), min(ys), max(xs), max(ys))))
        _put(nav, _one(OVERVIEW_CENTRE, "CdVec2", ((min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2)))
    ET.indent(doc, "\t")
    return ET.tostring(doc, encoding="unicode")


def save_xml(text: str, path: str) -> None:
    Path(path).write_bytes(('<?xml version="1.0" encoding="UTF-16" standalone="no"?>\n' + text).encode("utf-16"))


def _numbers(e: ET.Element | None, n: int) -> tuple | None:
    """The n numbers of a vector or box; None where it is missing or malformed."""
    try:
        out = tuple(float(d.text) for d in e.findall("double"))
    except (AttributeError, TypeError, ValueError):
        return None
    return out if len(out) == n else None


def _array(where: ET.Element, number: str) -> list[ET.Element]:
    return where.findall(f"Property[@ID='{number}']/Component")


def _whole(text: str | None) -> int | None:
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


def _read_names(nav: ET.Element, number: str) -> list[tuple[int | None, str | None]]:
    """(id, name) of each entry, null where it is missing or malformed."""
    named = []
    for c in _array(nav, number):
        i, n = c.findtext(f"PropertySet/Property[@ID='{ID}']/int"), c.find(f".//Property[@ID='{NAME}']/wstring")
        named.append((_whole(i), n.text if n is not None else None))
    return named


def _identified(ids: list[int | None], n: int, named: list[tuple[int | None, str | None]], word: str) -> list[tuple[int, str]]:
    """Id and name of n entries. Where all have ids of their own, names are joined by id, so a malformed entry shifts
    no other; else ids are places, and so are names."""
    sound = len(ids) == n and None not in ids and len(set(ids)) == n
    names = {i: x for i, x in named if x} if sound else {k: x for k, (_, x) in enumerate(named, 1) if x}
    return [(i, names.get(i) or f"{word} {k}") for k, i in enumerate(ids if sound else range(1, n + 1), 1)]


def _targets_of(text: str) -> list[tuple]:
    """Rows of the target columns. Malformed places and vertices are skipped, polygons without vertices too; ids may be
    missing or malformed; a polygon's missing z is 0 and missing names are filled by kind and place."""
    nav, rows = _set(ET.fromstring(text), NAVIGATOR_KEY), []
    ints = lambda number: [_whole(c.findtext("int")) for c in _array(nav, number)]
    places = _array(nav, POINT_PLACES)
    for (i, name), c in zip(_identified(ints(POINT_IDS), len(places), _read_names(nav, POINT_NAMES), "Position"), places, strict=True):
        if p := _numbers(c.find("CdVec3"), 3):
            rows.append(("point", i, name, *p, None, None, None))
    boxes = list(zip(_array(nav, RECT_PLACES), _array(nav, RECT_SIZES), strict=False))
    for (i, name), (c, s) in zip(_identified(ints(RECT_IDS), len(boxes), _read_names(nav, RECT_NAMES), "Rectangle"), boxes, strict=True):
        if (p := _numbers(c.find("CdVec3"), 3)) and (size := _numbers(s.find("CdVec2"), 2)):
            rows.append(("rectangle", i, name, *p, *size, None))
    sets = [c.find("PropertySet") for c in _array(nav, POLYGONS)]
    ids = [None if one is None else _whole(one.findtext(f"Property[@ID='{ID}']/int")) for one in sets]
    for (i, name), one in zip(_identified(ids, len(sets), _read_names(nav, POLYGON_NAMES), "Mosaic"), sets, strict=True):
        v = [] if one is None else [p for x in _array(one, VERTICES) if (p := _numbers(x.find("CdVec2"), 2))]
        if v:
            try:
                z = float(one.findtext(f"Property[@ID='{Z}']/double") or 0.0)
            except ValueError:
                z = 0.0
            rows.append(("polygon", i, name, None, None, z, None, None, v))
    return rows


def from_xml(spark: SparkSession, text: str) -> DataFrame:
    """Targets of a document; ``ordinal`` is the id."""
    return spark.createDataFrame(_targets_of(text), tables.SCHEMA)


def from_documents(documents: DataFrame) -> DataFrame:
    """Targets of many documents (image_id, value), each read in a task: image_id and the target columns."""
    kind = dict(documents.dtypes)["image_id"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = [(image, *t[:-1], t[-1] and [{"x": x, "y": y} for x, y in t[-1]]) for image, text in zip(df["image_id"], df["value"], strict=True) for t in _targets_of(text)]
            yield pd.DataFrame(rows, columns=["image_id", *tables.COLUMNS])

    return documents.select("image_id", F.col("value")).mapInPandas(read, f"image_id {kind}, {tables.SCHEMA}")


def overview_box(text: str) -> tuple | None:
    """(left, bottom, right, top) of the overview; None where the document has none."""
    return _numbers(_set(ET.fromstring(text), NAVIGATOR_KEY).find(f"Property[@ID='{OVERVIEW_BOX}']/CdRect"), 4)


def problems(text: str) -> list[str]:
    """What is wrong with a document's arrays: lengths that differ, ids that aren't 1..N, names of other ids,
    a scan list of other regions."""
    nav = _set(ET.fromstring(text), NAVIGATOR_KEY)
    ints = lambda number: [int(c.findtext("int")) for c in _array(nav, number)]
    inner = [int(i.text) for i in nav.findall(f"Property[@ID='{POLYGONS}']/Component/PropertySet/Property[@ID='{ID}']/int")]
    out, found = [], []
    for kind, ids, of_names, others in (("point", ints(POINT_IDS), POINT_NAMES, [POINT_PLACES, *(c[0] for c in POINT_CONSTANTS)]), ("rectangle", ints(RECT_IDS), RECT_NAMES, [RECT_PLACES, RECT_SIZES, *(c[0] for c in RECT_CONSTANTS)]), ("polygon", inner, POLYGON_NAMES, [])):
        found.append(ids)
        named = [int(c.findtext(f"PropertySet/Property[@ID='{ID}']/int")) for c in _array(nav, of_names)]
        out += [f"{kind}: array {n} differs in length" for n in others if len(_array(nav, n)) != len(ids)]
        out += [f"{kind}: names of other ids"] * (named != ids)
    n = sum(map(len, found))
    out += ["ids aren't 1..N"] * (not [i for ids in found for i in ids] == list(range(1, n + 1)) == ints(ALL_IDS))
    scanned = [int(i.text) for i in nav.findall(f"Property[@ID='{SCANS}']/PropertySet/Property[@ID='{SCAN_ARRAYS[0][0]}']/Component/int")]
    return out + ["the scan list holds other regions"] * (scanned != found[1] + found[2])
