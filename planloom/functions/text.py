"""Text rules as Column expressions: annotation patterns, measurements, scales, keyword scores, descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUM = r"(\d+(?:\.\d+)?)"
FRACTION = r"(\d+(?:/\d+)?)"
INCH_PART = r"(\d+(?:\d+/\d+)?)"
SHEET = r"([AEMPSFCL][-.]?\d{1,3}[.-]?\d{0,2})"

# fixed values: (pattern, annotation type, names of the captured fields); the first match decides
ANNOTATION_PATTERNS: list[tuple[str, str, list[str]]] = [
    (r"^ROOM\s*#?\s*(\d+[A-Z]?)$", "room_number", ["room_number"]),
    (r"^(\d{2,4}[A-Z]?)$", "room_number", ["room_number"]),
    (rf"^{NUM}\s*(?:SF|SQ\.?\s*FT\.?|FT2?)$", "area", ["area_sf"]),
    (rf"^{NUM}\s*(?:M2|SQ\.?\s*M\.?)$", "area", ["area_m2"]),
    (rf"^(\d+)['′]\s*[-]?\s*{INCH_PART}[\"″]?$", "dimension", ["feet", "inches"]),
    (rf"^{INCH_PART}[\"″]$", "dimension", ["inches"]),
    (rf"^{NUM}\s*(?:mm|MM)$", "dimension", ["mm"]),
    (rf"^{NUM}\s*(?:m|M)$", "dimension", ["m"]),
    (rf"^(?:EL\.?|ELEV\.?)\s*(\d+)['′]\s*[-]?\s*{INCH_PART}[\"″]?$", "elevation", ["elevation_feet", "elevation_inches"]),
    (rf"^(?:EL\.?|ELEV\.?)\s*[+]?{NUM}$", "elevation", ["elevation"]),
    (rf"^[+]{NUM}$", "elevation", ["elevation"]),
    (r"^CKT[-\s]?([A-Z]?\d+[A-Z]?)$", "circuit_id", ["circuit"]),
    (r"^(\d+)[Aa]/([13])P$", "circuit_id", ["amps", "poles"]),
    (r"^(AHU|VAV|FCU|RTU|ERU|MAU|EF|SF|RF|HWP|CWP|CHW|HW|P|FD|SD|BD|MD)[-_]?(\d+[A-Z]?)$", "equipment_tag", ["prefix", "number"]),
    (r"^([A-Z]{2,4})[-_]?(\d{1,4}[A-Z]?)$", "equipment_tag", ["prefix", "number"]),
    (r"^(\d+)\s*[xX×]\s*(\d+)\s*(SA|RA|EA|OA|EX)\s*(\d+)\s*CFM$", "equipment_spec", ["width", "height", "air_type", "cfm"]),
    (r"^(\d+)\s*[xX×]\s*(\d+)$", "size", ["width", "height"]),
    (rf"^{NUM}\s*CFM$", "flow_rate", ["cfm"]),
    (rf"^{NUM}\s*(?:L/S|LPS|L/MIN)$", "flow_rate", ["lps"]),
    (rf"^{FRACTION}[\"″]?\s*(GV|BV|CV|PRV|CK|CKV)$", "equipment_spec", ["size_inches", "valve"]),
    (rf"^{FRACTION}[\"″]$", "size", ["size_inches"]),
    (rf"^{NUM}\s*(?:HP|hp)$", "power", ["hp"]),
    (rf"^{NUM}\s*(?:kW|KW|kw)$", "power", ["kw"]),
    (rf"^{NUM}\s*(?:TON|TONS?)$", "capacity", ["tons"]),
    (r"^\((\d+)\)$", "quantity", ["quantity"]),
    (r"^TYP\.?\s*\((\d+)\)$", "quantity", ["typical_quantity"]),
    (r"^TYP\.?$", "quantity", []),
    (r"^(?:PANEL\s+)?([LM]?[PD]?P?[-]?\d*[A-Z]?)$", "panel_name", ["panel"]),
    (rf"^{SHEET}$", "sheet_ref", ["sheet"]),
    (rf"^(\d+)/{SHEET}$", "section_ref", ["detail", "sheet"]),
    (r"^(?:SECTION|SEC\.?|DETAIL|DET\.?)\s+([A-Z0-9]+)$", "section_ref", ["section"]),
]
# fixed values: words that mark a room name
ROOM_WORDS = ["OFFICE", "CONFERENCE", "MEETING", "LOBBY", "CORRIDOR", "HALLWAY", "RESTROOM", "BATHROOM", "TOILET", "KITCHEN",
              "BREAK", "LOUNGE", "STORAGE", "CLOSET", "MECHANICAL", "ELECTRICAL", "TELECOM", "IDF", "MDF", "JANITOR", "COPY",
              "MAIL", "RECEPTION", "WAITING", "ELEVATOR", "STAIR", "VESTIBULE", "ATRIUM", "COMMONS", "OPEN OFFICE",
              "WORKSTATION", "CUBICLE", "PRIVATE", "CLASSROOM", "LAB", "LABORATORY", "EXAM", "PATIENT", "NURSE", "DOCTOR",
              "TREATMENT", "RECOVERY", "SURGERY"]
# fixed values: general category per annotation type
ANNOTATION_CATEGORY = {
    "room_name": "identifier", "room_number": "identifier", "equipment_tag": "identifier",
    "area": "measurement", "dimension": "measurement", "elevation": "measurement",
    "equipment_spec": "equipment", "size": "equipment", "flow_rate": "equipment", "power": "equipment", "capacity": "equipment",
    "reference": "reference", "quantity": "reference", "sheet_ref": "reference", "section_ref": "reference",
    "circuit_id": "electrical", "panel_name": "electrical", "note": "text", "specification": "text"}
# fixed values: equipment kind per tag prefix
EQUIPMENT_PREFIX = {
    "AHU": "air_handling_unit", "VAV": "vav_box", "FCU": "fan_coil_unit", "RTU": "rooftop_unit", "ERU": "energy_recovery_unit",
    "MAU": "makeup_air_unit", "EF": "exhaust_fan", "SF": "supply_fan", "RF": "return_fan", "HWP": "hot_water_pump",
    "CWP": "chilled_water_pump", "P": "pump", "FD": "fire_damper", "SD": "smoke_damper", "BD": "backdraft_damper",
    "MD": "motorized_damper"}


def lookup(table: dict[str, object], key: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[key]


def match_pattern(text: Column, patterns=ANNOTATION_PATTERNS) -> Column:
    """Struct (type, fields) of the first matching pattern, null when none: one CASE over the whole table."""
    out = None
    for p, kind, names in patterns:
        p = "(?i)" + p
        pairs = [v for j, n in enumerate(names) for v in (F.lit(n), F.regexp_extract(text, p, j + 1))]
        fields = (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>")
        found = F.struct(F.lit(kind).alias("type"), fields.alias("fields"))
        out = F.when(text.rlike(p), found) if out is None else out.when(text.rlike(p), found)
    return out


def clean_text(text: Column) -> Column:
    return F.upper(F.trim(text))


def is_room_name(text: Column) -> Column:
    t = clean_text(text)
    words = F.lit(False)
    for w in ROOM_WORDS:
        words = words | F.contains(t, F.lit(w))
    return words | ((F.endswith(t, F.lit(" ROOM")) | F.startswith(t, F.lit("ROOM "))) & ~t.rlike(r"\d"))


def fraction(s: Column) -> Column:
    """``3/4`` or ``2.5`` to a number."""
    top, bottom = F.split_part(s, F.lit("/"), F.lit(1)), F.split_part(s, F.lit("/"), F.lit(2))
    return F.when(F.contains(s, F.lit("/")), F.try_divide(top.try_cast("double"), bottom.try_cast("double"))).otherwise(s.try_cast("double"))


# fixed values: numeric text for the number patterns of the classifier
DIMENSION_TEXT = r"^(\d+'-\d+\"?|\d+\.?\d*\"|\d+\.?\d*'|\d+\.?\d*|\d+/\d+|\d+-\d+/\d+)$"
PIPE_SIZE_TEXT = r"^(\d+/\d+\"?|\d+\"|\d+-\d+/\d+\"?)$"


def measurement(text: Column) -> Column:
    """Struct (value, unit) of a measurement text; feet become inches, centimetres and metres become millimetres."""
    s = F.trim(text)
    rules = [
        (rf"^{NUM}['′]\s*[-\s]?\s*{NUM}?[\"″]?", lambda p: _n(s, p, 1) * 12.0 + F.coalesce(_n(s, p, 2), F.lit(0.0)), "inches"),
        (rf"(?i)^{NUM}\s*(?:[\"″]|in(?:ches?)?)", lambda p: _n(s, p, 1), "inches"),
        (rf"(?i)^{NUM}\s*(?:['′]|ft|feet)", lambda p: _n(s, p, 1) * 12.0, "inches"),
        (rf"(?i)^{NUM}\s*mm(?:illimeters?)?", lambda p: _n(s, p, 1), "mm"),
        (rf"(?i)^{NUM}\s*cm", lambda p: _n(s, p, 1) * 10.0, "mm"),
        (rf"(?i)^{NUM}\s*m(?!m)(?:eters?)?", lambda p: _n(s, p, 1) * 1000.0, "mm"),
        (rf"^{NUM}$", lambda p: _n(s, p, 1), "inches"),
    ]
    out = None
    for p, value, unit in rules:
        v = F.struct(value(p).alias("value"), F.lit(unit).alias("unit"))
        out = F.when(s.rlike(p), v) if out is None else out.when(s.rlike(p), v)
    return out


def _n(s: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(s, pattern, group).try_cast("double")


def scale_per_pixel(text: Column, dpi: Column) -> Column:
    """Struct (value, unit): real units per pixel of a scale note such as ``1/4" = 1'-0"`` or ``1:100``; the value
    is null where the note or the resolution is 0."""
    s = F.trim(text)
    frac = rf"^{NUM}\s*/\s*(\d+)\s*[\"″]\s*=\s*(\d+)\s*['′]\s*[-\s]?\s*(\d+)?\s*[\"″]?"
    simple = rf"^{NUM}\s*[\"″]\s*=\s*(\d+)\s*['′](?:\s*[-\s]?\s*(\d+)\s*[\"″]?)?"
    metric = r"^1\s*:\s*(\d+)"
    feet = lambda p, i: _n(s, p, i) * 12.0 + F.coalesce(_n(s, p, i + 1), F.lit(0.0))
    st = lambda v, u: F.struct(v.alias("value"), F.lit(u).alias("unit"))
    return (F.when(s.rlike(frac), st(F.try_divide(F.try_divide(feet(frac, 3), F.try_divide(_n(s, frac, 1), _n(s, frac, 2))), dpi), "inches"))
            .when(s.rlike(simple), st(F.try_divide(F.try_divide(feet(simple, 2), _n(s, simple, 1)), dpi), "inches"))
            .when(s.rlike(metric), st(F.try_divide(_n(s, metric, 1) * 25.4, dpi), "mm")))


# fixed values: sheet sizes in inches, in matching order
SHEETS = {
    "ARCH A": (9.0, 12.0), "ARCH B": (12.0, 18.0), "ARCH C": (18.0, 24.0), "ARCH D": (24.0, 36.0), "ARCH E": (36.0, 48.0),
    "ARCH E1": (30.0, 42.0), "ANSI A": (8.5, 11.0), "ANSI B": (11.0, 17.0), "ANSI C": (17.0, 22.0), "ANSI D": (22.0, 34.0),
    "ANSI E": (34.0, 44.0), "A0": (33.11, 46.81), "A1": (23.39, 33.11), "A2": (16.54, 23.39), "A3": (11.69, 16.54),
    "A4": (8.27, 11.69), "24X36": (24.0, 36.0), "30X42": (30.0, 42.0), "36X48": (36.0, 48.0)}


def sheet_size(text: Column, sheets: dict[str, tuple[float, float]] = SHEETS) -> Column:
    """Struct (width, height) in inches from a sheet name or ``24x36``."""
    s = F.upper(F.trim(text))
    out = None
    st = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    for name, (w, h) in sheets.items():
        t = F.contains(s, F.lit(name))
        v = st(F.lit(w), F.lit(h))
        out = F.when(t, v) if out is None else out.when(t, v)
    p = rf"{NUM}\s*[\"″]?\s*[xX×]\s*{NUM}\s*[\"″]?"
    return out.when(s.rlike(p), st(_n(s, p, 1), _n(s, p, 2)))


# fixed values: architectural and metric scale notes
SCALES = {'1:1': 1.0, '1/16"=1\'-0"': 192.0, '3/32"=1\'-0"': 128.0, '1/8"=1\'-0"': 96.0, '3/16"=1\'-0"': 64.0, '1/4"=1\'-0"': 48.0,
          '3/8"=1\'-0"': 32.0, '1/2"=1\'-0"': 24.0, '3/4"=1\'-0"': 16.0, '1"=1\'-0"': 12.0, '1-1/2"=1\'-0"': 8.0, '3"=1\'-0"': 4.0,
          "FULL": 1.0, "1:10": 10.0, "1:20": 20.0, "1:25": 25.0, "1:50": 50.0, "1:100": 100.0, "1:200": 200.0, "1:500": 500.0,
          "1:1000": 1000.0}


def named_scale(text: Column) -> Column:
    return F.coalesce(lookup(SCALES, F.upper(text)), F.lit(1.0))


# fixed values: unit factors
UNITS = {"inches|feet": 1 / 12, "inches|mm": 25.4, "inches|m": 0.0254, "feet|inches": 12.0, "feet|mm": 304.8, "feet|m": 0.3048,
         "mm|inches": 1 / 25.4, "mm|feet": 1 / 304.8, "mm|m": 0.001, "m|inches": 39.3701, "m|feet": 3.28084, "m|mm": 1000.0}


def convert_units(value: Column, source: Column, target: Column) -> Column:
    """Converted value; null for an unknown pair of units."""
    return value * F.when(source == target, F.lit(1.0)).otherwise(lookup(UNITS, F.concat_ws("|", source, target)))


def keyword_scores(text: Column, table: dict[str, list[tuple[str, float]]], word: bool = False) -> Column:
    """Array of (score, pos, label) structs, one per label, in one pass over the text."""
    rows = []
    for pos, (label, words) in enumerate(table.items()):
        score = F.lit(0.0)
        for w, weight in words:
            hit = text.rlike(r"\b" + _quote(w) + r"\b") if word else F.contains(text, F.lit(w))
            score = score + F.when(hit, F.lit(float(weight))).otherwise(F.lit(0.0))
        rows.append(F.struct(score.alias("score"), F.lit(-pos).alias("neg"), F.lit(label).alias("label")))
    return F.array(*rows)


def _quote(s: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in s)


def normalize_ocr(text: Column) -> Column:
    """Lower case, single spaces, and the two characters that scanners confuse."""
    return F.translate(F.lower(F.regexp_replace(F.trim(text), r"\s+", " ")), "|0", "lo")


def text_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, on already normalised text."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / n)


def tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def fill_template(template: Column, values: Column, keys: list[str]) -> Column:
    """Replaces ``{key}`` for the given keys; unknown keys stay."""
    out = template
    for k in keys:
        out = F.when(F.contains(out, F.lit("{" + k + "}")), F.replace(out, F.lit("{" + k + "}"), F.coalesce(
            values[k], F.lit("{" + k + "}")))).otherwise(out)
    return out


def format_length(m: Column) -> Column:
    return (F.when(m < 0.01, F.format_string("%.1fmm", m * 1000.0)).when(m < 1.0, F.format_string("%.1fcm", m * 100.0))
            .otherwise(F.format_string("%.2fm", m)))


def format_area(m2: Column) -> Column:
    return F.format_string("%.1fsqm", m2)


def prop(props: Column, *names: str) -> Column:
    """Property under any of its names, as written, lower or upper case."""
    keys = F.array(*[F.lit(v) for n in names for v in dict.fromkeys((n, n.lower(), n.upper()))])
    return F.get(F.array_compact(F.transform(keys, lambda k: F.try_element_at(props, k))), F.lit(0))


def describe_entity(kind: Column, layer: Column, props: Column, x: Column, y: Column) -> Column:
    """Sentence for a drawing entity, e.g. ``LINE on layer WALLS, length 10.50m, at (1.0, 2.0)``."""
    num = lambda *n: prop(props, *n).try_cast("double")
    size = lambda word, v: F.when(v != 0, F.concat(F.lit(word + " "), format_length(v)))
    text = F.coalesce(prop(props, "content"), prop(props, "text_string"))
    short = F.when(F.length(text) > 50, F.concat(F.substring(text, 1, 47), F.lit("..."))).otherwise(text)
    color = prop(props, "color")
    return F.concat_ws(
        ", ", F.concat(F.coalesce(kind, F.lit("Unknown")), F.lit(" on layer "), F.coalesce(layer, F.lit("0"))),
        F.when(kind.isin("LINE", "POLYLINE", "LWPOLYLINE"), size("length", num("length", "Length")))
        .when(kind.isin("CIRCLE", "ARC"), size("radius", num("radius", "Radius")))
        .when(kind.isin("TEXT", "MTEXT") & (text != ""), F.concat(F.lit("'"), short, F.lit("'")))
        .when(kind.isin("INSERT", "BLOCKREFERENCE"), F.concat(F.lit("block '"), prop(props, "block_name", "name"), F.lit("'")))
        .when(kind == "HATCH", F.concat(F.lit("pattern '"), prop(props, "pattern_name", "pattern"), F.lit("'"))),
        F.when(x.isNotNull() & y.isNotNull(), F.format_string("at (%.1f, %.1f)", x, y)),
        F.when(color.isNotNull() & ~color.isin("7", "256"), F.concat(F.lit("color "), color)))


def describe_component(category: Column, family: Column, type_name: Column, props: Column) -> Column:
    """Sentence for a building-model element, e.g. ``Walls: Basic - Generic, height 3.00m, on Level 1``."""
    num = lambda *n: prop(props, *n).try_cast("double")
    label = lambda word, v, f=format_length: F.when(v != 0, F.concat(F.lit(word), f(v)))
    pair = lambda a, b: F.when((a != 0) & (b != 0), F.concat(format_length(a), F.lit(" x "), format_length(b)))
    name = F.concat_ws(" - ", F.when(family != "", family), F.when(type_name != "", type_name))
    say = lambda word, v: F.when(v != "", F.concat(F.lit(word), v))
    extra = (F.when(category.isin("Walls", "Wall"), F.concat_ws(
        ", ", label("height ", num("Height", "Unconnected Height")), label("width ", num("Width", "Thickness")),
        say("fire rating: ", prop(props, "Fire Rating"))))
        .when(category.isin("Doors", "Door", "Windows", "Window"), pair(num("Width", "Rough Width"), num("Height", "Rough Height")))
        .when(category.isin("Rooms", "Room"), F.concat_ws(
            ", ", F.when(prop(props, "Name") != "", F.concat(F.lit("'"), prop(props, "Name"), F.lit("'"))),
            say("number ", prop(props, "Number")), label("area ", num("Area"), format_area)))
        .when(category.isin("Columns", "Column", "Structural Columns"), pair(num("b", "Width"), num("h", "Depth")))
        .when(category.isin("Floors", "Floor"), F.concat_ws(
            ", ", label("area ", num("Area"), format_area), label("thickness ", num("Thickness", "Default Thickness")))))
    return F.concat_ws(", ", F.concat_ws(": ", F.coalesce(category, F.lit("Unknown")), F.when(name != "", name)),
                       F.when(extra != "", extra), say("on ", prop(props, "level", "Level")), say("mark: ", prop(props, "Mark", "Tag")))


# fixed values: standard line weights in millimetres
LINEWEIGHTS = [0.0, 0.05, 0.09, 0.13, 0.15, 0.18, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.53, 0.6, 0.7, 0.8, 0.9, 1.0, 1.06, 1.2, 1.4,
               1.58, 2.0, 2.11]


def lineweight(mm: Column, table: list[float] = LINEWEIGHTS) -> Column:
    """Nearest standard weight (first of equals); 0 for widths that are not positive."""
    best = F.array_min(F.array(*[F.struct(F.abs(mm - w).alias("d"), F.lit(w).alias("w")) for w in table]))
    return F.when(mm <= 0, F.lit(0.0)).otherwise(best["w"])


def thickness_class(weight: Column) -> Column:
    return (F.when(weight <= 0.05, "hairline").when(weight <= 0.18, "thin").when(weight <= 0.35, "medium")
            .when(weight <= 0.70, "thick").otherwise("extra_thick"))


def thickness_layer(cls: Column) -> Column:
    return (F.when(cls.isin("extra_thick", "thick"), "A-WALL").when(cls == "medium", "A-FLOR")
            .when(cls == "thin", "A-ANNO-DIMS").otherwise("A-ANNO-NOTE"))


def linetype_of(dash_ratio: Column, gaps: Column, pattern: Column, min_gaps: int = 2, continuous: float = 0.95,
                dotted: float = 0.2, hidden=(0.4, 0.6), dashed=(0.6, 0.85)) -> Column:
    """Line type from the share of ink, the gap count and the dash (+) and gap (-) lengths."""
    dash = F.filter(pattern, lambda v: v > 0)
    n = F.size(dash)
    mean = F.aggregate(dash, F.lit(0.0), lambda s, v: s + v) / n
    var = F.aggregate(dash, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n
    mixed = (F.size(pattern) >= 6) & (n >= 2) & (var > mean * mean * 0.1)
    return (F.when((gaps < min_gaps) | (dash_ratio >= continuous), "CONTINUOUS")
            .when(mixed, F.when(F.size(pattern) >= 8, "PHANTOM").otherwise("CENTER"))
            .when(dash_ratio < dotted, "DOTTED").when(dash_ratio.between(*hidden), "HIDDEN")
            .when(dash_ratio.between(*dashed), "DASHED").otherwise("DASHED"))


def expand_shortcut(text: Column, expansion: Column) -> Column:
    """The first word replaced by its expansion (null = not a shortcut); the other words stay."""
    rest = F.slice(F.split(F.trim(text), r"\s+"), 2, 100000000)
    return F.when(expansion.isNull(), text).otherwise(F.trim(F.concat_ws(" ", expansion, F.array_join(rest, " "))))


def describe(kind: Column, layer: Column, text: Column) -> Column:
    return F.concat_ws(" ", kind, F.when(layer.isNotNull() & (layer != ""), F.concat(F.lit("on layer "), layer)),
                       F.when(text.isNotNull() & (text != ""), F.concat(F.lit("text: "), F.substring(text, 1, 50))))
