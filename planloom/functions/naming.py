"""Layer, block, colour and system names per element kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planloom.functions.text import lookup

# fixed values: layer per element kind
LAYER = {
    "wall": "A-WALL", "door": "A-DOOR", "door_swing": "A-DOOR", "window": "A-GLAZ", "column": "A-COLS", "room": "A-AREA",
    "duct": "M-DUCT", "diffuser": "M-DIFF", "supply_diffuser": "M-DIFF-SUPP", "return_diffuser": "M-DIFF-RETN",
    "damper": "M-DAMP", "vav": "M-EQPM", "ahu": "M-EQPM", "wire": "E-POWR", "conduit": "E-COND", "outlet": "E-POWR-OUTL",
    "switch": "E-LITE-SWCH", "light": "E-LITE", "panel": "E-POWR-PANL", "pipe": "P-PIPE", "valve": "P-VALV",
    "fixture": "P-FIXT", "equipment": "P-EQPM", "sprinkler": "F-SPRL", "detector": "F-ALRM-DETC", "horn_strobe": "F-ANUN",
    "fire_alarm": "F-ALRM", "data": "T-DATA", "security": "T-SECU", "camera": "T-SECU-CCTV", "dimension": "G-ANNO-DIMS",
    "leader": "G-ANNO-LEAD", "note": "G-ANNO-NOTE", "title": "G-ANNO-TITL", "label": "G-ANNO-TEXT", "other": "0"}
TEXT_LAYER = {
    "room_name": "A-AREA-IDEN", "dimension": "G-ANNO-DIMS", "equipment_tag": "G-ANNO-TAGS", "note": "G-ANNO-NOTE",
    "title": "G-ANNO-TITL", "label": "G-ANNO-TEXT", "other": "G-ANNO-TEXT"}
SYMBOL_LAYER = {
    "diffuser": "M-DIFF", "outlet": "E-POWR-OUTL", "switch": "E-LITE-SWCH", "valve": "P-VALV", "fixture": "P-FIXT",
    "detector": "F-ALRM-DETC", "device": "E-POWR", "equipment": "M-EQPM", "other": "0"}
# fixed values: block per kind and subtype ("" = any)
BLOCK = {
    "diffuser|supply_square": "M-DIFF-SQ-S", "diffuser|supply_round": "M-DIFF-RD-S", "diffuser|supply_linear": "M-DIFF-LN-S",
    "diffuser|return_square": "M-DIFF-SQ-R", "diffuser|return_round": "M-DIFF-RD-R", "diffuser|exhaust": "M-DIFF-EXH",
    "diffuser|": "M-DIFF-GEN", "outlet|duplex": "E-OUTL-DUP", "outlet|gfci": "E-OUTL-GFCI", "outlet|quad": "E-OUTL-QUD",
    "outlet|floor": "E-OUTL-FLR", "outlet|dedicated": "E-OUTL-DED", "outlet|": "E-OUTL-GEN", "switch|single_pole": "E-SWCH-SP",
    "switch|three_way": "E-SWCH-3W", "switch|dimmer": "E-SWCH-DIM", "switch|": "E-SWCH-GEN", "valve|gate": "P-VALV-GATE",
    "valve|ball": "P-VALV-BALL", "valve|butterfly": "P-VALV-BTRF", "valve|check": "P-VALV-CHCK", "valve|globe": "P-VALV-GLOB",
    "valve|": "P-VALV-GEN", "fixture|sink": "P-FIXT-SINK", "fixture|toilet": "P-FIXT-WC", "fixture|lavatory": "P-FIXT-LAV",
    "fixture|urinal": "P-FIXT-URNL", "fixture|floor_drain": "P-FIXT-FD", "fixture|": "P-FIXT-GEN", "detector|smoke": "F-DETC-SMOK",
    "detector|heat": "F-DETC-HEAT", "detector|duct": "F-DETC-DUCT", "detector|": "F-DETC-GEN", "horn_strobe|": "F-ANUN-HS",
    "sprinkler|pendant": "F-SPKL-PND", "sprinkler|upright": "F-SPKL-UPR", "sprinkler|sidewall": "F-SPKL-SID",
    "sprinkler|": "F-SPKL-GEN", "data|rj45": "T-DATA-RJ45", "data|": "T-DATA-GEN", "camera|dome": "T-SECU-CAM-D",
    "camera|bullet": "T-SECU-CAM-B", "camera|": "T-SECU-CAM", "equipment|": "EQ-GEN", "device|": "DEV-GEN"}
# fixed values: system per element kind
SYSTEM = {
    "valve": "domestic_cold_water", "pipe": "domestic_cold_water", "fitting": "domestic_cold_water", "duct": "supply_air",
    "diffuser": "supply_air", "grille": "return_air", "register": "supply_air", "damper": "supply_air", "ahu": "supply_air",
    "vav": "supply_air", "fcu": "supply_air", "outlet": "power", "receptacle": "power", "switch": "lighting", "light": "lighting",
    "panel": "power", "transformer": "power", "smoke_detector": "fire_alarm", "heat_detector": "fire_alarm",
    "pull_station": "fire_alarm", "horn_strobe": "fire_alarm", "sprinkler": "fire_suppression", "fixture": "sanitary",
    "floor_drain": "sanitary", "cleanout": "sanitary", "data_outlet": "data", "camera": "security", "card_reader": "security",
    "speaker": "audio_visual"}
# fixed values: discipline per element kind, else per system
DISCIPLINE = {
    "duct": "mechanical", "diffuser": "mechanical", "grille": "mechanical", "damper": "mechanical", "ahu": "mechanical",
    "vav": "mechanical", "fcu": "mechanical", "outlet": "electrical", "receptacle": "electrical", "switch": "electrical",
    "light": "electrical", "panel": "electrical", "conduit": "electrical", "valve": "plumbing", "pipe": "plumbing",
    "fixture": "plumbing", "floor_drain": "plumbing", "smoke_detector": "fire", "heat_detector": "fire", "sprinkler": "fire",
    "pull_station": "fire", "horn_strobe": "fire", "data_outlet": "low_voltage", "camera": "low_voltage",
    "card_reader": "low_voltage", "speaker": "low_voltage"}
SYSTEM_DISCIPLINE = {
    "supply_air": "mechanical", "return_air": "mechanical", "exhaust_air": "mechanical", "chilled_water": "mechanical",
    "hot_water_heating": "mechanical", "domestic_cold_water": "plumbing", "domestic_hot_water": "plumbing",
    "sanitary": "plumbing", "power": "electrical", "lighting": "electrical", "fire_alarm": "fire", "fire_suppression": "fire",
    "data": "low_voltage", "security": "low_voltage"}


# fixed values: layer stem and colour per system
SYSTEM_LAYER = {
    "supply_air": ("M-HVAC", 5), "return_air": ("M-HVAC", 4), "exhaust_air": ("M-HVAC", 6), "outside_air": ("M-HVAC", 3),
    "chilled_water": ("M-HVAC", 5), "hot_water_heating": ("M-HVAC", 1), "steam": ("M-HVAC", 1), "condensate": ("M-HVAC", 2),
    "refrigerant": ("M-HVAC", 4), "domestic_cold_water": ("P-DOMW", 5), "domestic_hot_water": ("P-DOMW", 1),
    "sanitary": ("P-SNTY", 3), "vent": ("P-VENT", 6), "storm_drain": ("P-STRM", 4), "natural_gas": ("P-NGAS", 2),
    "power": ("E-POWR", 1), "lighting": ("E-LITE", 2), "emergency_power": ("E-EMER", 1), "grounding": ("E-GRND", 3),
    "fire_alarm": ("F-ALRM", 1), "fire_suppression": ("F-SPKL", 1), "fire_standpipe": ("F-STPF", 1), "data": ("T-DATA", 5),
    "voice": ("T-VOIC", 3), "security": ("T-SECR", 1), "audio_visual": ("T-AUDV", 6)}
DISCIPLINE_PREFIX = {"architectural": "A", "mechanical": "M", "electrical": "E", "plumbing": "P", "fire": "F",
                     "low_voltage": "T", "civil": "C", "structural": "S"}
SUFFIX = {
    "duct": "DUCT", "diffuser": "DIFF", "grille": "GRIL", "register": "REGI", "damper": "DAMP", "ahu": "EQPM", "fan": "EQPM",
    "vav": "EQPM", "fcu": "EQPM", "coil": "EQPM", "pump": "EQPM", "pipe": "PIPE", "valve": "VALV", "fitting": "FTTG",
    "fixture": "FIXT", "floor_drain": "DRAN", "cleanout": "CLEN", "water_heater": "EQPM", "outlet": "OUTL", "switch": "SWTC",
    "panel": "PANL", "transformer": "XFMR", "motor": "MOTR", "light": "FIXT", "receptacle": "RCPT", "junction_box": "JBOX",
    "conduit": "COND", "wire": "WIRE", "smoke_detector": "DETC", "heat_detector": "DETC", "pull_station": "ANUN", "horn_strobe": "ANUN",
    "sprinkler": "SPKL", "fire_extinguisher": "EXTN", "fdc": "CONN", "data_outlet": "OUTL", "camera": "SECU", "card_reader": "SECU",
    "speaker": "AUDV"}
# fixed values: block of the built-in standards per kind and subtype ("" = any)
STANDARD_BLOCK = {
    "valve|gate": "P-VALV-GATE", "valve|ball": "P-VALV-BALL", "valve|butterfly": "P-VALV-BTRF", "valve|globe": "P-VALV-GLOB",
    "valve|check": "P-VALV-CHEK", "valve|pressure_reducing": "P-VALV-PRV", "valve|pressure_relief": "P-VALV-PRF",
    "valve|balancing": "P-VALV-BAL", "valve|control": "P-VALV-CTRL", "valve|solenoid": "P-VALV-SOL", "valve|": "P-VALV",
    "diffuser|square": "M-DIFF-SQ", "diffuser|round": "M-DIFF-RD", "diffuser|linear": "M-DIFF-LN", "diffuser|slot": "M-DIFF-SLOT",
    "diffuser|perforated": "M-DIFF-PERF", "diffuser|": "M-DIFF",
    "grille|return": "M-GRIL-RTN", "grille|transfer": "M-GRIL-XFR", "grille|exhaust": "M-GRIL-EXH", "grille|": "M-GRIL",
    "damper|fire": "M-DAMP-FIRE", "damper|smoke": "M-DAMP-SMOK", "damper|volume": "M-DAMP-VOL", "damper|backdraft": "M-DAMP-BD", "damper|": "M-DAMP",
    "outlet|duplex": "E-OUTL-DUP", "outlet|quad": "E-OUTL-QUAD", "outlet|gfci": "E-OUTL-GFCI", "outlet|dedicated": "E-OUTL-DED",
    "outlet|floor": "E-OUTL-FLR", "outlet|": "E-OUTL",
    "switch|single": "E-SWTC-1P", "switch|3way": "E-SWTC-3W", "switch|4way": "E-SWTC-4W", "switch|dimmer": "E-SWTC-DIM",
    "switch|occupancy": "E-SWTC-OCC", "switch|": "E-SWTC",
    "light|recessed": "E-LITE-REC", "light|pendant": "E-LITE-PND", "light|surface": "E-LITE-SRF", "light|linear": "E-LITE-LIN",
    "light|emergency": "E-LITE-EMR", "light|exit": "E-LITE-EXIT", "light|": "E-LITE",
    "smoke_detector|photoelectric": "F-DETC-SMOK-P", "smoke_detector|ionization": "F-DETC-SMOK-I", "smoke_detector|duct": "F-DETC-SMOK-D",
    "smoke_detector|": "F-DETC-SMOK",
    "heat_detector|fixed_temp": "F-DETC-HEAT-FT", "heat_detector|rate_of_rise": "F-DETC-HEAT-RR", "heat_detector|": "F-DETC-HEAT",
    "horn_strobe|wall": "F-ANUN-HS-W", "horn_strobe|ceiling": "F-ANUN-HS-C", "horn_strobe|": "F-ANUN-HS", "pull_station|": "F-ANUN-PULL",
    "sprinkler|pendant": "F-SPKL-PND", "sprinkler|upright": "F-SPKL-UPR", "sprinkler|sidewall": "F-SPKL-SW",
    "sprinkler|concealed": "F-SPKL-CON", "sprinkler|": "F-SPKL",
    "fixture|water_closet": "P-FIXT-WC", "fixture|lavatory": "P-FIXT-LAV", "fixture|sink": "P-FIXT-SINK", "fixture|urinal": "P-FIXT-URN",
    "fixture|shower": "P-FIXT-SHWR", "fixture|drinking_fountain": "P-FIXT-DF", "fixture|": "P-FIXT",
    "data_outlet|rj45": "T-DATA-RJ45", "data_outlet|fiber": "T-DATA-FBR", "data_outlet|": "T-DATA",
    "camera|dome": "T-SECU-CAM-D", "camera|ptz": "T-SECU-CAM-PTZ", "camera|bullet": "T-SECU-CAM-B", "camera|": "T-SECU-CAM",
    "card_reader|": "T-SECU-CRDR", "speaker|": "T-AUDV-SPKR"}
# fixed values: attributes of the built-in standards, empty until they are filled in
ATTRIBUTES = {
    "valve": ["SIZE", "TYPE", "TAG"], "diffuser": ["SIZE", "CFM", "TAG"], "grille": ["SIZE", "CFM", "TAG"], "outlet": ["CIRCUIT", "VOLTAGE", "TAG"],
    "light": ["WATTS", "TYPE", "TAG"], "smoke_detector": ["ZONE", "ADDRESS", "TAG"], "sprinkler": ["SIZE", "K_FACTOR", "TAG"],
    "fixture": ["MODEL", "GPM", "TAG"]}


def default_layer(kind: Column, system: Column, discipline: Column) -> Column:
    """Layer by built-in naming: stem of the system, else prefix of the discipline, then the kind's suffix."""
    stem = F.coalesce(lookup({k: v[0] for k, v in SYSTEM_LAYER.items()}, system), lookup(DISCIPLINE_PREFIX, discipline), F.lit("0"))
    return F.concat_ws("-", stem, lookup(SUFFIX, kind))


def color_for(system: Column) -> Column:
    return F.coalesce(lookup({k: v[1] for k, v in SYSTEM_LAYER.items()}, system), F.lit(7))


def name_key(c: Column) -> Column:
    return F.translate(F.lower(c), "- ", "__")


def layer_for(kind: Column, subtype: Column | None = None) -> Column:
    k = name_key(kind)
    both = lookup(LAYER, F.concat(k, F.lit("_"), name_key(subtype))) if subtype is not None else F.lit(None)
    return F.coalesce(both, lookup(LAYER, k), F.lit("0"))


def text_layer_for(kind: Column) -> Column:
    return F.coalesce(lookup(TEXT_LAYER, name_key(kind)), F.lit("G-ANNO-TEXT"))


def symbol_layer_for(kind: Column) -> Column:
    return F.coalesce(lookup(SYMBOL_LAYER, name_key(kind)), F.lit("0"))


def block_for(kind: Column, subtype: Column) -> Column:
    k, s = name_key(kind), name_key(subtype)
    return F.coalesce(lookup(BLOCK, F.concat(k, F.lit("|"), s)), lookup(BLOCK, F.concat(k, F.lit("|"))),
                      F.concat(F.upper(k), F.lit("-"), F.coalesce(F.upper(s), F.lit("GEN"))))


def standard_block(kind: Column, subtype: Column) -> Column:
    """Block of the built-in standards: of the subtype, else of the kind, else null."""
    return F.coalesce(lookup(STANDARD_BLOCK, F.concat(kind, F.lit("|"), subtype)), lookup(STANDARD_BLOCK, F.concat(kind, F.lit("|"))))


def standard_attributes(kind: Column, size: Column | None = None) -> Column:
    """Attributes of the built-in standards as a map; a size fills in SIZE, all others are empty."""
    given = F.coalesce(size, F.lit("")) if size is not None else F.lit("")
    filled = {k: F.create_map(*[x for n in names for x in (F.lit(n), given if n == "SIZE" else F.lit(""))]) for k, names in ATTRIBUTES.items()}
    out = F.create_map().cast("map<string,string>")
    for k, attributes in filled.items():
        out = F.when(kind == k, attributes).otherwise(out)
    return out


def infer_system(kind: Column) -> Column:
    return F.coalesce(lookup(SYSTEM, kind), F.lit("unknown"))


def infer_discipline(kind: Column, system: Column) -> Column:
    return F.coalesce(lookup(DISCIPLINE, kind), lookup(SYSTEM_DISCIPLINE, system), F.lit("unknown"))


def region_layer(reason: Column, pattern: Column, drawing_type: Column, kind: Column) -> Column:
    """Layer of a region from its stated reason or pattern, else from the drawing type."""
    r, p, d = (F.lower(F.coalesce(c, F.lit(""))) for c in (reason, pattern, drawing_type))
    has = lambda w: F.contains(r, F.lit(w)) | F.contains(p, F.lit(w))
    pick = lambda line, other: F.when(kind == "line", line).otherwise(other)
    return (F.when(has("wall"), "A-WALL").when(has("duct"), "M-DUCT").when(has("pipe"), "P-PIPE")
            .when(F.contains(r, F.lit("wire")) | F.contains(p, F.lit("electrical")), "E-POWR")
            .when(F.contains(r, F.lit("column")), "A-COLS")
            .when(d == "mechanical", pick("M-DUCT", "M-EQPM")).when(d == "electrical", pick("E-POWR", "E-POWR-OUTL"))
            .when(d == "plumbing", pick("P-PIPE", "P-FIXT")).when(d == "fire_alarm", pick("F-ALRM", "F-ALRM-DETC"))
            .otherwise("0"))
