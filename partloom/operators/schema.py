"""Fixed target schema and small catalogs of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Target fields in order (name, type, required).
TARGET_FIELDS = [
    ("Detail Number", "string", True),
    ("Customer Part Number", "string", False),
    ("Higher index available", "string", False),
    ("Design Count", "integer", True),
    ("Spare Count", "integer", False),
    ("Description", "string", True),
    ("Dimensions X/D", "decimal", False),
    ("Dimensions Y/L", "decimal", False),
    ("Dimensions Z", "decimal", False),
    ("Material", "string", False),
    ("Parts Group", "string", False),
    ("2D exists", "string", False),
    ("3D exists", "string", False),
    ("Hardness", "string", False),
    ("Nitriding", "string", False),
    ("Nitriding type", "string", False),
    ("Nitriding depth", "string", False),
    ("Coating", "string", False),
    ("Manufacturer", "string", False),
    ("Manufacturer officially required", "string", False),
    ("Manufacturer part no.", "string", False),
    ("Tooling Standard", "string", False),
    ("Target cost block description", "string", False),
    ("Special Notes", "string", False),
    ("Refurbishment", "string", False),
    ("Pre assembling", "string", False),
    ("What has been changed?", "string", False),
    ("Detailed Drawing", "string", False),
    ("Drawings sent to STL", "string", False),
    ("Drawings sent from STL", "string", False),
]
DIMENSION_FIELDS = {"Dimensions X/D": "x", "Dimensions Y/L": "y", "Dimensions Z": "z"}

# Quality of a transform method in the rule score (others .50).
METHOD_QUALITY = {
    "master_data:exact_alias": 1.0,
    "master_data:exact": 1.0,
    "master_data:fuzzy_alias": 0.95,
    "master_data:fuzzy_material": 0.92,
    "master_data:werkstoff_nr_extract": 0.95,
    "master_data:werkstoff_nr_base": 0.90,
    "master_data:werkstoff_nr_format": 0.90,
    "master_data:werkstoff_nr_stripped": 0.75,
    "integer_coerce": 0.95,
    "decimal_coerce": 0.90,
    "boolean_normalize": 0.95,
    "regex_parse": 0.85,
    "dimension_split": 0.85,
    "text_cleanup": 0.80,
    "master_data:substring": 0.60,
    "extracted_from_material": 0.55,
    "passthrough": 0.82,
    "empty": 0.0,
}
# Methods that count as verified on the text path.
VERIFIED_METHODS = (
    "master_data:exact_alias",
    "master_data:exact",
    "master_data:werkstoff_nr_extract",
    "master_data:werkstoff_nr_base",
    "master_data:werkstoff_nr_format",
    "integer_coerce",
    "decimal_coerce",
    "boolean_normalize",
    "regex_parse",
    "dimension_split",
)
# Categories of fields.
CATEGORY_A = (
    "Detail Number", "Design Count", "Spare Count", "Dimensions X/D", "Dimensions Y/L", "Dimensions Z", "Material", "Hardness", "Nitriding",
    "Nitriding type", "Nitriding depth", "Coating", "Parts Group", "Customer Part Number", "Manufacturer part no.",
)
CATEGORY_B = ("Description", "Manufacturer", "Special Notes", "Target cost block description")
BOOLEAN_FIELDS = (
    "Nitriding", "2D exists", "3D exists", "Higher index available", "Manufacturer officially required", "Tooling Standard", "Refurbishment",
    "Pre assembling", "Detailed Drawing", "Drawings sent to STL", "Drawings sent from STL",
)
POSITION_FIELDS = ("Detail Number", "Position")
# Part group codes.
PART_GROUPS = ("D2", "F", "U", "E", "K1", "K2", "N", "S", "B", "BB", "A", "H", "D1", "NB", "STS", "TB", "V")
# Canonical coatings and nitriding types with their aliases.
COATING_ALIASES = {
    "BALINIT ALCRONA PRO": ["BALINIT", "ALCRONA", "Alcrona Pro", "Balinit Alcrona"],
    "Duplex Tigral": ["Tigral", "Tigral Duplex", "Duplex"],
    "PVD": ["PVD", "pvd", "PVD coating", "PVD Beschichtung"],
    "CVD": [],
    "DLC": ["DLC", "Diamond Like Carbon"],
    "CrN": ["CrN", "Chromnitrid", "Chrome Nitride"],
    "TiN": ["TiN", "Titannitrid", "Titanium Nitride"],
    "TiAlN": ["TiAlN", "Titan-Aluminium-Nitrid"],
}
NITRIDING_ALIASES = {
    "Plasmanitrieren": ["plasmanitrided", "plasma nitriding", "plasma nitriert", "ion nitriding", "Ionennitrieren", "NITEMPER"],
    "Gasnitrieren": ["gas nitriding", "Gasnitrieren", "gas nitriert", "Nitralox"],
    "Salzbadnitrieren": ["salt bath nitriding", "Salzbadnitrieren", "Tenifer", "QPQ"],
    "Einsatzhärten": ["case hardening", "Einsatzhärten", "carbonitriding"],
}
#: Our own small catalog of manufacturers; matched by name alone, never by likeness.
MANUFACTURERS = {"Normteile Nord": ["normteile nord gmbh", "NTN"], "Werkzeugbau Sued": ["werkzeugbau sued ag"], **{f"Supplier#{i:09d}": [] for i in range(1, 101)}}
#: Our own small material catalog (number, canonical name, aliases, hardness range in HRC, family).
MATERIALS = [
    ("1.2343", "1.2343 (X37CrMoV5-1)", ["X37CrMoV5-1", "H11"], (44, 48), "steel"),
    ("1.2344", "1.2344 (X40CrMoV5-1)", ["X40CrMoV5-1", "H13"], (44, 50), "steel"),
    ("1.2738", "1.2738 (40CrMnNiMo8-6-4)", ["40CrMnNiMo8-6-4", "P20+Ni"], (28, 34), "steel"),
    ("1.2311", "1.2311 (40CrMnMo7)", ["40CrMnMo7", "P20"], (28, 34), "steel"),
    ("3.3547", "AlMg4,5Mn", ["AlMg4,5Mn", "EN AW-5083"], None, "aluminium"),
]


def alias_rows(catalog: str) -> list[tuple[str, str]]:
    """(key, canonical): canonical names first, then aliases; a later entry of a key wins."""
    out: dict[str, str] = {}
    key = lambda s: " ".join(s.lower().split())
    if catalog == "material":
        for number, name, aliases, _, _ in MATERIALS:
            out[key(name)] = name
            out[key(number)] = name
            for a in aliases:
                out[key(a)] = name
    else:
        source = {"coating": COATING_ALIASES, "nitriding": NITRIDING_ALIASES, "manufacturer": MANUFACTURERS}[catalog]
        for name, aliases in source.items():
            out[key(name)] = name
            for a in aliases:
                out[key(a)] = name
        for name in source:
            out[key(name)] = name
    return list(out.items())


def alias_table(spark: SparkSession, catalog: str) -> DataFrame:
    return spark.createDataFrame(alias_rows(catalog), "alias string, canonical string")


def target_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *f) for i, f in enumerate(TARGET_FIELDS)], "ord int, field string, type string, required boolean")
