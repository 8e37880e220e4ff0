"""Fixed dimension tables: grades, specifications, bands, units and letters.  All are small and bounded."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


# Canonical grade, family group, aliases.  The order counts: contained aliases are listed in it.
GRADES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("S235JR", "structural_carbon", ("S235JR", "S235 JR", "S235", "S235JRH")),
    ("S275JR", "structural_carbon", ("S275JR", "S275 JR", "S275", "S275J0H")),
    ("S355JR", "structural_carbon", ("S355JR", "S355 JR")),
    ("S355J2", "structural_carbon", ("S355J2", "S355 J2", "S355J2H")),
    ("S355J2+N", "structural_carbon", ("S355J2+N", "S355 J2+N", "S355J2N")),
    ("API 5L X65", "line_pipe", ("API 5L X65", "API5L X65", "API 5LX65", "API5LX65", "X65", "L450")),
    ("S195", "pipe", ("S195", "EN 10255", "S195T")),
    ("SG2", "welding_wire", ("SG2", "NOVOFIL SG2", "NOVOBRONZE SG2")),
    ("B500B", "rebar", ("B 500 B", "B500B", "B 500B", "B500 B", "BST 500 B", "BST500B")),
    ("SRCDRW02", "demo_supported_known_grade", ("SRCDRW02", "SRC DRW02", "SRC-DRW02")),
    ("1.4301", "stainless_austenitic", ("1.4301", "14301", "X5CRNI18-10", "X5CRNI1810")),
    ("304", "stainless_austenitic", ("304", "AISI 304", "SS 304")),
    ("1.4307", "stainless_austenitic", ("1.4307", "14307", "X2CRNI18-9", "X2CRNI189")),
    ("304L", "stainless_austenitic", ("304L", "AISI 304L", "SS 304L")),
    ("1.4401", "stainless_austenitic", ("1.4401", "14401", "X5CRNIMO17-12-2", "X5CRNIMO17122")),
    ("316", "stainless_austenitic", ("316", "AISI 316", "SS 316")),
    ("1.4404", "stainless_austenitic", ("1.4404", "14404", "X2CRNIMO17-12-2", "X2CRNIMO17122")),
    ("316L", "stainless_austenitic", ("316L", "AISI 316L", "SS 316L")),
    ("TP304", "astm_pipe", ("TP304", "ASTM A312 TP304", "ASTM A213 TP304", "A312 TP304", "A213 TP304")),
    ("TP304L", "astm_pipe", ("TP304L", "ASTM A312 TP304L", "ASTM A213 TP304L", "A312 TP304L", "A213 TP304L")),
    ("TP316", "astm_pipe", ("TP316", "ASTM A312 TP316", "ASTM A213 TP316", "A312 TP316", "A213 TP316")),
    ("TP316L", "astm_pipe", ("TP316L", "ASTM A312 TP316L", "ASTM A213 TP316L", "A312 TP316L", "A213 TP316L")),
    ("317", "stainless_austenitic", ("317", "AISI 317", "SS 317")),
    ("317L", "stainless_austenitic", ("317L", "AISI 317L", "SS 317L")),
    ("TP317", "astm_pipe", ("TP317", "ASTM A312 TP317", "ASTM A213 TP317", "A312 TP317", "A213 TP317")),
    ("TP317L", "astm_pipe", ("TP317L", "ASTM A312 TP317L", "ASTM A213 TP317L", "A312 TP317L", "A213 TP317L")),
    ("TP321", "astm_pipe", ("TP321", "ASTM A312 TP321", "ASTM A213 TP321", "A312 TP321", "A213 TP321")),
    ("TP321H", "astm_pipe", ("TP321H", "ASTM A312 TP321H", "ASTM A213 TP321H", "A312 TP321H", "A213 TP321H")),
    ("347", "stainless_austenitic", ("347", "AISI 347", "SS 347", "1.4550", "14550")),
    ("316Ti", "stainless_austenitic", ("316TI", "316Ti", "1.4571", "14571")),
    ("347H", "stainless_austenitic", ("347H", "AISI 347H", "SS 347H")),
    ("TP347", "astm_pipe", ("TP347", "ASTM A312 TP347", "ASTM A213 TP347", "A312 TP347", "A213 TP347")),
    ("TP347H", "astm_pipe", ("TP347H", "ASTM A312 TP347H", "ASTM A213 TP347H", "A312 TP347H", "A213 TP347H")),
    ("1.4541", "stainless_austenitic", ("1.4541", "14541", "X6CRNITI18-10", "X6CRNITI1810")),
    ("321", "stainless_austenitic", ("321", "AISI 321", "SS 321", "UNS S32100", "S32100")),
    ("1.4878", "stainless_austenitic", ("1.4878", "14878", "X8CRNITI18-10", "X8CRNITI1810")),
    ("321H", "stainless_austenitic", ("321H", "AISI 321H", "SS 321H", "UNS S32109", "S32109")),
)

# Canonical grade, least yield, least and most tensile strength (MPa), least elongation (%).
SPECS: tuple[tuple[str, float, float, float, float], ...] = (
    ("S235JR", 235.0, 360.0, 510.0, 26.0),
    ("S275JR", 275.0, 410.0, 560.0, 23.0),
    ("S355JR", 355.0, 470.0, 630.0, 22.0),
    ("S355J2", 355.0, 470.0, 630.0, 22.0),
    ("S355J2+N", 355.0, 470.0, 630.0, 22.0),
    ("API 5L X65", 448.0, 531.0, 758.0, 18.0),
    ("SG2", 420.0, 500.0, 640.0, 22.0),
    ("S195", 195.0, 350.0, 620.0, 20.0),
    ("B500B", 500.0, 540.0, 2000.0, 0.0),
    ("SRCDRW02", 150.0, 250.0, 900.0, 0.0),
    ("1.4541", 205.0, 515.0, 750.0, 35.0),
    ("321", 205.0, 515.0, 750.0, 35.0),
    ("1.4878", 205.0, 515.0, 750.0, 35.0),
    ("321H", 205.0, 515.0, 750.0, 35.0),
)

# Field kind, least and most plausible value, both still plausible.
BANDS: dict[str, tuple[float, float]] = {"yield_mpa": (80.0, 1500.0), "tensile_mpa": (120.0, 1800.0), "elongation_pct": (1.0, 80.0)}
WIRE_BANDS: dict[str, tuple[float, float]] = {"yield_mpa": (0.0, 2500.0), "tensile_mpa": (1200.0, 2500.0), "elongation_pct": (0.0, 100.0)}

# Units of mass, their canonical name and kilograms.
MASS_UNITS: dict[str, tuple[str, float]] = (
    {u: ("kg", 1.0) for u in ("kg", "kgs", "kilogram", "kilograms")}
    | {u: ("g", 0.001) for u in ("g", "gram", "grams")}
    | {u: ("t", 1000.0) for u in ("t", "ton", "tons", "tonne", "tonnes", "mt")}
)

# Letters that a scan confuses in heat numbers, by shape.
HEAT_LOOKALIKES = ("0OD", "1IL", "5S", "6GB", "8B", "2Z")

# Outcomes that send a row to review.
REVIEW_OUTCOMES = ("NEEDS_REVIEW", "UNRESOLVED_SPEC", "UNSUPPORTED_SPEC_FAMILY", "UNSUPPORTED_DOCUMENT", "EXPLICIT_UNMAPPED_GRADE", "MISSING_CRITICAL_FIELD_GRADE")

# Look-alike characters inside identifiers; other than those of heat numbers.
IDENTIFIER_LOOKALIKES = ("O0", "IL1", "S5", "B8", "Z2", "G6")
RISKY_LETTERS = "OILSBZG"

# Canonical fields, their category and header synonyms.
HEADERS: dict[str, tuple[str, tuple[str, ...]]] = {
    "supplier_name": ("metadata", ("SUPPLIER", "MANUFACTURER", "PRODUCER", "COMPANY", "FIRMA")),
    "document_type": ("metadata", ("DOCUMENT TYPE", "CERTIFICATE TYPE", "DOC TYPE", "BELGE TIPI")),
    "certificate_date": ("metadata", ("DATE", "CERTIFICATE DATE", "ISSUE DATE", "TARIH")),
    "item_id": ("row", ("ITEM", "SIZE", "EBAT", "PROFILE", "PROFIL")),
    "heat_number": (
        "row",
        ("HEAT NO", "HEAT NUMBER", "HEAT#", "HEAT", "MELT NO", "MELT NUMBER", "SCHMELZE NO", "SCHMELZE NUMBER", "SCHMELZE", "DOKUM NO",
         "DOKUM NUMARASI", "DÖKÜM NO", "DÖKÜM NUMARASI"),
    ),
    "batch_number": ("metadata", ("BATCH NO", "BATCH NUMBER", "BATCH N", "BATCH N°", "BATCH", "PARTITA", "N PARTITA")),
    "lot_number": ("metadata", ("LOT", "LOT NO", "LOT NUMBER", "LOT N", "LOT N°", "LOTTO", "N LOTTO", "N. LOTTO")),
    "colata_number": ("metadata", ("COLATA", "N COLATA", "N. COLATA", "COLATA/BATCH", "COLATA NO", "COLATA N", "COLATA N°", "COLATA NUMBER")),
    "cast_number": ("metadata", ("CAST", "CAST NO", "CAST NUMBER")),
    "charge_number": ("metadata", ("CHARGE", "CHARGE NO", "CHARGE NUMBER")),
    "coil_number": ("row", ("COIL", "COIL NO", "COIL NUMBER")),
    "product_name": (
        "row",
        ("PRODUCT", "PRODUCT NAME", "PRODUCT DESCRIPTION", "MATERIAL NAME", "TRADE NAME", "DESCRIPTION", "PRODOTTO", "MATERIALE", "WARENBEZEICHNUNG",
         "ARTIKELBEZEICHNUNG", "PRODUCTO"),
    ),
    "grade": (
        "row",
        ("GRADE", "MATERIAL", "KALITE", "STEEL GRADE", "MATERIAL GRADE", "QUALITY", "QUALITA", "QUALITÀ", "QUALITE", "STAHLSORTE", "GUTE", "GÜTE"),
    ),
    "certificate_number": (
        "metadata",
        ("CERTIFICATE NO", "CERTIFICATE NUMBER", "CERTIFICATE N", "CERTIFICATE N°", "CERTIFICATE", "CERT NO", "CERT NUMBER", "CERT N", "CERT N°", "CERT",
         "CERTIFICATO", "CERTIFICATO NO", "CERTIFICATO N", "N CERTIFICATO", "ZERTIFIKAT NR", "ZEUGNIS NR"),
    ),
    "order_number": (
        "metadata",
        ("ORDER NO", "ORDER NUMBER", "ORDER N", "ORDER N°", "ORDER", "PURCHASE ORDER", "CUSTOMER ORDER", "CUSTOMER PO", "PO NO", "PO NUMBER", "PO N", "PO N°",
         "PO", "P.O.", "P.O. NO", "ORDINE", "ORDINE NO", "N ORDINE", "COMMESSA", "BESTELLUNG", "BESTELLNR", "AUFTRAG"),
    ),
    "order_date": ("metadata", ("ORDER DATE", "PO DATE", "P.O. DATE", "PURCHASE ORDER DATE", "CUSTOMER ORDER DATE", "DATA ORDINE", "DATA PO", "BESTELLDATUM")),
    "product_details": ("row", ("PRODUCT DETAILS", "PACKAGE", "PACKAGING", "PACKING", "PACKAGE DETAILS", "DETAIL", "DETAILS", "DETTAGLI", "IMBALLO")),
    "weight_or_length": ("row", ("WEIGHT", "LENGTH", "UZUNLUK", "AGIRLIK", "AĞIRLIK", "QTY")),
    "yield_strength_mpa": ("numeric", ("YIELD TS", "YIELD", "RE", "RP0.2", "RP 0.2", "RP 0,2")),
    "tensile_strength_mpa": ("numeric", ("TENSILE TS", "TENSILE", "RM")),
    "elongation_percentage": ("numeric", ("ELONGATION", "A%", "A %", "A")),
    "chemical_composition": ("row", ("CHEMICAL COMPOSITION", "CHEMISTRY", "CHEMICAL ANALYSIS", "CHEM COMPOSITION")),
    "dimensions": (
        "row",
        ("DIAMETER", "DIAM", "DIA", "DIMENSION", "DIMENSIONS", "NOMINAL DIAMETER", "NOMINAL SIZE", "DIAMETRO", "ABMESSUNG", "ABMESSUNGEN"),
    ),
    "standards": ("row", ("STANDARD", "STANDARDS", "NORMATIVE STANDARD", "NORM", "NORMA", "SPECIFICATION", "SPECIFICA")),
    "classifications": ("row", ("CLASSIFICATION", "CLASSIFICATIONS", "CLASSIFICAZIONE", "KLASSIFIZIERUNG")),
}

# Element symbols and their names.
ELEMENTS: dict[str, tuple[str, ...]] = {
    "C": ("CARBON",), "Si": ("SILICON",), "Mn": ("MANGANESE",), "P": ("PHOSPHORUS", "PHOSPHOROUS"), "S": ("SULPHUR", "SULFUR"),
    "Cu": ("COPPER",), "Ni": ("NICKEL",), "Cr": ("CHROMIUM",), "Mo": ("MOLYBDENUM",), "V": ("VANADIUM",), "Al": ("ALUMINIUM", "ALUMINUM"),
    "Nb": ("NIOBIUM", "COLUMBIUM"), "Ti": ("TITANIUM",), "N": ("NITROGEN",), "B": ("BORON",), "Fe": ("IRON",), "W": ("TUNGSTEN",),
    "Co": ("COBALT",), "Pb": ("LEAD",), "Sn": ("TIN",), "As": ("ARSENIC",), "Sb": ("ANTIMONY",), "Zr": ("ZIRCONIUM",), "Ca": ("CALCIUM",),
    "Mg": ("MAGNESIUM",), "Zn": ("ZINC",),
}


def header_key(text: str) -> str:
    """A synonym in the form that ``functions.text.normalize_header`` gives headers."""
    out = text.translate(str.maketrans("ÇĞİÖŞÜçğıöşü", "CGIOSUcgiosu")).upper().strip().replace(",", ".")
    for pattern, to in ((r"[/:;|]+", " "), (r"[_\-]+", " "), (r"\s+", " "), (r"\bRP\s*0[.,]?\s*2\b", "RP0.2"), (r"[^\w.%\s]+", ""), (r"\s+", " ")):
        out = re.sub(pattern, to, out)
    return out.strip()


HEADER_ROWS = [(h, f) for h, f in {header_key(h): f for f, (_, names) in HEADERS.items() for h in (f, *names)}.items()]
ELEMENT_ROWS = [(n, s) for s, names in ELEMENTS.items() for n in (s.upper(), *names)]


def alias_key(text: str) -> str:
    return "".join(c for c in text.strip().upper() if not c.isspace() and c not in "-_")


NAMED = {alias_key(alias): (canonical, group) for canonical, group, aliases in GRADES for alias in (canonical, *aliases)}
ALIAS_ROWS = [(key, canonical, group, ordinal) for ordinal, (key, (canonical, group)) in enumerate(NAMED.items())]


def grades(spark: SparkSession) -> DataFrame:
    """(alias_key, canonical, family_group, ordinal): one row for each way to write a grade."""
    return spark.createDataFrame(ALIAS_ROWS, "alias_key string, canonical string, family_group string, ordinal int")


def specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SPECS), "canonical string, min_yield double, min_tensile double, max_tensile double, min_elongation double")


def headers(spark: SparkSession) -> DataFrame:
    """(header, field): canonical names and synonyms in normalised form."""
    return spark.createDataFrame(HEADER_ROWS, "header string, field string")


def elements(spark: SparkSession) -> DataFrame:
    """(name, symbol): symbols in capitals and names of elements."""
    return spark.createDataFrame(ELEMENT_ROWS, "name string, symbol string")


def values_sql(rows, columns: str) -> str:
    """Rows as a SQL VALUES table, for the SQL counterparts of queries."""
    cell = lambda v: "NULL" if v is None else f"cast({v!r} AS DOUBLE)" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"
