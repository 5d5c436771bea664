"""Fixed values.

Everything in this file is data that has to agree with the feed being processed: prefixes, word lists, lookup tables,
thresholds, patterns and output formats. No logic lives here.
"""

from __future__ import annotations

# --- identity -------------------------------------------------------------------------------------------------------
SKU_PREFIX = "CSF-"
DEFAULT_MANUFACTURER = "CSF"
DEFAULT_CATEGORY = "Unknown"
EXPORT_VERSION = "1.0"
HIERARCHY_STRUCTURE = "year > make > model > parts"

# --- field limits ---------------------------------------------------------------------------------------------------
SKU_MAX = 100
NAME_MAX = 500
MAKE_MODEL_MAX = 100
SUBMODEL_MAX = 100
ENGINE_MAX = 100
FUEL_MAX = 50
ASPIRATION_MAX = 50
TRANSMISSION_BELOW = 50
PRICE_MAX = 50000
PRICE_DECIMALS = 2
YEAR_FIELD_MIN, YEAR_FIELD_MAX = 1900, 2030
YEAR_MIN = 1950
YEARS_AHEAD = 2
IMPORT_YEAR_MIN, IMPORT_YEAR_MAX = 1900, 2100

# --- paging and thresholds ------------------------------------------------------------------------------------------
PER_PAGE_DEFAULT = 20
PER_PAGE_MAX = 100
ADMIN_PER_PAGE = 20
SUGGEST_LIMIT = 10
EXCERPT_WORDS = 20
URLS_PER_PAGE = 2000
MAX_BADGES = 4
TOP_MAKES = 10
LOG_ENTRIES = 50
KEY_SPEC_LIMIT = 8
FAILURE_RATE_MAX = 0.05
HEALTH_MAX_AGE_SECONDS = 86400
HEALTH_MIN_PARTS = 1700
HEALTH_MAX_NEW = 100
MARKETING_MIN_CHARS = 10

# --- sort keys that callers may ask for -----------------------------------------------------------------------------
CATALOG_SORT_KEYS = ("name", "sku", "category", "created_at", "updated_at", "latest")
ADMIN_SORT_KEYS = ("sku", "name", "category", "last_synced", "updated_at", "created_at")

# --- make dimension used when discovery finds nothing ---------------------------------------------------------------
MAKES = {
    1: "Nissan", 2: "Ford", 3: "Honda", 4: "Toyota", 5: "Scion", 6: "Mazda", 7: "Lexus", 8: "Kia", 9: "Hyundai",
    10: "Dodge", 11: "Chevrolet", 12: "GMC", 13: "Buick", 14: "Peterbilt", 15: "Kenworth", 16: "International",
    17: "Freightliner", 18: "Lincoln", 19: "Ram", 20: "Mercury", 21: "Volvo", 22: "Subaru", 23: "Jeep",
    24: "Volkswagen", 25: "Mercedes-Benz", 26: "Mitsubishi", 27: "INFINITI", 28: "Land Rover", 29: "Chrysler",
    30: "Pontiac", 31: "Saturn", 32: "BMW", 33: "Audi", 34: "Cadillac", 35: "Fiat", 36: "Acura", 37: "Hummer",
    38: "Isuzu", 39: "Mack", 40: "Sterling Truck", 41: "Suzuki", 42: "Porsche", 43: "Jaguar", 44: "Mini",
    45: "Oldsmobile", 46: "Plymouth", 47: "Saab", 48: "Geo", 49: "Daewoo", 50: "Eagle", 51: "Tesla",
}

# --- page markers ---------------------------------------------------------------------------------------------------
PART_MARKERS = (".row.app", "row app")
SELLING_MARKER = "selling-part"
GALLERY_CATALOG = "catalog196"
GALLERY_SIZE = "/large/"
YEAR_LINK = "get_model_by_make_year"
MODEL_LINK = "/applications/"
MAKE_LINK = "get_year_by_make"
INTERCHANGE_HEADERS = ("Reference Number", "Reference Name")
VEHICLE_HEADERS = ("Make", "Model")
TECH_NOTE_KEY = "Tech Note"

# --- engine text: labels, makers and cut-off points (all case-insensitive) ------------------------------------------
ENGINE_LABELS = (
    r"^TRANSMISSION\s+CONTROL\s+TYPE:\s*",
    r"^ENG\.\s*BASE:\s*",
    r"^ENGINE:\s*",
    r"Eng\.\s+Version:\s*",
)
ENGINE_MAKERS = ("DENSO", "TOYO", "BEHR", "VALEO", "MODINE", "NISSENS", "DELPHI", "MAHLE", "CALSONIC")
ENGINE_CUTOFFS = (
    r"Body\s+Type:",
    r"OE\s+Style",
    r"Use\s+Mini",
    r"Mini,",
    r"Micro,",
    r"\d+\s+psi",
    r"Radiator\s+&",
    r"Radiator\s+And",
    r"Transmission\s+#\s+of\s+Speeds:",
    r"w/\s*Variable",
    r"w/o\s*Variable",
    r"NBR\s+OF\s+DOORS:",
    r"VALVES\s+PER\s+ENGINE:",
    r"ITEM\s+DETAIL",
    r"UPGRADED",
)

# --- engine text: things that belong to other fields (all case-insensitive) -----------------------------------------
ASPIRATION_WORDS = (
    r"Turbocharged",
    r"Supercharged",
    r"Naturally Aspirated",
    r"EcoBoost",
    r"w\/\s*EcoBoost(?:\s+Engine)?",
)
FUEL_TEXT = r"Fuel Type:\s*\w+"
RADIATOR_POSITION_TEXT = r"(?:Primary|Secondary)\s+Radiator"
DUTY_TEXT = r"\b(?:Std|Standard|Heavy|Max)\s+Duty"
MULTIFIT_TEXT = r"Multi-fit\s+Model"
PACKAGE_TEXT = r"\s*Pkg\s*"
ENGINE_PACKAGES = (
    r"w\/\s*(?:Heavy Duty |Max Duty )?Towing(?:\s+Package)?",
    r"w\/o\s*Towing(?:\s+Package)?",
    r"w\/\s*Off-Road(?:\s+Package)?",
    r"w\/o\s*Off-Road(?:\s+Package)?",
    r"w\/\s*Ambulance(?:\s+Package)?",
    r"w\/o\s*Ambulance(?:\s+Package)?",
    r"w\/\s*Air\s+Conditioning",
    r"w\/\s*Tow\s+Package",
    r"w\/o\s*Tow\s+Package",
)
PRODUCT_SPECS = (
    r"w\/\s*SUB COOL[^w]*",
    r"w\/\s*Heavy Duty Cooling[^w]*",
    r"w\/\s*Standard Duty Cooling[^w]*",
    r"w\/\s*\d+\s*Plate[^w]*",
    r"w\/\s*Plate\s+Type[^w]*",
    r"w\/\s*Built-In Oil Cooler[^w]*",
    r"OE\s+\d+mm[^w]*",
    r"\d+%\s+(?:Stronger|Thicker)[^w]*",
    r"High-Efficiency[^w]*",
    r"B-Tube Technology[^w]*",
    r"Includes\s+[^w]+",
    r"w\/\s*\d+\s+Speed",
    r"w\/\s*\d+\s+Plate",
)

# --- vehicle qualifiers found in listing text -----------------------------------------------------------------------
QUALIFIER_PATTERNS = (
    r"(w\/\s*(?:Heavy Duty |Max Duty )?Towing(?:\s+Package)?)",
    r"(w\/o\s*Towing(?:\s+Package)?)",
    r"(w\/\s*Tow\s+Package)",
    r"(w\/o\s*Tow\s+Package)",
    r"(w\/\s*Off-Road(?:\s+Package)?)",
    r"(w\/o\s*Off-Road(?:\s+Package)?)",
    r"(w\/\s*Ambulance(?:\s+Package)?)",
    r"(w\/o\s*Ambulance(?:\s+Package)?)",
    r"(w\/\s*Air\s+Conditioning)",
)
ENGINE_FIELD = r"Eng\.\s*Base:\s*([^\n]+?)(?:\n|Transmission|Fuel Type|Aspiration|Item Detail|Upgraded|Denso|$)"
ASPIRATION_FIELD = r"Aspiration:\s*([^\n]+?)(?:\n|Item Detail|Upgraded|Denso|$)"
TRANSMISSION_FIELD = r"Transmission\s+Control\s+Type:\s*([^\n]+?)(?:\n|Item Detail|Upgraded|Denso|$)"
NOT_APPLICABLE = ("not applicable", "n/a")
ECOBOOST = "EcoBoost"

# --- volatile page content blanked before hashing -------------------------------------------------------------------
VOLATILE_TOKENS = (
    (r'content="[A-Za-z0-9+/=]+"', 'content=""'),
    (r'value="[A-Za-z0-9+/=]+"', 'value=""'),
)
SIGNED_URL_QUERY = r"""\?X-Amz-[^"']+"""

# --- dropdown responses ---------------------------------------------------------------------------------------------
HTML_CALL = r'\.html\("(.+?)"\)'

# --- import cleanup -------------------------------------------------------------------------------------------------
CATEGORY_ALIASES = {"Drive Motor Inverter Cooler": "Inverter Cooler"}
RELATIVE_IMAGE = r"^https?://.*/(images/avif/.+)$"
IMAGE_ROOT = "images/"
SKU_FORMAT = r"^CSF-\d+$"
PART_NUMBER_KEY = r"^(CSF-?)?\d+$"

# --- content fields -------------------------------------------------------------------------------------------------
HASH_FIELDS = (
    "category", "features", "images", "in_stock", "manufacturer", "name", "position", "price", "sku", "specifications",
)
CONTENT_FIELDS = (
    "sku", "name", "description", "short_description", "category", "price", "manufacturer", "in_stock", "position",
    "specifications", "features", "tech_notes", "compatibility", "images", "interchange_numbers", "scraped_at",
)
IMPORT_SAMPLE_FIELDS = ("sku", "name", "price", "category", "manufacturer", "in_stock", "description")

# --- presentation ---------------------------------------------------------------------------------------------------
KEY_SPECS = {
    "Construction": ("Construction",),
    "Core Length": ("Core Length (in)", "Core Length"),
    "Core Thickness": ("Core Thickness (in)", "Core Thickness"),
    "Core Width": ("Core Width (in)", "Core Width"),
    "Flow": ("Flow", "Flow Type", "Flow Direction", "Cross-flow/Down-flow"),
    "Number of Rows": ("Number of Rows", "# of Rows", "Rows", "Row Count", "No. Of Rows"),
    "Tank Material": ("Tank Material",),
}
CAPITALIZED_SPECS = ("Construction", "Tank Material", "Flow", "Number of Rows")
PORTS = ("Inlet", "Outlet")
BOX_DIMENSIONS = ("Box Length (in)", "Box Width (in)", "Box Height (in)")
CORE_DIMENSIONS = ("Core Length (in)", "Core Width (in)", "Core Thickness (in)")
FRACTIONS = {
    " 1/2": " ½", " 1/3": " ⅓", " 2/3": " ⅔", " 1/4": " ¼", " 3/4": " ¾", " 1/5": " ⅕", " 2/5": " ⅖", " 3/5": " ⅗",
    " 4/5": " ⅘", " 1/6": " ⅙", " 5/6": " ⅚", " 1/8": " ⅛", " 3/8": " ⅜", " 5/8": " ⅝", " 7/8": " ⅞",
}
NO_PRICE_TEXT = "Contact for pricing"
IN_STOCK_URL = "https://schema.org/InStock"
OUT_OF_STOCK_URL = "https://schema.org/OutOfStock"
CONFIRMED_BADGE = "Your Vehicle"
POSSIBLE_BADGE = "Possible Match"

# --- import faults ---------------------------------------------------------------------------------------------------
IMPORT_NO_PARTS = 'Missing or invalid "parts" array.'
IMPORT_EMPTY = "No parts found in JSON file."
IMPORT_BROKEN = "The document cannot be read."
