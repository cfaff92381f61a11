"""Values that outside payloads and stored rows depend on.

Everything here is a fixed value: changing one changes query results.
"""

# Payload field name -> canonical column name.
# Several aliases share one target; the last field of a payload wins.
FIELD_ALIASES = {
    # transaction sheets
    "DEALDATE": "transaction_date",
    "DEALDATETIME": "transaction_datetime",
    "FULLADRESS": "full_address",
    "DISPLAYADRESS": "display_address",
    "GUSH": "block",
    "DEALNATUREDESCRIPTION": "property_type",
    "ASSETROOMNUM": "rooms",
    "FLOORNO": "floor",
    "DEALAMOUNT": "price",
    "NEWPROJECTTEXT": "new_project_text",
    "PROJECTNAME": "project_name",
    "BUILDINGYEAR": "building_year",
    "YEARBUILT": "year_built",
    "BUILDINGFLOORS": "building_floors",
    "KEYVALUE": "key_value",
    "TYPE": "type",
    "POLYGON_ID": "polygon_id",
    "TREND_IS_NEGATIVE": "trend_is_negative",
    "TREND_FORMAT": "trend_format",
    "city_name": "city",
    "street": "street",
    # price-index pages
    "percent": "percent_change",
    "percentYear": "percent_change_annual",
    "currBase": "current_base",
    "prevBase": "previous_base",
    "baseDesc": "base_description",
    "monthDesc": "month_name_he",
    # deal pages
    "dealAmount": "price",
    "dealDate": "transaction_date",
    "propertyTypeDescription": "property_type",
    "assetArea": "area_sqm",
    "floorNumber": "floor",
    "addressDescription": "full_address",
    "objectid": "object_id",
    "dealNatureDescription": "property_type",
    "assetRoomNum": "rooms",
    "newProjectText": "new_project_text",
    "projectName": "project_name",
    "buildingYear": "building_year",
    "buildingFloors": "building_floors",
    "polygonId": "polygon_id",
}

# Source names, retrieval methods and the rows seeded into the registry.
ARCHIVE_SOURCE = "odata_il_nadlan"
DEALS_SOURCE = "tax_authority_nadlan"
INDEX_SOURCE = "cbs_housing"
LISTINGS_SOURCE = "madlan_for_sale"

RETRIEVAL_METHODS = ("http_get", "http_post", "zip_download", "ftp", "mock", "browser")
PARSING_STATUSES = ("raw", "parsed", "failed", "skipped")
JOB_STATUSES = ("pending", "running", "completed", "failed", "partial")
SOURCE_STATUSES = ("active", "planned", "disabled")

# (name, display_name, description, status, source_url, tags)
SEED_SOURCES = (
    (
        "odata_il_nadlan",
        "odata.org.il — Real Estate Transactions",
        "Real estate transaction data from the Israeli open data portal",
        "active",
        "https://www.odata.org.il/dataset/84f2bc2d-87a0-474e-a3ea-63d7bb9b5447"
        "/resource/5eb859da-6236-4b67-bcd1-ec4b90875739/download/.zip",
        ["real-estate", "transactions"],
    ),
    (
        "tax_authority_nadlan",
        "Israel Tax Authority Transactions",
        "Real estate transaction data from the Israeli Tax Authority via Govmap API",
        "active",
        "https://www.govmap.gov.il/api",
        ["real-estate", "transactions", "tax-authority"],
    ),
    (
        "cbs_housing",
        "CBS Housing Statistics",
        "Housing price indices and rent statistics from the Central Bureau of Statistics",
        "active",
        "https://api.cbs.gov.il/index/data/price",
        ["housing", "statistics", "cbs", "price-index"],
    ),
    (
        "madlan_for_sale",
        "Madlan — For Sale Listings",
        "Live for-sale property listings scraped from madlan.co.il",
        "active",
        "https://www.madlan.co.il/for-sale/ישראל",
        ["real-estate", "listings", "madlan", "for-sale"],
    ),
)

# Constants written into records and jobs.
SCHEMA_VERSION = "v1"
INDEX_PROVENANCE = "cbs"
DEALS_PROVENANCE = "govmap"
ALL_SOURCES_JOB = "all"
STALE_JOB_MESSAGE = "Recovered on service restart — job interrupted"

# Listing pages.
LISTING_URL_PREFIX = "https://www.madlan.co.il/listing/"
IMAGE_URL_PREFIX = "https://images2.madlan.co.il/"
EMBEDDED_STATE_PATTERN = r"window\.__SSR_HYDRATED_CONTEXT__\s*=\s*(.+)"
GROUND_FLOOR_WORD = "קרקע"
BASEMENT_WORD = "מרתף"
JS_LITERALS = (("undefined", "null"), ("Infinity", "999999999"), ("NaN", "null"))

# Data-testid of each listing-card and listing-detail element.
CARD_ELEMENTS = {
    "price": "price",
    "address": "address",
    "rooms": "rooms",
    "area": "floor-size",
    "floor": "floor",
    "property_type": "asset-classification",
    "neighborhood": "neighborhood",
}
DETAIL_ELEMENTS = {
    "description": "description",
    "agent_name": "agent-name",
    "agent_phone": "agent-phone",
    "listing_date": "listing-date",
    "total_floors": "total-floors",
}
IMAGE_GALLERY = "image-gallery"
LISTING_HREF = "/listing/"

# Limits.
DEALS_PAGE_LIMIT = 100
LISTINGS_PAGE_SIZE = 50
STATUS_LOOKBACK_JOBS = 200
MAX_PAGE_LIMIT = 100
DEFAULT_PAGE_LIMIT = 20

# Layers offered when none is configured, and layer kinds.
# (id, name, type, color, source, min_zoom, max_zoom, opacity)
DEFAULT_LAYERS = (
    ("properties", "Properties", "fill", "#3388ff", "properties", None, None, 0.7),
    ("districts", "Districts", "line", "#ff6b6b", "districts", None, None, 0.9),
)
LAYER_TYPES = ("fill", "line", "circle", "symbol")
