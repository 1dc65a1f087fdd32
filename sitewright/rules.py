"""Site rules: the pattern lists, maps and limits every operator takes as data.

Three rule sets exist (``STANDARD``, ``FAST`` and ``FINAL``); they differ in
normalisation, skip and dynamic patterns, hosts and link classes. Use
``dataclasses.replace(STANDARD, hosts=(...,))`` to aim one at another site.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: patterns, maps and limits that decide the results ---------

DOCUMENT_FILES = r"\.(pdf|doc|docx|xls|xlsx|ppt|pptx|zip|rar|tar|gz)$"

STANDARD_SKIP = (
    DOCUMENT_FILES,
    r"\.(jpg|jpeg|png|gif|bmp|svg|ico|webp)$",
    r"\.(css|js|json|xml|txt)$",
    r"mailto:",
    r"tel:",
    r"javascript:",
    r"#",
)

FAST_SKIP = (
    DOCUMENT_FILES,
    r"\.(jpg|jpeg|png|gif|bmp|svg|ico|webp|css|js)$",
    r"mailto:|tel:|javascript:|#$",
)

STANDARD_DYNAMIC = (
    "/jobs",
    "/search",
    "/filter",
    "/category",
    "/location",
    "jobs-in-",
    "-jobs-in-",
)
FAST_DYNAMIC = (
    "/jobs-in-",
    "/search",
    "/filter",
    r"/jobs\?",
    "/category",
    "/location",
)
FINAL_DYNAMIC = ("/browse-jobs", r"/jobs\?", r"/search\?", "/jobs-in-")

JOB_RELATED = (
    "/jobs-in-",
    "/browse-jobs",
    "/job/",
    "/jobs/",
    "/search",
    "/category",
    "/location",
)

SAME_SITE_BLOCKED = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip",
    ".jpg", ".jpeg", ".png", ".gif", ".css", ".js",
)

URL_TYPE_PRIORITY = {
    "homepage": 1.0,
    "main_category": 0.9,
    "job_listing": 0.8,
    "location_page": 0.7,
    "individual_job": 0.6,
    "company_page": 0.7,
    "blog_post": 0.5,
    "static_page": 0.5,
    "default": 0.5,
}

URL_TYPE_CHANGEFREQ = {
    "homepage": "daily",
    "main_category": "daily",
    "job_listing": "daily",
    "location_page": "weekly",
    "individual_job": "daily",
    "company_page": "weekly",
    "blog_post": "monthly",
    "static_page": "monthly",
    "default": "weekly",
}

SITEMAP_NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
MAX_URLS_PER_SITEMAP = 50_000
SITEMAP_PATHS = (
    "/sitemap.xml",
    "/sitemap_index.xml",
    "/sitemaps.xml",
    "/sitemap/sitemap.xml",
    "/wp-sitemap.xml",
)

SEARCH_ENDPOINTS = ("/search", "/jobs", "/find-jobs", "/job-search")
API_ENDPOINTS = (
    "/api/jobs",
    "/api/search",
    "/api/locations",
    "/api/categories",
    "/jobs/api",
    "/search/api",
    "/ajax/jobs",
    "/ajax/search",
)
SEARCH_PARAMS = (
    ("q", "manager"),
    ("q", "analyst"),
    ("q", "advisor"),
    ("location", "london"),
    ("category", "banking"),
    ("type", "permanent"),
    ("level", "senior"),
)

COMPANY_WORDS = r"(?i)\b(bank|insurance|finance|capital|investment|fund|asset|wealth)\b"
PAGINATION_WORDS = ("next", "previous", "prev", "→", "←", "»", "«")

SCRIPT_URL_PATTERNS = (
    r"""(?i)["']([^"']*(?:jobs|search|category|location)[^"']*)["']""",
    r"""(?i)url\s*:\s*["']([^"']+)["']""",
    r"""(?i)href\s*:\s*["']([^"']+)["']""",
    r"""(?i)window\.location\s*=\s*["']([^"']+)["']""",
)

LOCATION_TEMPLATES = (
    "/jobs-in-{location}",
    "/{location}-jobs",
    "/browse-jobs?location={location}",
    "/search?location={location}",
    "/careers/{location}",
)
CATEGORY_TEMPLATES = (
    "/{category}-jobs",
    "/jobs/{category}",
    "/browse-jobs?category={category}",
    "/search?category={category}",
    "/careers/{category}",
)
TYPE_TEMPLATES = ("/{type}-jobs", "/jobs?type={type}", "/browse-jobs?type={type}")
LEVEL_TEMPLATES = ("/{level}-jobs", "/jobs?level={level}", "/browse-jobs?level={level}")
SALARY_TEMPLATES = ("/jobs?salary={salary}", "/browse-jobs?salary={salary}")
COMBO_TEMPLATES = (
    "/{category}-jobs-in-{location}",
    "/browse-jobs?category={category}&location={location}",
    "/search?category={category}&location={location}",
)
PATTERN_TEMPLATES = (
    "/jobs-in-{location}",
    "/{location}-jobs",
    "/jobs/{category}",
    "/{category}-jobs",
    "/jobs/{category}/{location}",
    "/search?location={location}",
    "/search?category={category}",
    "/search?q={keyword}",
    "/jobs?location={location}",
    "/jobs?category={category}",
    "/jobs?type={type}",
    "/jobs?level={level}",
)
PATTERN_COMBO_TEMPLATES = ("/jobs/{category}/{location}", "/{category}-jobs-in-{location}")

JOB_TYPES = (
    "full-time", "part-time", "contract", "temporary", "permanent", "graduate", "internship",
)
JOB_LEVELS = (
    "entry", "junior", "senior", "manager", "director", "head", "chief", "executive",
)
SALARY_BANDS = ("20k-30k", "30k-40k", "40k-50k", "50k-60k", "60k-80k", "80k-100k", "100k+")

# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Rules:
    """What a crawl counts as its own, skips, renders and keeps."""

    name: str
    hosts: tuple[str, ...]
    base_urls: tuple[str, ...]
    skip: tuple[str, ...]
    dynamic: tuple[str, ...]
    normalization: str
    link_rels: tuple[str, ...]
    use_area: bool = False
    use_forms: bool = False
    use_data_location: bool = False
    use_company: bool = False
    select_variant: str | None = None
    generate: bool = False
    max_depth: int = 5
    urls_per_sitemap: int = MAX_URLS_PER_SITEMAP


_BASES = ("https://www.example.com", "https://example.org")
_HOSTS = ("example.com", "www.example.com", "example.org", "www.example.org")

STANDARD = Rules(
    name="standard",
    hosts=_HOSTS,
    base_urls=_BASES,
    skip=STANDARD_SKIP,
    dynamic=STANDARD_DYNAMIC,
    normalization="standard",
    link_rels=("canonical", "alternate", "next", "prev"),
    use_area=True,
)

FAST = Rules(
    name="fast",
    hosts=_HOSTS,
    base_urls=_BASES,
    skip=FAST_SKIP,
    dynamic=FAST_DYNAMIC,
    normalization="fast",
    link_rels=("canonical", "alternate"),
    use_forms=True,
    use_data_location=True,
    select_variant="fast",
)

FINAL = Rules(
    name="final",
    hosts=("example.com", "www.example.com"),
    base_urls=("https://www.example.com",),
    skip=FAST_SKIP,
    dynamic=FINAL_DYNAMIC,
    normalization="fast",
    link_rels=("canonical", "alternate"),
    use_forms=True,
    use_company=True,
    select_variant="final",
    generate=True,
    max_depth=4,
)
