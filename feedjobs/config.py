"""Configuration of the feed: terms, kinds, windows and limits. Every value can be replaced."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# The default domain vocabulary.
TERMS = (
    "photogrammetry", "photogrammetric", "remote sensing", "geoinformatics", "geo-informatics", "geoinformation", "geospatial",
    "geomatics", "geodesy", "GIS", "GeoAI", "geo-AI", "earth observation", "SAR", "InSAR", "DInSAR", "LiDAR", "point cloud",
    "3D reconstruction", "digital twin", "CityGML", "IFC", "BIM", "UAV", "drone mapping", "hyperspectral", "multispectral",
    "Sentinel-1", "Sentinel-2", "Landsat", "Fernerkundung", "Photogrammetrie", "Geoinformatik", "Geodäsie", "Geomatik",
    "Copernicus", "Digital Earth", "geodetic", "cartography", "GNSS", "spatial data", "Earth system", "satellite",
    "geovisualization", "mapping",
)
WEAK_TERMS = ("mapping", "satellite", "Copernicus", "spatial data", "Earth system", "digital twin", "3D reconstruction", "BIM", "IFC", "UAV")
EXTRA_TERMS = (
    "geographic information", "geographical information", "GIScience", "GI Science", "geomatics", "surveying engineering", "geodetic",
    "geospatial", "Geoinformation", "Geoinformatik", "Fernerkundung",
)
EXCLUDE = ("Schülerpraktikum", "Schulpraktikum", "Girls' Day", "Boys' Day", "Ausbildung", "Administrative Committee", "AdCom", "Newsletter", "Membership", "Login", "Sign in")
KINDS = {
    "job": (
        "PhD", "Ph.D.", "doctoral", "doctorate", "postdoc", "post-doc", "postdoctoral", "research assistant", "research associate",
        "research fellow", "scholarship", "vacancy", "job opening", "position", "Mitarbeiter", "Doktorand", "scientist", "researcher",
        "engineer", "EngD", "assistant", "professor", "lecturer", "Wissenschaftler", "Ingenieur", "internship", "trainee",
        "graduate programme", "early career",
    ),
    "course": ("MSc", "M.Sc.", "Master", "master's", "bachelor", "programme", "program", "course", "study programme", "Studiengang"),
    "event": (
        "conference", "workshop", "symposium", "summer school", "winter school", "call for papers", "CFP", "congress", "colloquium",
        "webinar", "summit", "2026", "2027", "2028", "meeting", "forum", "days", "Tagung", "Konferenz", "Jahrestagung", "Symposium",
        "Kolloquium", "school",
    ),
    "paper": ("arXiv", "preprint", "journal", "we propose", "we present", "benchmark", "dataset", "study"),
}
TOP_VENUES = (
    "ISPRS Journal of Photogrammetry", "Remote Sensing of Environment", "IEEE Transactions on Geoscience and Remote Sensing",
    "International Journal of Applied Earth Observation", "^Nature( Communications| Geoscience| Climate Change| Reviews Earth & Environment)?$",
    "^Science$", "Photogrammetric Record", "Journal of Geodesy", "Pattern Analysis and Machine Intelligence",
    "International Journal of Computer Vision", "Computer Vision and Pattern Recognition", "International Conference on Computer Vision",
    "European Conference on Computer Vision", "Neural Information Processing Systems", "Earth System Science Data",
    "Geophysical Research Letters", "International Journal of Geographical Information Science", "Computers, Environment and Urban Systems",
    "Science of Remote Sensing", "IEEE Geoscience and Remote Sensing Magazine",
)
RETAIN_DAYS = {"job": 30, "course": 120, "event": 60, "paper": 60, "news": 7}
SOURCE_TYPES = ("rss", "html", "openalex", "arbeitsagentur", "jobsacuk", "euraxess", "adzuna", "page", "discovered", "isprs-calendar", "discovered-events", "curated")
SOURCE_KINDS = ("job", "course", "event", "news", "paper", "auto")
#: Types of loose boards, whose adverts are verified one by one.
VERIFIED_TYPES = ("jobsacuk", "euraxess")
#: Types whose listing shows everything that is open, so an item that is gone from it is over.
FULL_LISTING_TYPES = ("html", "jobsacuk", "euraxess", "adzuna", "page", "discovered", "discovered-events", "curated")


@dataclass(frozen=True)
class FeedConfig:
    terms: Sequence[str] = TERMS
    weak_terms: Sequence[str] = WEAK_TERMS
    exclude: Sequence[str] = EXCLUDE
    kinds: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(KINDS))
    retain_days: Mapping[str, int] = field(default_factory=lambda: dict(RETAIN_DAYS))
    default_retain_days: int = 45
    min_impact: int = 25
    top_venues: Sequence[str] = TOP_VENUES
    open_posting_days: int = 45
    full_listing_types: Sequence[str] = FULL_LISTING_TYPES
    verified_types: Sequence[str] = VERIFIED_TYPES
    verdict_version: int = 2
    verdict_days: int = 30
    verify_budget: int = 120
    verify_chars: int = 1500
    recheck_days: int = 3
    lookup_budget: int = 80
    max_failures: int = 5
    new_days: int = 7
    summary_chars: int = 300

    @property
    def strong_terms(self) -> list[str]:
        return [t for t in self.terms if t not in set(self.weak_terms)]


@dataclass(frozen=True)
class CrawlConfig:
    """Limits of a selection of stored pages of one site."""

    max_depth: int = 3
    max_pages: int = 45
    max_sitemap_urls: int = 60
    max_items: int = 12
    max_hosts: int = 160
    site_mode: str = "domain"


PROGRAMME_CRAWL = CrawlConfig()
EVENT_CRAWL = CrawlConfig(max_depth=2, max_pages=12, max_items=15, site_mode="subdomain")
