"""Sources of hits: a registry of providers, and a Python data source that reads a provider's answers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = ("images", "video", "llm", "transcription", "embedding", "notify")
CANDIDATES = "query string, provider string, hit int, url string, page string, title string, width int, height int, creator string, license string"

_REGISTRY: dict[str, dict[str, tuple[Callable, Callable[[], bool]]]] = {k: {} for k in KINDS}


def register(kind: str, name: str, source: Callable, ready: Callable[[], bool] = lambda: True) -> None:
    _REGISTRY[kind][name] = (source, ready)


def names(kind: str) -> list[str]:
    return sorted(_REGISTRY[kind])


def _is_ready(kind: str, name: str) -> bool:
    try:
        return name in _REGISTRY[kind] and bool(_REGISTRY[kind][name][1]())
    except Exception:  # a provider that cannot say is not ready
        return False


def resolve(kind: str, name: str, offline: bool = False) -> str:
    """The provider to use: the fake one offline, else the one named if it is ready, else the fake one; an error without either."""
    if not offline and _is_ready(kind, name):
        return name
    if _is_ready(kind, "fake"):
        return "fake"
    raise LookupError(f"no provider of {kind}")


def provider(kind: str, name: str, offline: bool = False) -> Callable:
    return _REGISTRY[kind][resolve(kind, name, offline)][0]


def ready_providers(kind: str, wanted: list[str]) -> list[str]:
    """Those wanted that are ready, each once, in order."""
    return [n for n in dict.fromkeys(wanted) if _is_ready(kind, n)]


def fake_images(query: str, limit: int) -> Iterator[tuple]:
    """Made-up hits, the same for the same query; every seventh repeats the one before under another url."""
    for i in range(limit):
        seed = hashlib.sha256(f"{query}:{i - (i % 7 == 6)}".encode()).hexdigest()
        suffix = "?size=large" if i % 7 == 6 else ""
        yield (query, "fake", i, f"https://images.example.org/{seed[:12]}.jpg{suffix}", f"https://images.example.org/page/{seed[:12]}", f"{query} {i}", 640 + int(seed[:3], 16) % 2000, 480 + int(seed[3:6], 16) % 1200, "", "CC0" if i % 2 else "")


register("images", "fake", fake_images)


class CandidateSource(DataSource):
    """spark.read.format("candidates") with options queries (by newlines), provider, limit, offline: one partition for each query."""

    @classmethod
    def name(cls) -> str:
        return "candidates"

    def schema(self) -> str:
        return CANDIDATES

    def reader(self, schema) -> DataSourceReader:
        return _CandidateReader(self.options)


class _CandidateReader(DataSourceReader):
    def __init__(self, options: dict):
        self.queries = [q for q in options.get("queries", "").split("\n") if q]
        self.search = provider("images", options.get("provider", "fake"), options.get("offline", "true").lower() in ("1", "true", "yes", "on"))
        self.limit = int(options.get("limit", 30))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in self.queries] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            yield from self.search(partition.value, self.limit)


def read_candidates(spark: SparkSession, queries: list[str], name: str = "fake", limit: int = 30, offline: bool = True) -> DataFrame:
    spark.dataSource.register(CandidateSource)
    return spark.read.format("candidates").options(queries="\n".join(queries), provider=name, limit=limit, offline=str(offline)).load()
