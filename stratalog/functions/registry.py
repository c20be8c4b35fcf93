"""Registry of modules: codecs and sources by content type; the first of a type stays."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

VERSION = 1
MOST = 32


@dataclass(frozen=True)
class Module:
    name: str
    content_type: int
    version: int = VERSION
    encode: Callable | None = None
    decode: Callable | None = None
    probe: Callable[[bytes], bool] | None = None
    functions: dict[str, object] = field(default_factory=dict)  # SQL name -> UDF
    sources: tuple[type, ...] = ()  # Python data sources


class Registry:
    def __init__(self) -> None:
        self.modules: dict[int, Module] = {}

    def register(self, module: Module) -> bool:
        """False for another version, a type that is taken, or a full registry."""
        if module.version != VERSION or module.content_type in self.modules or len(self.modules) >= MOST:
            return False
        self.modules[module.content_type] = module
        return True

    def find(self, content_type: int) -> Module | None:
        return self.modules.get(content_type)

    def probe(self, data: bytes) -> Module | None:
        """The first module, in order of registration, that knows data."""
        return next((m for m in self.modules.values() if m.probe and m.probe(data)), None)

    def load(self, package: str) -> int:
        """Registers MODULE of each module of a package; how many were taken."""
        found = importlib.import_module(package)
        names = [m.name for m in pkgutil.iter_modules(found.__path__, f"{package}.")]
        return sum(self.register(m) for n in names if (m := getattr(importlib.import_module(n), "MODULE", None)) is not None)

    def install(self, spark: SparkSession) -> None:
        for m in self.modules.values():
            for name, f in m.functions.items():
                spark.udf.register(name, f)
            for source in m.sources:
                spark.dataSource.register(source)

    def listing(self, spark: SparkSession) -> DataFrame:
        rows = [(m.name, m.content_type, m.version, m.encode is not None, m.decode is not None) for m in self.modules.values()]
        return spark.createDataFrame(rows, "name string, content_type int, version int, encodes boolean, decodes boolean")


def default() -> Registry:
    from stratalog.functions import codecs
    from stratalog.model import PRESS_MAGIC
    from stratalog.sources import ALL

    registry = Registry()
    registry.register(Module("raw", 1, encode=bytes, decode=bytes, probe=lambda d: not d.startswith((b"SLPK", PRESS_MAGIC)), functions={"sha3_256": codecs.sha3_256, "shake_256": codecs.shake_256, "xxhash32": codecs.xxhash32, "base32_decode": codecs.base32_decode}, sources=ALL))
    registry.register(Module("press", 2, encode=codecs.pack_bytes, decode=codecs.unpack_bytes, probe=lambda d: d.startswith((b"SLPK", PRESS_MAGIC)), functions={"pack_bytes": codecs.pack, "unpack_bytes": codecs.unpack}))
    return registry
