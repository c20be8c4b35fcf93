"""Tables of the engine: schemas and the names of codes."""

from __future__ import annotations

from pyspark.sql import types as T

#: Magic bytes of the formats.
CONTAINER_MAGIC, IMAGE_MAGIC, PRESS_MAGIC, VOLUME_MAGIC, LOG_MAGIC = b"CUTE", b"CFSP", b"PRSS", b"VOLM", b"WALR"
CONTAINER_VERSION = 5

#: Content types by code.
CONTENT_TYPES = {0: "unknown", 1: "raw", 2: "press", 3: "crypt", 4: "film", 5: "depo"}
COMPRESSED, ENCRYPTED = 1, 2

#: Log entry types by code.
LOG_TYPES = {1: "created", 2: "modified", 3: "wrapped", 4: "layered", 5: "accessed", 6: "linked", 7: "variant", 8: "collection", 9: "sealed", 255: "custom"}

#: Ledger actions by code.
LEDGER_ACTIONS = {0: "created", 1: "heartbeat", 2: "attempt", 3: "consumed", 4: "expired"}

#: Wrap types by code.
WRAP_TYPES = {
    1: "image", 2: "spectral", 3: "audio", 4: "video", 5: "scene", 6: "geometry", 7: "material", 8: "document", 9: "model", 10: "font", 11: "archive", 12: "stream",
    13: "timeline", 14: "lut", 15: "profile", 16: "texture", 17: "sprite", 18: "skeleton", 19: "animation", 20: "tilemap", 21: "particle", 22: "shader", 23: "level",
    24: "physics", 25: "navmesh", 26: "dialogue", 27: "voxel", 28: "terrain", 29: "prefab", 30: "exr-ext", 31: "dpx", 32: "spreadsheet", 33: "presentation", 34: "richtext",
    35: "form", 36: "database", 37: "chart", 38: "diagram", 39: "calendar", 40: "contacts", 41: "email", 42: "notebook", 43: "vector", 48: "hdr", 49: "aces", 65280: "custom",
}

#: Default wraps of file extensions (case-sensitive).
WRAPS_OF_EXTENSIONS = {
    "image": "png jpg jpeg bmp tga gif webp ico psd tiff tif", "image exr-ext": "exr", "image dpx": "dpx cin", "image hdr": "hdr rgbe", "audio": "wav flac aac mp3", "video": "mov mp4 mkv",
    "scene": "usd usda usdc usdz gltf glb obj fbx", "model": "onnx mlmodel tflite pt", "texture": "dds ktx ktx2 pvr basis", "shader": "spv spirv metal hlsl glsl vert frag comp wgsl",
    "tilemap": "tmx tmj", "voxel": "vox", "lut": "cube 3dl", "spreadsheet": "xlsx xls csv tsv ods numbers", "presentation": "pptx ppt odp key", "richtext": "docx doc odt rtf pages",
    "document": "pdf md txt html htm", "database": "db sqlite sqlite3", "notebook": "ipynb", "vector": "svg", "calendar": "ics ical", "contacts": "vcf vcard", "email": "eml msg", "font": "ttf otf woff woff2",
}

#: Archive formats of file extensions (case-sensitive but for ZIP).
ARCHIVES_OF_EXTENSIONS = {"zip": "zip ZIP jar ipa apk docx xlsx pptx", "tar": "tar", "tar.gz": "gz tgz", "tar.bz2": "bz2 tbz2", "tar.xz": "xz txz", "7z": "7z", "rar": "rar", "container": "cute"}

#: Flags of a locked file's header.
LOCK_FLAGS = {"folder": 1, "timed": 2, "delayed": 4, "fused": 8, "purge": 16, "container": 32, "keychain": 64, "remote": 128}

#: Film curves.
FILM_CURVES = {
    "default": {"base_fog": -0.15, "toe_limit": 0.002, "shoulder_limit": 10.0, "gamma": 0.65, "max_density": 3.0, "iso": 400.0},
    "negative": {"base_fog": -0.25, "toe_limit": 0.001, "shoulder_limit": 50.0, "gamma": 0.55, "max_density": 3.5, "iso": 800.0},
    "reversal": {"base_fog": -0.08, "toe_limit": 0.01, "shoulder_limit": 5.0, "gamma": 0.80, "max_density": 4.0, "iso": 100.0},
    "cinema": {"base_fog": -0.20, "toe_limit": 0.0005, "shoulder_limit": 100.0, "gamma": 0.50, "max_density": 5.0, "iso": 800.0},
}

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def table_of(columns: str) -> T.StructType:
    """Without a session, which a DDL string would need."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


ASSETS = table_of("idx long, path string, offset long, stored_size long, original_size long, flags int, wrap_type int, grp string, hash binary")
LOG_ENTRIES = table_of(
    "log string, type int, version int, flags int, sequence long, timestamp long, content_type int, layer_flags int, wrap_count int, original_size long, stored_size long, collection_id binary, collection_seq long, content_hash binary, prev_hash binary"
)
ARCHIVE_ENTRIES = table_of("archive string, idx int, path string, size long, compressed_size long, mtime long, crc32 long, permissions int, method int, is_dir boolean, encrypted boolean, symlink boolean, content binary")
CONTAINERS = table_of("path string, version int, type_code int, layer_flags int, payload_size long, original_size long, meta_size long, hash binary, meta binary, payload binary, intact boolean")
VOLUME_ASSETS = table_of("volume string, idx int, path string, offset long, stored_size long, original_size long, flags int, wrap_type int, grp int, hash binary, content binary")
