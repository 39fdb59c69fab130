"""Path expressions. All are plain column expressions, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions (without the dot) that mark a file as binary.
BINARY_EXTENSIONS = (
    "doc", "xls", "ppt", "docx", "xlsx", "pptx", "dot", "dotx", "ods", "odm", "odt", "ott", "pdf",
    "o", "a", "obj", "lib", "dll", "so", "exe",
    "jar", "zip", "z", "gz", "tar", "rar", "7z",
    "pdb", "idb", "ilk", "bsc", "ncb", "sbr", "pch",
    "bmp", "dib", "jpg", "jpeg", "png", "gif", "ico", "pcd", "wmf", "emf", "xcf", "tiff", "xpm",
    "gho", "mp3", "wma", "wmv", "wav", "avi",
)
# Image types that count as text.
TEXT_IMAGE_TYPES = ("image/x-xbitmap", "image/x-xpixmap")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_path(path: Column | str) -> Column:
    """Collapse runs of ``/``; a trailing slash stays."""
    return F.regexp_replace(_col(path), "/+", "/")


def base_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def _strip_last_component(path: Column) -> Column:
    last = F.substring_index(path, "/", -1)
    return F.left(path, F.greatest(F.length(path) - F.length(last) - F.lit(1), F.lit(0)))


def parent_dir(path: Column | str) -> Column:
    """Directory part without its trailing slash; ``/`` for a top-level entry."""
    p = _col(path)
    return F.when(
        F.locate("/", F.substring(p, 2, 2147483647)) == 0,
        F.when(p.startswith("/"), F.lit("/")).otherwise(F.lit("")),
    ).otherwise(_strip_last_component(p))


def file_type(path: Column | str) -> Column:
    """Extension with its dot, empty if none; leading dots do not count."""
    return F.regexp_extract(_col(path), r"[^./][^/]*(\.[^./]*)$", 1)


def dir_prefix(path: Column | str, scope: str = "/", depth: int = 2) -> Column:
    """The first ``depth`` directories below ``scope``, with ``scope`` in front."""
    if not scope:
        raise ValueError("scope must not be empty")
    rest = F.substring(_col(path), len(scope) + 1, 2147483647)
    return F.concat(
        F.lit(scope), F.substring_index(_strip_last_component(rest), "/", depth)
    )


def relative_path(path: Column | str, scope: str = "/") -> Column:
    p = _col(path)
    if scope == "/":
        return p
    return F.when(
        p.startswith(scope), F.substring(p, len(scope) + 1, 2147483647)
    ).otherwise(p)


def ancestors(path: Column | str, include_self: bool = False) -> Column:
    """All directories above a path, each with a trailing slash, ``/`` first.

    Turning "path under directory" into an equality on one of these keeps prefix
    joins hash joins; the array is as long as the path is deep.
    """
    p = _col(path)
    whole = F.concat(F.rtrim(p, F.lit("/")), F.lit("/")) if include_self else F.rtrim(p, F.lit("/"))
    parts = F.split(whole, "/")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")),
    )


def is_binary(path: Column | str, mime_type: Column | str | None = None,
              extensions: tuple[str, ...] = BINARY_EXTENSIONS) -> Column:
    """Known binary extension (lower or all upper case), else a non-text type."""
    known = ["." + e for e in extensions] + ["." + e.upper() for e in extensions]
    p = _col(path)
    by_ext = F.concat(F.lit("."), F.substring_index(base_name(p), ".", -1)).isin(known) & (
        F.locate(".", base_name(p)) > 0
    )
    if mime_type is None:
        return by_ext
    m = _col(mime_type)
    textual = m.startswith("text/") | m.isin(*TEXT_IMAGE_TYPES)
    return by_ext | (m.isNotNull() & ~textual)
